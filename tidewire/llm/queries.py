"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base, bpe_count, chat, decontaminate, importance, language_id, line_dedup, merkle, mixing, near_dedup, quality_classifier, quality_rules, token_files, warc


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = quality_classifier.train(docs, base.table(spark, sf_dir, "labels"))
    return quality_classifier.score(docs, trees).select(
        "doc_id",
        (base.crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(base.table(spark, sf_dir, "documents"), width=3, percent=85)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs, min_chars=20, min_docs=3).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256")
    )


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs, path = base.table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), public_tokenizers.path("piece_bpe_32k.model")
    model = language_id.train(docs, path)
    return language_id.predict(docs.select("doc_id", "text"), path, *model).select(
        "doc_id", (base.crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score"
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.judged(docs, base.table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr"
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.taken(base.table(spark, sf_dir, "documents").select("doc_id", "source", "text"), (5, 2, 1), 3)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(base.table(spark, sf_dir, "documents"), base.table(spark, sf_dir, "benchmark"))


def op8_chat_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All steps of op 8: the conversations in reply order. op8_chat_formatting has the links of each message."""
    return chat.conversations(base.table(spark, sf_dir, "conversations"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.replies(base.table(spark, sf_dir, "conversations"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = base.Scratch(spark, "warc").root
    warc.write(base.table(spark, sf_dir, "pages"), root, least=0)
    return warc.read_back(spark, root).drop("url")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = base.table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_count.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json")).select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > 2048).alias("over_limit"),
    )


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resampled(base.table(spark, sf_dir, "documents"), base.table(spark, sf_dir, "benchmark"), percent=25, least_words=20)
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(base.crc_mod(F.col("doc_id"), 3) == 0, changed).otherwise(F.col("text"))
    return merkle.proofs(base.table(spark, sf_dir, "documents"), tampered)


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    root = base.Scratch(spark, "ids").root
    token_files.write(base.table(spark, sf_dir, "documents"), root, public_tokenizers.path("byte_bpe_50k.json"), end=0)
    return token_files.documents(spark, root)


_BLANKS = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _decontamination_sql(size: int = decontaminate.WINDOW) -> str:
    units = ", ".join(f"'{u}'" for u in decontaminate.UNITS)
    mark = r"regexp_replace({}, '([\p{{L}}\p{{N}},;] )(\p{{Lu}}\p{{Ll}})', '\1' || chr(2) || '\2', 'g')"
    # A match uses up the character before, so neighbours of a name need a second turn.
    marked = mark.format(mark.format("coalesce(text, '')"))
    lead = lambda c: [f"lead({c}, {k}) OVER w" if k else c for k in range(size)]
    return rf"""
WITH texts AS (
  SELECT doc_id AS id, text, true AS doc FROM documents WHERE doc_id IS NOT NULL
  UNION ALL SELECT DISTINCT item_id, text, false FROM benchmark WHERE item_id IS NOT NULL),
split AS (SELECT id, doc, regexp_extract_all(lower({marked}), '\x02?[\p{{L}}\p{{M}}]+|[0-9]+(?:[.,:/][0-9]+)*') AS t FROM texts),
flat AS (SELECT id, doc, unnest(t) AS v, generate_subscripts(t, 1) - 1 AS place, len(t) AS n FROM split),
before AS (SELECT *, lag(v) OVER (PARTITION BY doc, id ORDER BY place) AS p FROM flat),
typed AS (
  SELECT *, CASE WHEN ascii(v) = 2 THEN '<name>' WHEN ascii(v) BETWEEN 48 AND 57 THEN '<number>'
    WHEN ascii(p) BETWEEN 48 AND 57 AND v IN ({units}) THEN '<unit>' ELSE v END AS c FROM before),
win AS (
  SELECT id, doc, place, n, [{", ".join(lead("c"))}] AS cs, [{", ".join(lead("v"))}] AS vs
  FROM typed WINDOW w AS (PARTITION BY doc, id ORDER BY place)),
keyed AS (
  SELECT id, doc, place, list_filter(vs, lambda x: x IS NOT NULL) AS vs, 'c' || replace(array_to_string(vs, ' '), chr(2), '') AS literal,
    CASE WHEN 2 * len(list_filter(cs, lambda x: x[1] = '<')) > {size} THEN 'v' || array_to_string(vs, ' ') ELSE 'c' || array_to_string(cs, ' ') END AS key,
    len(list_filter(cs, lambda x: x[1] = '<')) > 0 AS slotted
  FROM win WHERE place + {size} <= n),
typed_items AS (SELECT id AS item_id, key, key AS hash, min(place) AS item_at, arg_min(vs, place) AS item_vs, bool_or(slotted) AS slotted FROM keyed WHERE NOT doc GROUP BY ALL),
items AS (SELECT * FROM typed_items UNION ALL SELECT id, key, literal, min(place), NULL, false FROM keyed WHERE NOT doc AND slotted GROUP BY id, key, literal),
totals AS (SELECT item_id, count(*) AS n_windows FROM typed_items GROUP BY item_id),
asked AS (SELECT id, place, key AS hash, vs, slotted FROM keyed WHERE doc UNION ALL SELECT id, place, literal, NULL, false FROM keyed WHERE doc AND slotted),
matched AS (
  SELECT d.id AS doc_id, i.item_id, i.key, d.place - i.item_at AS diagonal, item_vs, d.vs, i.slotted AND d.slotted AS slotted
  FROM asked d JOIN items i ON d.hash = i.hash),
pairs AS (SELECT doc_id, item_id, diagonal, unnest(item_vs) AS a, unnest(vs) AS b FROM matched WHERE slotted),
slots AS (
  SELECT doc_id, item_id, diagonal, bool_or(least <> most) AS torn, bool_or(least <> a OR most <> a) AS changed
  FROM (SELECT doc_id, item_id, diagonal, a, min(b) AS least, max(b) AS most FROM pairs GROUP BY ALL) GROUP BY ALL),
lines AS (
  SELECT id, doc, regexp_extract_all(lower(unnest(CASE WHEN doc THEN list_append(string_split(text, chr(10)), text) ELSE [text] END)), '[\p{{L}}\p{{M}}]+|[0-9]+(?:[.,:/][0-9]+)*') AS t
  FROM texts WHERE text IS NOT NULL),
few AS (SELECT DISTINCT id, doc, array_to_string(t, ' ') AS line FROM lines WHERE len(t) BETWEEN 1 AND {size} - 1)
SELECT DISTINCT d.id AS doc_id, i.id AS item_id, 1::BIGINT AS n_matched, 1::BIGINT AS n_windows, true AS same_values FROM few d JOIN few i ON d.line = i.line AND d.doc AND NOT i.doc
UNION ALL
SELECT m.doc_id, m.item_id, count(DISTINCT m.key) AS n_matched, t.n_windows, NOT bool_or(coalesce(s.changed, false)) AS same_values
FROM matched m JOIN totals t ON m.item_id = t.item_id
LEFT JOIN slots s ON m.doc_id = s.doc_id AND m.item_id = s.item_id AND m.diagonal = s.diagonal
WHERE NOT coalesce(s.torn, false) OR NOT m.slotted
GROUP BY m.doc_id, m.item_id, t.n_windows
HAVING 100 * count(DISTINCT m.key) >= {decontaminate.COVERED} * t.n_windows
"""


#: CRC-32 of a text, byte by byte over a table t of 256 remainders.
_CRC_TABLE = "list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda v, k: xor(v >> 1, 3988292384 * (v & 1))))"


def _crc_sql(text: str) -> str:
    octets = f"list_transform(range(1, length(hex(encode({text}))), 2), lambda i: ('0x' || substr(hex(encode({text})), i, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"


def _leaf_sql(**other: str) -> str:
    values = [other.get(c, f"{c}::VARCHAR") for c in merkle.FIELDS]
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({v}))::VARCHAR || ':' || {v}, '-')" for v in values) + ")"


SQL: dict[str, str] = {
    "op2_minhash_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), LOWER), '[^\x20\x09-\x0D]+') AS t FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) BETWEEN 1 AND 2 THEN [array_to_string(t, ' ')]
    ELSE list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, both_.v FROM reach r JOIN both_ ON r.other = both_.u),
c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT c.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.doc_id
""".replace("LOWER", _LOWER),
    "op3_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
  FROM documents),
keyed AS (SELECT *, translate(trim(line, {_BLANKS}), {_LOWER}) AS key FROM lines),
shared AS (
  SELECT key, max(doc_id) AS owner FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.doc_id, k.place, k.line, s.key IS NOT NULL AND k.doc_id <> s.owner AS gone
  FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
    "op6_mixing": r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5('11:' || coalesce(doc_id::VARCHAR, '-')) AS ord
  FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM src),
total AS (SELECT coalesce(sum(source_size), 0)::BIGINT AS budget FROM src),
fill(turn, rest, open_weight, capped) AS (
  SELECT 0, (SELECT budget FROM total), (SELECT sum(weight)::BIGINT FROM weighted), 0::BIGINT
  UNION ALL
  SELECT turn + 1,
    (SELECT budget FROM total) - (SELECT coalesce(sum(3 * source_size), 0)::BIGINT FROM weighted WHERE 3 * source_size * f.open_weight <= weight * f.rest),
    (SELECT coalesce(sum(weight), 0)::BIGINT FROM weighted WHERE NOT (3 * source_size * f.open_weight <= weight * f.rest)),
    (SELECT count(*) FROM weighted WHERE 3 * source_size * f.open_weight <= weight * f.rest)
  FROM fill f
  WHERE f.open_weight > 0 AND (SELECT count(*) FROM weighted WHERE 3 * source_size * f.open_weight <= weight * f.rest) <> f.capped),
done AS (SELECT rest, open_weight FROM fill ORDER BY turn DESC LIMIT 1),
goal AS (
  SELECT source, source_size,
    CASE WHEN open_weight = 0 THEN (3 * source_size)::DOUBLE
         ELSE least((3 * source_size)::DOUBLE, (weight * rest)::DOUBLE / open_weight::DOUBLE) END AS target
  FROM weighted, done),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM goal),
run AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS part,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.ord RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
    sum(d.size) OVER (PARTITION BY d.source, d.ord) AS own
  FROM sized d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN part > 0 AND upto - own / 2 <= part THEN 1 ELSE 0 END))::BIGINT AS taken
FROM run
""",
    "op7_decontamination": _decontamination_sql(),
    "op8_chat_formatting": r"""
WITH RECURSIVE msg AS (SELECT row_number() OVER () AS rid, conv_id, turn::BIGINT AS turn, role, coalesce(text, '') AS text FROM conversations),
split AS (SELECT rid, conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM msg),
leveled AS (
  SELECT *, length(regexp_replace(regexp_extract(line, '^((?:[ \t]*>)+)[ \t]?', 1), '[^>]', '', 'g')) AS level,
    regexp_replace(line, '^((?:[ \t]*>)+)[ \t]?', '') AS body FROM split),
lines AS (
  SELECT *, level = 0 AND regexp_matches(body, '(?i)^\s*(?:(?:on|am|le|el)\b.*\b(?:wrote|schrieb|écrit|escribió).*:|-+ ?original message ?-+)\s*$')
    AND coalesce(lead(level) OVER (PARTITION BY rid ORDER BY place), 0) > 0 AS heads FROM leveled),
own AS (SELECT rid, trim(string_agg(body, chr(10) ORDER BY place), BLANKS) AS content FROM lines WHERE level = 0 AND NOT heads GROUP BY rid),
runs AS (SELECT *, place - row_number() OVER (PARTITION BY rid, level ORDER BY place) AS run FROM lines WHERE level > 0),
passages AS (
  SELECT conv_id, turn, level, string_agg(body, ' ' ORDER BY place) AS text FROM runs WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY rid, conv_id, turn, level, run
  UNION ALL SELECT conv_id, turn, 0, content FROM msg JOIN own USING (rid) WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
sentences AS (
  SELECT DISTINCT conv_id, turn, level, h FROM (
    SELECT conv_id, turn, level, unnest(string_split(regexp_replace(trim(regexp_replace(lower(text), '[\x20\x09-\x0D]+', ' ', 'g')), '([.!?:]) ', '\1' || chr(1), 'g'), chr(1))) AS h FROM passages)
  WHERE length(h) > 0),
found AS (
  SELECT q.conv_id, q.turn, q.level, q.h, max(o.turn) AS source FROM sentences q LEFT JOIN sentences o ON o.level = 0 AND o.conv_id = q.conv_id AND o.h = q.h AND o.turn < q.turn
  WHERE q.level > 0 GROUP BY ALL),
votes AS (SELECT conv_id, turn, level, source, count(*) AS n FROM found GROUP BY ALL),
links AS (SELECT conv_id, turn, sum(n)::BIGINT AS n_quoted, coalesce(sum(n) FILTER (WHERE source IS NOT NULL), 0)::BIGINT AS n_linked FROM votes GROUP BY ALL),
best AS (SELECT conv_id, turn, source AS parent_turn FROM votes WHERE source IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, n DESC, source DESC) = 1),
up(conv_id, turn, thread_root, depth) AS (
  SELECT conv_id, turn, parent_turn, 1 FROM best
  UNION ALL SELECT u.conv_id, u.turn, b.parent_turn, u.depth + 1 FROM up u JOIN best b ON b.conv_id = u.conv_id AND b.turn = u.thread_root),
top AS (SELECT conv_id, turn, min(thread_root) AS thread_root, max(depth) AS depth FROM up GROUP BY ALL)
SELECT m.conv_id, m.turn, m.role, coalesce(own.content, '') AS content, b.parent_turn, coalesce(t.thread_root, m.turn) AS thread_root, coalesce(t.depth, 0) AS depth,
  coalesce(l.n_quoted, 0) AS n_quoted, coalesce(l.n_linked, 0) AS n_linked
FROM msg m LEFT JOIN own USING (rid) LEFT JOIN links l ON l.conv_id = m.conv_id AND l.turn = m.turn
LEFT JOIN best b ON b.conv_id = m.conv_id AND b.turn = m.turn LEFT JOIN top t ON t.conv_id = m.conv_id AND t.turn = m.turn
""".replace("BLANKS", _BLANKS),
    "op11_importance_resampling": rf"""
WITH tab AS (SELECT {_CRC_TABLE} AS t),
texts AS (
  SELECT true AS doc, row_number() OVER () AS rid, doc_id, text FROM documents
  UNION ALL SELECT false, row_number() OVER (), NULL, text FROM benchmark),
w AS (SELECT doc, rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS t FROM texts),
f AS (SELECT doc, rid, unnest(t || list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS s FROM w),
d AS (SELECT s, {_crc_sql("s")} % 10000 AS b FROM (SELECT DISTINCT s FROM f), tab),
hashed AS (SELECT doc, rid, b FROM f JOIN d ON f.s = d.s),
n AS (SELECT b, count(*) FILTER (WHERE doc) AS s, count(*) FILTER (WHERE NOT doc) AS t FROM hashed GROUP BY b),
total AS (SELECT coalesce(sum(s), 0) AS all_s, coalesce(sum(t), 0) AS all_t FROM n),
g AS (SELECT b, floor(1000 * ln((t + 1)::DOUBLE * (all_s + 10000)::DOUBLE / ((s + 1)::DOUBLE * (all_t + 10000)::DOUBLE)))::BIGINT AS gain FROM n, total),
weights AS (SELECT rid, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM hashed JOIN g ON hashed.b = g.b WHERE doc GROUP BY rid),
scored AS (
  SELECT w.rid, doc_id, len(t) AS n_words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '-')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM w LEFT JOIN weights ON w.rid = weights.rid WHERE doc),
able AS (
  SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features, weight, n_words) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * n // 100 THEN place END AS rank FROM scored LEFT JOIN able ON scored.rid = able.rid
""",
    "op12_merkle_manifest": f"""
WITH RECURSIVE tab AS (SELECT {_CRC_TABLE} AS t),
hashed AS (
  SELECT doc_id, lang, {_leaf_sql()} AS leaf,
    {_leaf_sql(text=f"CASE WHEN {_crc_sql('doc_id::VARCHAR')} % 3 = 0 THEN translate(text, {_LOWER}) ELSE text END")} AS now
  FROM documents, tab),
p AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
    dense_rank() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS tree
  FROM hashed),
lv(tree, level, i, h, n) AS (
  SELECT tree, 0, i, leaf, count(*) OVER (PARTITION BY tree) FROM p
  UNION ALL
  SELECT tree, level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (max(n) + 7) // 8 FROM lv WHERE n > 1 GROUP BY tree, level, i // 8),
subs AS (SELECT tree, h AS subroot, level AS high FROM lv WHERE n = 1),
top(level, i, h, n) AS (
  SELECT 0, tree, subroot, count(*) OVER () FROM subs
  UNION ALL
  SELECT level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (max(n) + 7) // 8 FROM top WHERE n > 1 GROUP BY level, i // 8),
roots AS (SELECT h AS root, level AS top_high FROM top WHERE n = 1),
asked AS (SELECT p.tree, i, subroot, high, root, unnest(range(high + top_high)) AS step FROM p JOIN subs ON p.tree = subs.tree, roots),
steps AS (
  SELECT a.tree, a.i, a.step, s.h, s.i AS j, a.i >> (3 * a.step) AS mine FROM asked a JOIN lv s ON a.step < a.high AND s.tree = a.tree AND s.level = a.step AND s.i // 8 = a.i >> (3 * a.step + 3)
  UNION ALL
  SELECT a.tree, a.i, a.step, s.h, s.i, a.tree >> (3 * (a.step - a.high)) FROM asked a JOIN top s ON a.step >= a.high AND s.level = a.step - a.high AND s.i // 8 = a.tree >> (3 * (a.step - a.high) + 3)),
around AS (
  SELECT tree, i, step, coalesce(string_agg(h, '' ORDER BY j) FILTER (WHERE j < mine), '') AS l, coalesce(string_agg(h, '' ORDER BY j) FILTER (WHERE j > mine), '') AS r
  FROM steps GROUP BY tree, i, step),
told AS (SELECT tree, i, string_agg(l || r, '' ORDER BY step) AS siblings FROM around GROUP BY tree, i),
fold(tree, i, step, h) AS (
  SELECT tree, i, 0, now FROM p
  UNION ALL
  SELECT f.tree, f.i, f.step + 1, sha256(l || f.h || r) FROM fold f JOIN around a ON a.tree = f.tree AND a.i = f.i AND a.step = f.step),
ends AS (SELECT tree, i, arg_max(h, step) AS h FROM fold GROUP BY tree, i)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(siblings, '')) AS proof_sha256, ends.h AS folded_root, ends.h = root AS verified
FROM p JOIN subs ON p.tree = subs.tree JOIN ends ON ends.tree = p.tree AND ends.i = p.i LEFT JOIN told ON told.tree = p.tree AND told.i = p.i, roots
""",
    "op9_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (
  SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS h, sha256(html) AS s,
         list_transform(range(0, 160), lambda i: (('0x' || substr(sha1(html), (i // 4 + 1)::BIGINT, 1))::INT >> (3 - i % 4)::INT) & 1) AS bits
  FROM p),
b AS (
  SELECT page_id, payload_bytes, s,
    array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      (16 * bits[5 * k + 1] + 8 * bits[5 * k + 2] + 4 * bits[5 * k + 3] + 2 * bits[5 * k + 4] + bits[5 * k + 5] + 1)::BIGINT, 1)), '') AS payload_digest
  FROM d),
o AS (SELECT *, max(page_id) OVER (PARTITION BY s) AS owner FROM b)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> owner THEN owner END AS refers_to
FROM o
""",
}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()} | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
