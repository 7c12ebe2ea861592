"""The registered corpus queries over a fixture of odd rows: against their SQL, brute force, and the rules of their contracts."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm import base, chat, decontaminate, language_id, line_dedup, mixing, near_dedup, queries, quality_classifier, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "benchmark": "item_id long, text string",
    "pages": "page_id long, url string, html string",
    "conversations": "conv_id long, turn long, role string, text string",
}
ITEM = "which of the seven rivers of the northern plain carries the most water to the sea in spring"
LINE = "this very line is found in many of the documents here"


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def fixture_rows():
    """Copies, shared lines, junk, benchmark passages, quotes and odd rows: null and blank texts, ties, repeats, one very long text."""
    rng, texts = random.Random(20), []
    for i in range(60):
        core = prose(rng, 120)
        texts.append(core + (f"\n  {LINE.upper()}\t" if i % 4 == 0 else "") + (f"\n{ITEM}" if i % 17 == 0 else ""))
        if i % 6 == 0:
            texts += [core, core.upper(), core + " one more word"]
    texts += ["#$ %% && " * 30 + "<x> " * 20] * 4 + [None, "", " \n\t ", "½ ² ①", "one", "two words", ITEM.title(), "über " * 20_000]
    docs = [(100 + i, t, (None, "en", "de", "fr")[i % 4], (None, "a", "b", "a", "a")[i % 5], len(t or "")) for i, t in enumerate(texts)]
    labels = [(d[0], int(not (d[1] or "").startswith("#")), 0) for d in docs if d[0] % 3]
    pages = [(i, (None, "u", f"http://x/{i}")[i % 3], (None, "", "same é", f"page {i}")[i % 4]) for i in range(40)]
    chats = [(c, t, "user", rng.choice(["", f"> Answer {t - 1} of {c}.\n", ">> Answer 0 of 1.\n> Answer 2 of 2.\n"]) + f"Answer {t} of {c}.") for c in range(3) for t in range(12)]
    return {"documents": docs, "labels": labels, "benchmark": [(1, ITEM), (2, None), (3, "words that nobody has ever written down in such an order"), (4, "Two words"), (5, "Yes")], "pages": pages, "conversations": [*chats, (0, 12, "user", None)]}


@pytest.fixture(scope="module")
def rows():
    return fixture_rows()


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory, rows):
    path = tmp_path_factory.mktemp("tables")
    for name, schema in SCHEMAS.items():
        spark.createDataFrame(rows[name], schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.fixture(scope="module")
def got(spark, sf):
    """The rows of each registered query, run once."""
    kept = {}

    def run(name):
        if name not in kept:
            full = next(q for q in queries.queries() if q.startswith(name))
            kept[name] = queries.queries()[full](spark, sf)
            kept[name] = (kept[name].columns, kept[name].collect())
        return kept[name]

    return run


def normal(value):
    if isinstance(value, float):
        return round(value, 9)
    return list(map(normal, value)) if isinstance(value, (list, tuple)) else value


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(rows, sf, got, name):
    con = duckdb.connect()
    for table in SCHEMAS:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet/*.parquet'")
    found = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in found.description]
    columns, have = got(name)
    assert sorted(columns) == sorted(names) and have
    place = [columns.index(n) for n in names]
    assert sorted(repr(tuple(normal(r[i]) for i in place)) for r in have) == sorted(repr(tuple(map(normal, r))) for r in found.fetchall())


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


# 1


def test_quality_query(rows, got):
    columns, have = got("op1_")
    assert columns[:4] == ["doc_id", "held_out", "score", "predicted"] and len(have) == len(rows["documents"])
    text = {d[0]: d[1] or "" for d in rows["documents"]}
    for r in have:
        assert r.held_out == (fold(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        if text[r.doc_id].startswith(("#", "w")):
            assert r.predicted == int(text[r.doc_id].startswith("w"))


def test_held_out_labels_teach_nothing(spark, rows):
    d = spark.createDataFrame(rows["documents"], SCHEMAS["documents"])
    labels = spark.createDataFrame([(i, q if fold(i, 5) else 1 - q, t) for i, q, t in rows["labels"]], SCHEMAS["labels"])
    true = spark.createDataFrame(rows["labels"], SCHEMAS["labels"])
    scores = [{r.doc_id: r.score for r in quality_classifier.score(d, quality_classifier.train(d, x)).collect()} for x in (labels, true)]
    assert scores[0] == scores[1]


def slow_statistics(text):
    data = text.encode()
    words, lines = data.split(), data.split(b"\n")
    share = lambda test: sum(map(test, (bytes([b]) for b in data))) / len(data)
    blank, marks = (lambda c: c in b" \t\n\x0b\f\r"), b"#*$%&|<>!?"
    return {
        1: share(bytes.islower), 2: share(bytes.isupper), 3: share(bytes.isdigit), 4: share(blank), 5: share(lambda c: c in b"#*$%&|<>"), 6: share(lambda c: c in b"!?"), 8: share(lambda c: c[0] > 127),
        9: math.log1p(len(data)), 10: math.log1p(len(words)), 11: sum(map(len, words)) / len(words), 12: len(set(words)) / len(words), 13: len(set(zip(words, words[1:]))) / max(1, len(words) - 1),
        14: sum(w[-1:] in [bytes([m]) for m in marks] for w in words) / len(words), 15: max(map(len, words)), 16: len(set(lines)) / len(lines), 17: len(data) / len(lines), 18: data.count(b".") / len(words), 19: len(zlib.compress(data, 1)) / len(data),
    }


def test_statistics_by_brute_force():
    for text in ("One two! Three? #4 $ five. Six six\nsix\n\nsix é<b>", "x", "a\tb\x0bc ends!", LINE * 300):
        got = quality_classifier.statistics(text)
        assert len(got) == quality_classifier.N_FEATURES and all(abs(got[k] - v) < 1e-9 for k, v in slow_statistics(text).items())
    assert not quality_classifier.statistics(None).any() and not quality_classifier.statistics("").any()


def slow_grow(x, y, depth):
    """One tree by trying every cut between values: the gains of the first round of boosting."""
    start = math.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6))
    p = 1 / (1 + np.exp(-start))
    g, h = y - p, np.full(len(y), p * (1 - p))
    best = (0.0, None, None)
    for f in range(x.shape[1]):
        for cut in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= cut
            gain = g[left].sum() ** 2 / (h[left].sum() + 1) + g[~left].sum() ** 2 / (h[~left].sum() + 1) - g.sum() ** 2 / (h.sum() + 1)
            if gain > best[0] + 1e-12:
                best = (gain, f, cut)
    return best


def test_first_cut_is_the_best_one():
    rng = np.random.default_rng(21)
    x = rng.integers(0, 6, (200, quality_classifier.N_FEATURES)).astype(float)
    y = (x[:, 7] > 2).astype(float)
    tree = quality_classifier.grow(x, y, trees=1, depth=1)
    _, feature, cut = slow_grow(x, y, 1)
    assert tree.feature[0][0] == feature == 7
    assert (x[:, 7] > tree.cut[0][0]).tolist() == (x[:, 7] > cut).tolist()


# 2


def test_planted_near_copies_are_found(spark):
    """Pairs of a similarity just over the threshold: all of them are linked."""
    rng, texts = random.Random(22), []
    for _ in range(60):
        words = [f"v{rng.randrange(10**9)}" for _ in range(300)]
        changed = list(words)
        for at in rng.sample(range(10, 290, 4), 7):
            changed[at] = "x"
        texts += [" ".join(words), " ".join(changed)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(w[k : k + 3]) for k in range(len(w) - 2)} for w in map(str.split, texts)]
    alike = [len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2])]
    assert 0.85 <= min(alike) < 0.9
    found = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(d, 3, 85).collect()}
    assert all(found[i + 1] == found[i] == i for i in range(0, len(texts), 2))


def test_a_large_group_of_copies_costs_no_pairs(spark):
    """A third of the rows in one group, and long texts."""
    rng = random.Random(23)
    core = prose(rng, 60)
    texts = [core] * 300 + [f"{core} {i}" for i in range(60)] + [prose(rng, 50, 10**6) for _ in range(200)] + [prose(rng, 60_000, 10**6)] * 2
    found = near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 3, 85)
    sizes = collections.Counter(r.component_id for r in found.collect())
    assert sizes[0] == 360 and sizes[560] == 2 and len(sizes) == 202


# 3


def test_counts_can_be_left_out_and_a_long_text_is_cut(spark):
    long = "\n".join([LINE, *(f"own line {i} of a long document" for i in range(30_000))])
    d = spark.createDataFrame([(1, LINE, 7, 8), (2, LINE, 7, 8), (3, long, 7, 8)], "doc_id long, text string, n_lines int, n_dropped int")
    plain = {r.doc_id: r for r in line_dedup.dedup_lines(d, counts=False).collect()}
    assert plain[1].n_lines == 7 and plain[1].n_dropped == 8 and plain[1].text == "" and plain[3].text == long
    counted = {r.doc_id: (r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(d).collect()}
    assert counted == {1: (1, 1), 2: (1, 1), 3: (30_001, 0)}


def test_a_merge_sorts_no_run_again(spark):
    """The plan of the last merge: the new batch is dealt out and sorted, the runs are neither."""
    docs = spark.createDataFrame([(i, f"line number {i % 50} is here and long enough") for i in range(400)], "doc_id long, text string")
    runs = line_dedup.LineRuns(spark, base.Scratch(spark, "plan"))
    keys = line_dedup.line_keys(docs, 20)
    runs.add(keys.filter("doc_id >= 200"))
    run = runs.runs()[0]
    batch = keys.filter("doc_id < 200").groupBy("key").agg(F.max("doc_id").alias("owner"))
    joined = batch.join(run.select("key", F.lit(True).alias("known")).hint("merge"), "key", "left")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    right = plan[plan.index("SortMergeJoin") :].split("\n")
    depth = [len(re.match(r"[^A-Za-z]*", x)[0]) for x in right]
    scan = next(i for i, x in enumerate(right) if "FileScan parquet" in x and "tw_" in x)
    above = right[max(i for i in range(1, scan) if depth[i] == min(depth[1:scan + 1])) : scan + 1]
    assert not any(word in x for x in above for word in ("Sort ", "Exchange"))
    assert joined.filter("known").count() == 50 == joined.count()


# 4


def test_words_of_any_length_are_summed_whole():
    rng = random.Random(24)
    names = [b"ab", b"bc", b"abc", b"c" * 25, b"bca" * 9, b" a", "жзжзжз".encode()]
    v = language_id.Vocabulary(names)
    assert v.longest == 27
    p = np.array([[rng.uniform(0.001, 0.05) for _ in range(3)] for _ in range(v.size)])
    model = language_id.Model(v, ["x", "y", "z"], p, np.ones(3) / 3)
    at = {name: i for i, name in enumerate(v.pieces)}
    words = ["".join(rng.choice("abc") for _ in range(n)) for n in (1, 20, 47, 48, 49, 96, 500)] + ["c" * 400, "жз" * 120, "bca" * 100]

    def slow(word):
        data = b" " + word.encode()
        logs = [np.zeros(3)]
        for end in range(1, len(data) + 1):
            parts = [logs[end - n] + np.log(p[at[data[end - n : end]]]) for n in range(1, min(end, v.longest) + 1) if data[end - n : end] in at]
            logs.append(np.logaddexp.reduce(parts))
        return logs[-1]

    assert np.allclose(model.word_logs(words), [slow(w) for w in words])


def test_words_of_any_length_teach(monkeypatch):
    """Learning over segments of a few places equals that over whole words, and a language without blanks is learned from one word."""
    rng = random.Random(27)
    v = language_id.Vocabulary([b"ab", b"bc", b"abc", b"bca" * 5, "жз".encode(), "жзж".encode()])
    counts = {"x": {"".join(rng.choice("abc") for _ in range(n)): 1 + n % 3 for n in (1, 5, 30, 700, 1500)}, "y": {"жз" * 2000 + "abc": 2}, "z": {}}
    whole = language_id.learn(v, counts)
    monkeypatch.setattr(language_id, "SEGMENT", 7)
    assert np.allclose(language_id.learn(v, counts), whole)
    assert whole[v.pieces.index("жзж".encode()), 1] + whole[v.pieces.index("жз".encode()), 1] > 0.9 and np.allclose(whole.sum(axis=0), 1)


def test_only_letters_make_words(got, rows):
    assert language_id.letters("Ab½cd ² ①Ⅷ x1y É") == collections.Counter({"ab": 1, "cd": 1, "x": 1, "y": 1, "é": 1})
    text = {d[0]: d[1] or "" for d in rows["documents"]}
    columns, have = got("op4_")
    assert columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    for r in have:
        assert r.held_out == (fold(r.doc_id, 3) == 1) and (r.lang_pred == "und") == (not any(c.isalpha() for c in text[r.doc_id])) and 0 <= r.score <= 1


def test_rare_languages_are_learned(spark):
    import public_tokenizers

    path, rng = public_tokenizers.path("piece_bpe_32k.model"), random.Random(25)
    stock = {"en": "the house and water with right thing", "xx": "qopa zuvi weko tyla"}
    texts = [(i, " ".join(rng.choices(stock[k].split(), k=9)), k) for i in range(3000) for k in ["xx" if i % 300 < 3 else "en"]]
    d = spark.createDataFrame([*texts, *((10_000 + i, "one", f"l{i:03}") for i in range(600))], "doc_id long, text string, lang string")
    languages, p, prior = language_id.train(d, path, max_docs=100)
    assert len(languages) > 380 and "xx" in languages and p.shape[1] == len(prior) == len(languages)
    few = d.filter("lang IN ('en', 'xx')")
    model = language_id.train(few, path, max_docs=60)
    assert {r.lang_pred for r in language_id.predict(few.filter("lang = 'xx'"), path, *model).collect()} == {"xx"}


# 5


def test_rules_query(rows, got):
    columns, have = got("op5_")
    assert columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    text = {d[0]: d[1] or "" for d in rows["documents"]}
    for r in have:
        words = WORD.findall(text[r.doc_id])
        grams = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        repeated = {i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)}
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(words), sum(map(len, words)), len(repeated))
        assert r.base_failed == (len(words) < 10 or 100 * len(repeated) > 20 * len(words)) and not (r.base_failed and r.kept)


# 6


def test_empty_documents_stay_within_the_epochs(spark):
    rows = [(1078, "small", ""), (1046, "small", "two words"), *((i, "small", None) for i in range(300)), *((5000 + i, "large", "many words are in here " * 9) for i in range(40))]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string")
    times = collections.defaultdict(set)
    for r in mixing.taken(d, (5, 1), 3).collect():
        times[r.source].add(r.times)
    assert max(times["small"] | times["large"]) <= 3
    assert mixing.mix(d, (5, 1), 3).groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3


def test_many_sources_keep_their_order(spark):
    rows = [(i, s, "a b c") for i, s in enumerate([None, "", "é", "z", "Z", "\U0001f642", "\uffee", *(f"s{k}" for k in range(300))])]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string")
    target = {r.source: r.target for r in mixing.taken(d.repartition(9), (5, 2, 1), 3).collect()}
    order = sorted((s for s in target if s is not None), key=lambda s: s.encode()) + [None]
    shares = [(5, 2, 1)[i % 3] for i in range(len(order))]
    rest, capped = 3 * len(order), set()
    while True:
        whole = sum(w for i, w in enumerate(shares) if i not in capped)
        over = {i for i, w in enumerate(shares) if i not in capped and w * (rest - 9 * len(capped)) / whole > 9}
        if not over:
            break
        capped |= over
    for i, s in enumerate(order):
        assert abs(target[s] - (9 if i in capped else shares[i] * (rest - 9 * len(capped)) / whole)) < 1e-9


# 7


def test_contaminated_documents_are_found(rows, got):
    _, have = got("op7_")
    text = {d[0]: (d[1] or "").lower() for d in rows["documents"]}
    assert {r.doc_id for r in have if r.item_id == 1} == {i for i, t in text.items() if ITEM in t}
    assert {(r.doc_id, r.item_id) for r in have if r.item_id != 1} == {(i, 4) for i, t in text.items() if t == "two words"}


def test_a_long_text_and_ties_of_items(spark):
    long = " ".join(["filler"] * 100_000) + " " + ITEM
    d = spark.createDataFrame([(1, long), (1, long), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, ITEM), (2, ITEM), (1, ITEM)], SCHEMAS["benchmark"])
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(d, bench).collect()) == [(1, 1), (1, 2)]


# 8


def quoted(rng, conversations=6, turns=40):
    """Nested levels, rewrapped quotes, attributions, ties, repeated rows, a hot sentence and one very long message."""
    hot = "Everybody says this one sentence."
    rows = []
    for conv in range(conversations):
        said = []
        for turn in range(turns):
            lines = []
            for _ in range(rng.randrange(3)):
                source = rng.choice(said) if said and rng.random() < 0.8 else "Never said by anyone, ever."
                words, level = source.split(), rng.choice(["> ", ">> ", "> > ", ">", " > "])
                if rng.random() < 0.3:
                    lines.append("On Monday she wrote:")
                cut = rng.randrange(1, len(words) + 1)
                lines += [level + " ".join(words[:cut]), *([level + " ".join(words[cut:])] if words[cut:] else [])]
                lines.append(rng.choice(["", "Reply between."]))
            own = [f"Message {turn} of {conv} says something.", *([hot] if rng.random() < 0.5 else []), *(["OK."] if rng.random() < 0.3 else [])]
            said += own
            rows.append((conv, turn, "user", "\n".join([*lines, *own])))
        rows.append(rows[-1])
    return rows


def test_quoted_conversations_equal_their_sql(spark, tmp_path):
    rows = quoted(random.Random(26))
    d = spark.createDataFrame(rows, SCHEMAS["conversations"])
    con = duckdb.connect()
    con.register("conversations", d.toPandas())
    found = con.execute(queries.oracle_sql()["op8_chat_formatting"])
    names = [c[0] for c in found.description]
    have = chat.replies(d).collect()
    assert sum(r.parent_turn is not None for r in have) > 80 and max(r.depth for r in have) > 3
    assert sorted(repr(tuple(r[n] for n in names)) for r in have) == sorted(map(repr, found.fetchall()))
    parts = [m for r in chat.conversations(d).collect() for m in r.messages]
    assert len(parts) == len(rows)


def test_a_turn_of_very_many_lines_is_linear(spark):
    lines = [f"{'> ' * (1 + i % 2)}Line number {i} of all." if i % 3 else f"Own line {i}." for i in range(50_000)]
    rows = [(1, 0, "user", "Line number 1 of all."), (1, 1, "user", "\n".join(lines))]
    have = {r.turn: r for r in chat.replies(spark.createDataFrame(rows, SCHEMAS["conversations"])).collect()}
    assert have[1].parent_turn == 0 and have[1].n_quoted == sum(i % 3 > 0 for i in range(50_000)) and have[1].n_linked == 1


# 9


def parsed(record):
    """A strict reading of one WARC record: (fields, HTTP head, payload)."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    assert version == "WARC/1.1"
    pairs = [re.fullmatch(r"([A-Za-z-]+): (.*)", x).groups() for x in lines]
    fields = dict(pairs)
    assert len(fields) == len(pairs)
    size = int(fields["Content-Length"])
    assert rest[size:] == b"\r\n\r\n"
    http, end, payload = rest[:size].partition(b"\r\n\r\n")
    assert http.startswith(b"HTTP/1.1 200 OK\r\n") and end
    assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", fields["WARC-Date"]) and re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", fields["WARC-Record-ID"])
    assert fields["WARC-Target-URI"] and fields["Content-Type"] == "application/http;msgtype=response"
    return fields, http, payload


def test_records_are_whole(spark, tmp_path):
    pages = [(1, "http://a", "same é"), (2, "u\r\nX-Page-ID: 7", "same é"), (3, None, None), (4, "u4", ""), (5, "u6", "a\r\n\r\nb"), (5, "u6", "a\r\n\r\nb"), (6, "long", "x" * 3_000_000), (None, "u", "z")]
    root = str(tmp_path / "archive")
    warc.write(spark.createDataFrame(pages, SCHEMAS["pages"]).withColumn("sha256", F.lit(1)), root, date="2024-01-02T03:04:05Z")
    records = [parsed(bytes(r.record)) for r in warc.records(spark, root).collect()]
    assert len({f["WARC-Record-ID"] for f, _, _ in records}) == len(pages)
    by_id = {f["WARC-Record-ID"]: f for f, _, _ in records}
    left = collections.Counter((p, (t or "").encode()) for p, _, t in pages)
    for fields, _, payload in records:
        page = int(fields["X-Page-ID"]) if fields["X-Page-ID"] else None
        if fields["WARC-Type"] == "revisit":
            assert payload == b"" and by_id[fields["WARC-Refers-To"]]["WARC-Type"] == "response"
            assert by_id[fields["WARC-Refers-To"]]["WARC-Payload-Digest"] == fields["WARC-Payload-Digest"]
            continue
        assert fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
        left[page, payload] -= 1
    assert sorted(k[0] for k, n in left.items() if n) == [1, 3]
    back = {(r.page_id, r.record_type) for r in warc.read_back(spark, root).collect()}
    assert back == {(1, "revisit"), (2, "response"), (3, "revisit"), (4, "response"), (5, "response"), (6, "response"), (None, "response")}


def test_a_changed_record_is_refused(spark, tmp_path):
    root, bad = str(tmp_path / "one"), str(tmp_path / "bad")
    warc.write(spark.createDataFrame([(1, "u", "page")], SCHEMAS["pages"]), root)
    spark.read.parquet(f"{root}/payloads").write.parquet(f"{bad}/payloads")
    text = F.decode("header", "UTF-8")
    spark.read.parquet(f"{root}/headers").withColumn("header", F.encode(F.regexp_replace(text, "sha1:\\w{4}", "sha1:AAAA"), "UTF-8")).write.parquet(f"{bad}/headers")
    with pytest.raises(Exception, match="another digest"):
        warc.read_back(spark, bad).collect()


# 10


def test_token_query(rows, got):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    text = {d[0]: d[1] or "" for d in rows["documents"]}
    columns, have = got("op10_")
    assert columns[:4] == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    for r in have:
        n = len(library.encode(text[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text[r.doc_id].encode()), n, n > 2048)


# Scratch


def test_a_cluster_without_a_shared_folder_is_refused():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        base.Scratch(Session(), "x")


def test_released_tables_are_gone(spark):
    with base.released():
        work = base.Scratch(spark, "gone")
        work.keep(spark.range(3), "a")
        work.bucketed(spark.range(3), "b", 2, "id")
    assert not spark._jvm.java.io.File(work.root).exists() and not work.tables
