"""The corpus operators against brute force, with nulls, empties, ties, repeats and clashing columns."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm import base, bpe_count, chat, decontaminate, language_id, line_dedup, mixing, near_dedup, quality_classifier, quality_rules, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, texts, **columns):
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def odd_rows(spark):
    """Null id, null text, empty and blank texts, a repeated row, clashing columns."""
    rows = [(None, "some words that are here twice", None, None), (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t", None, "b"), (4, "a b c d e f g h", "en", "b"), (4, "a b c d e f g h", "en", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for name in ("score", "kept", "size", "id", "key", "n", "component", "words", "h"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)


def prose(rng, n, vocabulary=300):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# 1


def test_classifier_learns_and_survives(spark):
    rng = random.Random(1)
    texts = [prose(rng, 60) if i % 2 else " ".join("W%d!!" % rng.randrange(9) for _ in range(60)) for i in range(400)]
    d = docs(spark, texts)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(400)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    trees = quality_classifier.train(d, labels)
    held = quality_classifier.score(d, trees).filter(base.crc_mod(F.col("doc_id"), 5) == 0).collect()
    assert held and all((r.score >= 0.5) == bool(r.doc_id % 2) for r in held)
    assert all(0 <= r.score <= 1 for r in quality_classifier.score(odd_rows(spark), trees).collect())
    assert quality_classifier.score(empty(spark), trees).count() == 0
    none = quality_classifier.train(d, labels.limit(0))
    assert {r.score for r in quality_classifier.score(d, none).collect()} == {0.5}


def test_flat_trees_equal_a_walk():
    rng = np.random.default_rng(2)
    x = rng.random((300, quality_classifier.N_FEATURES))
    trees = quality_classifier.grow(x, (x[:, 3] + x[:, 5] > 1).astype(float), trees=6, depth=3)

    def walk(row):
        total = trees.start
        for f, c, leaf in zip(trees.feature, trees.cut, trees.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(row[f[node]] > c[node])
            total += leaf[node - len(f)]
        return total

    assert np.allclose(trees.margin(x), [walk(r) for r in x])


# 2


def brute_near(texts, width, percent):
    sets = {}
    for i, t in texts.items():
        w = WORDS.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("small", "width", "percent"), [(8, 3, 85), (2, 5, 80)])
def test_near_duplicates_by_brute_force(spark, monkeypatch, small, width, percent):
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup, "QUERIES", 3)
    monkeypatch.setattr(near_dedup, "ROWS_AT_ONCE", 5)
    rng, texts = random.Random(3), []
    for _ in range(5):
        core = prose(rng, 80).split()
        for k in range(12):
            copy = list(core)
            for _ in range(k):
                copy[rng.randrange(80)] = f"x{rng.randrange(9999)}"
            texts.append(" ".join(copy))
    texts += [texts[0], texts[0].upper(), "", None, " ", "one", "One", "two words"]
    want = brute_near(dict(enumerate(texts)), width, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs(spark, texts), width, percent).collect()}
    assert got == want


def test_near_duplicates_of_odd_rows(spark):
    got = near_dedup.near_duplicates(odd_rows(spark)).collect()
    assert len(got) == 6
    assert {(r.doc_id, r.component_id) for r in got} == {(None, None), (1, 1), (2, 2), (3, 3), (4, 4)} and all(r.kept for r in got)
    assert near_dedup.near_duplicates(empty(spark)).count() == 0


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 2**63, 400).astype(np.uint64)
    b = np.concatenate([a[:300], rng.integers(0, 2**63, 100).astype(np.uint64)])
    s = near_dedup.sketches([np.unique(a), np.unique(b), a[:1]])
    assert (s != near_dedup._EMPTY).all()
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.2


# 3


def brute_lines(rows):
    low = lambda x: x.strip(" \t\n\x0b\f\r").translate({c: c + 32 for c in range(65, 91)})
    held = collections.defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if d is not None and len(low(x)) >= 20:
                held[low(x)].add(d)
    return [(d, "\n".join(x for x in (t or "").split("\n") if d is None or not (len(held[low(x)]) >= 3 and d != max(held[low(x)])))) for d, t in rows]


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (4, 2), (5, 3)])
def test_lines_by_brute_force(spark, batches, fanout):
    rng = random.Random(5)
    lines = [f"line number {k} of a common stock" for k in range(12)] + ["short", "", "  LINE number 3 of a common stock\t"]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 9)))) for i in range(60)] + [(None, lines[0]), (7, lines[1]), (99, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("owner", F.lit(2))
    got = line_dedup.dedup_lines(df, batches=batches, fanout=fanout).collect()
    assert sorted(map(repr, [(r.doc_id, r.text) for r in got])) == sorted(map(repr, brute_lines(rows)))
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


# 4


def test_language_forward_sums_all_segmentations():
    v = language_id.Vocabulary([b"ab", b"bc", b" a", b"abc", b" abc"])
    p = np.full((v.size, 1), 0.01)
    codes, lengths = language_id._codes([b" abc", b"abab", b"x"])
    a = language_id.forward(v.lattice(codes, lengths), language_id._scaled(v, p), lengths)
    got = a[np.arange(3), lengths, 0] / language_id._SCALE**lengths

    def total(word):
        return 1.0 if not word else sum(0.01 * total(word[n:]) for n in range(1, len(word) + 1) if word[:n] in v.pieces)

    assert np.allclose(got, [total(b" abc"), total(b"abab"), total(b"x")])


def test_language_id(spark):
    import public_tokenizers

    rng = random.Random(6)
    stock = {"en": "the house and water with right thing".split(), "de": "das haus und wasser nicht richtig über".split()}
    rows = [(i, " ".join(rng.choice(stock[k]) for _ in range(20)), k) for i in range(120) for k in [("en", "de")[i % 2]]]
    d = spark.createDataFrame([*rows, (500, None, "en"), (501, "123 !!", "de"), (502, "haus" * 5000, None), (None, "das haus", "de")], "doc_id long, text string, lang string")
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(d.withColumn("score", F.lit("x")), path, *language_id.train(d, path)).collect()}
    assert all(got[i][0] == k for i, _, k in rows)
    assert got[500] == got[501] == ("und", 0.0) and got[502][0] == "de" and got[None][0] == "de"
    none = language_id.train(empty(spark), path)
    assert {r.lang_pred for r in language_id.predict(d, path, *none).collect()} == {"und"}


# 5


def brute_rules(text):
    text = text or ""
    w = WORDS.findall(text)
    c = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text), len(lines) - len(set(lines)), len(covered)


def test_rules_by_brute_force(spark):
    import xxhash

    rng = random.Random(7)
    texts = [prose(rng, rng.randrange(0, 60), 12) + rng.choice(["", "\n", "\n# $\n# $\n", "\né <x>"]) for _ in range(80)] + [None, "", " \n ", "a a a a a a a a a a a a"]
    d = docs(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(0, 80, 2)] + [(None, 1)], "doc_id long, quality int")
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    word = lambda w: signed(xxhash.xxh64_intdigest(w.encode(), 42))

    def grams(t):
        h = [word(w) for w in WORDS.findall(t or "")]
        pair = lambda a, b: signed(xxhash.xxh64_intdigest((b % 2**64).to_bytes(8, "little"), xxhash.xxh64_intdigest((a % 2**64).to_bytes(8, "little"), 42)))
        return [x % quality_rules.BUCKETS for x in [*h, *(pair(a, b) for a, b in zip(h, h[1:]))]]

    raw, good = collections.Counter(), collections.Counter()
    for i, t in enumerate(texts):
        raw.update(grams(t))
        if i < 80 and i % 6 == 0:
            good.update(grams(t))
    n, m = sum(raw.values()) + quality_rules.BUCKETS, sum(good.values()) + quality_rules.BUCKETS
    weight = lambda b: round(np.log((good[b] + 1) / m) - np.log((raw[b] + 1) / n), 6)
    for r in quality_rules.judged(d, labels).collect():
        t = texts[r.doc_id]
        want = brute_rules(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        score = sum(map(weight, grams(t))) / max(1, len(grams(t)))
        assert abs(r.llr - score) < 1e-5
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert r.base_failed == failed and r.kept == (not failed and r.llr >= quality_rules.THRESHOLD)
    assert quality_rules.judged(odd_rows(spark), labels.limit(0)).count() == 6
    assert quality_rules.judged(empty(spark), labels).count() == 0


# 6


def test_mix_meets_targets(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["a"] * 8 + ["b", None]), prose(rng, rng.randrange(0, 40))) for i in range(600)] + [(None, "c", "one two"), (3, "d", None), (3, "d", None)]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", F.lit("x")).withColumn("order", F.lit(1))
    got = mixing.taken(d).collect()
    assert len(got) == len(rows)
    size, target, words = collections.Counter(), {}, collections.Counter()
    for r in got:
        size[r.source] += r.size
        target[r.source] = r.target
        words[r.source] += r.size * r.times
        assert r.times <= 3
    assert abs(sum(target.values()) - sum(size.values())) < 1e-6
    assert all(target[s] <= 3 * size[s] + 1e-9 and abs(words[s] - target[s]) <= 40 for s in size)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.taken(d.repartition(7)).collect()))
    copies = mixing.mix(d.drop("order"), (5, 2, 1)).count()
    assert copies == sum(r.times for r in got)
    assert mixing.taken(empty(spark)).count() == 0


@pytest.mark.parametrize("size", [100_000_000, 350_000_000, 3_000_000_000])
def test_targets_of_very_many_words(spark, size):
    sizes = {"a": 4 * size, "b": size, "c": size, "d": 2}
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    target = {r.source: r.target for r in mixing.targets(rows, base.Scratch(spark, "targets"), (5, 2, 1), 3).collect()}
    # d, of weight 5, has its cap; the others share the rest by 5, 2 and 1.
    rest = sum(sizes.values()) - 6
    assert target == {"a": 5 * rest / 8, "b": 2 * rest / 8, "c": rest / 8, "d": 6.0}


# 7


def test_templates_are_found_and_torn_slots_count_letter_for_letter(spark):
    item = "A train leaves the old station of the city at 9 in the morning, Anna Miller rides 120 km with it and 120 again"
    bench = spark.createDataFrame([(1, item), (2, "too short item"), (3, None), (None, "x"), (1, item)], "item_id long, text string")
    other = item.replace("120", "75").replace("9", "10").replace("Anna Miller", "Peter Smith")
    torn = item.replace("120 again", "80 again")
    texts = ["before it. " + item + " after", "x " + other, torn, "nothing of the kind is in here at all today", None, "", "it is a TOO short, item!", item.upper(), "first line\n\tTOO short, item!\nlast", "Too short item", torn.replace("9", "10").replace("Anna", "Peter").replace("train", "plane")]
    got = {(r.doc_id, r.item_id): r.same_values for r in decontaminate.contaminated(docs(spark, texts), bench).collect()}
    assert got[0, 1] is True and got[1, 1] is False
    # Most windows of the torn copy match word for word; one that has other values all over has few of these.
    assert got[2, 1] is False and (3, 1) not in got and (10, 1) not in got
    # A short item is looked for as a line or text of its own.
    assert (6, 2) not in got and got[8, 2] is True and got[9, 2] is True
    left = {r.doc_id for r in decontaminate.clean(docs(spark, texts), bench).collect()}
    assert left == {3, 4, 5, 6, 10} | ({7} - {k[0] for k in got})
    assert decontaminate.contaminated(odd_rows(spark), bench).count() == 0
    assert decontaminate.contaminated(empty(spark), bench.limit(0)).count() == 0


def test_one_word_items_flag_no_running_text(spark):
    item = "The plant made 120 km of cable in March and it was said there that 120 again would be made by the same people in the year to come"
    bench = spark.createDataFrame([(1, item), (2, "Yes"), (3, "42"), (4, "no, thanks"), (5, "...")], "item_id long, text string")
    texts = [item.replace("120 again", "80 again"), "we said yes and 42 to it", "question?\nYes.\nreason", "No thanks", "42", None, "...", "a line\n42 km"]
    got = {(r.doc_id, r.item_id): (r.n_matched, r.n_windows) for r in decontaminate.contaminated(docs(spark, texts), bench).collect()}
    assert got.pop((0, 1))[0] > 12 and got == {(2, 2): (1, 1), (3, 4): (1, 1), (4, 3): (1, 1)}


# 8


def test_quotes_are_linked(spark):
    rows = [
        (1, 0, "user", "Hello there my friend. How are you doing today?\nThis is a second line of it."),
        (1, 1, "assistant", "On Monday user wrote:\n> Hello there my friend. How are you\n> doing today?\nI am fine."),
        (1, 2, "user", "Unrelated message in between."),
        (1, 3, "user", "> > Hello there my friend. How are you doing today?\n> I am fine.\nGood to know."),
        (1, 4, "user", None), (None, 1, "user", "> Hello there my friend."), (2, None, "user", "x > y"),
        (1, 600, "user", "> Good to know.\n> never said by anyone\nlate reply"), (1, 2, "user", "Unrelated message in between."),
    ]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("h", F.lit(1)).withColumn("block", F.lit(2))
    got = {(r.conv_id, r.turn): (r.content, r.parent_turn, r.thread_root, r.depth, r.n_quoted, r.n_linked) for r in chat.replies(d).collect()}
    assert got[1, 1] == ("I am fine.", 0, 0, 1, 2, 2)
    assert got[1, 3] == ("Good to know.", 1, 0, 2, 3, 3)
    assert got[1, 600] == ("late reply", 3, 0, 3, 2, 1)
    assert got[1, 2][1:4] == (None, 2, 0) and got[1, 4][0] == "" and got[None, 1][1] is None and got[2, None][0] == "x > y"
    assert chat.replies(d).count() == len(rows)
    parts = {(r.conv_id, r.part.turn): [m.content for m in r.messages] for r in chat.conversations(d).collect()}
    assert parts[1, 0][:3] == [rows[0][3], "I am fine.", "Good to know."] and parts[1, 2] == ["late reply"]
    assert chat.replies(d.limit(0)).count() == 0


# 9


def test_archive_gives_back_every_byte(spark, tmp_path):
    import base64

    pages = [(1, "u1", "same é"), (2, "u\r\n2", "same é"), (3, None, None), (4, "u4", ""), (None, "u5", "same é"), (5, "u6", "other"), (5, "u6", "other")]
    d = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("owner", F.lit("x"))
    root = str(tmp_path / "archive")
    warc.write(d, root)
    got = collections.Counter(map(tuple, warc.read_back(spark, root).drop("url").collect()))
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    row = lambda p, t, kind, to: (p, len((t or "").encode()), digest(t), kind, to)
    assert got == collections.Counter([row(1, "same é", "revisit", 2), row(2, "same é", "response", None), row(None, "same é", "revisit", 2), row(3, None, "revisit", 4), row(4, "", "response", None), row(5, "other", "response", None), row(5, "other", "response", None)])
    records = [bytes(r.record) for r in warc.records(spark, root).collect()]
    assert sum(b"\r\n\r\nsame \xc3\xa9\r\n\r\n" in r for r in records) == 1 and all(r.startswith(b"WARC/1.1\r\n") and r.endswith(b"\r\n\r\n") for r in records)
    assert warc.payloads(spark, root).count() == 3
    large = str(tmp_path / "large")
    warc.write(d, large, least=100)
    assert {r.record_type for r in warc.read_back(spark, large).collect()} == {"response"}
    bad = str(tmp_path / "bad")
    spark.read.parquet(f"{root}/payloads").withColumn("payload", F.encode(F.lit("forged"), "UTF-8")).write.parquet(f"{bad}/payloads")
    with pytest.raises(Exception, match="doesn't match its digest"):
        warc.payloads(spark, bad).collect()
    warc.write(d.limit(0), str(tmp_path / "none"))
    assert warc.read_back(spark, str(tmp_path / "none")).count() == 0


# 10


def test_token_counts_equal_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), bpe_count.Counter(path)
    rng = random.Random(9)
    pieces = [*"abc'stréÉİΣσςßǅ١²½Ⅷ一\x1c\x85\xa0  \n\t<|>🙂#", "<|endoftext|>", "<|start", "don't", "I'LL", "unbelievable"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(30))) for _ in range(2000)] + ["a" * 3000, "", None]
    want = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert [own.count(t) for t in texts] == want
    got = {r.doc_id: r.n_tokens for r in bpe_count.count_tokens(docs(spark, texts).withColumn("n_tokens", F.lit("x")), path).collect()}
    assert got == dict(enumerate(want))
    assert bpe_count.count_tokens(empty(spark), path).count() == 0


# The pipeline


def test_stages_keep_columns_and_clean_documents(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    d = base.table(spark, sf, "documents")
    columns = d.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = d
        d = base.Scratch(spark, "test").keep(stage(spark, before, sf), name)
        assert d.columns == columns, name
        assert 0.5 * before.count() <= d.count() <= before.count(), name
    assert corpus_pipeline.STAGES[-1][1](spark, d, sf).count() == d.count()


def test_quotes_equal_their_sql(spark):
    import duckdb

    from tidewire.llm import queries

    rng = random.Random(10)
    stock = [f"Sentence number {k} of the stock{e}" for k in range(6) for e in ".!"]
    rows = []
    for conv in range(4):
        for turn in range(25):
            lines = [rng.choice(["", "> ", ">> ", "> > ", " >"]) + rng.choice(stock) for _ in range(rng.randrange(5))]
            rows.append((conv, turn, "user", "\n".join([*rng.choice([[], ["On Monday she wrote:"]]), *lines])))
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    con = duckdb.connect()
    con.register("conversations", d.toPandas())
    found = con.execute(queries.oracle_sql()["op8_chat_formatting"])
    names = [c[0] for c in found.description]
    got = [tuple(r[n] for n in names) for r in chat.replies(d).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, found.fetchall()))
    assert sum(r[names.index("parent_turn")] is not None for r in got) > 20
