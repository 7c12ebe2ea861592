"""Each stage of the pipeline against brute force, on odd rows: nulls, blanks, ties, repeats, long texts, clashing names, no rows."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_contracts import ITEM, LINE, SCHEMAS, WORD, fixture_rows
from tidewire.llm import mixing

STAGE = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("pipeline")
    for name, rows in fixture_rows().items():
        spark.createDataFrame(rows, SCHEMAS[name]).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def odd(spark):
    """The fixture's documents, a null id, a repeated row and columns named like results."""
    rows = fixture_rows()["documents"]
    rows = [*rows, (None, "words without an id " * 9, "en", "a", 1), (None, None, None, None, None), rows[3], rows[3]]
    d = spark.createDataFrame(rows, SCHEMAS["documents"])
    for name in ("n_lines", "n_dropped", "score", "kept", "key", "id", "size", "component", "times", "copy", "cell", "order", "item_id", "target"):
        d = d.withColumn(name, F.lit("clash"))
    return d


def texts(rows):
    return collections.Counter((r.doc_id, r.text) for r in rows)


def test_every_stage_keeps_columns_and_survives_no_rows(spark, sf):
    d = odd(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, sf)
        assert out.columns == d.columns and {r[c] for r in out.collect() for c in d.columns[5:]} == {"clash"}, name
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, d.limit(0), sf).count() == 0, name


def test_quality_rejects_junk(spark, sf):
    d = odd(spark)
    left = texts(STAGE["quality"](spark, d, sf).collect())
    for (doc, text), n in texts(d.collect()).items():
        if text is not None and (text.startswith("w") or "#$" in text):
            assert left[doc, text] == (0 if "#$" in text else n)


def test_lines_by_brute_force(spark, sf):
    d = odd(spark)
    low = lambda x: x.strip(" \t\n\x0b\f\r").translate({c: c + 32 for c in range(65, 91)})
    held = collections.defaultdict(set)
    for r in d.collect():
        for x in (r.text or "").split("\n"):
            if r.doc_id is not None and len(low(x)) >= 20:
                held[low(x)].add(r.doc_id)
    want = collections.Counter()
    for r in d.collect():
        kept = [x for x in (r.text or "").split("\n") if r.doc_id is None or len(held[low(x)]) < 3 or r.doc_id == max(held[low(x)])]
        want[r.doc_id, "\n".join(kept)] += 1
    out = STAGE["lines"](spark, d, sf).collect()
    assert texts(out) == want and all(r.n_chars == len(r.text) for r in out)
    assert sum(LINE.upper() in (t or "") for _, t in want) == 1


def test_one_near_duplicate_of_each_group_stays(spark, sf):
    d = odd(spark)
    sets = {}
    for r in d.collect():
        w = WORD.findall((r.text or "").translate({c: c + 32 for c in range(65, 91)}))
        if r.doc_id is not None:
            sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    top = {i: i for i in sets}

    def find(i):
        return i if top[i] == i else find(top[i])

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    want = collections.Counter({k: n for k, n in texts(d.collect()).items() if k[0] is None or find(k[0]) == k[0]})
    assert texts(STAGE["near_duplicates"](spark, d, sf).collect()) == want and len(want) < len(sets)


def test_benchmark_documents_go(spark, sf):
    d = odd(spark)
    want = collections.Counter({k: n for k, n in texts(d.collect()).items() if ITEM not in (k[1] or "").lower() or k[0] is None})
    assert texts(STAGE["benchmark"](spark, d, sf).collect()) == want


def test_mix_meets_targets(spark, sf):
    d = odd(spark)
    out = STAGE["mix"](spark, d, sf).collect()
    assert len(out) == d.count()
    size, words, target = collections.Counter(), collections.Counter(), {}
    for r in out:
        size[r.source] += r.size
        words[r.source] += r.size * r.times
        target[r.source] = r.target
        assert r.times <= 3
    most = max(r.size for r in out)
    assert abs(sum(target.values()) - sum(size.values())) < 1e-6
    assert all(target[s] <= 3 * size[s] + 1e-9 and abs(words[s] - target[s]) <= most for s in size)


def test_mix_of_very_many_words(spark, sf, monkeypatch):
    """As many words as some GB of documents have: n_chars says how many."""
    monkeypatch.setattr(mixing, "sized", lambda docs: docs.select("doc_id", "source", F.col("n_chars").alias("size")))
    rows = [(i, "", "en", "abc"[i % 3], 2_000_000) for i in range(600)]
    out = STAGE["mix"](spark, spark.createDataFrame(rows, SCHEMAS["documents"]), sf).collect()
    assert {(r.source, r.target) for r in out} == {("a", 750e6), ("b", 300e6), ("c", 150e6)}
    words = collections.Counter()
    for r in out:
        words[r.source] += r.size * r.times
    assert all(abs(words[r.source] - r.target) <= r.size for r in out)


def test_run_is_the_stages_in_a_row(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    d = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, sf)
        d = spark.createDataFrame(out.collect(), out.schema)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, d.select(got.columns).collect()))
    assert got.count()
