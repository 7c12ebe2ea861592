"""No query loses a part of its input to a cut."""

from tidewire.sources import adapters

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, path, rows, name="documents", schema=DOCS):
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def documents(spark, path, texts, lang="en"):
    return tables(spark, path, [(i, t, lang, "src1", len(t)) for i, t in enumerate(texts)])


def test_long_first_lines_are_read(spark, tmp_path):
    from tidewire.plans.criteria import Criteria, search

    long = "word " * 23 + "straddle tailword"
    sf = documents(spark, tmp_path, [long, long + "\nbody", "short\nbody", "short", "a" * 120 + "\nbody", "a" * 120])
    got = {r.id: (r.title, r.content) for r in adapters.articles(spark, sf).collect()}
    assert got == {0: (long[:120], long), 1: (long[:120], long + "\nbody"), 2: ("short", "body"), 3: ("short", ""), 4: ("a" * 120, "body"), 5: ("a" * 120, "")}
    for word in ("straddle", "tailword"):
        found = search(adapters.articles(spark, sf), adapters.sources(spark, sf), Criteria(keywords=(word,)), adapters.now())
        assert {r.id for r in found.collect()} == {0, 1}


def test_language_is_that_of_the_whole_text(spark, tmp_path):
    from tidewire.plans import q_articles

    late = "title\n" + "zzz " * 600 + "der Mann ist nicht auf dem Berg und das Kind auch nicht"
    sf = documents(spark, tmp_path, [late, "der Mann ist nicht auf dem Berg\nzzz"], lang="fr")
    assert {r.id: r.detected for r in q_articles.lang_detect(spark, sf).collect()} == {0: "de", 1: "de"}


def test_pairs_of_all_languages_by_brute_force(spark, tmp_path):
    from tidewire.plans import q_articles

    titles = ["quake kills many near harbour", "many dead: quake near harbour", "harbour fair opens", "the quake", "quake near harbour kills", ""]
    rows = [(i, t, ("en", "fr", None)[i % 3], "src1", len(t)) for i, t in enumerate(titles)]
    sf = tables(spark, tmp_path, rows)
    held = {r.id: set(r.tokens) for r in q_articles.tokens(spark, sf).collect()}
    want = {}
    for i in held:
        for j in held:
            n = len(held[i] & held[j])
            if i < j and n >= 2 and n / min(len(held[i]), len(held[j])) >= 0.5:
                want[i, j] = (n, round(n / min(len(held[i]), len(held[j])), 6))
    assert (0, 1) in want and (0, 4) in want and (1, 4) in want
    assert {(r.id, r.other): (r.shared, r.similarity) for r in q_articles.pair_similarity(spark, sf).collect()} == want


def test_all_expired_articles_go(spark, tmp_path):
    from tidewire.plans import q_ops

    sf = documents(spark, tmp_path, ["t"] * 150)
    assert q_ops.retention_keep(spark, sf).count() == 0


def test_growth_reads_the_first_and_last_sample_by_time(spark, tmp_path):
    from datetime import datetime

    from tidewire.plans import q_ops

    sf = tables(spark, tmp_path, [(3, datetime(2024, 1, 1)), (1, datetime(2024, 1, 2)), (9, datetime(2024, 1, 3)), (5, datetime(2024, 1, 5))], "events", "event_id long, ts timestamp_ntz")
    got = q_ops.growth(spark, sf).collect()
    assert [(r.bytes_day, r.articles_day) for r in got] == [(500.0, 0.5)]
