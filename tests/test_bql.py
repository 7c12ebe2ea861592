import random

import pytest

from tidewire.plans import bql

CASES = [
    ("tokyo", "Earthquake in Tokyo today", True),
    ("tokyo", "Tokyoite", False),
    ('"in tokyo"', "quake in\n tokyo", True),
    ("quake AND NOT osaka", "quake in tokyo", True),
    ("quake -tokyo", "quake in tokyo", False),
    ("earthq*", "Earthquakes everywhere", True),
    ("wom?n", "women and women", True),
    ("a | b && c", "a", True),
    ("пожар", "Большой ПОЖАР вчера", True),
    ("地震", "昨日地震発生", True),
    ("quake NEAR/2 tokyo", "tokyo was hit by quake", False),
    ("quake NEAR/3 tokyo", "tokyo was hit by quake", True),
    ("quake ONEAR/3 tokyo", "tokyo was hit by quake", False),
    ("quake AROUND(3) tokyo", "tokyo was hit by quake", True),
    ("foo:bar", "some foo:bar here", True),
]


@pytest.mark.parametrize(("query", "text", "expected"), CASES)
def test_cases_match_in_python(query, text, expected):
    assert bql.matches(bql.parse(query), {"all": text}) is expected


def test_cases_match_in_spark(spark):
    for query, text, expected in CASES:
        for portable in (False, True):
            df = spark.createDataFrame([(text,)], "t string")
            from pyspark.sql import functions as F

            assert df.select(bql.query_column(query, {"all": F.col("t")}, portable)).first()[0] is expected, (query, portable)


@pytest.mark.parametrize("query", ["", '""', "a AND", "(a", "a)", '"open', "a*", "~syn", "a NEAR/0 b", "a NEAR/101 b", "(a OR b) NEAR c", "title:", "NOT"])
def test_errors(query):
    assert bql.validate(query)


def test_scopes():
    fields = {"all": "x", "headline": "flood", "lede": "river", "text": "body", "source": "Outlet One", "site": "a.example.com"}
    for query, expected in [("title:flood", True), ("body:flood", False), ("inlede:river", True), ('source:"outlet one"', True), ("-site:a.example.com", False)]:
        assert bql.matches(bql.parse(query), fields) is expected


def test_random_trees_agree_with_truth():
    rng = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta"]

    def tree(depth):
        if depth == 0 or rng.random() < 0.3:
            w = rng.choice(words)
            return w, lambda have, w=w: w in have
        op = rng.choice(["AND", "OR", "NOT"])
        if op == "NOT":
            q, f = tree(depth - 1)
            return f"(NOT {q})", lambda have, f=f: not f(have)
        (a, f), (b, g) = tree(depth - 1), tree(depth - 1)
        if op == "AND":
            return f"({a} AND {b})", lambda have, f=f, g=g: f(have) and g(have)
        return f"({a} OR {b})", lambda have, f=f, g=g: f(have) or g(have)

    for _ in range(300):
        query, truth = tree(3)
        parsed = bql.parse(query)
        for bits in range(16):
            have = [w for i, w in enumerate(words) if bits >> i & 1]
            assert bql.matches(parsed, {"all": " ".join(have)}) == truth(have)


def test_advice():
    assert bql.matches_everything("a OR NOT b") and not bql.matches_everything("a NOT b")
    assert len(bql.advisories("wind OR solar OR coal OR gas NOT oil")) >= 4
    assert [t.text for t in bql.literal_terms("a1 title:b1 c1 NEAR d1")] == ["a1", "b1"]
    assert [t.text for t in bql.literal_terms("a1 title:b1", scoped=False)] == ["a1"]
    assert bql.prefilter_terms("alpha (beta OR gamma)") == [["alpha", "beta"], ["alpha", "gamma"]]
    assert bql.prefilter_terms("alph* OR beta") is None
