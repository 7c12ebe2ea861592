"""Importance resampling, the Merkle manifest and token files against brute force, on odd rows."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm import base, importance, merkle, rans, token_files

DOCS = "doc_id long, source string, lang string, n_chars long, text string"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def low(text):
    return (text or "").translate(str.maketrans(UPPER, LOWER))


def odd(rng, n):
    texts = [None, "", " \n\t", "One two", "Größe É中文 word", "x" * 3000, "a  b\n\nc <|endoftext|> d", "1.5 it's, they'll"]
    return [(rng.choice([None, 7, i, i, i, i]), rng.choice([None, "s", "é"]), rng.choice([None, "en", "en", "en", "de", "É"]), rng.choice([None, 3]), rng.choice([*texts, *(" ".join(f"W{rng.randrange(50)}" for _ in range(40)) for _ in range(8))])) for i in range(n)]


def clashing(df):
    for name in ("part", "tree", "index", "hash", "level", "rank", "score", "weight", "start", "features", "place", "n", "ids"):
        df = df.withColumn(name, F.lit("clash"))
    return df


# 11


def slow_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
    runs = words + [" ".join(w) for w in zip(words, words[1:])]
    return len(words), [zlib.crc32(r.encode()) % 10_000 for r in runs]


def test_the_ring_holds_all_runs():
    for n in (1, 2, 3, 5):
        words = [f"w{i}" for i in range(9)]
        runs = [" ".join(words[i:j]) for i in range(9) for j in range(i + 1, min(i + n, 9) + 1)]
        count, found = importance.scan(" ".join(words).upper().encode(), n, 1000)
        assert count == 9 and sorted(found.tolist()) == sorted(zlib.crc32(r.encode()) % 1000 for r in runs)
    for text in ("Ab-c\x00d é1_2Ä x", "", "..."):
        assert sorted(importance.scan(text.encode(), 2, 10_000)[1].tolist()) == sorted(slow_features(text)[1])
    assert importance.scan(None, 2, 10)[0] == 0


@pytest.mark.parametrize("n", [0, 150])
def test_draws_equal_brute_force(spark, n):
    rng = random.Random(11)
    rows = odd(rng, n)
    goal = [("W1 w2 w3 w4 " * 5,), (None,), ("größe",)]
    docs = clashing(spark.createDataFrame(rows, DOCS).repartition(3))
    got = importance.resampled(docs, spark.createDataFrame(goal, "text string"), percent=25, least_words=2).collect()
    held = [slow_features(r[4]) for r in rows]
    s, t = (np.bincount([b for f in fs for b in f], minlength=10_000) for fs in ([f for _, f in held] or [[]], [slow_features(g[0])[1] for g in goal]))
    gain = [math.floor(1000 * math.log((float(t[b]) + 1) * (s.sum() + 10_000) / ((float(s[b]) + 1) * (t.sum() + 10_000)))) for b in range(10_000)]
    want = []
    for (doc, *_), (words, found) in zip(rows, held):
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'-' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        want.append((doc, words, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:5]) for r in got)
    able = sorted((w for w in want if w[1] >= 2), key=lambda w: (-w[4], w[0] is None, w[0] or 0, w[2], w[3], w[1]))
    drawn = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in drawn] == [*range(1, 25 * len(able) // 100 + 1)]
    assert [tuple(r)[:5] for r in drawn] == able[: len(drawn)]


def test_drawn_rows_are_whole(spark):
    docs = spark.createDataFrame([(i, None, None, None, f"good words {i} " * 9 if i % 4 == 0 else f"other text {i} " * 9) for i in range(40)], DOCS)
    found = importance.draw(docs, docs.filter("doc_id % 4 = 0").select("text"), percent=25).collect()
    assert len(found) == 10 and all(r.text for r in found) and sum(r.doc_id % 4 == 0 for r in found) >= 8
    assert importance.resampled(docs, docs.limit(0)).count() == 40


# 12


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def slow_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def slow_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def slow_path(levels, i):
    for level in levels[:-1]:
        first = i // 8 * 8
        yield "".join(level[first:i]), "".join(level[i + 1 : first + 8])
        i //= 8


def slow_proofs(rows, changed):
    by_lang = {}
    for row in rows:
        by_lang.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, slow_leaf(row), row))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = [slow_levels([x[2] for x in sorted(by_lang[k], key=lambda x: x[:3])]) for k in langs]
    top, out = slow_levels([t[-1][0] for t in trees]), []
    for k, (lang, tree) in enumerate(zip(langs, trees)):
        for i, (_, _, leaf, row) in enumerate(sorted(by_lang[lang], key=lambda x: x[:3])):
            path, at = [*slow_path(tree, i), *slow_path(top, k)], slow_leaf(changed(row))
            for left, right in path:
                at = sha(left + at + right)
            out.append((row[0], leaf, tree[-1][0], top[-1][0], sha("".join(a + b for a, b in path)), at, at == top[-1][0]))
    return sorted(map(repr, out))


def changed(row):
    hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
    return (*row[:4], low(row[4]) if hit and row[4] is not None else row[4])


@pytest.mark.parametrize("n", [0, 1, 2, 9, 600])
def test_proofs_equal_brute_force(spark, n):
    rng = random.Random(n)
    rows = odd(rng, n)
    docs = clashing(spark.createDataFrame(rows, DOCS).repartition(3))
    text = F.when(base.crc_mod(F.col("doc_id"), 3) == 0, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    got = merkle.proofs(docs, text).collect()
    assert sorted(repr(tuple(r)) for r in got) == slow_proofs(rows, changed)
    assert merkle.root(docs) == (got[0].root if got else None)


def test_one_tree_of_several_levels_and_many_trees(spark):
    one = [(i, None, "en", 1, f"Text {i}") for i in range(1100)]
    many = [(i, None, f"l{i:03}", 1, "T") for i in range(150)]
    for rows in (one, many):
        got = merkle.proofs(spark.createDataFrame(rows, DOCS).repartition(5)).collect()
        assert sorted(repr(tuple(r)) for r in got) == slow_proofs(rows, lambda r: r) and all(r.verified for r in got)


def test_forests_merge_in_any_order():
    rng = random.Random(12)
    sizes = {0: 1, 1: 8, 2: 9, 3: 100, 4: 513, **{k: 3 for k in range(5, 12)}}
    leaves = [(tree, n, 0, i, sha(f"{tree} {i}")) for tree, n in sizes.items() for i in range(n)]
    roots, made = set(), set()
    for _ in range(20):
        rng.shuffle(leaves)
        cuts = sorted(rng.sample(range(len(leaves)), 6))
        forests = [merkle.Forest(len(sizes)) for _ in range(7)]
        for forest, a, b in zip(forests, [0, *cuts], [*cuts, len(leaves)]):
            for leaf in leaves[a:b]:
                forest.add(*leaf)
        while len(forests) > 1:
            i = rng.randrange(len(forests) - 1)
            forests[i : i + 2] = [forests[i].merge(forests[i + 1])]
        roots.add(forests[0].root())
        made.add(tuple(sorted(forests[0].made)))
    assert len(roots) == len(made) == 1 and None not in roots


def test_sorted_parts_leave_few_nodes():
    forest = merkle.Forest(1)
    for i in range(1000, 90_000):
        forest.add(0, 1_000_000, 0, i, "h")
    assert len(list(forest.nodes())) <= 2 * 7 * merkle.height(1_000_000)


# 13


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    return path, Tokenizer.from_file(path)


@pytest.mark.parametrize("sizes", [(1 << 23, 1 << 18), (300, 70)])
def test_files_give_back_all_ids(spark, library, tmp_path, sizes):
    path, lib = library
    rng = random.Random(13)
    rows = odd(rng, 120)
    root = str(tmp_path / "ids")
    token_files.write(clashing(spark.createDataFrame(rows, DOCS).repartition(3)), root, path, 0, *sizes)
    got = sorted(token_files.documents(spark, root).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d or 0))
    assert [r.start for r in got] == [0, *itertools.accumulate(r.n_tokens for r in got)][:-1]
    code = lambda text: np.array(lib.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")
    want = [(r[0], len(ids := code(r[4])), zlib.crc32(ids.tobytes())) for r in rows]
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.n_tokens, r.ids_crc32)) for r in got)
    # The ids themselves, in whole and in part.
    ids = [i for r in sorted(token_files.parts(spark, root).collect(), key=lambda r: r["at"]) for i in r.ids]
    assert [zlib.crc32(np.array(ids[r.start : r.start + r.n_tokens], "<u4").tobytes()) for r in got] == [r.ids_crc32 for r in got]
    low, high = len(ids) // 3, len(ids) // 3 + 500
    some = sorted(token_files.ids_between(spark, root, low, high).collect(), key=lambda r: r["at"])
    assert [i for r in some for i in r.ids] == ids[low:high] and some[0]["at"] == low
    blocks = token_files.manifest(spark, root)
    assert blocks.filter(F.col("n_ids") > sizes[1]).isEmpty() and blocks.groupBy("file").agg(F.sum("n_ids").alias("n")).filter(F.col("n") > sizes[0]).isEmpty()


def test_no_rows_write_no_file(spark, library, tmp_path):
    token_files.write(spark.createDataFrame([], DOCS), str(tmp_path / "none"), library[0])
    assert token_files.documents(spark, str(tmp_path / "none")).count() == 0


def test_a_changed_byte_is_refused(spark, library, tmp_path):
    root = str(tmp_path / "bad")
    token_files.write(spark.createDataFrame([(1, None, None, None, "some words " * 50)], DOCS), root, library[0])
    block = token_files.manifest(spark, root).first()
    with open(f"{root}/files/{block.file}", "r+b") as file:
        file.seek(block.offset + block.length - 3)
        byte = file.read(1)
        file.seek(-1, 1)
        file.write(bytes([byte[0] ^ 1]))
    with pytest.raises(Exception, match="checksum"):
        token_files.documents(spark, root).collect()


def test_chunks_and_slices_equal_the_library(library):
    path, lib = library
    tokens, rng = token_files.Tokens(path), random.Random(14)
    bits = ["a", "b", " ", " ", " ", "  ", "\n", "\t", "é", "ß", "1", "'s", "'ll", "!", "<|endoftext|>", "\xa0", " ", "᠎", "\x1c", "\x85", "中", "🙂", "the", " house", "\r\n", "́", "<|", "\x00"]
    for _ in range(150):
        texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(50))) for _ in range(8)]
        for text, ids in zip(texts, tokens.many(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids
            pieces = list(token_files._slices(text, 5))
            assert "".join(pieces) == text and b"".join(tokens.many(pieces)) == ids


class Given:
    """A tokenizer that counts the characters it gets."""

    def __init__(self, inner):
        self.inner, self.n = inner, 0

    def encode_batch_fast(self, texts, **options):
        self.n += sum(map(len, texts))
        return self.inner.encode_batch_fast(texts, **options)


def test_the_library_gets_each_word_once(library, monkeypatch):
    path, lib = library
    tokens, rng = token_files.Tokens(path), random.Random(17)
    tokens.library, tokens.words = Given(tokens.library), Given(tokens.words)
    words = ["".join(rng.choices("abcdefghiéßñжσ", k=9)) for _ in range(500)]
    after = ["", ",", "$$$", "***", ").", " |", " 1999", "\n\n"]
    texts = [" ".join(rng.choice(words) + rng.choice([*after, "-" + rng.choice(words), ".\n" + rng.choice(words)]) for _ in range(500)) for _ in range(60)]
    want = [np.array(e.ids, "<u4").tobytes() for e in lib.encode_batch_fast(texts, add_special_tokens=False)]
    assert tokens.many(texts) == want
    # Each word with and without a space before it, its bytes written as characters, with a line end after it.
    most = 2.1 * sum(len(w.encode()) + 2 for w in words)
    assert tokens.library.n + tokens.words.n < most
    assert tokens.many(texts) == want and tokens.library.n + tokens.words.n < most
    monkeypatch.setattr(token_files, "KEPT", 100)
    for k in range(0, 60, 10):
        assert tokens.many(texts[k : k + 10]) == want[k : k + 10] and len(tokens.kept) <= 100


def test_pieces_of_any_characters_equal_the_library(library):
    path, lib = library
    tokens, rng = token_files.Tokens(path), random.Random(18)
    some = ["a", " ", " ", "\n", "5", "'", "s", "!", "<", "|", "<|endoftext|>", "×", "÷", "ÿ", "ȿ", "ɀ", "\x85", "\xa0", "\u1680", "\u180e", "\u2003", "\u2028", "\u205f", "\u3000", "の", "\ufeff", "½"]
    for _ in range(40):
        other = [chr(rng.choice([*range(1, 0x700), *range(0x1000, 0xD800), *range(0xE000, 0x11000)])) for _ in range(20)]
        texts = ["".join(rng.choice(rng.choice([some, other])) for _ in range(rng.randrange(25))) for _ in range(100)]
        assert tokens.cuts and tokens.many(texts) == [np.array(e.ids, "<u4").tobytes() for e in lib.encode_batch_fast(texts, add_special_tokens=False)]


def test_a_file_whose_added_tokens_can_be_cut_gets_whole_texts(library, tmp_path):
    from tokenizers import AddedToken, Tokenizer

    for k, token in enumerate([AddedToken("two words"), AddedToken("[mark]", lstrip=True), AddedToken("<x1>"), AddedToken("abc")]):
        lib = Tokenizer.from_file(library[0])
        lib.add_tokens([token])
        lib.save(str(tmp_path / f"{k}.json"))
        texts = ["two words and  [mark] <x1> abcabc, \n\n[mark]", "", "abc"]
        tokens = token_files.Tokens(str(tmp_path / f"{k}.json"))
        assert not tokens.cuts and tokens.many(texts) == [np.array(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    # Slices of a long text don't part a token either.
    lib, text = Tokenizer.from_file(str(tmp_path / "0.json")), "x" * 4 + "two words " * 105_000
    ids = np.concatenate([ids for _, ids in token_files._encoded([text], token_files.Tokens(str(tmp_path / "0.json")), 0)])
    assert len(text) > token_files.SLICE and ids.tolist() == [*lib.encode(text, add_special_tokens=False).ids, 0]


def test_coded_blocks_decode_from_any_checkpoint():
    rng = np.random.default_rng(15)
    for n, kinds in ((1, 1), (255, 9), (256, 2), (257, 50_000), (32_768, 1), (32_769, 4), (100_000, 50_257)):
        symbols = (np.minimum(rng.zipf(1.3, n), kinds) - 1).astype(np.uint32)
        table = rans.Frequencies.of(symbols)
        states, places, words = rans.encode(symbols.reshape(1, -1), table)[0]
        assert (rans.decode(n, table, states, places, words) == symbols).all()
        size = rans.LANES * rans.EVERY
        for k in range(len(states)):
            assert (rans.decode(n, table, states, places, words, first=k, last=k + 1) == symbols[k * size : (k + 1) * size]).all()
    rows = symbols[: n // 3 * 3].reshape(3, -1)
    for row, (states, places, words) in zip(rows, rans.encode(rows, table)):
        assert (rans.decode(len(row), table, states, places, words) == row).all()
    shares = np.bincount(symbols) / n
    entropy = -(shares[shares > 0] * np.log2(shares[shares > 0])).sum()
    assert 32 * len(words) / len(row) < 1.02 * entropy + 0.1


def test_checksums_join():
    rng = random.Random(16)
    for _ in range(50):
        a, b = rng.randbytes(rng.randrange(60)), rng.randbytes(rng.randrange(60))
        assert token_files.crc_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
