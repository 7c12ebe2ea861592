"""Near-duplicate detection: fast similarity sketches, banding, exact verification.

A document's set holds the hashes of its distinct word shingles. The sketch has ``COORDINATES``
coordinates. In round i < COORDINATES every element falls into a hashed bin with the value
(i, hash); a coordinate keeps the least value it has seen. Later rounds COORDINATES + j put every
element into bin j, so every coordinate is filled after at most twice as many rounds whatever
the size of the set, and a document stops at the round that fills its last coordinate.

Coordinates go into ``BANDS`` bands. Documents with equal bands are candidates, and a
link is made only if the full sets pass the similarity. With 28 bands of 4 coordinates two sets
of similarity 0.8 miss every band with probability 4e-7 (0.85: 1e-9).

Candidates of a band aren't all paired with each other. Equal word sequences are one class from
the start. Buckets of up to ``SMALL`` classes are paired in full; in a larger bucket every class is
held against the most central one (that of the most and largest buckets), so n alike classes cost n - 1
comparisons. Classes that stay outside the largest component of a bucket are then held against all
classes of their group (what large buckets connect) in blocks of ``QUERIES`` by ``ROWS_AT_ONCE``: 0/1
columns of full sets are multiplied, and of each such class one link to each other component comes out. No pairs are
put out for that and no task gets a whole group. ``SMALL`` changes the way, not the result: any pair with a class outside
the largest component of its bucket is compared.

Nulls: a document with a null or blank text has no shingles and is linked with nothing; one with
a null id is returned with a null component, kept, linked with nothing. Fewer words than a shingle
make one shingle of them all. Repeated rows share their id, so their component; where one id has
several texts, each row is placed by its own, and a link holds if any text of the one id is like any of the other.
Empty tables give empty results.
Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base
from .components import connected

COORDINATES, ROWS = 112, 4
BANDS = COORDINATES // ROWS
SMALL = 8
#: Classes of a block: those outside their bucket's largest component, and those they are held against.
QUERIES, ROWS_AT_ONCE = 2048, 4096
#: Elements of a set, so many as a block has room for on average.
ELEMENTS = 500
#: Elements that are sketched at once.
CHUNK = 2_000_000
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits with full avalanche."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _Hashes()


def words_of(text: str | None) -> list[bytes]:
    """Words of a text with A-Z in lower case; bytes.split knows exactly the contract's blanks."""
    return (text or "").encode("utf-8", "replace").lower().split()


def shingles(words: list[bytes], width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    out = np.full(n, min(width, len(h)), np.uint64)
    for k in range(min(width, len(h))):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(out)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """One row of COORDINATES values for each set; sets without elements have the empty value."""
    t = COORDINATES
    out = np.full(len(sets) * t, _EMPTY, np.uint64)
    sizes = np.array([len(s) for s in sets])
    elements = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    for i in range(2 * t):
        if not len(elements):
            break
        x = mix(elements ^ mix(np.full(1, i + 1, np.uint64)))
        bins = ((x >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else i - t
        value = (np.uint64(i) << np.uint64(32)) | (x & np.uint64(0xFFFFFFFF))
        np.minimum.at(out, owner * t + bins, value)
        if i < 4 or i % 4 == 3:
            open_ = (out.reshape(-1, t) == _EMPTY).any(axis=1)[owner]
            elements, owner = elements[open_], owner[open_]
    return out.reshape(-1, t)


def bands_of(sketch: np.ndarray) -> np.ndarray:
    parts = sketch.reshape(len(sketch), BANDS, ROWS)
    key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sketch), 1))
    for k in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return key.view(np.int64)


def _chunks(batch: pa.RecordBatch):
    """(ids, texts) of a few million characters each."""
    ids, texts, start, size = batch.column(0).to_pylist(), batch.column(1), 0, 0
    lengths = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist()
    for i, n in enumerate(lengths):
        size += n
        if size > 4 * CHUNK or i == len(lengths) - 1:
            yield ids[start : i + 1], texts.slice(start, i + 1 - start).to_pylist()
            start, size = i + 1, 0


def sketched(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the word sequence and the band keys."""
    base.python_ready(docs.sparkSession)
    schema = "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>"
    arrow = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        import pyarrow.compute  # noqa: F401

        for batch in batches:
            for ids, texts in _chunks(batch):
                words = [words_of(t) for t in texts]
                digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(b" ".join(w)) for w in words), np.int64).reshape(-1, 2)
                sets = [shingles(w, width) for w in words]
                del words
                keys = bands_of(sketches(sets))
                sizes = np.array([len(s) for s in sets], np.int64)
                offsets = np.arange(0, keys.size + 1, BANDS, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(sizes), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()))],
                    schema=arrow,
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """id and the whole shingle set of each document."""
    base.python_ready(docs.sparkSession)
    arrow = pa.schema([("id", pa.int64()), ("set", pa.list_(pa.int64()))])

    def run(batches):
        import pyarrow.compute  # noqa: F401

        for batch in batches:
            for ids, texts in _chunks(batch):
                sets = [shingles(words_of(t), width).view(np.int64) for t in texts]
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], schema=arrow)

    return docs.select(F.col("id").cast("long").alias("id"), "text").mapInArrow(run, "id long, set array<long>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int, per_salt: int = 256) -> DataFrame:
    """The pairs (u, v) with 100 * intersection >= percent * union.

    A u with many partners is dealt over salts, so no task gets all of them.
    """
    degree = pairs.groupBy("u").agg(F.ceil(F.count("*") / per_salt).cast("int").alias("salts"))
    left = degree.join(sets.withColumnsRenamed({"id": "u", "set": "u_set"}), "u").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    right = (
        pairs.join(degree, "u")
        .withColumn("salt", F.pmod(F.xxhash64("v"), F.col("salts")).cast("int"))
        .select("u", "v", "salt")
        .join(sets.withColumnsRenamed({"id": "v", "set": "v_set"}), "v")
    )
    both = F.size(F.array_intersect("u_set", "v_set")).cast("long")
    return (
        left.select("u", "salt", "u_set")
        .join(right, ["u", "salt"])
        .withColumn("both", both)
        .filter(100 * F.col("both") >= percent * (F.size("u_set") + F.size("v_set") - F.col("both")))
        .select("u", "v")
    )


def _outside(large: DataFrame, labels: DataFrame, work: base.Scratch) -> tuple[DataFrame, DataFrame]:
    """(id, component) of the classes outside the largest component of a large bucket; the same of all its classes."""
    held = work.keep(
        large.select("key", "id").join(labels.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("component")),
        "held",
    )
    shares = held.groupBy("key", "component").agg(F.count("*").alias("n"))
    top = shares.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.count("*").alias("parts")).filter("parts > 1").select("key", F.col("top.component").alias("top"))
    outside = held.join(top, "key").filter("component <> top").select("id", "component").distinct()
    return work.keep(outside, "outside"), work.keep(held.select("id", "component").distinct(), "inside")


def _block_links(ids: list, sets: list, comps: list, ids2: list, sets2: list, comps2: list, percent: int, columns: int = 4096):
    """(u, v) of sets in the first and the second list that pass; one link of each u to each component."""
    sizes, sizes2 = np.array([len(s) for s in sets]), np.array([len(s) for s in sets2])
    flat, flat2 = np.concatenate(sets), np.concatenate(sets2)
    row, row2 = np.repeat(np.arange(len(sets)), sizes), np.repeat(np.arange(len(sets2)), sizes2)
    values, at, times = np.unique(flat, return_index=True, return_counts=True)
    values2, at2, times2 = np.unique(flat2, return_index=True, return_counts=True)
    shared, i, j = np.intersect1d(values, values2, assume_unique=True, return_indices=True)
    # What a class shares only with itself, on the other side of the block, tells nothing of other classes.
    alone = (times[i] == 1) & (times2[j] == 1) & (np.array(ids)[row[at[i]]] == np.array(ids2)[row2[at2[j]]])
    shared = shared[~alone]
    both = np.zeros((len(sets), len(sets2)), np.float32)
    for i in range(0, len(shared), columns):
        part = shared[i : i + columns]
        left, right = (np.zeros((n, len(part)), np.float32) for n in (len(sets), len(sets2)))
        for out, values, rows in ((left, flat, row), (right, flat2, row2)):
            at = np.searchsorted(part, values)
            hit = part[np.minimum(at, len(part) - 1)] == values
            out[rows[hit], at[hit]] = 1
        both += left @ right.T
    comps, comps2 = np.array(comps), np.array(comps2)
    passed = (100 * both >= percent * (sizes[:, None] + sizes2[None, :] - both)) & (comps[:, None] != comps2[None, :])
    us, vs = [], []
    for i in np.flatnonzero(passed.any(axis=1)):
        hits = np.flatnonzero(passed[i])
        _, first = np.unique(comps2[hits], return_index=True)
        us += [ids[i]] * len(first)
        vs += [ids2[k] for k in hits[first]]
    return us, vs


def _by_blocks(outside: DataFrame, inside: DataFrame, groups: DataFrame, sets: DataFrame, percent: int, work: base.Scratch) -> DataFrame:
    """Links (u, v) of the outside classes with classes of other components of their group."""
    asking = outside.select("id", F.lit(True).alias("asks"))
    asked = groups.join(asking, "id").select("grp").distinct()
    rows = inside.join(groups, "id").join(asked, "grp", "left_semi").join(asking, "id", "left").join(sets, "id")
    rows = rows.select("grp", "id", "component", F.coalesce("asks", F.lit(False)).alias("query"), F.size("set").cast("long").alias("n"), "set")
    rows = work.keep(rows, "grouped")
    # Blocks are bounded by their classes and, on average, by the elements of their sets, so long texts make small ones.
    blocks = lambda held, most: F.greatest(F.ceil(F.count_if(held) / most), F.ceil(F.sum(F.when(held, F.col("n")).otherwise(0)) / (most * ELEMENTS))).cast("int")
    parts = work.keep(rows.groupBy("grp").agg(blocks(F.col("query"), QUERIES).alias("n_q"), blocks(F.lit(True), ROWS_AT_ONCE).alias("n_r")), "parts")
    rows = rows.join(parts, "grp").withColumn("mix", F.xxhash64("id"))
    over = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    queries = rows.filter("query").select("grp", F.pmod("mix", "n_q").cast("int").alias("q"), over("n_r").alias("r"), "id", "component", "set")
    others = rows.select(F.col("grp").alias("grp2"), over("n_q").alias("q2"), F.pmod("mix", "n_r").cast("int").alias("r2"), F.col("id").alias("id2"), F.col("component").alias("component2"), F.col("set").alias("set2"))
    out = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def block(one: pa.Table, two: pa.Table) -> pa.Table:
        if not (one.num_rows and two.num_rows):
            return out.empty_table()
        read = lambda t, i, s, c: (t[i].to_pylist(), [np.asarray(x.values) for x in t[s]], t[c].to_pylist())
        us, vs = _block_links(*read(one, "id", "set", "component"), *read(two, "id2", "set2", "component2"), percent)
        return pa.table([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], schema=out)

    return queries.groupBy("grp", "q", "r").cogroup(others.groupBy("grp2", "q2", "r2")).applyInArrow(block, "u long, v long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs (doc_id, text)."""
    work = base.Scratch(docs.sparkSession, "near")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    all_rows = work.keep(sketched(docs, width), "sketched")
    classes = work.keep(
        all_rows.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2", "bands").agg(F.min("doc_id").alias("id")),
        "classes",
    )
    members = classes.select("id", F.explode("bands").alias("key"))
    sizes = members.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    buckets = work.keep(members.join(sizes, "key"), "buckets")
    small, large = buckets.filter(F.col("n") <= SMALL).select("key", "id"), buckets.filter(F.col("n") > SMALL)
    # Of equally central classes the smallest id is the centre.
    weight = large.groupBy("id").agg(F.sum("n").alias("weight"))
    centres = large.join(weight, "id").groupBy("key").agg(F.max(F.struct("weight", (-F.col("id")).alias("minus"))).alias("top")).select("key", (-F.col("top.minus")).alias("centre"))
    large = work.keep(large.select("key", "id").join(centres, "key"), "large")
    pairs = (
        large.filter("id <> centre").select(F.col("centre").alias("u"), F.col("id").alias("v"))
        .union(small.withColumnRenamed("id", "u").join(small.withColumnRenamed("id", "v"), "key").filter("u < v").select("u", "v"))
        .distinct()
    )
    pairs = work.keep(pairs, "pairs")
    named = buckets.select("id").distinct()
    sets = work.keep(full_sets(docs.withColumnRenamed("doc_id", "id").join(named, "id", "left_semi").distinct(), width), "sets")
    links = work.keep(verified(pairs, sets, percent), "links")
    work.drop("buckets", "pairs")
    labels = connected(links, work, "labels")

    outside, inside = _outside(large, labels, work)
    if not outside.isEmpty():
        # What large buckets connect, alike or not, is a group.
        named = connected(large.filter("id <> centre").select(F.col("id").alias("u"), F.col("centre").alias("v")), work, "groups")
        groups = inside.select("id").join(named.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("grp"))
        found = work.keep(_by_blocks(outside, inside, groups, sets, percent, work), "found")
        labels = connected(links.union(found), work, "all_labels")
    work.drop("sets", "large", "links", "grouped", "parts")

    to_class = classes.select("d1", "d2", "id").join(labels.withColumnRenamed("node", "id"), "id", "left").select("d1", "d2", F.coalesce("component", "id").alias("component"))
    has = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    return (
        all_rows.select("doc_id", "n_shingles", F.when(has, F.col("d1")).alias("d1"), F.when(has, F.col("d2")).alias("d2"))
        .join(to_class, ["d1", "d2"], "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
