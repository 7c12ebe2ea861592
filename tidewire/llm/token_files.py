"""Token ids of a corpus in binary files, coded by a static range asymmetric numeral system (``rans.py``).

``write`` sorts the documents by doc_id in ranges; each task encodes the whole texts of its range with the tokenizers
library, puts the end id after each, and writes files of at most ``FILE_IDS`` ids into a shared folder. A file has
a head, one frequency table that all its blocks share, and independent blocks of at most ``BLOCK_IDS`` ids: whole documents or,
where they are longer, parts of them. A block holds the ids' documents, the coder's checkpoints, its words and
a CRC-32 of all that, so any block, and any segment between checkpoints, can be decoded alone; a block whose sum or last state doesn't
match stops the job. Files have names of their own for every attempt, and only those of tasks that ended are listed in the
manifest (a Parquet table with a row for each block), so a task that runs again does no harm.

``documents``, ``parts`` and ``ids_between`` read the files back, each block by whichever task it is dealt to. What a task holds is bounded
by the ids of a file, an Arrow batch and some ten times the bytes of ``GROUP`` characters.

The library encodes each distinct piece once in some ``GROUP`` characters of texts: where two bytes in a row tell that a word of
the byte-level pattern begins (a space before a letter, a mark after a letter), texts are cut, and Arrow finds the distinct pieces and puts
their ids together. Pieces that are one word go to the library in one text, and are told apart by the lengths of their ids' strings. A worker
keeps the ids of the ``KEPT`` pieces that it met most often lately, as Arrow arrays.

Nulls: a null or empty text has the end id alone; a null doc_id comes before all others. Rows with equal doc_id
are documents of their own, in the order of a hash of their texts. Empty tables write no file and read as empty
results. Extra columns are not read.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import base, rans
from .bpe_count import _byte_characters

FILE_IDS, BLOCK_IDS, SIDE_BY_SIDE, SLICE = 1 << 22, 1 << 18, 4, 1 << 20
GROUP, WORDS_AT_ONCE = 1 << 22, 1 << 14
KEPT, KEPT_BYTES = 300_000, 64
_MAGIC = b"TWIDS\x00\x00\x01"
#: Bytes and CRC-32 of the table.
_TABLE = struct.Struct("<II")
#: Ids, documents, checkpoints, words, place of the first document's first id and of the first id (from the first id of the range), CRC-32 of what follows.
_BLOCK = struct.Struct("<IIIIQQI")
_MANIFEST = "part int, file string, offset long, length long, first long, n_ids long, n_docs long"
#: Where a text may be cut in slices. White space in a row before an added token is one word, so only a character of words tells that it isn't.
_CUT = re.compile(r"[ \n](?=\w)|(?<=\S) (?=\S)")


#: Kinds of a byte: of a character that may be white space or begin an added token, surely of neither, and those whose runs are words of the pattern.
_OTHER, _SURE, _SPACE, _WHITE, _QUOTE, _MARK, _DIGIT, _LETTER = range(8)
#: Where a word of the pattern surely begins, by the kinds of two bytes in a row: at the first one (a white space before another character), and at the second one.
_AT_FIRST, _AT_SECOND = np.zeros((8, 8), dtype=bool), np.zeros((8, 8), dtype=bool)
_AT_FIRST[_SPACE : _WHITE + 1, [_SURE, _QUOTE, _MARK, _DIGIT, _LETTER]] = True
_AT_SECOND[_WHITE, [_SURE, _QUOTE, _MARK, _DIGIT, _LETTER]] = True
_AT_SECOND[[_QUOTE, _MARK, _DIGIT, _LETTER], _WHITE] = True
_AT_SECOND[_DIGIT:, [_QUOTE, _MARK]] = _AT_SECOND[_MARK, _DIGIT:] = _AT_SECOND[_DIGIT, _LETTER] = _AT_SECOND[_LETTER, _DIGIT] = True
#: Kind of a character beyond ASCII by its first two bytes: some white spaces have those named here (and U+180E, which once was one); letters of two bytes, but for later additions to Unicode.
_WIDE = np.full(1 << 16, _SURE, dtype=np.uint8)
_WIDE[[0xC285, 0xC2A0, 0xE19A, 0xE1A0, 0xE280, 0xE281, 0xE380]] = _OTHER
_WIDE[[int.from_bytes(chr(c).encode()) for c in (*range(0xC0, 0x240), *range(0x386, 0x482)) if chr(c).isalpha()]] = _LETTER
#: The code point of the character that stands for each byte in a byte-level vocabulary; line ends part words here.
_SHOWN = np.array([10 if b == 10 else ord(c) for b, c in enumerate(_byte_characters())], dtype="<u4")


class Tokens:
    """Ids of whole texts as the library for a byte-level vocabulary file gives them, as bytes of unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, CharDelimiterSplit

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark shares out the cores
        self.library = Tokenizer.from_file(path)
        # The same model for words that are cut and written as characters of its vocabulary already.
        self.words = Tokenizer(self.library.model)
        self.words.pre_tokenizer = CharDelimiterSplit("\n")
        added = list(self.library.get_added_tokens_decoder().values())
        special, vocabulary = {t.content for t in added}, self.library.get_vocab(True)
        # Each character of an id's string stands for one byte, but for added ones, which are written as they are.
        self.bytes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for word, i in vocabulary.items():
            self.bytes[i] = len(word.encode()) if word in special else len(word)
        self.kinds = np.full(256, _OTHER, dtype=np.uint8)
        self.kinds[32], self.kinds[9:14] = _SPACE, _WHITE
        for b in range(33, 127):
            c = chr(b)
            self.kinds[b] = _LETTER if c.isalpha() else _DIGIT if c.isdigit() else _OTHER if any(c == t.content[0] for t in added) else _SURE if any(c in t.content for t in added) else _QUOTE if c == "'" else _MARK
        cutter = self.library.pre_tokenizer
        #: Whether texts may be cut: by this pattern, and if no added token can be cut or takes the white space around it.
        self.cuts = self.library.normalizer is None and isinstance(cutter, ByteLevel) and cutter.use_regex and not cutter.add_prefix_space
        self.cuts = self.cuts and not any(t.lstrip or t.rstrip or t.single_word or self.kinds[t.content.encode()[0]] != _OTHER or not t.content[0].isascii() or self._begins(np.frombuffer(t.content.encode(), dtype=np.uint8))[1:-1].any() for t in added)
        #: Pieces met often lately, their ids, and how often: each group counts half of the next one.
        self.kept, self.kept_ids, self.often = _large(np.zeros(0, np.uint8), np.zeros(1)), _large(np.zeros(0, np.uint8), np.zeros(1)), np.zeros(0)

    def _kinds(self, data: np.ndarray) -> np.ndarray:
        kinds = _looked_up(self.kinds, data)
        if len(wide := np.flatnonzero(data >= 0xC2)):
            kinds[wide] = found = _WIDE[(data[wide].astype(np.int64) << 8) | data[wide + 1]]
            kinds[wide[found == _LETTER] + 1] = _LETTER
        return kinds

    def _begins(self, data: np.ndarray, starts: np.ndarray = np.zeros(1, dtype=np.int64)) -> np.ndarray:
        """Of each byte and the end, whether a piece begins there; starts: of the texts."""
        out = np.zeros(len(data) + 1, dtype=bool)
        if len(data) > 1:
            kinds = self._kinds(data)
            pairs = kinds[:-1] << 3
            pairs |= kinds[1:]
            out[:-2] = _looked_up(_AT_FIRST, pairs)
            # What stands after a text is none of it.
            out[starts[starts > 0] - 1] = False
            out[1:-1] |= _looked_up(_AT_SECOND, pairs).view(bool)
        return out

    def _ids(self, pieces: pa.Array) -> pa.Array:
        """The ids of each of distinct pieces. A run of letters, digits or marks, with or without a space before it, is one word of the pattern."""
        data, ends = _bytes(pieces)
        kinds, begin = self._kinds(data), ends[:-1]
        bad = kinds < _MARK
        bad[begin] &= (data[begin] != 32) | (np.diff(ends) == 1)
        before = np.concatenate([[0], np.cumsum(bad)])
        word = before[ends[1:]] == before[begin]
        # A space before what is no space always begins a word, so such pieces can stand in one text.
        row = ~word & (np.diff(ends) > 1) & (data[begin] == 32) & np.isin(kinds[np.minimum(begin + 1, max(len(data) - 1, 0))], [_SURE, *range(_QUOTE, _LETTER + 1)])
        if not self.cuts:
            word, row = np.zeros(len(pieces), dtype=bool), np.zeros(len(pieces), dtype=bool)
        found, sizes, place, n = [np.zeros(0, "<u4")], [], np.empty(len(pieces), dtype=np.int64), 0
        for kind in (word, row):
            data, ends = _bytes(pieces.filter(pa.array(kind)))
            for k in range(0, len(ends) - 1, WORDS_AT_ONCE):
                part = ends[k : k + WORDS_AT_ONCE + 1] - ends[k]
                some = data[ends[k] : ends[k] + part[-1]]
                if kind is word:
                    encoded = self.words.encode_batch_fast([_SHOWN[np.insert(some, part[1:-1], 10)].tobytes().decode("utf-32-le")], add_special_tokens=False)
                else:
                    encoded = self.library.encode_batch_fast([some.tobytes().decode()], add_special_tokens=False)
                ids = np.array(encoded[0].ids, dtype="<u4")
                reached = np.cumsum(self.bytes[ids])
                at = np.searchsorted(reached, part[1:])
                if at[-1] != len(ids) - 1 or not (reached[at] == part[1:]).all():
                    raise ValueError("ids don't end where a piece ends")
                found.append(ids)
                sizes.append(np.diff(at, prepend=-1))
            place[kind] = np.arange(n, n + len(ends) - 1)
            n += len(ends) - 1
        rest = pieces.filter(pa.array(~word & ~row)).cast(pa.large_string()).to_pylist()
        for k in range(0, len(rest), WORDS_AT_ONCE):
            some = [np.array(e.ids, dtype="<u4") for e in self.library.encode_batch_fast(rest[k : k + WORDS_AT_ONCE], add_special_tokens=False)]
            found += some
            sizes.append(np.fromiter(map(len, some), dtype=np.int64, count=len(some)))
        place[~word & ~row] = np.arange(n, len(pieces))
        return _large(np.concatenate(found), 4 * np.concatenate([[0], *sizes]).cumsum()).take(pa.array(place))

    def many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        data, starts = _bytes(pa.array(texts, pa.large_string()))
        if not len(data):
            return [b""] * len(texts)
        begins = self._begins(data, starts) if self.cuts else np.zeros(len(data) + 1, dtype=bool)
        begins[starts] = True
        begins = np.flatnonzero(begins)
        # Kept pieces come first, so each has its own place as its number.
        pieces, known = pa.concat_arrays([self.kept, _large(data, begins)]).dictionary_encode(), len(self.kept)
        numbers, pieces = pieces.indices[known:], pieces.dictionary
        ids = pa.concat_arrays([self.kept_ids, self._ids(pieces[known:])])
        out, ends = _bytes(ids.take(numbers))
        often = np.bincount(numbers, minlength=len(pieces)) + np.concatenate([self.often / 2, np.zeros(len(pieces) - known)])
        often[np.diff(_bytes(pieces)[1]) > KEPT_BYTES] = 0
        keep = np.flatnonzero(often)
        if len(keep) > KEPT:
            keep = keep[np.argpartition(often[keep], -KEPT)[-KEPT:]]
        self.kept, self.kept_ids, self.often = pieces.take(pa.array(keep)), ids.take(pa.array(keep)), often[keep]
        bounds, out = ends[np.searchsorted(begins, starts)].tolist(), memoryview(out)
        return [bytes(out[a:b]) for a, b in zip(bounds, bounds[1:])]


def _looked_up(table: np.ndarray, data: np.ndarray) -> np.ndarray:
    """table's value for each byte; numpy's own indexing would make eight bytes of each first."""
    return np.frombuffer(bytearray(data.tobytes().translate(table.astype(np.uint8).tobytes().ljust(256, b"\0"))), dtype=np.uint8)


def _large(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype("<i8")), pa.py_buffer(data)])


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins and the last ends."""
    _, bounds, data = texts.buffers()
    bounds = np.frombuffer(bounds, dtype="<i8")[texts.offset : texts.offset + len(texts) + 1] if bounds and bounds.size else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]] if data else np.zeros(0, dtype=np.uint8)
    return data, bounds - bounds[0]


@lru_cache(maxsize=2)
def _tokens(path: str) -> Tokens:
    return Tokens(path)


def _slices(text: str, size: int = SLICE):
    """Pieces of about size characters, cut where a word of the pattern begins with a space or a line end."""
    start = 0
    while len(text) - start > size:
        found = _CUT.search(text, start + size)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def _encoded(texts: list[str], tokens: Tokens, end: int):
    """(place of the text, ids) in order; a long text comes in several pieces, the last with the end id."""
    last, group, size = np.array([end], dtype="<u4").tobytes(), [], 0

    def flush():
        for (at, _, ends), ids in zip(group, tokens.many([piece for _, piece, _ in group])):
            yield at, np.frombuffer(ids + last if ends else ids, dtype="<u4")

    for at, text in enumerate(texts):
        pieces = list(_slices(text or "")) if tokens.cuts else [text or ""]
        for k, piece in enumerate(pieces):
            group.append((at, piece, k == len(pieces) - 1))
            size += len(piece)
            if size > GROUP:
                yield from flush()
                group, size = [], 0
    yield from flush()


def _store(root: str):
    from pyarrow import fs

    if re.match(r"file:/[^/]", root):
        root = root.replace("file:", "file://", 1)
    return fs.FileSystem.from_uri(root)


class _File:
    """The ids of one file while it is gathered; documents are runs of ids."""

    def __init__(self, first: int, doc_start: int):
        self.first, self.doc_start, self.n = first, doc_start, 0
        self.ids, self.docs, self.begins = [], [], []

    def add(self, doc, ids: np.ndarray, begins: bool) -> None:
        if begins or not self.docs:
            self.docs.append(doc)
            self.begins.append(self.n)
        self.ids.append(ids)
        self.n += len(ids)

    def written(self, out, block_ids: int):
        """Write the file; yields offset, length, first, n_ids and n_docs of each block. The ids aren't kept."""
        ids, begins, self.ids = np.concatenate(self.ids), np.array(self.begins, dtype=np.int64), []
        table = rans.Frequencies.of(ids)
        packed = zlib.compress(np.concatenate([np.diff(table.symbols, prepend=0), table.scaled]).astype("<u4").tobytes(), 6)
        out.write(_MAGIC + _TABLE.pack(len(packed), zlib.crc32(packed)) + packed)
        offset = len(_MAGIC) + _TABLE.size + len(packed)
        whole = self.n // block_ids * block_ids
        # Blocks of one size are coded some at a time.
        rows = [ids[:whole].reshape(-1, block_ids)[k : k + SIDE_BY_SIDE] for k in range(0, whole // block_ids, SIDE_BY_SIDE)]
        rows += [ids[whole:].reshape(1, -1)] if whole < self.n else []
        at = 0
        for coded in (c for r in rows for c in zip(r, rans.encode(r, table))):
            part, (states, places, words) = coded
            lo, hi = int(np.searchsorted(begins, at, "right")) - 1, int(np.searchsorted(begins, at + len(part)))
            docs, froms = self.docs[lo:hi], np.maximum(begins[lo:hi] - at, 0)
            doc_start = self.doc_start if lo == 0 else self.first + int(begins[lo])
            body = b"".join([
                np.array([d if d is not None else 0 for d in docs], dtype="<i8").tobytes(), np.array([d is None for d in docs], dtype="u1").tobytes(),
                froms.astype("<u4").tobytes(), states.astype("<u8").tobytes(), places.tobytes(), words.tobytes(),
            ])
            head = _BLOCK.pack(len(part), len(docs), len(states), len(words), doc_start, self.first + at, zlib.crc32(body))
            out.write(head + body)
            yield offset, len(head) + len(body), self.first + at, len(part), len(docs)
            offset, at = offset + len(head) + len(body), at + len(part)


def _writer(root: str, tokenizer: str, end: int, file_ids: int, block_ids: int):
    def run(batches):
        tokens, part, place, doc_start = _tokens(tokenizer), TaskContext.get().partitionId(), 0, 0
        file, files, begins = _File(0, 0), 0, True

        def flush():
            nonlocal files
            store, path = _store(root)
            name = f"ids-{part:05}-{files:05}-{uuid.uuid4().hex}.twids"
            store.create_dir(path, recursive=True)
            with store.open_output_stream(f"{path}/{name}") as out:
                rows = [(part, name, *block) for block in file.written(out, block_ids)]
            files += 1
            return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], schema=pa.schema([("part", pa.int32()), ("file", pa.string()), *((k, pa.int64()) for k in ("offset", "length", "first", "n_ids", "n_docs"))]))

        for batch in batches:
            docs, before = batch.column(0).to_pylist(), None
            for at, ids in _encoded(batch.column(1).to_pylist(), tokens, end):
                if at != before:
                    doc_start, before, begins = place, at, True
                while True:
                    room = file_ids - file.n
                    file.add(docs[at], ids[:room], begins)
                    place, begins = place + len(ids[:room]), False
                    if file.n < file_ids:
                        break
                    yield flush()
                    file, ids = _File(place, doc_start), ids[room:]
                    if not len(ids):
                        break
        if file.n:
            yield flush()
        # A worker that waits for its next task needn't hold what Arrow has freed.
        pa.default_memory_pool().release_unused()

    return run


def write(docs: DataFrame, root: str, tokenizer: str, end: int = 0, file_ids: int = FILE_IDS, block_ids: int = BLOCK_IDS) -> None:
    """Write the ids of docs (doc_id, text), each text's followed by end, in ascending doc_id order as files under root."""
    spark = docs.sparkSession
    base.python_ready(spark)
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged.mapInArrow(_writer(f"{root}/files", tokenizer, end, file_ids, block_ids), _MANIFEST).write.parquet(f"{root}/manifest")


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """One row for each block: its file, place there, and start, the number of ids of all documents before it."""
    rows = spark.read.schema(_MANIFEST).parquet(f"{root}/manifest")
    # One row for each range, so this window has no more rows than the sort had partitions.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(parts, "part").withColumn("start", F.col("base") + F.col("first"))


@lru_cache(maxsize=2)
def _table(root: str, file: str) -> rans.Frequencies:
    store, path = _store(root)
    with store.open_input_file(f"{path}/{file}") as f:
        head = f.read_at(len(_MAGIC) + _TABLE.size, 0)
        if head[: len(_MAGIC)] != _MAGIC:
            raise ValueError(f"{file} is no file of token ids")
        size, crc = _TABLE.unpack_from(head, len(_MAGIC))
        packed = f.read_at(size, len(head))
    if zlib.crc32(packed) != crc:
        raise ValueError(f"the table of {file} doesn't match its checksum")
    both = np.frombuffer(zlib.decompress(packed), dtype="<u4").astype(np.int64)
    return rans.Frequencies(np.cumsum(both[: len(both) // 2]), both[len(both) // 2 :])


def _read(root: str, file: str, offset: int, length: int, low: int = 0, high: int = 1 << 62):
    """One block's documents: (doc_id, doc_start, start of the run, ids), cut to the segments that hold places low to high of the block."""
    table, (store, path) = _table(root, file), _store(root)
    with store.open_input_file(f"{path}/{file}") as f:
        data = f.read_at(length, offset)
    n, n_docs, n_states, n_words, doc_start, first, crc = _BLOCK.unpack_from(data)
    body = memoryview(data)[_BLOCK.size :]
    if zlib.crc32(body) != crc:
        raise ValueError(f"a block of {file} doesn't match its checksum")
    at = 0

    def taken(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(body, dtype=kind, count=count, offset=at)
        at += out.nbytes
        return out

    docs, null, froms = taken("<i8", n_docs), taken("u1", n_docs), taken("<u4", n_docs).astype(np.int64)
    states, places, words = taken("<u8", n_states * rans.LANES).reshape(n_states, rans.LANES), taken("<u4", n_states), taken("<u4", n_words)
    segment = rans.LANES * rans.EVERY
    lo, hi = max(0, low // segment), min(n_states, -(-min(high, n) // segment))
    ids, skipped = rans.decode(n, table, states, places, words, first=lo, last=hi), lo * segment
    for k, (doc, is_null, start) in enumerate(zip(docs.tolist(), null.tolist(), froms.tolist())):
        stop = int(froms[k + 1]) if k + 1 < n_docs else n
        i, j = max(start, skipped), min(stop, skipped + len(ids))
        if i < j:
            yield None if is_null else doc, doc_start if k == 0 else first + start, first + i, ids[i - skipped : j - skipped]


def _dealt(blocks: DataFrame) -> DataFrame:
    """Blocks over all cores, those of a file together where they can be, as they share its table; the manifest itself is a small table."""
    spark = blocks.sparkSession
    base.python_ready(spark)
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return blocks.repartitionByRange(n, "file", "offset")


def crc_joined(left: int, right: int, size: int) -> int:
    """CRC-32 of a text from those of its two parts, the right one of size bytes: left is shifted by x^(8 * size) modulo the polynomial."""

    def times(a: int, b: int) -> int:
        out, bit = 0, 1 << 31
        while bit:
            if a & bit:
                out ^= b
            b = (b >> 1) ^ (0xEDB88320 if b & 1 else 0)
            bit >>= 1
        return out

    shift, power, n = 1 << 31, 1 << 30, 8 * size
    while n:
        if n & 1:
            shift = times(shift, power)
        power, n = times(power, power), n >> 1
    return times(left, shift) ^ right


def _whole_crc(run) -> int:
    crc = int(run[0]["crc"])
    for x in run[1:]:
        crc = crc_joined(crc, int(x["crc"]), 4 * int(x["n"]))
    return crc


def documents(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the decoded files."""
    folder = f"{root}/files"
    kinds = [("doc", pa.int64()), ("base", pa.int64()), ("doc_start", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("crc", pa.int64())]

    def run(batches):
        for batch in batches:
            for at, file, offset, length in zip(*(batch.column(i).to_pylist() for i in range(4))):
                rows = [(doc, at, doc_start, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for doc, doc_start, start, ids in _read(folder, file, offset, length)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), kinds)], schema=pa.schema(kinds))

    @F.pandas_udf("long")
    def crc(runs: pd.Series) -> pd.Series:
        from tidewire.llm import token_files

        return pd.Series([token_files._whole_crc(r) for r in runs], dtype="int64")

    decoded = _dealt(manifest(spark, root).select("base", "file", "offset", "length")).mapInArrow(run, "doc long, base long, doc_start long, at long, n long, crc long")
    # A long document is in several blocks.
    whole = decoded.groupBy((F.col("base") + F.col("doc_start")).alias("start")).agg(F.max("doc").alias("doc_id"), F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("at", "n", "crc"))).alias("runs"))
    return whole.select("doc_id", "start", "n_tokens", crc("runs").alias("ids_crc32"))


def parts(spark: SparkSession, root: str, blocks: Column | None = None) -> DataFrame:
    """doc_id, start (of the document), at (ids before the part) and ids of each run of a document in a block; blocks: a condition on the manifest."""
    return _parts(manifest(spark, root) if blocks is None else manifest(spark, root).filter(blocks), root, 0, 1 << 62)


def _parts(blocks: DataFrame, root: str, low: int, high: int) -> DataFrame:
    folder = f"{root}/files"

    def run(batches):
        for batch in batches:
            for at, start, file, offset, length in zip(*(batch.column(i).to_pylist() for i in range(5))):
                rows = [(doc, at + doc_start, at + first, ids) for doc, doc_start, first, ids in _read(folder, file, offset, length, low - start, high - start)]
                yield pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in rows], pa.int64()) for i in range(3)), pa.array([r[3] for r in rows], pa.list_(pa.uint32())).cast(pa.list_(pa.int64()))], ["doc_id", "start", "at", "ids"])

    return _dealt(blocks.select("base", "start", "file", "offset", "length")).mapInArrow(run, "doc_id long, start long, at long, ids array<long>")


def ids_between(spark: SparkSession, root: str, low: int, high: int) -> DataFrame:
    """doc_id, start, at and ids of places low to high (not included) of the whole sequence; of the blocks that hold them, only the segments needed are decoded."""
    found = _parts(manifest(spark, root).filter((F.col("start") < high) & (F.col("start") + F.col("n_ids") > low)), root, low, high)
    skip = F.greatest(F.lit(low) - F.col("at"), F.lit(0)).cast("int")
    keep = (F.least(F.lit(high), F.col("at") + F.size("ids")) - F.col("at")).cast("int") - skip
    return found.filter((F.col("at") < high) & (F.col("at") + F.size("ids") > low)).select("doc_id", "start", (F.col("at") + skip).alias("at"), F.slice("ids", skip + 1, keep).alias("ids"))
