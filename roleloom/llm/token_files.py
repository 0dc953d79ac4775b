"""Token ids in binary files whose document boundaries are Elias-Fano coded.

All documents, in ascending doc_id order, are one long id array that is cut, at documents, into
files of about FILE_IDS ids.  A file holds, little-endian, one after the other:

    magic 8 bytes; documents u64; ids u64; documents without doc_id u64; id width u8; low bits u8; 6 bytes of zero
    doc_ids     i64 for each document, those without one first (as 0)
    low         of the end of each document its lowest bits, packed
    high        of each end the rest in unary: bit (end >> low bits) + i is set for document i
    samples     u32 for every 64th set bit of high, its position: where a select begins to look
    ids         u16 or u32 each
    checksum    u32, crc32 of all before it
    end         one line feed

An end takes about 2 + log2(ids / documents) bits.  Files are written by Spark's own text writer, a file
for each row, so they can go to any store and a lost task leaves nothing behind; they are read as binary files.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ._text import _LOWER, flat, ranges
from ._work import release, shared_folder, table

MAGIC = b"RLTOKEN1"
HEADER = 40
SAMPLE = 64
#: A file is closed once it has this many ids; one document is never cut.
FILE_IDS = 4 << 20
#: Text that is encoded at once, units that a worker remembers between batches, and texts that the library is given at once.
BATCH_BYTES = 4 << 20
REMEMBERED = 1 << 19
GIVEN = 1 << 13

c = F.col


# --- ids ---------------------------------------------------------------------------------------------

#: Kinds of bytes: white space, letters (a-z, and in UTF-8 the letters of Latin-1), digits, other ASCII, the apostrophe, all else.
_SPACE, _LETTER, _DIGIT, _MARK, _APOSTROPHE, _ELSE = range(6)
_KIND = np.full(256, _ELSE, np.uint8)
_KIND[:128] = _MARK
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[97:123] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[39] = _APOSTROPHE
#: Neighbours that the vocabulary's pattern always parts.  An apostrophe stays with what follows; where anything else is near, nothing is cut.
_CUT = np.zeros((6, 6), bool)
for _a, _b in ((_LETTER, _DIGIT), (_LETTER, _MARK), (_LETTER, _APOSTROPHE), (_DIGIT, _LETTER), (_DIGIT, _DIGIT), (_DIGIT, _MARK), (_DIGIT, _APOSTROPHE), (_MARK, _LETTER), (_MARK, _DIGIT)):
    _CUT[_a, _b] = True
_CUT_OF = np.append(_CUT.ravel(), np.zeros(256 - _CUT.size, bool)).tobytes()


def _looked_up(codes: np.ndarray, table: bytes) -> np.ndarray:
    """The byte of ``table`` for each code; unlike indexing, this makes no index of eight bytes for each."""
    return np.frombuffer(bytearray(codes.tobytes().translate(table)), np.uint8)


def units(data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(where units begin, the units): stretches of lower-cased text that are encoded on their own.  ``begin`` has the texts' first bytes."""
    kind = _looked_up(data, _KIND.tobytes())
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = _LETTER
    inside = kind != _SPACE
    new = inside.copy()
    if len(new):
        new[1:] &= ~inside[:-1] | _looked_up(kind[:-1] * np.uint8(len(_CUT)) + kind[1:], _CUT_OF).view(bool)
        first = begin[begin < len(new)]
        new[first] = inside[first]
    start = np.flatnonzero(new)
    offsets = np.zeros(len(start) + 1, np.int64)
    if len(start):
        np.cumsum(np.add.reduceat(inside, start, dtype=np.int64), out=offsets[1:])
    return start, pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(data[inside]))


class Encoder:
    """The tokenizers library on the distinct units of a batch; ids of units are remembered between batches.

    White space separates pieces of this kind of vocabulary and is dropped, case does not matter, and its pattern parts letters, single digits
    and other signs, so a text's ids are those of its units.  Texts that may hold a special token's string go to the library whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.marks = sorted({t.content[:2] for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.start, self.count = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, count = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at in range(0, len(texts), GIVEN):  # what the library returns for a text takes far more than its ids
            made = [e.ids for e in self.tokenizer.encode_batch_fast(texts[at:at + GIVEN], add_special_tokens=False)]
            count.append(np.fromiter(map(len, made), np.int64, len(made)))
            ids.append(np.fromiter((i for m in made for i in m), np.uint32, int(count[-1].sum())))
        return np.concatenate(ids), np.concatenate(count)

    def _learn(self, found: list[str]) -> np.ndarray:
        """Number of each unit; new ones are encoded."""
        new = [w for w in found if w not in self.known]
        if new:
            ids, count = self._ids(new)
            self.start = np.append(self.start, len(self.ids) + np.cumsum(count) - count)
            self.ids, self.count = np.append(self.ids, ids), np.append(self.count, count)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        return np.fromiter(map(self.known.__getitem__, found), np.int64, len(found))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has)."""
        if len(self.known) > REMEMBERED:
            self.forget()
        whole = np.zeros(len(texts), bool)
        for mark in self.marks:
            whole |= pc.match_substring(texts, mark).fill_null(False).to_numpy(zero_copy_only=False)
        data, offsets = flat(pc.if_else(pa.array(whole), "", texts) if whole.any() else texts)
        data, offsets = _looked_up(data[offsets[0]:offsets[-1]], _LOWER.tobytes()), offsets - offsets[0]
        start, found = units(data, offsets[:-1])
        coded = found.dictionary_encode()
        unit = self._learn(coded.dictionary.to_pylist())[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
        size = self.count[unit]
        ids = self.ids[ranges(self.start[unit], size)]
        count = np.diff(np.append(0, np.cumsum(size))[np.searchsorted(start, offsets)])
        if whole.any():
            at = np.flatnonzero(whole)
            more, n = self._ids(texts.take(pa.array(at)).to_pylist())
            place = np.append(0, np.cumsum(count))[at]
            ids = np.insert(ids, np.repeat(place, n), more)
            count[at] = n
        return ids, count


_MADE: dict[str, Encoder] = {}


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    _, offsets = flat(batch.column("text"))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BATCH_BYTES, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def _encoder(path: str) -> Encoder:
    if path not in _MADE:
        _MADE[path] = Encoder(path)
    return _MADE[path]


def _coded(batches: Iterable[pa.RecordBatch], made: Encoder, end_id: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(doc_ids, how many ids each has, ids) of some documents at a time; ``end_id`` is behind each."""
    for batch in batches:
        for part in _slices(batch):
            ids, n = made.encode(part.column("text"))
            yield part.column("doc_id").cast(pa.int64()), n + 1, np.insert(ids, np.cumsum(n), end_id).astype(f"<u{made.width}")


# --- files -------------------------------------------------------------------------------------------

def _pack(values: np.ndarray, bits: int) -> bytes:
    """``bits`` lowest bits of each value, lowest bit first."""
    if not bits:
        return b""
    return np.packbits((values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1), bitorder="little").tobytes()


@dataclass
class Boundaries:
    """Ends of the documents of a file, read in place."""

    n: int
    bits: int
    low: np.ndarray
    high: np.ndarray
    samples: np.ndarray

    @staticmethod
    def write(ends: np.ndarray) -> tuple[int, bytes]:
        """(low bits, coded ends)."""
        n, top = len(ends), int(ends[-1])
        bits = max(0, (top // n).bit_length() - 1)
        ends = ends.astype(np.uint64)
        at = (ends >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(Boundaries.high_bytes(n, top, bits) * 8, np.uint8)
        high[at] = 1
        return bits, _pack(ends, bits) + np.packbits(high, bitorder="little").tobytes() + at[::SAMPLE].astype("<u4").tobytes()

    @staticmethod
    def high_bytes(n: int, top: int, bits: int) -> int:
        return (n + (top >> bits) + 1 + 7) // 8

    @classmethod
    def read(cls, data: np.ndarray, n: int, top: int, bits: int) -> tuple[Boundaries, int]:
        """The structures at the begin of ``data``, and the bytes that they take."""
        a = (n * bits + 7) // 8
        b = a + cls.high_bytes(n, top, bits)
        e = b + 4 * -(-n // SAMPLE)
        return cls(n, bits, data[:a], data[a:b], data[b:e].view("<u4")), e

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.int64)
        at = i[:, None] * self.bits + np.arange(self.bits)
        return (((self.low[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(np.int64) << np.arange(self.bits)).sum(1)

    def end(self, i: int) -> int:
        """Where document ``i`` ends: its set bit is looked for from the nearest sample before it."""
        at = int(self.samples[i // SAMPLE])
        left, byte = i % SAMPLE, at >> 3
        word = int(self.high[byte]) >> (at & 7) << (at & 7)
        while left >= word.bit_count():
            left -= word.bit_count()
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        place = 8 * byte + (word & -word).bit_length() - 1
        return (place - i << self.bits) + int(self._lows(np.array([i]))[0])

    def ends(self) -> np.ndarray:
        """Where each document ends."""
        i = np.arange(self.n)
        at = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[:self.n]
        return (at - i << self.bits) + self._lows(i)

    def holding(self, position: int) -> int:
        """The document that the id at ``position`` is of."""
        a, b = 0, self.n - 1
        while a < b:
            m = (a + b) // 2
            a, b = (m + 1, b) if self.end(m) <= position else (a, m)
        return a


def image(doc_ids: list[int | None], counts: np.ndarray, ids: bytes, width: int) -> bytes:
    """A file without its last line feed."""
    ends = np.cumsum(counts)
    bits, coded = Boundaries.write(ends)
    known = np.array([i or 0 for i in doc_ids], "<i8")
    head = MAGIC + np.array([len(counts), ends[-1], sum(i is None for i in doc_ids)], "<u8").tobytes() + bytes([width, bits]) + bytes(6)
    parts = [head, known.tobytes(), coded, ids]
    check = 0
    for part in parts:
        check = zlib.crc32(part, check)
    return b"".join([*parts, check.to_bytes(4, "little")])


@dataclass
class File:
    """A file's parts, as views of its bytes."""

    doc_ids: np.ndarray
    without_id: int
    boundaries: Boundaries
    ids: np.ndarray

    @classmethod
    def read(cls, content: bytes) -> File:
        if content[:8] != MAGIC or content[-1:] != b"\n" or zlib.crc32(memoryview(content)[:-5]) != int.from_bytes(content[-5:-1], "little"):
            raise ValueError("no whole token file")
        n, total, nulls = np.frombuffer(content, "<u8", 3, 8).tolist()
        width, bits = content[32], content[33]
        data = np.frombuffer(content, np.uint8)
        boundaries, size = Boundaries.read(data[HEADER + 8 * n:], n, total, bits)
        return cls(np.frombuffer(content, "<i8", n, HEADER), nulls, boundaries, np.frombuffer(content, f"<u{width}", total, HEADER + 8 * n + size))


def _images(path: str, end_id: int, most: int):
    """Files of documents that come in order."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _encoder(path)
        doc_ids, counts, ids, total = [], [], [], 0

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"image": [image(pa.concat_arrays(doc_ids).to_pylist(), np.concatenate(counts), np.concatenate(ids).tobytes(), made.width)]})
        for names, n, x in _coded(batches, made, end_id):
            at, ends = 0, np.append(0, np.cumsum(n))
            while at < len(n):  # up to the document that fills the file
                to = min(int(np.searchsorted(ends, ends[at] + most - total)), len(n))
                doc_ids.append(names.slice(at, to - at))
                counts.append(n[at:to])
                ids.append(x[ends[at]:ends[to]])
                total += int(ends[to] - ends[at])
                at = to
                if total >= most:
                    yield closed()
                    doc_ids, counts, ids, total = [], [], [], 0
        if total:
            yield closed()
    return run


def write(documents: DataFrame, path: str, end_id: int, folder: str | None = None, file_ids: int = FILE_IDS) -> str:
    """Encode every text and write the files; returns their folder, a new one in the shared folder unless ``folder`` names one.

    Documents are in ascending order of doc_id, those without one first; rows with one doc_id by their text's length, then its hash.  A
    null or empty text is its end id alone; equal rows are a document each.  An empty table leaves an empty folder; other columns are ignored.
    The numbers in the files' names ascend in the order of the documents.  Documents are dealt by ranges of that order, once; each task encodes its range as it
    writes it.
    """
    spark = documents.sparkSession
    folder = folder or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    by = [c("doc_id").asc_nulls_first(), c("size").asc_nulls_first(), c("h"), c("u")]
    keyed = documents.select("doc_id", "text", F.octet_length("text").alias("size"), F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("u"))
    ordered = keyed.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by).select("doc_id", "text")
    made = ordered.mapInArrow(_images(path, end_id, file_ids), "image binary")
    made.select(c("image").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("lineSep", "\n").text(folder)
    release(spark)
    return folder


def files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)


def _numbered(contents: DataFrame) -> DataFrame:
    schema = pa.schema([("file", pa.string()), ("doc_id", pa.int64()), ("offset", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                f = File.read(content.as_py())
                ends = f.boundaries.ends()
                starts = np.append(0, ends[:-1])
                for a in range(0, len(ends), 4096):
                    b = min(a + 4096, len(ends))
                    raw = f.ids[starts[a]:ends[b - 1]].astype("<u4").tobytes()
                    at = 4 * (ends[a:b] - starts[a])
                    doc_ids = pa.array(f.doc_ids[a:b], mask=np.arange(a, b) < f.without_id)
                    cut = [raw[x:y] for x, y in zip([0, *at[:-1].tolist()], at.tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array([name.rsplit("/", 1)[-1]] * (b - a)), doc_ids, pa.array(starts[a:b]), pa.array(ends[a:b] - starts[a:b]), pa.array(cut, pa.binary())], schema=schema)

    return contents.select("path", "content").mapInArrow(run, "file string, doc_id long, offset long, n_tokens long, ids binary")


#: Of a file's name, as Spark makes it, the task and the file of the task; the middle is random and may hold a "-c" with digits too.
TASK, FILE_OF_TASK = r"^part-(\d+)", r"-c(\d+)\.[^-]*$"


def catalog(spark: SparkSession, folder: str) -> DataFrame:
    """One row per file: its name, its documents, its ids, and the ids of all files before it.  Only headers are looked at.

    Files of one task follow each other and so do the tasks; sums go over tasks first, so no task sees more rows than there were tasks or files of one.
    """
    schema = "file string, documents long, ids long"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                n, total = np.frombuffer(content.as_buffer(), "<u8", 2, 8).tolist()
                yield pa.RecordBatch.from_arrays([pa.array([name.rsplit("/", 1)[-1]]), pa.array([n]), pa.array([total])], names=["file", "documents", "ids"])

    numbers = {"task": F.regexp_extract("file", TASK, 1).cast("long"), "k": F.regexp_extract("file", FILE_OF_TASK, 1).cast("long")}
    rows = table(files(spark, folder).select("path", "content").mapInArrow(run, schema)).withColumns(numbers)
    per_task = rows.groupBy("task").agg(F.sum("ids").alias("n")).select("task", (F.sum("n").over(W.orderBy("task")) - c("n")).alias("before"))
    inside = F.sum("ids").over(W.partitionBy("task").orderBy("k")) - c("ids")
    return rows.withColumn("inside", inside).join(per_task, "task").select("file", "documents", "ids", (c("before") + c("inside")).alias("start"))


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Every document of the files: doc_id, start (ids of all documents before it), n_tokens and ids as little-endian 32-bit integers."""
    found = _numbered(files(spark, folder))
    return found.join(catalog(spark, folder).select("file", c("start").alias("_base")), "file").select("doc_id", (c("_base") + c("offset")).alias("start"), "n_tokens", "ids")


def locate(spark: SparkSession, folder: str, positions: DataFrame) -> DataFrame:
    """For each ``position`` of the whole id array: doc_id, the document's start and end, and the id there.  Positions outside it, and nulls, give no row.

    Positions meet the files that share their block of FILE_IDS ids, and are answered inside a file by select, so only files that are asked for are read whole.
    """
    spans = catalog(spark, folder).select("file", "start", (c("start") + c("ids")).alias("stop"))
    spans = spans.withColumn("part", F.explode(F.sequence(F.floor(c("start") / FILE_IDS), F.floor((c("stop") - 1) / FILE_IDS))))
    asked = positions.select("position", F.floor(c("position") / FILE_IDS).alias("part")).distinct().join(spans, "part").where((c("position") >= c("start")) & (c("position") < c("stop")))
    per_file = asked.groupBy("file", "start").agg(F.collect_set(c("position") - c("start")).alias("at"))
    names = files(spark, folder).select("path", "content").withColumn("file", F.element_at(F.split("path", "/"), -1))
    schema = pa.schema([("position", pa.int64()), ("doc_id", pa.int64()), ("doc_start", pa.int64()), ("doc_end", pa.int64()), ("id", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for content, base, wanted in zip(batch.column("content"), batch.column("start").to_pylist(), batch.column("at").to_pylist()):
                f = File.read(content.as_py())
                for p in wanted:
                    k = f.boundaries.holding(p)
                    out.append((base + p, None if k < f.without_id else int(f.doc_ids[k]), base + (f.boundaries.end(k - 1) if k else 0), base + f.boundaries.end(k), int(f.ids[p])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, fld.type) for x, fld in zip(zip(*out), schema)], schema=schema)

    hits = names.join(per_file, "file").select("content", "start", "at").mapInArrow(run, "position long, doc_id long, doc_start long, doc_end long, id long")
    return positions.select("position").join(hits, "position")
