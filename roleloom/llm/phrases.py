"""Collocations by set-oriented mining: occurrence relations that are extended by a merge join.

R1 has a tuple (document, place, word) for every occurrence of a frequent word; places step by one
inside a piece and leave a gap between pieces, so that places that follow each other are neighbours
in a piece.  R(k+1) is the merge join of R(k) with itself on the document and adjacent places: a phrase of
k+1 words is two phrases of k words that overlap.  Each relation is kept sorted, as a row of packed
arrays for each document; its groups are counted by Spark; and its tuples are semi-joined with the
frequent groups before the next extension.  The semi-join probes a bitmap of fixed size, which loses no
frequent group; tuples that it lets through wrongly fall to the exact counts of the phrases themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window as W, functions as F

from ._text import _LOWER, _BYTE, Texts, mix, pieces, prefix, ranges, span_hash
from ._work import drop, release, table

#: Bits of the bitmap that stands for the frequent groups of one length: 16 MB, whatever their number.
FILTER_BITS = 27
#: Groups that a task combines before it hands them on.
HELD = 1 << 19
NO_LANG = "und"
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 32]] = 1
_KIND[[10, 11, 12, 13, *b".,;:!?"]] = 2

c = F.col


class Tokens:
    """Words of a piece of texts: bytes, places and a hash of each, without the document's language."""

    def __init__(self, texts: Texts):
        self.data = _LOWER[texts.data]
        kind, n = _KIND[self.data], len(self.data)
        inside = kind == 0
        edge = np.zeros(n + 1, bool)
        edge[texts.begin] = True
        edge[n] = True
        before = np.append(False, inside[:-1]) if n else inside
        self.start = np.flatnonzero(inside & (~before | edge[:n]))
        self.end = np.flatnonzero(inside & (~np.append(inside[1:], False) | edge[1:])) + 1 if n else self.start
        first = np.searchsorted(self.start, texts.begin)
        self.count = np.searchsorted(self.start, texts.end) - first
        self.doc = np.repeat(np.arange(len(self.count)), self.count)
        # A place for each word, and one left out wherever a new piece or document begins.
        breaks = np.append(0, np.cumsum(kind == 2))
        new = np.zeros(len(self.start), np.int64)
        if len(new):
            new[1:] = (breaks[self.start[1:]] > breaks[self.start[:-1]]) | (self.doc[1:] != self.doc[:-1])
        self.place = np.arange(len(new)) + np.cumsum(new)
        self.key = span_hash(prefix(_BYTE[self.data]), self.start, self.end)

    def phrases(self, at: np.ndarray, k: int) -> pa.Array:
        """The ``k`` words from each word number of ``at``, with a space between them."""
        size = self.end - self.start
        word = (at[:, None] + np.arange(k)).ravel()
        length = size[word] + 1
        source = ranges(self.start[word], length)
        ends = np.cumsum(length)
        source[ends - 1] = 0
        raw = self.data[source]
        raw[ends - 1] = 32
        stop = ends[k - 1::k] - 1
        begin = np.append(0, ends[k - 1::k])[:-1]
        keep = np.ones(len(raw), bool)
        keep[stop] = False
        offsets = np.append(0, np.cumsum(stop - begin)).astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw[keep].tobytes()))


def _lang_key(names: list[str | None]) -> np.ndarray:
    known = {n: int.from_bytes(hashlib.blake2b((n if n is not None else NO_LANG).encode(), digest_size=8).digest(), "little") for n in set(names)}
    return np.array([known[n] for n in names], np.uint64)


def _extended(place: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge join of a sorted relation with itself on adjacent places: (index of the first tuple, key of the longer phrase)."""
    at = np.flatnonzero(np.diff(place) == 1)
    return at, mix(key[at] * np.uint64(0x9E3779B97F4A7C15) + mix(key[at + 1], 0x5851F42D4C957F2D), 0x14057B7EF767814F)


class _Counter:
    """Counts of groups, combined in the task as long as it holds at most HELD of them."""

    def __init__(self):
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray) -> bool:
        """Whether the counts have to be handed on."""
        keys, counts = np.unique(keys, return_counts=True)
        if len(self.keys):
            keys, counts = np.append(self.keys, keys), np.append(self.counts, counts)
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            keys, counts = keys[at], np.add.reduceat(counts, at)
        self.keys, self.counts = keys, counts
        return len(keys) > HELD

    def batch(self) -> pa.RecordBatch:
        """A number for each group: 48 bits of its key, and its count in 16; a larger count takes several rows."""
        full, rest = np.divmod(self.counts, 0xFFFF)
        again = np.repeat(self.keys, full)
        value = np.append(self.keys << np.uint64(16) | rest.astype(np.uint64), again << np.uint64(16) | np.uint64(0xFFFF))
        self.__init__()
        return pa.RecordBatch.from_arrays([pa.array(value.view(np.int64))], names=["packed"])


def _word_counts(documents: DataFrame) -> DataFrame:
    """(lang, word, key, n): how often each task met each word."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("key", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in pieces(batches):
            t = Tokens(texts)
            names = texts.batch.column("lang").to_pylist()
            key = mix(t.key + _lang_key(names)[t.doc])
            k, at, n = np.unique(key, return_index=True, return_counts=True)
            lang = pa.array(names, pa.string()).take(pa.array(t.doc[at]))
            for a in range(0, len(k), 1 << 16):
                part = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays([lang[part].fill_null(NO_LANG), t.phrases(at[part], 1).cast(pa.string()), pa.array(k[part].view(np.int64)), pa.array(n[part])], schema=schema)

    return documents.select("lang", "text").mapInArrow(run, "lang string, word string, key long, n long")


def _bitmap(keys: DataFrame, size: int) -> Broadcast:
    """A bit for the low bits of every key, sent to all executors: 2^size bits, however many keys there are."""
    words = (keys.selectExpr(f"key & {(1 << size) - 1}L AS low").selectExpr("cast(shiftright(low, 6) AS int) AS w", "shiftleft(1L, cast(low & 63L AS int)) AS b")
             .groupBy("w").agg(F.bit_or("b").alias("b")))
    got = words.toArrow()
    bits = np.zeros(1 << size - 6, np.int64)
    bits[got.column("w").to_numpy()] = got.column("b").to_numpy()
    return keys.sparkSession.sparkContext.broadcast(bits)


def _probe(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    low = key & np.uint64(len(bits) * 64 - 1)
    return (bits[(low >> np.uint64(6)).astype(np.int64)].view(np.uint64) >> (low & np.uint64(63))) & np.uint64(1) != 0


#: Places are kept as steps of a byte from tuple to tuple: 1 to a neighbour, 2 over any gap.
_RELATION = pa.schema([("step", pa.binary()), ("key", pa.binary())])


def _first_relation(documents: DataFrame, frequent: Broadcast) -> DataFrame:
    """R1 as a row for each document: places and keys of the frequent words, in ascending order of places."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in pieces(batches):
            t = Tokens(texts)
            key = mix(t.key + _lang_key(texts.batch.column("lang").to_pylist())[t.doc])
            yield _packed(t.place, key, _probe(frequent.value, key), np.append(0, np.cumsum(t.count)))

    return documents.select("lang", "text").mapInArrow(run, "step binary, key binary")


def _packed(place: np.ndarray, key: np.ndarray, kept: np.ndarray, borders: np.ndarray) -> pa.RecordBatch:
    """Tuples that are kept, a row for each document; ``borders`` are where documents begin and end among the tuples."""
    ends = np.append(0, np.cumsum(kept))[borders]
    step = np.minimum(np.diff(place[kept], prepend=0), 2).astype(np.uint8)
    key = key[kept].astype("<u8")
    step[ends[:-1][ends[:-1] < len(step)]] = 2
    cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())
    return pa.RecordBatch.from_arrays([cut(step), cut(key)], schema=_RELATION)


def _flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of packed arrays, and where each row's begin."""
    size = np.dtype(kind).itemsize
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw.view(kind), (offsets - offsets[0]) // size


def _tuples(batch: pa.RecordBatch, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place, key, borders) of some documents at a time; places leave a gap between documents."""
    steps, borders = _flat(batch.column("step"), "u1")
    keys, _ = _flat(batch.column("key"), "<u8")
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(borders, borders[at] + most, "right")) - 1)
        part = slice(borders[at], borders[to])
        yield np.cumsum(steps[part], dtype=np.int64), keys[part], borders[at:to + 1] - borders[at]
        at = to


def _group_counts(relation: DataFrame, least: int) -> DataFrame:
    """(key, n) of the groups of the next length with at least ``least`` tuples; groups are told apart by 48 bits here."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter()
        for batch in batches:
            for place, key, _ in _tuples(batch):
                if counter.add(_extended(place, key)[1]):
                    yield counter.batch()
        if len(counter.keys):
            yield counter.batch()

    # Tasks have combined their rows already: dealt by key first, they are not combined a second time before the shuffle.
    parts = int(relation.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = relation.mapInArrow(run, "packed long").repartition(parts, F.expr("shiftrightunsigned(packed, 16)"))
    return counts.selectExpr("shiftrightunsigned(packed, 16) AS key", "packed & 65535L AS n").groupBy("key").agg(F.sum("n").alias("n")).where(c("n") >= least)


def _next_relation(relation: DataFrame, frequent: Broadcast) -> DataFrame:
    """The relation of the next length: merge join, then semi-join with its frequent groups."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, key, borders in _tuples(batch):
                at, longer = _extended(place, key)
                yield _packed(place[at], longer, _probe(frequent.value, longer), np.searchsorted(at, borders))

    return relation.mapInArrow(run, "step binary, key binary")


def _phrase_counts(documents: DataFrame, filters: list[Broadcast]) -> DataFrame:
    """(lang, phrase, k, n): how often each task met each phrase whose group, and those of all its parts, may be frequent."""
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("k", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in pieces(batches):
            t = Tokens(texts)
            names = texts.batch.column("lang").to_pylist()
            langs = pa.array(names, pa.string())
            key = mix(t.key + _lang_key(names)[t.doc])
            word = np.flatnonzero(_probe(filters[0].value, key))
            place, key = t.place[word], key[word]
            for k, f in enumerate(filters[1:], 2):
                at, key = _extended(place, key)
                passed = _probe(f.value, key)
                word, place, key = word[at][passed], place[at][passed], key[passed]
                _, first, n = np.unique(key, return_index=True, return_counts=True)
                for a in range(0, len(n), 1 << 16):
                    chosen = word[first[a:a + (1 << 16)]]
                    lang = langs.take(pa.array(t.doc[chosen])).fill_null(NO_LANG)
                    yield pa.RecordBatch.from_arrays([lang, t.phrases(chosen, k).cast(pa.string()), pa.array(np.full(len(chosen), k, np.int32)), pa.array(n[a:a + (1 << 16)])], schema=schema)

    return documents.select("lang", "text").mapInArrow(run, "lang string, phrase string, k int, n long")


def frequent_phrases(documents: DataFrame, longest: int, least: int, filter_bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, k, f) of all phrases of up to ``longest`` words that occur ``least`` times in their language, (lang, n) with the number of all words).

    Counts are exact: phrases are grouped by their text.  In one task's piece of text they are told apart by 64 bits of hash.
    """
    words = table(_word_counts(documents).groupBy("lang", "word").agg(F.min("key").alias("key"), F.sum("n").alias("f")))
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    singles = words.where(c("f") >= least)
    filters = [_bitmap(singles.select("key"), filter_bits)]
    relation = table(_first_relation(documents, filters[0]))
    for k in range(2, longest + 1):
        groups = table(_group_counts(relation, least))
        filters.append(_bitmap(groups, filter_bits))
        drop(groups)
        if k < longest:
            longer = table(_next_relation(relation, filters[-1]))
            drop(relation)
            relation = longer
    drop(relation)
    counted = _phrase_counts(documents, filters).groupBy("lang", "phrase", "k").agg(F.sum("n").alias("f")).where(c("f") >= least)
    every = table(counted.unionByName(singles.select("lang", c("word").alias("phrase"), F.lit(1).alias("k"), "f")))
    release(documents.sparkSession)
    return every, table(totals)


def collocations(documents: DataFrame, longest: int = 3, least: int = 10, covered_percent: int = 50, best: int = 2000, filter_bits: int = FILTER_BITS) -> DataFrame:
    """Each language's ``best`` phrases by score: lang, rank, phrase, a, l, r, n, score.

    A text is cut into pieces at ``. , ; : ! ?`` and line ends, and these into words at spaces and tabs, A-Z in lower case.  A candidate has 2 to ``longest`` words
    and occurs a >= ``least`` times in its language (null: und), overlaps included.  Cut behind its first words it has the counts l and r of its parts and
    the score floor(1000000 a a / (l r)); the lowest counts, of equal ones the first.  A candidate inside a longer one that occurs at least ``covered_percent`` percent
    as often is left out.  Ties go to the larger a, then to the phrase's bytes.  Null and empty texts have no words, repeated rows count each time, an empty
    table gives no rows, other columns are ignored.  ``filter_bits`` sizes the bitmaps; it changes how much is counted in vain, not the rows.
    """
    every, totals = frequent_phrases(documents, longest, least, filter_bits)
    part = every.select("lang", "phrase", "f")
    big = lambda x: x.cast("decimal(19,0)")
    candidates = every.where("k > 1").select("lang", "phrase", "k", c("f").alias("a"), F.split("phrase", " ").alias("w"))
    words = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    cuts = (candidates.select("lang", "phrase", "k", "a", "w", F.explode(F.sequence(F.lit(1), c("k") - 1)).alias("cut"))
            .select("lang", "phrase", "k", "a", "cut", words(F.lit(1), c("cut")).alias("first"), words(c("cut") + 1, c("k") - c("cut")).alias("rest")))
    scored = (cuts.join(part.select("lang", c("phrase").alias("first"), c("f").alias("l")), ["lang", "first"]).join(part.select("lang", c("phrase").alias("rest"), c("f").alias("r")), ["lang", "rest"])
              .withColumn("top", (big(c("a")) * big(c("a"))).cast("decimal(32,0)") * F.lit(1_000_000).cast("decimal(7,0)")).withColumn("bottom", big(c("l")) * big(c("r")))
              .withColumn("score", F.expr("cast(top AS decimal(38,0)) div cast(bottom AS decimal(38,0))")))
    lowest = scored.groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("m")).select("lang", "phrase", "k", "a", "m.l", "m.r", "m.score")
    inside = candidates.where("k > 2").select("lang", "a", "k", "w", F.explode(F.sequence(F.lit(2), c("k") - 1)).alias("j"))
    inside = inside.select("lang", "a", "w", "j", F.explode(F.sequence(F.lit(1), c("k") - c("j") + 1)).alias("s")).select("lang", words(c("s"), c("j")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("m"))
    kept = lowest.join(inside, ["lang", "phrase"], "left").where(c("m").isNull() | (100 * c("m") < covered_percent * c("a")))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(c("score").desc(), c("a").desc(), "phrase"))
    top = kept.withColumn("rank", rank).where(c("rank") <= best)
    return top.join(totals, "lang").select("lang", c("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
