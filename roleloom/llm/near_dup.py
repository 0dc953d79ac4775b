"""Near-duplicate documents by SetSketch registers.

A document's shingles are hashed to exponentially spaced points; register i keeps the
smallest point that fell to it, on a logarithmic scale.  Every shingle draws its points in
growing order, truncated to one interval each, so it stops as soon as no register can
change.  Sketches of parts merge by taking the larger register values; equal registers
are as likely as two sets are similar, so bands of registers find candidates, the
likelihood of all registers together estimates the similarity, and pairs that may reach the
threshold are compared on their full sets.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._graph import components
from ._text import Words, mix, pieces, prefix, ranges, span_hash, words
from ._work import bucketed, drop, id_of, one_text, table

REGISTERS = 256
#: Base of the logarithmic scale.
SCALE = 1.001
#: Registers of a band and bands.  A pair of similarity 0.8 shares none of 44 bands of 5 once in 4e7.
BAND, BANDS = 5, 44
#: A pair is dropped unverified only if the likelihood estimate is this many standard errors below the threshold.
ERRORS = 5.0
#: Documents and shingles of a bucket that are compared in one block.
BLOCK, VOLUME = 2048, 1 << 20
#: Classes of equal sets that may hold a share of more than 1 / HOT of all documents, so there are no more than HOT of them; their rows are not shuffled by class.
HOT = 1000

c = F.col


def shingles(w: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of each shingle; a document with fewer words is one shingle, one without words has none."""
    n = np.where(w.count == 0, 0, np.maximum(w.count - width + 1, 1))
    start = ranges(w.first, n)
    doc = np.repeat(np.arange(len(n)), n)
    end = np.minimum(start + width, (w.first + w.count)[doc])
    return span_hash(prefix(w.hash), start, end), doc


def distinct(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], doc[new]


def sketch(h: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Registers (docs x REGISTERS, int32) of distinct shingles; a document without shingles keeps the lowest value."""
    m = REGISTERS
    low = np.full(docs * m, np.inf)
    edges = np.log1p(np.arange(m) / (m - np.arange(m)).astype(np.float64))  # the j-th point lies behind edge j
    edges = np.append(edges, np.inf)
    start, step = mix(h, 1), mix(h, 2) | np.uint64(1)
    active, highest = np.arange(len(h)), np.full(docs, np.inf)
    for j in range(m):
        bits = mix(h[active], 1000 + j)
        u = ((bits >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
        # An exponential point truncated to [edges[j], edges[j + 1]).
        span = -np.expm1(edges[j] - edges[j + 1])
        x = edges[j] - np.log1p(-u * span)
        register = ((start[active] + np.uint64(j) * step[active]) % np.uint64(m)).astype(np.int64)
        np.minimum.at(low, doc[active] * m + register, x)
        live = np.flatnonzero(np.bincount(doc[active], minlength=docs))
        highest[live] = low.reshape(docs, m)[live].max(axis=1)
        active = active[highest[doc[active]] > edges[j + 1]]
        if not len(active):
            break
    with np.errstate(divide="ignore"):
        return np.where(np.isinf(low), -(1 << 15), np.clip(np.floor(1 - np.log(low) / np.log(SCALE)), -(1 << 15) + 1, (1 << 15) - 1)).reshape(docs, m).astype(np.int32)


def likely(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Joint maximum-likelihood estimate of the similarity of sets of known sizes from registers that are equal, larger in a, or larger in b.

    With intersection x, a register of a exceeds b's if the smallest point lies in a alone: chances (n_a - x), (n_b - x) and x of the union.
    The likelihood is concave in x; Newton's steps with bounds find its maximum.
    """
    equal, more_a, more_b = (a == b).sum(1), (a > b).sum(1), (a < b).sum(1)
    n_a, n_b = n_a.astype(np.float64), n_b.astype(np.float64)
    lo, hi = np.zeros(len(n_a)), np.minimum(n_a, n_b)
    for _ in range(40):
        x = (lo + hi) / 2
        slope = equal / np.maximum(x, 1e-12) - more_a / np.maximum(n_a - x, 1e-12) - more_b / np.maximum(n_b - x, 1e-12) + REGISTERS / np.maximum(n_a + n_b - x, 1e-12)
        up = slope > 0
        lo, hi = np.where(up, x, lo), np.where(up, hi, x)
    x = (lo + hi) / 2
    return x / np.maximum(n_a + n_b - x, 1e-12)


def _sketches(documents: DataFrame, width: int) -> DataFrame:
    """(id, n, f1, f2, registers): size, 128-bit fingerprint and sketch of each document's shingle set."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in pieces(batches, most=2 << 20):
            h, doc = distinct(*shingles(words(t, lower=True), width))
            docs = t.batch.num_rows
            n = np.bincount(doc, minlength=docs)
            first = np.searchsorted(doc, np.arange(docs))
            f = []
            for salt in (11, 12):
                sums = np.append(np.zeros(1, np.uint64), np.cumsum(mix(h, salt), dtype=np.uint64))
                f.append((sums[first + n] - sums[first]).astype(np.int64))
            regs = sketch(h, doc, docs).astype("<i2")
            yield pa.RecordBatch.from_arrays([t.batch.column("id"), pa.array(n, pa.int64()), pa.array(f[0], pa.int64()), pa.array(f[1], pa.int64()), pa.array([r.tobytes() for r in regs], pa.binary())], names=["id", "n", "f1", "f2", "registers"])
    return documents.mapInArrow(run, "id long, n long, f1 long, f2 long, registers binary")


def _band_hashes(regs: np.ndarray) -> np.ndarray:
    """A hash of the register values of every band of every sketch."""
    r = regs.astype(np.int64).view(np.uint64)
    h = np.zeros((len(r), BANDS), np.uint64)
    for i in range(BAND):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + r[:, i:BANDS * BAND:BAND])
    return mix(h + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), 5)


def _registers(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i2").reshape(-1, REGISTERS)


def _bands(reps: DataFrame) -> DataFrame:
    """(band, id): the buckets of every sketch."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = _band_hashes(_registers(b.column("registers")))
            yield pa.RecordBatch.from_arrays([pa.array(h.ravel().astype(np.int64), pa.int64()), pa.array(np.repeat(b.column("id").to_numpy(), BANDS), pa.int64())], names=["band", "id"])
    return reps.select("id", "registers").mapInArrow(run, "band long, id long")


def _plausible(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and joint estimate leave the threshold possible."""
    t = percent / 100
    floor = t - ERRORS * np.sqrt(t * (1 - t) / REGISTERS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ra, rb = (_registers(b.column(k)) for k in ("ra", "rb"))
            ok = likely(ra, rb, b.column("na").to_numpy(), b.column("nb").to_numpy()) >= floor
            yield b.filter(pa.array(ok)).select(["a", "b"])

    side = lambda x: reps.select(c("id").alias(x), c("n").alias(f"n{x}"), c("registers").alias(f"r{x}"))
    joined = pairs.join(side("b"), "b").join(side("a"), "a").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return joined.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, "a long, b long")


def _sets(documents: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, s): the distinct shingles of the documents named by ``ids``, as 64-bit hashes."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in pieces(batches):
            h, doc = distinct(*shingles(words(t, lower=True), width))
            offsets = np.append(0, np.cumsum(np.bincount(doc, minlength=t.batch.num_rows))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([t.batch.column("id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(h.astype(np.int64), pa.int64()))], names=["id", "s"])
    return documents.join(ids, "id").mapInArrow(run, "id long, s array<long>")


def _verified(pairs: DataFrame, documents: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union of the full shingle sets (64-bit hashes of them)."""
    sets = table(_sets(documents, table(pairs.select(c("a").alias("id")).unionByName(pairs.select(c("b").alias("id"))).distinct()), width))
    inter = F.size(F.array_intersect("sa", "sb"))
    both = pairs.join(sets.select(c("id").alias("b"), c("s").alias("sb")), "b").join(sets.select(c("id").alias("a"), c("s").alias("sa")), "a")
    out = table(both.where(100 * inter >= percent * (F.size("sa") + F.size("sb") - inter)).select("a", "b"))
    drop(sets)
    return out


def _across(buckets: DataFrame, labels: DataFrame, sketches: DataFrame, documents: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): components that a linked pair of one bucket joins; the bucket's documents but its leader in blocks, block against block.

    Pairs with a bucket's leader have been compared before, so buckets of two documents end here.  A pair is looked at in the first bucket that it shares.  What the
    likelihood leaves possible is compared on the full sets (64-bit hashes) where the documents meet.  A block keeps the components that it has joined, compares
    their documents no more, and returns a spanning forest: fewer rows than it has components, however many pairs are linked.
    """
    placed = table(buckets.where(c("id") != c("a")).select("band", "id").join(labels, "id").join(sketches.select("id", "n"), "id"))
    mixed = (placed.groupBy("band").agg(F.count("*").alias("rows"), F.sum("n").alias("volume"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
             .select("band", F.ceil(F.greatest(c("rows") / BLOCK, c("volume") / VOLUME)).alias("blocks")))
    rows = table(placed.join(mixed, "band").withColumn("block", F.pmod(F.xxhash64("id"), c("blocks"))))
    drop(placed)
    sets = table(_sets(documents, table(rows.select("id").distinct()), width))
    other = F.explode(F.sequence(F.lit(0).cast("long"), c("blocks") - 1)).alias("other")
    sides = rows.select("band", "id", "component", "block", "n", other).select("band", "id", "component", "block", "n", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    full = sides.join(sketches.select("id", "registers").join(sets, "id"), "id")
    t = percent / 100
    floor = t - ERRORS * np.sqrt(t * (1 - t) / REGISTERS)

    def run(block: pa.Table) -> pa.Table:
        ids, comp, n, own = (block.column(k).to_numpy() for k in ("id", "component", "n", "block"))
        regs = _registers(block.column("registers"))
        hashes = _band_hashes(regs)
        band = int(np.flatnonzero(hashes[0] == np.int64(block.column("band")[0].as_py()).astype(np.uint64))[0])
        earlier = hashes[:, :band].astype(np.uint32)
        x, y = block.column("x")[0].as_py(), block.column("y")[0].as_py()
        left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
        s = block.column("s").combine_chunks()
        size = s.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        known, number = np.unique(s.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
        begin, mark = np.append(0, np.cumsum(size)[:-1]), np.zeros(len(known), np.int64)
        node, code = np.unique(comp, return_inverse=True)
        joined = np.arange(len(node))  # the component that each one belongs to by now
        a_all, b_all = [], []
        for i in left:
            j = right[(joined[code[right]] != joined[code[i]]) & (100 * np.minimum(n[right], n[i]) >= percent * np.maximum(n[right], n[i]))]
            j = j[ids[j] > ids[i]] if x == y else j
            j = j[~(earlier[j] == earlier[i]).any(axis=1)] if band and len(j) else j
            j = j[(regs[j] == regs[i]).sum(axis=1) >= 0.5 * floor * REGISTERS] if len(j) else j
            if len(j):
                j = j[likely(np.broadcast_to(regs[i], (len(j), REGISTERS)), regs[j], np.full(len(j), n[i]), n[j]) >= floor]
            if len(j):
                own_part = number[begin[i]:begin[i] + size[i]]
                mark[own_part] = 1
                shared = np.add.reduceat(mark[number[ranges(begin[j], size[j])]], np.append(0, np.cumsum(size[j])[:-1]))
                mark[own_part] = 0
                for k in np.unique(code[j[100 * shared >= percent * (n[i] + n[j] - shared)]]):
                    if joined[k] != joined[code[i]]:
                        joined[joined == joined[k]] = joined[code[i]]
                        a_all.append(node[code[i]])
                        b_all.append(node[k])
        return pa.table({"a": pa.array(a_all, pa.int64()), "b": pa.array(b_all, pa.int64())})

    out = table(full.groupBy("band", "x", "y").applyInArrow(run, "a long, b long").distinct())
    drop(rows, sets)
    return out


def _by_key(rows: DataFrame, side: DataFrame, keys: list[str], hot: DataFrame) -> DataFrame:
    """``rows`` left-joined to ``side``, which has a row per key; rows of the ``hot`` keys stay where they are and get theirs by a broadcast."""
    few = F.broadcast(side.join(F.broadcast(hot), keys, "left_semi"))
    return rows.join(few, keys).unionByName(rows.join(F.broadcast(hot), keys, "left_anti").join(side, keys, "left"))


def near_duplicates(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): groups of documents linked by 100 * intersection >= ``percent`` * union of their word shingles.

    Words stand between ASCII white space, A-Z lowered; a document with fewer than ``width`` words is one shingle; one without words (null, empty, blank) is linked with nothing.
    component_id is the smallest doc_id reachable.  Documents with equal shingle sets are one class first, so copies cost nothing further.  Rows that repeat a doc_id
    are one document, of which the least text counts, and give one row; so do rows with a null doc_id, which sort before all others.  An empty table gives no rows; other columns are ignored.
    """
    return groups(one_text(documents), width, percent)


def groups(src: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``near_duplicates`` of rows (id, text) whose ids are distinct and not null; texts that are bucketed by id stay where they are."""
    # By id, so that later joins move ids and not registers.
    sk = bucketed(_sketches(src, width), "id")
    content = ["n", "f1", "f2"]
    classes = table(sk.where("n > 0").groupBy(*content).agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    # At most HOT classes hold more than this share of the rows.
    least = (classes.agg(F.sum("copies")).first()[0] or 0) // HOT
    hot = classes.where(c("copies") > least).select("rep", *content) if least else classes.limit(0).select("rep", *content)
    member = table(_by_key(sk.select("id", *content), classes.drop("copies"), content, hot.drop("rep")).select("id", "n", F.coalesce("rep", "id").alias("rep")))
    bands = table(_bands(sk.join(classes.select(c("rep").alias("id")), "id", "left_semi")))
    leader = bands.groupBy("band").agg(F.min("id").alias("a"), F.count("*").alias("rows")).where("rows > 1").select("band", "a")
    buckets = table(bands.join(leader, "band"))
    drop(bands)
    star = table(buckets.where(c("id") != c("a")).select("a", c("id").alias("b")).distinct())
    first = _verified(table(_plausible(star, sk, percent)), src, width, percent)
    linked = table(components(first))
    labels = member.where(c("id") == c("rep")).select("id").join(linked.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    rest = _across(buckets, labels, sk, src, width, percent)
    # Links between components: the components themselves are joined to larger ones.
    merged = table(components(rest)).select(c("node").alias("component"), c("component").alias("_larger"))
    labels = labels.join(merged, "component", "left").select(c("id").alias("rep"), F.coalesce("_larger", "component").alias("component"))
    drop(buckets, star)
    # A class goes where its representative, its smallest id, goes.
    out = _by_key(member, labels, ["rep"], hot.select("rep"))
    return out.select(id_of("id").alias("doc_id"), c("n").alias("n_shingles"), id_of("component").alias("component_id"), (c("id") == c("component")).alias("kept"))
