"""Merkle manifest of a table, by time-forward processing of its hash trees.

Rows become leaves; the leaves of a group form a tree of fan-out three, and the groups'
subroots form the top tree.  A tree is processed in blocks of SPAN consecutive nodes.  Nodes
of a block are labelled (last leaf below, level), so that every child has a smaller label
than its parent.  Spark's sorted shuffle is the external part of the priority queue: it
brings each task its blocks' input in label order; a small heap holds the digests that are
under way, at most two a level.  The tops of all blocks are the input of the next round.  The
reversed sweep reads the nodes that the rounds have written, largest label first, and sends
each child its siblings and what its parent received: at the leaves, whole proofs.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ._work import table

FAN = 3
#: Nodes of a block: seven levels.  It bounds what one task holds of a tree, whatever the tree's size.
SPAN = FAN ** 7
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
NODES = "tree long, n long, block long, last int, level int, top boolean, run array<string>, digest string"

c = F.col


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value: Column) -> Column:
    """A value with its length before it, so that no two rows are written alike; null is ``-``."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def fold(leaf: Column, before: Column, after: Column) -> Column:
    """The root that a leaf leads to by its proof: at each level its left siblings, itself and its right siblings are hashed."""
    return F.aggregate(F.arrays_zip(before.alias("b"), after.alias("a")), leaf, lambda h, s: F.sha2(F.concat(s["b"], h, s["a"]), 256))


def siblings(before: Column, after: Column) -> Column:
    """All digests of a proof as one text, level by level, left to right."""
    return F.array_join(F.zip_with(before, after, lambda b, a: F.concat(b, a)), "")


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, the place (from 0) of each among the rows of its group, and ``n``, the rows of the group.

    Rows are dealt by ranges of (group, order) and numbered inside each range; a table of one row per range and group gives the number before
    it, so a group of any size is spread over the ranges.  ``order`` has to tell all rows apart for this.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [c(group), *[c(o).asc_nulls_first() for o in order]]
    made = table(rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    made = made.withColumn("_range", F.shiftright("_at", 33))
    runs = made.groupBy("_range", group).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    whole = W.partitionBy(group)
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("_range", group, (before - c("_first")).alias("_shift"), F.sum("_n").over(whole).alias("n"))
    return made.join(runs, ["_range", group]).withColumn("pos", c("_at") + c("_shift")).drop("_range", "_at", "_shift")


def height(n: int) -> int:
    """Levels above ``n`` nodes."""
    k = 0
    while n > 1:
        n, k = -(-n // FAN), k + 1
    return k


class _Block:
    """The sweep of one block towards its top: a heap of digests, ordered by the label of the node they are sent to."""

    def __init__(self, tree: int, n: int, block: int, span: int, out: list):
        self.tree, self.n, self.block, self.out = tree, n, block, out
        self.size = min(span, n - block * span)
        self.height = height(min(n, span))
        self.queue: list[tuple[int, int, int, str]] = []

    def send(self, place: int, level: int, value: str) -> None:
        """Node ``place`` of ``level`` is done: its parent, a level up, gets its digest; the top is the block's result."""
        if level == self.height:
            self.out.append((self.tree, self.n, self.block, self.size - 1, level, True, None, value))
            return
        span = FAN ** (level + 1)
        last = min((place // FAN + 1) * span, self.size) - 1
        heapq.heappush(self.queue, (last, level + 1, place, value))

    def until(self, leaf: int) -> None:
        """Do all nodes whose leaves come before ``leaf``."""
        queue = self.queue
        while queue and queue[0][0] < leaf:
            last, level, place, value = heapq.heappop(queue)
            run = [value]
            while queue and queue[0][:2] == (last, level):
                run.append(heapq.heappop(queue)[3])
            made = digest(*run)
            self.out.append((self.tree, self.n, self.block, last, level, False, run, made))
            self.send(place // FAN, level, made)


_NODE = pa.schema([("tree", pa.int64()), ("n", pa.int64()), ("block", pa.int64()), ("last", pa.int32()), ("level", pa.int32()), ("top", pa.bool_()), ("run", pa.list_(pa.string())), ("digest", pa.string())])


def _rows(out: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)


def _forward(span: int):
    """The sweep towards the tops, over blocks that come one after the other, each in order of its leaves."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list = []
        now: _Block | None = None
        for batch in batches:
            for tree, n, block, pos, value in zip(*[batch.column(k).to_pylist() for k in ("tree", "n", "block", "pos", "digest")]):
                if now is None or (now.tree, now.block) != (tree, block):
                    if now:
                        now.until(span)
                    now = _Block(tree, n, block, span, out)
                place = pos - block * span
                now.until(place)
                now.send(place, 0, value)
            if out:
                yield _rows(out, _NODE)
                out.clear()
        if now:
            now.until(span)
        if out:
            yield _rows(out, _NODE)
    return run


def climb(items: DataFrame, most: int, span: int = SPAN) -> tuple[list[DataFrame], DataFrame]:
    """All nodes above ``items`` (tree, n, pos, digest), a table for each round, and the root of each tree (tree, digest).

    ``most`` is the size of the largest tree; a round divides it by ``span``.
    """
    rounds, roots, rows = [], None, items
    while True:
        block = F.floor(c("pos") / span)
        dealt = rows.select("tree", "n", block.alias("block"), "pos", "digest").repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
        made = table(dealt.mapInArrow(_forward(span), NODES))
        rounds.append(made)
        tops = made.where("top").select("tree", "n", c("block").alias("pos"), "digest")
        done = tops.where(c("n") <= span).select("tree", "digest")
        roots = done if roots is None else roots.unionByName(done)
        if most <= span:
            return rounds, roots
        most = -(-most // span)
        rows = tops.where(c("n") > span).withColumn("n", F.ceil(c("n") / span))


@dataclass
class _Under:
    """What is under way in one block of the reversed sweep."""

    key: tuple
    arriving: tuple | None
    fixed: tuple
    queue: list


def _backward(carried: list[str], schema: pa.Schema, span: int):
    """A reversed sweep over nodes, suffixes and, in the last round, the leaves themselves with the columns they carry."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Under | None = None
        for batch in batches:
            at, got = [], []
            names = ("kind", "tree", "block", "last", "level", "run", "before", "after", "subroot", "root")
            for i, (kind, tree, block, last, level, run, before, after, subroot, root) in enumerate(zip(*[batch.column(k).to_pylist() for k in names])):
                if kind == 2:  # the proof of the block's top
                    rest = None
                    for pair in reversed(list(zip(before, after))):
                        rest = (*pair, rest)
                    now = _Under((tree, block), (rest,), (subroot, root), [])
                    continue
                assert now is not None and now.key == (tree, block), "a block begins with its own suffix"
                if now.arriving is not None:  # the first node behind the suffix is the top
                    (proof,), now.arriving = now.arriving, None
                else:
                    label_last, label_level, proof = heapq.heappop(now.queue)[:3]
                    assert (-label_last, -label_level) == (last, level), "messages come in the order of the labels"
                if kind == 0:
                    at.append(i)
                    got.append((tree, block * span + last, proof, now.fixed))
                    continue
                size, low = FAN ** (level - 1), FAN ** level * (last // FAN ** level)
                for k in range(len(run)):
                    mine = ("".join(run[:k]), "".join(run[k + 1:]), proof)
                    end = min(low + (k + 1) * size - 1, last)
                    if level == 1 and not carried:
                        at.append(i)
                        got.append((tree, block * span + end, mine, now.fixed))
                    else:
                        heapq.heappush(now.queue, (-end, -(level - 1), mine))
            if at:
                yield _proofs(batch, at, got, carried, schema)
    return run


def _proofs(batch: pa.RecordBatch, at: list[int], got: list, carried: list[str], schema: pa.Schema) -> pa.RecordBatch:
    before, after = [], []
    for _, _, proof, _ in got:
        b, a = [], []
        while proof is not None:
            b.append(proof[0])
            a.append(proof[1])
            proof = proof[2]
        before.append(b)
        after.append(a)
    texts = pa.list_(pa.string())
    columns = [pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array(before, texts), pa.array(after, texts), pa.array([g[3][0] for g in got], pa.string()), pa.array([g[3][1] for g in got], pa.string())]
    rows = pa.array(at, pa.int64())
    return pa.RecordBatch.from_arrays([*columns, *[batch.column(k).take(rows).cast(schema.field(k).type) for k in carried]], schema=schema)


_PROOF = "tree long, pos long, before array<string>, after array<string>, subroot string, root string"


def descend(rounds: list[DataFrame], suffixes: DataFrame, leaves: DataFrame, carried: list[str], span: int = SPAN) -> DataFrame:
    """The proof of every leaf: tree, pos, before, after, subroot, root and the carried columns.

    ``suffixes`` (tree, pos 0, before, after, subroot, root) has the proof of each tree's root, ``leaves`` (tree, pos and the carried columns) the leaves.
    """
    types = {f.name: f for f in leaves.select(*carried).schema}
    nothing = [F.lit(None).cast(types[k].dataType).alias(k) for k in carried]
    texts = F.lit(None).cast("array<string>")
    text = F.lit(None).cast("string")
    found = None
    for i in reversed(range(len(rounds))):
        final = i == 0
        own, blank = (carried, nothing) if final else ([], [])
        # Trees whose last round this is get their own suffix here, the others what the round above has found for each block.
        ending = suffixes.join(rounds[i].where(c("top") & (c("block") == 0)).select("tree"), "tree", "left_semi")
        if found is not None:
            ending = ending.join(rounds[i + 1].where(c("top") & (c("block") == 0)).select("tree"), "tree", "left_anti").unionByName(found)
        nodes = rounds[i].where(~c("top")).select(F.lit(1).alias("kind"), "tree", "block", "last", "level", "run", texts.alias("before"), texts.alias("after"), text.alias("subroot"), text.alias("root"), *blank)
        tops = ending.select(F.lit(2).alias("kind"), "tree", c("pos").alias("block"), F.lit(span).alias("last"), F.lit(99).alias("level"), texts.alias("run"), "before", "after", "subroot", "root", *blank)
        rows = nodes.unionByName(tops)
        if final:
            block = F.floor(c("pos") / span)
            rows = rows.unionByName(leaves.select(F.lit(0).alias("kind"), "tree", block.alias("block"), (c("pos") - block * span).cast("int").alias("last"), F.lit(0).alias("level"),
                                                  texts.alias("run"), texts.alias("before"), texts.alias("after"), text.alias("subroot"), text.alias("root"), *carried))
        columns = _PROOF + "".join(f", `{k}` {types[k].dataType.simpleString()}" for k in own)
        dealt = rows.repartition("tree", "block").sortWithinPartitions("tree", "block", c("last").desc(), c("level").desc())
        found = dealt.mapInArrow(_backward(own, _arrow(leaves.sparkSession, columns), span), columns)
        found = found if final else table(found)
    return found


def _arrow(spark: SparkSession, columns: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(spark.createDataFrame([], columns).schema)


def manifest(documents: DataFrame, columns: tuple[str, ...] = COLUMNS, group: str = "source", order: str = "doc_id", carry: dict[str, Column] | None = None, span: int = SPAN) -> DataFrame:
    """Leaf, subroot, root and proof of every row: ``order``, leaf, subroot, root, before, after, and the columns that ``carry`` names.

    ``before`` and ``after`` hold, from the lowest level of the group's tree to the highest of the top tree, the digests left and right of the
    node on the leaf's way; one alone in its run has "" twice.  Groups are ordered by their text's bytes, null first; in a group rows ascend by
    ``order``, nulls first, rows with one ``order`` by their leaf; equal rows are a leaf each.  Null values are hashed as ``-``, an empty text as
    ``0:``.  An empty table has no root and gives no rows; further columns are ignored.  ``carry`` holds text columns computed from the input row; ``span``, a power of three,
    is the size of a block.
    """
    carry = carry or {}
    spark = documents.sparkSession
    own = {f"c_{k}": v for k, v in carry.items()}
    g = F.coalesce(F.concat(F.lit("1"), c(group).cast("string")), F.lit("0"))
    hashed = table(documents.select(g.alias("g"), c(order).alias("o"), leaf_of(*[c(k) for k in columns]).alias("digest"), *[v.alias(k) for k, v in own.items()], F.monotonically_increasing_id().alias("u")))
    rows = ranked(hashed, "g", ["o", "digest", "u"])
    groups = table(rows.groupBy("g").agg(F.max("n").alias("n")))
    most, n_groups = groups.agg(F.max("n"), F.count("*")).first()
    result = [c("o").alias(order), c("digest").alias("leaf"), "subroot", "root", "before", "after", *[c(k).alias(k[2:]) for k in own]]
    if not n_groups:
        return spark.createDataFrame([], f"o {dict(hashed.dtypes)['o']}, digest string, subroot string, root string, before array<string>, after array<string>" + "".join(f", {k} string" for k in own)).select(*result)
    trees = ranked(groups.select("g", F.lit(0).alias("all")), "all", ["g"]).select("g", c("pos").alias("tree"))
    leaves = table(rows.join(trees, "g").select("tree", "n", "pos", "o", "digest", *own))
    lower, subroots = climb(leaves, most, span)
    tops = table(subroots.select(F.lit(0).cast("long").alias("tree"), F.lit(n_groups).cast("long").alias("n"), c("tree").alias("pos"), "digest"))
    upper, roots = climb(tops, n_groups, span)
    whole = roots.select("tree", F.lit(0).cast("long").alias("pos"), F.array().cast("array<string>").alias("before"), F.array().cast("array<string>").alias("after"), F.lit(None).cast("string").alias("subroot"), c("digest").alias("root"))
    at_top = descend(upper, whole, tops, ["digest"], span)
    suffixes = table(at_top.select(c("pos").alias("tree"), F.lit(0).cast("long").alias("pos"), "before", "after", c("digest").alias("subroot"), "root"))
    return descend(lower, suffixes, leaves, ["o", "digest", *own], span).select(*result)
