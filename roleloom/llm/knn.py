"""Exact top-k inner products by a Voronoi join.

Adding one coordinate sqrt(M^2 - |x|^2) to every data vector turns the largest inner
product into the smallest distance.  Data and queries are grouped by their nearest
pivot; small summaries of the groups (size, radius, k+1 smallest distances of different
ids to the pivot) bound how far a query group's neighbours can lie, so a data vector is sent only
to the groups whose bound reaches it, and blocks of queries and data are multiplied
there.  Distances only decide what is sent; scores are integers and exact.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ._work import table

SCALE = 64
#: Pivots; they are the vectors with the lowest hash of their id.
PIVOTS = 48
#: Rows of a block of queries or data, so one product holds at most QUERY_BLOCK x DATA_BLOCK numbers.
QUERY_BLOCK, DATA_BLOCK = 512, 4096

c = F.col


def quantized(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, v array<long>): floor(64 * x) of each component; rows without a usable vector or id are left out."""
    v = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select("vec_id", v.alias("v")).where(c("vec_id").isNotNull() & c("v").isNotNull() & ~bad).select("vec_id", F.transform("v", lambda x: F.floor(x * SCALE)).alias("v"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column, shorter ones filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values, offsets = column.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(np.diff(column.offsets.to_numpy())))
    length = np.diff(offsets)
    if len(length) and (length == dims).all():
        return values.reshape(-1, dims).astype(np.int64)
    out = np.zeros((len(length), dims), np.int64)
    row = np.repeat(np.arange(len(length)), length)
    out[row, np.arange(len(values)) - offsets[:-1][row]] = values
    return out


def _distances(x: np.ndarray, lift: np.ndarray, pivots: np.ndarray, pivot_lift: np.ndarray) -> np.ndarray:
    a, p = np.concatenate([x, lift[:, None]], axis=1).astype(np.float64), np.concatenate([pivots, pivot_lift[:, None]], axis=1).astype(np.float64)
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] - 2 * a @ p.T + (p * p).sum(1)[None, :], 0))


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k largest scores that are no sentinel; equal scores go to the smaller id."""
    n = min(k, score.shape[1])
    cut = np.partition(score, score.shape[1] - n, axis=1)[:, score.shape[1] - n]
    row, col = np.nonzero((score >= cut[:, None]) & (score > np.iinfo(np.int64).min))
    order = np.lexsort((ids[col], -score[row, col], row))
    row, col = row[order], col[order]
    first = np.searchsorted(row, row)
    keep = np.arange(len(row)) - first < k
    return row[keep], col[keep]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, vector: str = "embedding", pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` largest integer inner products with all other vectors, ties to the smaller vec_id.

    ``queries`` has the columns of ``vectors``.  A vector that is null, or has a null or non-finite component, takes no part, nor does one without an id; a shorter vector is filled with zeros.
    Rows with the query's own id are the query itself; queries with equal ids are one (the least vector), data rows with equal ids are candidates each.  Fewer
    than ``k`` candidates are all returned; empty tables give no rows; other columns are ignored.  Scores have to fit 64-bit integers.
    """
    spark = vectors.sparkSession
    data, asked = quantized(vectors, vector), quantized(queries, vector).groupBy("vec_id").agg(F.min("v").alias("v"))
    out_schema = "query_id long, rank int, vec_id long, score long"
    norm = F.aggregate("v", F.lit(0.0), lambda t, x: t + x.cast("double") * x)
    size = data.agg(F.count("*"), F.max(F.size("v")), F.max(norm)).first()
    if not size[0]:
        return spark.createDataFrame([], out_schema)
    dims = max(size[1], asked.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0], 1)
    top = size[2] * (1 + 1e-9) + 1.0
    # A bounded sample: ``pivots`` rows.
    chosen = data.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(pivots).collect()
    p = np.zeros((len(chosen), dims), np.int64)
    for i, r in enumerate(chosen):
        p[i, :len(r["v"])] = r["v"]
    p_lift = np.sqrt(np.maximum(top - (p.astype(np.float64) ** 2).sum(1), 0))

    def assign(is_query: bool):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = _matrix(b.column("v"), dims)
                lift = np.zeros(len(x)) if is_query else np.sqrt(np.maximum(top - (x.astype(np.float64) ** 2).sum(1), 0))
                d = _distances(x, lift, p, p_lift)
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([b.column("vec_id").cast(pa.int64()), pa.array(cell, pa.int32()), pa.array(d[np.arange(len(x)), cell], pa.float64()), pa.array(list(x), pa.list_(pa.int64()))], names=["vec_id", "cell", "dist", "v"])
        return run

    shape = "vec_id long, cell int, dist double, v array<long>"
    cells = table(data.mapInArrow(assign(False), shape))
    groups = table(asked.mapInArrow(assign(True), shape))
    # Summaries: k + 1 distances of each of at most ``pivots`` groups, each of another id.  Ranked in two rounds, so that a large group is not sorted by one task.
    salted = W.partitionBy("cell", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("dist", "vec_id")
    near = cells.groupBy("cell", "vec_id").agg(F.min("dist").alias("dist")).withColumn("r", F.row_number().over(salted)).where(c("r") <= k + 1)
    near = near.withColumn("r", F.row_number().over(W.partitionBy("cell").orderBy("dist", "vec_id"))).where(c("r") <= k + 1).select("cell", "vec_id", "dist").collect()
    far = {r["cell"]: r["u"] for r in groups.groupBy("cell").agg(F.max("dist").alias("u")).collect()}
    if not far:
        return spark.createDataFrame([], out_schema)
    between = _distances(p, p_lift, p, p_lift)
    near_cell, near_id, near_dist = (np.array([r[x] for r in near]) for x in ("cell", "vec_id", "dist"))
    slack = 1e-6 * (np.sqrt(top) + 1) + 1e-6 * between.max()
    reach = []  # (data cell, query group, least distance to the pivot that can matter)
    for g, u in far.items():
        bound = u + between[g][near_cell] + near_dist
        order = np.argsort(bound, kind="stable")
        bound = np.sort(bound[order[np.unique(near_id[order], return_index=True)[1]]])  # the least of each id
        theta = bound[k] if len(bound) > k else np.inf  # the (k+1)th id: one of them may be the query's own, all rows of which are left out
        reach += [(int(j), int(g), float(between[g][j] - u - theta - slack)) for j in np.unique(near_cell)]
    reach_df = F.broadcast(spark.createDataFrame(reach, "cell int, group int, least double"))  # pivots^2 rows at most

    sent = cells.join(reach_df, "cell").where(c("dist") >= c("least"))
    sizes = {r["group"]: r["n"] for r in sent.groupBy("group").agg(F.count("*").alias("n")).collect()}  # a row per group
    asked_sizes = {r["cell"]: r["n"] for r in groups.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    blocks = [(g, max(1, -(-sizes.get(g, 0) // DATA_BLOCK)), max(1, -(-asked_sizes.get(g, 0) // QUERY_BLOCK))) for g in asked_sizes]
    blocks_df = F.broadcast(spark.createDataFrame(blocks, "group int, nd long, nq long"))
    d_blocks = (sent.join(blocks_df, "group").select("group", F.pmod(F.xxhash64("vec_id", F.lit(1)), c("nd")).alias("d"), F.explode(F.sequence(F.lit(0).cast("long"), c("nq") - 1)).alias("q"), "vec_id", "v", F.lit(False).alias("asks")))
    q_blocks = (groups.withColumnRenamed("cell", "group").join(blocks_df, "group").select("group", F.explode(F.sequence(F.lit(0).cast("long"), c("nd") - 1)).alias("d"), F.pmod(F.xxhash64("vec_id", F.lit(2)), c("nq")).alias("q"), "vec_id", "v", F.lit(True).alias("asks")))

    def solve(block: pa.Table) -> pa.Table:
        asks = block.column("asks").to_numpy()
        ids, x = block.column("vec_id").to_numpy(), _matrix(block.column("v"), dims)
        q_id, q, d_id, d = ids[asks], x[asks], ids[~asks], x[~asks]
        if not len(q_id) or not len(d_id):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        small = max(float(np.abs(q).max()), 1) * max(float(np.abs(d).max()), 1) * dims < 2 ** 52
        score = (q.astype(np.float64) @ d.T.astype(np.float64)).astype(np.int64) if small else q @ d.T  # doubles are exact below 2^53
        score[q_id[:, None] == d_id[None, :]] = np.iinfo(np.int64).min
        row, col = _best(score, d_id, k)
        return pa.table({"query_id": q_id[row], "vec_id": d_id[col], "score": score[row, col]})

    partial = d_blocks.unionByName(q_blocks).groupBy("group", "d", "q").applyInArrow(solve, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return partial.withColumn("rank", rank).where(c("rank") <= k).select("query_id", c("rank").cast("int").alias("rank"), "vec_id", "score")
