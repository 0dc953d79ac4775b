"""Which of many (key, document, position) rows share their key with another row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

#: Bytes of text whose keys a task combines before they are shuffled.
CHUNK_BYTES = 32 << 20
SCHEMA = "k long, k2 int, id long, pos int, more_id array<long>, more_pos array<int>"

c = F.col


class Combiner:
    """Rows of one task: those with equal keys become one row, so a key that is very frequent gives a row per chunk and not one per place."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.bytes = 0

    def add(self, k: np.ndarray, k2: np.ndarray, ids: np.ndarray, pos: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
        self.parts.append((k, k2, ids, pos))
        self.bytes += size
        if self.bytes >= CHUNK_BYTES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        k, k2, ids, pos = (np.concatenate(x) for x in zip(*self.parts))
        self.parts, self.bytes = [], 0
        if not len(k):
            return
        order = np.lexsort((pos, ids, k2, k))
        k, k2, ids, pos = k[order], k2[order], ids[order], pos[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (k2[1:] != k2[:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(k)))
        offsets = pa.array(np.append(0, np.cumsum(count - 1)).astype(np.int32), mask=np.append(count == 1, False))
        rest = ~new
        columns = [pa.array(k[first].astype(np.int64), pa.int64()), pa.array(k2[first].astype(np.int32), pa.int32()), pa.array(ids[first], pa.int64()), pa.array(pos[first].astype(np.int32), pa.int32()),
                   pa.ListArray.from_arrays(offsets, pa.array(ids[rest], pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(pos[rest].astype(np.int32), pa.int32()))]
        whole = pa.RecordBatch.from_arrays(columns, names=["k", "k2", "id", "pos", "more_id", "more_pos"])
        for at in range(0, whole.num_rows, 1 << 16):
            yield whole.slice(at, 1 << 16)


def repeated(rows: DataFrame) -> DataFrame:
    """(id, pos, total) of every place whose key is that of ``total`` > 1 places."""
    total = F.sum(1 + F.coalesce(F.size("more_id"), F.lit(0))).over(W.partitionBy("k", "k2"))
    many = rows.withColumn("total", total).where(c("total") > 1)
    places = F.concat(F.array(F.struct("id", "pos")), F.coalesce(F.zip_with("more_id", "more_pos", lambda i, p: F.struct(i.alias("id"), p.alias("pos"))), F.array().cast("array<struct<id:bigint,pos:int>>")))
    return many.select(F.explode(places).alias("p"), "total").select("p.id", "p.pos", "total")
