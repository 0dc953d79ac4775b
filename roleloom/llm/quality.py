"""Quality classifier by compression.

Two zstandard dictionaries are built, from good and from bad labelled text.  A text
costs fewer bytes under the dictionary of the kind it resembles: the difference of the
two sizes, over their sum and over the root of the text's length, is the evidence, and
texts that shrink far more than good ones do repeat themselves.  A logistic curve fitted
on other labelled texts turns this into a probability.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ._text import pieces
from ._work import table

#: Labelled documents of each class that training looks at: a half for the dictionary, a half for the curve.
SAMPLE_PER_CLASS = 4_000
#: Of each such document, its pieces for the dictionary: this many, spread over the whole text.
PIECES_PER_DOCUMENT = 4
DICTIONARY_BYTES = 64 << 10
#: A text is compressed in pieces, so that the dictionary counts for all of it.
PIECE_BYTES = 2048
LEVEL = 3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    shrunk: float  # log of size over length below which a text repeats itself more than nearly all good ones
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]

    def probability(self, sizes: np.ndarray) -> np.ndarray:
        m = (features(sizes, self.shrunk) - np.array(self.mean)) / np.array(self.scale)
        return 1 / (1 + np.exp(-np.clip(np.c_[m, np.ones(len(m))] @ np.array(self.weights), -40, 40)))


def _pieces(text: bytes) -> list[bytes]:
    """Pieces of about equal size, none over PIECE_BYTES."""
    n = max(1, -(-len(text) // PIECE_BYTES))
    edge = [len(text) * i // n for i in range(n + 1)]
    return [text[a:b] for a, b in zip(edge, edge[1:])]


def _compressor(dictionary: bytes):
    import zstandard as z
    params = z.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
    d = z.ZstdCompressionDict(dictionary)
    d.precompute_compress(compression_params=params)
    return z.ZstdCompressor(dict_data=d, compression_params=params)


def sizes(texts: Iterable[bytes], good: bytes, bad: bytes) -> np.ndarray:
    """(size under the good dictionary, size under the bad one, length) of each whole text, without what an empty piece costs."""
    g, b = _compressor(good).compress, _compressor(bad).compress
    over_g, over_b = len(g(b"")), len(b(b""))
    out = []
    for text in texts:
        cut = _pieces(text) if text else []
        out.append((sum(len(g(p)) - over_g for p in cut), sum(len(b(p)) - over_b for p in cut), len(text)))
    return np.array(out, np.float64).reshape(-1, 3)


def features(sized: np.ndarray, shrunk: float) -> np.ndarray:
    """Normalised difference of the sizes, how far the text shrinks below ``shrunk``, the difference over the root of the length, and the length's log."""
    x, y, n = sized[:, 0], sized[:, 1], np.maximum(sized[:, 2], 1)
    return np.stack([(y - x) / (x + y + 8), np.maximum(0, shrunk - np.log(np.maximum(x, 1) / n)), np.clip((y - x) / np.sqrt(n), -5, 5), np.log(n)], axis=1)


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the samples themselves where there are too few to train on."""
    import zstandard as z
    try:
        return z.train_dictionary(DICTIONARY_BYTES, samples, k=64, d=8).as_bytes()
    except (z.ZstdError, ValueError):
        return b"".join(samples)[-DICTIONARY_BYTES:] or b"\0" * 8


def _curve(m: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights) of a logistic regression of y on the columns of m, by Newton's steps; a small penalty keeps separable data finite."""
    k = m.shape[1]
    if not len(m) or y.min() == y.max():
        return np.zeros(k), np.ones(k), np.zeros(k + 1)
    mean, scale = m.mean(axis=0), m.std(axis=0) + 1e-9
    z, w = np.c_[(m - mean) / scale, np.ones(len(m))], np.zeros(k + 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(k + 1), z.T @ (y - p) - 1e-3 * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return mean, scale, w


def train(documents: DataFrame, labels: DataFrame, sample_per_class: int = SAMPLE_PER_CLASS) -> Model:
    """A model from documents (doc_id, text) and labels (doc_id, quality: 1 good, 0 bad; other labels teach nothing).

    The dictionaries come from half of the sample, the curve from the other half, both chosen by a hash of the id.  Only labels are counted to choose them: ``sample_per_class``
    rows of each class are expected, so the chosen ids may be broadcast, and of a document at most PIECES_PER_DOCUMENT pieces of PIECE_BYTES reach the driver.
    """
    marked = labels.where(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("quality"))
    counts = {r["quality"]: r["n"] for r in marked.groupBy("quality").agg(F.count("*").alias("n")).collect()}  # two rows
    h = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 20))
    share = F.when(F.col("quality") == 1, min(1.0, sample_per_class / max(1, counts.get(1, 0)))).otherwise(min(1.0, sample_per_class / max(1, counts.get(0, 0))))
    chosen = marked.where(h < share * (1 << 20)).withColumn("first_half", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)) == 0)
    sample = table(documents.where(F.col("text").isNotNull() & (F.length("text") > 0)).select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t in enumerate(batch.column("text").to_pylist()):
                parts = _pieces(t.encode())
                step = max(1, -(-len(parts) // PIECES_PER_DOCUMENT))
                some = parts[::step]
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("doc_id")[i].as_py()] * len(some), pa.int64()), pa.array([batch.column("quality")[i].as_py()] * len(some), pa.int32()), pa.array(some, pa.binary())], names=["doc_id", "quality", "piece"])

    got = sample.where("first_half").mapInArrow(cut, "doc_id long, quality int, piece binary").toPandas()
    got = got.sort_values(["doc_id", "piece"], kind="stable")
    good, bad = (_dictionary([bytes(p) for p in got.loc[got["quality"] == k, "piece"]]) for k in (1, 0))

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in pieces(batches):
            x = sizes((t.data[a:b].tobytes() for a, b in zip(t.begin, t.end)), good, bad)
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:, k], pa.float64()) for k in range(3)), t.batch.column("quality")], names=["g", "b", "n", "quality"])

    seen = sample.where("NOT first_half").select("text", "quality").mapInArrow(measure, "g double, b double, n double, quality int").toPandas().sort_values(["g", "b", "n", "quality"])
    sized, label = seen[["g", "b", "n"]].to_numpy(np.float64), seen["quality"].to_numpy(np.float64)
    usual = sized[(label == 1) & (sized[:, 2] > 200)]
    shrunk = float(np.quantile(np.log(np.maximum(usual[:, 0], 1) / usual[:, 2]), 0.02)) if len(usual) else -10.0
    mean, scale, weights = _curve(features(sized, shrunk), label)
    return Model(good, bad, shrunk, tuple(mean), tuple(scale), tuple(weights))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """``documents`` with the column ``quality_score`` (0 to 1, higher: better), over whole texts.

    Null and empty texts are texts of length 0 and get the curve's value for that; one row per input row, repeated rows alike; all other columns stay, a former quality_score is replaced.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)  # two dictionaries of 64 KB
    rest = documents.drop("quality_score")
    schema = StructType([*rest.schema.fields, StructField("quality_score", DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for t in pieces(batches):
            p = m.probability(sizes((t.data[a:b].tobytes() for a, b in zip(t.begin, t.end)), m.good, m.bad))
            yield pa.RecordBatch.from_arrays([*t.batch.columns, pa.array(p, pa.float64())], names=[*t.batch.schema.names, "quality_score"])

    return rest.mapInArrow(run, schema)
