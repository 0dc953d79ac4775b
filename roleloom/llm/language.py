"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of (language, bucket) are gathered by Spark from a bounded sample of labelled
documents; the matrix of log probabilities has 2^16 rows and a column per language,
so its size does not depend on the corpus, and is sent to the executors.  Scoring adds
the rows of a document's n-grams: a sparse product, a batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._text import Texts, mix, pieces

BITS = 16
ORDERS = (1, 2, 3)
#: Labelled documents of a language that training looks at; they are those with the lowest hash of their id.
SAMPLE_PER_LANGUAGE = 10_000
UNKNOWN = "und"
PIECE = 1 << 20
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Lower-case code point of every letter, 0 for all other code points."""
    if not _LETTERS:
        table = np.zeros(0x110000, np.uint32)
        for i in range(0x110000):
            ch = chr(i)
            if ch.isalpha():
                table[i] = ord(low) if len(low := ch.lower()) == 1 else i
        _LETTERS.append(table)
    return _LETTERS[0]


def _grams(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, document, has letter): n-grams of each text, in which every run of other characters is one space."""
    raw = texts.data.tobytes()
    point, doc = [], []
    lengths = np.zeros(len(texts.begin), np.int64)
    for i, (b, e) in enumerate(zip(texts.begin, texts.end)):
        p = np.frombuffer(raw[b:e].decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
        point.append(p)
        lengths[i] = len(p)
    low = _letters()[np.concatenate(point)] if point else np.zeros(0, np.uint32)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    has = np.bincount(doc[low > 0], minlength=len(lengths)) > 0
    keep = low > 0
    keep[1:] |= low[:-1] > 0  # the first of a run of others stays, as a space
    first = (np.cumsum(lengths) - lengths)[lengths > 0]
    keep[first] = low[first] > 0  # what the text before it ends with is no matter
    low, doc = low[keep], doc[keep]
    buckets, owners = [], []
    h = np.zeros(len(low), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        h = h[: max(0, len(low) - n + 1)] * np.uint64(0x100000001B3) + low[n - 1:].astype(np.uint64)
        if n in ORDERS and len(h):
            whole = doc[: len(h)] == doc[n - 1:]
            if n == 1:
                whole = whole & (low > 0)
            buckets.append((mix(h[whole], n) >> np.uint64(64 - BITS)).astype(np.int64))
            owners.append(doc[: len(h)][whole])
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), has
    return np.concatenate(buckets), np.concatenate(owners), has


def train(documents: DataFrame, sample_per_language: int = SAMPLE_PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities [buckets + prior row, languages]) from the columns doc_id, text and lang.

    Rows with a null lang or text teach nothing.  The model is the same however the rows are partitioned.
    """
    labelled = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    languages = sorted(sizes)
    if not languages:
        return [], np.zeros((0, 0), np.float64)
    # A share of each language's documents, chosen by a hash of the id; the expected number is the bound.
    share = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(min(1.0, sample_per_language / sizes[lang])))])
    sample = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20)).select("lang", "text")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {lang: np.zeros(1 << BITS, np.int64) for lang in languages}
        for t in pieces(batches, most=PIECE):
            bucket, doc, _ = _grams(t)
            lang = np.array(t.batch.column("lang").to_pylist(), object)
            for name in set(lang):
                totals[name] += np.bincount(bucket[(lang == name)[doc]], minlength=1 << BITS)
        for name, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["lang", "bucket", "n"])

    counted = sample.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # 65,536 rows a language at most
    matrix = np.full(((1 << BITS) + 1, len(languages)), 0.1)
    matrix[counted["bucket"].to_numpy(np.int64), counted["lang"].map(languages.index).to_numpy(np.int64)] += counted["n"].to_numpy(np.float64)
    matrix[:-1] = np.log(matrix[:-1] / matrix[:-1].sum(axis=0))
    matrix[-1] = np.log(np.array([sizes[x] for x in languages]) / sum(sizes.values()))
    return languages, matrix


def predict(documents: DataFrame, languages: list[str], matrix: np.ndarray) -> DataFrame:
    """(doc_id, lang_pred, score) of every text.

    Texts that are null, empty or have no letter, and all texts of a model that has learnt nothing, are ``und`` with score 0.  The score is the language's posterior
    probability, its log odds divided by the square root of the n-gram count so that long texts stay graded.  Ties go to the language first in order.
    One row per input row, repeated rows alike; only doc_id and text are read.
    """
    model = documents.sparkSession.sparkContext.broadcast((languages, matrix))  # (2^16 + 1) x 8 bytes a language

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, logs = model.value
        for t in pieces(batches, most=PIECE):
            n = t.batch.num_rows
            bucket, doc, has = _grams(t)
            count = np.bincount(doc, minlength=n)
            if names:
                log = np.stack([np.bincount(doc, logs[bucket, k], minlength=n) for k in range(len(names))], axis=1) + logs[-1]
                best = log.argmax(axis=1)
                tempered = np.exp((log - log[np.arange(n), best, None]) / np.sqrt(np.maximum(count, 1))[:, None])
                value = np.where(has, 1 / tempered.sum(axis=1), 0.0)
                pred = np.where(has, np.array(names, object)[best], UNKNOWN)
            else:
                value, pred = np.zeros(n), np.full(n, UNKNOWN, object)
            yield pa.RecordBatch.from_arrays([t.batch.column("doc_id").cast(pa.int64()), pa.array(list(pred), pa.string()), pa.array(value, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return documents.select("doc_id", "text").mapInArrow(score, "doc_id long, lang_pred string, score double")
