"""Repeated word windows by difference-cover anchors.

Of a document's words only those at positions of a difference cover modulo a period
begin an anchor.  Two equal windows, wherever they stand, have a shift below the
period at which both are at cover positions, so their anchors there are equal: a window
none of whose anchors is repeated is unique.  The others are compared as whole windows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._repeats import SCHEMA, Combiner, repeated
from ._text import Words, mix, pieces, prefix, ranges, runs, span_hash, words
from ._work import distinct_texts, id_of, table

WIDTH = 35
#: Base of the second hash of a window.
SECOND = 0xC2B2AE3D27D4EB4F
#: Perfect difference sets: period -> positions whose differences give every shift once (fixed values).
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}

c = F.col


def cover(width: int) -> tuple[int, np.ndarray, int]:
    """(period, which positions modulo it are in the cover, words of an anchor): anchors keep about two fifths of the window."""
    period = max(p for p in COVERS if p == 1 or p <= 0.62 * width)
    inside = np.zeros(period, bool)
    inside[list(COVERS[period])] = True
    return period, inside, width - period + 1


def _anchors(w: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word index, hash, document) of the anchors of documents that have a window."""
    period, inside, size = cover(width)
    n = np.where(w.count >= width, w.count - size + 1, 0)
    at = ranges(w.first, n)
    doc = np.repeat(np.arange(len(n)), n)
    keep = inside[(at - w.first[doc]) % period]
    at, doc = at[keep], doc[keep]
    return at, span_hash(prefix(w.hash), at, at + size), doc


def _anchor_rows(width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Combiner()
        for t in pieces(batches):
            w = words(t)
            at, h, doc = _anchors(w, width)
            yield from rows.add(h, np.zeros(len(h), np.int32), t.column("id")[doc], at - w.first[doc], len(t.data))
        yield from rows.flush()
    return run


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, count of each row) of a list column; a null list is empty."""
    count = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), count


def _window_rows(width: int):
    """Hashes of the windows that hold a repeated anchor; equal ones of a task are combined."""
    period, _, size = cover(width)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Combiner()
        for t in pieces(batches):
            w = words(t)
            values, count = _lists(t.batch.column("at"))
            marked = np.zeros(len(w.hash) + 1, np.int64)
            marked[np.repeat(w.first, count) + values] = 1
            sums = np.append(0, np.cumsum(marked))
            n = np.maximum(w.count - width + 1, 0)
            start, doc = ranges(w.first, n), np.repeat(np.arange(len(n)), n)
            hit = sums[start + period] > sums[start]  # an anchor that begins in the first ``period`` words lies inside the window
            start, doc = start[hit], doc[hit]
            h = span_hash(prefix(w.hash), start, start + width, salt=7)
            h2 = span_hash(prefix(mix(w.hash, 99), SECOND), start, start + width, base=SECOND) >> np.uint64(32)
            yield from rows.add(h, h2.astype(np.uint32).view(np.int32), t.column("id")[doc], start - w.first[doc], len(t.data))
        yield from rows.flush()
    return run


def _kept(width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in pieces(batches):
            values, count = _lists(t.batch.column("at"))
            doc = np.repeat(np.arange(len(count)), count)
            order = np.lexsort((values, doc))
            r_doc, r_from, r_to = runs(values[order].astype(np.int64), doc[order], width)
            removed = np.bincount(r_doc, r_to - r_from, minlength=len(count)).astype(np.int64)
            edge = np.searchsorted(r_doc, np.arange(len(count) + 1))
            copied = t.batch.column("copies").to_numpy(zero_copy_only=False) > 1
            n_words = np.zeros(len(count), np.int64)
            raw, texts = t.data.tobytes(), []
            for i, (b, e) in enumerate(zip(t.begin, t.end)):
                ws, kept, at = raw[b:e].split(), [], 0
                n_words[i] = len(ws)
                if copied[i] and len(ws) >= width:  # every window also starts in the text's copies
                    removed[i] = len(ws)
                    texts.append("")
                    continue
                for k in range(edge[i], edge[i + 1]):
                    kept += ws[at:r_from[k]]
                    at = r_to[k]
                texts.append(b" ".join(kept + ws[at:]).decode())
            yield pa.RecordBatch.from_arrays([t.batch.column("id"), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())], names=["id", "n_words", "n_removed", "text"])
    return run


def repeated_windows(texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """(id, at): of each distinct text of ``distinct_texts``, under its first id, the first words of the windows whose word sequence also starts elsewhere among them."""
    firsts = texts.where(c("id") == c("first")).select("id", "text")
    anchors = table(repeated(firsts.mapInArrow(_anchor_rows(width), SCHEMA)).groupBy("id").agg(F.collect_list("pos").alias("at")))
    windows = firsts.join(anchors, "id").select("id", "text", "at").mapInArrow(_window_rows(width), SCHEMA)
    return table(repeated(windows).groupBy("id").agg(F.collect_list("pos").alias("at")))


def remove_repeats(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_words, n_removed, text): words covered by a window of ``width`` words that also starts anywhere else, the same document included, are removed.

    Words stand between ASCII white space; ``text`` is the kept words joined by one space.  Null, empty and blank texts and texts shorter than a window keep all
    they have (``text`` is then empty, not null).  Rows that repeat a doc_id are one document, of which the least text counts, and give one row; so do rows with a null doc_id.
    Windows are equal if 96 bits of two hashes are.  An empty table gives no rows; other columns are ignored.
    """
    texts = distinct_texts(documents)
    rows = texts.join(repeated_windows(texts, width), "id", "left").select("id", "text", "copies", "at")
    out = rows.mapInArrow(_kept(width), "id long, n_words long, n_removed long, text string")
    return out.select(id_of("id").alias("doc_id"), "n_words", "n_removed", "text")
