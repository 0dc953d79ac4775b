"""Exact repeated substrings with a run-length index.

A Burrows-Wheeler transform of a whole corpus would have to be sorted as one string, so
the corpus is first cut where nothing can be lost.  Every window of ``length`` bytes has
an anchor: the k-mer with the smallest hash in it.  Equal windows have equal anchors, so
windows whose anchor occurs once are unique, and the others need comparison only with
windows of the same anchor.  Each stretch of windows with one anchor is a context of fewer
than twice ``length`` bytes; equal contexts are merged, and where an anchor has
different contexts, these are indexed together:

* the contexts' suffixes are sorted and their Burrows-Wheeler transform is cut into runs;
* common prefixes are measured at the run ends only; inside a run the match of a position is
  one shorter than that of the position before it, so the matching statistics of all
  positions follow in one pass over the text;
* neighbours that match for ``length`` bytes are the same window, and all but its first
  occurrence are marked.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._repeats import SCHEMA, Combiner, repeated
from ._text import _BYTE, Texts, pieces, prefix, ranges, span_hash
from ._work import distinct_texts, id_of, table

LENGTH = 100
#: Bytes of an anchor.
KMER = 28
#: Anchors with more occurrences than this are told apart by whole windows instead, so that no task receives all their contexts.
FREQUENT = 4000
#: Bytes of contexts that a task indexes together.
INDEX_BYTES = 1 << 20

c = F.col


def _windows(t: Texts, length: int, kmer: int) -> tuple[np.ndarray, ...]:
    """Stretches of windows with one anchor: (anchor hash, anchor place, first window, last window, document); places are bytes of the piece."""
    n_win = np.maximum(t.end - t.begin - length + 1, 0)
    empty = np.zeros(0, np.int64)
    if not n_win.sum():
        return np.zeros(0, np.uint64), empty, empty, empty, empty
    sums = prefix(_BYTE[t.data])
    n = len(t.data) - kmer + 1
    start = np.arange(n)
    h = span_hash(sums, start, start + kmer)
    del sums
    # The smallest of 32 bits of hash, the leftmost where they are equal.
    v = (h & np.uint64(0xFFFFFFFF00000000)) | start.astype(np.uint64)
    span, have = length - kmer + 1, 1
    while have * 2 <= span:
        v = np.minimum(v[:-have], v[have:])
        have *= 2
    if have < span:
        v = np.minimum(v[:len(v) - (span - have)], v[span - have:])
    doc = np.repeat(np.arange(len(n_win)), n_win)
    win = np.arange(len(doc)) + np.repeat(t.begin - np.append(0, np.cumsum(n_win)[:-1]), n_win)
    at = (v[win] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return h[at[first]], at[first], win[first], win[last], doc[first]


def _anchor_rows(length: int, kmer: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Combiner()
        for t in pieces(batches, most=2 << 20):
            h, at, _, _, doc = _windows(t, length, kmer)
            # An anchor that returns to one place is one place.
            yield from rows.add(h, np.zeros(len(h), np.int32), t.column("id")[doc], at - t.begin[doc], len(t.data))
        yield from rows.flush()
    return run


def _context_rows(length: int, kmer: int):
    """Per document with repeated anchors: their contexts, and windows already known to start earlier."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in pieces(batches, most=2 << 20):
            at_list = t.batch.column("at")
            count = at_list.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = at_list.flatten()
            values, total = flat.field("pos").to_numpy(zero_copy_only=False), flat.field("total").to_numpy(zero_copy_only=False)
            h, at, lo, hi, doc = _windows(t, length, kmer)
            frequent = np.full(len(t.data) + 1, 0, np.int8)
            place = np.repeat(t.begin, count) + values
            frequent[place] = np.where(total > FREQUENT, 2, 1)
            kind = frequent[at]
            some = kind == 1
            g, lo1, hi1, doc1 = h[some], lo[some], hi[some], doc[some]
            many = kind == 2
            n = (hi[many] - lo[many] + 1)
            if len(n):  # windows of frequent anchors one by one
                single = np.arange(n.sum()) + np.repeat(lo[many] - np.append(0, np.cumsum(n)[:-1]), n)
                g = np.append(g, span_hash(prefix(_BYTE[t.data]), single, single + length, salt=3))
                lo1, hi1, doc1 = np.append(lo1, single), np.append(hi1, single), np.append(doc1, np.repeat(doc[many], n))
            order = np.lexsort((lo1, doc1))
            g, lo1, hi1, doc1 = g[order], lo1[order], hi1[order], doc1[order]
            ids, raw = t.column("id"), t.data.tobytes()
            # Equal contexts within the piece: the first in order of document and place stays.
            first: dict[bytes, int] = {}
            keep = np.zeros(len(g), bool)
            rank = np.lexsort((lo1, ids[doc1]))
            for k in rank:
                b = raw[lo1[k]:hi1[k] + length]
                if b not in first:
                    first[b] = k
                    keep[k] = True
            kept, known = np.flatnonzero(keep), np.flatnonzero(~keep)
            cut = lambda which: pa.array(np.searchsorted(doc1[which], np.arange(len(count) + 1)).astype(np.int32))
            rel = lo1 - t.begin[doc1]
            o1, o2 = cut(kept), cut(known)
            yield pa.RecordBatch.from_arrays([
                t.batch.column("id"), pa.ListArray.from_arrays(o1, pa.array(g[kept].astype(np.int64), pa.int64())), pa.ListArray.from_arrays(o1, pa.array(rel[kept].astype(np.int32), pa.int32())),
                pa.ListArray.from_arrays(o1, pa.array([raw[lo1[k]:hi1[k] + length] for k in kept], pa.binary())), pa.ListArray.from_arrays(o2, pa.array(rel[known].astype(np.int32), pa.int32())),
                pa.ListArray.from_arrays(o2, pa.array((hi1 - lo1 + 1)[known].astype(np.int32), pa.int32()))], names=["id", "g", "start", "context", "known", "known_n"])
    return run


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of several strings, with match lengths sampled at its run ends."""

    def __init__(self, strings: list[bytes]):
        length = np.array([len(s) for s in strings], np.int64)
        self.begin = np.append(0, np.cumsum(length + 1))  # each string is closed by a byte that is smaller than all of its own
        self.text = np.zeros(self.begin[-1], np.uint8)
        body = np.frombuffer(b"\xff".join(strings) + b"\xff", np.uint8)
        self.text[:] = body + np.uint8(1)  # 0xff, which UTF-8 never holds, becomes 0
        self.order = self._suffixes(int(length.max()) + 1 if len(length) else 1)
        before = np.append(np.uint8(0), self.text[:-1])[self.order]
        head = np.ones(len(before), bool)
        head[1:] = (before[1:] != before[:-1]) | (before[1:] == 0)
        self.heads = np.flatnonzero(head)  # the runs
        self.run_bytes = before[self.heads]
        self.samples = self.order[self.heads]

    def _suffixes(self, longest: int) -> np.ndarray:
        """Suffix order by ranks of 8 bytes, then of three (or two) such stretches together, and so on; a suffix ends with its string, and equal ones go by place."""
        n = len(self.text)
        padded = np.append(self.text, np.zeros(8, np.uint8)).astype(np.uint64)
        left = np.repeat(self.begin[1:], np.diff(self.begin)) - np.arange(n)  # bytes to the string's end, the closing one included
        value = np.zeros(n, np.uint64)
        for i in range(8):
            value = (value << np.uint64(8)) | np.where(left > i, padded[i:n + i], 0)
        rank, bits = self._ranked(value), n.bit_length()
        parts, size = (3 if 3 * bits <= 64 else 2), 8
        while size < longest and rank.max(initial=0) < n:
            joined = rank
            for k in range(1, parts):
                behind = np.zeros(n, np.uint64)
                inside = np.flatnonzero(left > size * k)
                behind[inside] = rank[inside + size * k]
                joined = (joined << np.uint64(bits)) | behind
            rank = self._ranked(joined)
            size *= parts
        return np.argsort(rank, kind="stable")

    @staticmethod
    def _ranked(value: np.ndarray) -> np.ndarray:
        """1, 2, ... in order of the values, equal ones alike."""
        order = np.argsort(value)
        new = np.ones(len(value), np.uint64)
        new[1:] = value[order[1:]] != value[order[:-1]]
        rank = np.empty(len(value), np.uint64)
        rank[order] = np.cumsum(new)
        return rank

    def match_lengths(self) -> np.ndarray:
        """For each suffix in order, the length it shares with the one before it: measured at run heads, streamed in text order between them."""
        n = len(self.text)
        ends = np.repeat(self.begin[1:] - 1, np.diff(self.begin))
        measured = np.zeros(n, np.int64)
        at = self.samples[1:] if len(self.heads) and self.heads[0] == 0 else self.samples
        prev = self.order[self.heads[self.heads > 0] - 1]
        width = int((np.diff(self.begin)).max())
        for a in range(0, len(at), 4096):
            x, y = at[a:a + 4096], prev[a:a + 4096]
            most = np.minimum(ends[x] - x, ends[y] - y)
            step = np.arange(width)
            same = self.text[np.minimum(x[:, None] + step, n - 1)] == self.text[np.minimum(y[:, None] + step, n - 1)]
            same &= step < most[:, None]
            measured[x] = np.where(same.all(axis=1), width, same.argmin(axis=1))
        is_sample = np.zeros(n, bool)
        is_sample[self.samples] = True
        place = np.maximum.accumulate(np.where(is_sample, np.arange(n), -1))
        streamed = measured[place] - (np.arange(n) - place)
        return np.maximum(streamed, 0)[self.order]

    def first_occurrences(self, length: int, owner: np.ndarray) -> np.ndarray:
        """Per byte of the text, whether the window of ``length`` bytes there equals one that stands before it in the order of ``owner`` (a number for each byte's place)."""
        match = self.match_lengths()
        n = len(self.text)
        ends = np.repeat(self.begin[1:] - 1, np.diff(self.begin))
        whole = ends[self.order] - self.order >= length
        group = np.cumsum(~((match >= length) & whole))
        keys = owner[self.order]
        least = np.full(int(group.max()) + 1 if n else 0, np.iinfo(np.int64).max)
        np.minimum.at(least, group[whole], keys[whole])
        out = np.zeros(n, bool)
        out[self.order[whole]] = keys[whole] > least[group[whole]]
        return out


def _trimmed(rows: list[tuple[int, int, bytes]], length: int) -> list[tuple[int, int, bytes]]:
    """The rows without what cannot match: a window whose hash occurs once among them is unique, so contexts are cut to their first and last other window."""
    size = np.array([len(b) for _, _, b in rows], np.int64)
    begin = np.append(0, np.cumsum(size)[:-1])
    n = size - length + 1
    start = ranges(begin, n)
    h = span_hash(prefix(_BYTE[np.frombuffer(b"".join(b for _, _, b in rows), np.uint8)]), start, start + length)
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)
    row = np.repeat(np.arange(len(rows)), n)[at]
    place = start[at] - begin[row]
    keep, first = np.unique(row, return_index=True)
    last = np.append(first[1:], len(row)) - 1
    return [(rows[k][0], rows[k][1] + int(place[f]), rows[k][2][place[f]:place[e] + length]) for k, f, e in zip(keep, first, last)] if len(at) else []


def _solve(groups: list[tuple[int, list[tuple[int, int, bytes]]]], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(document id, window start) of the windows that also start earlier, for contexts (id, start, bytes) that differ within a group."""
    rows = _trimmed(sorted((i, s, b) for _, members in groups for i, s, b in members), length)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    index = RunLengthIndex([b for _, _, b in rows])
    size = np.diff(index.begin)
    row = np.repeat(np.arange(len(rows)), size)
    inside = np.arange(len(index.text)) - index.begin[row]
    ids, starts = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
    # Places in order of (document, byte): one number for each.
    doc = np.unique(ids, return_inverse=True)[1]
    owner = (doc[row] << 40) | (starts[row] + inside)
    marked = np.flatnonzero(index.first_occurrences(length, owner))
    return ids[row[marked]], (starts[row] + inside)[marked]


def _repeat_rows(length: int):
    """Streams a partition sorted by anchor; whole anchors are indexed together, a few MB at a time."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        ready: list[tuple[int, list]] = []
        size, n_out = 0, 0
        now, contexts = None, {}

        def close():
            nonlocal size
            if len(contexts) > 1:
                ready.append((now, [(i, s, b) for b, (i, s) in contexts.items()]))
                size += sum(map(len, contexts))

        def solved():
            nonlocal ready, size
            ids, starts = _solve(ready, length)
            ready, size = [], 0
            return ids, starts, np.ones(len(ids), np.int64)

        def batch():
            nonlocal out, n_out
            ids, starts, n = (np.concatenate(x) for x in zip(*out))
            out, n_out = [], 0
            return pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(starts.astype(np.int32)), pa.array(n.astype(np.int32))], names=["id", "start", "n"])

        for b in batches:
            g, ids, starts, ctx = b.column("g").to_pylist(), b.column("id").to_pylist(), b.column("start").to_pylist(), b.column("context").to_pylist()
            known_i, known_s, known_n = [], [], []
            for k in range(len(g)):
                if g[k] != now:
                    close()
                    if size >= INDEX_BYTES:
                        out.append(solved())
                    now, contexts = g[k], {}
                place, have = (ids[k], starts[k]), contexts.get(ctx[k])
                if have is None:
                    contexts[ctx[k]] = place
                elif have != place:
                    later = max(have, place)
                    contexts[ctx[k]] = min(have, place)
                    known_i.append(later[0])
                    known_s.append(later[1])
                    known_n.append(len(ctx[k]) - length + 1)
            if known_i:
                out.append((np.array(known_i), np.array(known_s), np.array(known_n)))
            if out:
                yield batch()
        close()
        if ready:
            out.append(solved())
        if out:
            yield batch()
    return run


def _kept(length: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in pieces(batches):
            count = t.batch.column("start").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            start, size = (t.batch.column(k).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for k in ("start", "n"))
            doc = np.repeat(np.arange(len(count)), count)
            cover = np.zeros(len(t.data) + 1, np.int64)
            at = t.begin[doc] + start
            np.add.at(cover, at, 1)
            np.add.at(cover, at + size - 1 + length, -1)
            # A later copy of a whole text is gone from end to end, if it is long enough for a window.
            copy = ~t.batch.column("is_first").to_numpy(zero_copy_only=False) & (t.end - t.begin >= length)
            np.add.at(cover, t.begin[copy], 1)
            np.add.at(cover, t.end[copy], -1)
            gone = np.cumsum(cover)[:-1] > 0
            edge = np.zeros(len(gone) + 1, bool)
            edge[:-1] = gone
            edge[1:-1] &= ~gone[:-1]
            edge[t.begin[t.begin < len(gone)]] = gone[t.begin[t.begin < len(gone)]]
            n_gone, n_runs = np.append(0, np.cumsum(gone)), np.append(0, np.cumsum(edge[:-1]))
            kept = [t.data[b:e][~gone[b:e]].tobytes() for b, e in zip(t.begin, t.end)]
            yield pa.RecordBatch.from_arrays([t.batch.column("id"), pa.array(t.end - t.begin, pa.int64()), pa.array(n_gone[t.end] - n_gone[t.begin], pa.int64()), pa.array(n_runs[t.end] - n_runs[t.begin], pa.int64()), pa.array(kept, pa.binary())],
                                             names=["id", "n_bytes", "n_removed", "n_spans", "kept"])
    return run


def remove_repeats(documents: DataFrame, length: int = LENGTH, kmer: int = KMER) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary): without the bytes covered by a ``length``-byte string that also starts earlier (in a document with a smaller doc_id, or before it in the same one).

    Texts are UTF-8 bytes and matches stay within documents; what is kept may begin or end inside a character.  Null and empty texts have no bytes; texts shorter than ``length`` keep all.
    Rows that repeat a doc_id are one document, of which the least text counts, and give one row; so do rows with a null doc_id, which sort before all others.  An empty table gives
    no rows; other columns are ignored.
    """
    texts = distinct_texts(documents)
    # A later copy of a text adds no string that its first does not have; only firsts are looked into.
    firsts = texts.where(c("id") == c("first")).select("id", "text")
    places = F.collect_list(F.struct("pos", F.least("total", F.lit(1 << 30)).cast("int").alias("total")))
    anchors = table(repeated(firsts.mapInArrow(_anchor_rows(length, kmer), SCHEMA)).groupBy("id").agg(places.alias("at")))
    parts = table(firsts.join(anchors, "id").select("id", "text", "at").mapInArrow(_context_rows(length, kmer), "id long, g array<long>, start array<int>, context array<binary>, known array<int>, known_n array<int>"))
    contexts = parts.select("id", F.explode(F.arrays_zip("g", "start", "context")).alias("x")).select(c("x.g").alias("g"), "id", c("x.start").alias("start"), c("x.context").alias("context"))
    found = contexts.repartition("g").sortWithinPartitions("g").mapInArrow(_repeat_rows(length), "id long, start int, n int")
    known = parts.select("id", F.explode(F.arrays_zip("known", "known_n")).alias("x")).select("id", c("x.known").alias("start"), c("x.known_n").alias("n"))
    lists = table(found.unionByName(known).groupBy("id").agg(F.collect_list(F.struct("start", "n")).alias("r")).select("id", c("r.start").alias("start"), c("r.n").alias("n")))
    rows = texts.join(lists, "id", "left").select("id", "text", (c("id") == c("first")).alias("is_first"), "start", "n")
    out = rows.mapInArrow(_kept(length), "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.select(id_of("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")
