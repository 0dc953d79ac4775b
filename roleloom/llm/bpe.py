"""Byte-level BPE by merge replay over the vocabulary of a batch.

The pretokens of a batch are made distinct first.  An inverted index maps the pairs, by
the rank of their merge, to their positions in those words; merges are then replayed in
rank order, over all words at once, and only the two neighbours of a merged position
change.  Every document is then the concatenation of its words' tokens.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._text import flat, ranges

#: Words and their bytes that a Python worker remembers between batches; beyond either it starts anew.
REMEMBERED, REMEMBERED_BYTES = 600_000, 16 << 20
#: Bytes of text encoded together.
BATCH_BYTES = 8 << 20
#: Words longer than this are replayed one by one, with a heap, in n log n steps.
LONG_WORD = 200
#: Ranks whose positions are looked at together.
WINDOW = 1024
NONE = np.int64(1 << 40)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _pattern(pattern: str):
    """The pattern with Unicode's own white space, which is what the reference tokenizer's engine means by \\s."""
    import regex
    return regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


class Replay:
    """Merges of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        ids = sorted(ranks.values())
        self.spelled = {i: b for b, i in ranks.items()}
        self.size = np.zeros(ids[-1] + 1, np.int64)
        self.size[ids] = [len(self.spelled[i]) for i in ids]
        self.start = np.append(0, np.cumsum(self.size)[:-1])
        self.letters = np.frombuffer(b"".join(self.spelled[i] for i in ids), np.uint8)
        # Every pair of tokens that makes a token, whichever way it is cut.
        pairs = [((ranks[b[:k]] << 32) | ranks[b[k:]], i) for b, i in ranks.items() for k in range(1, len(b)) if b[:k] in ranks and b[k:] in ranks]
        self.pair_key, self.pair_rank = (np.array(x, np.int64) for x in zip(*sorted(pairs))) if pairs else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.pairs = dict(pairs)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that two make together, NONE if they make none."""
        key = (a << 32) | b
        at = np.searchsorted(self.pair_key, key)
        at[at == len(self.pair_key)] = 0
        if not len(self.pair_key):
            return np.full(len(a), NONE)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], NONE)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each)."""
        sizes = np.array([len(w) for w in words], np.int64)
        whole = np.array([self.ranks.get(w, -1) for w in words], np.int64)
        short = np.flatnonzero((whole < 0) & (sizes <= LONG_WORD))
        text = np.frombuffer(b"".join(words), np.uint8)
        starts = np.append(0, np.cumsum(sizes)[:-1]).astype(np.int64)
        word = np.repeat(short, sizes[short])
        sym = self._replay(self.single[text[ranges(starts[short], sizes[short])]], word)
        alive = sym >= 0
        ids, owner = [sym[alive], whole[whole >= 0]], [word[alive], np.flatnonzero(whole >= 0)]
        for i in np.flatnonzero((whole < 0) & (sizes > LONG_WORD)):
            made = self._one(words[i])
            ids.append(np.array(made, np.int64))
            owner.append(np.full(len(made), i))
        owned = np.concatenate(owner)
        return np.concatenate(ids)[np.argsort(owned, kind="stable")], np.bincount(owned, minlength=len(words))

    def _replay(self, sym: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Symbols after all merges, -1 where one was merged into its left neighbour.  ``word`` numbers the word of each symbol."""
        n = len(sym)
        if not n:
            return sym
        top = int(self.pair_rank.max(initial=0)) // WINDOW + 1
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        nxt[edge - 1], nxt[n - 1], prv[edge], prv[0] = -1, -1, -1, -1
        cur = np.full(n, NONE)  # the merge rank of the pair that begins at each symbol
        inner = np.flatnonzero(nxt >= 0)
        cur[inner] = self.rank(sym[inner], sym[inner + 1])
        index: list[list[np.ndarray]] = [[] for _ in range(top)]  # window of ranks -> positions of its pairs

        def note(at: np.ndarray) -> None:
            w = cur[at] // WINDOW
            order = np.argsort(w, kind="stable")
            at, w = at[order], w[order]
            cuts = np.flatnonzero(np.append(True, w[1:] != w[:-1])) if len(w) else []
            for x, y in zip(cuts, np.append(cuts[1:], len(w)) if len(w) else []):
                index[w[x]].append(at[x:y])

        note(np.flatnonzero(cur < NONE))
        for k in range(top):
            limit = (k + 1) * WINDOW
            work = np.concatenate(index[k]) if index[k] else np.zeros(0, np.int64)
            while len(work):
                work = work[cur[work] < limit]
                # The lowest rank of each word, the leftmost of equals; a position noted twice is one.
                work = work[np.lexsort((work, cur[work], word[work]))]
                twice = np.zeros(len(work), bool)
                twice[1:] = work[1:] == work[:-1]
                work = work[~twice]
                first = np.ones(len(work), bool)
                first[1:] = word[work[1:]] != word[work[:-1]]
                i, rest = work[first], work[~first]
                j = nxt[i]
                sym[i], sym[j], cur[j] = cur[i], -1, NONE
                after = nxt[j]
                nxt[i] = after
                some = after >= 0
                prv[after[some]] = i[some]
                cur[i] = NONE
                cur[i[some]] = self.rank(sym[i[some]], sym[after[some]])
                before = prv[i]
                has = before >= 0
                before, right = before[has], i[has]
                cur[before] = self.rank(sym[before], sym[right])
                touched = np.concatenate([i, before])
                soon = cur[touched] < limit
                note(touched[~soon & (cur[touched] < NONE)])
                work = np.concatenate([rest, touched[soon]])
            index[k] = []
        return sym

    def _one(self, word: bytes) -> list[int]:
        """Tokens of one word: the same replay with a heap of (rank, position)."""
        sym, n = self.single[np.frombuffer(word, np.uint8)].tolist(), len(word)
        nxt, prv, pairs = list(range(1, n)) + [-1], list(range(-1, n - 1)), self.pairs
        heap = [(r, i) for i in range(n - 1) if (r := pairs.get((sym[i] << 32) | sym[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = nxt[i]
            if sym[i] < 0 or j < 0 or pairs.get((sym[i] << 32) | sym[j]) != r:
                continue
            sym[i], sym[j] = r, -1
            nxt[i] = after = nxt[j]
            if after >= 0:
                prv[after] = i
                if (q := pairs.get((r << 32) | sym[after])) is not None:
                    heapq.heappush(heap, (q, i))
            if (before := prv[i]) >= 0 and (q := pairs.get((sym[before] << 32) | r)) is not None:
                heapq.heappush(heap, (q, before))
        return [s for s in sym if s >= 0]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes that the ids stand for."""
        return self.letters[ranges(self.start[ids], self.size[ids])]


class _Index(dict):
    """Numbers words in the order in which they are first met."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Encoder:
    """A Python worker's replay, with the words that it has already encoded."""

    def __init__(self, path: str, pattern: str):
        self.replay, self.split = Replay(load_ranks(path)), _pattern(pattern)
        self._forget()

    def _forget(self) -> None:
        self.index, self.ids, self.count, self.bytes = _Index(), np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each); the words of all of them are encoded together."""
        if len(self.index) > REMEMBERED or self.bytes > REMEMBERED_BYTES:
            self._forget()
        n_words, where = np.zeros(len(texts), np.int64), []
        for i, t in enumerate(texts):
            words = self.split.findall(t)
            n_words[i] = len(words)
            where.append(np.fromiter(map(self.index.__getitem__, words), np.int64, len(words)))
        new = [w.encode() for w in self.index.new]
        self.index.new.clear()
        if new:
            ids, count = self.replay.encode(new)
            self.ids, self.count, self.bytes = np.append(self.ids, ids), np.append(self.count, count), self.bytes + sum(map(len, new))
        start = np.append(0, np.cumsum(self.count))[:-1]
        at = np.concatenate(where) if where else np.zeros(0, np.int64)
        ids = self.ids[ranges(start[at], self.count[at])]
        ends = np.append(0, np.cumsum(self.count[at]))[np.cumsum(n_words)]
        return ids, np.diff(np.append(0, ends))


_MADE: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    if (path, pattern) not in _MADE:
        _MADE[path, pattern] = Encoder(path, pattern)
    return _MADE[path, pattern]


def _groups(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    _, offsets = flat(batch.column(text))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BATCH_BYTES, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def encode(documents: DataFrame, path: str, pattern: str, keep_ids: bool = True) -> DataFrame:
    """Token ids of every text: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ``ids``.

    ids_sha256 covers the ids as little-endian 32-bit integers, decoded_sha256 the bytes that the ids stand for.  A null text is empty;
    an empty text has no tokens; one row per input row, repeated rows alike; an empty table gives none; other columns are ignored.
    ``path`` names the rank file, which every executor reads once.
    """
    fields = [pa.field("doc_id", pa.int64()), pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())] + [pa.field("ids", pa.list_(pa.int32()))] * keep_ids
    schema = pa.schema(fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(path, pattern)
        for batch in batches:
            for part in _groups(batch, "text"):
                ids, n = made.encode([t or "" for t in part.column("text").to_pylist()])
                stop = np.cumsum(n)
                each = [ids[b - k:b] for b, k in zip(stop, n)]
                sha = [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in each]
                back = [hashlib.sha256(made.replay.decode(x).tobytes()).hexdigest() for x in each]
                columns = [part.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, stop).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)


def decode(ids: list[int], path: str) -> bytes:
    return Replay(load_ranks(path)).decode(np.array(ids, np.int64)).tobytes()
