"""Small documents with every odd case, and plain Python versions of the operators."""

import hashlib
import random
import re

from pyspark.sql.types import LongType, StringType, StructField, StructType

rng = random.Random(7)
WORDS = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(300)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


LONG = prose(20_000, 1)
PASSAGE = prose(60, 2)
BASE = prose(400, 3)
NEAR = BASE.split()
NEAR[200] = "changed"
DOCS = [
    (1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, LONG), (6, LONG[:50_000] + " inserted " + LONG[50_000:]), (7, "word"), (8, "Word"), (9, "!!! ### $$$"), (10, "Ünïcödé ñandú 漢字 🙂 Straße " * 9), (11, BASE), (12, " ".join(NEAR)), (13, BASE.upper()),
    (14, prose(50, 4) + " " + PASSAGE + " " + prose(50, 5)), (15, prose(80, 6) + "\n" + PASSAGE + "\t" + prose(10, 7)), (16, "ab " * 200), (17, "x" * 5000), (18, "a b c"), (19, "A  b\tc"), (20, prose(35, 8)), (21, prose(34, 9) + " end"), (22, prose(35, 8)),
    (23, PASSAGE), (24, "the " * 300), (25, "\x00\x1c\x85\xa0 tail᠎ x"), (26, prose(3, 10)),
] + [(100 + i, BASE + f" tail {i}") for i in range(12)]
REPEATED = [(11, BASE), (30, "same id, one text " * 20), (30, "same id, other text " * 20), (None, "no id at all " * 20), (None, "no id at all " * 20)]
#: Columns that operators might use themselves.
CLASHING = ["id", "n", "k", "pos", "token", "window", "start", "rep", "band", "component", "at", "text_", "lang", "source"]


def frame(spark, rows, extra=True):
    """Documents with further columns of clashing names."""
    names = CLASHING if extra else []
    schema = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), *[StructField(n, StringType()) for n in names]])
    return spark.createDataFrame([(*r, *["x"] * len(names)) for r in rows], schema)


def one_text(rows):
    """One text per id, the least where ids repeat (a null first); a null id sorts before all."""
    out = {}
    for i, t in rows:
        k = -1 if i is None else i
        if k not in out or t is None or (out[k] is not None and t.encode() < out[k].encode()):
            out[k] = t
    return sorted(out.items())


def public(i):
    return None if i == -1 else i


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def spaced(text):
    return (text or "").encode().split()


def near_duplicates(rows, width, percent):
    sets = {}
    for i, t in one_text(rows):
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k:k + width]) for k in range(max(len(w) - width + 1, 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {(public(i), len(sets[i]), public(find(i)), find(i) == i) for i in ids}


def without_repeats(rows, length):
    seen, out = set(), set()
    for i, t in one_text(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if b[k:k + length] in seen:
                gone[k:k + length] = b"\1" * length
            seen.add(b[k:k + length])
        out.add((public(i), len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(x for x, g in zip(b, gone) if not g)))
    return out


def without_windows(rows, width):
    texts = [(i, spaced(t)) for i, t in one_text(rows)]
    count = {}
    for _, w in texts:
        for k in range(len(w) - width + 1):
            count[tuple(w[k:k + width])] = count.get(tuple(w[k:k + width]), 0) + 1
    out = set()
    for i, w in texts:
        gone = bytearray(len(w))
        for k in range(len(w) - width + 1):
            if count[tuple(w[k:k + width])] > 1:
                gone[k:k + width] = b"\1" * width
        out.add((public(i), len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


def contamination(rows, items, width):
    cut = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    wins = {}
    for item, t in items:
        w = cut(t)
        for k in range(max(len(w) - width + 1, 1) if w else 0):
            wins.setdefault(tuple(w[k:k + width]), set()).add(item)
    sizes = {len(w) for w in wins}
    out = []
    for i, t in rows:
        w, gone, hit = cut(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in wins:
                    gone.update(range(k, k + n))
                    hit |= wins[tuple(w[k:k + n])]
        names = sorted(str(x) for x in hit if x is not None)
        out.append((i, len(w), len(gone), len(names), sha(",".join(names)), len(gone) > 0 and 20 * len(gone) >= len(w)))
    return sorted(out, key=str)
