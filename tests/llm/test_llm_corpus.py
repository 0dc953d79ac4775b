"""Merkle manifest, token files and collocations against plain Python versions."""

import re
import zlib
from collections import Counter
from itertools import groupby

import llm_cases as K
import numpy as np
import pytest
from pyspark.sql import functions as F
from roleloom.llm import merkle, phrases, queries, token_files

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string, tree long, n long, pos long, digest string, u long, g string, o string, file string, start long"
ROWS = [(i, ["a", "b", "é", "B", ""][i % 5] if i % 7 else None, None if i % 3 else "en", len(t or "") if i % 4 else None, t) for i, t in K.DOCS if i != 4]
ROWS += [(None, "a", "en", 1, "x\ny"), (None, "a", "en", 1, "x\ny"), (None, None, None, None, None), (7, "a", "de", 2, "z\n"), (7, "a", "de", 2, "z\n"), (-5, "a", "de", 2, "\n"), (1 << 40, "alone", "de", 2, "one\nleaf")]
ROWS += [(1000 + i, "large", "en", i, f"row\n{i}") for i in range(700)]


def documents(spark, rows):
    return spark.createDataFrame([(*r, 1, 1, 1, "x", 1, "x", "x", "x", 1) for r in rows], COLUMNS)


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row):
    return K.sha("".join(map(field, row)))


def tampered(row):
    if row[4] is None or row[0] is None or zlib.crc32(str(row[0]).encode()) % 2:
        return leaf(row)
    return leaf((*row[:4], row[4].replace("\n", "")))


def climbed(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([K.sha("".join(levels[-1][i:i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def way(levels, i):
    out = []
    for level in levels[:-1]:
        low = i // 3 * 3
        out.append(("".join(level[low:i]), "".join(level[i + 1:low + 3])))
        i //= 3
    return out


def brute_manifest(rows):
    order = sorted(rows, key=lambda r: (r[1] is not None, (r[1] or "").encode(), r[0] is not None, r[0] or 0, leaf(r)))
    groups = [list(g) for _, g in groupby(order, key=lambda r: r[1])]
    trees = [climbed([leaf(r) for r in g]) for g in groups]
    top = climbed([t[-1][0] for t in trees])
    out = []
    for k, g in enumerate(groups):
        for i, r in enumerate(g):
            proof = way(trees[k], i) + way(top, k)
            h = tampered(r)
            for b, a in proof:
                h = K.sha(b + h + a)
            out.append((r[0], leaf(r), trees[k][-1][0], top[-1][0], K.sha("".join(b + a for b, a in proof)), h, h == top[-1][0]))
    return sorted(out, key=str)


def manifest(spark, rows, span):
    d = documents(spark, rows)
    t = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.regexp_replace("text", "\n", "")).otherwise(F.col("text"))
    out = merkle.manifest(d, carry={"tampered": merkle.leaf_of(*[t if k == "text" else F.col(k) for k in merkle.COLUMNS])}, span=span)
    root = merkle.fold(F.col("tampered"), F.col("before"), F.col("after"))
    got = out.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("before"), F.col("after")), 256), root, root == F.col("root"))
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("span", [3, 27, merkle.SPAN])
def test_manifest(spark, span):
    got = manifest(spark, ROWS, span)
    assert got == brute_manifest(ROWS)
    assert any(r[-1] for r in got) and not all(r[-1] for r in got)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28])
def test_manifest_of_few_leaves(spark, n):
    rows = [(i, "one", "en", 1, "t\n") for i in range(n)]
    assert manifest(spark, rows, 9) == brute_manifest(rows)


def test_manifest_of_nothing(spark):
    out = merkle.manifest(documents(spark, []), carry={"tampered": F.col("text")})
    assert out.count() == 0 and out.columns == ["doc_id", "leaf", "subroot", "root", "before", "after", "tampered"]


def test_manifest_values_do_not_run_together(spark):
    rows = [(1, "1:a", None, None, ""), (1, "1:a-", None, None, None), (11, "-", "", None, "-")]
    leaves = [r[0] for r in documents(spark, rows).select(merkle.leaf_of(*[F.col(k) for k in merkle.COLUMNS])).collect()]
    assert leaves == [leaf(r) for r in rows] and len(set(leaves)) == 3


# --- token files -------------------------------------------------------------------------------------

def vocabulary():
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


ODD = ["<|endoftext|> x<|startoftext|>y", "a b c\x0b\x0c\x1c\x85d", "é É ́x ΑΣ ΑΣ. ΣΑΣ' İstanbul", "I'll we're 'S don't's 12345 ½ ²", "​zero   line", "漢字 かな 한글 🙂👍🏽", "a\tb\r\nc\x00d", "x" * 3000, "'" * 50, " lead and trail ", "Σ.a ΑΣ'b Σ1 aΣ.", "=\u0338 <\u0338> a\u0301 A\u0300b 1\u20e3 ,\u0301x é\u0301", "don't 'tis ,'tis x''s 5's '5 l'été d'Été. «où» «où», Ça×b÷c…, —, é, É! ÿ: à1 1à a1b2 12.5", "<|ENDOFTEXT|> <| a<|endoftext|>B |>", "\xa0a\xa0, a\u2009b,", "ab\x1cc, \x7f.a"]


def token_rows():
    return K.DOCS + K.REPEATED + [(500 + i, t) for i, t in enumerate(ODD)] + [(-3, "negative id"), (1 << 62, "large id")]


def plain_ids(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(vocabulary())
    return [[*t.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]


@pytest.mark.parametrize("file_ids", [1, 500, token_files.FILE_IDS])
def test_token_files(spark, file_ids):
    rows = token_rows()
    ids = plain_ids([t for _, t in rows])
    folder = token_files.write(K.frame(spark, rows), vocabulary(), 1, file_ids=file_ids)
    back = token_files.read_documents(spark, folder).collect()
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in back) == Counter((i, np.array(x, "<u4").tobytes()) for (i, _), x in zip(rows, ids))
    order = sorted(back, key=lambda r: r["start"])
    assert [r["start"] for r in order] == [0, *np.cumsum([r["n_tokens"] for r in order])[:-1].tolist()]
    key = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in order]
    assert key == sorted(key) and all(r["n_tokens"] * 4 == len(r["ids"]) for r in back)
    catalog = token_files.catalog(spark, folder).collect()
    assert sum(r["documents"] for r in catalog) == len(rows) and sum(r["ids"] for r in catalog) == sum(map(len, ids))
    assert len(catalog) == len(rows) if file_ids == 1 else len(catalog) <= len(rows)


def test_token_positions(spark):
    folder = token_files.write(K.frame(spark, token_rows()), vocabulary(), 1, file_ids=700)
    docs = sorted(token_files.read_documents(spark, folder).collect(), key=lambda r: r["start"])
    whole = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in docs])
    asked = [0, 1, 5, 5, len(whole) - 1, len(whole), -1, None, *range(3, len(whole), 997)]
    got = token_files.locate(spark, folder, spark.createDataFrame([(p,) for p in asked], "position long")).collect()
    assert Counter(r["position"] for r in got) == Counter(p for p in asked if p is not None and 0 <= p < len(whole))
    starts = [r["start"] for r in docs]
    for r in got:
        d = docs[int(np.searchsorted(starts, r["position"], "right")) - 1]
        assert (r["doc_id"], r["doc_start"], r["doc_end"], r["id"]) == (d["doc_id"], d["start"], d["start"] + d["n_tokens"], whole[r["position"]])


def test_units_are_encoded_as_whole_texts_are():
    import pyarrow as pa
    r = np.random.default_rng(3)
    signs = list("aBz019 .,'<|>=-_\t\n\x00\x1c\x85\xa0é×÷ÀßŁσΣς漢🙂\u0301\u0338\u20e3½²İ—…«'sdtmlrev")
    texts = ["".join(r.choice(signs, int(n))) for n in r.integers(0, 60, 4000)] + ["<|endoftext|>x", "é<|startoftext|>", "", None]
    made = token_files.Encoder(vocabulary())
    want = [x[:-1] for x in plain_ids(texts)]
    for a in range(0, len(texts), 700):
        ids, n = made.encode(pa.array(texts[a:a + 700]))
        ends = np.cumsum(n)
        assert [ids[e - k:e].tolist() for e, k in zip(ends, n)] == want[a:a + 700]


def test_files_follow_each_other_whatever_their_random_names(spark):
    """Random names with "-c" and digits once hid the numbers of a task's files."""
    folder = token_files.write(K.frame(spark, token_rows()).coalesce(1), vocabulary(), 1, file_ids=700)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for f in fs.listStatus(path(folder)):
        name = f.getPath().getName()
        if name.startswith("part-"):
            head, tail = name[:len("part-00000")], name[name.rindex("-c"):]
            assert fs.rename(f.getPath(), path(f"{folder}/{head}-c7e6e0ab-c10b-4c78-c10b-62117fd9182a{tail}"))
    docs = sorted(token_files.read_documents(spark, folder).collect(), key=lambda r: r["start"])
    assert [r["start"] for r in docs] == [0, *np.cumsum([r["n_tokens"] for r in docs])[:-1].tolist()]
    assert len(token_files.catalog(spark, folder).collect()) > 8


def test_units_take_little_more_memory_than_their_text():
    import tracemalloc
    text = np.frombuffer("somewhat lengthy wordings, consisting alphabetical signatures; ".encode() * 60_000, np.uint8)
    begin = np.arange(0, len(text), 1000)
    tracemalloc.start()
    try:
        start, found = token_files.units(text, begin)
        assert tracemalloc.get_traced_memory()[1] < 17 * len(text)
    finally:
        tracemalloc.stop()
    assert len(found) == len(start) and found[0].as_py() == "somewhat"


def test_the_library_gets_few_units_at_once():
    import pyarrow as pa
    made, most = token_files.Encoder(vocabulary()), []

    class Counting:
        def encode_batch_fast(self, texts, **how):
            most.append(len(texts))
            return library.encode_batch_fast(texts, **how)
    library, made.tokenizer = made.tokenizer, Counting()
    texts = [" ".join(f"{a}{b}q" for b in "abcdefghijklmnopqrstuvwxyz") for a in map("".join, [(x, y, z) for x in "abcdefgh" for y in "abcdefghi" for z in "abcdefgh"])]
    ids, n = made.encode(pa.array(texts))
    assert len(made.known) > token_files.GIVEN >= max(most)
    assert [ids[e - k:e].tolist() for e, k in zip(np.cumsum(n)[:20], n)] == [x[:-1] for x in plain_ids(texts[:20])]


def test_no_token_files(spark):
    folder = token_files.write(K.frame(spark, []), vocabulary(), 1)
    assert token_files.read_documents(spark, folder).count() == 0 and token_files.catalog(spark, folder).count() == 0


@pytest.mark.parametrize("counts", [[1], [1] * 1000, [1, 100_000, 1, 1, 7], [5000] * 3, list(range(1, 700))])
def test_boundaries(counts):
    counts = np.array(counts)
    content = token_files.image([None] * len(counts), counts, np.zeros(counts.sum(), "<u2").tobytes(), 2) + b"\n"
    f = token_files.File.read(content)
    ends = np.cumsum(counts)
    assert (f.boundaries.ends() == ends).all() and [f.boundaries.end(i) for i in range(len(ends))] == ends.tolist()
    for p in {0, int(ends[-1]) - 1, int(ends[0]), int(ends[len(ends) // 2]) - 1} - {int(ends[-1])}:
        assert f.boundaries.holding(p) == np.searchsorted(ends, p, "right")
    bits = 8 * (len(f.boundaries.low) + len(f.boundaries.high) + 4 * len(f.boundaries.samples))
    assert bits <= len(counts) * (3.5 + max(np.log2(ends[-1] / len(counts)), 0)) + 64
    with pytest.raises(ValueError):
        token_files.File.read(content[:-3] + b"xx\n")


# --- collocations ------------------------------------------------------------------------------------

def brute_phrases(rows, longest, least, percent, best):
    count, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                count.update((lang, tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    candidates = {p: a for p, a in count.items() if len(p[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in candidates.items():
        score, _, l, r = min((10 ** 6 * a * a // (count[lang, p[:k]] * count[lang, p[k:]]), k, count[lang, p[:k]], count[lang, p[k:]]) for k in range(1, len(p)))
        if any(o == lang and len(q) > len(p) and 100 * b >= percent * a and any(q[i:i + len(p)] == p for i in range(len(q))) for (o, q), b in candidates.items()):
            continue
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:best]))


def phrase_rows():
    r = np.random.default_rng(11)
    words = ["New", "york", "the", "of", "é", "漢", "x-y", "\x00", "a b", "(q)"]
    def text(n):
        return "".join(words[min(int(x), 9)] + sep for x, sep in zip(r.geometric(0.3, n) - 1, r.choice([" ", "\t", "  ", ". ", ",", "\n", "\r\n", "! ", " ;"], n, p=[.6, .1, .1, .05, .03, .04, .03, .03, .02])))
    rows = [(["en", "de", None, "und", ""][i % 5], text(int(r.integers(0, 120)))) for i in range(150)]
    return rows + [("en", None), (None, ""), ("en", " \t. , "), ("en", "the of " * 3000), ("fr", "once only words"), ("de", "the of New york"), ("en", "a" * 4000 + " b")] + [("en", "big city life")] * 12


@pytest.mark.parametrize("longest,least,percent,best,bits", [(3, 10, 50, 2000, 27), (3, 3, 50, 5, 6), (4, 4, 90, 40, 8), (2, 10, 50, 2000, 12)])
def test_collocations(spark, longest, least, percent, best, bits):
    rows = phrase_rows()
    d = spark.createDataFrame([(i, lang, t, "x", 1, 1, "x", 1, 1) for i, (lang, t) in enumerate(rows)], "doc_id long, lang string, text string, phrase string, n long, k long, word string, key long, f long").repartition(5)
    got = sorted(map(tuple, phrases.collocations(d, longest, least, percent, best, bits).collect()))
    assert got == brute_phrases(rows, longest, least, percent, best) and len(got) > 5


def test_collocations_of_nothing(spark):
    d = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(d).count() == 0
    assert phrases.collocations(spark.createDataFrame([("en", None), (None, "one word")], "lang string, text string")).count() == 0


def test_large_counts_are_exact(spark):
    """Products of counts beyond 64 bits."""
    a, l, r = 4_000_000_007, 6_000_000_011, 5_000_000_029
    top = "cast(cast(a AS decimal(19,0)) * cast(a AS decimal(19,0)) AS decimal(32,0)) * cast(1000000 AS decimal(7,0))"
    got = spark.sql(f"SELECT cast({top} AS decimal(38,0)) div cast(cast(l AS decimal(19,0)) * cast(r AS decimal(19,0)) AS decimal(38,0)) s FROM VALUES ({a}L, {l}L, {r}L) t(a, l, r)").first()["s"]
    assert got == 10 ** 6 * a * a // (l * r)


def test_token_file_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect(), key=lambda r: r["doc_id"])
    ids = plain_ids([r["text"] for r in rows])
    start, want = 0, []
    for r, x in zip(rows, ids):
        want.append((r["doc_id"], start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    assert sorted(map(tuple, queries.op12_token_files(spark, sf).collect())) == want
