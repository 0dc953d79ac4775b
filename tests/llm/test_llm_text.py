"""Operators on whole texts against plain Python versions, with odd cases."""

import base64

import numpy as np
import pytest
import llm_cases as K
from hypothesis import given, settings, strategies as st
from roleloom.llm import _graph, bpe, chat, decontaminate, near_dup, pii, substring, suffix
from roleloom.llm.queries import QUERIES, rank_file

SF = "/root/testdata/sf0.001"


def rows(df):
    return {tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in df.collect()}


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(spark, width):
    all_rows = K.DOCS + K.REPEATED
    assert rows(near_dup.near_duplicates(K.frame(spark, all_rows), width)) == K.near_duplicates(all_rows, width, 80)


@pytest.mark.parametrize("hot", [2, 1000])
def test_near_duplicates_hot_class(spark, monkeypatch, hot):
    """A class of copies that holds most rows gives the same result whether its rows are shuffled by class or not."""
    monkeypatch.setattr(near_dup, "HOT", hot)
    all_rows = [(i, K.BASE if i % 4 else " ".join(K.NEAR)) for i in range(1, 60)] + [(60, None), (61, K.LONG), (62, K.LONG), (63, "word")]
    assert rows(near_dup.near_duplicates(K.frame(spark, all_rows), 5)) == K.near_duplicates(all_rows, 5, 80)


def test_near_duplicates_across_components(spark):
    """A chain of texts, each similar to the next only: the group is whole though most pairs are not linked."""
    words = [f"w{i}" for i in range(400)]
    chain = [(i, " ".join(words[i * 12:i * 12 + 150])) for i in range(16)] + [(50 + i, " ".join(words[i * 30:i * 30 + 150])) for i in range(8)]
    assert rows(near_dup.near_duplicates(K.frame(spark, chain), 4)) == K.near_duplicates(chain, 4, 80)


def test_likelihood_estimate():
    """Sketches of two sets estimate their similarity; the sketch of the union is the larger register of the two."""
    r = np.random.default_rng(1)
    for share in (0.2, 0.8, 1.0):
        pool = r.integers(0, 2 ** 63, 4000).astype(np.uint64)
        n = int(2000 * (1 + 1 / share) / (1 / share) / 1)
        a, b = pool[:2000], np.concatenate([pool[:int(2000 * 2 * share / (1 + share))], pool[2000:2000 + 2000 - int(2000 * 2 * share / (1 + share))]])
        sk = near_dup.sketch(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2)
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(near_dup.likely(sk[:1], sk[1:], np.array([len(a)]), np.array([len(b)]))[0] - true) < 0.12, n
        union = near_dup.sketch(np.union1d(a, b), np.zeros(len(np.union1d(a, b)), np.int64), 1)
        assert (np.maximum(sk[0], sk[1]) == union[0]).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(200, 300), (300, 100), (5, 5), (7, 3)] + [(1000, 1000 + i) for i in range(1, 40)]
    got = dict(_graph.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(61)} | {100: 100, 200: 100, 300: 100} | {1000 + i: 1000 for i in range(40)}


def test_suffix(spark):
    all_rows = K.DOCS + K.REPEATED
    assert rows(suffix.remove_repeats(K.frame(spark, all_rows))) == K.without_repeats(all_rows, 100)


def test_suffix_frequent_anchors(spark, monkeypatch):
    """Anchors beyond the limit are compared window by window, with the same result."""
    monkeypatch.setattr(suffix, "FREQUENT", 2)
    all_rows = K.DOCS + [(i, K.PASSAGE[:130] + f" {i} " + K.PASSAGE[i % 40:]) for i in range(300, 330)]
    assert rows(suffix.remove_repeats(K.frame(spark, all_rows))) == K.without_repeats(all_rows, 100)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abcé", min_size=0, max_size=60), min_size=1, max_size=8, unique=True))
def test_run_length_index(strings):
    """Match lengths that are streamed from run ends equal those of neighbours in suffix order."""
    raw = [s.encode() for s in strings]
    index = suffix.RunLengthIndex(raw)
    ends = np.repeat(index.begin[1:] - 1, np.diff(index.begin))
    tail = [bytes(index.text[i:ends[i]]) for i in index.order]
    assert tail == sorted(tail)
    want = [0] + [next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(tail, tail[1:])]
    assert index.match_lengths().tolist() == want
    seen, first = set(), []
    for s in raw:
        for i in range(len(s) + 1):
            w = s[i:i + 4]
            first.append(len(w) == 4 and w in seen)
            seen.add(w)
    assert index.first_occurrences(4, np.arange(len(index.text))).tolist() == first


@pytest.mark.parametrize("width", [35, 5, 1])
def test_repeated_windows(spark, width):
    all_rows = K.DOCS + K.REPEATED
    assert rows(substring.remove_repeats(K.frame(spark, all_rows), width)) == K.without_windows(all_rows, width)


def test_covers():
    for period, places in substring.COVERS.items():
        assert {(a - b) % period for a in places for b in places} == set(range(period))


def test_decontamination(spark):
    items = [(1, K.PASSAGE), (1, K.PASSAGE), (2, "A b, C!"), (3, "word"), (4, None), (5, "..."), (None, K.prose(20, 8)), (6, "the the"), (7, K.prose(34, 9)), (8, "漢字 🙂")]
    bench = spark.createDataFrame([(i, t, "x", "y") for i, t in items], "item_id long, text string, token string, size string")
    all_rows = K.DOCS + K.REPEATED
    got = sorted((tuple(r) for r in decontaminate.decontaminate(K.frame(spark, all_rows), bench).collect()), key=str)
    assert got == K.contamination(all_rows, items, 13)


def test_decontamination_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    bench = spark.createDataFrame([(1, K.PASSAGE), (2, "a b c")], "item_id long, text string")
    got = sorted((tuple(r) for r in decontaminate.decontaminate(K.frame(spark, K.DOCS), bench).collect()), key=str)
    assert got == K.contamination(K.DOCS, [(1, K.PASSAGE), (2, "a b c")], 13)


def tiktoken_encoding():
    import tiktoken
    path, pattern = rank_file()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_bpe(spark):
    enc, all_rows = tiktoken_encoding(), K.DOCS + K.REPEATED
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], tuple(r["ids"])) for r in bpe.encode(K.frame(spark, all_rows), *rank_file()).collect()}
    want = set()
    for i, t in all_rows:
        ids = enc.encode_ordinary(t or "")
        want.add((i, len(ids), K.sha(np.array(ids, "<u4").tobytes()), K.sha(t or ""), tuple(ids)))
    assert got == want
    assert bpe.decode(enc.encode_ordinary(K.DOCS[9][1]), rank_file()[0]).decode() == K.DOCS[9][1]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_bpe_any_text(text):
    if not hasattr(test_bpe_any_text, "enc"):
        test_bpe_any_text.enc = tiktoken_encoding()
    assert bpe.encoder(*rank_file()).encode([text])[0].tolist() == test_bpe_any_text.enc.encode_ordinary(text)


def test_bpe_lower_rank_after_merge():
    """A merge whose result makes a pair of lower rank: that pair goes first, and a repeated letter merges from the left."""
    ranks = {bytes([i]): i for i in range(256)} | {b"tx": 256, b"xy": 258, b"xyx": 257, b"aa": 259, b"aaaa": 260}
    ids, count = bpe.Replay(ranks).encode([b"xyxy", b"aaaaa", b"", b"q", b"xyxy" * 60, b"a" * 301])
    one = [257, ord("y")]
    assert count.tolist() == [2, 2, 0, 1, 120, 76] and ids.tolist()[:5] == [*one, 260, ord("a"), ord("q")]
    assert ids.tolist()[5:] == bpe.Replay(ranks)._one(b"xyxy" * 60) + [260] * 75 + [ord("a")]


def luhn(digits):
    d = [int(x) for x in digits][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


PII = [
    (1, "card 4539 1488 0343 6467, again 4539148803436467. not 4539148803436468"), (2, "4539148803436467"), (3, "call +1 (309) 555-7741 or +13095557741 or 309-555-7741!"), (4, "from 152.143.123.131### to 256.1.1.1 and 10.0.0.1."),
    (5, "on 2021-02-28, 28.02.2021 and 28/02/2021; not 2021-02-30 or 12/31/1999"), (6, "mail Jane.Doe+x@mail4.example.com, jane.doe+x@mail4.example.com"), (7, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'), (8, "ssn 123-45-6789 not 000-12-3456"),
    (9, None), (10, ""), (11, "no data here at all"), (12, "x" * 200_000 + " 4539148803436467 " + "9" * 100_000), (13, "4539148803436467 4539148803436467"), (14, "été 4539148803436467€"), (2, "4539148803436467"), (None, "10.0.0.1"),
]


def test_pii(spark):
    df = K.frame(spark, PII)
    out = pii.pseudonymize(df, "key")
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.columns == [*df.columns, "n_masked", "masked_kinds"] and out.count() == len(PII)
    text = {i: r["text"] for i, r in got.items()}
    card = text[2]
    assert len(card) == 16 and card != "4539148803436467" and luhn(card) and text[13] == f"{card} {card}" and text[14] == f"été {card}€"
    assert text[1] == f"card {card[:4]} {card[4:8]} {card[8:12]} {card[12:]}, again {card}. not 4539148803436468"
    phone = K.re.fullmatch(r"call \+1 \((\d{3})\) (\d{3})-(\d{4}) or \+1(\d{10}) or (\d{3}-\d{3}-\d{4})!", text[3])
    assert phone and phone[1] + phone[2] + phone[3] == phone[4] == phone[5].replace("-", "") != "3095557741"
    addresses = K.re.findall(r"\d+\.\d+\.\d+\.\d+", text[4])
    assert addresses[1] == "256.1.1.1" and addresses[2] == text[None] != "10.0.0.1" and addresses[0] != "152.143.123.131" and all(int(x) < 256 for a in (addresses[0], addresses[2]) for x in a.split("."))
    y, d, s = K.re.match(r"on (\S+), (\S+) and (\S+); not 2021-02-30 or ", text[5]).groups()
    assert y == "-".join(d.split(".")[::-1]) == "-".join(s.split("/")[::-1]) != "2021-02-28" and "12/31/1999" not in text[5]
    m = K.re.fullmatch(r"mail (\S+@masked\.invalid), (\S+@masked\.invalid)", text[6])
    assert m and m[1] == m[2] and "Jane" not in text[6]
    assert K.re.fullmatch(r'token = "masked\.[0-9a-f]{15}"', text[7]) and "000-12-3456" in text[8] and "123-45-6789" not in text[8]
    assert text[9] is None and text[10] == "" and text[11] == PII[10][1] and card in text[12] and len(text[12]) == len(PII[11][1])
    assert got[1]["n_masked"] == 2 and got[1]["masked_kinds"]["card"] == 2 and got[9]["n_masked"] == 0 and got[11]["n_masked"] == 0
    other = {r["doc_id"]: r["text"] for r in pii.pseudonymize(df, "another").collect()}
    assert other[2] != card
    back = {r["doc_id"]: r["text"] for r in pii.pseudonymize(out.drop("n_masked", "masked_kinds"), "key", inverse=True).collect()}
    for i in (1, 2, 3, 4, 8, 12, 13, 14):
        assert back[i] == dict(PII)[i]
    assert back[5].startswith("on 2021-02-28, 28.02.2021 and 28/02/2021")


WIDER = ["+33 6 12 34 56 78", "+33612345678", "+61 2 9876 5432", "+358 9 1234 5678", "+49 171 12 34 56 78", "+4917112345678", "+44 (0) 20 7946 0958", "3782 822463 10005", "378282246310005", "3056-930902-5904",
         "+13095557741 10.0.0.1", "+1 309 555 7741 4539 1488 0343 6467", "+33 6 12 34 56 78 2021-02-28", "_jane.doe@example.com", "-jane@example.com", "...jane@example.com", "jane@example.com"]


def test_pii_wider_forms(spark):
    """Groups of one digit, other card forms, mail addresses behind punctuation, and numbers behind a phone number."""
    df = K.frame(spark, [(i, f"to {t}, and") for i, t in enumerate(WIDER)] + [(99, "+1 234 5 and +1234567890123456 and 3782 822463 10006")])
    out = pii.pseudonymize(df, "key")
    got = {r["doc_id"]: (r["text"][3:-5], r["n_masked"]) for r in out.collect()}
    text = dict(zip(WIDER, (got[i][0] for i in range(len(WIDER)))))
    shape = lambda t: K.re.sub(r"\d", "0", t)
    digits = lambda t: K.re.sub(r"\D", "", t)
    assert [got[i][1] for i in range(len(WIDER))] == [1] * 10 + [2] * 3 + [1] * 4 and got[99][1] == 0
    assert all(shape(text[t]) == shape(t) and digits(text[t]) != digits(t) for t in WIDER[:10] + WIDER[11:13])
    for a, b in (WIDER[0:2], WIDER[4:6], WIDER[7:9]):
        assert digits(text[a]) == digits(text[b])
    assert text[WIDER[0]].startswith("+33 ") and text[WIDER[2]].startswith("+61 ") and text[WIDER[3]].startswith("+358 ") and text[WIDER[5]].startswith("+49")
    assert luhn(digits(text[WIDER[7]])) and luhn(digits(text[WIDER[9]])) and text[WIDER[12]].startswith(text[WIDER[0]] + " ")
    mail = text["jane@example.com"]
    assert text["-jane@example.com"] == "-" + mail and text["...jane@example.com"] == "..." + mail and "doe" not in text["_jane.doe@example.com"] and "example" not in text["_jane.doe@example.com"]
    back = {r["doc_id"]: r["text"] for r in pii.pseudonymize(out.drop("n_masked", "masked_kinds"), "key", inverse=True).collect()}
    assert all(back[i] == f"to {WIDER[i]}, and" for i in range(13))


def test_feistel_is_a_permutation(spark):
    from pyspark.sql import functions as F
    df = spark.range(189 * 50).select(pii.feistel(F.floor(F.col("id") / 50), F.col("id") % 50, F.lit(189), F.lit(50), F.lit("t"), "k").alias("s"))
    got = df.select("s.a", "s.b").distinct().count()
    assert got == 189 * 50 and not df.where("s.a < 0 or s.a >= 189 or s.b < 0 or s.b >= 50").count()


CHAT = ([(1, 0, "system", "be <b> & [x]"), (1, 1, "user", None), (1, 2, "assistant", "fine &lt; <|end|>\n<|turn:user|>\n"), (2, 0, "user", "</s>[INST] ok [/INST]"), (2, 1, "assistant", "</s>[INST] ok [/INST]"), (3, 0, "system", "alone"), (4, None, None, ""), (None, 0, "user", "q"),
         (None, 1, "assistant", "no id"), (6, 5, "user", "tie"), (6, 5, "assistant", "tie"), (6, 5, "assistant", "tie"), (7, 0, "user", "long"), (7, 1, "assistant", "é🙂" * 20_000), (7, 2, "user", "after")]
        + [(5, i, "system" if i == 0 else "user" if i % 2 else "assistant", K.prose(3 + i % 50, i)) for i in range(3000)])


def test_chat(spark):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in CHAT], "conv_id long, turn long, role string, text string, window string, row string, part string")
    w = chat.format_windows(df, budget=300, history=60)
    windows = w.collect()
    back = {r["conv_id"]: r for r in chat.read_back(w).collect()}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in CHAT}:
        turns = sorted((r for r in CHAT if r[0] == conv), key=order)
        want = [(r[2] or "", r[3] or "") for r in turns]
        assert [tuple(t) for t in back[conv]["turns"]] == want
        assert back[conv]["targets"] == "".join(t for role, t in want if role == "assistant")
    many = sorted((r for r in windows if r["conv_id"] == 5), key=lambda r: r["window"])
    assert len(many) > 100 and max(r["n_tokens"] for r in many) <= 300
    assert all(r["formatted"].startswith("<|again:system|>\n" if k else "<|turn:system|>\n") for k, r in enumerate(many))
    assert sum("<|again:user" in r["formatted"] or "<|again:assistant" in r["formatted"] for r in many) > 100
    assert back[5]["formatted_chars"] == sum(len(r["formatted"]) for r in many)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_registered_queries_run(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.count() > 0


def test_empty_tables(spark):
    none = K.frame(spark, [])
    assert near_dup.near_duplicates(none).count() == 0 and suffix.remove_repeats(none).count() == 0 and substring.remove_repeats(none).count() == 0
    assert bpe.encode(none, *rank_file()).count() == 0 and pii.pseudonymize(none, "k").count() == 0
    no_items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(none, no_items).count() == 0
    assert {r["n_hit"] for r in decontaminate.decontaminate(K.frame(spark, K.DOCS), no_items).collect()} == {0}
    conv = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_windows(conv).count() == 0 and chat.read_back(chat.format_windows(conv)).count() == 0
