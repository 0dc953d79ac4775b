"""Trained operators by held-out accuracy, top-k by brute force, and the pipeline stage by stage."""

import duckdb
import llm_cases as K
import numpy as np
import pytest
from pyspark.sql import functions as F
from roleloom.llm import knn, language, quality, queries
from roleloom.llm._work import held_out, read

import corpus_pipeline as P

SF = "/root/testdata/sf0.01"


def test_language(spark):
    truth = {r["doc_id"]: r["lang"] for r in read(spark, SF, "documents").select("doc_id", "lang").collect()}
    got = queries.op1_language(spark, SF).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(truth) and 0.2 < len(held) / len(got) < 0.3
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.98 and all(0 <= r["score"] <= 1 for r in got)


def test_language_odd_cases(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "text", None), (5, "", "de"), (None, "the end of the day", "en")]
    train = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, bucket string")
    names, matrix = language.train(train)
    assert names == ["de", "en"]
    got = {r["doc_id"]: r for r in language.predict(K.frame(spark, K.DOCS + K.REPEATED), names, matrix).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1, 2, 3, 9)) and got[24]["lang_pred"] == "en"
    assert language.predict(K.frame(spark, K.DOCS + K.REPEATED), names, matrix).count() == len(K.DOCS + K.REPEATED)
    again = language.train(train.repartition(5, "text"))[1]
    assert (again == matrix).all()
    nothing = language.train(train.limit(0))
    assert nothing[0] == [] and {r["lang_pred"] for r in language.predict(K.frame(spark, K.DOCS), *nothing).collect()} == {"und"}
    assert language.predict(K.frame(spark, []), names, matrix).count() == 0


def test_a_text_scores_alike_alone_and_behind_others(spark):
    texts = ["3 cat", "dog", "- the end", "", "x1", "'s Haus", None, "  la fin.", "ende"]
    train = spark.createDataFrame([(i, t, ["en", "de", "fr"][i % 3]) for i, t in enumerate(["the cat and the dog", "der hund, das haus und das ende", "la fin du chat", "an end", "ein haus", "le chat"])], "doc_id long, text string, lang string")
    model = language.train(train)

    def scored(rows):
        df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        return {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(df, *model).collect()}
    alone = {}
    for i, t in enumerate(texts):
        alone |= scored([(i, t)])
    rows = list(enumerate(texts))
    assert scored(rows) == scored(rows[::-1]) == alone

    def grams(t):  # a text's n-grams by hand: letters in lower case, other runs behind a letter as one space
        out, last = "", ""
        for ch in t:
            if ch.isalpha():
                out += ch.lower()
            elif last.isalpha():
                out += " "
            last = ch
        return [out[a:a + n] for n in language.ORDERS for a in range(len(out) - n + 1) if n > 1 or out[a] != " "]
    from roleloom.llm._text import pieces
    import pyarrow as pa
    for t in texts[:3] + ["Ab  c.d", "..", "é1é"]:
        piece = next(pieces([pa.RecordBatch.from_pydict({"text": ["zz", t]})]))
        bucket, doc, has = language._grams(piece)
        assert (doc == 1).sum() == len(grams(t)) and len(set(bucket[doc == 1])) == len(set(grams(t))) and has[1] == any(ch.isalpha() for ch in t)


def test_quality(spark):
    label = {r["doc_id"]: r["quality"] for r in read(spark, SF, "labels").collect()}
    got = queries.op2_quality(spark, SF).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] in label]
    good, bad = ([r["score"] for r in held if label[r["doc_id"]] == k] for k in (1, 0))
    assert np.mean([x > y for x in good for y in bad]) > 0.95 and np.mean([x >= 0.7 for x in good]) > 0.95 and np.mean([y < 0.7 for y in bad]) > 0.8
    assert all(r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in got)


def test_quality_odd_cases(spark):
    labelled = spark.createDataFrame([(i, K.prose(100, i) if i % 2 else "!!! " + K.prose(60, i).upper(), i % 2, "x") for i in range(60)] + [(99, None, 1, "x"), (98, "t", None, "x"), (97, "", 0, "x")], "doc_id long, text string, quality int, piece string")
    model = quality.train(labelled.drop("quality"), labelled.drop("text"))
    df = K.frame(spark, K.DOCS + K.REPEATED)
    out = quality.score(df, model)
    assert out.columns == [*df.columns, "quality_score"] and out.count() == len(K.DOCS + K.REPEATED) and not out.where("quality_score IS NULL OR quality_score < 0 OR quality_score > 1").count()
    assert quality.score(out, model).columns == out.columns and quality.score(K.frame(spark, []), model).count() == 0
    untaught = quality.train(labelled.drop("quality"), labelled.drop("text").limit(0))
    assert {r["quality_score"] for r in quality.score(df, untaught).collect()} == {0.5}


def brute_top_k(data, asked, k):
    ok = [(i, np.floor(64 * np.array(v, float)).astype(np.int64)) for i, v in data if i is not None and v is not None and not any(x is None or not np.isfinite(x) for x in v)]
    out = {}
    for q in sorted(set(asked)):
        qs = sorted((v.tolist() for i, v in ok if i == q))
        if qs:
            near = sorted((-int(sum(a * b for a, b in zip(qs[0], v.tolist()))), i) for i, v in ok if i != q)[:k]
            out[q] = [(i, -s) for s, i in near]
    return out


@pytest.mark.parametrize("pivots", [3, 40])
def test_top_k(spark, pivots, monkeypatch):
    monkeypatch.setattr(knn, "QUERY_BLOCK", 7)
    monkeypatch.setattr(knn, "DATA_BLOCK", 50)
    r = np.random.default_rng(5)
    centre = r.normal(size=(6, 8)) * 3
    data = [(i, [float(x) for x in centre[i % 6] + r.normal(size=8) * 0.1]) for i in range(400)]
    data += [(400 + i, data[20][1]) for i in range(40)] + [(500, None), (501, [None] * 8), (502, [float("nan")] * 8), (503, [float("inf")] * 8), (504, [1.0, 2.0]), (505, []), (20, data[20][1]), (20, data[20][1]), (None, data[3][1])]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in data], "vec_id long, embedding array<float>, cell int, dist double")
    data = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = {}
    for row in knn.top_k(df, df.where("vec_id % 20 = 0"), 20, pivots=pivots).orderBy("query_id", "rank").collect():
        got.setdefault(row["query_id"], []).append((row["vec_id"], row["score"]))
    assert got == brute_top_k(data, [i for i, _ in data if i is not None and i % 20 == 0], 20)
    few = df.where("vec_id < 5")
    assert knn.top_k(few, few.where("vec_id = 0"), 20).count() == 4 and knn.top_k(df.limit(0), df, 20).count() == 0 and knn.top_k(df, df.limit(0), 20).count() == 0


def test_top_k_of_an_id_with_many_rows(spark):
    """Rows of the query's own id, however many and near, take no place of a neighbour in other groups; every row is a pivot, so also theirs."""
    r = np.random.default_rng(6)
    centre = r.normal(size=(6, 8))
    data = [(i, [float(x) for x in centre[i % 6] + r.normal(size=8) * 0.1]) for i in range(1, 200) if i % 20]
    far = [0.0] * 7 + [50.0]
    data += [(20, far)] * 30 + [(40, [-x for x in far])] * 30 + [(40, data[3][1])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    data = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = {}
    for row in knn.top_k(df, df.where("vec_id % 20 = 0"), 20, pivots=400).orderBy("query_id", "rank").collect():
        got.setdefault(row["query_id"], []).append((row["vec_id"], row["score"]))
    assert got == brute_top_k(data, [20, 40], 20) and all(len(x) == 20 for x in got.values())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    cur = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cur.description]
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(tuple, df.select(names).collect())) == sorted(cur.fetchall())


def test_pipeline(spark):
    """Every stage on what its predecessor kept, against a plain version of the stage."""
    docs = read(spark, SF, "documents")
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "decontaminate", "personal_data", "tokens"]
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in read(spark, SF, "labels").collect()}
    text = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    one = P.quality(spark, docs, SF).cache()
    assert one.columns == docs.columns
    kept = text(one)
    good = [i for i, x in labels.items() if x[0] == 1]
    assert sum(i in kept for i in good) / len(good) > 0.95 and sum(i in kept for i, x in labels.items() if x[0] == 0) / (len(labels) - len(good)) < 0.2
    two = P.near_duplicates(spark, one, SF).cache()
    want = {i for i, _, _, first in K.near_duplicates(sorted(kept.items()), 5, 80) if first}
    assert set(text(two)) == want and two.columns == docs.columns
    three = P.decontaminate(spark, two, SF).cache()
    items = [(r["item_id"], r["text"]) for r in read(spark, SF, "benchmark").collect()]
    clean = {r[0] for r in K.contamination(sorted(text(two).items()), items, 13) if not r[5]}
    assert set(text(three)) == clean and three.columns == docs.columns
    four = P.personal_data(spark, three, SF).cache()
    masked = text(four)
    assert set(masked) == clean and four.columns == docs.columns and not any("@mail" in (t or "") for t in masked.values())
    five = P.tokens(spark, four, SF).collect()
    assert {r["doc_id"]: r["decoded_sha256"] for r in five} == {i: K.sha(t or "") for i, t in masked.items()}
    run = P.run(spark, "/root/testdata/sf0.001")
    assert run.count() > 0 and run.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]


def test_pipeline_stages_take_odd_rows(spark, tmp_path):
    """Nulls in any column, repeated rows and empty tables."""
    for name in ("labels", "benchmark"):
        read(spark, SF, name).write.parquet(str(tmp_path / f"{name}.parquet"))
    rows = K.frame(spark, K.DOCS + K.REPEATED, extra=False).withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})
    for docs in (rows, rows.limit(0)):
        for i, (_, stage) in enumerate(P.STAGES):
            out = stage(spark, docs, str(tmp_path))
            if i < 4:
                assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
            out.count()


def test_pipeline_stages_decide_per_row(spark, tmp_path):
    """Rows without a doc_id, rows that share one, and repeated rows each get the decision of their own text."""
    spark.createDataFrame([(1, K.PASSAGE)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clean = [K.prose(60, 700 + i) for i in range(5)]
    near = clean[3].replace(clean[3].split()[30], "changed", 1)
    docs = lambda rows: spark.createDataFrame([(i, t, "en", None, len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = lambda stage, rows: sorted((tuple(r) for r in stage(spark, docs(rows), str(tmp_path)).select("doc_id", "text").collect()), key=str)
    rows = [(None, K.PASSAGE), (None, clean[0]), (5, K.PASSAGE), (5, clean[1]), (6, clean[2]), (6, clean[2]), (7, None), (None, None)]
    assert kept(P.decontaminate, rows) == sorted([r for r in rows if r[1] != K.PASSAGE], key=str)
    rows = [(None, clean[0])] * 3 + [(None, clean[1]), (5, clean[2]), (5, clean[3]), (6, near), (7, clean[4]), (7, clean[4]), (8, None), (8, None), (9, None), (None, None), (9, ""), (9, "")]
    assert kept(P.near_duplicates, rows) == sorted([(None, clean[0]), (None, clean[1]), (5, clean[2]), (5, clean[3]), (7, clean[4]), (8, None), (9, None), (None, None), (9, "")], key=str)


def test_held_out(spark):
    import zlib
    got = spark.range(200).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in got)


def test_near_duplicates_shuffles_texts_once(spark):
    """Without any broadcast, what stays is found where the texts lie; only row numbers move."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = [K.prose(40, 800 + i) for i in range(6)]
        docs = spark.createDataFrame([(i, t, "en", None, len(t)) for i, t in enumerate(texts + texts[:3])], "doc_id long, text string, lang string, source string, n_chars long")
        out = P.near_duplicates(spark, docs, SF)
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        assert sorted(r["doc_id"] for r in out.collect()) == [0, 1, 2, 3, 4, 5]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
