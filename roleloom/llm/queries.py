"""Registered queries of this subpackage and their DuckDB checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, chat, decontaminate, knn, language, merkle, near_dup, phrases, pii, quality, substring, suffix, token_files
from ._work import held_out, read

#: Key of the pseudonyms; a deployment passes its own.
PII_KEY = "roleloom"
QUALITY_THRESHOLD = 0.7
EXTRA_CONVERSATION = "</s>[INST] ok [/INST]"

c = F.col


def rank_file() -> tuple[str, str]:
    """(path of the ranks, pattern) of the vocabulary that the queries use."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    languages, matrix = language.train(docs.where(~held_out(c("doc_id"))).select("doc_id", "text", "lang"))
    return language.predict(docs, languages, matrix).select("doc_id", held_out(c("doc_id")).alias("held_out"), "lang_pred", "score")


def quality_model(documents: DataFrame, labels: DataFrame) -> quality.Model:
    return quality.train(documents, labels.where(~held_out(c("doc_id"))))


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    model = quality_model(docs, read(spark, folder, "labels"))
    return quality.score(docs, model).select("doc_id", held_out(c("doc_id")).alias("held_out"), c("quality_score").alias("score"), (c("quality_score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


def op3_near_dup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dup.near_duplicates(read(spark, folder, "documents"), width=4, percent=80)


def op4_top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = read(spark, folder, "embeddings")
    return knn.top_k(vectors, vectors.where(c("vec_id") % 20 == 0), k=20)


def op5_suffix(spark: SparkSession, folder: str) -> DataFrame:
    return suffix.remove_repeats(read(spark, folder, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.decontaminate(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


def op7_substring(spark: SparkSession, folder: str) -> DataFrame:
    return substring.remove_repeats(read(spark, folder, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op8_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode(read(spark, folder, "documents"), *rank_file(), keep_ids=False)


def op9_pii(spark: SparkSession, folder: str) -> DataFrame:
    out = pii.pseudonymize(read(spark, folder, "documents"), PII_KEY)
    return out.select("doc_id", "text", "n_masked", *[F.coalesce(c("masked_kinds")[k], F.lit(0)).alias(f"n_{k}") for k in sorted(pii.KINDS)])


def op10_chat(spark: SparkSession, folder: str) -> DataFrame:
    turns = read(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), c("id").alias("turn"), F.when(c("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(EXTRA_CONVERSATION).alias("text"))
    back = chat.read_back(chat.format_windows(turns.unionByName(extra)))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(spoken, 256).alias("turns_sha256"), F.length("targets").cast("long").alias("loss_chars"), F.sha2("targets", 256).alias("loss_sha256"),
                       c("formatted_chars").cast("long").alias("formatted_chars"))


def op11_merkle(spark: SparkSession, folder: str) -> DataFrame:
    tampered = F.when(F.crc32(c("doc_id").cast("string").cast("binary")) % 2 == 0, F.regexp_replace("text", "\n", "")).otherwise(c("text"))
    values = [tampered if k == "text" else c(k) for k in merkle.COLUMNS]
    out = merkle.manifest(read(spark, folder, "documents"), carry={"tampered": merkle.leaf_of(*values)})
    folded = merkle.fold(c("tampered"), c("before"), c("after"))
    return (out.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(c("before"), c("after")), 256).alias("proof_sha256"), folded.alias("folded_root"))
            .withColumn("verified", c("folded_root") == c("root")))


def op12_token_files(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers
    written = token_files.write(read(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    back = token_files.read_documents(spark, written)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op13_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(read(spark, folder, "documents"), longest=3, least=10, covered_percent=50, best=2000)


QUERIES = {f.__name__: f for f in (op1_language, op2_quality, op3_near_dup, op4_top_k, op5_suffix, op6_decontaminate, op7_substring, op8_bpe, op9_pii, op10_chat, op11_merkle, op12_token_files, op13_phrases)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"[^\x20\x09-\x0D]+"

#: A document's words in windows of every size that an item has, against the items' windows.
_DECONTAMINATE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(13, len(w)) n, array_to_string(w[s:s + least(13, len(w)) - 1], ' ') t
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
starts AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) s FROM d, sizes WHERE len(w) >= n),
hits AS (SELECT x.doc_id, x.s, x.n, win.item_id FROM (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') t FROM starts) x JOIN win USING (n, t)),
cov AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) p FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(*) n_items, string_agg(i, ',' ORDER BY i) ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) i FROM hits) GROUP BY 1)
SELECT d.doc_id, len(w) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(ids, '')) items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN items USING (doc_id)"""

#: Every pair of documents that share a shingle, and the closure of their links.
_NEAR = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_SPACED}') w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY 1),
p AS (SELECT a.doc_id a, b.doc_id b, count(*) k FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
two AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT doc_id x, doc_id y FROM d UNION SELECT x, b FROM reach JOIN two ON y = a)
SELECT d.doc_id, coalesce(any_value(n.n), 0) n_shingles, min(y) component_id, d.doc_id = min(y) kept FROM d LEFT JOIN n USING (doc_id) JOIN reach ON x = d.doc_id GROUP BY d.doc_id"""

_TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id query_id, d.vec_id, CAST(list_sum(list_transform(list_zip(q.e, d.e), lambda z: z[1] * z[2])) AS BIGINT) score FROM v q, v d WHERE q.vec_id % 20 = 0 AND d.vec_id <> q.vec_id)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) r FROM p) WHERE r <= 20"""

_REPEATED_WORDS = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') w FROM documents),
win AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 34], ' ')) t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) s FROM d WHERE len(w) >= 35)),
rep AS (SELECT doc_id, s FROM win WHERE t IN (SELECT t FROM win GROUP BY t HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) p FROM rep),
word AS (SELECT doc_id, generate_subscripts(w, 1) p, unnest(w) t FROM d),
kept AS (SELECT word.doc_id, string_agg(t, ' ' ORDER BY p) k, count(*) n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT d.doc_id, len(w) n_words, len(w) - coalesce(n, 0) n_removed, sha256(coalesce(k, '')) kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

#: Leaves, their trees level by level, the siblings of each leaf on every level, and the fold of the tampered leaves.
_MERKLE = """
WITH RECURSIVE d AS (SELECT doc_id, source, lang, n_chars, text, CASE WHEN crc % 2 = 1 THEN replace(text, chr(10), '') ELSE text END t
  FROM (SELECT *, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: ascii(CAST(doc_id AS VARCHAR)[i])::UBIGINT)),
        lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END))) crc FROM documents)),
f AS (SELECT doc_id, source, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
             || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') head, coalesce(strlen(text) || ':' || text, '-') a, coalesce(strlen(t) || ':' || t, '-') b FROM d),
h AS (SELECT doc_id, source, sha256(head || a) leaf, sha256(head || b) tampered FROM f),
s AS (SELECT source, n, row_number() OVER (ORDER BY source NULLS FIRST) - 1 tree FROM (SELECT source, count(*) n FROM h GROUP BY 1)),
l AS (SELECT tree, n, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 i, doc_id, leaf, tampered FROM h JOIN s ON h.source IS NOT DISTINCT FROM s.source),
t AS (SELECT tree, 0 lv, n, i, leaf g FROM l
      UNION ALL SELECT tree, any_value(lv) + 1, (any_value(n) + 2) // 3, i // 3, sha256(string_agg(g, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY tree, i // 3),
r AS (SELECT tree, max(lv) top, arg_max(g, lv) subroot FROM t GROUP BY 1),
u AS (SELECT 0 lv, (SELECT count(*) FROM r) n, tree i, subroot g FROM r
      UNION ALL SELECT any_value(lv) + 1, (any_value(n) + 2) // 3, i // 3, sha256(string_agg(g, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY i // 3),
root AS (SELECT max(lv) top, arg_max(g, lv) root FROM u),
step AS (SELECT l.tree, l.i, x.lv, coalesce(string_agg(y.g, '' ORDER BY y.i) FILTER (y.i < x.i), '') b, coalesce(string_agg(y.g, '' ORDER BY y.i) FILTER (y.i > x.i), '') a
         FROM l JOIN r USING (tree) JOIN t x ON x.tree = l.tree AND x.lv < r.top AND x.i = l.i // CAST(3 ** x.lv AS BIGINT) JOIN t y ON y.tree = x.tree AND y.lv = x.lv AND y.i // 3 = x.i // 3 GROUP BY 1, 2, 3),
high AS (SELECT r.tree, r.top + x.lv lv, coalesce(string_agg(y.g, '' ORDER BY y.i) FILTER (y.i < x.i), '') b, coalesce(string_agg(y.g, '' ORDER BY y.i) FILTER (y.i > x.i), '') a
         FROM r JOIN root ON true JOIN u x ON x.lv < root.top AND x.i = r.tree // CAST(3 ** x.lv AS BIGINT) JOIN u y ON y.lv = x.lv AND y.i // 3 = x.i // 3 GROUP BY 1, 2),
p AS (SELECT tree, i, lv, b, a FROM step UNION ALL SELECT l.tree, l.i, lv, b, a FROM l JOIN high USING (tree)),
k AS (SELECT l.tree, l.i, 0 lv, tampered g FROM l UNION ALL SELECT k.tree, k.i, k.lv + 1, sha256(p.b || k.g || p.a) FROM k JOIN p ON p.tree = k.tree AND p.i = k.i AND p.lv = k.lv),
folded AS (SELECT tree, i, arg_max(g, lv) folded_root FROM k GROUP BY 1, 2),
proof AS (SELECT tree, i, string_agg(b || a, '' ORDER BY lv) q FROM p GROUP BY 1, 2)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(q, '')) proof_sha256, folded_root, folded_root = root verified
FROM l JOIN r USING (tree) JOIN root ON true JOIN folded USING (tree, i) LEFT JOIN proof USING (tree, i)"""

#: Every phrase of one to three words of a piece, its count, and its lowest cut.
_PHRASES = r"""
WITH w AS (SELECT lang, doc_id, p, regexp_extract_all(x, '[^\x20\x09]+') w FROM (
  SELECT coalesce(lang, 'und') lang, doc_id, unnest(range(1, len(pieces) + 1)) p, unnest(pieces) x
  FROM (SELECT lang, doc_id, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') pieces FROM documents))),
o AS (SELECT lang, k, array_to_string(w[s:s + k - 1], ' ') g FROM (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) s FROM w, (SELECT unnest([1, 2, 3]) k) WHERE len(w) >= k)),
f AS (SELECT lang, k, g, count(*) a FROM o GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) n FROM f WHERE k = 1 GROUP BY 1),
cand AS (SELECT lang, k, g, a, string_split(g, ' ') w FROM f WHERE k > 1 AND a >= 10),
cut AS (SELECT c.lang, c.k, c.g, c.a, c.w, x.a l, y.a r, s, (1000000::HUGEINT * c.a * c.a) // (x.a::HUGEINT * y.a) score
        FROM (SELECT *, unnest(range(1, k)) s FROM cand) c JOIN f x ON x.lang = c.lang AND x.g = array_to_string(c.w[1:s], ' ') JOIN f y ON y.lang = c.lang AND y.g = array_to_string(c.w[s + 1:], ' ')),
low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, s) = 1),
over AS (SELECT lang, sub, max(a) m FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) sub FROM cand WHERE k = 3) GROUP BY 1, 2),
kept AS (SELECT low.* FROM low LEFT JOIN over ON over.lang = low.lang AND sub = g AND k = 2 WHERE m IS NULL OR 100 * m < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank, g AS phrase, a, l, r, n, CAST(score AS BIGINT) score
FROM kept JOIN n USING (lang) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) <= 2000"""

ORACLES = {"op11_merkle": _MERKLE, "op13_phrases": _PHRASES, "op3_near_dup": _NEAR, "op4_top_k": _TOP_K, "op6_decontaminate": _DECONTAMINATE, "op7_substring": _REPEATED_WORDS}
