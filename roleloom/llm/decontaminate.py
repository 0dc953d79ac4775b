"""Benchmark decontamination: prefix-filtered set join of word shingles, in DataFrame operations alone.

Every item is cut into windows.  Of the shingles of a window the one that is rarest
in the documents is its prefix token: a document that holds the window holds that
shingle, so joining on it loses nothing.  A candidate then has to leave room for the
whole window before and behind the shingle (length and position), and its words have
to equal the window's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ._work import ascii_lower, key

WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
SHINGLE = 3
#: Default bound of the windows that are sent to all executors: under 64 MB.
BROADCAST_WINDOWS = 200_000

c = F.col


def words(text: Column) -> Column:
    """Words of a text: runs of digits, a-z (A-Z lowered) and characters outside ASCII; a null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), WORD_BREAK), "")


def _token(at, size: int) -> Column:
    """Hash of the ``size`` words that begin at the 0-based position ``at`` of ``_w``."""
    return F.xxhash64(F.lit(size), *[F.get(c("_w"), at + i) for i in range(size)])


def windows(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """(item_id, window, size): each run of ``width`` words of an item; a shorter item that has words is one window."""
    w = benchmark.select("item_id", words(c("text")).alias("_b")).where(F.size("_b") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("_b") - width, F.lit(0)))
    return (w.select("item_id", "_b", F.explode(starts).alias("_s")).select("item_id", F.slice("_b", c("_s") + 1, width).alias("window"))
            .distinct().withColumn("size", F.size("window")))


def _offsets(size: int) -> Column:
    """Every shingle of ``size`` words of a window and where it begins."""
    return F.transform(F.sequence(F.lit(0), c("size") - size), lambda i: F.struct(F.xxhash64(F.lit(size), *[F.get(c("window"), i + k) for k in range(size)]).alias("token"), i.alias("off")))


def _tokens(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """One row per document word and shingle size: (_d, _t, _w, _pos, token)."""
    out = docs.select("_d", "_t", "_w", F.posexplode("_w").alias("_pos", "_word"))
    if len(sizes) == 1:
        return out.withColumn("token", _token(c("_pos"), sizes[0]))
    return out.withColumn("token", F.explode(F.array(*[_token(c("_pos"), s) for s in sizes])))


def hits(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, broadcast_windows: int | None = None) -> DataFrame:
    """(_d, _t, start, size, item_id): every occurrence of a benchmark window in a document; _w holds the document's words.

    Up to ``broadcast_windows`` windows are sent to all executors and a document's words are compared where they are read.  More are joined by a
    shuffle of (document, place, token) rows; the candidates that fit then meet the words of their document, each of which is moved once.
    """
    most = BROADCAST_WINDOWS if broadcast_windows is None else broadcast_windows
    win = windows(benchmark, width)
    n, sizes = win.agg(F.count("*"), F.sort_array(F.collect_set(F.least("size", F.lit(SHINGLE))))).first()  # at most three sizes
    sizes = sizes or [SHINGLE]
    small = (lambda d: F.broadcast(d)) if n <= most else (lambda d: d)
    kinds = [_offsets(s) for s in sizes]
    choice = kinds[-1]
    for s, kind in reversed(list(zip(sizes, kinds))):
        choice = F.when(F.least("size", F.lit(SHINGLE)) == s, kind).otherwise(choice)
    shingles = win.select("item_id", "window", "size", F.explode(choice).alias("_x")).select("item_id", "window", "size", "_x.token", "_x.off")
    tokens = _tokens(docs, sizes)
    known = shingles.select("token").distinct()
    counts = tokens.select("token").join(small(known), "token").groupBy("token").agg(F.count("*").alias("n"))
    rarest = (shingles.join(counts, "token", "left").groupBy("item_id", "window", "size")
              .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "off")).alias("_r")).where(c("_r.n") > 0)
              .select("item_id", "window", "size", c("_r.token").alias("token"), c("_r.off").alias("off")))
    start = c("_pos") - c("off")
    if n > most:
        places = tokens.select("_d", "_t", "_pos", F.size("_w").alias("_n"), "token")
        fits = places.join(rarest, "token").where((start >= 0) & (start + c("size") <= c("_n"))).select("_d", "_t", start.alias("start"), "size", "item_id", "window").distinct()
        return fits.join(docs.select("_d", "_t", "_w"), ["_d", "_t"]).where(F.slice("_w", c("start") + 1, c("size")) == c("window")).select("_d", "_t", "start", "size", "item_id")
    return (tokens.join(small(rarest), "token").where((start >= 0) & (start + c("size") <= F.size("_w")))
            .where(F.slice("_w", start + 1, c("size")) == c("window")).select("_d", "_t", start.alias("start"), "size", "item_id"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, width: int = WINDOW, percent: int = 5, carry: tuple[str, ...] = (), broadcast_windows: int | None = None) -> DataFrame:
    """Words of each document that stand inside an occurrence of a benchmark window.

    Returns doc_id, n_words, n_hit, n_items, items_sha256 and contaminated (at least one word and ``percent`` of all words hit), one row
    per input row.  A null or empty text has no words and is clean; items without words have no windows, a null item_id is left out of
    the items but its windows count; repeated rows each give a row; an empty benchmark hits nothing; other columns are ignored, but those named in ``carry`` follow the result's.
    ``broadcast_windows`` is as in ``hits``; the rows do not depend on it.
    """
    docs = documents.select("doc_id", key().alias("_d"), F.xxhash64("text").alias("_t"), words(c("text")).alias("_w"), *carry)
    found = hits(docs, benchmark, width, broadcast_windows).select("_d", "_t", "start", (c("start") + c("size")).alias("end"), "item_id")
    # Occurrences of one document in order: each adds the words behind the furthest end so far.
    before = F.max("end").over(W.partitionBy("_d", "_t").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1))
    per_doc = (found.groupBy("_d", "_t", "start").agg(F.max("end").alias("end"), F.collect_set(c("item_id").cast("string")).alias("items"))
               .withColumn("_new", F.greatest(F.lit(0), c("end") - F.greatest("start", F.coalesce(before, F.lit(0)))))
               .groupBy("_d", "_t").agg(F.sum("_new").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")))
    hit, n = F.coalesce("n_hit", F.lit(0).cast("long")), c("n_words")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return (docs.select("doc_id", "_d", "_t", F.size("_w").cast("long").alias("n_words"), *carry).join(per_doc, ["_d", "_t"], "left")
            .select("doc_id", "n_words", hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
                    ((hit > 0) & (hit * 100 >= n * percent)).alias("contaminated"), *carry))
