"""Entity resolution: candidates, evidence ladder, fuzzy titles, decisions, survivorship, batch resolution.

Nothing here pairs all rows of a group.  Exact evidence aggregates the stored side
per key before the join.  Fuzzy evidence works on distinct titles: a prefix-filtered
set-similarity join inside each organisation finds similar titles, and rows attach
to titles through (organisation, title, deadline) classes of which only the three
lowest job ids can ever matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import rules as R, text as T
from ..functions.dates import ts_lit
from ..sources.tables import materialised, over_tasks
from .lifecycle import days, status_column

c = F.col
MICROS_PER_DAY = 86_400_000_000


def with_keys(rows: DataFrame) -> DataFrame:
    """Adds normalised title and URL, fingerprint and content hash where they are not stored yet."""
    out = rows.withColumn("normalized_title", T.normalize_title(c("title"))).withColumn("norm_url", T.normalize_url(c("application_url")))
    if "fingerprint" not in rows.columns:
        out = out.withColumn("fingerprint", T.job_fingerprint(c("org_slug"), c("normalized_title"), c("deadline")))
    if "content_hash" not in rows.columns:
        out = out.withColumn("content_hash", T.content_hash(c("org_slug"), c("title"), c("department"), c("summary"), T.iso_utc(c("deadline"))))
    return out


def prepare_incoming(postings: DataFrame) -> DataFrame:
    k = with_keys(postings)
    return k.withColumn("external_key", T.external_key(c("source_key"), c("source_job_id"), c("application_url"), c("source_url"), c("normalized_title"), c("norm_url")))


# --- R1, R2: exact evidence ------------------------------------------------------
#: Pairs of one key that a task makes, about, and the rows and columns of tasks over which the postings and jobs of a key are dealt, at most.
_CELL = 1 << 22
_GRID = 32


def _kinds(df: DataFrame, id_col: str, keys: dict[str, Column]) -> DataFrame:
    """(id, evidence, key): a row for each kind of evidence that a row has."""
    found = F.array(*[F.struct(F.lit(kind).alias("evidence"), key.cast("string").alias("key")) for kind, key in keys.items()])
    return df.select(id_col, F.explode(found).alias("e")).select(id_col, "e.*").where(c("key").isNotNull())


def _by_key(links: DataFrame, live: DataFrame) -> DataFrame:
    return links.join(live.select("job_id"), "job_id", "left_semi").select("job_id", F.lit("key").alias("evidence"), c("external_key").alias("key")).where(c("key").isNotNull())


def dup_candidates(incoming: DataFrame, stored: DataFrame, links: DataFrame, now, cell: int = _CELL) -> DataFrame:
    """(posting_id, evidence, candidates, first_job_id, job_id): every stored job that shares a kind of evidence with a posting, and beside it how many do and the first of them.

    All postings of an organisation meet all its recent jobs, so the rows grow with the square of an organisation by definition.  Numbers are taken per key, so neither pairs
    nor what is counted of them are shuffled, and a key with many pairs is dealt over a grid of tasks: postings over its rows, jobs over its columns, each pair in one cell.
    """
    live = stored.where(c("archived_at").isNull())
    recent = F.when(c("created_at") >= ts_lit(now) - days(R.CANDIDATE_WINDOW_DAYS), c("org_id"))
    shared = {"fingerprint": c("fingerprint"), "hash": c("content_hash")}
    theirs = _kinds(live, "job_id", {"url": c("application_url"), **shared, "org": recent}).unionByName(_by_key(links, live))
    urls = incoming.select("posting_id", F.explode(F.array_distinct(F.array("application_url", "norm_url"))).alias("key")).where(c("key").isNotNull() & (c("key") != ""))
    ours = _kinds(incoming, "posting_id", {"key": c("external_key"), **shared, "org": c("org_id")}).unionByName(urls.withColumn("evidence", F.lit("url")))
    on = ["evidence", "key"]
    met = (theirs.groupBy(*on).agg(F.count("*").alias("jobs"), F.min("job_id").alias("first")).join(ours.groupBy(*on).agg(F.count("*").alias("postings")), on)
           .withColumn("_n", F.least(F.lit(_GRID), F.ceil(F.sqrt(c("jobs").cast("double") * c("postings") / cell))).cast("int")))
    met = materialised(met.drop("postings"))
    own = W.partitionBy("posting_id", "evidence")  # a posting has two URLs at most
    mine = ours.join(met, on).select("posting_id", *on, "_n", F.sum("jobs").over(own).alias("candidates"), F.min("first").over(own).alias("first_job_id"))
    part = lambda id_col: F.pmod(F.xxhash64(id_col), c("_n")).cast("int")
    every = F.explode(F.sequence(F.lit(0), c("_n") - 1))
    mine = mine.withColumn("_i", part("posting_id")).withColumn("_j", every).drop("_n")
    dealt = theirs.join(met.select(*on, "_n"), on).withColumn("_j", part("job_id")).withColumn("_i", every).drop("_n")
    at = [*on, "_i", "_j"]
    # Both sides are small beside their pairs: by size alone Spark would make all pairs in a few tasks.
    return over_tasks(mine, *at).hint("merge").join(over_tasks(dealt, *at), at).select("posting_id", "evidence", "candidates", "first_job_id", "job_id")


RUNGS = ["external_key", "norm_url", "fingerprint", "content_hash"]


def _evidence(rung: int, kind: str, *parts: Column) -> Column:
    """One piece of evidence: its rung and 128 bits that stand for it, as the texts are several times as long; null where a part is null."""
    key = F.concat(F.lit(f"{rung}{kind}"), *[F.concat(F.lit("\x1f"), p.cast("string")) for p in parts])
    return F.struct(F.lit(rung).cast("byte").alias("rung"), F.unhex(F.md5(key)).alias("key"))


def dedupe_exact(incoming: DataFrame, stored: DataFrame, links: DataFrame, now) -> DataFrame:
    """(posting_id, rung, job_id): first rung with evidence — source key, URL, fingerprint, content hash — and its lowest job id.

    All evidence of a row is stacked, so either side is shuffled once.  A stored URL counts when its raw form is one of
    ours, or when the job is a candidate for another reason.
    """
    live = stored.where(c("archived_at").isNull())
    url = c("norm_url")
    recent = F.when(c("created_at") >= ts_lit(now) - days(R.CANDIDATE_WINDOW_DAYS), c("org_id"))
    both = [_evidence(2, "fingerprint", url, c("fingerprint")), _evidence(2, "hash", url, c("content_hash")), _evidence(3, "fingerprint", c("fingerprint")), _evidence(4, "hash", c("content_hash"))]
    theirs = F.array(_evidence(2, "raw", url, c("application_url")), _evidence(2, "org", url, recent), *both)
    ours = F.array(_evidence(1, "key", c("external_key")), _evidence(2, "raw", url, c("application_url")), _evidence(2, "raw", url, url), _evidence(2, "org", url, c("org_id")), *both)
    stack = lambda df, id_col, items: df.select(id_col, F.explode(F.array_distinct(items)).alias("e")).select(id_col, "e.*").where(c("key").isNotNull())
    by_key = links.join(live.select("job_id"), "job_id", "left_semi").select("job_id", _evidence(1, "key", c("external_key"))["key"].alias("key")).where(c("key").isNotNull())
    best = stack(live, "job_id", theirs).select("job_id", "key").unionByName(by_key).groupBy("key").agg(F.min("job_id").alias("job_id"))
    hit = stack(incoming, "posting_id", ours).join(best, "key")
    return hit.groupBy("posting_id").agg(F.min(F.struct(c("rung").cast("int").alias("rung"), "job_id")).alias("m")).select("posting_id", "m.rung", "m.job_id")


# --- R3: similar titles inside an organisation --------------------------------------
#: Features told apart by how many titles have them; those that fewer titles have come first, in the order of their hashes.
_COMMON = 1 << 16


def _features(title: Column) -> Column:
    """Numbered bigrams and words of a title as numbers, an odd one for a word.  Equal hashes of different features cost work, not results."""
    def numbers(values: Column, odd: int) -> Column:
        return F.transform(values, lambda x: F.shiftleft(F.shiftright(F.xxhash64(x), 1), 1) + odd)
    return F.concat(numbers(T.numbered_bigrams(title), 0), numbers(T.tokens(title), 1))


def _prefixes(titles: DataFrame, threshold: float) -> DataFrame:
    """(num, pre): of every title(num, title) the rarest features that it must share with any title that is similar enough, each with the number of all its features of that kind and of those from it on."""
    feats = over_tasks(titles, "num").select("num", F.explode(_features(c("title"))).alias("f"))
    # A table of fixed size: any order that all titles have in common will do.
    common = feats.groupBy("f").agg(F.count("*").alias("n")).orderBy(c("n").desc(), "f").limit(_COMMON)
    ranked = feats.join(F.broadcast(common), "f", "left").withColumn("w", F.pmod("f", F.lit(2)) == 1)
    # One title has at most a few hundred features, so its list is small.
    ordered = ranked.groupBy("num", "w").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0).cast("long")).alias("n"), "f"))).alias("a"))
    size = F.size("a")
    keep = size - F.ceil(size * F.when(c("w"), F.lit(threshold)).otherwise(F.lit(threshold / (2 - threshold))) - 1e-9).cast("int") + 1
    item = lambda x, i: F.struct(x["f"].alias("f"), (size.cast("long") * _HALF + (size - i)).alias("x"))
    return ordered.select("num", F.transform(F.slice("a", F.lit(1), keep), item).alias("pre"))


_HALF = 1 << 32


def similar_titles(left: DataFrame, right: DataFrame, threshold: float = R.REVIEW_SIMILARITY) -> DataFrame:
    """(org_id, left_title, right_title, score) of all distinct title pairs of one organisation with score >= threshold.

    Exact: two similar titles always share one of their rarest features (prefix
    filtering), equal titles are joined directly, and every candidate is verified.
    Titles and features are numbers until then.
    """
    sides = [d.select("org_id", c("normalized_title").alias("title"), F.lit(mine).alias("l"), F.lit(not mine).alias("r")) for d, mine in ((left, True), (right, False))]
    have = materialised(sides[0].unionByName(sides[1]).where(c("org_id").isNotNull() & c("title").isNotNull()).groupBy("org_id", "title").agg(F.max("l").alias("l"), F.max("r").alias("r")))
    titles = materialised(have.select("title").distinct().withColumn("num", F.monotonically_increasing_id()))
    numbered = have.join(titles, "title").join(_prefixes(titles, threshold), "num")
    at = numbered.select("org_id", "num", "l", "r", F.explode("pre").alias("p")).select("org_id", "p.f", "num", "p.x", "l", "r")
    lp, rp = (at.where(s).select("org_id", "f", c("num").alias(f"{s}n"), c("x").alias(f"{s}x")) for s in ("l", "r"))
    total, rest = (lambda x: F.shiftright(x, 32)), (lambda x: c(x).bitwiseAND(F.lit(_HALF - 1)))
    # Features that two similar titles share at least, against those that their sizes and the places of this one leave possible.
    need = F.when(F.pmod("f", F.lit(2)) == 1, threshold / (1 + threshold)).otherwise(threshold / 2) * (total("lx") + total("rx"))
    room = F.least(rest("lx"), rest("rx")) >= need - 1e-9
    found = materialised(lp.join(rp, ["org_id", "f"]).where((c("ln") != c("rn")) & room).select("org_id", "ln", "rn").distinct())
    # Features are prepared once per title; a candidate pair only intersects two small arrays, and only once.
    features = lambda s: titles.select(c("num").alias(f"{s}n"), c("title").alias(f"{s}_t"), T.numbered_bigrams(c("title")).alias(f"{s}_g"), T.tokens(c("title")).alias(f"{s}_w"))
    full = found.select("ln", "rn").distinct().join(features("l"), "ln").join(features("r"), "rn")
    score = F.greatest(T.dice_of(c("l_t"), c("r_t"), c("l_g"), c("r_g")), T.jaccard_of(c("l_w"), c("r_w")))
    scored = full.select("ln", "rn", c("l_t").alias("left_title"), c("r_t").alias("right_title"), F.explode(F.filter(F.array(score), lambda x: x >= threshold)).alias("score"))
    near = found.join(scored, ["ln", "rn"]).select("org_id", "left_title", "right_title", "score")
    same = have.where("l AND r").select("org_id", c("title").alias("left_title"), c("title").alias("right_title"), F.lit(1.0).alias("score"))
    return near.unionByName(same)


def dedupe_fuzzy(incoming: DataFrame, stored: DataFrame, now) -> DataFrame:
    return similar_titles(incoming, fuzzy_pool(stored, now))


def fuzzy_pool(stored: DataFrame, now) -> DataFrame:
    return stored.where(c("archived_at").isNull() & (c("created_at") >= ts_lit(now) - days(R.CANDIDATE_WINDOW_DAYS)))


def _day(deadline: Column) -> Column:
    return F.unix_date(deadline.cast("date"))


#: Days that lie inside the deadline window of every instant of day 0, and those that only some of it reaches.
_INNER = list(range(1 - R.DEADLINE_WINDOW_DAYS, R.DEADLINE_WINDOW_DAYS))
_EDGE = [-R.DEADLINE_WINDOW_DAYS, R.DEADLINE_WINDOW_DAYS]


def _days(deadline: Column, offsets: list[int]) -> Column:
    return F.explode(F.transform(F.array(*[F.lit(x) for x in offsets]), lambda i: _day(deadline) + i))


def _lowest(df: DataFrame, keys: list[str], id_col: str, k: int, salts: int = 32) -> DataFrame:
    """The k lowest ids per key in two rounds, so that a hot key is ranked by many tasks."""
    first = df.withColumn("_s", F.pmod(F.xxhash64(id_col), F.lit(salts))).withColumn("_r", F.row_number().over(W.partitionBy(*keys, "_s").orderBy(id_col))).where(c("_r") <= k)
    return first.drop("_s").withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(id_col))).where(c("_r") <= k).drop("_r")


def class_candidates(incoming: DataFrame, pool: DataFrame, titles: DataFrame, id_col: str = "job_id", k: int = R.REVIEW_CANDIDATES) -> DataFrame:
    """(org_id, normalized_title, deadline, job_id, score, dated): candidates of every distinct incoming class with a compatible deadline.

    Per stored class only the k lowest ids are carried: candidates of one class tie in
    score, so higher ids can never enter a best-k list.
    """
    mine = incoming.select("org_id", c("normalized_title").alias("left_title"), "deadline").distinct().join(titles, ["org_id", "left_title"])
    theirs = pool.select("org_id", c("normalized_title").alias("right_title"), c("deadline").alias("d"), c(id_col).alias("job_id"))
    on = ["org_id", "right_title"]
    dated = theirs.where(c("d").isNotNull())
    by_day = _lowest(dated.withColumn("b", _day(c("d"))), on + ["b"], "job_id", k)
    by_instant = _lowest(dated, on + ["d"], "job_id", k).withColumn("b", _day(c("d")))
    undated = _lowest(theirs.where(c("d").isNull()), on, "job_id", k)
    any_date = _lowest(theirs, on, "job_id", k)
    limit = R.DEADLINE_WINDOW_DAYS * MICROS_PER_DAY
    with_date = mine.where(c("deadline").isNotNull())
    # Whole days need their lowest ids only; instants are compared on the two days at the window's ends.
    near = (with_date.withColumn("b", _days(c("deadline"), _INNER)).join(by_day, on + ["b"])
            .unionByName(with_date.withColumn("b", _days(c("deadline"), _EDGE)).join(by_instant, on + ["b"]).where(F.abs(F.timestamp_diff("MICROSECOND", "deadline", "d")) <= limit)))
    cols = ["org_id", c("left_title").alias("normalized_title"), "deadline", "job_id", "score", (c("deadline").isNotNull() & c("d").isNotNull()).alias("dated")]
    return (near.select(*cols).unionByName(with_date.join(undated, on).select(*cols))
            .unionByName(mine.where(c("deadline").isNull()).join(any_date, on).select(*cols)))


def review_candidates(incoming: DataFrame, stored: DataFrame, now, k: int = R.REVIEW_CANDIDATES) -> DataFrame:
    """Best k candidates per incoming class: score first, then the lowest job id."""
    pool = fuzzy_pool(stored, now)
    cand = class_candidates(incoming, pool, materialised(similar_titles(incoming, pool)))
    cls = ["org_id", "normalized_title", "deadline"]
    w = W.partitionBy(*cls).orderBy(c("score").desc(), c("job_id").asc())
    return cand.withColumn("rank", F.row_number().over(w)).where(c("rank") <= k)


def _class_join(rows: DataFrame, cands: DataFrame, how: str = "inner") -> DataFrame:
    r = cands.withColumnsRenamed({"org_id": "_o", "normalized_title": "_t", "deadline": "_d"})
    same = (c("org_id") == c("_o")) & (c("normalized_title") == c("_t")) & c("deadline").eqNullSafe(c("_d"))
    return rows.join(r, same, how).drop("_o", "_t", "_d")


def dedupe_decide(incoming: DataFrame, stored: DataFrame, links: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """(decisions, reviews).

    decisions(posting_id, action, job_id, score): ``same-source``, ``merge`` or ``create``;
    reviews(posting_id, job_id, score, rank): up to three candidates of every created posting.
    """
    # Both intermediate results feed several outputs, so they are materialised once.
    exact = materialised(dedupe_exact(incoming, stored, links, now))
    rest = incoming.join(exact.select("posting_id"), "posting_id", "left_anti")
    listed = materialised(_class_join(rest.select("posting_id", "org_id", "normalized_title", "deadline"), review_candidates(rest, stored, now), "left"))
    best = c("rank") == 1
    merged = listed.where(best & (c("score") >= R.AUTO_MERGE_SIMILARITY) & c("dated")).select("posting_id", F.lit("merge").alias("action"), "job_id", "score")
    known = exact.select("posting_id", F.when(c("rung") == 1, "same-source").otherwise("merge").alias("action"), "job_id", F.lit(1.0).alias("score"))
    created = rest.join(merged.select("posting_id"), "posting_id", "left_anti").select(
        "posting_id", F.lit("create").alias("action"), F.lit(None).cast("bigint").alias("job_id"), F.lit(None).cast("double").alias("score"))
    reviews = (listed.where(c("rank").isNotNull()).join(merged.select("posting_id"), "posting_id", "left_anti").select("posting_id", "job_id", "score", "rank"))
    return known.unionByName(merged).unionByName(created), reviews


# --- R5–R7, R9, R13: writing the decisions --------------------------------------------
#: Columns of a job that its owning source writes.
OWNED = ["title", "normalized_title", "department", "category", "secondary_categories", "level", "summary", "responsibilities", "required_skills", "preferred_skills", "education_disciplines", "discipline_note",
         "min_cgpa", "ssc_hsc_requirement", "min_ssc_gpa", "min_hsc_gpa", "masters_required", "no_third_division", "min_experience_years", "max_experience_years", "age_limit", "banking_experience_preferred",
         "requirements_parsed", "location", "work_mode", "employment_type", "salary", "vacancies", "published_at", "deadline", "application_url", "content_hash", "fingerprint"]
REQUIREMENTS = ["education_disciplines", "min_cgpa", "masters_required", "no_third_division", "min_experience_years", "max_experience_years", "age_limit"]


def merge_survivorship(stored: DataFrame, matched: DataFrame, now) -> DataFrame:
    """Updated job rows.  ``matched`` holds the postings with ``job_id``, ``action``, ``source_name`` and the enriched columns.

    A posting of the owning source overwrites; the last one wins.  Others fill only what is missing (null, zero or
    empty text), the first one that has a value wins.  ``deadline_changed`` is true when any posting brought another deadline.
    """
    cur = stored.select("job_id", c("source_name").alias("_owner"), c("deadline").alias("_deadline"))
    m = matched.join(cur, "job_id").withColumn("_owns", (c("action") == "same-source") & (c("_owner") == c("source_name")))
    filler = lambda col, ok: F.min_by(F.when(ok, c(col)), F.when(ok & ~c("_owns"), c("posting_id")))
    real = {"deadline": c("deadline").isNotNull(), "application_url": c("application_url") != "", "salary": c("salary") != "", "vacancies": c("vacancies") != 0}
    agg = m.groupBy("job_id").agg(
        F.max_by(F.struct(*OWNED), F.when(c("_owns"), c("posting_id"))).alias("own"),
        *[filler(col, ok).alias(f"fill_{col}") for col, ok in real.items()],
        F.min_by(F.struct(*REQUIREMENTS), F.when(c("requirements_parsed") & ~c("_owns"), c("posting_id"))).alias("req"),
        F.max(F.coalesce(c("deadline") != c("_deadline"), F.lit(False))).alias("deadline_changed"))
    j = stored.join(agg, "job_id")
    owned = c("own").isNotNull()
    base = {col: F.when(owned, c(f"own.{col}")).otherwise(c(col)) for col in OWNED}
    for col in real:
        empty = base[col].isNull() if col == "deadline" else (base[col].isNull() | (base[col] == (0 if col == "vacancies" else "")))
        base[col] = F.when(empty, F.coalesce(c(f"fill_{col}"), base[col])).otherwise(base[col])
    fill_req = ~base["requirements_parsed"] & c("req").isNotNull()
    for col in REQUIREMENTS:
        base[col] = F.when(fill_req, c(f"req.{col}")).otherwise(base[col])
    base["requirements_parsed"] = base["requirements_parsed"] | fill_req
    out = j.withColumn("_old_deadline", c("deadline")).withColumns(base)
    status = status_column(now, deadline=F.coalesce("deadline", "_old_deadline"), missing=F.lit(0), verified=ts_lit(now))
    return out.withColumn("status", status).withColumn("last_verified_at", ts_lit(now)).withColumn("missing_runs", F.lit(0)).drop(
        "own", "req", "_old_deadline", *[f"fill_{x}" for x in real])


def link_upsert(links: DataFrame, seen: DataFrame, now) -> DataFrame:
    """Next links: known external keys get a new last sighting and URL, unknown ones are inserted.  One row per key.

    ``seen(external_key, job_id, source_id, source_url, posting_id)``; untrusted rows are left out by the caller.
    """
    last = seen.groupBy("external_key").agg(F.min_by(F.struct("job_id", "source_id"), "posting_id").alias("n"), F.max_by("source_url", "posting_id").alias("new_url"))
    both = links.join(last, "external_key", "full_outer")
    old, hit, t = c("job_id").isNotNull(), c("n").isNotNull(), ts_lit(now)
    return both.select(
        "external_key", F.when(old, c("job_id")).otherwise(c("n.job_id")).alias("job_id"), F.when(old, c("source_id")).otherwise(c("n.source_id")).alias("source_id"),
        F.when(hit, c("new_url")).otherwise(c("source_url")).alias("source_url"), F.when(old, c("first_seen_at")).otherwise(t).alias("first_seen_at"),
        F.when(hit, t).otherwise(c("last_seen_at")).alias("last_seen_at"))


def _hashed_id(key: Column, attempt: int) -> Column:
    text = F.concat(key, F.lit(f"#{attempt}")) if attempt else key
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def new_job_ids(keys: DataFrame, stored: DataFrame) -> DataFrame:
    """(external_key, job_id): a number for each distinct key, the same whenever the key is met, and never one that a stored job or another key has.

    60 bits of the key's hash; where they are taken, the keys but the first take those of their next hash.
    """
    todo, taken, out, attempt = keys.select("external_key").distinct(), stored.select("job_id"), None, 0
    while True:
        tried = todo.withColumn("job_id", _hashed_id(c("external_key"), attempt))
        first = tried.groupBy("job_id").agg(F.min("external_key").alias("external_key")).join(taken, "job_id", "left_anti").select("external_key", "job_id")
        first = materialised(first)
        out = first if out is None else out.unionByName(first)
        todo = todo.join(first, "external_key", "left_anti")
        if todo.isEmpty():
            return out
        taken, attempt = taken.unionByName(first.select("job_id")), attempt + 1


def settle(incoming: DataFrame, decisions: DataFrame, stored: DataFrame) -> DataFrame:
    """Decisions in which every posting has a job: of the created ones, the first of each duplicate group keeps ``create`` and the new job's number, the others update or merge into it."""
    created = incoming.join(decisions.where(c("action") == "create").select("posting_id"), "posting_id", "left_semi")
    roots = materialised(resolve_batch(created.withColumnRenamed("posting_id", "seq")))
    keyed = created.select(c("posting_id").alias("seq"), "external_key").join(roots, "seq")
    root_key = keyed.where(c("seq") == c("root")).select("root", c("external_key").alias("root_key"))
    ids = new_job_ids(root_key.select(c("root_key").alias("external_key")), stored)
    made = keyed.join(root_key, "root").join(ids.select(c("external_key").alias("root_key"), "job_id"), "root_key")
    action = F.when(c("seq") == c("root"), "create").when(c("external_key") == c("root_key"), "same-source").otherwise("merge")
    return decisions.where(c("action") != "create").select("posting_id", "action", "job_id").unionByName(made.select(c("seq").alias("posting_id"), action.alias("action"), "job_id"))


def create_jobs(incoming: DataFrame, settled: DataFrame, orgs: DataFrame, now) -> DataFrame:
    """Whole canonical rows of created jobs, with their status at birth.

    ``incoming`` holds the enriched columns and source_name, source_url, source_job_id; ``manual``, ``review_status``, ``is_demo`` and ``submitted_by`` come from the submission options.
    """
    new = incoming.join(settled.where(c("action") == "create").select("posting_id", "job_id"), "posting_id").join(orgs.select("org_id", F.coalesce("short_name", "name").alias("_org")), "org_id")
    option = lambda name, default: F.coalesce(name, default) if name in new.columns else default
    review, manual, t = option("review_status", F.lit("APPROVED")), option("manual", F.lit(False)), ts_lit(now)
    status = status_column(now, missing=F.lit(0), review=review, verified=t, discovered=t, manual=manual)
    slug = F.concat(T.slugify(F.concat_ws(" ", "_org", "title")), F.lit("-"), F.lower(F.hex("job_id")))
    return new.select("job_id", "posting_id", slug.alias("slug"), "org_id", *OWNED, "source_name", "source_url", "source_job_id", "external_key", t.alias("first_discovered_at"), t.alias("last_verified_at"),
                      F.lit(0).alias("missing_runs"), review.alias("review_status"), option("is_demo", F.lit(False)).alias("is_demo"), option("submitted_by", F.lit(None).cast("long")).alias("submitted_by"), status.alias("status"))


def ingest_submissions(submissions: DataFrame, stored: DataFrame, links: DataFrame, now) -> DataFrame:
    """(posting_id, outcome, job_id, review_status, linked): entries by administrators (``trusted``) and by the community.

    A community entry has to be a technology role, adds nothing where its job is already listed, and waits for review (PENDING);
    a trusted one passes the gate, is APPROVED, and attaches its link or updates the job.  Entries of one batch that are the same job count in order.
    """
    from .enrich import is_tech_job
    low = [F.lower(F.coalesce(c(n), F.lit(""))) for n in ("title", "department", "summary")]
    rows = submissions.withColumn("_ok", c("trusted") | is_tech_job(*low))
    ready = materialised(prepare_incoming(rows.where("_ok")))
    decisions, _ = dedupe_decide(ready, stored, links, now)
    settled = settle(ready, decisions, stored)
    d = ready.select("posting_id", "trusted").join(settled, "posting_id")
    outcome = F.when(c("action") == "create", "created").when(~c("trusted"), "already listed").when(c("action") == "same-source", "updated").otherwise("merged")
    review = F.when(c("action") == "create", F.when(c("trusted"), "APPROVED").otherwise("PENDING"))
    done = d.select("posting_id", outcome.alias("outcome"), "job_id", review.alias("review_status"), (c("trusted") | (c("action") == "create")).alias("linked"))
    skipped = rows.where("NOT _ok").select("posting_id", F.lit("not a technology role").alias("outcome"), F.lit(None).cast("bigint").alias("job_id"), F.lit(None).cast("string").alias("review_status"), F.lit(False).alias("linked"))
    return done.unionByName(skipped)


# --- R8: duplicates inside one batch -----------------------------------------------------
def batch_parents(rows: DataFrame) -> DataFrame:
    """(seq, parent): every row points at the best earlier row by the evidence ladder, or at itself.

    ``rows`` carry ``seq`` (the arrival order) and the keys of :func:`prepare_incoming`.
    """
    keys = F.array(*[_evidence(i, k, c(k)) for i, k in enumerate(RUNGS)])
    evidence = rows.select("seq", F.explode(keys).alias("e")).select("seq", "e.rung", "e.key").where(c("key").isNotNull())
    first = evidence.groupBy("key").agg(F.min("seq").alias("first"))
    earlier = evidence.join(first, "key").where(c("first") < c("seq")).groupBy("seq").agg(F.min(F.struct("rung", "first")).alias("m")).select("seq", c("m.first").alias("parent"))
    out = materialised(rows.select("seq", "org_id", "normalized_title", "deadline").join(earlier, "seq", "left"))
    rest = out.where(c("parent").isNull())  # at most one row per fingerprint
    dated = rest.where(c("deadline").isNotNull())
    # Only the most similar row counts, and only from AUTO_MERGE_SIMILARITY on: less similar titles can't change it.
    titles = materialised(similar_titles(dated, rows, R.AUTO_MERGE_SIMILARITY))
    # A row may only look back, so a class is represented by its first row.
    pool = rows.groupBy("org_id", "normalized_title", "deadline").agg(F.min("seq").alias("seq"))
    dated = dated.select("seq", "org_id", c("normalized_title").alias("left_title"), "deadline").join(titles, ["org_id", "left_title"])
    theirs = pool.select("org_id", c("normalized_title").alias("right_title"), c("deadline").alias("d"), c("seq").alias("other"))
    limit = R.DEADLINE_WINDOW_DAYS * MICROS_PER_DAY
    on = ["org_id", "right_title"]
    by_instant = theirs.where(c("d").isNotNull()).withColumn("b", _day(c("d")))
    by_day = by_instant.groupBy(*on, "b").agg(F.min("other").alias("other"), F.min("d").alias("d"))
    near = (dated.withColumn("b", _days(c("deadline"), _INNER)).join(by_day, on + ["b"])
            .unionByName(dated.withColumn("b", _days(c("deadline"), _EDGE)).join(by_instant, on + ["b"]).where(F.abs(F.timestamp_diff("MICROSECOND", "deadline", "d")) <= limit)))
    blank = dated.join(theirs.where(c("d").isNull()), on)
    cols = ["seq", "other", "score", c("d").isNotNull().alias("both")]
    cand = near.select(*cols).unionByName(blank.select(*cols)).where(c("other") < c("seq"))
    best = cand.groupBy("seq").agg(F.min(F.struct((-c("score")).alias("m"), "other", "both")).alias("x"))
    fuzzy = best.where(c("x.both")).select("seq", c("x.other").alias("near"))
    return out.select("seq", "parent").join(fuzzy, "seq", "left").select("seq", F.coalesce("parent", "near", "seq").alias("parent"))


def resolve_batch(rows: DataFrame) -> DataFrame:
    """(seq, root): the canonical row of every row of a batch.

    Pointers are doubled until every row has reached its root, so a chain of n rows takes log2(n) rounds, and rows that have
    reached it rest.  Each round is a table in shared storage, which cuts the lineage and survives the loss of executors.
    """
    p = materialised(batch_parents(rows))
    done = p.where(c("seq") == c("parent")).withColumnRenamed("parent", "root")
    moving, found = p.where(c("seq") != c("parent")), None  # found: those whose root is known
    while not moving.isEmpty():
        known = moving.select(c("seq").alias("_s"), c("parent").alias("_p"), F.lit(False).alias("_end"))
        if found is not None:
            known = known.unionByName(found.select(c("seq").alias("_s"), c("root").alias("_p"), F.lit(True).alias("_end")))
        # A parent that is in neither is a root itself.
        step = materialised(moving.join(known, c("parent") == c("_s"), "left").select("seq", F.coalesce("_p", "parent").alias("parent"), F.coalesce("_end", F.lit(True)).alias("_end")))
        ended = step.where("_end").select("seq", c("parent").alias("root"))
        found = ended if found is None else found.unionByName(ended)
        moving = step.where("NOT _end").select("seq", "parent")
    return done if found is None else done.unionByName(found)


# --- R10–R12 ---------------------------------------------------------------------------
def review_queue(duplicates: DataFrame, jobs: DataFrame, orgs: DataFrame, links: DataFrame) -> DataFrame:
    """Pending pairs, one row per (job, candidate), with both titles, organisations and link counts."""
    pending = duplicates.where(c("status") == "PENDING").groupBy("job_id", "candidate_job_id").agg(F.max("score").alias("score"))
    n = links.groupBy("job_id").agg(F.count("*").alias("links"))
    side = (jobs.join(orgs.select("org_id", c("name").alias("org")), "org_id").join(n, "job_id", "left")
            .select("job_id", "title", "org", F.coalesce("links", F.lit(0).cast("bigint")).alias("links")))
    other = side.select(c("job_id").alias("candidate_job_id"), c("title").alias("candidate_title"), c("org").alias("candidate_org"), c("links").alias("candidate_links"))
    return pending.join(side, "job_id").join(other, "candidate_job_id")


def apply_merge(resolved: DataFrame, links: DataFrame, saved: DataFrame, applications: DataFrame, jobs: DataFrame) -> dict[str, DataFrame]:
    """Tables after merging ``resolved(keep, drop)``: each dropped job has one keeper that is itself kept."""
    m = resolved.select("keep", "drop")

    def moved(df: DataFrame) -> DataFrame:
        return df.join(m, df["job_id"] == m["drop"], "left").withColumn("_moved", c("drop").isNotNull()).withColumn("job_id", F.coalesce("keep", "job_id")).drop("keep", "drop")
    kept = moved(saved).groupBy("user_id", "job_id").agg(F.min_by("created_at", F.struct("_moved", "created_at")).alias("created_at"))
    apps = moved(applications)
    # An application of the keeper stays; of several moved ones the first by time moves.
    one = apps.groupBy("user_id", "job_id").agg(F.min_by(F.struct("status", "updated_at"), F.struct("_moved", "updated_at", "status")).alias("x"))
    return {"links": moved(links).drop("_moved"), "saved": kept, "applications": one.select("user_id", "job_id", "x.status", "x.updated_at"),
            "jobs": jobs.join(m.select(c("drop").alias("job_id")), "job_id", "left_anti")}


#: Columns that an administrator may set.
EDITABLE = ["title", "department", "category", "level", "summary", "location", "work_mode", "salary", "vacancies", "deadline", "application_url", "education_disciplines", "min_cgpa", "masters_required", "no_third_division",
            "min_experience_years", "max_experience_years", "age_limit", "required_skills", "preferred_skills"]


def apply_edits(jobs: DataFrame, edits: DataFrame, links: DataFrame, orgs: DataFrame, now) -> DataFrame:
    """Edited jobs, with ``rescore`` for those whose matches are to be computed anew and ``announce`` for newly approved ones.

    ``edits(job_id, edited_at, edited, decision?, toggle_archive?, <editable columns>)``: the latest edit of a job counts.  Where ``edited`` is true, all editable columns that
    ``edits`` has are set, to null too; the others stay.  A review or archive step alone leaves fingerprint and status as they are, unless it approves.
    """
    from .enrich import requirements_parsed
    from .lifecycle import manual_flags
    last = edits.groupBy("job_id").agg(F.max_by(F.struct(*[x for x in edits.columns if x != "job_id"]), "edited_at").alias("e"))
    j = jobs.drop("org_slug").join(last, "job_id").join(manual_flags(links), "job_id", "left").join(orgs.select("org_id", c("slug").alias("org_slug")), "org_id")
    edited, approved = F.coalesce("e.edited", F.lit(False)), F.coalesce(c("e.decision") == "approve", F.lit(False))
    j = j.withColumns({x: F.when(edited, c(f"e.{x}")).otherwise(c(x)) for x in EDITABLE if x in edits.columns})
    parsed = requirements_parsed(c("education_disciplines"), c("min_cgpa"), c("masters_required"), c("min_experience_years"), c("age_limit"), c("no_third_division"))
    recheck = edited | approved
    j = j.withColumns({
        "requirements_parsed": F.when(edited, parsed).otherwise(c("requirements_parsed")), "normalized_title": F.when(recheck, T.normalize_title(c("title"))).otherwise(c("normalized_title")),
        "review_status": F.when(approved, "APPROVED").when(c("e.decision") == "reject", "REJECTED").otherwise(c("review_status")),
        "archived_at": F.when(c("e.toggle_archive"), F.when(c("archived_at").isNull(), ts_lit(now))).otherwise(c("archived_at")),
        "last_verified_at": F.when(edited | c("e.decision").isNotNull(), ts_lit(now)).otherwise(c("last_verified_at"))})
    manual = ~F.coalesce("sourced", F.lit(False))
    return j.withColumns({
        "fingerprint": F.when(recheck, T.job_fingerprint(c("org_slug"), c("normalized_title"), c("deadline"))).otherwise(c("fingerprint")),
        "status": F.when(recheck, status_column(now, manual=manual)).otherwise(c("status")), "rescore": recheck, "announce": approved}).drop("e", "sourced", "org_slug")
