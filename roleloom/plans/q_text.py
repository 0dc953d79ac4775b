"""Text, URL, hash and similarity functions over whole texts."""

from pyspark.sql import functions as F

from ..functions import rules as R, text as T
from . import sqltext as Q
from .core import register

c = F.col


@register("html_to_text", f"SELECT page_id, {Q.html_to_text('html')} AS text FROM pages")
def _(t):
    return t.pages.select("page_id", T.html_to_text(c("html")).alias("text"))


@register("clean_text", f"SELECT doc_id, {Q.collapse('text')} AS clean FROM documents")
def _(t):
    return t.documents.select("doc_id", T.clean_text(c("text")).alias("clean"))


@register("normalize_title", f"""SELECT job_id, {Q.normalize_title('title')} AS normalized FROM {{v_jobs0}}
  UNION ALL SELECT -1 - doc_id, {Q.normalize_title('text')} FROM documents""")
def _(t):
    return (t.dealt("v_jobs0").select("job_id", T.normalize_title(c("title")).alias("normalized"))
            .unionByName(t.dealt("documents", "documents").select((F.lit(-1) - c("doc_id")).alias("job_id"), T.normalize_title(c("text")).alias("normalized"))))


@register("normalize_org_name", f"SELECT org_id, {Q.normalize_org_name('name')} AS normalized FROM {{v_orgs}}")
def _(t):
    return t.v_orgs.select("org_id", T.normalize_org_name(c("name")).alias("normalized"))


@register("normalize_url", f"""SELECT page_id AS id, {Q.normalize_url('url')} AS url FROM pages
  UNION ALL SELECT -1 - posting_id, {Q.normalize_url("coalesce(application_url, concat(' ', title))")} FROM {{v_postings0}}""")
def _(t):
    postings = t.dealt("v_postings0").select((F.lit(-1) - c("posting_id")).alias("id"),
                                    T.normalize_url(F.coalesce("application_url", F.concat(F.lit(" "), "title"))).alias("url"))
    return t.pages.select(c("page_id").alias("id"), T.normalize_url(c("url")).alias("url")).unionByName(postings)


@register("absolute_url", """SELECT page_id, href, CASE WHEN starts_with(href, '/') THEN concat(regexp_extract(url, '^(https?://[^/]+)', 1), href)
    WHEN starts_with(href, '#') OR href = '' THEN CASE WHEN href IN ('', '#') THEN NULL ELSE concat(regexp_replace(url, '#.*$', ''), href) END
    WHEN regexp_matches(href, '^https?://[^/]+$') THEN concat(href, '/')
    WHEN regexp_matches(href, '^https?:') THEN href
    WHEN regexp_matches(href, '^[a-z]+:') THEN NULL
    ELSE concat(regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', ''), href) END AS link
  FROM (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) h""")
def _(t):
    links = t.pages.select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href"))
    return links.select("page_id", "href", T.absolute_url(c("href"), c("url")).alias("link"))


@register("sha256_hex", "SELECT doc_id, sha256(text) AS digest FROM documents")
def _(t):
    return t.documents.select("doc_id", T.sha256_hex(c("text")).alias("digest"))


@register("job_fingerprint", f"""SELECT job_id, {Q.fingerprint("concat('org-', org_id)", Q.normalize_title('title'), 'deadline')} AS fingerprint FROM {{v_jobs0}}""")
def _(t):
    slug = F.concat(F.lit("org-"), c("org_id"))
    return t.dealt("v_jobs0").select("job_id", T.job_fingerprint(slug, T.normalize_title(c("title")), c("deadline")).alias("fingerprint"))


@register("content_hash", f"""SELECT job_id, {Q.content_hash("concat('org-', org_id)", 'title', 'department', 'summary', Q.iso_utc('deadline'))} AS digest FROM {{v_jobs0}}""")
def _(t):
    slug = F.concat(F.lit("org-"), c("org_id"))
    return t.dealt("v_jobs0").select("job_id", T.content_hash(slug, c("title"), c("department"), c("summary"), T.iso_utc(c("deadline"))).alias("digest"))


@register("external_key", f"""SELECT posting_id, CASE WHEN source_job_id IS NOT NULL THEN concat(source_key, ':id:', source_job_id)
  ELSE concat(source_key, ':u:', substr(sha256(concat(coalesce({Q.normalize_url('application_url')}, {Q.normalize_url('source_url')}, source_url), '|', {Q.normalize_title('title')})), 1, 32)) END AS external_key
  FROM {{v_postings0}}""")
def _(t):
    return t.dealt("v_postings0").select("posting_id", T.external_key(
        c("source_key"), c("source_job_id"), c("application_url"), c("source_url"), T.normalize_title(c("title"))).alias("external_key"))


_PAIRS = f"""WITH p AS (SELECT j.job_id, {Q.normalize_title('j.title')} AS a, {Q.normalize_title('i.title')} AS b
  FROM {{v_jobs0}} j JOIN {{v_postings0}} i ON i.posting_id = j.job_id) """


def _pairs(t):
    a = t.dealt("v_jobs0").select("job_id", T.normalize_title(c("title")).alias("a"))
    b = t.dealt("v_postings0").select(c("posting_id").alias("job_id"), T.normalize_title(c("title")).alias("b"))
    return a.join(b, "job_id")


@register("dice_similarity", _PAIRS + f"SELECT job_id, round({Q.dice('a', 'b')}, 6) AS score FROM p")
def _(t):
    return _pairs(t).select("job_id", F.round(T.dice_similarity(c("a"), c("b")), 6).alias("score"))


@register("token_jaccard", _PAIRS + f"SELECT job_id, round({Q.jaccard('a', 'b')}, 6) AS score FROM p")
def _(t):
    return _pairs(t).select("job_id", F.round(T.token_jaccard(c("a"), c("b")), 6).alias("score"))


@register("title_similarity", _PAIRS + f"SELECT job_id, round({Q.similarity('a', 'b')}, 6) AS score FROM p")
def _(t):
    return _pairs(t).select("job_id", F.round(T.title_similarity_normalized(c("a"), c("b")), 6).alias("score"))


@register("slugify", f"SELECT doc_id, {Q.slugify('text')} AS slug FROM documents")
def _(t):
    return t.documents.select("doc_id", T.slugify(c("text")).alias("slug"))


@register("truncate_words", f"SELECT doc_id, {Q.truncate_words('text', 200)} AS short FROM documents")
def _(t):
    return t.documents.select("doc_id", T.truncate_words(c("text"), 200).alias("short"))


@register("csv_list", f"""SELECT doc_id, array_to_string(list_transform(p[:40], lambda x: substr(x, 1, 80)), '|') AS items FROM (
  SELECT doc_id, list_filter(parts, lambda x, i: x <> '' AND list_position(parts, x) = i) AS p FROM (
    SELECT doc_id, list_transform(regexp_split_to_array(text, '[,\\n]'), lambda s: {Q.strip('s')}) AS parts FROM documents) d) e""")
def _(t):
    return t.documents.select("doc_id", F.array_join(T.csv_list(c("text")), "|").alias("items"))


@register("norm_skill", f"SELECT doc_id, {Q.norm_skill('text')} AS skill FROM documents")
def _(t):
    return t.documents.select("doc_id", T.norm_skill(c("text")).alias("skill"))


@register("skill_matches", f"""WITH m AS (SELECT v.user_id, v.job_id, {Q.norm_skill('ms.s')} AS mine, {Q.norm_skill('ws.s')} AS wanted
    FROM {{v_views}} v JOIN (SELECT user_id, unnest(skills) AS s FROM {{v_profiles}}) ms USING (user_id)
    JOIN (SELECT job_id, unnest(required_skills) AS s FROM {{v_jobs0}}) ws USING (job_id))
  SELECT user_id, job_id, mine, wanted, {Q.skill_matches('mine', 'wanted')} AS matched FROM m""")
def _(t):
    mine = t.v_profiles.select("user_id", F.explode("skills").alias("s")).select("user_id", T.norm_skill(c("s")).alias("mine"))
    wanted = t.v_jobs0.select("job_id", F.explode("required_skills").alias("s")).select("job_id", T.norm_skill(c("s")).alias("wanted"))
    return t.v_views.join(mine, "user_id").join(wanted, "job_id").select(
        "user_id", "job_id", "mine", "wanted", T.skill_matches(c("mine"), c("wanted")).alias("matched"))


@register("sentences", f"SELECT doc_id, array_to_string({Q.sentences('text')}, '|') AS parts FROM documents")
def _(t):
    return t.documents.select("doc_id", F.array_join(T.sentences(c("text")), "|").alias("parts"))


@register("escape_html", """SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS html FROM documents
  UNION ALL SELECT -1 - page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') FROM pages""")
def _(t):
    pages = t.pages.select((F.lit(-1) - c("page_id")).alias("doc_id"), T.escape_html(c("html")).alias("html"))
    return t.documents.select("doc_id", T.escape_html(c("text")).alias("html")).unionByName(pages)


_NOTICE = ["Exam result of ", "Job circular and viva date: ", "", "Joining formalities, ", "Result: apply again for result of "]
_NOTICE_SQL = "concat(split_part('" + "|".join(_NOTICE) + "', '|', cast(job_id % 5 + 1 as int)), title)"


@register("is_non_job_notice", f"""SELECT job_id, title, {Q.has('lower(title)', R.NOTICE)} AND NOT {Q.has(f"regexp_replace(lower(title), {Q.re2(R.NOTICE)}, '')", R.HIRING)} AS notice
  FROM (SELECT job_id, {_NOTICE_SQL} AS title FROM {{v_jobs0}}) x""")
def _(t):
    titles = t.v_jobs0.select("job_id", F.expr(_NOTICE_SQL).alias("title"))
    return titles.select("job_id", "title", T.is_non_job_notice(c("title")).alias("notice"))
