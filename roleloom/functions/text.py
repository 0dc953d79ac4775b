"""Scalar text, URL, hash and similarity functions, built from native column
expressions.  Those with a lambda over an array (``transform``, ``filter``, ``exists``,
``aggregate``) are evaluated in the JVM but outside whole-stage code generation."""

import functools
import unicodedata

from pyspark.sql import Column, functions as F

from . import rules as R
from .patterns import BLANKS, has, let, needs, spell, sub


def collapse(c: Column) -> Column:
    return F.trim(sub(c, r"\s+", " "))


def clean_text(c: Column) -> Column:
    return collapse(F.coalesce(c, F.lit("")))


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(c, F.lit(BLANKS))


def html_to_text(c: Column) -> Column:
    t = F.regexp_replace(c, r"(?i)<(br|/p|/li|/div|/h[1-6]|/tr)[^>]*>", "\n")
    t = F.regexp_replace(t, r"(?is)<!--.*?-->|<(script|style|textarea|option)\b[^>]*>.*?</\1\s*>", "")
    t = F.regexp_replace(t, r"<[a-zA-Z/!?][^>]*>", "")
    t = F.regexp_replace(t, r"&nbsp;|\x{00A0}", " ")
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, spell(r"\n\s*\n+"), "\n")
    return strip(t)


def _sub_where_met(c: Column, pattern: str, replacement: str) -> Column:
    """``sub`` for texts that hold a literal of the pattern; others skip the regex."""
    words = needs(pattern)
    return let(c, lambda t: F.when(functools.reduce(lambda a, b: a | b, [t.contains(w) for w in words]), sub(t, pattern, replacement)).otherwise(t))


def normalize_title(c: Column) -> Column:
    t = F.replace(F.lower(c), F.lit("&"), F.lit(" and "))
    for pattern, word in R.TITLE_EXPANSIONS:
        t = _sub_where_met(t, pattern, word)
    t = F.regexp_replace(t, R.TITLE_PUNCTUATION, " ")
    return collapse(sub(t, R.TITLE_NOISE, " "))


def normalize_org_name(c: Column) -> Column:
    t = F.replace(F.lower(c), F.lit("&"), F.lit(" and "))
    t = sub(t, R.ORG_NOISE, " ")
    return collapse(F.regexp_replace(t, r"[^a-z0-9 ]+", " "))


# --- URLs ---------------------------------------------------------------------
_URL = r"(?i)^(https?)://(?:[^/?#@]*@)?([^/?#]+)([^?#]*)(\?[^#]*)?(?:#.*)?\z"


def _tidy_path(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments and encode blanks."""
    def tidy(encoded: Column) -> Column:
        parts = F.split(encoded, "/")
        last = F.element_at(parts, -1)
        stack = F.aggregate(
            parts, F.array().cast("array<string>"),
            lambda acc, p: F.when(p == "..", F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc))
            .when(p == ".", acc).otherwise(F.concat(acc, F.array(p))))
        joined = F.array_join(stack, "/")
        dotted = F.when(last.isin(".", ".."), F.concat(joined, F.lit("/"))).otherwise(joined)
        return F.when(encoded.rlike(r"(^|/)\.\.?(/|\z)"), dotted).otherwise(encoded)
    return let(F.replace(path, F.lit(" "), F.lit("%20")), tidy)


def _host(url: Column) -> Column:
    scheme = F.lower(F.regexp_extract(url, _URL, 1))
    host = F.lower(F.regexp_extract(url, _URL, 2))
    port = F.when(scheme == "http", F.regexp_replace(host, r":80?\z|:80\z", "")).otherwise(F.regexp_replace(host, r":443\z", ""))
    return F.regexp_replace(port, r":\z", "")


def _encode(c: Column) -> Column:
    t = F.url_encode(c)
    for was, now in (("+", "%20"), ("%7E", "~"), ("%21", "!"), ("%28", "("), ("%29", ")")):
        t = F.replace(t, F.lit(was), F.lit(now))
    return t


def _decode(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def _tidy_query(text: Column) -> Column:
    """Parameters without tracking ones, in order of their lower-case names."""
    pairs = F.filter(F.split(F.substr(text, F.lit(2)), "&"), lambda p: p != "")
    params = F.transform(pairs, lambda p: F.struct(
        _decode(F.regexp_extract(p, r"^([^=]*)", 1)).alias("k"),
        _decode(F.regexp_extract(p, r"^[^=]*=(.*)\z", 1)).alias("v")))
    kept = F.filter(params, lambda p: ~p["k"].rlike("(?i)" + R.TRACKING_PARAM))
    ordered = F.array_sort(F.transform(kept, lambda p, i: F.struct(F.lower(p["k"]).alias("k"), i.alias("i"), p["v"].alias("v"))))
    query = F.array_join(F.transform(ordered, lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))), "&")
    return let(query, lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")))


def normalize_url(c: Column) -> Column:
    """Canonical form for duplicate detection, null for anything that is no web address.

    Every step is evaluated once: a web address only, its path and its query each by a ``let``.
    """
    def build(url: Column) -> Column:
        host = F.regexp_replace(_host(url), r"^www\.", "")
        path = let(F.regexp_replace(_tidy_path(F.regexp_extract(url, _URL, 3)), r"/+\z", ""), lambda p: F.when(p == "", F.lit("/")).otherwise(p))
        query = let(F.regexp_extract(url, _URL, 4), lambda q: F.when(q == "", F.lit("")).otherwise(_tidy_query(q)))
        return F.when(url.rlike(_URL), F.concat(F.lit("https://"), host, path, query))
    return let(strip(c), build)


def absolute_url(href: Column, base: Column) -> Column:
    """Resolve a link against its page; null for empty, fragment-only, script, mail and non-web links."""
    return let(F.struct(strip(href).alias("h"), base.alias("base")), lambda s: _absolute(s["h"], s["base"]))


def _absolute(h: Column, base: Column) -> Column:
    scheme = F.lower(F.regexp_extract(base, _URL, 1))
    origin = F.concat(scheme, F.lit("://"), _host(base))
    base_path = F.regexp_extract(base, _URL, 3)
    folder = F.when(base_path == "", F.lit("/")).otherwise(F.regexp_replace(base_path, r"[^/]*\z", ""))
    base_file = F.when(base_path == "", F.lit("/")).otherwise(base_path)
    tail = F.regexp_extract(h, r"([?#].*)?\z", 1)
    h_path = F.regexp_extract(h, r"^([^?#]*)", 1)
    web = F.when(F.regexp_extract(h, _URL, 3) == "", F.lit("/")).otherwise(_tidy_path(F.regexp_extract(h, _URL, 3)))
    whole = F.concat(F.lower(F.regexp_extract(h, _URL, 1)), F.lit("://"), _host(h), web, F.regexp_extract(h, r"^[^?#]*([?#].*)?\z", 1))
    scheme_less = F.concat(scheme, F.lit(":"), h)
    resolved = (
        F.when(h.rlike(_URL), whole)
        .when(h.rlike(r"(?i)^[a-z][a-z0-9+.\-]*:"), F.lit(None).cast("string"))
        .when(h.startswith("//"), F.when(scheme_less.rlike(_URL), scheme_less))
        .when(h.startswith("/"), F.concat(origin, _tidy_path(h_path), tail))
        .when(h.startswith("?"), F.concat(origin, base_file, h))
        .when(h.startswith("#"), F.concat(origin, base_file, F.regexp_extract(base, r"^[^?#]*(\?[^#]*)?", 1), h))
        .otherwise(F.concat(origin, _tidy_path(F.concat(folder, h_path)), tail)))
    usable = h.isNotNull() & (h != "") & (h != "#") & ~h.startswith("javascript:") & ~h.startswith("mailto:")
    return F.when(usable & base.rlike(_URL), resolved)


# --- hashes and keys ------------------------------------------------------------
def sha256_hex(c: Column) -> Column:
    return F.sha2(c, 256)


def local_day(ts: Column) -> Column:
    return F.date_format(ts + F.expr(f"INTERVAL '{R.LOCAL_OFFSET_HOURS}' HOUR"), "yyyy-MM-dd")


def job_fingerprint(org_slug: Column, normalized: Column, deadline: Column) -> Column:
    day = F.coalesce(local_day(deadline), F.lit("none"))
    return F.substring(F.sha2(F.concat_ws("|", org_slug, normalized, day), 256), 1, 40)


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def content_hash(*parts: Column) -> Column:
    cleaned = [collapse(F.lower(F.coalesce(p, F.lit("")))) for p in parts]
    return F.sha2(F.concat_ws("\u0001", *cleaned), 256)


def external_key(source_key: Column, source_job_id: Column, application_url: Column, source_url: Column, normalized: Column, norm_url: Column | None = None) -> Column:
    """``norm_url`` is the normalised ``application_url`` where the caller has it already."""
    url = F.coalesce(normalize_url(application_url) if norm_url is None else norm_url, normalize_url(source_url), source_url)
    hashed = F.substring(F.sha2(F.concat_ws("|", url, normalized), 256), 1, 32)
    has_id = source_job_id.isNotNull() & (source_job_id != "")
    return F.when(has_id, F.concat(source_key, F.lit(":id:"), source_job_id)).otherwise(F.concat(source_key, F.lit(":u:"), hashed))


# --- similarity -------------------------------------------------------------------
def bigrams(c: Column) -> Column:
    return (F.when(F.length(c) >= 2, F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(c, i, F.lit(2))))
            .otherwise(F.array().cast("array<string>")))


def numbered_bigrams(c: Column) -> Column:
    """Bigrams with their occurrence number, so a multiset overlap becomes a plain set intersection."""
    return let(bigrams(sub(c, r"\s+", " ")), lambda g: F.transform(g, lambda x, i: (
        F.when(F.array_position(g, x) == i + 1, F.concat(x, F.lit("1")))
        .otherwise(F.concat(x, F.size(F.filter(F.slice(g, F.lit(1), i + 1), lambda y: y == x)).cast("string"))))))


def tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, " "), lambda t: t != ""))


def dice_of(a: Column, b: Column, ga: Column, gb: Column) -> Column:
    """Dice coefficient from the texts and their numbered bigrams."""
    return (F.when(a == b, F.lit(1.0)).when((F.length(a) < 2) | (F.length(b) < 2), F.lit(0.0))
            .otherwise(F.lit(2.0) * F.size(F.array_intersect(ga, gb)) / (F.size(ga) + F.size(gb))))


def jaccard_of(ta: Column, tb: Column) -> Column:
    """Jaccard coefficient of two token sets."""
    shared = F.size(F.array_intersect(ta, tb))
    return (F.when((F.size(ta) == 0) | (F.size(tb) == 0), F.lit(0.0))
            .otherwise(shared / (F.size(ta) + F.size(tb) - shared)))


def dice_similarity(a: Column, b: Column) -> Column:
    return let(F.struct(a.alias("a"), b.alias("b")), lambda s: dice_of(s["a"], s["b"], numbered_bigrams(s["a"]), numbered_bigrams(s["b"])))


def token_jaccard(a: Column, b: Column) -> Column:
    return let(F.struct(tokens(a).alias("a"), tokens(b).alias("b")), lambda s: jaccard_of(s["a"], s["b"]))


def title_similarity_normalized(a: Column, b: Column) -> Column:
    return F.greatest(dice_similarity(a, b), token_jaccard(a, b))


def title_similarity(a: Column, b: Column) -> Column:
    return let(F.struct(normalize_title(a).alias("a"), normalize_title(b).alias("b")), lambda s: title_similarity_normalized(s["a"], s["b"]))


# --- small helpers ----------------------------------------------------------------
@functools.cache
def _folding() -> tuple[str, str, dict[str, str]]:
    """Characters with a compatibility decomposition: those of one plain character (from, to), and the longer ones."""
    one_from, one_to, longer = [], [], {}
    for i in range(0x80, 0x20000):  # the planes beyond have no letters or digits of the Latin script
        ch = chr(i)
        if unicodedata.category(ch) in ("Cs", "Co", "Cn") or 0xAC00 <= i <= 0xD7A3:  # nothing of Hangul is plain
            continue
        plain = "".join(x for x in unicodedata.normalize("NFKD", ch).lower() if not "\u0300" <= x <= "\u036f")
        if plain != ch and any("a" <= x <= "z" or "0" <= x <= "9" for x in plain):
            if len(plain) == 1:
                one_from.append(ch)
                one_to.append(plain)
            else:
                longer[ch] = plain
    return "".join(one_from), "".join(one_to), longer


_MARKS = r"[\x{0300}-\x{036F}]"


def slugify(c: Column) -> Column:
    """Lower-case letters and digits of the text's NFKD form, joined by hyphens."""
    folded, plain, longer = _folding()
    t = F.translate(F.lower(c), folded, plain)
    # Ligatures and the like become several characters; a text without any skips the lookup.
    table = F.str_to_map(F.lit("\x02".join(f"{k}\x01{v}" for k, v in longer.items())), F.lit("\x02"), F.lit("\x01"))
    opened = F.array_join(F.transform(F.split(t, ""), lambda x: F.coalesce(F.try_element_at(table, x), x)), "")
    t = F.when(t.rlike("[" + "".join(longer) + "]"), opened).otherwise(t)
    t = F.regexp_replace(t, _MARKS, "")
    t = F.regexp_replace(F.regexp_replace(t, r"[^a-z0-9]+", "-"), r"^-+|-+\z", "")
    return F.substring(t, 1, 80)


def truncate_words(c: Column, limit: int) -> Column:
    cut = F.substring(c, 1, limit - 1)
    space = F.length(cut) - F.instr(F.reverse(cut), " ")  # zero-based index of the last blank
    space = F.when(F.instr(cut, " ") > 0, space).otherwise(F.lit(-1))
    keep = F.when(space > limit * 0.6, F.substring(cut, F.lit(1), space)).otherwise(cut)
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.regexp_replace(keep, spell(r"\s+$"), ""), F.lit("…")))


def csv_list(c: Column, max_items: int = 40, max_len: int = 80) -> Column:
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), r"[,\n]"), strip)
    unique = F.array_distinct(F.filter(parts, lambda p: p != ""))
    return F.transform(F.slice(unique, 1, max_items), lambda p: F.substring(p, 1, max_len))


def norm_skill(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^a-z0-9#+]", "")


def skill_matches(mine: Column, wanted: Column) -> Column:
    """Both sides already normalised; equal, or one contains the other when the contained one has 3+ characters."""
    return ((mine != "") & (wanted != "") & (
        (mine == wanted) | ((F.length(mine) >= 3) & F.contains(wanted, mine)) | ((F.length(wanted) >= 3) & F.contains(mine, wanted))))


def sentences(c: Column) -> Column:
    parts = F.split(c, spell(r"(?<=[.;!?])\s+|\n+|•|·"))
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def escape_html(c: Column) -> Column:
    t = c
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        t = F.replace(t, F.lit(char), F.lit(entity))
    return t


def is_non_job_notice(title: Column) -> Column:
    """Announcement wording present and, once its first occurrence is cut out, no hiring wording left."""
    t = F.lower(title)
    before = F.regexp_extract(t, "(?s)^(.*?)" + spell(R.NOTICE), 1)
    word = F.regexp_extract(t, spell(R.NOTICE), 0)
    rest = F.concat(before, F.substring(t, F.length(before) + F.length(word) + 1, F.length(t)))
    return has(t, R.NOTICE) & ~has(rest, R.HIRING)
