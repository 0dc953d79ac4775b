"""DuckDB spellings of the scalar rules, used only by the SQL checks."""

from ..functions import rules as R
from ..functions.patterns import spell


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    return q(spell(pattern, "re2"))


WS = spell(r"\s", "re2")


def collapse(e: str) -> str:
    return f"trim(regexp_replace({e}, {q(WS + '+')}, ' ', 'g'))"


def strip(e: str) -> str:
    return f"regexp_replace({e}, {q('^' + WS + '+|' + WS + '+$')}, '', 'g')"


def has(e: str, pattern: str) -> str:
    """Rules with look-ahead or look-behind get an RE2 spelling that decides the same."""
    ahead = r"|\bcomputer science\b(?! (and|&) engineering)"
    if ahead in pattern:
        rest = f"regexp_replace({e}, 'computer science (and|&) engineering', '#', 'g')"
        return f"(regexp_matches({e}, {re2(pattern.replace(ahead, ''))}) OR regexp_matches({rest}, '\\bcomputer science\\b'))"
    pattern = pattern.replace(r"(?<![.\w])js\b", r"(^|[^.\w])js\b")
    return f"regexp_matches({e}, {re2(pattern)})"


def group(e: str, pattern: str, idx: int = 1) -> str:
    return f"nullif(regexp_extract({e}, {re2(pattern)}, {idx}), '')"


def html_to_text(e: str) -> str:
    raw = "|".join(fr"<{t}\b[^>]*>.*?</{t}\s*>" for t in ("script", "style", "textarea", "option"))
    t = f"regexp_replace({e}, {q('(?i)<(br|/p|/li|/div|/h[1-6]|/tr)[^>]*>')}, chr(10), 'g')"
    t = f"regexp_replace({t}, {q('(?is)<!--.*?-->|' + raw)}, '', 'g')"
    t = f"regexp_replace({t}, '<[a-zA-Z/!?][^>]*>', '', 'g')"
    t = f"replace(replace({t}, '&nbsp;', ' '), chr(160), ' ')"
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        t = f"replace({t}, {q(entity)}, {q(char)})"
    t = f"regexp_replace({t}, {q('[ ' + chr(9) + ']+')}, ' ', 'g')"
    t = f"regexp_replace({t}, {q('\\n' + WS + '*\\n+')}, chr(10), 'g')"
    return strip(t)


def normalize_title(e: str) -> str:
    t = f"replace(lower({e}), '&', ' and ')"
    for pattern, word in R.TITLE_EXPANSIONS:
        if "(?=" in pattern:
            t = f"regexp_replace({t}, {q(spell(pattern.replace('(?=', '('), 're2'))}, {q(word + chr(92) + '1')}, 'g')"
        else:
            t = f"regexp_replace({t}, {re2(pattern)}, {q(word)}, 'g')"
    t = f"regexp_replace({t}, {q(R.TITLE_PUNCTUATION)}, ' ', 'g')"
    return collapse(f"regexp_replace({t}, {re2(R.TITLE_NOISE)}, ' ', 'g')")


def normalize_org_name(e: str) -> str:
    t = f"regexp_replace(replace(lower({e}), '&', ' and '), {re2(R.ORG_NOISE)}, ' ', 'g')"
    return collapse(f"regexp_replace({t}, '[^a-z0-9 ]+', ' ', 'g')")


URL = r"(?i)^(https?)://([^/?#]+)([^?#]*)(\?[^#]*)?(?:#.*)?$"


def normalize_url(e: str) -> str:
    u = strip(e)
    host = f"regexp_replace(lower(regexp_extract({u}, {q(URL)}, 2)), '^www\\.', '')"
    path = f"regexp_replace(regexp_extract({u}, {q(URL)}, 3), '/+$', '')"
    pairs = f"list_filter(string_split(substr(regexp_extract({u}, {q(URL)}, 4), 2), '&'), lambda p: p <> '')"
    kept = f"list_filter({pairs}, lambda p: NOT regexp_matches(p, {q('(?i)' + R.TRACKING_PARAM.replace('ref$', 'ref(=|$)').replace('source$', 'source(=|$)'))}))"
    ordered = f"list_sort(list_transform({kept}, lambda p: concat(lower(regexp_extract(p, '^([^=]*)', 1)), '=', regexp_extract(p, '^[^=]*=(.*)$', 1))))"
    query = f"array_to_string({ordered}, '&')"
    return (f"CASE WHEN regexp_matches({u}, {q(URL)}) THEN concat('https://', {host}, CASE WHEN {path} = '' THEN '/' ELSE {path} END, "
            f"CASE WHEN {query} = '' THEN '' ELSE concat('?', {query}) END) END")


def local_day(e: str) -> str:
    return f"strftime({e} + INTERVAL 6 HOUR, '%Y-%m-%d')"


def fingerprint(slug: str, normalized: str, deadline: str) -> str:
    return f"substr(sha256(concat({slug}, '|', {normalized}, '|', coalesce({local_day(deadline)}, 'none'))), 1, 40)"


def iso_utc(e: str) -> str:
    return f"(strftime({e}, '%Y-%m-%dT%H:%M:%S') || '.' || lpad(cast(cast(floor((epoch_us({e}) % 1000000) / 1000) as bigint) as varchar), 3, '0') || 'Z')"


def content_hash(*parts: str) -> str:
    cleaned = [collapse(f"lower(coalesce({p}, ''))") for p in parts]
    return f"sha256(concat_ws(chr(1), {', '.join(cleaned)}))"


def dice(a: str, b: str) -> str:
    def grams(x):
        return f"list_transform(generate_series(1, length({x}) - 1), lambda i: substr({x}, i, 2))"
    shared = (f"list_sum(list_transform(list_intersect(list_distinct({grams(a)}), list_distinct({grams(b)})), lambda g: "
              f"least(len(list_filter({grams(a)}, lambda y: y = g)), len(list_filter({grams(b)}, lambda z: z = g)))))")
    return (f"CASE WHEN {a} = {b} THEN 1.0::double WHEN length({a}) < 2 OR length({b}) < 2 THEN 0.0::double "
            f"ELSE 2.0::double * coalesce({shared}, 0) / (length({a}) + length({b}) - 2) END")


def jaccard(a: str, b: str) -> str:
    def toks(x):
        return f"list_distinct(list_filter(string_split({x}, ' '), lambda t: t <> ''))"
    inter = f"len(list_intersect({toks(a)}, {toks(b)}))"
    return (f"CASE WHEN len({toks(a)}) = 0 OR len({toks(b)}) = 0 THEN 0.0::double "
            f"ELSE {inter}::double / (len({toks(a)}) + len({toks(b)}) - {inter}) END")


def similarity(a: str, b: str) -> str:
    return f"greatest({dice(a, b)}, {jaccard(a, b)})"


def slugify(e: str) -> str:
    t = f"regexp_replace(strip_accents(lower({e})), '[^a-z0-9]+', '-', 'g')"
    return f"substr(regexp_replace({t}, '^-+|-+$', '', 'g'), 1, 80)"


def norm_skill(e: str) -> str:
    return f"regexp_replace(lower({e}), '[^a-z0-9#+]', '', 'g')"


def skill_matches(mine: str, wanted: str) -> str:
    return (f"({mine} <> '' AND {wanted} <> '' AND ({mine} = {wanted} OR (length({mine}) >= 3 AND contains({wanted}, {mine})) "
            f"OR (length({wanted}) >= 3 AND contains({mine}, {wanted}))))")


def sentences(e: str) -> str:
    marked = f"regexp_replace({e}, {q('([.;!?])' + WS + '+')}, {q(chr(92) + '1' + chr(10))}, 'g')"
    return f"list_filter(list_transform(regexp_split_to_array({marked}, '\\n+|•|·'), lambda s: {strip('s')}), lambda s: s <> '')"


def truncate_words(e: str, limit: int) -> str:
    cut = f"substr({e}, 1, {limit - 1})"
    space = f"(CASE WHEN contains({cut}, ' ') THEN length({cut}) - strpos(reverse({cut}), ' ') ELSE -1 END)"
    keep = f"CASE WHEN {space} > {limit * 0.6} THEN substr({cut}, 1, {space}) ELSE {cut} END"
    return f"CASE WHEN length({e}) <= {limit} THEN {e} ELSE concat(regexp_replace({keep}, {q(WS + '+$')}, ''), '…') END"


def hours_until(target: str, now: str) -> str:
    return f"((epoch_us({target}) - epoch_us({now}))::double / 3.6e9)"


def fmt_date(e: str) -> str:
    return f"coalesce(replace(strftime({e} + INTERVAL 6 HOUR, '%d %b %Y'), 'Sep', 'Sept'), 'Not specified')"


def fmt_datetime(e: str) -> str:
    l = f"{e} + INTERVAL 6 HOUR"
    return f"coalesce(replace(strftime({l}, '%d %b %Y'), 'Sep', 'Sept') || ', ' || lower(strftime({l}, '%I:%M %p')) || ' BST', 'Not specified')"


def strings(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def listed(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def month(e: str) -> str:
    return "CASE " + " ".join(f"WHEN {e} = {q(k)} THEN {v}" for k, v in R.MONTHS.items()) + " END"


def parse_local_date(e: str) -> str:
    """End of local day; ISO date-times are taken as UTC here (the checks feed none with another zone)."""
    t = f"lower({strip(e)})"
    t = f"regexp_replace({t}, {q(spell(r'(\d+)(st|nd|rd|th)\b', 're2'))}, '\\1', 'g')"
    t = f"regexp_replace(replace({t}, ',', ' '), {q(WS + '+')}, ' ', 'g')"
    t = f"regexp_replace({t}, {q(r'\b(\d{1,2})[-./]([a-z]{3,9})[-./](\d{4})\b')}, '\\1 \\2 \\3', 'g')"
    ymd, dmy = r"\b(\d{4})-(\d{1,2})-(\d{1,2})\b", r"\b(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})\b"
    d_mon, mon_d = r"\b(\d{1,2}) ([a-z]{3,9}) (\d{4})\b", r"\b([a-z]{3,9}) (\d{1,2}) (\d{4})\b"

    def g(p, n):
        return f"nullif(regexp_extract({t}, {q(p)}, {n}), '')"

    def i(p, n):
        return f"try_cast({g(p, n)} as int)"
    m3, m1 = month(g(d_mon, 2)), month(g(mon_d, 1))
    ymd_ok, dmy_ok = f"{i(ymd, 1)} > 0", f"{i(dmy, 3)} > 0"
    d_ok, m_ok = f"({m3}) IS NOT NULL AND {i(d_mon, 3)} > 0", f"({m1}) IS NOT NULL AND {i(mon_d, 3)} > 0"

    def choose(a, b, c, d):
        return f"CASE WHEN {ymd_ok} THEN {a} WHEN {dmy_ok} THEN {b} WHEN {d_ok} THEN {c} WHEN {m_ok} THEN {d} END"
    y = choose(i(ymd, 1), i(dmy, 3), i(d_mon, 3), i(mon_d, 3))
    m = choose(i(ymd, 2), i(dmy, 2), m3, m1)
    d = choose(i(ymd, 3), i(dmy, 1), i(d_mon, 1), i(mon_d, 2))
    iso = f"try_cast(regexp_replace(replace({t}, 't', ' '), 'z$', '') as timestamp)"
    return (f"CASE WHEN regexp_matches({t}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}t\\d{{2}}:\\d{{2}}') THEN {iso} "
            f"WHEN {y} BETWEEN 2000 AND 2100 THEN try_cast(printf('%04d-%02d-%02d', {y}, {m}, {d}) as timestamp) "
            f"- INTERVAL 6 HOUR + INTERVAL 86399 SECOND END")
