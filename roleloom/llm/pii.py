"""Format-preserving pseudonyms for personal data, in DataFrame operations alone.

Card numbers, phone numbers, addresses of machines, social security numbers and
dates are found by pattern, validated, and permuted inside their own format by a
keyed Feistel network: the pair of halves (a, b) lives in Z_A x Z_B, every round adds
a keyed hash of one half to the other, so the map is a permutation of the format, the
same value gets the same pseudonym in every document, and the key holder can undo it.
Mail addresses and secrets have no numeric format; they become keyed names of theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ROUNDS = 10
#: 1800-01-01 to 2199-12-31 has 189 * 773 days.
FIRST_DAY, DAY_A, DAY_B = "1800-01-01", 189, 773

#: A mail address begins at a letter or digit, also behind any of ._%+-, which stay.
EMAIL = r"(?<![\p{L}\p{N}])[\p{L}\p{N}][\p{L}\p{N}._%+-]{0,63}+@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63}){1,8}"
SECRET = r"(?<![A-Za-z])(?i:api[_-]?key|access[_-]?key|token|secret|password)[\"']?[ \t]{0,4}[=:][ \t]{0,4}[\"']?[A-Za-z0-9+/_.=-]{16,}"
CARD = r"(?<![\w.-])\d{13,19}(?!\w)|(?<![\w.-])\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}(?![\d-])|(?<![\w.-])\d{4}[ -]\d{6}[ -]\d{4,5}(?![\d-])"
ADDRESS = r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\d|\w)"
DATE = r"(?<![\w.-])\d{4}-\d{2}-\d{2}(?![\d-])|(?<![\w/])\d{2}/\d{2}/\d{4}(?![\d/])|(?<![\w.])\d{2}\.\d{2}\.\d{4}(?!\.?\d)"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\d-])"
#: Back references would count groups of the whole, so the grouped card form is spelled out here.
_CARD = CARD.replace("([ -])", "[ -]").replace(r"\1", "[ -]")
#: A phone number of 7 digits or more ends before a blank that another number follows; four groups of four before a fifth may be its own last and a card.
_NEXT = rf"(?! (?:(?:{_CARD})(?![ -]\d{{4}}(?!\d))|\d{{1,3}}(?:\.\d{{1,3}}){{3}}(?![.\w])|{DATE}|{SSN}|\d{{3}}[-.]\d{{3}}[-.]\d{{4}}(?![\d-])))"


def _more(have: int) -> str:
    """Further digits, single or in groups, that bring ``have`` to 7 at least and 15 at most."""
    least = max(7 - have, 0)
    return rf"(?:[ .-]?\d){{{least}}}(?:{_NEXT}[ .-]?\d){{0,{15 - have - least}}}"


#: A country code and groups of any size, of 7 to 15 digits in all; the first group behind the code may stand in parentheses.
_GLOBAL = "|".join([*[rf"\d{{{i}}}[ .-]?\(\d{{{j}}}\){_more(i + j)}" for i in (1, 2, 3) for j in (1, 2, 3, 4)], rf"\d{_more(1)}"])
PHONE = rf"(?<![\w+])\+(?:{_GLOBAL})(?!\d)|(?<![\w(])\(\d{{3}}\) ?\d{{3}}-\d{{4}}(?!\d)|(?<![\w.-])\d{{3}}[-.]\d{{3}}[-.]\d{{4}}(?![\d-])"
#: Country codes; they are prefix-free, so the code does not depend on how a number is spaced.
COUNTRY = r"^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
ANY = "|".join([EMAIL, SECRET, PHONE, _CARD, ADDRESS, DATE, SSN])
KINDS = {"email": rf"^[^@]+@[^@]+$", "secret": r"^[A-Za-z_-]+[\"']?[ \t]*[=:]", "ssn": r"^\d{3}-\d{2}-\d{4}$", "address": r"^\d{1,3}(\.\d{1,3}){3}$",
         "date": r"^(\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})$", "card": r"^(\d{13,19}|\d{4}([ -])\d{4}\2\d{4}\2\d{1,7}|\d{4}([ -])\d{6}\3\d{4,5})$", "phone": r"^[+(]|^\d{3}[-.]\d{3}[-.]\d{4}$"}

c, lit = F.col, F.lit


def _keyed(key: str, *parts: Column) -> Column:
    """60 bits of a keyed hash."""
    text = F.concat_ws("\x1f", lit(key), *[p.cast("string") for p in parts], lit(key))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def feistel(a: Column, b: Column, size_a: Column, size_b: Column, tag: Column, key: str, inverse: bool = False) -> Column:
    """Keyed permutation of (a, b) in Z_size_a x Z_size_b; returns a struct of a and b."""
    sign = -1 if inverse else 1

    def step(s, r):
        first = F.struct(F.pmod(s["a"] + sign * (_keyed(key, tag, r, s["b"]) % size_a), size_a).alias("a"), s["b"].alias("b"))
        second = F.struct(s["a"].alias("a"), F.pmod(s["b"] + sign * (_keyed(key, tag, r, s["a"]) % size_b), size_b).alias("b"))
        return F.when(r % 2 == 0, first).otherwise(second)

    rounds = F.array(*[lit(r) for r in (range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS))])
    return F.aggregate(rounds, F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step)


def _digits_permuted(digits: Column, tag: Column, key: str, inverse: bool) -> Column:
    """Digits of the same count; at most 20."""
    n = F.length(digits)
    left = F.floor(n / 2).cast("int")
    out = feistel(F.substr(digits, lit(1), left).cast("long"), F.substr(digits, left + 1).cast("long"), F.pow(lit(10), left).cast("long"), F.pow(lit(10), n - left).cast("long"),
                  F.concat(tag, n.cast("string")), key, inverse)
    # One array holds the result, so that the rounds run once.
    return F.element_at(F.transform(F.array(out), lambda s: F.concat(F.lpad(s["a"].cast("string"), left, "0"), F.lpad(s["b"].cast("string"), n - left, "0"))), 1)


def _luhn_sum(digits: Column, doubled_first: bool) -> Column:
    """Luhn sum from the right; ``doubled_first``: the last digit counts double."""
    odd = 0 if doubled_first else 1
    values = F.transform(F.split(F.reverse(digits), ""), lambda x, i: F.when(i % 2 == odd, x.cast("int") * 2 - F.when(x.cast("int") > 4, 9).otherwise(0)).otherwise(x.cast("int")))
    return F.aggregate(values, lit(0), lambda t, x: t + F.coalesce(x, lit(0)))


def _refilled(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced, in order, by ``digits``."""
    def step(s, ch):
        is_digit = ch.rlike("^[0-9]$")
        return F.struct(F.concat(s["o"], F.when(is_digit, F.substr(digits, s["i"], lit(1))).otherwise(ch)).alias("o"), (s["i"] + F.when(is_digit, 1).otherwise(0)).alias("i"))
    return F.aggregate(F.split(form, ""), F.struct(lit("").alias("o"), lit(1).alias("i")), step, lambda s: s["o"])


def _date_format(m: Column) -> Column:
    return F.when(m.contains("-"), "yyyy-MM-dd").when(m.contains("."), "dd.MM.yyyy").when(F.try_to_timestamp(m, lit("dd/MM/yyyy")).isNotNull(), "dd/MM/yyyy").otherwise("MM/dd/yyyy")


def _day(m: Column) -> Column:
    """Days since FIRST_DAY; null for what is no date of the range."""
    parsed = F.coalesce(*[F.try_to_timestamp(m, lit(f)) for f in ("yyyy-MM-dd", "dd.MM.yyyy", "dd/MM/yyyy", "MM/dd/yyyy")]).cast("date")
    day = F.datediff(parsed, lit(FIRST_DAY).cast("date"))
    return F.when((day >= 0) & (day < DAY_A * DAY_B), day)


def _date_permuted(m: Column, key: str, inverse: bool) -> Column:
    day = _day(m)
    out = feistel(F.floor(day / DAY_B), day % DAY_B, lit(DAY_A), lit(DAY_B), lit("date"), key, inverse)
    fields = F.transform(F.array(out), lambda s: F.date_add(lit(FIRST_DAY).cast("date"), (s["a"] * DAY_B + s["b"]).cast("int")))
    d = F.element_at(fields, 1)
    spelled = F.when(m.contains("-"), F.date_format(d, "yyyy-MM-dd")).when(m.contains("."), F.date_format(d, "dd.MM.yyyy"))
    return spelled.when(_date_format(m) == "dd/MM/yyyy", F.date_format(d, "dd/MM/yyyy")).otherwise(F.date_format(d, "MM/dd/yyyy"))


def _address_permuted(m: Column, key: str, inverse: bool) -> Column:
    o = [F.get(F.split(m, r"\."), i).cast("long") for i in range(4)]
    out = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], lit(65536), lit(65536), lit("address"), key, inverse)
    return F.element_at(F.transform(F.array(out), lambda s: F.concat_ws(".", *[F.floor(s[h] / 256).cast("string") if top else (s[h] % 256).cast("string") for h in "ab" for top in (True, False)])), 1)


def _ssn_permuted(digits: Column, key: str, inverse: bool) -> Column:
    """Numbers that were ever given out: area 001-899 but 666, group 01-99, serial 0001-9999."""
    area, group, serial = (F.substr(digits, lit(a), lit(n)).cast("long") for a, n in ((1, 3), (4, 2), (6, 4)))
    out = feistel(area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1, lit(898), lit(99 * 9999), lit("ssn"), key, inverse)
    padded = lambda x, n: F.lpad(x.cast("string"), n, "0")
    return F.element_at(F.transform(F.array(out), lambda s: F.concat(padded(s["a"] + F.when(s["a"] >= 665, 2).otherwise(1), 3), padded(F.floor(s["b"] / 9999) + 1, 2), padded(s["b"] % 9999 + 1, 4))), 1)


def _kind(m: Column) -> Column:
    """Kind of a match, or null for one that fails validation."""
    digits = F.regexp_replace(m, r"\D", "")
    kind = None
    for name in KINDS:
        test = m.rlike(KINDS[name])
        if name == "card":
            test = test & (_luhn_sum(digits, False) % 10 == 0)
        if name == "date":
            test = test & _day(m).isNotNull()
        if name == "ssn":
            test = test & ~m.rlike(r"^(000|666|9\d\d)|^\d{3}-00|0000$")
        if name == "phone":
            test = test & F.length(digits).between(7, 15)
        kind = F.when(test, name) if kind is None else kind.when(test, name)
    return kind


def _pseudonym(m: Column, kind: Column, key: str, inverse: bool) -> Column:
    digits = F.regexp_replace(m, r"\D", "")
    payload = F.substr(digits, lit(1), F.length(digits) - 1)
    card = F.element_at(F.transform(F.array(_digits_permuted(payload, lit("card"), key, inverse)), lambda p: F.concat(p, ((10 - _luhn_sum(p, True) % 10) % 10).cast("string"))), 1)
    country = F.length(F.when(m.startswith("+"), F.regexp_extract(digits, COUNTRY, 1)).otherwise(""))
    national = F.substr(digits, country + 1)
    phone = F.concat(F.substr(digits, lit(1), country), _digits_permuted(national, lit("phone"), key, inverse))
    spelled = (F.when(kind == "card", _refilled(m, card)).when(kind == "phone", _refilled(m, phone)).when(kind == "ssn", _refilled(m, _ssn_permuted(digits, key, inverse)))
               .when(kind == "address", _address_permuted(m, key, inverse)).when(kind == "date", _date_permuted(m, key, inverse)))
    if inverse:
        return spelled.otherwise(m)
    name = lambda part: F.lower(F.lpad(F.conv(_keyed(key, kind, part).cast("string"), 10, 16), 15, "0"))
    value = F.regexp_extract(m, r"[=:][ \t]*[\"']?([A-Za-z0-9+/_.=-]+)$", 1)
    return (spelled.when(kind == "email", F.concat(lit("user."), name(F.lower(m)), lit("@masked.invalid")))
            .when(kind == "secret", F.concat(F.substr(m, lit(1), F.length(m) - F.length(value)), lit("masked."), name(value))).otherwise(m))


def pseudonymize(documents: DataFrame, key: str, text: str = "text", inverse: bool = False) -> DataFrame:
    """``documents`` with the personal data in ``text`` replaced, plus n_masked and a map of counts by kind.

    Card numbers have to pass Luhn's check and their pseudonyms pass it too; dates have to exist between 1800 and 2199 and stay dates;
    phone numbers keep country code and punctuation; numbers that fail validation stay as they are.  ``inverse`` undoes numbers and dates
    with the same key, but for dates only spelled month first (their pseudonym may read day first).  Null texts stay null and
    empty ones empty; every row stays, repeated rows alike; columns named n_masked or masked_kinds are replaced, all others stay.
    """
    t = c(text)
    found = F.when(t.rlike("[0-9@=:]"), F.regexp_extract_all(t, lit(ANY), lit(0)))
    out = documents.withColumn("__pii_m", F.coalesce(found, F.array().cast("array<string>")))
    out = out.withColumn("__pii_k", F.transform("__pii_m", lambda m: F.struct(m.alias("m"), _kind(m).alias("k"))))
    out = out.withColumn("__pii_p", F.transform("__pii_k", lambda s: _pseudonym(s["m"], s["k"], key, inverse)))
    joined = F.array_join(F.zip_with(F.split(t, ANY, -1), F.concat("__pii_p", F.array(lit(""))), lambda gap, p: F.concat(gap, p)), "")
    count = lambda k: F.size(F.filter("__pii_k", lambda s: F.coalesce(s["k"] == k, lit(False)))).cast("long")
    kinds = F.map_from_entries(F.array(*[F.struct(lit(k), count(k)) for k in sorted(KINDS)]))
    return (out.withColumn(text, F.when(F.size("__pii_m") == 0, t).otherwise(joined)).withColumn("n_masked", F.size(F.filter("__pii_k", lambda s: s["k"].isNotNull())).cast("long"))
            .withColumn("masked_kinds", kinds).drop("__pii_m", "__pii_k", "__pii_p"))
