"""Spell one rule pattern for Java (Spark) or RE2 (the SQL check).

``\\b`` in the rule tables is the ASCII word boundary, but Java 17's ``\\b``
looks at Unicode letters, so it is written as an ASCII look-around.  ``\\s``
covers Unicode white space in both spellings, and ``$`` is the end of the text
(Java's ``$`` would also match before a final line break).
"""

from functools import reduce, wraps

from pyspark import SparkContext
from pyspark.sql import Column, functions as F

_SPACE = r"\s\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: The same characters as a text.
BLANKS = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
_START = r"(?<![A-Za-z0-9_])"
_END = r"(?![A-Za-z0-9_])"
_EITHER = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def _branches(body: str) -> list[str]:
    """Alternatives of a group body, split at its own level only."""
    parts, depth, cur, i = [], 0, "", 0
    while i < len(body):
        if body[i] == "\\":
            cur += body[i:i + 2]
            i += 2
            continue
        depth += (body[i] == "(") - (body[i] == ")")
        if body[i] == "|" and depth == 0:
            parts.append(cur)
            cur = ""
        else:
            cur += body[i]
        i += 1
    return parts + [cur]


def _closing(pattern: str, start: int) -> int:
    depth, i = 0, start
    while True:
        if pattern[i] == "\\":
            i += 2
            continue
        depth += (pattern[i] == "(") - (pattern[i] == ")")
        if depth == 0:
            return i
        i += 1


def _boundary(pattern: str, i: int) -> str:
    """A one-sided look-around where the neighbour is always a word character, the full boundary otherwise."""
    rest, before = pattern[i + 2:], pattern[:i]
    if rest.startswith("("):
        body = rest[1:_closing(rest, 0)].removeprefix("?:")
        return _START if all(b[:1].isalnum() or b[:2] in (r"\d", r"\w") for b in _branches(body)) else _EITHER
    if rest[:2] in (r"\d", r"\w") or rest[:1].isalnum():
        return _START
    if rest[:1] == "\\":
        return _EITHER
    if before.endswith(")") and not before.endswith(r"\)"):
        start = next(k for k in range(len(before)) if before[k] == "(" and before[k - 1:k] != "\\" and _closing(before, k) == len(before) - 1)
        if any(b.endswith(r"\)") for b in _branches(before[start + 1:-1])):
            return _EITHER
    return _END


def spell(pattern: str, engine: str = "java") -> str:
    out, i, in_class = [], 0, False
    while i < len(pattern):
        two, ch = pattern[i:i + 2], pattern[i]
        if two == r"\s":
            out.append(_SPACE if in_class else f"[{_SPACE}]")
            i += 2
        elif two == r"\b" and not in_class and engine == "java":
            out.append(_boundary(pattern, i))
            i += 2
        elif ch == "\\":
            out.append(two)
            i += 2
        elif ch == "[" and not in_class:
            in_class = True
            out.append(ch)
            i += 1
        elif ch == "]" and in_class:
            in_class = False
            out.append(ch)
            i += 1
        elif ch == "$" and not in_class:
            out.append(r"\z")
            i += 1
        else:
            out.append(ch)
            i += 1
    return "".join(out)


def let(value: Column, fn) -> Column:
    """Evaluate ``value`` once and use it many times in ``fn``; keeps large expressions small."""
    return F.transform(F.array(value), fn)[0]


def once(build):
    """Keep what ``build(*names)`` returns: columns that refer to other columns by name alone are the same for every table, and large ones take seconds to put together."""
    made: dict = {}

    @wraps(build)
    def kept(*names: str):
        key = (id(SparkContext._gateway), names)
        if key not in made:
            made[key] = build(*names)
        return made[key]
    return kept


def _sequence_needs(branch: str) -> list[str] | None:
    """Literals of which any match of one alternative contains at least one; the most selective choice."""
    options, run, i = [], "", 0

    def close():
        nonlocal run
        if run:
            options.append([run])
        run = ""
    while i < len(branch):
        ch, item = branch[i], None
        if ch == "(":
            end = _closing(branch, i)
            body = branch[i + 1:end]
            i = end + 1
            if body[:2] in ("?=", "?!", "?<"):
                continue
            item = needs(body.removeprefix("?:"))
            optional = branch[i:i + 1] in ("?", "*", "{")
            close()
            if item and not optional:
                options.append(item)
        elif ch == "[":
            i = branch.index("]", i + 2) + 1
            close()
        elif ch == "\\" and branch[i + 1] == "b":
            i += 2
            continue
        elif ch == "\\" and branch[i + 1].isalnum() or ch in ".^$":
            i += 2 if ch == "\\" else 1
            close()
        else:
            i += 2 if ch == "\\" else 1
            run += branch[i - 1]
            if branch[i:i + 1] in ("?", "*", "{"):
                run = run[:-1]
                close()
        if branch[i:i + 1] in ("?", "*", "+", "{"):
            close()
            i = branch.index("}", i) + 1 if branch[i] == "{" else i + 1
            if branch[i:i + 1] == "?":
                i += 1
    close()
    return max(options, key=lambda o: (min(map(len, o)), -len(o))) if options else None


def needs(pattern: str) -> list[str] | None:
    """Literals without which ``pattern`` cannot match, null when there are none."""
    out: list[str] = []
    for branch in _branches(pattern):
        found = _sequence_needs(branch)
        if not found:
            return None
        out += found
    return list(dict.fromkeys(out))


def has(col: Column, pattern: str) -> Column:
    """True where ``pattern`` occurs; ``col`` must already be lower case if the rule asks for it.

    A plain substring test runs first: most rules do not apply to most texts, and
    a byte search is far cheaper than starting the regex at every position.
    """
    hit = col.rlike(spell(pattern))
    words = needs(pattern)
    if not words or "(?i)" in pattern:
        return hit
    # a longer literal that contains a shorter one adds nothing
    words = [w for w in words if not any(v != w and v in w for v in words)]
    return reduce(lambda a, b: a | b, [col.contains(w) for w in words]) & hit


def group(col: Column, pattern: str, idx: int = 1) -> Column:
    """Capture group of the first match, null without a match."""
    return F.nullif(F.regexp_extract(col, spell(pattern), idx), F.lit(""))


def sub(col: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(col, spell(pattern), replacement)
