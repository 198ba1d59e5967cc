"""Regex helpers.

Rules are written in the ECMAScript dialect.  Two engines run them:

* java.util.regex, through ``rlike``, decides.  :func:`to_java` rewrites the few
  escapes it reads differently.
* RE2, through Arrow compute, looks ahead.  It walks a text once for all rules
  together, some fifty times faster than trying them one by one, but lacks
  look-around.  :func:`to_re2` gives a pattern that matches at least as often.

:func:`search_pattern` picks what RE2 searches for: the rule itself, or words
any match must contain, or nothing when the rule has to be tried on every line.
"""

from __future__ import annotations

import re
import warnings

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

try:  # the parser of the standard library; without it there are no word lists
    from re import _constants as _sre
    from re import _parser as _sre_parser
except ImportError:  # pragma: no cover
    _sre = _sre_parser = None

_WORD = "A-Za-z0-9_"
# The white space and line ends of ECMAScript.
JS_SPACE = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
_JS_LINE_END = r"\n\r\u2028\u2029"
_BOUNDARY = f"(?:(?<![{_WORD}])(?=[{_WORD}])|(?<=[{_WORD}])(?![{_WORD}]))"
_NO_BOUNDARY = f"(?:(?<![{_WORD}])(?![{_WORD}])|(?<=[{_WORD}])(?=[{_WORD}]))"
_SAME_ESCAPES = set("dDwWnrtf")
# escapes of more than one character, the same in all dialects
_LONG_ESCAPE = re.compile(r"\\(?:x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|c[A-Za-z]|[1-9][0-9]?|k<\w+>)")

_JAVA = {
    "outside": {"b": _BOUNDARY, "B": _NO_BOUNDARY, "s": f"[{JS_SPACE}]", "S": f"[^{JS_SPACE}]"},
    "inside": {"b": r"\x08", "s": JS_SPACE, "S": f"[^{JS_SPACE}]"},
    ".": f"[^{_JS_LINE_END}]",
    "$": r"\z",
    "nothing": "(?!)",
}
_RE2_SPACE = re.sub(r"\\u([0-9A-F]{4})", r"\\x{\1}", JS_SPACE)
# what lies between the white space, spelt out: a class may be negated, where wider would be narrower
_RE2_NO_SPACE = (
    r"\x{0}-\x{8}\x{E}-\x{1F}\x{21}-\x{9F}\x{A1}-\x{167F}\x{1681}-\x{1FFF}\x{200B}-\x{2027}"
    r"\x{202A}-\x{202E}\x{2030}-\x{205E}\x{2060}-\x{2FFF}\x{3001}-\x{FEFE}\x{FF00}-\x{10FFFF}"
)
_RE2 = {
    "outside": {"b": r"\b", "B": r"\B", "s": f"[{_RE2_SPACE}]", "S": r"\S"},
    "inside": {"b": r"\x08", "s": _RE2_SPACE, "S": _RE2_NO_SPACE},
    ".": ".",
    "$": "$",
    "nothing": r"[^\x{0}-\x{10FFFF}]",
}


def to_java(pattern: str) -> str:
    """Rewrite an ECMAScript pattern so that java.util.regex matches the same text."""
    return _rewrite(pattern, _JAVA, lambda ch: f"(?u:{ch})")


def to_re2(pattern: str) -> str:
    """Rewrite an ECMAScript pattern so that RE2 matches wherever ECMAScript does."""
    whole = _rewrite(pattern, _RE2, lambda ch: ch)
    return re.sub(r"\\u([0-9A-Fa-f]{4})", r"\\x{\1}", whole)


def _rewrite(pattern: str, dialect: dict, beyond_ascii) -> str:
    out: list[str] = []
    in_class = False
    after_word = False  # the token before is a plain word character
    i = 0
    while i < len(pattern):
        ch, step = pattern[i], 1
        plain = not in_class and re.match(r"[A-Za-z0-9_]", ch) is not None
        if long := _LONG_ESCAPE.match(pattern, i):
            ch, step = long[0], len(long[0])
        elif ch == "\\" and i + 1 < len(pattern):
            nxt, step = pattern[i + 1], 2
            table = dialect["inside" if in_class else "outside"]
            if nxt == "b" and not in_class:
                ch = _boundary(pattern, i, after_word, dialect)
            elif nxt in table:
                ch = table[nxt]
            elif nxt in "0v":
                ch = r"\x00" if nxt == "0" else r"\x0B"
            elif nxt in _SAME_ESCAPES or not nxt.isalnum() or nxt == "k":
                ch = "\\" + nxt
            else:  # ECMAScript reads an unknown letter escape as the letter
                ch = nxt
        elif in_class:
            if ch == "]":
                in_class = False
            elif ch == "[" or pattern.startswith("&&", i):
                ch = "\\" + ch
        elif pattern.startswith("[^]", i):
            ch, step = r"[\s\S]", 3
        elif pattern.startswith("[]", i):
            ch, step = dialect["nothing"], 2
        elif ch == "[":
            in_class = True
        elif ch in ".$":
            ch = dialect[ch]
        elif ch == "{" and not re.match(r"\{\d+(,\d*)?\}", pattern[i:]):
            ch = r"\{"
        elif ord(ch) > 127:  # ignore case beyond ASCII for this character only
            ch = beyond_ascii(ch)
        out.append(ch)
        after_word = plain
        i += step
    return "".join(out)


def _boundary(pattern: str, i: int, after_word: bool, dialect: dict) -> str:
    """The boundary at ``pattern[i:i+2]``; one look is enough next to a plain word character."""
    if dialect is _JAVA:
        if re.match(r"[A-Za-z0-9_](?![?*{])", pattern[i + 2 :]):
            return f"(?<![{_WORD}])"
        if after_word:
            return f"(?![{_WORD}])"
    return dialect["outside"]["b"]


def check_patterns(spark: SparkSession, named: list[tuple[str, str]]) -> None:
    """Raise an error that names the first (rule, pattern) whose pattern is not a regex.

    Long lists are compiled in one query first, and one by one only if that fails.
    """
    if len(named) > GROUP:
        rows = spark.createDataFrame(pa.table({"pattern": [rule_regex(p) for _, p in named]}))
        try:
            rows.where("'' RLIKE pattern").count()
            return
        except Exception:  # noqa: BLE001, S110 - the patterns tell which one it was
            pass
    for rule_id, pattern in named:
        check_pattern(spark, rule_id, pattern)


def check_pattern(spark: SparkSession, rule_id: str, pattern: str) -> None:
    """Raise an error that names the rule when its pattern is not a regex."""
    try:
        spark._jvm.java.util.regex.Pattern.compile(rule_regex(pattern))
    except Exception as error:
        reason = str(getattr(error, "java_exception", error)).splitlines()[0]
        raise ValueError(f"rule {rule_id}: {pattern!r} is not a regex: {reason}") from None


def rule_regex(pattern: str) -> str:
    """Java form of a rule pattern, matched without regard to case."""
    return "(?i)" + to_java(pattern)


def search_pattern(pattern: str) -> str:
    """RE2 pattern, ignoring case, found on every line the rule matches; empty if all lines have to be tried."""
    whole = to_re2(pattern)
    if re2_accepts(whole):
        return whole
    words = required_words(pattern)
    return "|".join(re.escape(w) for w in words)


def index_words(pattern: str) -> list[str]:
    """Words for an index of rules: each match holds at least one; empty if none are known that are long enough."""
    words = required_words(pattern)
    return words if words and min(map(len, words)) >= INDEXED_LENGTH else []


_LITERAL = re.compile(r"(\\b)?((?:[ -~](?<![\\^$.|?*+()\[\]{}])|\\[!-/:-@\[-`{-~])+)(\\b)?")


def literal_word(pattern: str) -> tuple[str, bool, bool] | None:
    """The ASCII word that a pattern is, in lower case, and whether its start and end are boundaries.

    The pattern matches wherever the word stands without a word character at such an
    end, and nowhere else.  None for other patterns, for words too short for an index, and
    for those with a boundary that hold more than word characters.
    """
    parts = _LITERAL.fullmatch(pattern)
    if parts is None:
        return None
    word = re.sub(r"\\(.)", r"\1", parts[2]).lower()
    before, after = parts[1] is not None, parts[3] is not None
    if len(word) < INDEXED_LENGTH or (before or after) and not re.fullmatch(f"[{_WORD}]+", word):
        return None
    return word, before, after


def either(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


GROUP = 200  # patterns tried as one; a larger group only takes longer to halve
INDEXED_LENGTH = 3  # shorter words stand on too many lines to tell rules apart


def re2_groups(patterns: list[str]) -> list[str]:
    """All patterns as few alternations that RE2 takes; the empty pattern finds everything."""
    if "" in patterns:
        return [""]
    groups: list[str] = []
    rest = list(patterns)
    while rest:
        size = min(len(rest), GROUP)
        while size > 1 and not re2_accepts(either(rest[:size])):
            size //= 2
        groups.append(either(rest[:size]))
        rest = rest[size:]
    return groups


def re2_accepts(pattern: str) -> bool:
    try:
        pc.match_substring_regex(pa.array([""]), pattern, ignore_case=True)
    except pa.ArrowInvalid:
        return False
    return True


def required_words(pattern: str) -> list[str]:
    """Lower-case ASCII words of which every match holds at least one; empty if unknown."""
    if _sre_parser is None or re.search(r"\\[aN]", pattern):  # escapes of Python, letters in ECMAScript
        return []
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            clauses = _clauses(_sre_parser.parse(pattern))
    except (re.error, OverflowError, RecursionError):
        return []
    return sorted(set(max(clauses, key=_strength, default=[])))


def _strength(clause: list[str]) -> tuple[int, int]:
    return min(map(len, clause)), -len(clause)


def _clauses(items) -> list[list[str]]:
    found: list[list[str]] = []
    run = ""
    for op, arg in items:
        if op is _sre.LITERAL and arg < 128:
            run += chr(arg).lower()
            continue
        if op is _sre.BRANCH:  # the parser moves a common start in front of the branches
            start = [(_sre.LITERAL, ord(c)) for c in run]
            best = [max(_clauses([*start, *branch]), key=_strength, default=None) for branch in arg[1]]
            if all(best):
                found.append([word for clause in best for word in clause])
        if run:
            found.append([run])
            run = ""
        if op is _sre.ASSERT:  # what a positive look-around looks for stands on the line too
            found += _clauses(arg[1])
            if arg[0] < 0 and all(o is _sre.LITERAL and a < 128 for o, a in arg[1]):
                run = "".join(chr(a).lower() for _, a in arg[1])  # right before what comes next
        elif op is _sre.SUBPATTERN:
            found += _clauses(arg[-1])
        elif op in (_sre.MAX_REPEAT, _sre.MIN_REPEAT) and arg[0] >= 1:
            found += _clauses(arg[2])
    if run:
        found.append([run])
    return found


def any_of(patterns: list[str]) -> str:
    """One case-insensitive Java regex for a list of patterns.

    Patterns that start with a boundary before a word character share one test
    for it, so the list is only tried where a word starts.
    """
    bound = [p[2:] for p in patterns if re.match(r"\\b[A-Za-z0-9_](?![?*{])", p)]
    free = [to_java(p) for p in patterns if p[2:] not in bound]
    if bound:
        free.append(f"(?<![{_WORD}])(?:" + "|".join(to_java(p) for p in bound) + ")")
    return "(?i)" + either(free)
