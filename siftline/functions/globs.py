"""File globs as regular expressions."""

from __future__ import annotations

import re


def glob_regex(glob: str, dot: bool = False) -> str:
    """Java regex for a glob on a relative path with ``**``, ``*``, ``?``, ``[..]`` and ``{a,b}``.

    Without ``dot``, names that start with a dot only match when the glob spells
    the dot out.
    """
    return "^(?:" + "|".join(_one(g, dot) for g in expand_braces(glob)) + r")\z"


def expand_braces(glob: str) -> list[str]:
    inner = re.search(r"\{([^{}]*,[^{}]*)\}", glob)
    if not inner:
        return [glob]
    parts = inner.group(1).split(",")
    return [g for p in parts for g in expand_braces(glob[: inner.start()] + p + glob[inner.end() :])]


def _one(glob: str, dot: bool) -> str:
    hidden = "" if dot else r"(?!\.)"
    segments = glob.removeprefix("./").split("/")
    out = ""
    for i, segment in enumerate(segments):
        last = i == len(segments) - 1
        if segment == "**":
            name = hidden + "[^/]+"
            out += f"(?:{name}(?:/{name})*)?" if last else f"(?:{name}/)*"
        else:
            out += _segment(segment, hidden) + ("" if last else "/")
    return out


def _segment(segment: str, hidden: str) -> str:
    out = "" if segment.startswith(".") else hidden
    for token in re.findall(r"\[[!^]?[^\]]+\]|.", segment):
        if token == "*":
            out += "[^/]*"
        elif token == "?":
            out += "[^/]"
        elif len(token) > 1:
            out += "[" + ("^" if token[1] in "!^" else "") + token.strip("[]").lstrip("!^") + "]"
        else:
            out += re.escape(token)
    return out


def name_glob(globs: list[str]) -> str | None:
    """Glob on the file name alone, when every glob ends in one; lists fewer files."""
    names = {g.rsplit("/", 1)[-1] for g in globs}
    if any("**" in n for n in names):
        return None
    return "{" + ",".join(sorted(names)) + "}" if len(names) > 1 else names.pop()
