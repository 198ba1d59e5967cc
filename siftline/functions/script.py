"""Call expressions in JavaScript and TypeScript text.

A tokenizer with a bracket stack, not a parser: it knows comments, strings,
templates, regex literals, member chains, ``new``, type arguments and the shapes
in which a name before a parenthesis is a definition.  Text between JSX tags is
read as code.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from typing import NamedTuple

_TOKEN = re.compile(
    r"""(?:\s+|//[^\n]*|/\*.*?(?:\*/|\Z))*+
    (?:(?P<string>"(?:[^"\\\n]|\\.)*"?|'(?:[^'\\\n]|\\.)*'?)
    |(?P<name>[^\W\d][\w$]*|\$[\w$]*|\#[^\W\d][\w$]*)
    |(?P<number>\d[\w.]*)
    |(?P<punct>\?\.(?!\d)|=>|\+\+|--|.)|\Z)""",
    re.VERBOSE | re.DOTALL,
)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*(`|\$\{|\Z)", re.DOTALL)
_TYPE_RUN = re.compile(r"""[\w\s.,<>\[\]|&"'$]*""")
_AFTER = re.compile(r"(?:\s+|//[^\n]*|/\*.*?\*/)*+(\{|=>|:|)", re.DOTALL)

_CONTROL = frozenset("if for while switch catch with".split())
_KEYWORDS = _CONTROL | frozenset(
    "function return typeof instanceof in of do else case throw delete void await yield var let const class extends "
    "default break continue try finally debugger export enum interface".split()
)
# after these an opening brace starts statements, after anything else an object or a type
_BLOCK_AFTER = frozenset(["", ")", ";", "{", "}", "=>", "else", "try", "do", "finally", ":"])
_MODIFIERS = frozenset("async static get set public private protected readonly override abstract declare".split())


class Call(NamedTuple):
    text: str
    start: int
    callee_end: int
    end: int

    @property
    def callee(self) -> str:
        """Cut out only when asked for: the callees of a long chain hold one another."""
        return self.text[self.start : self.callee_end]

    @property
    def last_name(self) -> str:
        """The callee after its last dot."""
        dot = self.text.rfind(".", self.start, self.callee_end)
        return self.text[self.start if dot < 0 else dot + 1 : self.callee_end]

    def ends_in(self, name: str) -> bool:
        return self.text.endswith(name, self.start, self.callee_end)

    def targets(self, name: str) -> bool:
        """The callee is the name or ends in it after a dot."""
        before = self.callee_end - len(name)
        return self.ends_in(name) and (before == self.start or self.text[before - 1] == ".")


class _Operand(NamedTuple):
    """The expression that ends at the last token."""

    start: int
    end: int
    news: tuple[int, ...] = ()
    """Places of ``new`` whose arguments are still to come."""
    plain: bool = False
    """A single name."""


class _Open(NamedTuple):
    kind: str
    operand: _Operand | None = None
    start: int = 0
    definition: bool = False
    member: bool = False
    """The name stands where a member or a statement starts."""


class _TypeArguments:
    """Where type arguments that start at a place end, if a parenthesis follows them.

    A run of characters that types may hold is looked at once; each later place in
    it has the same end.
    """

    def __init__(self, text: str):
        self.text, self.run_end, self.close = text, -1, -1

    def end(self, start: int) -> int | None:
        if start >= self.run_end:
            self.run_end = _TYPE_RUN.match(self.text, start).end()
            self.close = -1
            if self.text.startswith("(", self.run_end):
                last = len(self.text[start : self.run_end].rstrip()) + start
                self.close = last if self.text[last - 1] == ">" else -1
        return self.close if self.close > start + 1 else None


def calls_in(text: str) -> list[Call]:
    """Calls in tree order: an outer call before the calls inside it."""
    found: list[Call] = []
    stack: list[_Open] = []
    left: _Operand | None = None  # operand ending here
    chain: _Operand | None = None  # operand before a dot
    news: tuple[int, ...] = ()
    before, last, class_head = "", "", False
    types = _TypeArguments(text)
    i = 0
    while i < len(text):
        token = _TOKEN.match(text, i)
        kind, i = token.lastgroup, token.end()
        if kind is None:  # only space and comments are left
            break
        word, start = token[kind], token.start(kind)
        if word == "/" and left is None and (literal := _REGEX.match(text, start)):
            kind, i = "string", literal.end()
        if kind == "name" and chain is not None:
            left, chain = chain._replace(end=i, plain=False), None
        elif kind == "name" and word == "new":
            news, left = news + (start,), None
        elif kind == "name" and word in _KEYWORDS:
            class_head = class_head or word in ("class", "interface")
            left, news = None, ()
        elif kind in ("name", "string", "number"):
            left, news = _Operand(news[0] if news else start, i, news, kind == "name"), ()
            if left.news:
                left = left._replace(start=start)
        elif word in (".", "?.") and left is not None:
            chain = left
            if word == "?." and text[i : i + 1] in ("(", "["):  # the callee ends before the dot
                chain = None
                last = word
                continue
            left = None
        elif word == "!" and left is not None and text[i : i + 1] in (".", "(", "["):
            left = left._replace(end=i, plain=False)
        elif word == "<" and left is not None and left.end == start and (end := types.end(start)):
            i = end
            continue
        elif word == "`" or (word == "}" and stack and stack[-1].kind == "${"):
            operand = stack.pop().operand if word == "}" else (left or _Operand(start, i))
            part = _TEMPLATE.match(text, i)
            i = part.end()
            left = operand._replace(end=i, plain=False)
            if part[1] == "${":
                stack.append(_Open("${", operand))
                left = None
            word = "`"
        elif word == "(":
            stack.append(_open_paren(left or (_Operand(start, start, news) if news else None), last, before, start, stack))
            left, news = None, ()
        elif word == "[":
            stack.append(_Open("[", left, start))
            left = None
        elif word == "{":
            stack.append(_Open("class" if class_head else "{" if last in _BLOCK_AFTER else "object"))
            left, class_head, news = None, False, ()
        elif word in ")]}":
            left = _close(text, word, i, stack, found)
        else:
            left, news = None, ()
        if word not in (".", "?."):
            chain = None
        if not (kind == "name" and left is not None and last in (".", "?.")):
            before = last
        last = word
    found += [_call(text, o, len(text)) for o in stack if o.kind == "call" and not o.definition]
    return sorted(found, key=lambda c: (c.start, -c.end))


def _open_paren(left: _Operand | None, last: str, before: str, start: int, stack: list[_Open]) -> _Open:
    if left is None:
        return _Open("control" if last in _CONTROL or last == "function" else "group", None, start)
    if left.end == start == left.start:  # new (expression)(arguments)
        return _Open("group", left, start)
    if left.news:
        return _Open("new", left, left.news[-1])
    around = stack[-1].kind if stack else ""
    starts = before in ("{", "}", ";", "*", ")", ",", "") or before in _MODIFIERS
    definition = left.plain and (before == "function" or (before == "*" and not stack) or (around == "class" and starts and before != ","))
    extended = before == "extends"
    return _Open("call", left._replace(plain=left.plain and not extended), left.start, definition, starts)


def _close(text: str, word: str, end: int, stack: list[_Open], found: list[Call]) -> _Operand | None:
    wanted = {")": ("call", "new", "group", "control"), "]": ("[",), "}": ("{", "class", "object")}[word]
    if not stack or stack[-1].kind not in wanted:
        return None
    opened = stack.pop()
    if word == "}" or opened.kind == "control":
        return None
    if opened.kind == "call":
        if opened.definition or (opened.operand.plain and _is_definition(_AFTER.match(text, end)[1], opened, stack)):
            return None
        found.append(_call(text, opened, end))
        return _Operand(opened.start, end)
    if opened.kind == "new":
        return _Operand(opened.start, end, opened.operand.news[:-1])
    if opened.operand is not None:
        return opened.operand._replace(end=end, plain=False)
    return _Operand(opened.start, end)


def _is_definition(after: str, opened: _Open, stack: list[_Open]) -> bool:
    """Do the parentheses just closed hold parameters?  ``after`` is what follows them.

    An arrow always says so, a type annotation does where a member may start, and
    a brace does inside an object or class; elsewhere it starts a block of its own.
    """
    if after == "=>":
        return True
    inside = stack[-1].kind if stack else ""
    return opened.member and (after == ":" or (after == "{" and inside in ("object", "class")))


def _call(text: str, opened: _Open, end: int) -> Call:
    return Call(text, opened.start, opened.operand.end, end)


def line_starts(text: str) -> list[int]:
    return [0, *(m.end() for m in re.finditer("\n", text))]


def line_of(starts: list[int], place: int) -> int:
    return bisect_right(starts, place)
