"""Tokens of nine dialects: identifiers, numbers, strings and operators with their places; comments leave no trace.

Comments and strings are where a search for names goes wrong, so they are the one thing that is read exactly here.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

ECMA = ("javascript", "jsx", "typescript", "tsx")

_ID = r"[^\W\d][\w$]*|[$][\w$]*"
_NUMBER = r"\d[\w]*(?:\.\d[\w]*)?"
_OPS = r"\.\.\.|\.\.=|::|=>|->|:=|\?\.|\?\?|<<|==|!=|<=|>=|&&|\|\||\.\.|[^\s\w]"
_LINE, _BLOCK = r"//[^\n]*", r"/\*(?:(?!\*/)[\s\S])*(?:\*/|$)"
_DOUBLE, _SINGLE = r'"(?:[^"\\\n]|\\[\s\S])*(?:"|$|(?=\n))', r"'(?:[^'\\\n]|\\[\s\S])*(?:'|$|(?=\n))"
_STRINGS = {
    "rust": rf'b?r(?P<hash>#*)"[\s\S]*?"(?P=hash)|b?"(?:[^"\\]|\\[\s\S])*(?:"|$)|b?\'(?:[^\'\\\n]|\\(?:u\{{[^}}]*\}}|x..|.))\'|\'(?=\w)',
    "go": rf"`[^`]*(?:`|$)|{_DOUBLE}|{_SINGLE}",
    "java": rf'"""[\s\S]*?(?:"""|$)|{_DOUBLE}|{_SINGLE}',
    "csharp": rf'\$*"""[\s\S]*?(?:"""|$)|(?:\$@|@\$|@)"(?:[^"]|"")*(?:"|$)|\$?{_DOUBLE}|{_SINGLE}',
    "dart": rf"r?'''[\s\S]*?(?:'''|$)|r?\"\"\"[\s\S]*?(?:\"\"\"|$)|r'[^'\n]*'|r\"[^\"\n]*\"|{_DOUBLE}|{_SINGLE}",
    "ecma": rf"`(?:[^`\\]|\\[\s\S])*(?:`|$)|{_DOUBLE}|{_SINGLE}",
}


def _nested_comment(text: str, at: int) -> int:
    depth = 0
    for m in re.compile(r"/\*|\*/").finditer(text, at):
        depth += 1 if m[0] == "/*" else -1
        if not depth:
            return m.end()
    return len(text)


_PATTERNS: dict[str, re.Pattern] = {}


def _pattern(language: str) -> re.Pattern:
    key = "ecma" if language in ECMA else language
    if key not in _PATTERNS:
        pound = r"|(?P<pound>^[ \t]*\#[^\n]*)" if key == "csharp" else ""
        _PATTERNS[key] = re.compile(rf"(?P<comment>{_LINE}|{_BLOCK}){pound}|(?P<str>{_STRINGS[key]})|(?P<id>@?(?:{_ID}))|(?P<num>{_NUMBER})|(?P<op>{_OPS})", re.MULTILINE)
    return _PATTERNS[key]


@dataclass(slots=True)
class Token:
    kind: str  # id, num, str, op, pound
    text: str
    start: int
    end: int
    first: bool  # whether it begins a line


#: After these a slash begins a regular expression, not a division.
_BEFORE_REGEX = frozenset("( [ { , ; = : ? ! & | + - * % < > ~ ^ => && || == != <= >= ?? return typeof case in of delete void throw new else do yield await".split())
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*")


def tokens(text: str, language: str) -> list[Token]:
    out: list[Token] = []
    pattern, at, line_end = _pattern(language), 0, -1
    while m := pattern.search(text, at):
        at = m.end()
        if at == m.start():
            at += 1
            continue
        if m["comment"] is not None:
            if language in ("rust", "dart") and m["comment"].startswith("/*"):
                at = _nested_comment(text, m.start())
            continue
        kind = m.lastgroup if m.lastgroup != "hash" else "str"
        first = "\n" in text[line_end:m.start()] if line_end >= 0 else True
        if m["str"] == "'" and language == "rust":  # a lifetime
            life = re.compile(r"\w+").match(text, at)
            at = life.end() if life else at
            line_end = at
            continue
        if kind == "op" and m["op"] == "/" and language in ECMA and (not out or out[-1].text in _BEFORE_REGEX):
            r = _REGEX.match(text, m.start())
            if r:
                out.append(Token("str", r[0], r.start(), r.end(), first))
                at = line_end = r.end()
                continue
        out.append(Token(kind, m[0], m.start(), at, first))
        line_end = at
    return out


_CLOSE = {"(": ")", "[": "]", "{": "}"}


def pairs(found: list[Token]) -> tuple[dict[int, int], list[int]]:
    """(partner of each bracket, brackets without one in order); a closing bracket that fits none is skipped."""
    partner, stack, alone = {}, [], []
    for i, t in enumerate(found):
        if t.kind != "op":
            continue
        if t.text in _CLOSE:
            stack.append(i)
        elif t.text in (")", "]", "}"):
            while stack and _CLOSE[found[stack[-1]].text] != t.text and t.text == "}":
                alone.append(stack[-1])
                partner[stack.pop()] = i
            if stack and _CLOSE[found[stack[-1]].text] == t.text:
                partner[stack[-1]] = i
                partner[i] = stack.pop()
            else:
                alone.append(i)
    for i in stack:
        partner[i] = len(found)
    return partner, sorted(alone + stack)


class Offsets:
    """Byte offsets of character offsets."""

    def __init__(self, text: str):
        self.plain = text.isascii()
        if not self.plain:
            self.wide = [i for i, c in enumerate(text) if not c.isascii()]
            self.extra, total = [], 0
            for i in self.wide:
                total += len(text[i].encode()) - 1
                self.extra.append(total)

    def __call__(self, at: int) -> int:
        if self.plain:
            return at
        k = bisect_right(self.wide, at - 1)
        return at + (self.extra[k - 1] if k else 0)
