"""One lexer for the languages with brackets: tokens with places and lines, comments dropped, brackets matched."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  # name, number, string, char, directive, punct
    text: str
    start: int
    end: int
    line: int  # of its start, from 1


@dataclass(frozen=True)
class Dialect:
    line_comment: str = r"//[^\n]*"
    block_comment: tuple[str, str] | None = ("/*", "*/")
    nested_comments: bool = False
    strings: str = r'"(?:\\.|[^"\\\n])*"?'  # an open string ends with its line
    chars: str = r"'(?:\\.|[^'\\\n])*'?"
    directives: bool = False  # lines that begin with #
    names: str = r"[A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*"
    puncts: str = r"::|->|=>|\?\.|\.\.\.|[-+*/%&|^!=<>]=|&&|\|\||.|\n"
    regexes: bool = False


C = Dialect(strings=r'(?:u8|[uUL])?R"([^()\\ ]{0,16})\([\s\S]*?\)\1"|(?:u8|[uUL])?"(?:\\[\s\S]|[^"\\\n])*"?', chars=r"(?:u8|[uUL])?'(?:\\.|[^'\\\n])*'?", directives=True)
JAVA = Dialect(strings=r'"""[\s\S]*?(?:"""|\Z)|"(?:\\.|[^"\\\n])*"?')
ECMA = Dialect(strings=r'"(?:\\[\s\S]|[^"\\\n])*"?|`(?:\\[\s\S]|[^`\\])*`?', chars=r"'(?:\\[\s\S]|[^'\\\n])*'?", regexes=True, names=r"#?[A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*")
RUST = Dialect(nested_comments=True, strings=r'b?r(#*)"[\s\S]*?"\1|b?"(?:\\[\s\S]|[^"\\])*"?', chars=r"b?'(?:\\[^\n]{1,10}?|[^'\\\n])'|'[A-Za-z_]\w*")
GO = Dialect(strings=r'"(?:\\.|[^"\\\n])*"?|`[^`]*`?')
CSHARP = Dialect(strings=r'"""[\s\S]*?(?:"""|\Z)|(?:\$@|@\$|@)"(?:""|[^"])*"?|\$?"(?:\\.|[^"\\\n])*"?', directives=True, names=r"@?[A-Za-z_\u0080-\U0010ffff][\w\u0080-\U0010ffff]*")

_BEFORE_REGEX = {"(", ",", "=", ":", "[", "!", "&&", "||", "?", "{", "}", ";", "=>", "return", "typeof", "case", "in", "of", "+", "-", "*", "%", "<", ">", "==", "!=", "&", "|", "^"}
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/\w*").match
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


@cache
def _pattern(d: Dialect) -> re.Pattern[str]:
    """One pattern for a dialect's tokens, with the blanks before them."""
    parts = [r"(?P<space>[ \t\r\n\f\v﻿]+)", f"(?P<line>{d.line_comment})"]
    if d.block_comment:
        parts.append(f"(?P<block>{re.escape(d.block_comment[0])})")
    if d.directives:
        parts.append(r"(?P<directive>\#(?:[^\n\\]|\\[\s\S])*)")
    strings = d.strings
    # A back reference within the strings' pattern counts its own group only.
    parts.append(f"(?P<string>{strings.replace(chr(92) + '1', '(?P=mark)').replace('R\"([^', 'R\"(?P<mark>[^').replace('r(#*)', 'r(?P<mark>#*)')})")
    parts += [f"(?P<char>{d.chars})", f"(?P<name>{d.names})", r"(?P<number>\d(?:[\w.']|(?<=[eEpP])[+-])*)", f"(?P<punct>{d.puncts})"]
    return re.compile(f"[ \\t]*(?:{'|'.join(parts)})")


def lex(source: str, d: Dialect) -> list[Token]:
    find, made = _pattern(d).match, tuple.__new__
    out: list[Token] = []
    at, line, n = 0, 1, len(source)
    fresh = True  # nothing but space on this line so far
    while at < n:
        m = find(source, at)
        kind, end = m.lastgroup, m.end()
        if kind == "mark":
            kind = "string"
        at = m.start(kind)
        if kind in ("name", "number"):  # the most; they have no line ends
            out.append(made(Token, (kind, source[at:end], at, end, line)))
            fresh, at = False, end
            continue
        if kind == "block":
            depth = 1
            opened, closed = d.block_comment
            while depth and end < n:
                if source.startswith(closed, end):
                    depth, end = depth - 1, end + len(closed)
                elif d.nested_comments and source.startswith(opened, end):
                    depth, end = depth + 1, end + len(opened)
                else:
                    end += 1
        elif kind == "directive" and not fresh:
            kind, end = "punct", at + 1
        elif kind == "punct" and d.regexes and source[at] == "/" and (not out or out[-1].text in _BEFORE_REGEX):
            found = _REGEX(source, at)
            if found:
                kind, end = "string", found.end()
        text = source[at:end]
        if kind not in ("space", "line", "block"):
            out.append(made(Token, (kind, text, at, end, line)))
            fresh = False
        lines = text.count("\n")
        if lines:
            line += lines
            fresh = kind in ("space", "block") and source[at:end].rsplit("\n", 1)[1].strip() == "" or kind == "directive"
        at = end
        if kind == "directive":
            fresh = True
    return out


def matches(tokens: list[Token]) -> dict[int, int]:
    """The place of each bracket's partner. Brackets without one are absent; a closing one ends all that are open within."""
    found: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    for i, t in enumerate(tokens):
        if t.kind != "punct":
            continue
        if t.text in _OPEN:
            stack.append((_OPEN[t.text], i))
        elif t.text in _CLOSE and any(c == t.text for c, _ in stack[-64:]):
            while stack:
                close, j = stack.pop()
                if close == t.text:
                    found[i], found[j] = j, i
                    break
    return found
