"""C#."""

from __future__ import annotations

from lodestone.sources.extract.base import MOST_ITEMS, Sink, Source, trimmed
from lodestone.sources.extract.lex import CSHARP

NOT_CALLED = frozenset("if for foreach while switch return catch lock using fixed nameof typeof sizeof default checked unchecked base this throw new when is as in do else await yield stackalloc".split())
MODIFIERS = frozenset("public private protected internal static readonly sealed abstract virtual override async extern unsafe partial new volatile ref required file const implicit explicit".split())
TYPES = {"class": "Class", "struct": "Struct", "interface": "Interface", "record": "Class", "enum": "Enum"}


class _Parser:
    def __init__(self, text: str, sink: Sink):
        self.s, self.sink = Source(text, CSHARP, NOT_CALLED), sink

    def body(self, lo: int, hi: int, parent: str | None) -> None:
        s, i = self.s, lo
        while i < hi:
            x = s.text(i)
            if s.kind(i) == "directive" or x in (";", "}", ")", ","):
                i += 1
            elif x == "{":
                i = s.close(i) + 1
            elif x == "[":  # attributes
                i = s.close(i) + 1
            else:
                i = self.member(i, hi, parent)

    def type_text(self, lo: int, hi: int) -> str:
        """A type's name: of a generic one the bare name, a qualified one whole, predefined types too."""
        s = self.s
        while lo < hi and s.text(lo) in ("ref", "out", "in", "params", "this", "readonly", "scoped"):
            lo += 1
        stop = lo
        while stop < hi and (s.is_name(stop) or s.text(stop) in (".", "::")):
            stop += 1
            if s.is_name(stop - 1) and s.text(stop) not in (".", "::"):
                break
        return s.slice(lo, stop)

    def member(self, first: int, hi: int, parent: str | None) -> int:
        s, i = self.s, first
        if s.text(i) == "global" and s.text(i + 1) == "using":
            i += 1
        if s.text(i) == "using" and s.text(i + 1) != "(":
            end = s.until(i, hi, {";"})
            k = i + 1 + (s.text(i + 1) in ("static", "unsafe"))
            if s.text(k + 1) == "=":  # its first name is the alias
                self.sink.include(s.text(k), s.line(first), s.last_line(min(end, hi - 1)))
            else:
                self.sink.include(self.type_text(k, end), s.line(first), s.last_line(min(end, hi - 1)))
            return end + 1
        if s.text(i) == "namespace":
            k = i + 1
            while k < hi and s.text(k) not in ("{", ";"):
                k += 1
            name = s.slice(i + 1, k)
            end = s.close(k) if s.text(k) == "{" else hi - 1
            self.sink.symbol(name, "Namespace", s.line(i), s.last_line(end if s.text(k) == "{" else k))
            if s.text(k) == "{":
                self.body(k + 1, end, None)
                return end + 1
            return k + 1
        while i < hi and (s.text(i) in MODIFIERS or s.text(i) == "["):
            i = s.close(i) + 1 if s.text(i) == "[" else i + 1
        x = s.text(i)
        if x in TYPES and s.is_name(i + 1):
            return self.type_declaration(first, i, hi, parent)
        if x == "delegate" and s.text(i + 1) != "(":
            return s.until(i, hi, {";"}) + 1
        if x == "event":
            end = self.brace_or_end(i, hi)
            if s.text(end) != "}":
                self.fields(first, i + 1, end, hi, parent)
            return end + 1
        if s.text(i) == "~":
            i += 1
        k = i
        while k < hi:
            y = s.text(k)
            if y == "<":
                k = s.angle(k, hi)
                continue
            if y == "[" or (y == "(" and k == i):  # an array's rank, a tuple
                k = s.close(k) + 1
                continue
            if y in ("(", "{", "=", ";", "=>", ","):
                break
            if y == "operator":
                while k < hi and s.text(k) != "(":
                    k += 1
                end = self.brace_or_end(s.close(k) + 1, hi)
                return end + 1
            k += 1
        y = s.text(k)
        if y == "(":
            return self.method(first, i, k, hi, parent)
        if y in ("{", "=>") and s.is_name(k - 1) and k - 1 > i and s.text(k - 1) != "this":
            end = s.close(k) if y == "{" else s.until(k, hi, {";"})
            if y == "{" and s.text(end + 1) == "=":
                end = s.until(end + 1, hi, {";"})
            self.sink.symbol(s.text(k - 1), "Variable", s.line(first), s.last_line(min(end, hi - 1)), None, parent)
            return end + 1
        if y == "{":
            return s.close(k) + 1
        end = s.until(i, hi, {";"}, angles=False)
        self.fields(first, i, end, hi, parent)
        return end + 1

    def brace_or_end(self, k: int, hi: int) -> int:
        s = self.s
        while k < hi and s.text(k) not in ("{", ";"):
            k = s.close(k) + 1 if s.text(k) in ("(", "[") else k + 1
        return s.close(k) if s.text(k) == "{" else min(k, hi - 1)

    def fields(self, first: int, i: int, end: int, hi: int, parent: str | None) -> None:
        s, names = self.s, []
        for n, (a, b) in enumerate(s.items(i, end)):
            b = s.until(a, b, {"="}, angles=True)
            if s.is_name(b - 1) and (n or b - 1 > a):
                names.append(s.text(b - 1))
        for name in names[:MOST_ITEMS]:
            self.sink.symbol(name, "Variable", s.line(first), s.last_line(min(end, hi - 1)), None, parent)

    def type_declaration(self, first: int, i: int, hi: int, parent: str | None) -> int:
        s, word = self.s, self.s.text(i)
        kind = TYPES[word]
        if word == "record" and s.text(i + 1) in ("class", "struct"):
            i += 1
        name, k = s.text(i + 1), i + 2
        bases = []
        while k < hi and s.text(k) not in ("{", ";"):
            if s.text(k) == "<":
                k = s.angle(k, hi)
            elif s.text(k) == "(":
                k = s.close(k) + 1
            elif s.text(k) == ":" and not bases:
                stop = k + 1
                while stop < hi and s.text(stop) not in ("{", ";", "where"):
                    stop = s.angle(stop, hi) if s.text(stop) == "<" else s.close(stop) + 1 if s.text(stop) == "(" else stop + 1
                bases = [self.type_text(a, b) for a, b in s.items(k + 1, stop)]
                k = stop
            else:
                k += 1
        end = s.close(k) if s.text(k) == "{" else min(k, hi - 1)
        signature = trimmed(s.source[s.t[first].start : s.t[k].start]) if s.text(k) == "{" and kind != "Enum" else None
        if self.sink.symbol(name, kind, s.line(first), s.last_line(end), signature, parent) and kind != "Enum":
            self.sink.edges(name, bases, "Inherits", MOST_ITEMS)
        if s.text(k) == "{" and kind != "Enum":
            self.body(k + 1, end, name)
        return end + 1

    def method(self, first: int, typed: int, bracket: int, hi: int, parent: str | None) -> int:
        s, at = self.s, bracket - 1
        if s.text(at) == ">":
            depth = 0
            while at > typed:
                depth += {">": 1, "<": -1}.get(s.text(at), 0)
                at -= 1
                if not depth:
                    break
        close = s.close(bracket)
        k = close + 1
        while k < hi and s.text(k) not in ("{", ";", "=>"):
            k = s.close(k) + 1 if s.text(k) in ("(", "[") else k + 1
        arrow, block = s.text(k) == "=>", s.text(k) == "{"
        end = s.close(k) if block else s.until(k, hi, {";"})
        name = s.text(at)
        if not s.is_name(at):
            return end + 1
        signature = trimmed(s.source[s.t[first].start : s.t[k].start]) if block else None
        if self.sink.symbol(name, "Function", s.line(first), s.last_line(min(end, hi - 1)), signature, parent):
            if block or arrow:
                self.sink.edges(name, s.calls(k, min(end, hi), frozenset({".", "?.", "::"}), generic=True), "Calls")
            if at > typed:
                self.sink.edge(name, self.type_text(typed, at), "Returns")
            for a, b in s.items(bracket + 1, close)[:MOST_ITEMS]:
                while s.text(a) == "[":
                    a = s.close(a) + 1
                if b - a > 1:
                    self.sink.edge(name, self.type_text(a, b), "TypedAs")
        return end + 1


def extract_csharp(text: str, sink: Sink) -> None:
    p = _Parser(text, sink)
    p.body(0, p.s.n, None)
