"""Rust."""

from __future__ import annotations

from lodestone.sources.extract.base import MOST_ITEMS, Sink, Source, trimmed
from lodestone.sources.extract.lex import RUST

NOT_CALLED = frozenset("if while match return for loop in let else move unsafe as break where fn pub crate".split())
# The names of the language's own types, which name no user type, and words within types.
PRIMITIVE = frozenset("bool char str i8 i16 i32 i64 i128 isize u8 u16 u32 u64 u128 usize f32 f64 mut dyn impl const ref fn self crate super where for as".split())


class _Parser:
    def __init__(self, text: str, sink: Sink):
        self.s, self.sink = Source(text, RUST, NOT_CALLED), sink

    def type_name(self, lo: int, hi: int) -> str:
        """The first type name of a range; a path's leading parts aren't types."""
        s = self.s
        return next((s.text(k) for k in range(lo, hi) if s.is_name(k) and s.text(k) not in PRIMITIVE and s.text(k + 1) != "::"), "")

    def items(self, lo: int, hi: int, parent: str | None) -> None:
        s, i = self.s, lo
        while i < hi:
            i = self.item(i, hi, parent)

    def item(self, i: int, hi: int, parent: str | None) -> int:
        s = self.s
        if s.text(i) in (";", "}", ")", ","):
            return i + 1
        if s.text(i) == "#":
            k = i + 1 + (s.text(i + 1) == "!")
            return s.close(k) + 1 if s.text(k) == "[" else i + 1
        first = i
        while s.text(i) in ("pub", "unsafe", "async", "default", "extern") or s.text(i) == "const" and s.text(i + 1) in ("fn", "unsafe", "async", "extern"):
            i += 1
            if s.text(i) == "(" and s.text(i - 1) == "pub":
                i = s.close(i) + 1
            if s.kind(i) == "string":
                i += 1
        x = s.text(i)
        if x == "fn":
            return self.function(first, i, hi, parent)
        if x in ("struct", "enum", "union") and s.is_name(i + 1):
            k = i + 2
            while k < hi and s.text(k) not in ("{", ";"):
                k = s.angle(k, hi) if s.text(k) == "<" else s.close(k) + 1 if s.text(k) == "(" else k + 1
            end = s.close(k) if s.text(k) == "{" else k
            if x != "union":
                self.sink.symbol(s.text(i + 1), "Struct" if x == "struct" else "Enum", s.line(first), s.last_line(end), None, parent)
            return end + 1
        if x == "trait":
            return self.trait(first, i, hi, parent)
        if x == "impl":
            return self.impl(i, hi, parent)
        if x == "mod":
            k = i + 2
            end = s.close(k) if s.text(k) == "{" else k
            self.sink.symbol(s.text(i + 1), "Namespace", s.line(first), s.last_line(end))
            if s.text(k) == "{":
                self.items(k + 1, end, None)
            return end + 1
        if x == "use":
            end = s.until(i, hi, {";"})
            self.sink.include(s.slice(i + 1, end), s.line(first), s.last_line(min(end, hi - 1)))
            return end + 1
        if x in ("type", "const", "static") and (s.is_name(i + 1)):
            k = i + 1 + (s.text(i + 1) == "mut")
            end = s.until(i, hi, {";"})
            kind = "Alias" if x == "type" else "Variable"
            self.sink.symbol(s.text(k), kind, s.line(first), s.last_line(min(end, hi - 1)), None, None if x == "static" else parent)
            return end + 1
        if x == "macro_rules":
            k = i + 2
            body = k + 1
            end = s.close(body)
            self.sink.symbol(s.text(k), "Macro", s.line(first), s.last_line(end))
            return end + 1
        if x == "{":
            self.items(i + 1, s.close(i), parent)
            return s.close(i) + 1
        if s.is_name(i) and s.text(i + 1) == "!":
            k = i + 2 + s.is_name(i + 2)
            return s.close(k) + 1 if s.text(k) in ("(", "[", "{") else k + 1
        return i + 1

    def function(self, first: int, i: int, hi: int, parent: str | None) -> int:
        s, name, k = self.s, self.s.text(i + 1), i + 2
        if s.text(k) == "<":
            k = s.angle(k, hi)
        bracket, close = k, s.close(k)
        k = close + 1
        arrow = k if s.text(k) == "->" else -1
        while k < hi and s.text(k) not in ("{", ";"):
            k = s.close(k) + 1 if s.text(k) in ("(", "[") else k + 1
        if s.text(k) != "{":
            return k + 1  # told of, without a body
        end = s.close(k)
        if self.sink.symbol(name, "Function", s.line(first), s.last_line(end), trimmed(s.source[s.t[first].start : s.t[k].start]), parent):
            self.sink.edges(name, s.calls(k, end, generic=True, macros=True), "Calls")
            if arrow >= 0:
                where = next((j for j in range(arrow, k) if s.text(j) == "where"), k)
                self.sink.edge(name, self.type_name(arrow, where), "Returns")
            for a, b in s.items(bracket + 1, close)[:MOST_ITEMS]:
                colon = s.until(a, b, {":"})
                if colon < b:
                    self.sink.edge(name, self.type_name(colon, b), "TypedAs")
        return end + 1

    def trait(self, first: int, i: int, hi: int, parent: str | None) -> int:
        s, name, k = self.s, self.s.text(i + 1), i + 2
        if s.text(k) == "<":
            k = s.angle(k, hi)
        bounds = []
        if s.text(k) == ":":
            stop = k + 1
            while stop < hi and s.text(stop) not in ("{", "where", ";"):
                stop = s.angle(stop, hi) if s.text(stop) == "<" else stop + 1
            for a, b in s.items(k + 1, stop, separator="+"):
                bounds.append(self.type_name(a, b))
            k = stop
        while k < hi and s.text(k) not in ("{", ";"):
            k += 1
        end = s.close(k) if s.text(k) == "{" else k
        if self.sink.symbol(name, "Interface", s.line(first), s.last_line(end), None, parent):
            self.sink.edges(name, bounds, "Inherits", MOST_ITEMS)
        if s.text(k) == "{":
            self.items(k + 1, end, name)
        return end + 1

    def impl(self, i: int, hi: int, parent: str | None) -> int:
        s, k = self.s, i + 1
        if s.text(k) == "<":
            k = s.angle(k, hi)
        head = k
        while k < hi and s.text(k) not in ("{", ";", "where"):
            k = s.angle(k, hi) if s.text(k) == "<" else s.close(k) + 1 if s.text(k) in ("(", "[") else k + 1
        stop = k
        while k < hi and s.text(k) not in ("{", ";"):
            k += 1
        of = next((j for j in range(head, stop) if s.text(j) == "for"), -1)
        owner = self.type_name(of + 1 if of >= 0 else head, stop)
        if of >= 0 and owner:
            self.sink.edge(owner, self.type_name(head, of), "Inherits")
        if s.text(k) != "{":
            return k + 1
        self.items(k + 1, s.close(k), owner or parent)
        return s.close(k) + 1


def extract_rust(text: str, sink: Sink) -> None:
    p = _Parser(text, sink)
    p.items(0, p.s.n, None)
