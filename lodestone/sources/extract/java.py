"""Java."""

from __future__ import annotations

from lodestone.sources.extract.base import MOST_ITEMS, Sink, Source, trimmed
from lodestone.sources.extract.lex import JAVA

NOT_CALLED = frozenset("if for while switch return catch synchronized super this throw new assert try do else case yield instanceof".split())
MODIFIERS = frozenset("public protected private static final abstract native synchronized transient volatile strictfp default sealed non".split())
# Words for types that aren't names of types.
PRIMITIVE = frozenset("void boolean byte short int long float double char var extends super final".split())


class _Parser:
    def __init__(self, text: str, sink: Sink):
        self.s, self.sink = Source(text, JAVA, NOT_CALLED), sink
        self.note = False  # inside an annotation type

    def types(self, lo: int, hi: int) -> list[str]:
        """Type names of a range: of a generic type its bare name only, of a qualified one the last part."""
        s, out, k = self.s, [], lo
        while k < hi:
            if s.text(k) == "<":
                k = s.angle(k, hi)
            elif s.text(k) == "@":
                k += 2
                if s.text(k) == "(":
                    k = s.close(k) + 1
            else:
                if s.is_name(k) and s.text(k) not in PRIMITIVE and s.text(k + 1) != ".":
                    out.append(s.text(k))
                k += 1
        return out

    def body(self, lo: int, hi: int, parent: str | None, enum: bool = False) -> None:
        s, i = self.s, lo
        if enum:  # the constants
            i = s.until(i, hi, {";"}) + 1
        while i < hi:
            if s.text(i) in (";", "}", ")", ","):
                i += 1
            elif s.text(i) == "{":  # an initialiser
                i = s.close(i) + 1
            else:
                i = self.member(i, hi, parent)

    def member(self, first: int, hi: int, parent: str | None) -> int:
        s, i = self.s, first
        while i < hi:
            if s.text(i) == "@" and s.text(i + 1) != "interface":
                i += 2
                while s.text(i) == ".":
                    i += 2
                if s.text(i) == "(":
                    i = s.close(i) + 1
            elif s.text(i) in MODIFIERS and not (s.text(i) == "default" and s.text(i + 1) in (":", "->")):
                i += 1
                if s.text(i) == "-":
                    i += 2
            else:
                break
        x = s.text(i)
        if x in ("package", "import", "module", "open", "requires", "exports"):
            end = s.until(i, hi, {";"})
            if x == "import":
                k = i + 1 + (s.text(i + 1) == "static")
                parts = [s.text(j) for j in range(k, end) if s.is_name(j)]
                self.sink.include(".".join(parts), s.line(first), s.last_line(end))
            return end + 1
        if x in ("class", "interface", "enum") and s.is_name(i + 1) or x == "record" and s.is_name(i + 1) and s.text(i + 2) in ("(", "<") or x == "@":
            return self.type_declaration(first, i, hi, parent)
        if s.text(i) == "{":
            return s.close(i) + 1
        if s.text(i) == "<":
            i = s.angle(i, hi)
        k = i
        while k < hi and s.text(k) not in ("(", "=", ";", "{", ","):
            k = s.angle(k, hi) if s.text(k) == "<" else s.close(k) + 1 if s.text(k) == "[" else k + 2 if s.text(k) == "@" else k + 1
        if s.text(k) == "(" and s.is_name(k - 1):
            return self.method(first, i, k, hi, parent)
        if s.text(k) == "{" and s.is_name(k - 1) and k - 1 == i:  # a record's compact constructor
            self.callable(first, k - 1, i, i, -1, k, s.close(k), parent)
            return s.close(k) + 1
        end = s.until(i, hi, {";"}, angles=False)
        names = []
        for n, (a, b) in enumerate(s.items(i, end)):
            b = s.until(a, b, {"="}, angles=True)
            while b - 1 > a and s.text(b - 1) in ("]", "["):
                b -= 1
            if s.is_name(b - 1) and (n or b - 1 > a):
                names.append(s.text(b - 1))
        for name in names[:MOST_ITEMS]:
            self.sink.symbol(name, "Variable", s.line(first), s.last_line(min(end, hi - 1)), None, parent)
        return end + 1

    def type_declaration(self, first: int, i: int, hi: int, parent: str | None) -> int:
        s, word = self.s, self.s.text(i)
        if word == "@":
            i, word = i + 1, "@interface"
        name, k = s.text(i + 1), i + 2
        heads: dict[str, list[str]] = {}
        while k < hi and s.text(k) not in ("{", ";"):
            if s.text(k) == "<":
                k = s.angle(k, hi)
            elif s.text(k) == "(":
                k = s.close(k) + 1
            elif s.text(k) in ("extends", "implements", "permits"):
                stop = k + 1
                while stop < hi and s.text(stop) not in ("{", ";", "extends", "implements", "permits"):
                    stop = s.angle(stop, hi) if s.text(stop) == "<" else stop + 1
                heads[s.text(k)] = self.types(k + 1, stop)
                k = stop
            else:
                k += 1
        if s.text(k) != "{":
            return k + 1
        end = s.close(k)
        kind = {"class": "Class", "record": "Class", "interface": "Interface", "enum": "Enum", "@interface": "Class"}[word]
        signature = trimmed(s.source[s.t[first].start : s.t[k].start]) if word in ("class", "record", "interface") else None
        if self.sink.symbol(name, kind, s.line(first), s.last_line(end), signature, parent):
            self.sink.edges(name, [*heads.get("extends", []), *heads.get("implements", [])], "Inherits", MOST_ITEMS)
        outer, self.note = self.note, word == "@interface"
        self.body(k + 1, end, name, word == "enum")
        self.note = outer
        return end + 1

    def method(self, first: int, typed: int, bracket: int, hi: int, parent: str | None) -> int:
        s, close = self.s, self.s.close(bracket)
        k = close + 1
        while k < hi and s.text(k) not in ("{", ";"):
            k += 1
        body = s.text(k) == "{"
        end = s.close(k) if body else k
        if self.note and not body:
            return end + 1  # an annotation's elements have no rows
        self.callable(first, bracket - 1, typed, bracket - 1, bracket, k if body else -1, min(end, hi - 1 if not body and end >= hi else end), parent)
        return end + 1

    def callable(self, first: int, at: int, typed: int, typed_end: int, bracket: int, body: int, end: int, parent: str | None) -> None:
        s = self.s
        signature = trimmed(s.source[s.t[first].start : s.t[body].start]) if body >= 0 else trimmed(s.slice(first, end + 1), ";")
        name = s.text(at)
        if not self.sink.symbol(name, "Function", s.line(first), s.last_line(end), signature, parent):
            return
        if body >= 0:
            self.sink.edges(name, [c for c in s.calls(body, end, frozenset({"."}), generic=False) if c], "Calls")
        self.sink.edges(name, self.types(typed, typed_end), "Returns")
        if bracket >= 0:
            for a, b in s.items(bracket + 1, s.close(bracket))[:MOST_ITEMS]:
                while b > a and not s.is_name(b - 1):
                    b -= 1
                self.sink.edges(name, self.types(a, b - 1), "TypedAs")


def extract_java(text: str, sink: Sink) -> None:
    p = _Parser(text, sink)
    p.body(0, p.s.n, None)
