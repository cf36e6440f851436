"""Go."""

from __future__ import annotations

from lodestone.sources.extract.base import Sink, Source, trimmed
from lodestone.sources.extract.lex import GO

NOT_CALLED = frozenset("if for switch select return func go defer range case else map chan interface struct type var const".split())
MOST_SPECS = 128


class _Parser:
    def __init__(self, text: str, sink: Sink):
        self.s, self.sink = Source(text, GO, NOT_CALLED), sink

    def run(self) -> None:
        s, i = self.s, 0
        while i < s.n:
            x = s.text(i)
            if x == "func":
                i = self.function(i)
            elif x in ("import", "const", "var", "type"):
                i = self.group(i)
            elif x in ("{", "(") and s.kind(i) == "punct":
                i = s.close(i) + 1
            else:
                i += 1

    def line_end(self, i: int, hi: int) -> int:
        """The place after a spec that begins at i: where its line ends outside of brackets."""
        s, k = self.s, i
        while k < hi:
            if s.text(k) in ("(", "[", "{") and s.kind(k) == "punct":
                k = s.close(k)
            if k + 1 >= hi or s.text(k + 1) == ";" or s.text(k + 1) in (")", "}"):
                return k + 1
            here = s.t[k]
            if s.line(k + 1) > s.last_line(k) and (here.kind != "punct" or here.text in (")", "]", "}", "*")):
                return k + 1
            k += 1
        return hi

    def group(self, i: int) -> int:
        s, word = self.s, self.s.text(i)
        if s.text(i + 1) == "(":
            lo, hi = i + 2, s.close(i + 1)
        else:
            lo, hi = i + 1, self.line_end(i + 1, s.n)
        k, specs = lo, 0
        while k < hi and specs < MOST_SPECS:
            if s.text(k) == ";":
                k += 1
                continue
            end = self.line_end(k, hi)
            first = i if word in ("const", "var") and s.text(i + 1) != "(" else k
            if word == "import":
                path = next((s.text(j) for j in range(k, end) if s.kind(j) == "string"), "")
                self.sink.include(path[1:-1], s.line(k), s.last_line(end - 1))
            elif word == "type":
                self.type_spec(k, end)
            elif s.is_name(k):
                self.sink.symbol(s.text(k), "Variable", s.line(first), s.last_line(end - 1))
            specs += 1
            k = max(end, k + 1)
        return hi + 1 if s.text(i + 1) == "(" else max(hi, i + 1)

    def type_spec(self, k: int, end: int) -> None:
        s, name, j = self.s, self.s.text(k), k + 1
        if s.text(j) == "[" and s.is_name(j + 1) and s.text(j + 2) != "]":
            j = s.close(j) + 1
        if s.text(j) == "=":
            j += 1
        kind = {"struct": "Struct", "interface": "Interface"}.get(s.text(j), "Alias")
        if not s.is_name(k) or not self.sink.symbol(name, kind, s.line(k), s.last_line(end - 1)) or kind == "Alias" or s.text(j + 1) != "{":
            return
        at, hi = j + 2, s.close(j + 1)
        while at < hi:
            if s.text(at) == ";":
                at += 1
                continue
            stop = self.line_end(at, hi)
            b = stop - (s.kind(stop - 1) == "string")  # a tag
            lo = at + (s.text(at) == "*")
            text = s.slice(lo, b)
            plain = all(s.is_name(x) if (x - lo) % 2 == 0 else s.text(x) == "." for x in range(lo, b)) and (b - lo) % 2 == 1
            if plain and (kind == "Struct" or s.text(at) != "*"):
                self.sink.edge(name, text, "Inherits")
            at = max(stop, at + 1)

    def bare_types(self, lo: int, hi: int, named: bool) -> list[str]:
        """Types of a list that are one plain name each; pointers, slices and qualified names aren't."""
        s, parts = self.s, self.s.items(lo, hi, angles=False)
        typed = any(b - a > 1 and s.is_name(a) and (s.is_name(a + 1) or s.text(a + 1) in ("*", "[", "(", "...") or s.text(a + 1) in ("func", "map", "chan", "interface", "struct")) for a, b in parts)
        out = []
        for a, b in parts:
            if not named and not typed:
                if b - a == 1 and s.is_name(a):
                    out.append(s.text(a))
            elif typed:
                if b - a == 2 and s.is_name(a) and s.is_name(a + 1):
                    out.append(s.text(a + 1))
            elif b - a == 1 and s.is_name(a):
                out.append(s.text(a))
        return out

    def function(self, i: int) -> int:
        s, k, receiver = self.s, i + 1, None
        if s.text(k) == "(":
            inner = [j for j in range(k + 1, s.close(k))]
            names = [j for j in inner if s.is_name(j)]
            stop = next((j for j in inner if s.text(j) == "["), s.close(k))
            names = [j for j in names if j < stop]
            receiver = s.text(names[-1]) if names else None
            k = s.close(k) + 1
        if not s.is_name(k):
            return k + 1
        name = s.text(k)
        k += 1
        if s.text(k) == "[":
            k = s.close(k) + 1
        if s.text(k) != "(":
            return k
        bracket, close = k, s.close(k)
        k = close + 1
        result = k
        while k < s.n and s.text(k) != "{":
            if s.line(k) > s.last_line(k - 1) and k > result - 1 and s.text(k) in ("func", "type", "var", "const", "import"):
                break
            if s.text(k) in ("interface", "struct") and s.text(k + 1) == "{":
                k = s.close(k + 1) + 1
                continue
            k = s.close(k) + 1 if s.text(k) in ("(", "[") else k + 1
        body = s.text(k) == "{"
        end = s.close(k) if body else k - 1
        signature = trimmed(s.source[s.t[i].start : s.t[k].start]) if body else None
        if self.sink.symbol(name, "Function", s.line(i), s.last_line(end), signature, receiver):
            if body:
                self.sink.edges(name, s.calls(k, end, frozenset({"."})), "Calls")
            if s.text(result) == "(":
                self.sink.edges(name, self.bare_types(result + 1, s.close(result), named=False), "Returns")
            elif k - result == 1 and s.is_name(result):
                self.sink.edge(name, s.text(result), "Returns")
            self.sink.edges(name, self.bare_types(bracket + 1, close, named=True), "TypedAs")
        return end + 1


def extract_go(text: str, sink: Sink) -> None:
    _Parser(text, sink).run()
