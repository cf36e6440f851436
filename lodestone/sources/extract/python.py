"""Python, by logical lines and their indents, so that an error in one place leaves the rest readable."""

from __future__ import annotations

from dataclasses import dataclass

from lodestone.sources.extract.base import MOST_ITEMS, Sink, Source, trimmed
from lodestone.sources.extract.lex import Dialect

PYTHON = Dialect(
    line_comment=r"#[^\n]*", block_comment=None, chars=r"(?!)",
    strings=r"(?:[rRbBuUfFtT]{0,2})(?:\"\"\"(?:\\[\s\S]|[^\\])*?(?:\"\"\"|\Z)|'''(?:\\[\s\S]|[^\\])*?(?:'''|\Z)|\"(?:\\[\s\S]|[^\"\\\n])*\"?|'(?:\\[\s\S]|[^'\\\n])*'?)",
    names=r"[A-Za-z_\u0080-\U0010ffff][\w\u0080-\U0010ffff]*", puncts=r"->|:=|==|!=|<=|>=|\*\*=|//=|>>=|<<=|[-+*/%&|^@]=|\*\*|//|\\\r?\n|.|\n",
)
KEYWORDS = frozenset("if elif else for while with try except finally return yield lambda not and or in is assert del raise global nonlocal pass break continue import from as await async print exec match case def class".split()) - {"print", "exec", "match"}
BLOCKS = frozenset("if elif else for while with try except finally async match case".split())


@dataclass
class _Line:
    indent: int
    lo: int
    hi: int


class _Parser:
    def __init__(self, text: str, sink: Sink):
        self.s, self.sink = Source(text, PYTHON, KEYWORDS), sink
        s = self.s
        self.lines: list[_Line] = []
        i = 0
        while i < s.n:
            if s.text(i).startswith("\\"):
                i += 1
                continue
            lo, line = i, s.line(i)
            while i < s.n:
                if s.text(i) in ("(", "[", "{") and s.kind(i) == "punct":
                    i = s.match.get(i, i)
                elif s.text(i) == ";" and s.kind(i) == "punct":
                    break
                line = s.last_line(i)
                i += 1
                if i < s.n and s.line(i) != line:
                    if s.text(i - 1).startswith("\\"):
                        line = s.line(i)
                        continue
                    break
            begin = text.rfind("\n", 0, s.t[lo].start) + 1
            space = text[begin : s.t[lo].start]
            indent = len(space.expandtabs(8)) if not space.strip() else self.lines[-1].indent if self.lines else 0
            if i > lo:
                self.lines.append(_Line(indent, lo, i))
            if i < s.n and s.text(i) == ";":
                i += 1

    def block(self, at: int) -> int:
        """The line after the block that the line at hand heads."""
        end = at + 1
        while end < len(self.lines) and self.lines[end].indent > self.lines[at].indent:
            end += 1
        return end

    def run(self, lo: int, hi: int, parent: str | None) -> None:
        s, i = self.s, lo
        while i < hi:
            line = self.lines[i]
            a, b = line.lo, line.hi
            word = s.text(a)
            if word == "async" and s.text(a + 1) == "def":
                word = "def"
            if word == "def" or word == "class" and s.is_name(a + 1):
                end = self.block(i)
                (self.function if word == "def" else self.klass)(i, end, parent)
                i = end
                continue
            if word == "import":
                self.imports(a, b)
            elif word == "from":
                self.from_import(a, b)
            elif s.text(a + 1) in ("=", ":") and s.is_name(a) and word not in BLOCKS and word not in ("lambda",):
                if not (word.startswith("__") and word.endswith("__")):
                    self.sink.symbol(word, "Variable", s.line(a), s.last_line(b - 1), None, parent)
            elif word in BLOCKS:  # what follows its colon on the same line is a line of the block
                colon = s.until(a, b, {":"})
                if colon < b - 1:
                    self.lines.insert(i + 1, _Line(line.indent, colon + 1, b))
                    self.lines[i] = _Line(line.indent, a, colon + 1)
                    hi += 1
            i += 1

    def body_end(self, i: int, end: int) -> int:
        return self.s.last_line(self.lines[end - 1].hi - 1)

    def colon(self, line: _Line) -> int:
        return self.s.until(line.lo, line.hi, {":"})

    def function(self, i: int, end: int, parent: str | None) -> None:
        s, line = self.s, self.lines[i]
        at = next((k for k in range(line.lo, line.hi) if s.text(k) == "def"), line.lo)
        name, colon = s.text(at + 1), self.colon(line)
        first = colon + 1 if colon < line.hi - 1 else self.lines[i + 1].lo if i + 1 < end else line.hi
        last = self.lines[end - 1].hi
        body = s.t[first].start if first < s.n and first < last else None
        signature = trimmed(s.source[s.t[line.lo].start : s.t[colon].end if colon < s.n and colon < line.hi else s.t[line.hi - 1].end], ":") if body is not None else None
        if not s.is_name(at + 1) or not self.sink.symbol(name, "Function", s.line(line.lo), self.body_end(i, end), signature, parent):
            return
        self.sink.edges(name, s.calls(first, last, frozenset({"."})), "Calls")
        arrow = next((k for k in range(line.lo, colon) if s.text(k) == "->"), -1)
        if arrow >= 0:
            self.sink.edge(name, s.slice(arrow + 1, colon).strip(), "Returns")

    def klass(self, i: int, end: int, parent: str | None) -> None:
        s, line = self.s, self.lines[i]
        name = s.text(line.lo + 1)
        if self.sink.symbol(name, "Class", s.line(line.lo), self.body_end(i, end), None, parent, member=False):
            at = line.lo + 2
            if s.text(at) == "[":
                at = s.close(at) + 1
            if s.text(at) == "(":
                bases = []
                for a, b in s.items(at + 1, s.close(at), angles=False):
                    plain = all(s.is_name(k) if (k - a) % 2 == 0 else s.text(k) == "." for k in range(a, b)) and (b - a) % 2 == 1
                    if plain:
                        bases.append(s.text(b - 1))
                self.sink.edges(name, bases, "Inherits", MOST_ITEMS)
        colon = self.colon(line)
        if colon < line.hi - 1:
            self.lines.insert(i + 1, _Line(line.indent + 1, colon + 1, line.hi))
            self.lines[i] = _Line(line.indent, line.lo, colon + 1)
            self.run(i + 1, i + 2, name)
            self.lines.pop(i + 1)
            self.lines[i] = line
        self.run(i + 1, end, name)

    def imports(self, a: int, b: int) -> None:
        s = self.s
        for lo, hi in s.items(a + 1, b, angles=False)[:MOST_ITEMS]:
            stop = s.until(lo, hi, {"as"})
            self.sink.include("".join(s.text(k) for k in range(lo, stop)), s.line(a), s.last_line(b - 1))

    def from_import(self, a: int, b: int) -> None:
        s = self.s
        stop = s.until(a, b, {"import"})
        module = "".join(s.text(k) for k in range(a + 1, stop))
        if stop >= b:
            return
        self.sink.include(module, s.line(a), s.last_line(b - 1))
        if module.startswith("."):
            lo, hi = stop + 1, b
            if s.text(lo) == "(":
                lo, hi = lo + 1, s.close(lo)
            for x, y in s.items(lo, hi, angles=False)[:MOST_ITEMS]:
                name = "".join(s.text(k) for k in range(x, s.until(x, y, {"as"})))
                if name != "*":
                    self.sink.include(name, s.line(a), s.last_line(b - 1))


def extract_python(text: str, sink: Sink) -> None:
    p = _Parser(text, sink)
    p.run(0, len(p.lines), None)
