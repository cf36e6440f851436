"""What extractors write, and what they share."""

from __future__ import annotations

from lodestone.functions.model import KIND, RELATION
from lodestone.sources.extract.lex import Dialect, Token, lex, matches

#: Calls looked at in a function, and items of a list (bases, imports, parameters, declarators).
MOST_CALLS, MOST_ITEMS = 10_000, 64


class Sink:
    """Rows of one file in the order in which they are found; the file's own symbol is first. Empty names are dropped."""

    def __init__(self, path: str):
        self.path = path
        self.rows: list[tuple] = []
        self.rows.append(("S", path, KIND["File"], 0, 0, None, None, None, None, None))

    def symbol(self, name: str, kind: str, start: int, end: int, signature: str | None = None, parent: str | None = None, member: bool = True, defined: bool = True) -> bool:
        if not name:
            return False
        self.rows.append(("S", name, KIND[kind], start, end, signature or None, parent or None, None, None, None))
        if defined:
            self.edge(name, self.path, "DefinedIn")
        if member and parent:
            self.edge(name, parent, "MemberOf")
        return True

    def include(self, name: str, start: int, end: int) -> None:
        if self.symbol(name, "Include", start, end, defined=False):
            self.edge(self.path, name, "Includes")

    def edge(self, src: str, dst: str, relation: str) -> None:
        if src and dst:
            self.rows.append(("E", None, None, None, None, None, None, src, dst, RELATION[relation]))

    def edges(self, src: str, many: list[str], relation: str, most: int | None = None) -> None:
        for dst in many[:most]:
            self.edge(src, dst, relation)


class Source:
    """A file's tokens and the helpers over them; places are indices of tokens, ranges are half open."""

    def __init__(self, text: str, dialect: Dialect, not_called: frozenset[str] = frozenset()):
        self.source = text
        self.t: list[Token] = lex(text, dialect)
        self.match = matches(self.t)
        self.n = len(self.t)
        self.not_called = not_called

    def text(self, i: int) -> str:
        return self.t[i].text if 0 <= i < self.n else ""

    def kind(self, i: int) -> str:
        return self.t[i].kind if 0 <= i < self.n else ""

    def is_name(self, i: int) -> bool:
        return self.kind(i) == "name"

    def close(self, i: int, default: int | None = None) -> int:
        """The partner of the bracket at i; of one that isn't closed, the file's end."""
        return self.match.get(i, self.n - 1 if default is None else default)

    def line(self, i: int) -> int:
        return self.t[min(i, self.n - 1)].line

    def last_line(self, i: int) -> int:
        t = self.t[min(max(i, 0), self.n - 1)]
        return t.line + t.text.count("\n")

    def slice(self, lo: int, hi: int) -> str:
        """Source of the tokens lo to hi - 1."""
        return self.source[self.t[lo].start : self.t[hi - 1].end] if lo < hi <= self.n else ""

    def until(self, i: int, hi: int, stops: set[str], angles: bool = False) -> int:
        """The first place from i on that has one of the texts, outside of brackets; hi if none has."""
        depth = 0
        while i < hi:
            x = self.text(i)
            if self.kind(i) == "punct":
                if depth <= 0 and x in stops:
                    return i
                if x in "([{" and x:
                    i = self.close(i, hi) + 1
                    continue
                if angles and x == "<":
                    depth += 1
                elif angles and x == ">":
                    depth -= 1
            elif depth <= 0 and x in stops:
                return i
            i += 1
        return hi

    def angle(self, i: int, hi: int) -> int:
        """The place after the closing angle of the opening one at i."""
        depth = 0
        while i < hi:
            x = self.text(i)
            if x == "<":
                depth += 1
            elif x == ">":
                depth -= 1
                if not depth:
                    return i + 1
            elif x in ("(", "[", "{"):
                i = self.close(i, hi)
            elif x == ";":
                return i
            i += 1
        return hi

    def calls(self, lo: int, hi: int, chain: frozenset[str] = frozenset({".", "?.", "->", "::"}), generic: bool = False, macros: bool = False) -> list[str]:
        """Names of what is called, an outer call before those in its callee and arguments. macros: what a name and ! are given are tokens, not calls."""
        found: list[tuple[int, int, str]] = []
        after = lo
        for i in range(lo, hi):
            if i < after:
                continue
            if macros and self.text(i) == "!" and self.is_name(i - 1) and self.text(i + 1) in ("(", "[", "{"):
                after = self.close(i + 1, hi) + 1
                continue
            if self.text(i) != "(" or self.kind(i) != "punct":
                continue
            at = i - 1
            if self.text(at) == "?.":
                at -= 1
            if generic and self.text(at) == ">":
                depth, at = 1, at - 1
                while at > lo and depth and self.text(at) not in (";", "{", "}", ")"):
                    depth += {">": 1, "<": -1}.get(self.text(at), 0)
                    at -= 1
                if self.text(at) == "::":
                    at -= 1
            if at < lo or not self.is_name(at) or self.text(at) in self.not_called:
                continue
            begin, direct = at, True
            while begin - 1 >= lo and self.text(begin - 1) in chain and self.kind(begin - 1) == "punct":
                if begin - 2 < lo:
                    break
                before = begin - 2
                while before > lo and self.text(before) in (")", "]") and before in self.match:
                    before, direct = self.match[before] - 1, False
                if not self.is_name(before) and self.kind(before) not in ("string", "number"):
                    begin = min(before + 1, begin - 1)
                    break
                begin = before
            if direct and self.text(begin - 1) in ("new", "func", "function", "fn", "def", "class") and begin - 1 >= lo:
                continue
            found.append((begin, -self.close(i, hi), self.text(at)))
            if len(found) >= MOST_CALLS:
                break
        return [name for _, _, name in sorted(found)]

    def items(self, lo: int, hi: int, angles: bool = True, separator: str = ",") -> list[tuple[int, int]]:
        """The parts of a range between separators outside of brackets."""
        out, at = [], lo
        while at < hi:
            end = self.until(at, hi, {separator}, angles)
            if end > at:
                out.append((at, end))
            at = end + 1
        return out


def trimmed(text: str, ends: str = "") -> str:
    """text without white space and the given signs at its end."""
    text = text.rstrip()
    while text and ends and text[-1] in ends:
        text = text[:-1].rstrip()
    return text
