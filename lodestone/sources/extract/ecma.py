"""JavaScript, TypeScript and TSX."""

from __future__ import annotations

from lodestone.sources.extract.base import MOST_ITEMS, Sink, Source, trimmed
from lodestone.sources.extract.lex import ECMA

NOT_CALLED = frozenset("if for while switch return catch super typeof instanceof in of delete void throw new await yield do else case with function async import".split())
MEMBER_WORDS = frozenset("public private protected static readonly abstract override declare async get set accessor".split())
STATEMENTS = frozenset("if for while do switch try catch finally else with".split())
CHAIN = frozenset({".", "?."})


class _Parser:
    def __init__(self, text: str, sink: Sink, typed: bool):
        self.s, self.sink, self.typed = Source(text, ECMA, NOT_CALLED), sink, typed

    def statements(self, lo: int, hi: int, parent: str | None) -> None:
        s, i = self.s, lo
        while i < hi:
            i = self.statement(i, hi, parent)

    def statement(self, i: int, hi: int, parent: str | None) -> int:
        s, x, first = self.s, self.s.text(i), i
        if x in (";", "}", ")", "]", ","):
            return i + 1
        if x == "{":
            self.statements(i + 1, s.close(i), parent)
            return s.close(i) + 1
        if x == "@":
            i += 2
            while s.text(i) == ".":
                i += 2
            return s.close(i) + 1 if s.text(i) == "(" else i
        if x == "export":
            i += 1
            if s.text(i) == "default":
                i += 1
            if s.text(i) in ("{", "*", "="):
                return self.end(i, hi) + 1
            return self.statement(i, hi, parent)
        if x == "import" and s.text(i + 1) not in ("(", "."):
            end = self.end(i, hi)
            source = next((s.text(k) for k in range(end if s.kind(end) in ("string", "char") else end - 1, i, -1) if s.kind(k) in ("string", "char")), "")
            self.sink.include(source[1:-1], s.line(first), s.last_line(min(end, hi - 1)))
            return end + 1
        if x == "async" and s.text(i + 1) == "function":
            i += 1
            x = "function"
        if x == "function":
            k = i + 1 + (s.text(i + 1) == "*")
            if s.is_name(k):
                return self.function(first, k, hi, parent)
        if x in ("abstract", "declare") and s.is_name(i + 1) and self.typed:
            return self.statement(i + 1, hi, parent)
        if x == "class" and s.is_name(i + 1):
            return self.klass(i, hi, parent)
        if x in ("var", "let", "const"):
            if self.typed and s.text(i + 1) == "enum":
                return self.enum(first, i + 1, hi, parent)
            if s.is_name(i + 1) or s.text(i + 1) in ("{", "["):
                return self.variables(i, hi, parent)
        if self.typed and x == "interface" and s.is_name(i + 1):
            return self.interface(i, hi, parent)
        if self.typed and x == "enum" and s.is_name(i + 1):
            return self.enum(first, i, hi, parent)
        if self.typed and x == "type" and s.is_name(i + 1) and s.text(i + 2) in ("=", "<"):
            end = self.end(i, hi)
            self.sink.symbol(s.text(i + 1), "Alias", s.line(i), s.last_line(min(end, hi - 1)))
            return end + 1
        if self.typed and x in ("namespace", "module") and (s.is_name(i + 1) or s.kind(i + 1) in ("string", "char")):
            k = s.until(i, hi, {"{"})
            if k < hi:
                self.statements(k + 1, s.close(k), parent)
                return s.close(k) + 1
        if x in STATEMENTS:
            k = i + 1
            if s.text(k) == "await":
                k += 1
            if s.text(k) == "(":
                k = s.close(k) + 1
            return k if k > i else i + 1
        return self.end(i, hi) + 1

    def end(self, i: int, hi: int) -> int:
        """The last token of a statement without a body of its own: a semicolon, or the line's end where one can be."""
        s, k = self.s, i
        while k < hi:
            x = s.text(k)
            if x == ";":
                return k
            if x in ("(", "[", "{") and s.kind(k) == "punct":
                k = s.close(k)
            if k + 1 >= hi or s.text(k + 1) == "}":
                return k
            here, after = s.t[k], s.t[k + 1]
            if s.line(k + 1) > s.last_line(k) and after.kind in ("name", "number", "string", "char") and (here.kind in ("name", "number", "string", "char") or here.text in (")", "]", "}")):
                if here.text not in ("from", "return", "import", "export", "of", "in", "instanceof", "typeof", "new", "await", "extends") and after.text not in ("from", "instanceof", "in", "of", "as"):
                    return k
            if after.text in ("@",) and s.line(k + 1) > s.last_line(k):
                return k
            k += 1
        return hi

    def annotation(self, i: int, hi: int) -> int:
        """The place after a type annotation that begins with the colon at i."""
        s, k = self.s, i + 1
        while k < hi:
            x = s.text(k)
            if x == "{" and s.text(k - 1) not in (":", "|", "&", "<", ",", "=>", "("):
                return k
            if x in (";", "=", ",", ")") or (x == "=>" and s.text(k - 1) != ")"):
                return k
            k = s.angle(k, hi) if x == "<" else s.close(k) + 1 if x in ("(", "[", "{") else k + 1
        return hi

    def callable(self, first: int, name: str, bracket: int, hi: int, parent: str | None, typed_as: bool) -> int:
        """Rows of a function whose parameters begin at bracket; the place after it."""
        s, close = self.s, self.s.close(bracket)
        k, returns = close + 1, ""
        if s.text(k) == ":":
            stop = self.annotation(k, hi)
            returns = s.slice(k, stop)
            k = stop
        if s.text(k) != "{":
            return self.end(first, hi) + 1  # told of, without a body
        end = s.close(k)
        if self.sink.symbol(name, "Function", s.line(first), s.last_line(end), trimmed(s.source[s.t[first].start : s.t[k].start], "{"), parent):
            self.sink.edges(name, s.calls(k, end, CHAIN), "Calls")
            self.sink.edge(name, returns, "Returns")
            if typed_as:
                for a, b in s.items(bracket + 1, close)[:MOST_ITEMS]:
                    colon = s.until(a, b, {":"})
                    self.sink.edge(name, s.slice(colon, s.until(colon, b, {"="}, True)) if colon < b else "", "TypedAs")
        return end + 1

    def function(self, first: int, at: int, hi: int, parent: str | None) -> int:
        s, k = self.s, at + 1
        if s.text(k) == "<":
            k = s.angle(k, hi)
        if s.text(k) != "(":
            return self.end(first, hi) + 1
        return self.callable(first, s.text(at), k, hi, parent, typed_as=False)

    def bases(self, lo: int, hi: int) -> list[str]:
        """Plain names and member paths between commas, without type arguments."""
        s, out, k = self.s, [], lo
        while k < hi:
            if s.text(k) in ("extends", "implements", ","):
                k += 1
            elif s.is_name(k):
                stop = k + 1
                while s.text(stop) == "." and stop + 1 < hi:
                    stop += 2
                if s.text(stop) != "(":
                    out.append(s.slice(k, stop))
                k = stop
            elif s.text(k) == "<":
                k = s.angle(k, hi)
            else:
                k = s.close(k) + 1 if s.text(k) in ("(", "[") else k + 1
        return out[:MOST_ITEMS]

    def klass(self, i: int, hi: int, parent: str | None) -> int:
        s, name, k = self.s, self.s.text(i + 1), i + 2
        if s.text(k) == "<":
            k = s.angle(k, hi)
        head = k
        while k < hi and s.text(k) != "{":
            k = s.angle(k, hi) if s.text(k) == "<" else s.close(k) + 1 if s.text(k) == "(" else k + 1
        end = s.close(k)
        if self.sink.symbol(name, "Class", s.line(i), s.last_line(end), None, parent):
            # Of a member path, as React.Component, the last part is the base.
            self.sink.edges(name, [b.rpartition(".")[2] for b in self.bases(head, k)], "Inherits")
        self.members(k + 1, end, name)
        return end + 1

    def members(self, lo: int, hi: int, parent: str) -> None:
        s, i = self.s, lo
        while i < hi:
            if s.text(i) in (";", ",", "}"):
                i += 1
                continue
            if s.text(i) == "@":
                i += 2
                while s.text(i) == ".":
                    i += 2
                if s.text(i) == "(":
                    i = s.close(i) + 1
                continue
            first = i
            while s.text(i) in MEMBER_WORDS and s.text(i + 1) not in ("(", "=", ";", ":", "<", "?", "!"):
                i += 1
            if s.text(i) == "{":  # a static block
                i = s.close(i) + 1
                continue
            if s.text(i) == "*":
                i += 1
            name, computed = s.text(i), s.text(i) == "["
            if s.kind(i) in ("string", "char"):
                name = s.text(i)
            k = s.close(i) + 1 if computed else i + 1
            if s.text(k) in ("?", "!"):
                k += 1
            if s.text(k) == "<":
                k = s.angle(k, hi)
            if s.text(k) == "(":
                i = self.callable(first, "" if computed else name, k, hi, parent, typed_as=True)
            else:
                i = self.end(k - 1, hi) + 1  # a field has no row

    def variables(self, i: int, hi: int, parent: str | None) -> int:
        s, k, last = self.s, i + 1, i
        rows = []
        while k < hi and len(rows) < MOST_ITEMS:
            name = s.text(k) if s.is_name(k) else ""
            k = k + 1 if s.is_name(k) else s.close(k) + 1
            if s.text(k) == "!":
                k += 1
            if s.text(k) == ":":
                k = self.annotation(k, hi)
            body = None
            if s.text(k) == "=":
                value = k + 1
                body = self.function_value(value, hi)
                if body:
                    k = body[1] + 1
                else:
                    k = value
                    while k < hi and s.text(k) not in (",", ";"):
                        stop = k
                        k = s.close(k) + 1 if s.text(k) in ("(", "[", "{") and s.kind(k) == "punct" else k + 1
                        if self.end(stop, k) < k - 1 or (k < hi and self.end(k - 1, k + 1) == k - 1 and s.text(k) not in (",", ";")):
                            break
            last = k - 1
            rows.append((name, body))
            if s.text(k) != ",":
                break
            k += 1
        if s.text(k) == ";":
            last = k
        for name, body in rows:
            if not name:
                continue
            if body:
                lo, end = body
                if self.sink.symbol(name, "Function", s.line(i), s.last_line(last), trimmed(s.source[s.t[i].start : s.t[lo].start], "{"), parent):
                    self.sink.edges(name, s.calls(lo, end + 1, CHAIN), "Calls")
            else:
                self.sink.symbol(name, "Variable", s.line(i), s.last_line(last), None, parent)
        return max(k, i + 1)

    def function_value(self, k: int, hi: int) -> tuple[int, int] | None:
        """(first token of the body, last) of the function or arrow function at k; None for any other value."""
        s = self.s
        if s.text(k) == "async":
            k += 1
        if s.text(k) == "function":
            while k < hi and s.text(k) != "(":
                k += 1
            k = s.close(k) + 1
            if s.text(k) == ":":
                k = self.annotation(k, hi)
            return (k, s.close(k)) if s.text(k) == "{" else None
        if s.text(k) == "<":
            k = s.angle(k, hi)
        if s.text(k) == "(":
            k = s.close(k) + 1
            if s.text(k) == ":":
                k = self.annotation(k, hi)
        elif s.is_name(k):
            k += 1
        if s.text(k) != "=>":
            return None
        k += 1
        if s.text(k) == "{":
            return k, s.close(k)
        end = k
        while end < hi and s.text(end) not in (",", ";", ")", "}"):
            end = s.close(end) if s.text(end) in ("(", "[", "{") and s.kind(end) == "punct" else end
            if end + 1 < hi and self.end(end, end + 2) == end:
                return k, end
            end += 1
        return k, end - 1

    def interface(self, i: int, hi: int, parent: str | None) -> int:
        s, k = self.s, i + 2
        if s.text(k) == "<":
            k = s.angle(k, hi)
        head = k
        while k < hi and s.text(k) != "{":
            k = s.angle(k, hi) if s.text(k) == "<" else k + 1
        end = s.close(k)
        if self.sink.symbol(s.text(i + 1), "Interface", s.line(i), s.last_line(end), None, parent):
            self.sink.edges(s.text(i + 1), self.bases(head, k), "Inherits")
        return end + 1

    def enum(self, first: int, i: int, hi: int, parent: str | None) -> int:
        s = self.s
        k = s.until(i, hi, {"{"})
        end = s.close(k) if k < hi else hi - 1
        self.sink.symbol(s.text(i + 1), "Enum", s.line(first), s.last_line(end), None, parent)
        return end + 1


def extract_javascript(text: str, sink: Sink) -> None:
    p = _Parser(text, sink, typed=False)
    p.statements(0, p.s.n, None)


def extract_typescript(text: str, sink: Sink) -> None:
    p = _Parser(text, sink, typed=True)
    p.statements(0, p.s.n, None)
