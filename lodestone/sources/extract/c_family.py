"""C and C++."""

from __future__ import annotations

import re

from lodestone.sources.extract.base import MOST_ITEMS, Sink, Source, trimmed
from lodestone.sources.extract.lex import C

# Words of the languages that name no user type, and words that a bracket may follow without a call.
PRIMITIVE = frozenset(
    "void bool char short int long float double signed unsigned auto const constexpr consteval constinit volatile static extern inline register mutable thread_local virtual explicit friend typename class struct union "
    "enum size_t ssize_t ptrdiff_t intptr_t uintptr_t int8_t int16_t int32_t int64_t uint8_t uint16_t uint32_t uint64_t char8_t char16_t char32_t wchar_t nullptr_t _Bool restrict _Noreturn noexcept override final "
    "decltype operator template using typedef namespace public private protected requires concept const_cast static_cast max_align_t".split()
)
NOT_CALLED = frozenset("if for while switch return sizeof alignof alignas decltype catch throw new delete noexcept typeid static_assert _Static_assert defined __attribute__ __declspec asm typeof static_cast dynamic_cast const_cast reinterpret_cast else do case co_await co_return co_yield and or not".split())
RECORDS = ("class", "struct", "union")


class _Parser:
    def __init__(self, text: str, sink: Sink, cpp: bool):
        self.s, self.sink, self.cpp = Source(text, C, NOT_CALLED), sink, cpp

    def scope(self, lo: int, hi: int, parent: str | None, in_class: bool = False) -> None:
        s, i = self.s, lo
        while i < hi:
            x = s.text(i)
            if s.kind(i) == "directive":
                self.directive(i)
                i += 1
            elif x in (";", "}", ")", "]") and s.kind(i) == "punct":
                i += 1
            elif x in ("public", "private", "protected") and s.text(i + 1) == ":":
                i += 2
            elif self.cpp and x == "template":
                i = s.angle(i + 1, hi) if s.text(i + 1) == "<" else i + 1
                if s.text(i) == "requires":
                    i = self.requires(i + 1, hi)
            elif self.cpp and (x == "namespace" or (x == "inline" and s.text(i + 1) == "namespace")):
                i = self.namespace(i, hi)
            elif self.cpp and x == "concept":
                end = s.until(i, hi, {";"})
                self.sink.symbol(s.text(i + 1), "Concept", s.line(i), s.last_line(end))
                i = end + 1
            elif self.cpp and x == "using":
                end = s.until(i, hi, {";"})
                if s.text(i + 2) == "=" or (s.text(i + 2) == "[" and "=" in [s.text(k) for k in range(i, end)]):
                    self.sink.symbol(s.text(i + 1), "Alias", s.line(i), s.last_line(end))
                i = end + 1
            elif x == "extern" and s.kind(i + 1) == "string":
                i += 2
                if s.text(i) == "{":
                    self.scope(i + 1, s.close(i), parent, in_class)
                    i = s.close(i) + 1
            elif x == "typedef":
                i = self.typedef(i, hi, parent)
            elif x == "{":
                self.scope(i + 1, s.close(i), parent, in_class)
                i = s.close(i) + 1
            else:
                i = self.declaration(i, hi, parent, in_class)

    def requires(self, i: int, hi: int) -> int:
        s = self.s
        while i < hi:
            if s.text(i) in ("(", "{"):
                i = s.close(i) + 1
            elif s.is_name(i):
                i += 1
                if s.text(i) == "<":
                    i = s.angle(i, hi)
            elif s.text(i) == "::":
                i += 1
                continue
            else:
                i += 1
                continue
            if s.text(i) not in ("&&", "||", "::", "(", "{"):
                return i
        return hi

    def directive(self, i: int) -> None:
        t = self.s.t[i]
        end = t.line + t.text.count("\n")
        if m := re.match(r"#\s*define\s+([A-Za-z_]\w*)", t.text):
            self.sink.symbol(m[1], "Macro", t.line, end)
        elif m := re.match(r"#\s*include(?:_next)?\s*(\"[^\"\n]*\"|<[^>\n]*>)", t.text):
            if len(m[1]) >= 3:
                self.sink.include(m[1][1:-1], t.line, end)

    def namespace(self, i: int, hi: int) -> int:
        s, first = self.s, i
        i += 2 if s.text(i) == "inline" else 1
        name = ""
        while i < hi and s.text(i) not in ("{", "=", ";"):
            if s.is_name(i):
                name = s.text(i)
            i = s.close(i) + 1 if s.text(i) in ("[", "(") else i + 1
        end = s.close(i) if s.text(i) == "{" else s.until(i, hi, {";"})
        self.sink.symbol(name, "Namespace", s.line(first), s.last_line(end))
        if s.text(i) == "{":
            self.scope(i + 1, end, None)
        return end + 1

    def typedef(self, i: int, hi: int, parent: str | None) -> int:
        s = self.s
        end = s.until(i, hi, {";"})
        pointers = [k for k in range(i, end) if s.text(k) == "(" and s.text(k + 1) in ("*", "^", "&")]
        name = ""
        if pointers:
            name = next((s.text(k) for k in range(pointers[0], s.close(pointers[0], end)) if s.is_name(k)), "")
        else:
            k = end - 1
            while k > i and s.text(k) in ("]", ")") and k in s.match:
                k = s.match[k] - 1
            name = s.text(k) if s.is_name(k) else ""
        self.sink.symbol(name, "Alias", s.line(i), s.last_line(end), None, parent, member=False)
        k = i + 1
        while s.text(k) in ("const", "volatile"):
            k += 1
        if s.text(k) in (*RECORDS, "enum"):
            self.specifier(k, end, parent)
        return end + 1

    def types(self, lo: int, hi: int) -> list[str]:
        """Names of user types in a range: names that aren't a scope, a primitive or a value."""
        s = self.s
        return sorted({s.text(k) for k in range(lo, hi) if s.is_name(k) and s.text(k) not in PRIMITIVE and s.text(k + 1) != "::"})

    def bases(self, lo: int, hi: int) -> list[str]:
        s, out = self.s, []
        for a, b in s.items(lo, hi):
            while a < b and s.text(a) in ("public", "private", "protected", "virtual"):
                a += 1
            stop = s.until(a, b, {"<"})
            name = s.slice(a, stop)
            out.append(name.rsplit("::", 1)[-1].strip() if stop < b else name)  # of a template only its bare name
        return out[:MOST_ITEMS]

    def specifier(self, i: int, hi: int, parent: str | None) -> int:
        """A class, struct, union or enum with a body: its rows, and the place after the body; i if it has none."""
        s, word, first = self.s, self.s.text(i), i
        k = i + 1
        if word == "enum" and s.text(k) in ("class", "struct"):
            k += 1
        while s.text(k) == "[" or s.text(k) in ("__attribute__", "__declspec", "alignas"):
            k = s.close(k) + 1 if s.text(k) == "[" else s.close(k + 1) + 1
        names = []
        while k < hi and (s.is_name(k) or s.text(k) in ("::", "<")):
            if s.text(k) == "<":
                k = s.angle(k, hi)
                continue
            if s.is_name(k) and s.text(k) != "final":
                names.append(k)
            k += 1
        base_lo = base_hi = k
        if s.text(k) == ":":
            base_lo = k + 1
            base_hi = k = s.until(k, hi, {"{", ";"}, True)
        name = s.text(names[-1]) if names else ""
        if s.text(k) == ";" and k == i + 2 and word != "enum":  # told of, without a body
            self.sink.symbol(name, "Class" if word == "class" else "Struct", s.line(first), s.last_line(k - 1), None, parent, member=False)
            return k
        if s.text(k) != "{":
            return i
        end = s.close(k)
        if word == "enum":
            self.sink.symbol(name, "Enum", s.line(first), s.last_line(end), None, parent)
            return end + 1
        kind = "Class" if word == "class" else "Struct"
        if self.sink.symbol(name, kind, s.line(first), s.last_line(end), None, parent, member=False):
            self.sink.edges(name, self.bases(base_lo, base_hi), "Inherits")
        self.scope(k + 1, end, name or parent, in_class=True)
        return end + 1

    def declaration(self, i: int, hi: int, parent: str | None, in_class: bool) -> int:
        s, first, k = self.s, i, i
        bracket, equals, pointed = -1, -1, -1  # the parameters' bracket; the first sign of a value; the bracket of (*name)
        body, typed = -1, i  # typed: after a record or enum that is the type
        while k < hi:
            x = s.text(k)
            if s.kind(k) == "directive":
                self.directive(k)
                k += 1
                continue
            if x == ";":
                break
            if x in (*RECORDS, "enum") and equals < 0 and bracket < 0:
                after = self.specifier(k, hi, parent)
                if after != k:
                    if s.text(after) == ";" or after >= hi:
                        return after + 1
                    k = typed = after
                    continue
            if x == "operator" and s.is_name(k):
                k += 1
                if s.text(k) == "(":
                    k += 2
                while k < hi and s.text(k) not in ("(", ";", "{"):
                    k += 1
                continue
            if x == "<" and s.is_name(k - 1) and equals < 0:
                k = s.angle(k, hi)
                continue
            if x == "=" and equals < 0:
                equals = k
            if x == "(":
                callee = s.text(k - 1)
                named = (s.is_name(k - 1) and callee not in ("__attribute__", "__declspec", "alignas", "decltype", "noexcept", "throw", "requires")) or callee == ">" or any(s.text(b) == "operator" for b in range(max(first, k - 4), k))
                if bracket < 0 and equals < 0 and k > first and s.text(k + 1) in ("*", "&", "^") and s.text(s.close(k) + 1) == "(":
                    pointed, bracket = k, s.close(k) + 1
                elif bracket < 0 and equals < 0 and named:
                    bracket = k
                k = s.close(k) + 1
                continue
            if x == "[":
                k = s.close(k) + 1
                continue
            if x == ":" and bracket >= 0 and equals < 0:  # the members' values of a constructor
                k += 1
                while k < hi and s.text(k) not in ("{", ";"):
                    if s.text(k) == "<":
                        k = s.angle(k, hi)
                    elif s.text(k) == "(":
                        k = s.close(k) + 1
                    else:
                        k += 1
                        if s.text(k) == "{" and s.is_name(k - 1):
                            k = s.close(k) + 1
                continue
            if x == "{":
                if bracket >= 0 and equals < 0:
                    body = k
                    break
                k = s.close(k) + 1
                continue
            if x == "}":
                return k + 1
            k += 1
        if body >= 0:
            end = s.close(body)
            self.function(first, bracket, body, end, parent, pointed)
            return end + 1
        if in_class:
            return k + 1  # members without a body have no rows
        self.plain(first, bracket, equals, min(k, hi), parent, pointed, typed)
        return k + 1

    def name_before(self, first: int, bracket: int) -> tuple[str, str, int]:
        """Name, scope and the place where the declarator begins, of what the bracket at hand belongs to."""
        s, k = self.s, bracket - 1
        op = next((b for b in range(bracket - 1, max(first, bracket - 5) - 1, -1) if s.text(b) == "operator"), -1)
        if op >= 0:
            name, k = "operator" + "".join(s.text(b) for b in range(op + 1, bracket)), op
        else:
            if s.text(k) == ">":
                depth = 0
                while k > first:
                    depth += {">": 1, "<": -1}.get(s.text(k), 0)
                    k -= 1
                    if not depth:
                        break
            name = s.text(k)
            if s.text(k - 1) == "~":
                name, k = "~" + name, k - 1
        scope = ""
        while s.text(k - 1) == "::" and k - 1 > first - 1:
            k -= 2
            if s.text(k) == ">":
                depth = 0
                while k > first:
                    depth += {">": 1, "<": -1}.get(s.text(k), 0)
                    k -= 1
                    if not depth:
                        break
            if not scope and s.is_name(k):
                scope = s.text(k)
            if k < first:
                break
        return name, scope, max(k, first)

    def declared(self, first: int, bracket: int, pointed: int) -> tuple[str, str, int]:
        """name_before(), or of a declarator like (*name)(…) the first name in its bracket."""
        if pointed < 0:
            return self.name_before(first, bracket)
        s = self.s
        return next((s.text(k) for k in range(pointed, s.close(pointed)) if s.is_name(k) and s.text(k) not in PRIMITIVE), ""), "", pointed

    def function(self, first: int, bracket: int, body: int, end: int, parent: str | None, pointed: int) -> None:
        s = self.s
        name, scope, begin = self.declared(first, bracket, pointed)
        owner = parent or scope or None
        if not self.sink.symbol(name, "Function", s.line(first), s.last_line(end), trimmed(s.source[s.t[first].start : s.t[body].start]), owner):
            return
        self.sink.edges(name, sorted(set(s.calls(body, end))), "Calls")
        close = s.close(bracket)
        returned = self.types(first, begin)
        arrow = next((k for k in range(close, body) if s.text(k) == "->"), -1)
        self.sink.edges(name, sorted({*returned, *(self.types(arrow, body) if arrow >= 0 else [])}), "Returns")
        self.sink.edges(name, self.parameter_types(bracket, close), "TypedAs")

    def parameter_types(self, bracket: int, close: int) -> list[str]:
        s, found = self.s, set()
        for a, b in s.items(bracket + 1, close):
            b = s.until(a, b, {"="})
            names = [k for k in range(a, b) if s.is_name(k) and s.text(k) not in PRIMITIVE and s.text(k + 1) != "::"]
            own = names
            if len(names) > 1 or any(s.text(k) in PRIMITIVE - {"const", "volatile", "struct", "class", "enum", "union", "typename"} for k in range(a, b)):
                last = names[-1] if names else -1
                if last >= 0 and s.text(last + 1) in (",", ")", "=", "[", "") and s.text(last - 1) != "::":
                    own = names[:-1]
            found.update(s.text(k) for k in own)
        return sorted(found)

    def plain(self, first: int, bracket: int, equals: int, end: int, parent: str | None, pointed: int = -1, typed: int = 0) -> None:
        """A declaration without a body: a prototype, or a variable for each declarator."""
        s = self.s
        if end <= first or s.text(first) in ("return", "goto", "friend", "static_assert", "_Static_assert", "asm"):
            return
        if bracket >= 0 and (equals < 0 or bracket < equals):
            name, scope, begin = self.declared(first, bracket, pointed)
            if begin > first or name.startswith("~") or scope:
                self.sink.symbol(name, "Function", s.line(first), s.last_line(end), trimmed(s.slice(first, end), ";"), parent or scope or None)
            return
        names = []
        for a, b in s.items(max(first, typed), end):
            b = s.until(a, b, {"=", "{", ":"}, True)
            k = b - 1
            while k > a and s.text(k) in ("]", ")") and k in s.match:
                inner = s.match[k]
                pointed = [x for x in range(inner, k) if s.is_name(x)] if s.text(k) == ")" and s.text(inner + 1) in ("*", "&", "^") else []
                if pointed:
                    k = pointed[0]
                    break
                k = inner - 1
            if s.is_name(k) and s.text(k) not in PRIMITIVE and (names or k > first):
                names.append(s.text(k))
        for name in names[:MOST_ITEMS]:
            self.sink.symbol(name, "Variable", s.line(first), s.last_line(end), None, parent)


def extract_c(text: str, sink: Sink) -> None:
    p = _Parser(text, sink, cpp=False)
    p.scope(0, p.s.n, None)


def extract_cpp(text: str, sink: Sink) -> None:
    p = _Parser(text, sink, cpp=True)
    p.scope(0, p.s.n, None)
