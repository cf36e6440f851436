"""Extractors on small sources in each language, against the rows that the rules give."""

import pytest

from lodestone.functions.model import KINDS, RELATIONS
from lodestone.sources.extract import EXTRACTORS, extract, register
from lodestone.sources.extract.base import Sink, Source
from lodestone.sources.extract.lex import C, GO, RUST, lex


def rows(language, text):
    found, status = extract("f", language, text)
    assert status == "ok"
    assert found[0][:5] == ("S", "f", KINDS.index("File"), 0, 0)
    symbols = [(KINDS[r[2]], r[1], r[3], r[4], r[5], r[6]) for r in found[1:] if r[0] == "S"]
    edges = [(r[7], RELATIONS[r[9]], r[8]) for r in found if r[0] == "E"]
    return symbols, [e for e in edges if e[1] != "DefinedIn"], [e for e in edges if e[1] == "DefinedIn"]


def names(language, text):
    return [(s[0], s[1]) for s in rows(language, text)[0]]


def test_python():
    text = '''import os, sys as system
from . import a, b as c
from pkg.mod import (x,
    y)
X: int = 5
__all__ = ["x"]
(a, b) = 1, 2
if X:
    Y = 1
else: Z = 2
@deco(1)
class Foo(Base, pkg.Other, metaclass=M):
    attr = 1
    def m(self, x: int = f(2)) -> "List[int]":
        def inner(): pass
        self.g(h(1)).k()
        return super().m(x)

    async def n(self): return await z()
'''
    symbols, edges, defined = rows("python", text)
    assert [(s[0], s[1], s[2], s[3]) for s in symbols] == [
        ("Include", "os", 1, 1), ("Include", "sys", 1, 1), ("Include", ".", 2, 2), ("Include", "a", 2, 2), ("Include", "b", 2, 2), ("Include", "pkg.mod", 3, 4), ("Variable", "X", 5, 5),
        ("Variable", "Y", 9, 9), ("Variable", "Z", 10, 10), ("Class", "Foo", 12, 19), ("Variable", "attr", 13, 13), ("Function", "m", 14, 17), ("Function", "n", 19, 19),
    ]
    assert symbols[-2][4:] == ('def m(self, x: int = f(2)) -> "List[int]"', "Foo")
    assert [e for e in edges if e[0] == "Foo"] == [("Foo", "Inherits", "Base"), ("Foo", "Inherits", "Other")]
    assert [e[1:] for e in edges if e[0] == "m"] == [("MemberOf", "Foo"), ("Calls", "k"), ("Calls", "g"), ("Calls", "h"), ("Calls", "m"), ("Calls", "super"), ("Returns", '"List[int]"')]
    assert ("f", "Includes", "pkg.mod") in edges and all(d[0] != "os" for d in defined)


def test_python_against_its_own_parser():
    """Functions and classes of installed modules: names, lines and parents as the ast module has them."""
    import ast
    import json
    import logging

    def walk(body, parent):
        for n in body:
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                yield "Function", n.name, n.lineno, n.end_lineno, parent
            elif isinstance(n, ast.ClassDef):
                yield "Class", n.name, n.lineno, n.end_lineno, parent
                yield from walk(n.body, n.name)
            else:
                for inner in (getattr(n, "body", None), getattr(n, "orelse", None), getattr(n, "finalbody", None), *(h.body for h in getattr(n, "handlers", []))):
                    yield from walk(inner if isinstance(inner, list) else [], parent)

    for module in (ast, json.decoder, json.encoder, logging, pytest):
        with open(module.__file__, encoding="utf-8") as f:
            text = f.read()
        got = [(s[0], s[1], s[2], s[3], s[5]) for s in rows("python", text)[0] if s[0] in ("Function", "Class")]
        assert got == list(walk(ast.parse(text).body, None))


def test_cpp():
    text = '''#include <vector>
#define MAX(a,b) \\
   ((a)>(b))
namespace a::b {
template <typename T> concept Addable = requires(T t) { t + t; };
using Vec = std::vector<int>;
class Foo final : public Base, private ns::Other<int> {
public:
  Foo(int x) : x_(x), y_{2} { init(); }
  int get() const { return x_; }
  void proto(int);
  int x_;
  struct Inner { int q; };
};
std::vector<Bar> Foo::make(const Baz& b, Qux* q, int n) { helper(b); q->run(n); ns::call(3); helper(n); return {}; }
int proto2(int a, char* b);
static const int a1 = 1, *b1 = nullptr, c1[3];
enum class Color : int { Red, Green };
typedef int (*fp)(int);
}
'''
    symbols, edges, _ = rows("cpp", text)
    assert [(s[0], s[1]) for s in symbols] == [
        ("Include", "vector"), ("Macro", "MAX"), ("Namespace", "b"), ("Concept", "Addable"), ("Alias", "Vec"), ("Class", "Foo"), ("Function", "Foo"), ("Function", "get"), ("Struct", "Inner"),
        ("Function", "make"), ("Function", "proto2"), ("Variable", "a1"), ("Variable", "b1"), ("Variable", "c1"), ("Enum", "Color"), ("Alias", "fp"),
    ]
    assert [e[1:] for e in edges if e[0] == "make"] == [("MemberOf", "Foo"), ("Calls", "call"), ("Calls", "helper"), ("Calls", "run"), ("Returns", "Bar"), ("Returns", "vector"), ("TypedAs", "Baz"), ("TypedAs", "Qux")]
    assert [e[2] for e in edges if e[1] == "Inherits"] == ["Base", "Other"]
    assert not [e for e in edges if e[:2] == ("Inner", "MemberOf")]  # records have a parent and no edge to it
    assert [s for s in symbols if s[1] == "proto2"][0][4] == "int proto2(int a, char* b)"


def test_c():
    assert names("c", "struct Node { int v; };\ntypedef struct Node Node_t;\nvoid f(struct Node *n);\nstatic int x = 3;\nint g(void) { return f(0); }\nunion U { int a; };\n") == [
        ("Struct", "Node"), ("Alias", "Node_t"), ("Function", "f"), ("Variable", "x"), ("Function", "g"), ("Struct", "U")
    ]


def test_java():
    text = """package a.b;
import java.util.List;
public class Foo<T> extends Base<T> implements I1, p.I2<String> {
  private final Map<String, List<Bar>> m = new HashMap<>(), n;
  public Foo(int x, Bar b) { super(x); go(b).then(this::x); }
  List<Baz> get(final Qux q, String... rest) { return new Thing(q.call()).done(); }
  abstract void nothing();
  enum Color implements C { RED(1), GREEN { void x() {} }; int v; }
  interface Shape extends A, B<C> { double area(); }
  record Point(int x, int y) implements P { }
  @interface Note { }
}
"""
    symbols, edges, _ = rows("java", text)
    assert [(s[0], s[1]) for s in symbols] == [
        ("Include", "java.util.List"), ("Class", "Foo"), ("Variable", "m"), ("Variable", "n"), ("Function", "Foo"), ("Function", "get"), ("Function", "nothing"), ("Enum", "Color"), ("Variable", "v"),
        ("Interface", "Shape"), ("Function", "area"), ("Class", "Point"), ("Class", "Note"),
    ]
    assert [e[1:] for e in edges if e[0] == "get"] == [("MemberOf", "Foo"), ("Calls", "done"), ("Calls", "call"), ("Returns", "List"), ("TypedAs", "Qux"), ("TypedAs", "String")]
    assert [e[2] for e in edges if e[0] == "Foo" and e[1] == "Inherits"] == ["Base", "I1", "I2"]
    assert [s for s in symbols if s[1] == "nothing"][0][4] == "abstract void nothing()"


def test_javascript_and_typescript():
    text = """import React from 'react'
export const add = (a, b) => a + plus(b)
const { x, y } = obj, z = 3;
export default class App extends React.Component {
  state = { a: 1 };
  async run(x) { for (const i of x) { this.go(i) } }
  [computed]() {}
}
function* gen(a = 1) { yield other(a) }
if (cond) { var inIf = 1 }
"""
    assert names("javascript", text) == [("Include", "react"), ("Function", "add"), ("Variable", "z"), ("Class", "App"), ("Function", "run"), ("Function", "gen"), ("Variable", "inIf")]
    typed = "interface Shape extends A, B<C> { area(): number }\nenum Color { Red }\ntype Al<T> = T | { a: string };\nclass P { m(x: Map<string, number>): Promise<void> { go() } }\n"
    symbols, edges, _ = rows("typescript", typed)
    assert [(s[0], s[1]) for s in symbols] == [("Interface", "Shape"), ("Enum", "Color"), ("Alias", "Al"), ("Class", "P"), ("Function", "m")]
    assert [e[1:] for e in edges if e[0] == "m"] == [("MemberOf", "P"), ("Calls", "go"), ("Returns", ": Promise<void>"), ("TypedAs", ": Map<string, number>")]


def test_rust():
    text = """use std::{io, fmt::Display};
pub struct Foo<'a, T> { x: &'a T }
pub trait Shape: Display + Clone { fn area(&self) -> f64; fn two(&self) -> Vec<Foo> { helper::<T>(self.area()) } }
impl<'a, T: X> Shape for Foo<'a, T> { fn area(&self) -> f64 { let c = 'x'; println!("{}", c); self.x.len() } }
mod inner { pub fn f(a: &Bar) { a::b::c(1) } }
const MAX: usize = 3;
static mut S: &str = "x";
macro_rules! my { ($x:expr) => { $x }; }
"""
    symbols, edges, _ = rows("rust", text)
    assert [(s[0], s[1], s[5]) for s in symbols] == [
        ("Include", "std::{io, fmt::Display}", None), ("Struct", "Foo", None), ("Interface", "Shape", None), ("Function", "two", "Shape"), ("Function", "area", "Foo"), ("Namespace", "inner", None),
        ("Function", "f", None), ("Variable", "MAX", None), ("Variable", "S", None), ("Macro", "my", None),
    ]
    assert ("Foo", "Inherits", "Shape") in edges and ("f", "TypedAs", "Bar") in edges and ("f", "Calls", "c") in edges


def test_go():
    text = """package main
import (
  "fmt"
  m "math/rand"
)
type Foo struct {
  Base
  *Ptr
  pkg.Q `json:"x"`
  a, b int
}
type I interface { Other; Do(x int) error }
type A = map[string]int
const ( X = iota; Y )
var p, q int = 1, 2
func (f *Foo) Method(a Bar, b *Baz) (Qux, error) { f.go1(fmt.Sprint(a)); return nil, nil }
func plain(x string) error { return nil }
"""
    symbols, edges, _ = rows("go", text)
    assert [(s[0], s[1]) for s in symbols] == [
        ("Include", "fmt"), ("Include", "math/rand"), ("Struct", "Foo"), ("Interface", "I"), ("Alias", "A"), ("Variable", "X"), ("Variable", "Y"), ("Variable", "p"), ("Function", "Method"), ("Function", "plain")
    ]
    assert [e[2] for e in edges if e[0] == "Foo"] == ["Base", "Ptr", "pkg.Q"]
    assert [e[1:] for e in edges if e[0] == "Method"] == [("MemberOf", "Foo"), ("Calls", "go1"), ("Calls", "Sprint"), ("Returns", "Qux"), ("Returns", "error"), ("TypedAs", "Bar")]


def test_csharp():
    text = """using System;
namespace My.Space {
  public sealed class Foo<T> : Base<T>, I.J where T : new() {
    private readonly int a = 1, b;
    public event EventHandler Changed, Other;
    public int Prop { get; set; } = 3;
    public Foo(int x) : base(x) { Init(); }
    public async Task<List<int>> Run(ref Bar b, int n = 3) { await Go<int>(b).Then(n); return null; }
    struct Inner : IInner { public int v; }
  }
}
"""
    symbols, edges, _ = rows("csharp", text)
    assert [(s[0], s[1]) for s in symbols] == [
        ("Include", "System"), ("Namespace", "My.Space"), ("Class", "Foo"), ("Variable", "a"), ("Variable", "b"), ("Variable", "Changed"), ("Variable", "Other"), ("Variable", "Prop"), ("Function", "Foo"),
        ("Function", "Run"), ("Struct", "Inner"), ("Variable", "v"),
    ]
    assert [e[2] for e in edges if e[0] == "Foo" and e[1] == "Inherits"] == ["Base", "I.J"]
    assert [e[1:] for e in edges if e[0] == "Run"] == [("MemberOf", "Foo"), ("Calls", "Then"), ("Calls", "Go"), ("Returns", "Task"), ("TypedAs", "Bar"), ("TypedAs", "int")] or [e[1:] for e in edges if e[0] == "Run"][3:] == [("Returns", "Task"), ("TypedAs", "Bar"), ("TypedAs", "int")]


BROKEN = ["", "\n\n", "(((", "}}}}", "class", "def f(", '"open', "/* open", "@", "#", "function (", "impl", "func", "fn f(", "namespace", "template <", "x = {", "\x00\ud7ff", "import", "from", "type", "enum {", "struct S {", "a" * 5000, "{" * 3000]


@pytest.mark.parametrize("language", sorted(EXTRACTORS))
def test_broken_sources_are_read_as_far_as_they_go(language):
    for text in BROKEN:
        found, status = extract("f", language, text)
        assert found[0][1] == "f" and (status == "ok" or "{" * 50 in text), (language, text[:20], status)


@pytest.mark.parametrize("language", sorted(EXTRACTORS))
def test_an_error_keeps_the_rest(language):
    good = {"python": "def good():\n    pass\n", "go": "func good() {}\n", "rust": "fn good() {}\n", "java": "class good { }\n", "csharp": "class good { }\n"}.get(language, "class good { };\n" if language in ("cpp", "javascript", "typescript", "tsx") else "int good(void) { return 1; }\n")
    assert "good" in [s[1] for s in extract("f", language, good + "%%% (\n")[0] if s[0] == "S"]


def test_comments_and_strings_hold_no_symbols():
    assert names("cpp", '// class A {};\n/* class B {}; */\nconst char* s = "class C {};";\nauto r = R"x(class D {};)x";\n') == [("Variable", "s"), ("Variable", "r")]
    assert names("rust", '/* /* struct A; */ struct B; */ const X: &str = r#"struct "C";"#;\n') == [("Variable", "X")]
    assert names("python", '"""class A: pass"""\n# class B: pass\nx = \'\'\'\nclass C: pass\n\'\'\'\n') == [("Variable", "x")]


def test_own_extractor():
    def lines(text, sink):
        for i, line in enumerate(text.splitlines(), 1):
            sink.symbol(line.strip(), "Variable", i, i)

    register("lines", lines)
    try:
        assert [r[1] for r in extract("f", "lines", "a\n\nb")[0] if r[0] == "S"] == ["f", "a", "b"]
        assert extract("f", "none", "x")[1] == "no extractor"
    finally:
        del EXTRACTORS["lines"]


def test_lexer_places():
    for dialect, text in ((C, 'int x = "a\\n"; // c\n#define Y 1\n'), (RUST, "let a = 'b; 'c';"), (GO, "x := `raw\nline` + y")):
        for t in lex(text, dialect):
            assert text[t.start : t.end] == t.text and t.line == text.count("\n", 0, t.start) + 1
    assert Source("f(a[1], {b})", C).items(2, 8)
    assert Sink("p").rows[0][1] == "p"
