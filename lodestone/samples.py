"""Small sources in every language, one for each construct that the extractors know: a table to run them over.

A sample's name says language and construct; its file is named after it, with the language's extension.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.functions.model import language_of_path

SAMPLES: dict[str, tuple[str, str]] = {}


def _sample(name: str, end: str, text: str) -> None:
    SAMPLES[name] = (f"{name}.{end}", text)


# C
_sample("c_function", "c", """static Node *make(Tree *t, const Node *n, int k) {
  grow(t);
  t->visit(n);
  grow(t);
  return 0;
}
""")
_sample("c_struct", "c", """struct Point {
  int x;
};
union Value { int i; float f; };
struct { int q; } unnamed;
""")
_sample("c_enum", "c", """enum Color {
  RED,
  GREEN
};
enum { A, B };
""")
_sample("c_macro", "c", """#define LIMIT 10
#define MAX(a, b) ((a) > (b) ? (a) : (b))
int x;
""")
_sample("c_include", "c", """#include <stdio.h>
#include "dir/own.h"
int x;
""")
_sample("c_typedef", "c", """typedef unsigned long Size;
typedef struct Pair { int a, b; } Pair_t;
typedef int (*Handler)(int);
""")
_sample("c_declaration", "c", """int twice(int x);
static const int a = 1, *b = 0, c[3];
extern Node *root;
""")
_sample("c_declarator_name", "c", """int *(*table[4]);
char **argv;
int (*pick(int k))(void) { return 0; }
""")
_sample("c_prototype_or_variable", "c", """void run(void);
void (*hook)(void);
Node *next(Node *n);
""")
_sample("cpp_scope_class", "cpp", """void Tree::grow(int n) { }
int ns::Leaf::size() { return 0; }
template <typename T> void Box<T>::put(T t) { }
""")
_sample("c_type_names", "c", """Map *build(Key *k, Item *i, Key *again, int n) { return 0; }
""")
_sample("cpp_call_targets", "cpp", """void f(Q *q) {
  zeta();
  q->run(alpha(1));
  ns::call(3);
  q->run(2);
}
""")

# C++
_sample("cpp_class", "cpp", """class Foo final : public Base, private ns::Other {
public:
  int get() const { return x_; }
  int x_;
};
template <> class Box<int> { };
""")
_sample("cpp_namespace", "cpp", """namespace a {
int one() { return 1; }
}
namespace b::c { int two; }
namespace { int three; }
""")
_sample("cpp_concept", "cpp", """template <typename T>
concept Addable = requires(T t) { t + t; };
""")
_sample("cpp_alias", "cpp", """class Outer {
  using Inner = std::vector<int>;
};
using Vec = std::vector<long>;
""")
_sample("cpp_template", "cpp", """template <typename T, int N>
struct Array { };
template <typename T> T first(T t) { return use(t); }
""")

# Python
_sample("python_function", "py", """def area(w: int, h: int) -> "Size":
    def inner():
        pass
    return mul(w, scale(h))
async def wait(x): return await get(x)
""")
_sample("python_class", "py", """class Shape(Base, geo.Solid, metaclass=Meta):
    def side(self):
        return self.n
class Plain:
    pass
""")
_sample("python_import", "py", """import os
import sys as system, json.decoder
""")
_sample("python_import_from", "py", """from pkg.mod import x, y as z
from . import a, b as c
from ..up import d
""")
_sample("python_decorated", "py", """@cached(1)
def f():
    return g()
class C:
    @property
    def p(self):
        return 1
""")
_sample("python_assignment", "py", """X = 1
Y: int = 2
__all__ = ["X"]
a.b = 3
(p, q) = 1, 2
if X:
    Z = 4
class C:
    field = 5
""")
_sample("python_calls", "py", """def f(x):
    a.b.c(one(x), two(x))
    one(x)
    x[0](1)
""")

# Java
_sample("java_class", "java", """public class Foo<T> extends Base<T> implements I1, p.I2<String> {
  int n;
}
record Point(int x, int y) implements P { }
""")
_sample("java_interface", "java", """public interface Shape extends A, B<C> {
  double area();
}
""")
_sample("java_enum", "java", """enum Color implements Named {
  RED, GREEN;
  int code;
}
""")
_sample("java_method", "java", """class K {
  K(int n) { super(n); init(n); }
  List<Out> get(final In q, String... rest) {
    return new Thing(q.call()).done();
  }
  abstract void nothing();
}
""")
_sample("java_field", "java", """class K {
  private final Map<String, Bar> m = make(), n;
  static int count = 0;
}
""")
_sample("java_import", "java", """import java.util.List;
import static org.a.B.c;
import java.io.*;
class K { }
""")
_sample("java_annotation_type", "java", """class K {
  @interface Note { String value(); }
}
@interface Top { }
""")
_sample("java_calls", "java", """class K {
  void f(Map<Key, Val> m) { a(b(1)); this.c().d(); new E(g()); a(2); }
}
""")

# JavaScript and TypeScript
_sample("js_function", "js", """function add(a, b) {
  return plus(a, neg(b));
}
async function* gen() { yield add(1) }
""")
_sample("js_class", "js", """class App extends React.Component {
  render() { return draw() }
}
class Plain { }
class Sub extends Plain { }
""")
_sample("js_method", "js", """class Q {
  constructor(x) { super(x) }
  static of(x) { return new Q(wrap(x)) }
  [computed]() { }
  get size() { return this.count() }
}
""")
_sample("js_variable", "js", """const add = (a, b) => plus(a, b)
let z = 3, f = function () { go() }
const { x, y } = obj
var w
""")
_sample("js_import", "js", """import React from 'react'
import { a as b } from "./dir/mod.js"
import './side'
const fs = require('fs')
""")
_sample("js_export", "js", """export const one = 1
export default class Two { }
export function three() { }
""")
_sample("ts_interface", "ts", """export interface Shape extends A, B<C> {
  area(): number
}
""")
_sample("ts_enum", "ts", """enum Color { Red, Green }
const enum Flag {
  On = 1
}
""")
_sample("ts_type_alias", "ts", """type Id = string | number
export type Box<T> = { value: T }
""")
_sample("ts_calls", "tsx", """class P {
  m(x: Map<string, number>): Promise<void> { a.b(c()); go(); a.b() }
}
""")

# Rust
_sample("rust_function", "rs", """pub fn make(a: &Bar, n: usize, v: Vec<Item>) -> Option<Foo> {
    let x = a.get(n);
    println!("{}", hidden(x));
    b::c::build(x)
}
""")
_sample("rust_struct", "rs", """pub struct Foo<'a, T> {
    x: &'a T,
}
struct Unit;
struct Pair(i32, i32);
""")
_sample("rust_enum", "rs", """enum Shape {
    Dot,
    Line(u8),
}
""")
_sample("rust_trait", "rs", """pub trait Draw: Display + Clone {
    fn area(&self) -> f64;
    fn twice(&self) -> f64 { self.area() }
}
""")
_sample("rust_impl", "rs", """impl Foo {
    fn one(&self) -> Bar { two() }
}
impl<T> Draw for Boxed<T> {
    const K: u8 = 1;
}
""")
_sample("rust_mod", "rs", """mod inner {
    pub fn f() { g() }
}
mod other;
""")
_sample("rust_use", "rs", """use std::{io, fmt::Display};
pub use crate::a::b as c;
""")
_sample("rust_type_alias", "rs", """type Pairs = Vec<(u8, u8)>;
impl Iterator for It {
    type Item = u8;
}
""")
_sample("rust_const", "rs", """pub const MAX: usize = 3;
impl Foo {
    const N: u8 = 1;
}
""")
_sample("rust_static", "rs", """static mut COUNT: u32 = 0;
pub static NAME: &str = "n";
""")
_sample("rust_macro", "rs", """macro_rules! twice {
    ($x:expr) => { $x * 2 };
}
""")
_sample("rust_calls", "rs", """fn f(x: Q) {
    a(b(1));
    x.c::<u8>(2);
    m!(not_called(3));
    d::e(4);
}
""")

# Go
_sample("go_function", "go", """package main
func Make(a Bar, b *Baz, n int) (Qux, error) {
	return build(a), fmt.Errorf("x")
}
""")
_sample("go_method", "go", """package main
func (s *Stack) Push(v Item) Stack { s.grow(v); return own(s) }
func (s Stack) Len() int { return len(s.items) }
""")
_sample("go_type", "go", """package main
type Foo struct {
	Base
	*Ptr
	pkg.Q
	a, b int
}
type Reader interface {
	Closer
	Read(p []byte) int
}
type Names = map[string]int
""")
_sample("go_import", "go", """package main
import "os"
import (
	"fmt"
	m "math/rand"
)
""")
_sample("go_const", "go", """package main
const Pi = 3
const (
	X = iota
	Y
)
""")
_sample("go_var", "go", """package main
var p, q int = 1, 2
var (
	r = 1
	s string
)
""")
_sample("go_calls", "go", """package main
func f(x T) {
	a(b(1))
	x.c.d(2)
	a(3)
}
""")

# C#
_sample("cs_class", "cs", """public sealed class Foo<T> : Base<T>, I.J where T : new() {
  int n;
}
record Point(int X, int Y);
""")
_sample("cs_struct", "cs", """struct Inner : IInner {
  public int v;
}
""")
_sample("cs_interface", "cs", """interface IShape : IBase, IDisposable {
  double Area();
}
""")
_sample("cs_enum", "cs", """enum Color : byte {
  Red, Green
}
""")
_sample("cs_method", "cs", """class K {
  public K(int n) : base(n) { Init(n); }
  public Task<Out> Run(Bar b, int n) { Go(b).Then(n); return null; }
  abstract void Nothing();
}
""")
_sample("cs_property", "cs", """class K {
  public int Size { get; set; } = 3;
  string Name => Make();
}
""")
_sample("cs_namespace", "cs", """namespace My.Space {
  class A { }
}
""")
_sample("cs_using", "cs", """using System;
using System.Text;
class K { }
""")
_sample("cs_field", "cs", """class K {
  private readonly int a = 1, b;
  static Foo f;
}
""")
_sample("cs_event", "cs", """class K {
  public event EventHandler Changed, Other;
}
""")
_sample("cs_calls", "cs", """class K {
  ns.Out F(List<In> x) { a(b(1)); this.c().d(); new E(g()); a(2); }
}
""")


def sample_files(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """file_ord, file_path, lang, content of the samples, all in order by default."""
    chosen = [SAMPLES[n] for n in (names or SAMPLES)]
    rows = [(i, path, language_of_path(path), bytearray(text.encode())) for i, (path, text) in enumerate(chosen)]
    return spark.createDataFrame(rows, "file_ord long, file_path string, lang string, content binary")
