"""What each sample's extraction should give by the rules, as SQL VALUES.

The rows were written with the extractors' output at hand, each held against the rules and changed where they differ.

A line is a row, in order of emission: a symbol as kind|name|first line|last line|signature|parent, an edge as
source|relation|target with a leading '>'. @ stands for the file. The file's own symbol comes first in every sample.
"""

from __future__ import annotations

from lodestone.samples import SAMPLES

EXPECTED: dict[str, str] = {}

EXPECTED["c_function"] = """
Function|make|1|6|static Node *make(Tree *t, const Node *n, int k)|
>make|DefinedIn|@
>make|Calls|grow
>make|Calls|visit
>make|Returns|Node
>make|TypedAs|Node
>make|TypedAs|Tree
"""
EXPECTED["c_struct"] = """
Struct|Point|1|3||
>Point|DefinedIn|@
Struct|Value|4|4||
>Value|DefinedIn|@
Variable|unnamed|5|5||
>unnamed|DefinedIn|@
"""
EXPECTED["c_enum"] = """
Enum|Color|1|4||
>Color|DefinedIn|@
"""
EXPECTED["c_macro"] = """
Macro|LIMIT|1|1||
>LIMIT|DefinedIn|@
Macro|MAX|2|2||
>MAX|DefinedIn|@
Variable|x|3|3||
>x|DefinedIn|@
"""
EXPECTED["c_include"] = """
Include|stdio.h|1|1||
>@|Includes|stdio.h
Include|dir/own.h|2|2||
>@|Includes|dir/own.h
Variable|x|3|3||
>x|DefinedIn|@
"""
EXPECTED["c_typedef"] = """
Alias|Size|1|1||
>Size|DefinedIn|@
Alias|Pair_t|2|2||
>Pair_t|DefinedIn|@
Struct|Pair|2|2||
>Pair|DefinedIn|@
Alias|Handler|3|3||
>Handler|DefinedIn|@
"""
EXPECTED["c_declaration"] = """
Function|twice|1|1|int twice(int x)|
>twice|DefinedIn|@
Variable|a|2|2||
>a|DefinedIn|@
Variable|b|2|2||
>b|DefinedIn|@
Variable|c|2|2||
>c|DefinedIn|@
Variable|root|3|3||
>root|DefinedIn|@
"""
EXPECTED["c_declarator_name"] = """
Variable|table|1|1||
>table|DefinedIn|@
Variable|argv|2|2||
>argv|DefinedIn|@
Function|pick|3|3|int (*pick(int k))(void)|
>pick|DefinedIn|@
"""
EXPECTED["c_prototype_or_variable"] = """
Function|run|1|1|void run(void)|
>run|DefinedIn|@
Function|hook|2|2|void (*hook)(void)|
>hook|DefinedIn|@
Function|next|3|3|Node *next(Node *n)|
>next|DefinedIn|@
"""
EXPECTED["cpp_scope_class"] = """
Function|grow|1|1|void Tree::grow(int n)|Tree
>grow|DefinedIn|@
>grow|MemberOf|Tree
Function|size|2|2|int ns::Leaf::size()|Leaf
>size|DefinedIn|@
>size|MemberOf|Leaf
Function|put|3|3|void Box<T>::put(T t)|Box
>put|DefinedIn|@
>put|MemberOf|Box
>put|TypedAs|T
"""
EXPECTED["c_type_names"] = """
Function|build|1|1|Map *build(Key *k, Item *i, Key *again, int n)|
>build|DefinedIn|@
>build|Returns|Map
>build|TypedAs|Item
>build|TypedAs|Key
"""
EXPECTED["cpp_call_targets"] = """
Function|f|1|6|void f(Q *q)|
>f|DefinedIn|@
>f|Calls|alpha
>f|Calls|call
>f|Calls|run
>f|Calls|zeta
>f|TypedAs|Q
"""
EXPECTED["cpp_class"] = """
Class|Foo|1|5||
>Foo|DefinedIn|@
>Foo|Inherits|Base
>Foo|Inherits|ns::Other
Function|get|3|3|int get() const|Foo
>get|DefinedIn|@
>get|MemberOf|Foo
Class|Box|6|6||
>Box|DefinedIn|@
"""
EXPECTED["cpp_namespace"] = """
Namespace|a|1|3||
>a|DefinedIn|@
Function|one|2|2|int one()|
>one|DefinedIn|@
Namespace|c|4|4||
>c|DefinedIn|@
Variable|two|4|4||
>two|DefinedIn|@
Variable|three|5|5||
>three|DefinedIn|@
"""
EXPECTED["cpp_concept"] = """
Concept|Addable|2|2||
>Addable|DefinedIn|@
"""
EXPECTED["cpp_alias"] = """
Class|Outer|1|3||
>Outer|DefinedIn|@
Alias|Inner|2|2||
>Inner|DefinedIn|@
Alias|Vec|4|4||
>Vec|DefinedIn|@
"""
EXPECTED["cpp_template"] = """
Struct|Array|2|2||
>Array|DefinedIn|@
Function|first|3|3|T first(T t)|
>first|DefinedIn|@
>first|Calls|use
>first|Returns|T
>first|TypedAs|T
"""
EXPECTED["python_function"] = """
Function|area|1|4|def area(w: int, h: int) -> "Size"|
>area|DefinedIn|@
>area|Calls|mul
>area|Calls|scale
>area|Returns|"Size"
Function|wait|5|5|async def wait(x)|
>wait|DefinedIn|@
>wait|Calls|get
"""
EXPECTED["python_class"] = """
Class|Shape|1|3||
>Shape|DefinedIn|@
>Shape|Inherits|Base
>Shape|Inherits|Solid
Function|side|2|3|def side(self)|Shape
>side|DefinedIn|@
>side|MemberOf|Shape
Class|Plain|4|5||
>Plain|DefinedIn|@
"""
EXPECTED["python_import"] = """
Include|os|1|1||
>@|Includes|os
Include|sys|2|2||
>@|Includes|sys
Include|json.decoder|2|2||
>@|Includes|json.decoder
"""
EXPECTED["python_import_from"] = """
Include|pkg.mod|1|1||
>@|Includes|pkg.mod
Include|.|2|2||
>@|Includes|.
Include|a|2|2||
>@|Includes|a
Include|b|2|2||
>@|Includes|b
Include|..up|3|3||
>@|Includes|..up
Include|d|3|3||
>@|Includes|d
"""
EXPECTED["python_decorated"] = """
Function|f|2|3|def f()|
>f|DefinedIn|@
>f|Calls|g
Class|C|4|7||
>C|DefinedIn|@
Function|p|6|7|def p(self)|C
>p|DefinedIn|@
>p|MemberOf|C
"""
EXPECTED["python_assignment"] = """
Variable|X|1|1||
>X|DefinedIn|@
Variable|Y|2|2||
>Y|DefinedIn|@
Variable|Z|7|7||
>Z|DefinedIn|@
Class|C|8|9||
>C|DefinedIn|@
Variable|field|9|9||C
>field|DefinedIn|@
>field|MemberOf|C
"""
EXPECTED["python_calls"] = """
Function|f|1|4|def f(x)|
>f|DefinedIn|@
>f|Calls|c
>f|Calls|one
>f|Calls|two
>f|Calls|one
"""
EXPECTED["java_class"] = """
Class|Foo|1|3|public class Foo<T> extends Base<T> implements I1, p.I2<String>|
>Foo|DefinedIn|@
>Foo|Inherits|Base
>Foo|Inherits|I1
>Foo|Inherits|I2
Variable|n|2|2||Foo
>n|DefinedIn|@
>n|MemberOf|Foo
Class|Point|4|4|record Point(int x, int y) implements P|
>Point|DefinedIn|@
>Point|Inherits|P
"""
EXPECTED["java_interface"] = """
Interface|Shape|1|3|public interface Shape extends A, B<C>|
>Shape|DefinedIn|@
>Shape|Inherits|A
>Shape|Inherits|B
Function|area|2|2|double area()|Shape
>area|DefinedIn|@
>area|MemberOf|Shape
"""
EXPECTED["java_enum"] = """
Enum|Color|1|4||
>Color|DefinedIn|@
>Color|Inherits|Named
Variable|code|3|3||Color
>code|DefinedIn|@
>code|MemberOf|Color
"""
EXPECTED["java_method"] = """
Class|K|1|7|class K|
>K|DefinedIn|@
Function|K|2|2|K(int n)|K
>K|DefinedIn|@
>K|MemberOf|K
>K|Calls|init
Function|get|3|5|List<Out> get(final In q, String... rest)|K
>get|DefinedIn|@
>get|MemberOf|K
>get|Calls|done
>get|Calls|call
>get|Returns|List
>get|TypedAs|In
>get|TypedAs|String
Function|nothing|6|6|abstract void nothing()|K
>nothing|DefinedIn|@
>nothing|MemberOf|K
"""
EXPECTED["java_field"] = """
Class|K|1|4|class K|
>K|DefinedIn|@
Variable|m|2|2||K
>m|DefinedIn|@
>m|MemberOf|K
Variable|n|2|2||K
>n|DefinedIn|@
>n|MemberOf|K
Variable|count|3|3||K
>count|DefinedIn|@
>count|MemberOf|K
"""
EXPECTED["java_import"] = """
Include|java.util.List|1|1||
>@|Includes|java.util.List
Include|org.a.B.c|2|2||
>@|Includes|org.a.B.c
Include|java.io|3|3||
>@|Includes|java.io
Class|K|4|4|class K|
>K|DefinedIn|@
"""
EXPECTED["java_annotation_type"] = """
Class|K|1|3|class K|
>K|DefinedIn|@
Class|Note|2|2||K
>Note|DefinedIn|@
>Note|MemberOf|K
Class|Top|4|4||
>Top|DefinedIn|@
"""
EXPECTED["java_calls"] = """
Class|K|1|3|class K|
>K|DefinedIn|@
Function|f|2|2|void f(Map<Key, Val> m)|K
>f|DefinedIn|@
>f|MemberOf|K
>f|Calls|a
>f|Calls|b
>f|Calls|d
>f|Calls|c
>f|Calls|g
>f|Calls|a
>f|TypedAs|Map
"""
EXPECTED["js_function"] = """
Function|add|1|3|function add(a, b)|
>add|DefinedIn|@
>add|Calls|plus
>add|Calls|neg
Function|gen|4|4|async function* gen()|
>gen|DefinedIn|@
>gen|Calls|add
"""
EXPECTED["js_class"] = """
Class|App|1|3||
>App|DefinedIn|@
>App|Inherits|Component
Function|render|2|2|render()|App
>render|DefinedIn|@
>render|MemberOf|App
>render|Calls|draw
Class|Plain|4|4||
>Plain|DefinedIn|@
Class|Sub|5|5||
>Sub|DefinedIn|@
>Sub|Inherits|Plain
"""
EXPECTED["js_method"] = """
Class|Q|1|6||
>Q|DefinedIn|@
Function|constructor|2|2|constructor(x)|Q
>constructor|DefinedIn|@
>constructor|MemberOf|Q
Function|of|3|3|static of(x)|Q
>of|DefinedIn|@
>of|MemberOf|Q
>of|Calls|wrap
Function|size|5|5|get size()|Q
>size|DefinedIn|@
>size|MemberOf|Q
>size|Calls|count
"""
EXPECTED["js_variable"] = """
Function|add|1|1|const add = (a, b) =>|
>add|DefinedIn|@
>add|Calls|plus
Variable|z|2|2||
>z|DefinedIn|@
Function|f|2|2|let z = 3, f = function ()|
>f|DefinedIn|@
>f|Calls|go
Variable|w|4|4||
>w|DefinedIn|@
"""
EXPECTED["js_import"] = """
Include|react|1|1||
>@|Includes|react
Include|./dir/mod.js|2|2||
>@|Includes|./dir/mod.js
Include|./side|3|3||
>@|Includes|./side
Variable|fs|4|4||
>fs|DefinedIn|@
"""
EXPECTED["js_export"] = """
Variable|one|1|1||
>one|DefinedIn|@
Class|Two|2|2||
>Two|DefinedIn|@
Function|three|3|3|function three()|
>three|DefinedIn|@
"""
EXPECTED["ts_interface"] = """
Interface|Shape|1|3||
>Shape|DefinedIn|@
>Shape|Inherits|A
>Shape|Inherits|B
"""
EXPECTED["ts_enum"] = """
Enum|Color|1|1||
>Color|DefinedIn|@
Enum|Flag|2|4||
>Flag|DefinedIn|@
"""
EXPECTED["ts_type_alias"] = """
Alias|Id|1|1||
>Id|DefinedIn|@
Alias|Box|2|2||
>Box|DefinedIn|@
"""
EXPECTED["ts_calls"] = """
Class|P|1|3||
>P|DefinedIn|@
Function|m|2|2|m(x: Map<string, number>): Promise<void>|P
>m|DefinedIn|@
>m|MemberOf|P
>m|Calls|b
>m|Calls|c
>m|Calls|go
>m|Calls|b
>m|Returns|: Promise<void>
>m|TypedAs|: Map<string, number>
"""
EXPECTED["rust_function"] = """
Function|make|1|5|pub fn make(a: &Bar, n: usize, v: Vec<Item>) -> Option<Foo>|
>make|DefinedIn|@
>make|Calls|get
>make|Calls|build
>make|Returns|Option
>make|TypedAs|Bar
>make|TypedAs|Vec
"""
EXPECTED["rust_struct"] = """
Struct|Foo|1|3||
>Foo|DefinedIn|@
Struct|Unit|4|4||
>Unit|DefinedIn|@
Struct|Pair|5|5||
>Pair|DefinedIn|@
"""
EXPECTED["rust_enum"] = """
Enum|Shape|1|4||
>Shape|DefinedIn|@
"""
EXPECTED["rust_trait"] = """
Interface|Draw|1|4||
>Draw|DefinedIn|@
>Draw|Inherits|Display
>Draw|Inherits|Clone
Function|twice|3|3|fn twice(&self) -> f64|Draw
>twice|DefinedIn|@
>twice|MemberOf|Draw
>twice|Calls|area
"""
EXPECTED["rust_impl"] = """
Function|one|2|2|fn one(&self) -> Bar|Foo
>one|DefinedIn|@
>one|MemberOf|Foo
>one|Calls|two
>one|Returns|Bar
>Boxed|Inherits|Draw
Variable|K|5|5||Boxed
>K|DefinedIn|@
>K|MemberOf|Boxed
"""
EXPECTED["rust_mod"] = """
Namespace|inner|1|3||
>inner|DefinedIn|@
Function|f|2|2|pub fn f()|
>f|DefinedIn|@
>f|Calls|g
Namespace|other|4|4||
>other|DefinedIn|@
"""
EXPECTED["rust_use"] = """
Include|std::{io, fmt::Display}|1|1||
>@|Includes|std::{io, fmt::Display}
Include|crate::a::b as c|2|2||
>@|Includes|crate::a::b as c
"""
EXPECTED["rust_type_alias"] = """
Alias|Pairs|1|1||
>Pairs|DefinedIn|@
>It|Inherits|Iterator
Alias|Item|3|3||It
>Item|DefinedIn|@
>Item|MemberOf|It
"""
EXPECTED["rust_const"] = """
Variable|MAX|1|1||
>MAX|DefinedIn|@
Variable|N|3|3||Foo
>N|DefinedIn|@
>N|MemberOf|Foo
"""
EXPECTED["rust_static"] = """
Variable|COUNT|1|1||
>COUNT|DefinedIn|@
Variable|NAME|2|2||
>NAME|DefinedIn|@
"""
EXPECTED["rust_macro"] = """
Macro|twice|1|3||
>twice|DefinedIn|@
"""
EXPECTED["rust_calls"] = """
Function|f|1|6|fn f(x: Q)|
>f|DefinedIn|@
>f|Calls|a
>f|Calls|b
>f|Calls|c
>f|Calls|e
>f|TypedAs|Q
"""
EXPECTED["go_function"] = """
Function|Make|2|4|func Make(a Bar, b *Baz, n int) (Qux, error)|
>Make|DefinedIn|@
>Make|Calls|build
>Make|Calls|Errorf
>Make|Returns|Qux
>Make|Returns|error
>Make|TypedAs|Bar
>Make|TypedAs|int
"""
EXPECTED["go_method"] = """
Function|Push|2|2|func (s *Stack) Push(v Item) Stack|Stack
>Push|DefinedIn|@
>Push|MemberOf|Stack
>Push|Calls|grow
>Push|Calls|own
>Push|Returns|Stack
>Push|TypedAs|Item
Function|Len|3|3|func (s Stack) Len() int|Stack
>Len|DefinedIn|@
>Len|MemberOf|Stack
>Len|Calls|len
>Len|Returns|int
"""
EXPECTED["go_type"] = """
Struct|Foo|2|7||
>Foo|DefinedIn|@
>Foo|Inherits|Base
>Foo|Inherits|Ptr
>Foo|Inherits|pkg.Q
Interface|Reader|8|11||
>Reader|DefinedIn|@
>Reader|Inherits|Closer
Alias|Names|12|12||
>Names|DefinedIn|@
"""
EXPECTED["go_import"] = """
Include|os|2|2||
>@|Includes|os
Include|fmt|4|4||
>@|Includes|fmt
Include|math/rand|5|5||
>@|Includes|math/rand
"""
EXPECTED["go_const"] = """
Variable|Pi|2|2||
>Pi|DefinedIn|@
Variable|X|4|4||
>X|DefinedIn|@
Variable|Y|5|5||
>Y|DefinedIn|@
"""
EXPECTED["go_var"] = """
Variable|p|2|2||
>p|DefinedIn|@
Variable|r|4|4||
>r|DefinedIn|@
Variable|s|5|5||
>s|DefinedIn|@
"""
EXPECTED["go_calls"] = """
Function|f|2|6|func f(x T)|
>f|DefinedIn|@
>f|Calls|a
>f|Calls|b
>f|Calls|d
>f|Calls|a
>f|TypedAs|T
"""
EXPECTED["cs_class"] = """
Class|Foo|1|3|public sealed class Foo<T> : Base<T>, I.J where T : new()|
>Foo|DefinedIn|@
>Foo|Inherits|Base
>Foo|Inherits|I.J
Variable|n|2|2||Foo
>n|DefinedIn|@
>n|MemberOf|Foo
Class|Point|4|4||
>Point|DefinedIn|@
"""
EXPECTED["cs_struct"] = """
Struct|Inner|1|3|struct Inner : IInner|
>Inner|DefinedIn|@
>Inner|Inherits|IInner
Variable|v|2|2||Inner
>v|DefinedIn|@
>v|MemberOf|Inner
"""
EXPECTED["cs_interface"] = """
Interface|IShape|1|3|interface IShape : IBase, IDisposable|
>IShape|DefinedIn|@
>IShape|Inherits|IBase
>IShape|Inherits|IDisposable
Function|Area|2|2||IShape
>Area|DefinedIn|@
>Area|MemberOf|IShape
>Area|Returns|double
"""
EXPECTED["cs_enum"] = """
Enum|Color|1|3||
>Color|DefinedIn|@
"""
EXPECTED["cs_method"] = """
Class|K|1|5|class K|
>K|DefinedIn|@
Function|K|2|2|public K(int n) : base(n)|K
>K|DefinedIn|@
>K|MemberOf|K
>K|Calls|Init
>K|TypedAs|int
Function|Run|3|3|public Task<Out> Run(Bar b, int n)|K
>Run|DefinedIn|@
>Run|MemberOf|K
>Run|Calls|Then
>Run|Calls|Go
>Run|Returns|Task
>Run|TypedAs|Bar
>Run|TypedAs|int
Function|Nothing|4|4||K
>Nothing|DefinedIn|@
>Nothing|MemberOf|K
>Nothing|Returns|void
"""
EXPECTED["cs_property"] = """
Class|K|1|4|class K|
>K|DefinedIn|@
Variable|Size|2|2||K
>Size|DefinedIn|@
>Size|MemberOf|K
Variable|Name|3|3||K
>Name|DefinedIn|@
>Name|MemberOf|K
"""
EXPECTED["cs_namespace"] = """
Namespace|My.Space|1|3||
>My.Space|DefinedIn|@
Class|A|2|2|class A|
>A|DefinedIn|@
"""
EXPECTED["cs_using"] = """
Include|System|1|1||
>@|Includes|System
Include|System.Text|2|2||
>@|Includes|System.Text
Class|K|3|3|class K|
>K|DefinedIn|@
"""
EXPECTED["cs_field"] = """
Class|K|1|4|class K|
>K|DefinedIn|@
Variable|a|2|2||K
>a|DefinedIn|@
>a|MemberOf|K
Variable|b|2|2||K
>b|DefinedIn|@
>b|MemberOf|K
Variable|f|3|3||K
>f|DefinedIn|@
>f|MemberOf|K
"""
EXPECTED["cs_event"] = """
Class|K|1|3|class K|
>K|DefinedIn|@
Variable|Changed|2|2||K
>Changed|DefinedIn|@
>Changed|MemberOf|K
Variable|Other|2|2||K
>Other|DefinedIn|@
>Other|MemberOf|K
"""
EXPECTED["cs_calls"] = """
Class|K|1|3|class K|
>K|DefinedIn|@
Function|F|2|2|ns.Out F(List<In> x)|K
>F|DefinedIn|@
>F|MemberOf|K
>F|Calls|a
>F|Calls|b
>F|Calls|d
>F|Calls|c
>F|Calls|g
>F|Calls|a
>F|Returns|ns.Out
>F|TypedAs|List
"""


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'" if value else "CAST(NULL AS VARCHAR)"


def rows_of(name: str) -> list[tuple[int, str, list[str]]]:
    """(number, S or E, fields) of a sample's rows; number counts from 0 with the file's own symbol."""
    path = SAMPLES[name][0]
    out: list[tuple[int, str, list[str]]] = [(0, "S", ["File", path, "0", "0", "", ""])]
    for line in EXPECTED[name].strip().split("\n"):
        fields = [path if f == "@" else f for f in line.removeprefix(">").split("|")]
        out.append((len(out), "E" if line.startswith(">") else "S", fields))
    return out


def values(names: list[str]) -> str:
    """The rows of samples, as a parenthesised VALUES list of (file_ord, file_path, n, row_type, name, kind, start_line, end_line, signature, parent_class, src, relation, dst)."""
    made = []
    for k, name in enumerate(names):
        for n, kind, f in rows_of(name):
            own = [_text(f[1]), _text(f[0]), f[2], f[3], _text(f[4]), _text(f[5]), *["CAST(NULL AS VARCHAR)"] * 3] if kind == "S" else [*["CAST(NULL AS VARCHAR)"] * 2, *["CAST(NULL AS INTEGER)"] * 2, *["CAST(NULL AS VARCHAR)"] * 2, *(_text(x) for x in f)]
            made.append(f"({k}, {_text(SAMPLES[name][0])}, {n}, '{kind}', {', '.join(own)})")
    return "(VALUES\n" + ",\n".join(made) + "\n) AS t(file_ord, file_path, n, row_type, name, kind, start_line, end_line, signature, parent_class, src, relation, dst)"


def sql(names: list[str]) -> str:
    return f"SELECT file_path, CAST(n AS INTEGER) AS n, row_type, name, kind, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line, signature, parent_class, src, relation, dst FROM {values(names)}"


def _table(columns: str, *rows: tuple) -> str:
    """Rows written out as SQL; text as literals, None as NULL."""

    def literal(v: object) -> str:
        return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(literal(v) for v in r) + ')' for r in rows)}) AS t({columns})"


ORACLES = {f"extract_{name}": sql([name]) for name in EXPECTED}

IN_ORDER = sorted(SAMPLES, key=lambda n: SAMPLES[n][0])
_ALL = values(IN_ORDER)
#: Python and Go samples in order, as the engine's queries index them.
_TWO = values([n for n in IN_ORDER if SAMPLES[n][0].endswith((".py", ".go"))])
_KINDS = "['Function', 'Class', 'Struct', 'Enum', 'Variable', 'Macro', 'Alias', 'Include', 'Namespace', 'Concept', 'Interface', 'File']"
_RELATIONS = "['Inherits', '', 'MemberOf', '', 'DefinedIn', '', 'Includes', '', 'Calls', '', 'Returns', '', 'TypedAs']"
_ENDS = "CASE string_split(path, '.')[2] WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'rs' THEN 'rust' WHEN 'cs' THEN 'csharp' ELSE string_split(path, '.')[2] END"

ORACLES["collect_folder"] = (
    "SELECT row_number() OVER (ORDER BY last, path) - 1 AS ord, path FROM (SELECT 0 AS last, file_path AS path FROM " + _ALL + " WHERE n = 0 UNION ALL SELECT 1, 'deep/er/more.py' UNION ALL SELECT 2, 'node_modules/x.js')"
)
ORACLES["read_sources"] = f"SELECT file_ord, path, {_ENDS} AS lang, bytes FROM (SELECT ord AS file_ord, path, strlen(text) AS bytes FROM ({_table('ord, path, text', *((i, *SAMPLES[n]) for i, n in enumerate(IN_ORDER)), (len(IN_ORDER) + 1, *SAMPLES[IN_ORDER[0]]))}))"
ORACLES["index_symbols"] = f"SELECT row_number() OVER (ORDER BY file_ord, n) AS symbol_id, name, CAST(list_position({_KINDS}, kind) - 1 AS INTEGER) AS kind, file_path AS file, start_line, end_line, signature, parent_class FROM {_ALL} WHERE row_type = 'S'"
ORACLES["index_edges"] = f"SELECT row_number() OVER (ORDER BY file_ord, n) AS edge_id, src, dst, file_path AS file, CAST(list_position({_RELATIONS}, relation) - 1 AS INTEGER) AS relation FROM {_ALL} WHERE row_type = 'E'"
ORACLES["report_labels"] = _table("label, n", ("C", 10), ("C++", 8), ("C/C++", 1), ("Python", 7), ("Java", 8), ("JavaScript", 7), ("TypeScript", 4), ("Rust", 12), ("Go", 7), ("C#", 11), ("Other", 2))
ORACLES["name_statistics"] = f"SELECT count(*) AS names, CAST(sum(strlen(x)) AS BIGINT) AS bytes FROM (SELECT DISTINCT unnest([name, file_path, signature, parent_class, src, dst]) AS x FROM {values(['cs_method'])}) WHERE x IS NOT NULL"
ORACLES["engine_index"] = f"""WITH t AS (SELECT count(*) AS n FROM {_TWO} WHERE row_type = 'S')
SELECT 'index' AS step, n AS symbols FROM t UNION ALL SELECT 'again', n + 4 FROM t UNION ALL SELECT 'reindex', n FROM t UNION ALL SELECT 'remove', n - 4 FROM t UNION ALL SELECT 'update', 4"""
ORACLES["engine_file_symbols"] = _table("name, kind, line", ("go_type.go", "FileNode", 0), ("Foo", "ClassNode", 2), ("Reader", "InterfaceNode", 8), ("Names", "AliasNode", 12))
ORACLES["engine_file_tree"] = f"SELECT CAST(file_ord AS INTEGER) AS ord, file_path AS path, file_path AS name FROM {_TWO} WHERE n = 0"
ORACLES["engine_search"] = f"""WITH s AS (SELECT name, CASE kind WHEN 'Struct' THEN 'ClassNode' ELSE kind || 'Node' END AS kind, file_path AS file, start_line AS line, row_number() OVER (PARTITION BY name ORDER BY file_ord, n) AS k FROM {_TWO} WHERE row_type = 'S'),
f AS (SELECT *, CASE WHEN kind = 'FileNode' THEN '/' || name ELSE lower(name) END AS l FROM s WHERE k = 1 AND (kind = 'FileNode' OR contains(lower(name), 's')))
SELECT CAST(row_number() OVER (ORDER BY NOT starts_with(l, 's'), l, name) - 1 AS INTEGER) AS ord, name, kind, file, line FROM f ORDER BY ord LIMIT 12"""
ORACLES["engine_query"] = f"SELECT CAST(row_number() OVER (ORDER BY min(n)) - 1 AS INTEGER) AS ord, dst AS name FROM {_TWO} WHERE src = 'Push' GROUP BY dst"
ORACLES["engine_repr"] = _table("shown", ("<SymbolEntry FunctionNode Push @ go_method.go:2>",), ("<RelatedSymbol ClassNode Shape depth=1>",))
ORACLES["engine_pincer"] = "SELECT 3 AS start_line, 38 AS end_line, array_to_string(['// ...', 'line18', 'line19', '    target(1)', 'line21', 'line22', '// ...'], chr(10)) AS code, true AS applied"
ORACLES["engine_opencode"] = _table("number, line", (1, 'def area(w: int, h: int) -> "Size":'), (2, "    def inner():"), (3, "        pass"), (4, "    return mul(w, scale(h))"))


def _lines(*lines: str) -> str:
    return _table("n, line", (0, "indexed 14 files"), *((i, x) for i, x in enumerate(lines, 1)))


_PUSH = ["  [FunctionNode] Push  go_method.go:2-2", "      func (s *Stack) Push(v Item) Stack"]
ORACLES["cli_index"] = _lines("  Go: 7", "  Python: 7")
ORACLES["cli_query"] = _lines("1 matches, 5 related", *_PUSH, "  DefinedIn -> [FileNode] go_method.go  go_method.go:0")
ORACLES["cli_lookup"] = _lines("1 matches", *_PUSH)
ORACLES["cli_search"] = _lines("  [ClassNode] Shape  python_class.py:1")
ORACLES["cli_symbols"] = _lines("       0  [FileNode] go_method.go", "       2  [FunctionNode] Push", "       3  [FunctionNode] Len")
ORACLES["cli_opencode"] = _lines("  [FunctionNode] area  python_function.py:1-4", '      def area(w: int, h: int) -> "Size"', '     1 | def area(w: int, h: int) -> "Size":', "     2 |     def inner():", "     3 |         pass", "     4 |     return mul(w, scale(h))")
ORACLES["clipped_signatures"] = "SELECT CAST(n AS INTEGER) AS length, CAST(m AS INTEGER) AS most, CASE WHEN n > m THEN repeat('a', m - 3) || '...' ELSE repeat('a', n) END AS shown FROM (VALUES (99), (100), (101), (120), (121), (300)) AS a(n), (VALUES (100), (120)) AS b(m)"
ORACLES["msvc_markers"] = _table("pos, line, file, original", (1, "int a;", "a.c", 1), (2, "int b;", "a.c", 2), (4, "int c;", "dir/b.h", 10), (6, "int d;", "a.c", 3))
ORACLES["preprocessor_commands"] = """SELECT compiler, lang, CASE compiler WHEN 'cl.exe' THEN 'cl.exe /nologo /E ' || CASE lang WHEN 'c' THEN '/TC' ELSE '/TP' END || ' /Iinc /Ia b /DX=1 -w bundle.' || lang
ELSE compiler || ' -E -x ' || CASE lang WHEN 'c' THEN 'c' ELSE 'c++' END || ' -Iinc -Ia b -DX=1 -w bundle.' || lang END AS command FROM (VALUES ('gcc'), ('clang'), ('cl.exe')) AS a(compiler), (VALUES ('c'), ('cpp')) AS b(lang)"""
ORACLES["preprocessor_output"] = _table("path, pos, line, original", ("/s/a.c", 0, "int a;", 1), ("/s/a.c", 1, "", 2), ("/s/a.c", 2, "int b;", 7), ("/s/b.c", 0, "int c;", 2), ("/s/b.c", 1, "", 3))
ORACLES["normalized_paths"] = _table("path, shown, known_compiler", ("a\\b\\c.h", "a/b/c.h", True), ("a/b/c.h", "a/b/c.h", True), ("C:\\x y\\z.cpp", "C:/x y/z.cpp", True), ("", "", True))
ORACLES["extract_all_statuses"] = "SELECT doc_id AS file_ord, 'doc' || doc_id || '.' || ['c', 'cpp', 'py', 'java', 'js', 'ts', 'tsx', 'rs', 'go', 'cs'][doc_id % 10 + 1] AS path, 11 AS kind, 0 AS start_line FROM documents"
