"""The facade, the command line, preprocessing and the stream over real files."""

import sys
import time

import pytest

from lodestone import cli
from lodestone.engine import Engine
from lodestone.sources.files import collect_files, read_files
from lodestone.sources.preprocess import PreprocessConfig, command, detect_compiler, parse_marker, preprocess_batch, split_output

PY = "import os\nclass Base:\n    pass\nclass Foo(Base):\n    def run(self) -> int:\n        return helper(1)\ndef helper(x):\n    return x\n"
CC = '#include "b.h"\n#define N 3\nint twice(int x) { return x * N; }\nint main(void) { return twice(2); }\n'


@pytest.fixture()
def tree(tmp_path):
    (tmp_path / "node_modules").mkdir()
    (tmp_path / ".git").mkdir()
    for name, text in {"a.py": PY, "b.c": CC, "b.h": "int twice(int x);\n", "node_modules/x.js": "var a=1", ".git/y.py": "x=1", "readme.txt": "no"}.items():
        (tmp_path / name).write_text(text)
    return tmp_path


def test_listing(tree):
    assert [p.rsplit("/", 1)[1] for p in collect_files([str(tree)])] == ["a.py", "b.c", "b.h"]


def test_missing_files_are_left_out(spark, tree):
    assert read_files(spark, [str(tree / "a.py"), str(tree / "gone.py"), str(tree / "readme.txt")]).count() == 1
    with pytest.raises(ValueError):
        read_files(spark, [str(tree / "a.py")] * 3, limit=2)


def test_engine(spark, tree):
    with Engine(spark) as engine:
        assert engine.symbol_count() == 0 and engine.lookup("x") == []
        assert engine.index_files(collect_files([str(tree)])) == 3
        first = engine.symbol_count()
        foo = engine.lookup("Foo")[0]
        assert (foo.kind, foo.start_line, foo.end_line) == ("ClassNode", 4, 6) and "Foo" in repr(foo)
        found = engine.query("run", 1)
        assert found.related[:3] == [str(tree / "a.py"), "Foo", "helper"]
        assert [r.relation for r in found.related_symbols] == ["DefinedIn", "MemberOf", "Calls"]
        assert engine.query("helper", 1, reverse=True).related_symbols[0].relation == "CalledBy"
        assert engine.smart_query("run").density.expansions_used == 1
        assert '"name":"helper"' in engine.search_symbols("HELP") and "a.py" in engine.get_file_tree() and '"line":0' in engine.get_file_symbols("a.py")
        assert engine.language_counts() == {"cpp": 1, "c": 1, "python": 1}
        assert [line for _, line in engine.opencode("helper")[0][1]] == ["def helper(x):", "    return x"]
        snip = Engine.pincer_extract(spark, str(tree / "a.py"), 1, 8, "helper", 1)
        assert snip.pincer_applied and snip.code.startswith("// ...\n    def run")
        # Indexing again adds; reindexing replaces; removing is seen at once.
        engine.index_files([str(tree / "a.py")])
        assert len(engine.lookup("Foo")) == 2
        (tree / "a.py").write_text(PY.replace("Foo", "Bar"))
        engine.reindex_files([str(tree / "a.py")])
        assert engine.lookup("Foo") == [] and len(engine.lookup("Bar")) == 1 and engine.symbol_count() == first
        engine.remove_files([str(tree / "a.py")])
        assert engine.lookup("Bar") == [] and engine.search_symbols("bar") == "[]"
        assert engine.update() == 1


def test_command_line(tree, capsys, spark, monkeypatch):
    for argv, want in (
        (["index", str(tree)], "Python: 1"), (["query", "run", str(tree), "--depth", "1"], "Calls -> "), (["lookup", "helper", str(tree)], "def helper(x)"), (["search", "twi", str(tree)], "twice"),
        (["symbols", str(tree / "a.py")], "Base"), (["opencode", "helper", str(tree)], "return x"),
    ):
        cli.main(argv)
        assert want in capsys.readouterr().out
    monkeypatch.setattr(sys, "stdin", iter(["helper\n", "/query run\n", "/smart run\n", "/files\n", "/stats\n", "/search twi\n", "/symbols a.py\n", "/opencode helper\n", "\n", "/quit\n"]))
    cli.main(["repl", str(tree)])
    out = capsys.readouterr().out
    assert "expansions" in out and "symbols" in out
    with pytest.raises(SystemExit):
        cli.main(["index", str(tree / "node_modules" / "none")])
    assert cli.clip("x" * 200, 120).endswith("...") and len(cli.clip("x" * 200, 120)) == 120


def test_markers():
    assert parse_marker('# 12 "a/b.c" 2') == (12, "a/b.c") and parse_marker('#line 3 "C:\\\\x\\\\y.c"') == (3, "C:/x/y.c") and parse_marker("#define X") is None
    out = split_output('# 1 "b.c"\nint a;\n# 5 "/x/y.c"\nint b;\n\nint c;\n# 1 "z.h"\nskip\n# 9 "/x/y.c"\nint d;', {"/x/y.c"})
    assert out == {"/x/y.c": ("int b;\n\nint c;\nint d;\n", [5, 6, 7, 9])}
    assert command("cl", "b.cpp", "cpp", PreprocessConfig(defines=("A=1",)))[2:5] == ["/E", "/TP", "/DA=1"]


# A stand-in for a compiler: each included file's lines, N replaced, between markers, without its directives.
FAKE = """#!{python}
import sys
for line in open(sys.argv[-1]):
    path = line.split('"')[1]
    print('# 1 "%s"' % path)
    n = 0
    for text in open(path):
        n += 1
        if text.startswith("#"):
            print('# 1 "other.h"')
            print("int from_elsewhere;")
            print('# %d "%s" 2' % (n + 1, path))
        else:
            print(text.rstrip().replace("N", "3"))
"""


def test_preprocessing(spark, tree):
    fake = tree / "fakecc"
    fake.write_text(FAKE.format(python=sys.executable))
    fake.chmod(0o755)
    config = PreprocessConfig(enabled=True, compiler=str(fake), batch_size=1)
    text, lines = preprocess_batch({str(tree / "b.c"): "c", str(tree / "b.h"): "cpp"}, config)[str(tree / "b.c")]
    assert "x * 3" in text and "from_elsewhere" not in text and lines[:2] == [3, 4]
    with Engine(spark) as engine:
        engine.set_preprocess_config(enabled=True, compiler=str(fake), include_paths=[str(tree)])
        engine.index_files([str(tree / "b.c")])
        twice = engine.lookup("twice")[0]
        assert (twice.start_line, twice.end_line) == (3, 3) and engine.lookup("N") == []
        # Where the compiler fails, files are read raw.
        engine.set_preprocess_config(enabled=True, compiler=str(tree / "nothing"))
        engine.reindex_files([str(tree / "b.c")])
        assert engine.lookup("N")[0].kind == "MacroNode"
    assert detect_compiler(windows=True) in ("", "cl", "clang", "gcc")


def test_stream(spark, tmp_path):
    """New, changed and removed files; a start with only the checkpoint goes on from what was kept there."""
    from lodestone.streaming.incremental import follow, refresh

    folder, state = tmp_path / "in", str(tmp_path / "c")
    folder.mkdir()
    seen = []

    def names():
        follow(spark, str(folder), state, seen.append).awaitTermination()
        return {r["name"].rpartition("/")[2] for r in seen[-1].symbols.collect()}

    (folder / "a.py").write_text("def one(): pass\n")
    (folder / "notes.txt").write_text("no source")
    assert names() == {"a.py", "one"}
    time.sleep(1.1)
    (folder / "a.py").write_text("def two(): pass\n")
    (folder / "b.py").write_text("def three(): pass\n")
    assert names() == {"a.py", "two", "b.py", "three"}
    ids = [r["symbol_id"] for r in seen[-1].symbols.collect()]
    assert len(set(ids)) == len(ids)
    (folder / "b.py").unlink()
    assert names() == {"a.py", "two"}
    assert seen[-1].edges.filter("file_path like '%b.py'").count() == 0
    found = refresh(spark, str(folder), f"{state}/versions")
    assert (found.indexed, found.dropped) == (0, 0)
    (folder / "a.py").unlink()
    assert names() == set() and len(seen) == 4


def test_stream_from_a_graph(spark, tmp_path):
    from lodestone.sources.files import index_files
    from lodestone.streaming.incremental import refresh

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.py").write_text("def one(): pass\n")
    (tmp_path / "other.py").write_text("def other(): pass\n")
    start, _ = index_files(spark, [str(tmp_path / "other.py"), str(tmp_path / "in" / "a.py")])
    found = refresh(spark, str(tmp_path / "in"), str(tmp_path / "state"), start)
    assert (found.indexed, found.dropped) == (1, 0)
    assert sorted(r["name"].rpartition("/")[2] for r in found.graph.symbols.collect()) == ["a.py", "one", "other", "other.py"]
