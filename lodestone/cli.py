"""Command line: index, query, lookup, search, symbols, opencode and a prompt over one session."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.engine import Engine, RelatedSymbol, SymbolEntry
from lodestone.sources.files import collect_files


def clip(text: str, most: int) -> str:
    return text if len(text) <= most else text[: most - 3] + "..."


def clipped(text: Column, most: Column) -> Column:
    """clip() of a column."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, F.lit(1), most - 3), F.lit("..."))).otherwise(text)


def show_entry(e: SymbolEntry) -> None:
    print(f"  [{e.kind}] {e.name}  {e.file_path}:{e.start_line}-{e.end_line}" + (f"  in {e.parent_class}" if e.parent_class else ""))
    if e.signature:
        print(f"      {clip(e.signature, 120)}")


def show_related(r: RelatedSymbol) -> None:
    print(f"  {'  ' * (r.depth - 1)}{r.relation} -> [{r.kind}] {r.name}  {r.file_path}:{r.start_line}")
    if r.signature:
        print(f"      {clip(r.signature, 100)}")


def make_engine(paths: list[str]) -> Engine:
    from pyspark.sql import SparkSession

    files = collect_files(paths)
    if not files:
        print("no source files found", file=sys.stderr)
        raise SystemExit(1)
    spark = SparkSession.builder.appName("lodestone").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    engine = Engine(spark).initialize()
    count = engine.index_files(files)
    print(f"indexed {count} files in {engine.stats.seconds:.1f} s: {engine.symbol_count()} symbols")
    return engine


def cmd_index(engine: Engine) -> None:
    for label, n in engine.label_counts().items():
        print(f"  {label}: {n}")


def cmd_query(engine: Engine, name: str, depth: int) -> None:
    began = time.monotonic()
    found = engine.query(name, depth)
    print(f"{len(found.symbols)} matches, {len(found.related)} related in {time.monotonic() - began:.2f} s")
    for e in found.symbols:
        show_entry(e)
    for r in found.related_symbols:
        show_related(r)


def cmd_lookup(engine: Engine, name: str) -> None:
    found = engine.lookup(name)
    print(f"{len(found)} matches")
    for e in found:
        show_entry(e)


def cmd_search(engine: Engine, text: str, limit: int) -> None:
    for hit in json.loads(engine.search_symbols(text, limit)):
        print(f"  [{hit['kind']}] {hit['name']}  {hit['file']}:{hit['line']}")


def cmd_symbols(engine: Engine, path: str) -> None:
    for row in json.loads(engine.get_file_symbols(path)):
        print(f"  {row['line']:>6}  [{row['kind']}] {row['name']}")


def cmd_opencode(engine: Engine, name: str) -> None:
    for entry, lines in engine.opencode(name):
        show_entry(entry)
        for number, line in lines:
            print(f"{number:>6} | {line}")


def cmd_smart(engine: Engine, name: str) -> None:
    found = engine.smart_query(name)
    d = found.density
    print(f"score {d.weighted_score:g}, {d.edge_type_count} kinds of edges, {'sufficient' if d.sufficient else 'not sufficient'}, expansions {d.expansions_used}")
    for r in found.related_symbols:
        show_related(r)


def repl(engine: Engine) -> None:
    print("/query /lookup /search /symbols /opencode /smart /files /stats /quit; a bare name is looked up")
    for line in sys.stdin:
        word, _, rest = line.strip().partition(" ")
        rest = rest.strip()
        if word in ("/quit", "/exit"):
            return
        if word == "/files":
            for f in json.loads(engine.get_file_tree())[:50]:
                print(f"  {f['path']}")
        elif word == "/stats":
            print(f"  {engine.symbol_count()} symbols")
            cmd_index(engine)
        elif word == "/query":
            cmd_query(engine, rest, 2)
        elif word == "/search":
            cmd_search(engine, rest, 20)
        elif word == "/symbols":
            cmd_symbols(engine, rest)
        elif word == "/opencode":
            cmd_opencode(engine, rest)
        elif word == "/smart":
            cmd_smart(engine, rest)
        elif word:
            cmd_lookup(engine, rest if word == "/lookup" else line.strip())


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lodestone")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("repl", "index"):
        commands.add_parser(name).add_argument("paths", nargs="+")
    for name in ("query", "lookup", "search", "opencode"):
        p = commands.add_parser(name)
        p.add_argument("name")
        p.add_argument("paths", nargs="*")
        p.add_argument("--path", nargs="+", default=[], dest="more")
        if name == "query":
            p.add_argument("--depth", type=int, default=2)
        if name == "search":
            p.add_argument("--limit", type=int, default=20)
    p = commands.add_parser("symbols")
    p.add_argument("file")
    p.add_argument("paths", nargs="*")
    p.add_argument("--path", nargs="+", default=[], dest="more")
    a = parser.parse_args(argv)
    paths = [*a.paths, *getattr(a, "more", [])]
    if not paths and a.command != "symbols":
        parser.error("no files or folders; give them as --path")
    paths = paths or [os.path.dirname(os.path.abspath(a.file))]
    with make_engine(paths) as engine:
        if a.command == "repl":
            repl(engine)
        elif a.command == "index":
            cmd_index(engine)
        elif a.command == "query":
            cmd_query(engine, a.name, a.depth)
        elif a.command == "lookup":
            cmd_lookup(engine, a.name)
        elif a.command == "search":
            cmd_search(engine, a.name, a.limit)
        elif a.command == "symbols":
            cmd_symbols(engine, os.path.abspath(a.file))
        else:
            cmd_opencode(engine, a.name)


if __name__ == "__main__":
    main()
