"""Runs a query and its SQL over the same tables and tells how their rows differ."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if hasattr(value, "asDict"):
        return tuple(_plain(v) for v in value.asDict().values())
    if isinstance(value, dict):
        return tuple(_plain(v) for v in value.values())
    return str(value) if value is not None else None


def differ(spark, sf_dir: str, query, sql: str) -> str:
    """'' if both give the same rows under the same names."""
    df = query(spark, sf_dir)
    mine_names = sorted(df.columns)
    mine = Counter(tuple(_plain(r[c]) for c in mine_names) for r in df.collect())
    result = connect(sf_dir).execute(sql)
    names = [d[0] for d in result.description]
    at = [names.index(c) for c in sorted(names)]
    theirs = Counter(tuple(_plain(r[i]) for i in at) for r in result.fetchall())
    if sorted(names) != mine_names:
        return f"columns {mine_names} and {sorted(names)}"
    if mine != theirs:
        return f"{sum((mine - theirs).values())} rows too many, e.g. {list(mine - theirs)[:2]}; {sum((theirs - mine).values())} missing, e.g. {list(theirs - mine)[:2]}"
    return ""
