"""Compare a query with its SQL on DuckDB: names, row count, values regardless of order."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def cell(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    return x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr), [names[i] for i in order]


def kind(text: str) -> str:
    """Type families that must agree between the engines."""
    text = text.lower()
    for family, words in {
        "whole": ("bigint", "integer", "int", "smallint", "tinyint", "long"), "float": ("double", "float"), "text": ("varchar", "string"),
        "flag": ("boolean",), "date": ("date",), "time": ("timestamp", "timestamp_ntz"),
    }.items():
        if text in words:
            return family
    return text


def differences(df, con, sql: str, close: float = 2e-6) -> list[str]:
    result = con.execute(sql)
    duck_names = [d[0] for d in result.description]
    duck_types = {d[0]: kind(str(d[1])) for d in result.description}
    want, want_names = rows_of(duck_names, result.fetchall())
    got, got_names = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if got_names != want_names:
        return [f"columns {got_names} != {want_names}"]
    out = [f"type {f.name}: {f.dataType.simpleString()} vs {duck_types[f.name]}" for f in df.schema.fields if kind(f.dataType.simpleString()) != duck_types[f.name]]
    if len(got) != len(want):
        return out + [f"{len(got)} rows != {len(want)}"]
    if got != want:
        bad = [(a, b) for a, b in zip(got, want) if a != b]
        out.append(f"{len(bad)} rows differ, e.g. {bad[:2]}")
    return out
