"""Rows of a query and of its SQL, in a form that compares equal if they are."""

from __future__ import annotations

import json
import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 9)
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


def lines(rows) -> list[str]:
    return sorted(json.dumps([plain(v) for v in row], default=str) for row in rows)


def of_query(df) -> tuple[list[str], list[str]]:
    columns = sorted(df.columns)
    return columns, lines(df.select(*columns).collect())


def of_sql(sql: str, sf_dir: str) -> tuple[list[str], list[str]]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(sf_dir):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    at = [names.index(c) for c in sorted(names)]
    return sorted(names), lines([row[i] for i in at] for row in found.fetchall())
