"""Run registered queries beside their SQL and compare the rows.

    python -m salesloom.check [--sf DIR] [--only key,key] [--plan]
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import math
import sys
import time

import duckdb

from salesloom.plans import load_all
from salesloom.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def open_duckdb(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if value is None:
        return None
    if isinstance(value, decimal.Decimal):
        return ("decimal", str(value.normalize()))
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value + 0.0, 9)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_cell(v) for v in value)
    return value


def _kind(name: str) -> str:
    name = name.lower()
    for kind, words in {
        "integer": ("tinyint", "smallint", "int", "integer", "bigint", "hugeint", "long"),
        "float": ("float", "double", "real"),
        "text": ("string", "varchar"),
    }.items():
        if name in words:
            return f"{kind}:{'bigint' if name in ('bigint', 'long') else 'double' if name == 'double' else name}"
    return name.split("(")[0]


SAME = {"text:string": "text:varchar", "integer:int": "integer:integer"}


def compare(df, con, sql: str) -> list[str]:
    problems = []
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    kinds = {d[0]: _kind(str(d[1])) for d in result.description}
    expected = result.fetchall()
    columns = sorted(df.columns)
    if columns != sorted(names):
        return [f"columns {columns} != {sorted(names)}"]
    for name, dtype in df.dtypes:
        mine = _kind(dtype)
        if SAME.get(mine, mine) != SAME.get(kinds[name], kinds[name]):
            problems.append(f"type of {name}: {dtype} != {kinds[name]}")
    got = [tuple(_cell(row[c]) for c in columns) for row in df.collect()]
    order = [names.index(c) for c in columns]
    want = [tuple(_cell(row[i]) for i in order) for row in expected]
    if len(got) != len(want):
        problems.append(f"rows {len(got)} != {len(want)}")
    left, right = sorted(got, key=repr), sorted(want, key=repr)
    if left != right:
        a, b = set(map(repr, left)), set(map(repr, right))
        problems.append(f"values: only here {sorted(a - b)[:2]}; only SQL {sorted(b - a)[:2]}"[:900])
    elif not got:
        problems.append("no rows")
    return problems


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--only", default="")
    parser.add_argument("--prefix", default="")
    parser.add_argument("--plan", action="store_true")
    args = parser.parse_args()
    queries, oracles = load_all()
    spark = build_session("check", cpus=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = open_duckdb(args.sf)
    chosen = [k for k in queries if (not args.only or k in args.only.split(",")) and k.startswith(args.prefix)]
    failed = 0
    for name in chosen:
        started = time.time()
        try:
            df = queries[name](spark, args.sf)
            if args.plan:
                df.explain()
            problems = compare(df, con, oracles[name]) if name in oracles else ([] if df.collect() else ["no rows"])
        except Exception as error:  # a query that fails must not hide the ones after it
            problems = [f"{type(error).__name__}: {str(error)[:700]}"]
        failed += bool(problems)
        note = "" if name in oracles else " (rows only)"
        print(f"{'FAIL' if problems else 'ok  '} {name}{note} {time.time() - started:.1f}s {'; '.join(problems)}", flush=True)
    print(f"{len(chosen) - failed} of {len(chosen)} match")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
