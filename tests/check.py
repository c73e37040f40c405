"""Run registered queries against their SQL in DuckDB and compare the values.

Usage: python tests/check.py [sf] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return f"{value + 0.0:.6f}".replace("-0.000000", "0.000000")
    return repr(value)


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in data)


def kind(type_name: str) -> str:
    t = type_name.lower()
    for group, names in {
        "int64": ("bigint", "long", "int64"),
        "int32": ("integer", "int32", "int"),
        "double": ("double", "float"),
        "bool": ("bool",),
        "text": ("string", "varchar"),
    }.items():
        if any(t.startswith(n) for n in names):
            return group
    return t


def compare(df, con, sql):
    """None when equal, else a message; also returns the two run times."""
    t0 = time.time()
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: kind(str(d[1])) for d in cur.description}
    want = cur.fetchall()
    t2 = time.time()
    message = None
    if sorted(df.columns) != sorted(names):
        message = f"columns {sorted(df.columns)} != {sorted(names)}"
    else:
        a, b = rows_of(df.columns, got), rows_of(names, want)
        mine = {n: kind(t) for n, t in df.dtypes}
        if {n: t for n, t in mine.items() if types[n] != t}:
            message = "types " + str({n: (t, types[n]) for n, t in mine.items() if types[n] != t})
        elif len(a) != len(b):
            message = f"rows {len(a)} != {len(b)}"
        elif a != b:
            left, right = set(a), set(b)
            message = f"values differ: {len(left - right)} e.g. {sorted(left - right)[:2]} vs {sorted(right - left)[:2]}"
    return message, len(got), t1 - t0, t2 - t1


def main() -> None:
    import __spark_entry__ as entry
    from recspark.session import build_session

    args = sys.argv[1:]
    sf = args[0] if args else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session("local[8]", 8, **{"spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    names = args[1:] or list(queries)
    bad = 0
    for name in names:
        t0 = time.time()
        try:
            df = queries[name](spark, sf_dir)
            built = time.time() - t0
            if name in sqls:
                message, n, s, d = compare(df, con, sqls[name])
            else:
                t1 = time.time()
                n, message, d = len(df.collect()), None, 0.0
                s = time.time() - t1
            note = "ok" if name in sqls else "rows-only"
            bad += message is not None
            print(f"{'FAIL' if message else note:9} {name:32} rows={n:<8} build={built:.1f}s spark={s:.1f}s duckdb={d:.1f}s {message or ''}", flush=True)
        except Exception as exc:  # report and go on with the next query
            bad += 1
            print(f"ERROR     {name}: {type(exc).__name__}: {str(exc)[:1200]}", flush=True)
    print(f"{len(names)} queries, {bad} bad")


if __name__ == "__main__":
    main()
