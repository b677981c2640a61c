"""Run queries and their DuckDB twins side by side."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages"
          " benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canonical(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shaped = [tuple(canonical(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(shaped, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def compare(spark, con, name, fn, sql, sf_dir) -> str | None:
    """None if equal, else a short description of the difference."""
    df = fn(spark, sf_dir)
    left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    right = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"rows {len(left[1])} != {len(right[1])}: {left[1][:2]} / {right[1][:2]}"
    for a, b in zip(left[1], right[1]):
        if a != b or [type(v) for v in a] != [type(v) for v in b]:
            return f"{left[0]}: {str(a)[:600]} != {str(b)[:600]}"
    return None


def main() -> None:
    import __spark_entry__ as entry
    from groundshift.session import local_session

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark = local_session(8)
    con = connect(sf_dir)
    oracle = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if name in oracle:
                result = compare(spark, con, name, fn, oracle[name], sf_dir)
            else:
                result = None if fn(spark, sf_dir).count() else "no rows"
        except Exception as problem:
            result = f"{type(problem).__name__}: {str(problem)[:700]}"
        bad += result is not None
        mark = "ok  " if result is None else "FAIL"
        print(f"{mark} {name} {time.time() - start:.1f}s {result or ('' if name in oracle else '(rows only)')}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
