"""Runs a registered query in Spark and its SQL in DuckDB and compares the rows."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def canonical(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(canonical(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark_df, con, sql: str) -> list[str]:
    got_names, got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    want_names, want = rows_of(names, result.fetchall())
    problems = []
    if got_names != want_names:
        problems.append(f"columns {got_names} != {want_names}")
    for field in spark_df.schema.fields:
        kind, sql_kind = field.dataType.simpleString(), types.get(field.name, "?")
        allowed = {"bigint": ("BIGINT", "NUMBER"), "double": ("DOUBLE", "NUMBER"), "string": ("VARCHAR", "STRING")}
        if not any(a in sql_kind for a in allowed.get(kind, ("",))):
            problems.append(f"type of {field.name}: {kind} vs {sql_kind}")
    if len(got) != len(want):
        problems.append(f"{len(got)} rows != {len(want)}")
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        problems.append(f"{len(bad)} rows differ, first: {bad[0]}")
    if not got:
        problems.append("no rows")
    return problems


def main(sf_dir: str, names: list[str]) -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from exposurekit.session import build_session, release

    spark = build_session(
        master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="12g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(sf_dir), 0
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in names or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            problems = compare(df, con, oracles[name]) if name in oracles else ([] if df.count() else ["no rows"])
        except Exception as error:  # noqa: BLE001 - report and go on to the next query
            problems = [f"{type(error).__name__}: {str(error)[:1500]}"]
        release(spark)
        failed += bool(problems)
        kind = "sql" if name in oracles else "rows"
        print(f"{'FAIL' if problems else 'ok  '} {name} [{kind}] {time.time() - start:.1f}s {' | '.join(problems)}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1], sys.argv[2:]))
