"""Run registered queries against their SQL in DuckDB."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = "/root/testdata"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return str(value) if type(value).__name__ == "Decimal" else value


def _sorted(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, query, sql: str, sf_dir: str) -> str | None:
    """None if both give the same rows, else what differs."""
    df = query(spark, sf_dir)
    spark_rows = _sorted(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    sql_rows = _sorted(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    bad = [(c, t, types[c]) for c, t in df.dtypes if same.get(t, t) != types[c]]
    if bad:
        return f"types {bad}"
    if len(spark_rows) != len(sql_rows):
        return f"{len(spark_rows)} vs {len(sql_rows)} rows"
    if not spark_rows:
        return "no rows"
    for a, b in zip(spark_rows, sql_rows):
        if a != b:
            return f"{a} vs {b}"
    return None


def main(names: list[str], sf: str = "sf0.01") -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from quillmark.session import build_session

    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(f"{ROOT}/{sf}")
    queries, sqls, failed = entry.queries(), entry.oracle_sql(), 0
    for name in names or list(queries):
        started = time.time()
        try:
            if name in sqls:
                result = compare(spark, con, queries[name], sqls[name], f"{ROOT}/{sf}")
            else:
                n = queries[name](spark, f"{ROOT}/{sf}").count()
                result = None if n else "no rows"
        except Exception as e:  # noqa: BLE001
            result = f"{type(e).__name__}: {str(e)[:600]}"
        failed += result is not None
        print(f"{'ok  ' if result is None else 'FAIL'} {name:32s} {time.time() - started:6.2f}s "
              f"{'' if name in sqls else '(rows only) '}{result or ''}", flush=True)
    print(f"{failed} failed")
    spark.stop()
    return failed


if __name__ == "__main__":
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("sf") else "sf0.01"
    raise SystemExit(main(args, sf))
