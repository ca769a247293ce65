"""Run registered queries against their check SQL: python tests/compare.py [names...]."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return str([_plain(v) for v in value])
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def difference(spark_df, con, sql) -> str | None:
    """None if equal, else a description of the difference."""
    names, got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    result = con.execute(sql)
    want_names, want = rows_of([d[0] for d in result.description], result.fetchall())
    if names != want_names:
        return f"columns {names} != {want_names}"
    if got == want:
        return None
    extra, missing = sorted(set(got) - set(want))[:3], sorted(set(want) - set(got))[:3]
    return f"rows {len(got)} vs {len(want)}; extra {str(extra)[:600]}; missing {str(missing)[:600]}"


def main() -> None:
    import __spark_entry__ as entry
    from codeloom import build_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
                                                "spark.ui.enabled": "false", "spark.log.level": "ERROR"})
    con, oracles, bad = connect(folder), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if len(sys.argv) > 1 and not any(name.startswith(a) for a in sys.argv[1:]):
            continue
        start = time.time()
        try:
            if name in oracles:
                problem = difference(fn(spark, folder), con, oracles[name])
            else:
                print(f"     {name}: {len(fn(spark, folder).collect())} rows, no SQL")
                problem = None
        except Exception as error:
            problem = f"{type(error).__name__} {str(error)[:1500]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'BAD '} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
