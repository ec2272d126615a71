"""Compares registered queries with their SQL in DuckDB: ``python -m lodestar.plans.verify sf_dir [name ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path


def rows(frame) -> list[str]:
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    return sorted(str([round(x, 9) if isinstance(x, float) else x for x in r]) for r in frame.itertuples(index=False))


def main(sf_dir: str, names: list[str]) -> int:
    import duckdb
    from pyspark.sql import SparkSession

    from lodestar.plans import registry
    from lodestar.session import ship

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    con, bad = duckdb.connect(), 0
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    for name in names or registry.QUERIES:
        began = time.time()
        try:
            ours = registry.QUERIES[name](spark, sf_dir).toPandas()
            took = time.time() - began
            theirs = con.execute(registry.SQL[name]).df() if name in registry.SQL else None
        except Exception as e:
            bad += 1
            print(f"{name}: {type(e).__name__} {str(e)[:600]}", flush=True)
            continue
        if theirs is None:
            print(f"{name}: {len(ours)} rows, no SQL, {took:.1f} s", flush=True)
            continue
        a, b = rows(ours), rows(theirs)
        same = sorted(ours.columns) == sorted(theirs.columns) and a == b
        bad += not same
        print(f"{name}: {'same' if same else 'DIFFERENT'} {len(a)} {len(b)}, {took:.1f} s" + ("" if same else f"\n  {sorted(ours.columns)}\n  {sorted(theirs.columns)}\n  {[x for x in a if x not in set(b)][:2]}\n  {[x for x in b if x not in set(a)][:2]}"), flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
