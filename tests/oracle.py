"""Run a query and its SQL side by side: ``python tests/oracle.py [name ...]``."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    """Values as both engines should print them."""
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float, Decimal)):
        f = float(v)
        return repr(f + 0.0)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def compare(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Differences, empty when both sides agree."""
    rel = con.sql(sql)
    names = sorted(rel.columns)
    if names != sorted(spark_df.columns):
        return [f"columns {sorted(spark_df.columns)} != {names}"]
    mine = sorted(tuple(plain(r[n]) for n in names) for r in spark_df.collect())
    theirs = sorted(
        tuple(plain(v) for v in row) for row in rel.project(", ".join(f'"{n}"' for n in names)).fetchall()
    )
    if mine == theirs:
        return []
    only_mine = sorted(set(mine) - set(theirs))
    only_theirs = sorted(set(theirs) - set(mine))
    return [f"{len(mine)} rows vs {len(theirs)}; columns {names}"] + [
        f"  spark only {r}" for r in only_mine[:3]
    ] + [f"  duckdb only {r}" for r in only_theirs[:3]]


def main(sf: str, names: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries

    from sparkodds.session import local_session

    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session()
    spark.sparkContext.setLogLevel("FATAL")
    con, sqls, failed = connect(sf_dir), oracle_sql(), 0
    for name, fn in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            if name in sqls:
                diff = compare(fn(spark, sf_dir), con, sqls[name])
            else:
                diff = [] if fn(spark, sf_dir).count() >= 0 else ["no rows"]
        except Exception as e:  # report and go on to the next query
            diff = [type(e).__name__ + ": " + str(e)[:600].replace("\n", " ")]
        print(f"{'FAIL' if diff else 'ok  '} {name} {time.time() - start:.2f}s", *diff[:7], sep="\n     " if diff else " ", flush=True)
        failed += bool(diff)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    args = sys.argv[1:]
    sf = args.pop(0)[3:] if args and args[0].startswith("sf=") else "0.01"
    sys.exit(1 if main(sf, args) else 0)
