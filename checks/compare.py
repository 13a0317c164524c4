"""Run registered queries next to their oracle SQL: ``python -m checks.compare SF_DIR [query ...]``."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

from checks.oracles import ORACLES
from checks.queries import QUERIES, TABLES
from figtrace.session import build_session


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return value


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def differences(spark, con, sf: str, name: str) -> tuple[int, list]:
    """Row count, and the differences found (none when all agrees)."""
    df = QUERIES[name](spark, sf)
    found = rows_of(df.columns, df.collect())
    result = con.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    if sorted(columns) != sorted(df.columns):
        return 0, [("columns", sorted(df.columns), sorted(columns))]
    wanted = rows_of(columns, result.fetchall())
    diff = [("spark", r) for r in list((found - wanted).elements())[:3]]
    diff += [("duckdb", r) for r in list((wanted - found).elements())[:3]]
    return sum(found.values()), diff


def main() -> int:
    sf, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                    "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = duck(sf), 0
    for name in names:
        start = time.time()
        try:
            n, diff = differences(spark, con, sf, name)
        except Exception as exc:
            n, diff = 0, [("error", str(exc)[:1500])]
        bad += bool(diff)
        print(f"{'FAIL' if diff else 'ok':4} {name:24} rows={n:<7} {time.time() - start:5.1f}s", flush=True)
        for d in diff:
            print("     ", *d)
    print(f"{len(names) - bad} of {len(names)} agree")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
