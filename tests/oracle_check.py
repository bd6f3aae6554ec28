"""Runs catalogue queries beside their SQL on DuckDB and compares columns, types and values.

``python tests/oracle_check.py [sf_dir] [query ...]``
"""

from __future__ import annotations

import datetime as dt
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
SAME_TYPE = {
    "BIGINT": "bigint",
    "INTEGER": "int",
    "DOUBLE": "double",
    "VARCHAR": "string",
    "TIMESTAMP": "timestamp_ntz",
    "FLOAT": "float",
    "BOOLEAN": "boolean",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    return value.replace(tzinfo=None) if isinstance(value, dt.datetime) else value


def _sorted(rows, order):
    cleaned = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(cleaned, key=lambda r: tuple((v is None, str(type(v)), v) for v in r))


def compare(con, sql: str, df) -> list[str]:
    """Differences between a Spark result and the SQL result; empty when they agree."""
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    types = {c[0]: SAME_TYPE.get(str(c[1]), str(c[1])) for c in cursor.description}
    expected = cursor.fetchall()
    problems = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    spark_types = dict(df.dtypes)
    problems += [f"type of {n}: {spark_types[n]} != {types[n]}" for n in names if spark_types[n] != types[n]]
    got = [tuple(r) for r in df.collect()]
    order = sorted(names)
    left = _sorted(got, [df.columns.index(n) for n in order])
    right = _sorted(expected, [names.index(n) for n in order])
    if len(left) != len(right):
        problems.append(f"{len(left)} rows != {len(right)}")
    else:
        bad = [(a, b) for a, b in zip(left, right) if a != b]
        if bad:
            problems.append(f"{len(bad)} of {len(left)} rows differ, e.g. {bad[0]}")
    return problems


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from flowsieve.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:] or list(queries())
    spark, con = local_session(), connect(sf_dir)
    failed = 0
    for name in wanted:
        began = time.perf_counter()
        try:
            df = queries()[name](spark, sf_dir)
            if name in oracle_sql():
                problems = compare(con, oracle_sql()[name], df)
            else:
                problems = [] if df.collect() else ["no rows"]
        except Exception as error:  # noqa: BLE001
            problems = [f"{type(error).__name__}: {str(error)[:1500]}"]
        failed += bool(problems)
        kind = "sql" if name in oracle_sql() else "rows"
        print(f"{name:24s} {kind:5s} {time.perf_counter() - began:7.2f}s {'OK' if not problems else problems}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
