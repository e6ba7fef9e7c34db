"""Run registered queries in Spark and their statements in DuckDB and compare the rows.

    python tests/oracle.py [sf_dir] [query ...]
"""

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')"
        )
    return connection


def _value(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_value(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_value(row[i]) for i in order) for row in rows]
    return sorted(columns), sorted(out, key=repr)


def compare(frame, connection, sql) -> str:
    """Empty string if both sides have the same columns and rows, else the difference."""
    mine, got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    relation = connection.sql(sql)
    names, expected = rows_of(relation.columns, relation.fetchall())
    if mine != names:
        return f"columns {mine} != {names}"
    if len(got) != len(expected):
        return f"{len(got)} rows != {len(expected)} rows"
    types = [[type(v) for v in r] for r in (got[:1] + expected[:1])]
    if types and types[0] != types[-1]:
        return f"types {got[0]} != {expected[0]}"
    wrong = [(a, b) for a, b in zip(got, expected) if a != b]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else ""


def main(argv):
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as driver
    from lyrascope.session import build_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = build_session("oracle", 8)
    connection = duck(sf_dir)
    sql = driver.oracle_sql()
    bad = []
    for name, query in driver.queries().items():
        if argv[1:] and name not in argv[1:]:
            continue
        start = time.time()
        if name in sql:
            try:
                problem = compare(query(spark, sf_dir), connection, sql[name])
            except Exception as error:  # report and go on with the next query
                problem = f"{type(error).__name__}: {str(error)[:600]}"
        else:
            problem = "" if query(spark, sf_dir).count() else "no rows"
        print(f"{name:28s} {time.time() - start:6.1f}s {problem or 'ok'}", flush=True)
        if problem:
            bad.append(name)
    print("FAILED " + " ".join(bad) if bad else "all ok")
    return len(bad)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
