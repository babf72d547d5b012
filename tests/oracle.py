"""Compare a Spark query with its DuckDB SQL: columns by name, rows in any order."""

import math
from pathlib import Path

import duckdb

DATA = "/root/testdata/sf0.001"


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return round(float(value), 6)
    return str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted((tuple(_plain(r[k]) for k in order) for r in data), key=repr)


def assert_same(spark, query, sql, data=DATA):
    frame = query(spark, data)
    mine = rows(frame.columns, frame.collect())
    con = duckdb.connect()
    for path in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    cursor = con.execute(sql)
    theirs = rows([d[0] for d in cursor.description], cursor.fetchall())
    assert mine[0] == theirs[0]
    assert len(mine[1]) == len(theirs[1])
    assert mine[1] == theirs[1]
