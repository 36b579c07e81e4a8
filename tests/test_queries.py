"""Every query of the standard tables against its SQL, and the driver's contract."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from scorewright.plans import oracle, queries

from .conftest import SMALL

SQL = oracle.oracle_sql()


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)

    def plain(x):
        return None if isinstance(x, float) and math.isnan(x) else round(x, 5) if isinstance(x, float) else x

    return sorted((tuple(plain(v[k]) for k in order) for v in values), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_against_sql(spark, duck, name):
    frame = queries.queries()[name](spark, SMALL)
    got = rows(frame.columns, [tuple(r) for r in frame.collect()])
    if name in SQL:
        done = duck.execute(SQL[name])
        columns = [d[0] for d in done.description]
        assert sorted(columns) == sorted(frame.columns)
        assert got == rows(columns, done.fetchall())


def test_character_distance(spark):
    def distance(a, b):
        row = [*range(len(b) + 1)]
        for k, x in enumerate(a, 1):
            new = [k]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    from scorewright.functions.distance import with_error_rates

    pairs = [("äb", "ab"), ("größer als", "groß"), ("", "x"), ("日本語", "日語")]
    got = with_error_rates(spark.createDataFrame(pairs, "hypothesis string, reference string")).collect()
    assert [r["char_edits"] for r in got] == [distance(*p) for p in pairs]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
