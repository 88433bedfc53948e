"""Every registered query with SQL gives DuckDB's rows over the same tables."""

from __future__ import annotations

import glob

import duckdb
import pytest

from navspark import registry


def plain(value):
    if hasattr(value, "item"):
        value = value.item()
    if value is None or str(value) in ("<NA>", "NaT", "nan"):
        return None
    return float(value) if isinstance(value, int | float) else str(value)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        db.execute(f"create view {p.split('/')[-1][:-8]} as select * from '{p}'")
    got, want = registry.QUERIES[name](spark, sf_dir).toPandas(), db.execute(registry.SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
