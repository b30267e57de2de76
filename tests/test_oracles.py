"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from sieveline.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*' if os.path.isdir(p) else p}')")
    return c


def rows(frame):
    def text(v):
        if v is None or v != v:
            return "~"
        if isinstance(v, float) and v == int(v):
            return str(int(v))
        return str(v)

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(map(text, r)) for r in frame.where(frame.notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_sql(spark, duck, name):
    ours, theirs = catalog.QUERIES[name](spark, SF).toPandas(), duck.sql(catalog.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert len(theirs) > 0
    assert rows(ours) == rows(theirs)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_library_does_not_import_the_subpackage():
    import pathlib

    root = pathlib.Path(catalog.__file__).parents[1]
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "llm" in p.read_text()]
