"""Every query of the operators against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from thalweg.plans import catalogue


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


def canonical(frame):
    frame = frame[sorted(frame.columns)]
    clean = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else (round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v)
    rows = [tuple(clean(v.item() if hasattr(v, "item") else v) for v in row) for row in frame.itertuples(index=False)]
    return sorted(rows, key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, sf_dir, name):
    ours = catalogue.queries()[name](spark, sf_dir).toPandas()
    theirs = duck.execute(catalogue.oracle_sql()[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canonical(ours) == canonical(theirs)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_gives_rows(spark, sf_dir, name):
    assert catalogue.queries()[name](spark, sf_dir).count() > 0
