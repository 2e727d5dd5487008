"""Every registered query of the package against its SQL on the smallest driver tables."""

import duckdb
import pytest

from assaykit.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple("null" if x is None or x != x else repr(round(x, 6)) if isinstance(x, float) else str(x) for x in row) for row in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, sf_dir, name):
    got = registry.QUERIES[name](spark, sf_dir).toPandas()
    if name not in registry.ORACLES:
        assert len(got.columns)
        return
    expected = duck.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert canonical(got) == canonical(expected)
