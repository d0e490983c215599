"""Every registered query of the engine against its SQL, on the smallest tables."""

import duckdb
import pytest

from rasterloom import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def rows(df):
    cols = sorted(df.columns)
    clean = df[cols].astype(object).where(df[cols].notna(), None)
    return cols, sorted(tuple("" if v is None else repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in clean.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, sf_dir, name):
    got = queries.QUERIES[name](spark, sf_dir).toPandas()
    if name in queries.ORACLES:
        assert rows(got) == rows(con.sql(queries.ORACLES[name]).df())
    else:
        assert len(got) > 0


def test_every_image_of_the_virtual_raster_is_traced(spark, sf_dir):
    got = queries.vectorize_images(spark, sf_dir).collect()
    assert all(r["status"] == "ok" and r["dropped_regions"] == 0 and r["repaired_regions"] == 0 for r in got)


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
