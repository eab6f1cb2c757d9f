"""Every query against its SQL in another engine, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from marlstone.plans.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    def plain(v):
        if v is None or v is pd.NA or v != v:
            return "~"
        return f"{float(v):.5f}" if isinstance(v, int | float) and not isinstance(v, bool) else str(v)

    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple(plain(v) for v in r) for r in frame.astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def engine(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, engine, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name in SQL:
        assert rows(got) == rows(engine.execute(SQL[name]).df())
    elif name == "stream_event_fold":
        assert rows(got) == rows(QUERIES["event_fold"](spark, sf_dir).toPandas())
