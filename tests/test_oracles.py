"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from gridloom.plans import properties, registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def normal(frame):
    def one(v):
        if v is None or v != v:
            return "null"
        if hasattr(v, "item"):
            v = v.item()
        return f"{float(v):.6g}" if isinstance(v, int | float) else str(v)

    columns = sorted(frame.columns)
    return columns, sorted(tuple(one(v) for v in row) for row in frame[columns].itertuples(index=False))


#: Each solves anew what other queries solve: of these, two stand for all here.
AGAIN = {f"{n}_is_final" for n in properties.STOPS} | {f"{n}_is_connected" for n in properties.CONNECTED}
AGAIN -= {"gasp_mean_is_final", "edge_weighted_agglomeration_is_connected"}


@pytest.mark.parametrize("name", sorted(set(registry.ORACLES) - AGAIN))
def test_query_matches_sql(name, spark, db):
    assert normal(registry.QUERIES[name](spark, SF).toPandas()) == normal(db.execute(registry.ORACLES[name]).fetch_df())
