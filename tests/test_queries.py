"""Every registered query against its SQL, and the driver contract."""

import pytest

import __spark_entry__ as entry_points
from checks import on_routers
from checks.catalog import QUERIES, SQL
from checks.compare import difference, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, con, name):
    assert difference(QUERIES[name](spark, SF), con, SQL[name]) is None


def test_entry_points(spark):
    assert entry_points.entry(spark).count() == 6
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert all(s.strip() for s in entry_points.oracle_sql().values())


def test_all_routers_are_reported(spark):
    rows = QUERIES["report_all_routers"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 10 and len({(r.setup, r.router) for r in rows}) == 10
    oracle = [r for r in rows if r.router == "oracle"]
    assert all(r.auroc == 1.0 for r in oracle)


@pytest.mark.parametrize("name", ["embedding_router", "score_splits_embedding", "report_all_routers"])
def test_embedding_queries_take_every_row(spark, monkeypatch, name):
    """What is fitted and scored is the whole labelled table, with a vector for each row."""
    sf, seen = "/root/testdata/sf0.01", []

    class Noted:
        def __init__(self, store):
            self.store = store

        def fit(self, table):
            seen.append((table, self.store))
            return self

        def score(self, table):
            return table.selectExpr("id", "0.5 AS score")

    monkeypatch.setattr(on_routers, "EmbeddingRouter", Noted)
    monkeypatch.setattr(on_routers, "score_splits", lambda table, splits, router, store: seen.append((table, store)))
    monkeypatch.setattr(on_routers.analyse, "score_all", lambda table, *_, embedding: seen.append((table, embedding["store"])))
    monkeypatch.setattr(on_routers.analyse, "report", lambda *_, **__: None)
    QUERIES[name](spark, sf)
    (table, store), whole = seen[0], QUERIES["length_router"](spark, sf).count()
    assert table.count() == whole == table.join(store, "id").count()
