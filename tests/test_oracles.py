"""Every query that has SQL must return the same rows as DuckDB on the smallest tables."""

import pytest
from oracle_check import compare, connect

from tissuegrid.plans import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, con, name):
    ok, message = compare(spark, con, FOLDER, catalog.QUERIES[name], catalog.ORACLES[name])
    if "0 rows" == message:
        pytest.skip("no rows at this scale")
    assert ok, message


def test_registry_is_consistent():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert len(catalog.QUERIES) > 100


def test_domain_adaptation_takes_every_reference_cell(spark, monkeypatch):
    from tissuegrid.operators import cvae

    seen = {}

    def adapt(st, sc, axis, n_types, config):
        seen.update(cells=sc.select("id").distinct().count(), samples=config.samples)
        return None, spark.createDataFrame([], "id long, v array<double>"), None

    monkeypatch.setattr(cvae, "adapt_domains", adapt)
    catalog.QUERIES["domain_adaptation"](spark, FOLDER)
    # Customers without an order line have no counts.
    ordered = spark.read.parquet(f"{FOLDER}/orders.parquet").join(
        spark.read.parquet(f"{FOLDER}/lineitem.parquet").selectExpr("l_orderkey AS o_orderkey"), "o_orderkey", "left_semi")
    assert seen == {"cells": ordered.select("o_custkey").distinct().count(), "samples": cvae.CvaeConfig().samples}
