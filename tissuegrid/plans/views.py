"""How the bundled star-schema tables stand in for spatial and single-cell data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tissuegrid.session import materialize
from tissuegrid.sources.tables import Tables

# The same views in SQL, for the oracles.
ST = ("SELECT l_suppkey AS id, l_partkey AS gene, sum(l_quantity) AS value"
      " FROM lineitem GROUP BY 1, 2")
SC = ("SELECT o_custkey AS id, l_partkey AS gene, sum(l_quantity) AS value"
      " FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2")
SC_BRAND = ("SELECT o_custkey AS id, p_brand AS gene, sum(l_quantity) AS value"
            " FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
            " JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")
ST_BRAND = ("SELECT l_suppkey AS id, p_brand AS gene, sum(l_quantity) AS value"
            " FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")
TYPES = "SELECT c_custkey AS id, c_mktsegment AS cell_type FROM customer"
EMB = ("SELECT vec_id AS id, label, embedding::DOUBLE[] AS v, embedding[1]::DOUBLE AS x,"
       " embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings")


def shared(df: DataFrame) -> DataFrame:
    """Count tables that a query reads more than once are computed once."""
    return materialize(df, "counts")


def st_counts(t: Tables) -> DataFrame:
    """Spots are suppliers, genes are parts."""
    return t.lineitem.groupBy(F.col("l_suppkey").alias("id"), F.col("l_partkey").alias("gene")).agg(
        F.sum("l_quantity").alias("value")
    )


def _sold(t: Tables) -> DataFrame:
    orders = t.orders.select("o_orderkey", "o_custkey")
    return t.lineitem.select("l_orderkey", "l_partkey", "l_quantity").join(
        orders, F.col("l_orderkey") == F.col("o_orderkey")
    )


def sc_counts(t: Tables) -> DataFrame:
    """Reference cells are customers, genes are parts."""
    return _sold(t).groupBy(F.col("o_custkey").alias("id"), F.col("l_partkey").alias("gene")).agg(
        F.sum("l_quantity").alias("value")
    )


def _brands(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", "p_brand")


def sc_brand_counts(t: Tables) -> DataFrame:
    """A short, dense gene axis: brands."""
    return _sold(t).join(_brands(t), F.col("l_partkey") == F.col("p_partkey")).groupBy(
        F.col("o_custkey").alias("id"), F.col("p_brand").alias("gene")
    ).agg(F.sum("l_quantity").alias("value"))


def st_brand_counts(t: Tables) -> DataFrame:
    return t.lineitem.join(_brands(t), F.col("l_partkey") == F.col("p_partkey")).groupBy(
        F.col("l_suppkey").alias("id"), F.col("p_brand").alias("gene")
    ).agg(F.sum("l_quantity").alias("value"))


def types(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("cell_type"))


def cells(t: Tables) -> DataFrame:
    """Cells with a 64-d feature vector; the first components serve as coordinates."""
    vec = F.transform("embedding", lambda e: e.cast("double"))
    return t.embeddings.select(
        F.col("vec_id").alias("id"), "label", vec.alias("v"),
        vec[0].alias("x"), vec[1].alias("y"), vec[2].alias("z"),
    )
