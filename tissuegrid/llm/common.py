"""Session settings, table access and connected components shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tissuegrid.session import materialize, prepare, release

#: Rows per Arrow batch: whole texts are kept few at a time in a Python worker.
ARROW_ROWS = 1024


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the corpus, read by Spark alone so that any file system it knows will do."""
    prepare(spark)
    limit_batches(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def limit_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def with_missing(df: DataFrame, **types: str) -> DataFrame:
    """Add absent columns as nulls, so that operators may name them."""
    for name, kind in types.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def connected(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest node reachable from each node of an undirected edge table (``a``, ``b`` long).

    Returns (``node``, ``component``) for every node that has an edge. Alternates two steps until
    nothing moves: every node's neighbours greater than it are tied to its smallest neighbour, then
    the smaller ones are. Each keeps components intact, shrinks distances geometrically and leaves
    stars. Rounds are written as stage tables, so lost executors repeat one round at most; a node
    with very many edges is only ever the key of a minimum (combined before the shuffle) and of a
    join whose large partitions are split.
    """
    now = materialize(_canonical(edges), "edges")
    for _ in range(max_rounds):
        if _is_settled(now):
            break
        large = materialize(_step(now, larger=True), "edges")
        small = materialize(_step(large, larger=False), "edges")
        release(large)
        release(now)
        now = small
    else:
        raise RuntimeError("connected components did not settle")
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    leaves = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return leaves.unionByName(roots)


def _canonical(edges: DataFrame) -> DataFrame:
    """Distinct edges from the greater to the smaller node, loops left out."""
    return (
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b"))
        .distinct()
    )


def _step(edges: DataFrame, larger: bool) -> DataFrame:
    """Large-star or small-star: tie neighbours of a node to the least node in its neighbourhood."""
    around = edges.select(F.col("a").alias("n"), F.col("b").alias("v"))
    if larger:
        around = around.unionByName(edges.select(F.col("b").alias("n"), F.col("a").alias("v")))
    least = around.groupBy("n").agg(F.min("v").alias("m")).withColumn("m", F.least("n", "m"))
    least = least.select("n", "m")
    tied = around.join(least, "n")
    if larger:
        tied = tied.where(F.col("v") > F.col("n")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        # Below a node only smaller neighbours are listed; the node itself is tied as well.
        tied = tied.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("n").alias("a"), F.col("m").alias("b")))
    return _canonical(tied)


def _is_settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: no node is tied to two others, no centre is tied to another."""
    tied = edges.select(F.col("a").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("into"))
    centres = edges.select(F.col("b").alias("n"), F.lit(0).alias("out"), F.lit(1).alias("into"))
    loose = tied.unionByName(centres).groupBy("n").agg(
        F.sum("out").alias("out"), F.sum("into").alias("into")).where("out > 1 or (out > 0 and into > 0)")
    return loose.isEmpty()
