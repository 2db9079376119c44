"""Keyed-table sources and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """Lazy access to a folder with one Parquet file (or folder) per table."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def require_columns(df: DataFrame, columns: Sequence[str], what: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what}: missing column(s) {', '.join(missing)}")
    return df


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Feature and expression sink: zstd Parquet, replaced as a whole."""
    writer = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Label and factor sink."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Stage tables kept as CSV; ids are declared as strings by the caller's schema."""
    return spark.read.schema(schema).option("header", True).csv(path)
