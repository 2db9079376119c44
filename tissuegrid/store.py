"""Results of a stage kept for later runs: tables, parameter arrays and values under one manifest.

A bundle is a folder with a Parquet table per part and one for all arrays. Its manifest names the parts;
it is written last, so a folder without one is the rest of a run that failed. A bundle that replaces
another is written beside it under a new generation and the manifest switched over, so readers of the old
one are not disturbed until ``clean`` removes what no manifest names.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, fields, is_dataclass
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tissuegrid.sources.tables import write_table

#: Raised when the layout of bundles changes; readers refuse what they do not know.
VERSION = 1
MANIFEST = "version int, kind string, generation string, part string, form string, value string"
ARRAYS = "name string, shape array<int>, dtype string, value binary"


@dataclass
class Bundle:
    """What a stage leaves: ``tables``, ``arrays`` and plain ``values``, of one ``kind``."""

    kind: str
    tables: dict[str, DataFrame]
    arrays: dict[str, np.ndarray]
    values: dict[str, Any]


def save(spark: SparkSession, path: str, bundle: Bundle) -> None:
    """Write a bundle; the folder may hold an earlier one, which is replaced at the end."""
    clash = set(bundle.tables) & (set(bundle.arrays) | set(bundle.values)) | set(bundle.arrays) & set(bundle.values)
    if clash:
        raise ValueError(f"parts named twice: {', '.join(sorted(clash))}")
    generation = uuid.uuid4().hex
    home = f"{path.rstrip('/')}/{generation}"
    for name, table in bundle.tables.items():
        write_table(table, f"{home}/{name}")
    if bundle.arrays:
        rows = [(n, list(a.shape), a.dtype.str, np.ascontiguousarray(a).tobytes()) for n, a in bundle.arrays.items()]
        write_table(spark.createDataFrame(rows, ARRAYS), f"{home}/_arrays")
    parts = [(n, "table", t.schema.json()) for n, t in bundle.tables.items()]
    parts += [(n, "array", None) for n in bundle.arrays]
    parts += [(n, "value", json.dumps(v)) for n, v in bundle.values.items()]
    manifest = [(VERSION, bundle.kind, generation, *p) for p in parts or [(None, "empty", None)]]
    # One small file, swapped in at the end.
    spark.createDataFrame(manifest, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/manifest")


def load(spark: SparkSession, path: str, kind: str) -> Bundle:
    """Read a bundle of that ``kind``; raises where there is none, or another kind or version."""
    root = path.rstrip("/")
    if not _exists(spark, f"{root}/manifest/_SUCCESS"):
        raise FileNotFoundError(f"no finished bundle in {path}")
    rows = spark.read.schema(MANIFEST).parquet(f"{root}/manifest").collect()
    if {r["version"] for r in rows} != {VERSION}:
        raise ValueError(f"{path}: bundle version {rows[0]['version']}, this reads {VERSION}")
    if rows[0]["kind"] != kind:
        raise ValueError(f"{path} holds {rows[0]['kind']}, not {kind}")
    home = f"{root}/{rows[0]['generation']}"
    from pyspark.sql.types import StructType

    tables = {r["part"]: spark.read.schema(StructType.fromJson(json.loads(r["value"]))).parquet(f"{home}/{r['part']}")
              for r in rows if r["form"] == "table"}
    arrays = {}
    if any(r["form"] == "array" for r in rows):
        for r in spark.read.schema(ARRAYS).parquet(f"{home}/_arrays").collect():
            arrays[r["name"]] = np.frombuffer(bytes(r["value"]), dtype=r["dtype"]).reshape(r["shape"]).copy()
    values = {r["part"]: json.loads(r["value"]) for r in rows if r["form"] == "value"}
    return Bundle(kind, tables, arrays, values)


def holds(spark: SparkSession, path: str, kind: str) -> bool:
    """Whether a finished bundle of that kind and of this version is there."""
    root = path.rstrip("/")
    if not _exists(spark, f"{root}/manifest/_SUCCESS"):
        return False
    return not spark.read.schema(MANIFEST).parquet(f"{root}/manifest").where(
        (F.col("kind") == kind) & (F.col("version") == VERSION)).isEmpty()


def clean(spark: SparkSession, path: str) -> list[str]:
    """Delete the generations that the manifest does not name; returns their names. Not while others read or write."""
    root = path.rstrip("/")
    current = {r["generation"] for r in spark.read.schema(MANIFEST).parquet(f"{root}/manifest").collect()}
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(root).getFileSystem(spark._jsc.hadoopConfiguration())
    old = [s.getPath() for s in fs.listStatus(hadoop(root)) if s.getPath().getName() not in current | {"manifest"}]
    for p in old:
        fs.delete(p, True)
    return sorted(p.getName() for p in old)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def settings_of(config: Any) -> dict[str, Any]:
    """A settings dataclass as plain values."""
    return asdict(config) if is_dataclass(config) else dict(config)


def settings_as(kind: type, values: dict[str, Any]) -> Any:
    """A settings dataclass from stored values; pairs come back as tuples, unknown names are an error."""
    known = {f.name for f in fields(kind)}
    if set(values) - known:
        raise ValueError(f"unknown settings {', '.join(sorted(set(values) - known))}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})
