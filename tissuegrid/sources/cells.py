"""Readers for segmentation results, boundaries, images and probabilities."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tissuegrid.functions.scalars import homography
from tissuegrid.operators.ranking import hash_uniform, row_numbers
from tissuegrid.sources.records import RANGE, read_records
from tissuegrid.sources.tables import require_columns
from tissuegrid.sources.tiles import as_rgb, ranged_tiles

_FEATURE = "geometry struct<type: string, coordinates: string>, properties struct<measurements: map<string,double>>"
_NUCLEUS = "contour array<array<double>>, centroid array<double>, type int"
_RING = "array<array<double>>"

SLIDE_TYPES = (".svs", ".tif", ".ndpi")
PROBABILITY_NAMES = ("detection_probability", "probability", "detection_prob")


def _points(ring: Column) -> Column:
    return F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def read_geojson(spark: SparkSession, path: str, lines: bool = False, range_bytes: int = RANGE) -> DataFrame:
    """``(file, pos, polygon, rings, measurements)`` per feature; unreadable features are dropped.

    A file is one feature collection, read by ranges of ``range_bytes`` in as many tasks, or with
    ``lines=True`` one feature per line. ``pos`` orders the features of a file. ``rings`` are all rings of
    a polygon or of the parts of a multipolygon, ``polygon`` the first of them.
    """
    if lines:
        raw = spark.read.text(path).select(
            F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("pos"), F.col("value").alias("record"))
    else:
        raw = read_records(spark, path, range_bytes=range_bytes)
    rows = raw.select("file", "pos", F.from_json("record", _FEATURE).alias("f"))
    shape = F.col("f.geometry.coordinates")
    parts = F.flatten(F.from_json(shape, f"array<array<{_RING}>>"))
    rings = F.when(F.col("f.geometry.type") == "MultiPolygon", parts).otherwise(F.from_json(shape, f"array<{_RING}>"))
    rows = rows.select("file", "pos", F.transform(rings, _points).alias("rings"), F.col("f.properties.measurements").alias("measurements"))
    return rows.select("file", "pos", F.try_element_at("rings", F.lit(1)).alias("polygon"), "rings", "measurements").where(
        "polygon IS NOT NULL AND measurements IS NOT NULL AND size(polygon) > 0")


def measurement_names(features: DataFrame) -> list[str]:
    """Columns of the feature table: every name that any feature carries, in order of name."""
    names = features.select(F.explode(F.map_keys("measurements")).alias("k")).distinct()
    return sorted(r["k"] for r in names.collect())


def number_cells(cells: DataFrame, order: Sequence[str], prefix: str = "cell_") -> DataFrame:
    """``cell_0, cell_1, ...`` in file order over the kept rows."""
    numbered = row_numbers(cells, [F.col(c) for c in order], "_rn")
    return numbered.withColumn("cell_id", F.concat(F.lit(prefix), (F.col("_rn") - 1).cast("string"))).drop("_rn")


def read_nuclei(
    spark: SparkSession, path: str, detection_mag: int = 40, slide_mag: int = 40, share: float = 1.0, seed: int = 0,
    range_bytes: int = RANGE,
) -> DataFrame:
    """Nucleus map JSON: ``(file, nucleus_id, contour, polygon, centroid, type)`` at slide scale.

    Contours and centroids are floor-divided for the pixel grid, the polygon is divided exactly.
    ``share`` below 1 asks for that part of the nuclei, drawn by a hash of file and id. A file is read by
    ranges of ``range_bytes`` in as many tasks; entries with neither contour nor centroid are dropped.
    """
    ratio = detection_mag / slide_mag
    raw = read_records(spark, path, named=True, range_bytes=range_bytes)
    rows = raw.select("file", F.col("name").alias("nucleus_id"), F.from_json("record", _NUCLEUS).alias("f")).where(
        "f.contour IS NOT NULL OR f.centroid IS NOT NULL")
    if share < 1:
        rows = rows.where(hash_uniform(F.concat_ws("/", "file", "nucleus_id"), seed) < share)
    floor = lambda v: F.floor(v / ratio).cast("double")
    return rows.select(
        "file", "nucleus_id",
        F.transform("f.contour", lambda p: F.struct(floor(p[0]).alias("x"), floor(p[1]).alias("y"))).alias("contour"),
        F.transform("f.contour", lambda p: F.struct((p[0] / ratio).alias("x"), (p[1] / ratio).alias("y"))).alias("polygon"),
        F.transform("f.centroid", floor).alias("centroid"), F.col("f.type").alias("type"))


def read_boundaries(
    spark: SparkSession, path: str, alignment: Sequence[Sequence[float]] | None = None, scale: float = 1.0, ring: str | None = None,
) -> DataFrame:
    """Vertex table ``(cell_id, ring, seq, x, y)`` in image space; ``seq`` is the row position in the file.

    ``ring`` names the column that numbers the rings of a cell; without one each cell has a single ring.
    """
    needed = ["cell_id", "vertex_x", "vertex_y", *([ring] if ring else [])]
    raw = require_columns(spark.read.parquet(path), needed, "boundaries")
    x, y = F.col("vertex_x") / scale, F.col("vertex_y") / scale
    if alignment is not None:
        x, y = homography(x, y, np.linalg.inv(np.asarray(alignment, float)).tolist())
    number = F.col(ring).cast("long") if ring else F.lit(0).cast("long")
    return raw.select(F.col("cell_id").cast("string").alias("cell_id"), number.alias("ring"),
                      F.col("_metadata.row_index").alias("seq"), x.alias("x"), y.alias("y"))


def read_probabilities(spark: SparkSession, path: str) -> DataFrame | None:
    """``(cell_id, probability)`` from a comma or tab table; None when no known column is present."""
    header = spark.read.text(path).first()
    if header is None:
        return None
    sep = "\t" if "\t" in header[0] else ","
    raw = spark.read.option("header", True).option("sep", sep).csv(path)
    raw = raw.toDF(*[c.strip().lower().replace(" ", "_") for c in raw.columns])
    found = next((c for c in PROBABILITY_NAMES if c in raw.columns), None)
    if "cell_id" not in raw.columns or found is None:
        return None
    return raw.select("cell_id", F.col(found).try_cast("double").alias("probability"))


def with_probability(cells: DataFrame, probabilities: DataFrame | None) -> DataFrame:
    if probabilities is None:
        return cells.withColumn("probability", F.lit(1.0))
    return cells.join(probabilities, "cell_id", "left").withColumn("probability", F.coalesce("probability", F.lit(1.0)))


def find_slide(spark: SparkSession, folder: str, stem: str) -> str | None:
    """First match of: the name itself, the name with a known type, the same one folder below."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    base, ext = os.path.splitext(stem)
    names = [stem] + [base + e for e in SLIDE_TYPES] if ext else [stem, *[stem + e for e in SLIDE_TYPES]]
    for pattern in [*names, *[f"*/{n}" for n in names]]:
        hits = fs.globStatus(jvm.org.apache.hadoop.fs.Path(root, pattern)) or []
        files = sorted(h.getPath().toString() for h in hits if h.isFile())
        if files:
            return files[0]
    return None


def decode_image(data: bytes) -> np.ndarray:
    """Pixels of an encoded image. Binary netpbm is read directly, other formats need Pillow."""
    if data[:2] in (b"P5", b"P6"):
        kind, width, height, _, body = data.split(maxsplit=4) if data[3:4] != b"#" else (b"", 0, 0, 0, b"")
        bands = 3 if kind == b"P6" else 1
        size = int(width) * int(height) * bands
        return np.frombuffer(data[-size:], np.uint8).reshape(int(height), int(width), bands)
    try:
        import io

        from PIL import Image
    except ImportError as exc:
        raise RuntimeError("decoding this image format needs Pillow") from exc
    return np.asarray(Image.open(io.BytesIO(data)))


def read_tiles(spark: SparkSession, path: str, size: int = 256, decode: Callable | None = None) -> DataFrame:
    """``(image_id, tx, ty, width, height, rgb)``: image files cut into raw RGB tiles.

    Grey images become RGB, bands beyond three are dropped. Edge tiles are padded with white. Netpbm and
    plain or deflated TIFF files are read by range, a bounded part in each task. Any other file, or every
    file where ``decode`` is given, is decoded as a whole in one task.
    """
    if decode is not None:
        return _decoded_tiles(spark, [path], size, decode)
    ranged, others = ranged_tiles(spark, path, size)
    if not others:
        return ranged
    whole = _decoded_tiles(spark, others, size, decode_image)
    return whole if ranged is None else ranged.unionByName(whole)


def _decoded_tiles(spark: SparkSession, paths: list[str], size: int, decode: Callable) -> DataFrame:
    files = spark.read.format("binaryFile").load(paths).select("path", "content")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                img = decode(content)
                img = img[..., None] if img.ndim == 2 else img
                img = as_rgb(img)
                h, w = img.shape[:2]
                for ty in range(-(-h // size)):
                    for tx in range(-(-w // size)):
                        part = img[ty * size:(ty + 1) * size, tx * size:(tx + 1) * size]
                        tile = np.full((size, size, 3), 255, np.uint8)
                        tile[:part.shape[0], :part.shape[1]] = part
                        yield pd.DataFrame([(os.path.basename(name), tx, ty, w, h, tile.tobytes())],
                                           columns=["image_id", "tx", "ty", "width", "height", "rgb"])

    return files.mapInPandas(cut, "image_id string, tx int, ty int, width int, height int, rgb binary")


def tiles_from_pixels(pixels: DataFrame, size: int = 256) -> DataFrame:
    """Tiles from a pixel table ``(image_id, px, py, r, g, b)``; missing pixels are white."""
    at = pixels.select(
        "image_id", F.floor(F.col("px") / size).cast("int").alias("tx"), F.floor(F.col("py") / size).cast("int").alias("ty"),
        (F.col("px") % size).cast("int").alias("ix"), (F.col("py") % size).cast("int").alias("iy"), "r", "g", "b")
    extent = pixels.groupBy("image_id").agg((F.max("px") + 1).cast("int").alias("width"), (F.max("py") + 1).cast("int").alias("height"))

    def paint(key: tuple[Any, ...], g: pd.DataFrame) -> pd.DataFrame:
        tile = np.full((size, size, 3), 255, np.uint8)
        tile[g["iy"], g["ix"]] = g[["r", "g", "b"]].to_numpy(np.uint8)
        return pd.DataFrame([(*key, tile.tobytes())], columns=["image_id", "tx", "ty", "rgb"])

    painted = at.groupBy("image_id", "tx", "ty").applyInPandas(paint, "image_id string, tx int, ty int, rgb binary")
    return painted.join(extent, "image_id").select("image_id", "tx", "ty", "width", "height", "rgb")
