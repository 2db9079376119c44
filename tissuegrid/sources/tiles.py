"""Large images as tiles, each task reading only the bytes of its own part.

Binary netpbm files and 8-bit TIFF files (classic or big, in tiles or strips, plain or deflated) say
where their pixels lie, so a slide is cut into parts of one row of tiles and a bounded number of columns,
and a part is read by ranges. Memory and input of a task depend on the tile size, not on the image;
only a TIFF strip is as wide as the image. Other formats are left to a decoder of the whole file.

Files are read through ``pyarrow.fs``, so the path must be one that it or the operating system knows.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tissuegrid.sources.records import RangedFile, list_files

#: Tiles side by side in one part, and files whose heads one task reads.
SPAN, HEADS = 32, 64

# TIFF tags and the bytes of their value types: fixed values of the format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, STRIP_ROWS, STRIP_SIZES = 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_SIZES = 284, 317, 322, 323, 324, 325
TYPES = {1: "B", 3: "H", 4: "I", 16: "Q"}
PLAIN, DEFLATED = (1,), (8, 32946)


@dataclass
class Layout:
    """Where the pixels of an image lie: in a grid of chunks of ``tall`` x ``wide`` pixels."""

    width: int
    height: int
    bands: int
    wide: int
    tall: int
    offsets: np.ndarray | None = None  # None: rows follow each other from ``body``
    sizes: np.ndarray | None = None
    body: int = 0
    deflated: bool = False
    predicted: bool = False


def layout(file: RangedFile) -> Layout | None:
    """Layout of a file whose pixels can be read by range, None for any other."""
    head = file.read(0, 4)
    if head[:2] in (b"P5", b"P6"):
        return _netpbm(file, 1 if head[:2] == b"P5" else 3)
    if head in (b"II*\0", b"MM\0*", b"II+\0", b"MM\0+"):
        return _tiff(file, "<" if head[:2] == b"II" else ">", head[2:].strip(b"\0") == b"+")
    return None


def _netpbm(file: RangedFile, bands: int) -> Layout | None:
    numbers, at = [], 2
    while len(numbers) < 3:
        byte = file.read(at, at + 1)
        if not byte:
            return None
        if byte == b"#":
            while file.read(at, at + 1) not in (b"\n", b""):
                at += 1
        elif byte.isdigit():
            text = b""
            while byte.isdigit():
                text += byte
                at += 1
                byte = file.read(at, at + 1)
            numbers.append(int(text))
            continue
        at += 1
    width, height, most = numbers
    # The body starts after a single white space; larger values take two bytes a sample.
    return Layout(width, height, bands, width, height, body=at + 1) if most < 256 else None


def _tiff(file: RangedFile, order: str, big: bool) -> Layout | None:
    word, count, entry = ("Q", "Q", 20) if big else ("I", "H", 12)
    room = struct.calcsize(word)
    start = struct.unpack(order + word, file.read(8 if big else 4, (8 if big else 4) + room))[0]
    n = struct.unpack(order + count, file.read(start, start + struct.calcsize(count)))[0]
    at = start + struct.calcsize(count)
    raw = file.read(at, at + n * entry)
    tags: dict[int, np.ndarray] = {}
    for i in range(n):
        tag, kind, items = struct.unpack(order + "HH" + word, raw[i * entry:i * entry + 4 + room])
        if kind not in TYPES:
            continue
        value = raw[i * entry + 4 + room:(i + 1) * entry]
        size = items * struct.calcsize(TYPES[kind])
        if size > room:
            value = file.read(struct.unpack(order + word, value)[0], struct.unpack(order + word, value)[0] + size)
        tags[tag] = np.frombuffer(value[:size], dtype=order + TYPES[kind].replace("B", "u1").replace("H", "u2").replace(
            "I", "u4").replace("Q", "u8")).astype(np.int64)
    one = lambda tag, default: int(tags[tag][0]) if tag in tags else default
    bands, packed = one(SAMPLES, 1), one(COMPRESSION, 1)
    plain = set(tags.get(BITS, np.array([1])).tolist()) == {8} and one(PLANAR, 1) == 1 and one(PREDICTOR, 1) in (1, 2)
    if not plain or packed not in (*PLAIN, *DEFLATED) or one(PHOTOMETRIC, 1) not in (1, 2) or WIDTH not in tags or HEIGHT not in tags:
        return None
    width, height = one(WIDTH, 0), one(HEIGHT, 0)
    tiled = TILE_OFFSETS in tags
    return Layout(
        width, height, bands, one(TILE_WIDTH, width) if tiled else width,
        one(TILE_HEIGHT, height) if tiled else min(height, one(STRIP_ROWS, height)),
        tags[TILE_OFFSETS if tiled else STRIP_OFFSETS], tags[TILE_SIZES if tiled else STRIP_SIZES],
        deflated=packed in DEFLATED, predicted=one(PREDICTOR, 1) == 2)


def region(file: RangedFile, at: Layout, x0: int, x1: int, y0: int, y1: int) -> np.ndarray:
    """Pixels of a rectangle, as stored."""
    out = np.zeros((y1 - y0, x1 - x0, at.bands), np.uint8)
    if at.offsets is None:
        for y in range(y0, y1):
            row = at.body + (y * at.width + x0) * at.bands
            out[y - y0] = np.frombuffer(file.read(row, row + (x1 - x0) * at.bands), np.uint8).reshape(-1, at.bands)
        return out
    across = -(-at.width // at.wide)
    for cy in range(y0 // at.tall, -(-y1 // at.tall)):
        for cx in range(x0 // at.wide, -(-x1 // at.wide)):
            chunk, left, top = _chunk(file, at, cy * across + cx, cy), cx * at.wide, cy * at.tall
            a, b = max(x0, left), min(x1, left + at.wide)
            c, d = max(y0, top), min(y1, top + len(chunk))
            out[c - y0:d - y0, a - x0:b - x0] = chunk[c - top:d - top, a - left:b - left]
    return out


def _chunk(file: RangedFile, at: Layout, number: int, row: int) -> np.ndarray:
    start = int(at.offsets[number])
    raw = file.read(start, start + int(at.sizes[number]))
    raw = zlib.decompress(raw) if at.deflated else raw
    # The last strip holds only the rows that are left; tiles are always whole.
    tall = at.tall if at.wide < at.width or len(raw) >= at.tall * at.wide * at.bands else at.height - row * at.tall
    pixels = np.frombuffer(raw, np.uint8)[:tall * at.wide * at.bands].reshape(tall, at.wide, at.bands)
    return np.cumsum(pixels, axis=1, dtype=np.uint8) if at.predicted else pixels


def as_rgb(pixels: np.ndarray) -> np.ndarray:
    return np.repeat(pixels[..., :1], 3, axis=2) if pixels.shape[2] < 3 else pixels[..., :3]


@dataclass
class Part(InputPartition):
    """Tiles ``tx0`` to ``tx1`` of row ``ty`` of one image."""

    file: str
    tx0: int
    tx1: int
    ty: int


@dataclass
class Heads(InputPartition):
    files: list[str]


class ImageTiles(DataSource):
    """``image_tiles``: RGB tiles of images that can be read by range, or the sizes of all images."""

    @classmethod
    def name(cls) -> str:
        return "image_tiles"

    def schema(self) -> str:
        if self.options["what"] == "heads":
            return "file string, width int, height int"
        return "image_id string, tx int, ty int, width int, height int, rgb binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.what, self.parts, self.size = options["what"], options["parts"], int(options["size"])

    def partitions(self) -> list[InputPartition]:
        return [Heads(p) if self.what == "heads" else Part(*p) for p in json.loads(self.parts)]

    def read(self, part):
        return self._heads(part) if self.what == "heads" else self._tiles(part)

    def _heads(self, part: Heads) -> Iterator[tuple]:
        for name in part.files:
            at = layout(RangedFile(name))
            yield (name, None, None) if at is None else (name, at.width, at.height)

    def _tiles(self, part: Part) -> Iterator[tuple]:
        file, size = RangedFile(part.file), self.size
        at = layout(file)
        y0, y1 = part.ty * size, min(at.height, (part.ty + 1) * size)
        x0, x1 = part.tx0 * size, min(at.width, part.tx1 * size)
        pixels = as_rgb(region(file, at, x0, x1, y0, y1))
        for tx in range(part.tx0, part.tx1):
            cut = pixels[:, tx * size - x0:(tx + 1) * size - x0]
            tile = np.full((size, size, 3), 255, np.uint8)
            tile[:cut.shape[0], :cut.shape[1]] = cut
            yield os.path.basename(part.file), tx, part.ty, at.width, at.height, tile.tobytes()


def ranged_tiles(spark: SparkSession, path: str, size: int = 256, span: int = SPAN) -> tuple[DataFrame | None, list[str]]:
    """``(image_id, tx, ty, width, height, rgb)`` of the images that can be read by range, and the other files.

    The driver holds one entry per part, as it does for the tasks themselves.
    """
    spark.dataSource.register(ImageTiles)
    source = spark.read.format("image_tiles").option("size", size)
    files = [f for f, _ in list_files(spark, path)]
    heads = source.option("what", "heads").option("parts", json.dumps(
        [files[i:i + HEADS] for i in range(0, len(files), HEADS)])).load().collect()
    parts = [(h["file"], tx, min(tx + span, across), ty) for h in sorted(heads) if h["width"] is not None
             for across in [-(-h["width"] // size)] for ty in range(-(-h["height"] // size)) for tx in range(0, across, span)]
    others = sorted(h["file"] for h in heads if h["width"] is None)
    return source.option("what", "tiles").option("parts", json.dumps(parts)).load() if parts else None, others
