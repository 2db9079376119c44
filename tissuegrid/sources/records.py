"""Records of large JSON files, read by byte range.

One file holds one document: an object with an array of records (a feature collection) or with a map
of records by name (detected nuclei). A range can start anywhere, also inside a text. So the ranges are
first read for what they change: whether they leave a text open, and by how much they raise the nesting,
both for a start inside and outside a text. Summed up in order these give the true state at the start of
every range, and each range then yields the records that open in it, reading on to the end of the last.
Any formatting of the JSON will do.

Ranges are read through ``pyarrow.fs``, so the path must be one that it or the operating system knows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes per range, and per block that is scanned at once.
RANGE, BLOCK = 1 << 24, 1 << 20
#: Bytes before a record that are searched for its name first.
NAME_BYTES = 256

_STEP = np.zeros(256, dtype=np.int8)
_STEP[[ord("{"), ord("[")]] = 1
_STEP[[ord("}"), ord("]")]] = -1
_NAME = re.compile(rb'(?<!\\)"((?:[^"\\]|\\.)*)"\s*:\s*\Z', re.S)


@dataclass
class JsonRange(InputPartition):
    """Bytes ``start`` to ``end`` of a file, and the state the document is in at ``start``."""

    file: str
    start: int
    end: int
    inside: bool = False
    depth: int = 0


def brackets(block: np.ndarray, inside: bool, escaped: bool) -> tuple[np.ndarray, np.ndarray, bool, bool]:
    """Positions and steps (+1, -1) of the brackets outside texts, and the state after the block.

    ``escaped`` tells that the first byte follows an odd number of backslashes.
    """
    quotes = np.flatnonzero(block == 34)
    slash = block == 92
    after = False
    if escaped or slash.any():
        at = np.arange(len(block))
        # Run of backslashes up to each byte; one before the block counts.
        last = np.maximum.accumulate(np.where(slash, -1, at))
        run = np.where(last < 0, at + 1 + escaped, at - last)
        before = np.where(quotes > 0, run[quotes - 1], int(escaped))
        quotes = quotes[before % 2 == 0]
        after = bool(run[-1] % 2)
    place = np.flatnonzero(_STEP[block])
    text = (np.searchsorted(quotes, place) + inside) % 2 == 1
    place = place[~text]
    return place, _STEP[block[place]].astype(np.int64), bool((len(quotes) + inside) % 2), after


class RangedFile:
    """A file read by byte ranges."""

    def __init__(self, path: str):
        self.handle = _system(path)[0].open_input_file(_system(path)[1])
        self.size = self.handle.size()

    def read(self, start: int, end: int) -> bytes:
        start = max(0, start)
        return self.handle.read_at(max(0, min(end, self.size) - start), start)

    def blocks(self, start: int, end: int) -> Iterator[tuple[int, np.ndarray]]:
        for at in range(start, min(end, self.size), BLOCK):
            yield at, np.frombuffer(self.read(at, min(end, at + BLOCK)), dtype=np.uint8)

    def escaped(self, start: int) -> bool:
        """Whether an odd number of backslashes stands before ``start``."""
        n, width = 0, 64
        while start - n > 0:
            piece = self.read(start - n - width, start - n)
            run = len(piece) - len(piece.rstrip(b"\\"))
            n += run
            if run < len(piece):
                break
        return n % 2 == 1


def _system(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if re.match(r"^[a-zA-Z][\w+.-]*:", path) else (pafs.LocalFileSystem(), path)


def changes(part: JsonRange) -> tuple[int, int, int]:
    """Texts left open (0 or 1), and the change of nesting for a start outside and inside a text."""
    file = RangedFile(part.file)
    escaped = file.escaped(part.start)
    net, inside = [0, 0], [False, True]
    for _, block in file.blocks(part.start, part.end):
        for i in (0, 1):
            _, step, inside[i], after = brackets(block, inside[i], escaped)
            net[i] += int(step.sum())
        escaped = after
    return int(inside[0]), net[0], net[1]


def records(part: JsonRange, level: int, named: bool) -> Iterator[tuple[str, int, str | None, str]]:
    """``(file, pos, name, record)`` of the objects that open at nesting ``level`` within the range."""
    file = RangedFile(part.file)
    depth, inside, escaped = part.depth, part.inside, file.escaped(part.start)
    held, opened = b"", None
    for at, block in file.blocks(part.start, file.size):
        if at >= part.end and opened is None:
            return
        place, step, inside, escaped = brackets(block, inside, escaped)
        after = depth + np.cumsum(step)
        depth = int(after[-1]) if len(after) else depth
        raw = block.tobytes()
        cut = 0
        edge = np.flatnonzero(after + (step < 0) == level + 1)
        for p, s in zip(place[edge].tolist(), step[edge].tolist()):
            if s > 0 and raw[p] == 123 and at + p < part.end:
                opened, held, cut = at + p, b"", p
            elif s < 0 and opened is not None:
                name = _name(file, opened, raw[:max(0, opened - at)]) if named else None
                yield part.file, opened, name, (held + raw[cut:p + 1]).decode("utf-8", "replace")
                opened = None
                if at + p >= part.end:
                    return
        held = held + raw[cut:] if opened is not None else b""


def _name(file: RangedFile, opened: int, before: bytes) -> str | None:
    """The key of the record that opens at ``opened``, from what stands ``before`` it in its block or further back."""
    width = NAME_BYTES
    found = _NAME.search(before[-width:]) if len(before) >= width else None
    # A match at the very start of the window may be a quote within a longer key.
    while (found is None or found.start() == 0) and (width == NAME_BYTES or width // 16 < opened):
        found = _NAME.search(file.read(opened - width, opened))
        width *= 16
    return json.loads(b'"' + found.group(1) + b'"') if found else None


class JsonRecords(DataSource):
    """``json_records``: ranges of JSON files as records, or as the changes that each makes."""

    @classmethod
    def name(cls) -> str:
        return "json_records"

    def schema(self) -> str:
        if self.options["what"] == "changes":
            return "file string, start long, end long, texts int, outside long, inside long"
        return "file string, pos long, name string, record string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.what, self.ranges = options["what"], options["ranges"]
        self.level, self.named = int(options["level"]), options["named"] == "true"

    def partitions(self) -> list[JsonRange]:
        return [JsonRange(*r) for r in json.loads(self.ranges)]

    def read(self, part: JsonRange):
        if self.what == "changes":
            yield (part.file, part.start, part.end, *changes(part))
        else:
            yield from records(part, self.level, self.named)


def list_files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Files behind a path, folder or pattern, with their sizes."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    found = []
    for status in hadoop(path).getFileSystem(conf).globStatus(hadoop(path)) or []:
        inner = [status] if status.isFile() else status.getPath().getFileSystem(conf).listStatus(status.getPath())
        found += [(s.getPath().toString(), s.getLen()) for s in inner if s.isFile() and s.getPath().getName()[0] not in "._"]
    if not found:
        raise FileNotFoundError(path)
    return sorted(found)


def read_records(
    spark: SparkSession, path: str, level: int = 2, named: bool = False, range_bytes: int = RANGE,
) -> DataFrame:
    """``(file, pos, name, record)``: the objects at nesting ``level`` of each JSON file, as text.

    ``pos`` is the byte at which a record opens; ``name`` its key where the records are a map (``named``).
    The driver holds one entry per range, as it does for the tasks themselves.
    """
    spark.dataSource.register(JsonRecords)
    source = spark.read.format("json_records").option("level", level).option("named", str(named).lower())
    ranges = [(f, at, min(at + range_bytes, size)) for f, size in list_files(spark, path) for at in range(0, size, range_bytes)]
    found = source.option("what", "changes").option("ranges", json.dumps(ranges)).load().collect()
    made = {(r["file"], r["start"]): r for r in found}
    states, inside, depth = [], False, 0
    for file, start, end in ranges:
        if start == 0:
            inside, depth = False, 0
        states.append((file, start, end, inside, depth))
        change = made[file, start]
        depth += change["inside" if inside else "outside"]
        inside ^= bool(change["texts"])
    return source.option("what", "records").option("ranges", json.dumps(states)).load()
