"""LAS point clouds (uncompressed, formats 0 to 3 and 6 to 8) as a Spark data source."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import ship_package
from .blobs import open_system, qualified, write_files

CHUNK = 1_000_000
SCHEMA = "index long, x double, y double, z double, intensity int, return_number short, number_of_returns short, classification short, file string"


def files(path: str) -> list[str]:
    """The file, or the ``.las`` files of a folder."""
    from pyarrow import fs

    system, inner = open_system(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.Directory:
        return sorted(f.path for f in system.get_file_info(fs.FileSelector(inner)) if f.path.lower().endswith(".las"))
    return [inner]


def header(raw: bytes) -> dict:
    """What a LAS header says of its points: place, size, count, scale, offset, bounds."""
    if raw[:4] != b"LASF":
        raise ValueError("not a LAS file")
    version = raw[25]
    start, = struct.unpack_from("<I", raw, 96)
    kind, size, count = struct.unpack_from("<BHI", raw, 104)
    if kind & 0x80:
        raise ValueError("compressed (LAZ) points need a codec that is not here")
    scales, offsets = struct.unpack_from("<3d", raw, 131), struct.unpack_from("<3d", raw, 155)
    bounds = struct.unpack_from("<6d", raw, 179)
    if version >= 4:
        count = struct.unpack_from("<Q", raw, 247)[0] or count
    return {"start": start, "kind": kind, "size": size, "count": count, "scales": scales, "offsets": offsets, "east": bounds[0], "west": bounds[1], "north": bounds[2], "south": bounds[3], "high": bounds[4], "low": bounds[5]}


def decode(raw: bytes, h: dict, first: int, name: str) -> pa.RecordBatch:
    n = len(raw) // h["size"]
    b = np.frombuffer(raw, np.uint8)[: n * h["size"]].reshape(n, h["size"])
    xyz = np.ascontiguousarray(b[:, :12]).view("<i4") * np.array(h["scales"]) + np.array(h["offsets"])
    bits = b[:, 14]
    if h["kind"] >= 6:
        number, total, label = bits & 15, bits >> 4, b[:, 16]
    else:
        number, total, label = bits & 7, bits >> 3 & 7, b[:, 15] & 31
    intensity = np.ascontiguousarray(b[:, 12:14]).view("<u2")[:, 0]
    columns = [pa.array(np.arange(first, first + n)), *[pa.array(xyz[:, k]) for k in range(3)], pa.array(intensity.astype(np.int32)), *[pa.array(v.astype(np.int16)) for v in (number, total, label)], pa.array([name] * n)]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])


class _Part(InputPartition):
    """Ranges ``path, first, count`` that one task reads, one after another."""

    def __init__(self, ranges: list[tuple[str, int, int]]):
        super().__init__(ranges)
        self.ranges = ranges


MOST_TASKS = 200  # beyond so many ranges, and beyond some for each core, a task takes several


class _Reader(DataSourceReader):
    def __init__(self, path: str, chunk: int, tasks: int):
        self.path, self.chunk, self.tasks = path, chunk, tasks

    def partitions(self):
        """Ranges of up to ``chunk`` points; only headers are read here, several at a time."""
        system, _ = open_system(self.path)

        def count(f):
            with system.open_input_file(f) as s:
                return f, header(s.read(375))["count"]

        with ThreadPoolExecutor(16) as pool:
            ranges = [(f, k, min(self.chunk, n - k)) for f, n in pool.map(count, files(self.path)) for k in range(0, n, self.chunk)]
        each = -(-len(ranges) // self.tasks)
        return [_Part(ranges[k : k + each]) for k in range(0, len(ranges), max(each, 1))] or [_Part([])]

    def read(self, part) -> Iterator[pa.RecordBatch]:
        system, _ = open_system(self.path)
        for path, k in groupby(part.ranges, lambda r: r[0]):
            with system.open_input_file(path) as s:
                h = header(s.read(375))
                for _, first, count in k:
                    for done in range(0, count, 100_000):
                        n = min(100_000, count - done)
                        s.seek(h["start"] + (first + done) * h["size"])
                        yield decode(s.read(n * h["size"]), h, first + done, path)


class LasDataSource(DataSource):
    """``spark.read.format("las").load(path)``: points with their place in the file as ``index``. Option ``chunk``: points of a range; a partition is one range, or several if there are more than ``tasks``."""

    @classmethod
    def name(cls):
        return "las"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options["path"], int(self.options.get("chunk", CHUNK)), int(self.options.get("tasks", MOST_TASKS)))


def encode(points: dict, scale: float = 0.001) -> bytes:
    """A LAS 1.2 file (format 0) of arrays ``x, y, z, intensity, return_number, number_of_returns, classification``."""
    xyz = np.stack([np.asarray(points[k], float) for k in "xyz"], 1)
    n = len(xyz)
    low = xyz.min(0) if n else np.zeros(3)
    high = xyz.max(0) if n else np.zeros(3)
    offset = np.floor(low)
    head = bytearray(227)
    head[:4] = b"LASF"
    head[24], head[25] = 1, 2
    struct.pack_into("<HII", head, 94, 227, 227, 0)
    struct.pack_into("<BHI", head, 104, 0, 20, n)
    struct.pack_into("<3d", head, 131, scale, scale, scale)
    struct.pack_into("<3d", head, 155, *offset)
    struct.pack_into("<6d", head, 179, high[0], low[0], high[1], low[1], high[2], low[2])
    rows = np.zeros((n, 20), np.uint8)
    rows[:, :12] = np.rint((xyz - offset) / scale).astype("<i4").view(np.uint8).reshape(n, 12)
    rows[:, 12:14] = np.asarray(points["intensity"], "<u2").view(np.uint8).reshape(n, 2)
    rows[:, 14] = np.asarray(points["return_number"], np.uint8) | np.asarray(points["number_of_returns"], np.uint8) << 3
    rows[:, 15] = points["classification"]
    return bytes(head) + rows.tobytes()


def read_las(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """The points of a file or a folder."""
    ship_package(spark)
    spark.dataSource.register(LasDataSource)
    return spark.read.format("las").option("chunk", chunk).option("tasks", max(MOST_TASKS, 16 * spark.sparkContext.defaultParallelism)).load(qualified(spark, path))


HEADER = "file string, points long, point_format int, west double, east double, south double, north double, low double, high double"


def _headers(batches):
    names = [c.split()[0] for c in HEADER.split(", ")]
    for batch in batches:
        rows = []
        for path in batch.column(0).to_pylist():
            system, inner = open_system(path)
            with system.open_input_file(inner) as s:
                h = header(s.read(375))
            rows.append((path, h["count"], h["kind"], *[float(h[k]) for k in names[3:]]))
        types = [pa.string(), pa.int64(), pa.int32(), *[pa.float64()] * 6]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """What the headers of the ``.las`` files of a folder say, one row a file; no point is read."""
    ship_package(spark)
    paths = spark.read.format("binaryFile").option("pathGlobFilter", "*.las").load(path).select("path")
    return paths.mapInArrow(_headers, HEADER)


FIELDS = ["x", "y", "z", "intensity", "return_number", "number_of_returns", "classification"]


def _encoded(scale: float, most: int):
    def run(batches):
        held, n = [], 0
        for batch in batches:
            for k in range(0, batch.num_rows, most):
                part = batch.slice(k, most)
                if n + part.num_rows > most:
                    yield _file(held, scale)
                    held, n = [], 0
                held.append(part)
                n += part.num_rows
        if held:
            yield _file(held, scale)

    return run


def _file(batches: list[pa.RecordBatch], scale: float) -> pa.RecordBatch:
    table = pa.Table.from_batches(batches)
    raw = encode({k: table.column(k).to_numpy() for k in FIELDS}, scale)
    return pa.RecordBatch.from_arrays([pa.array([f"{uuid.uuid4().hex}.las"]), pa.array([raw], pa.binary())], names=["name", "content"])


def write_las(points: DataFrame, path: str, scale: float = 0.001, most: int = CHUNK) -> None:
    """Write points as LAS files of up to ``most`` points, one or more a partition. Columns that are missing are 0; points without a place are left out."""
    have = {c: F.col(c) for c in points.columns}
    rows = points.filter("x is not null and y is not null and z is not null").select(
        *[have[c].cast("double").alias(c) for c in "xyz"],
        *[F.coalesce(have.get(c, F.lit(0)).cast("int"), F.lit(0)).alias(c) for c in FIELDS[3:]],
    )
    ship_package(points.sparkSession)
    write_files(rows.mapInArrow(_encoded(scale, most), "name string, content binary"), path)
