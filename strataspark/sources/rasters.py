"""Rasters as cell rows: text grids, and TIFF files that need no codec beyond zlib."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from .blobs import arrow_reaches, open_system, qualified, write_files

_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 16: 8}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
_TYPES = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}
INFO = "file string, width int, height int, bands int, dtype string, west double, north double, cell_x double, cell_y double, nodata double"


def _tags(read) -> tuple[str, dict]:
    """Byte order and tags of a TIFF of which ``read(at, n)`` gives bytes; only the tags and what they point to are read."""
    head = read(0, 8)
    end = {b"II": "<", b"MM": ">"}.get(head[:2])
    if end is None or len(head) < 8 or struct.unpack_from(f"{end}H", head, 2)[0] != 42:
        raise ValueError("not a classic TIFF file")
    at, = struct.unpack_from(f"{end}I", head, 4)
    n, = struct.unpack(f"{end}H", read(at, 2))
    body, tags = read(at + 2, 12 * n), {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(f"{end}HHI", body, 12 * k)
        size = _SIZES[kind] * count
        data = body[12 * k + 8 : 12 * k + 8 + size] if size <= 4 else read(struct.unpack_from(f"{end}I", body, 12 * k + 8)[0], size)
        tags[tag] = data.split(b"\0")[0].decode("latin-1") if kind == 2 else struct.unpack(f"{end}{count}{_CODES.get(kind, 'B')}", data)
    return end, tags


def info(read) -> dict:
    """Size, type, place and nodata value of a TIFF; without a place the transform is that of pixels. ``read`` is a function ``(at, n)`` or the bytes."""
    end, t = _tags(read if callable(read) else lambda at, n: read[at : at + n])
    one = lambda tag, default: t.get(tag, (default,))[0]
    kind = _TYPES[one(339, 1), one(258, 8)]
    sx, sy = t.get(33550, (1.0, 1.0))[:2]
    tie = t.get(33922)
    west, north = (tie[3] - tie[0] * sx, tie[4] + tie[1] * sy) if tie else (0.0, 0.0)
    nodata = t.get(42113)
    return {"width": one(256, 0), "height": one(257, 0), "bands": one(277, 1), "dtype": kind, "west": float(west), "north": float(north), "cell_x": float(sx), "cell_y": float(sy), "nodata": float(nodata) if nodata and nodata.strip() else None, "end": end, "tags": t}


def layout(h: dict) -> list[tuple[int, int, int, int, int]]:
    """``(band or -1, row, col, offset, bytes)`` of each strip or tile; -1: it holds all bands."""
    t = h["tags"]
    apart, tiled = t.get(284, (1,))[0] == 2, 324 in t
    offsets, counts = (t[324], t[325]) if tiled else (t[273], t[279])
    bw, bh = (t[322][0], t[323][0]) if tiled else (h["width"], t.get(278, (h["height"],))[0])
    across, down = -(-h["width"] // bw), -(-h["height"] // bh)
    found = []
    for k, (at, n) in enumerate(zip(offsets, counts, strict=True)):
        band, rest = divmod(k, across * down) if apart else (-1, k)
        found.append((band, rest // across * bh, rest % across * bw, at, n))
    return found


def block(h: dict, band: int, r: int, c: int, data: bytes) -> np.ndarray:
    """The values of one strip or tile, ``[row, col, band]``."""
    t = h["tags"]
    how, predictor = t.get(259, (1,))[0], t.get(317, (1,))[0]
    if how not in (1, 8, 32946):
        raise ValueError(f"TIFF compression {how} needs a codec that is not here")
    tiled = 324 in t
    bw, bh = (t[322][0], t[323][0]) if tiled else (h["width"], t.get(278, (h["height"],))[0])
    dtype = np.dtype(h["end"] + h["dtype"])
    depth = h["bands"] if band < 0 else 1
    data = data if how == 1 else zlib.decompress(data)
    rows = bh if tiled else min(bh, h["height"] - r)
    if predictor == 3:
        b = np.frombuffer(data, np.uint8)[: rows * bw * depth * dtype.itemsize].reshape(rows, -1)
        b = np.cumsum(b.reshape(rows, -1, depth), axis=1, dtype=np.uint8).reshape(rows, dtype.itemsize, bw * depth)
        a = np.ascontiguousarray(b.transpose(0, 2, 1)).view(np.dtype(">" + h["dtype"])).reshape(rows, bw, depth)
    else:
        a = np.frombuffer(data, dtype)[: rows * bw * depth].reshape(rows, bw, depth)
        if predictor == 2:
            a = np.cumsum(a, axis=1, dtype=dtype.newbyteorder("="))
    return a[: h["height"] - r, : h["width"] - c]


def _opened(path: str):
    """``read(at, n)`` of a file, by byte ranges."""
    system, name = open_system(path)
    source = system.open_input_file(name)

    def read(at: int, n: int) -> bytes:
        source.seek(at)
        return source.read(n)

    return read


def _held(raw: bytes):
    return lambda at, n: raw[at : at + n]


_BLOCK_ROWS = "file string, band int, row int, col int, offset long, bytes long"
_PART = 16  # blocks of a file that are read together


def _blocks_of(window):
    """Strips and tiles of each file that meet the window ``(row, col, rows, cols)``."""

    def run(batches):
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                h = info(_opened(path))
                t = h["tags"]
                high, wide = (t[323][0], t[322][0]) if 324 in t else (t.get(278, (h["height"],))[0], h["width"])
                for band, r, c, at, n in layout(h):
                    if window is None or (r < window[0] + window[2] and r + high > window[0] and c < window[1] + window[3] and c + wide > window[1]):
                        rows.append((path, band, r, c, at, n))
            types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate(types)], names=[c.split()[0] for c in _BLOCK_ROWS.split(", ")])

    return run


def _cell_rows(name: str, h: dict, band: int, r: int, c: int, a: np.ndarray, window):
    """Arrow batches of one block's cells, those of the window alone."""
    if window is not None:
        top, left = max(window[0] - r, 0), max(window[1] - c, 0)
        a = a[top : max(top, window[0] + window[2] - r), left : max(left, window[1] + window[3] - c)]
        r, c = r + top, c + left
    if not a.size:
        return
    for k in range(a.shape[2]):
        v = a[:, :, k].astype(float)
        void = np.isnan(v) if h["nodata"] is None else np.isnan(v) | (v == h["nodata"])
        rows, cols = np.indices(v.shape)
        n = v.size
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * n), pa.array(np.full(n, (k if band < 0 else band) + 1, np.int32)), pa.array((rows.ravel() + r).astype(np.int32)), pa.array((cols.ravel() + c).astype(np.int32)), pa.array(v.ravel(), mask=void.ravel())],
            names=["file", "band", "row", "col", "value"],
        )


def _cells_of(window):
    def run(batches):
        for batch in batches:
            path, read, h = None, None, None
            for name, band, r, c, at, n in zip(*[batch.column(k).to_pylist() for k in range(6)], strict=True):
                if name != path:
                    path, read = name, _opened(name)
                    h = info(read)
                yield from _cell_rows(name, h, band, r, c, block(h, band, r, c, read(at, n)), window)

    return run


def _whole_cells(window):
    def run(batches):
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = info(raw)
                for band, r, c, at, n in layout(h):
                    yield from _cell_rows(name, h, band, r, c, block(h, band, r, c, raw[at : at + n]), window)

    return run


def _infos(ranged: bool):
    def run(batches):
        names = [c.split()[0] for c in INFO.split(", ")]
        types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), *[pa.float64()] * 5]
        for batch in batches:
            files = batch.column(0).to_pylist()
            reads = [_opened(f) for f in files] if ranged else [_held(raw) for raw in batch.column(1).to_pylist()]
            heads = [info(read) for read in reads]
            rows = [(f, *[h[k] for k in names[1:]]) for f, h in zip(files, heads, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    return run


def _files(spark: SparkSession, path: str) -> tuple[DataFrame, bool]:
    """The files of a path, and whether their bytes can be read in ranges; where only Spark reaches them, their content comes along."""
    found = spark.read.format("binaryFile").load(path)
    ranged = arrow_reaches(qualified(spark, path))
    return found.select("path") if ranged else found.select("path", "content"), ranged


def read_tiff(spark: SparkSession, path: str, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """``file, band, row, col, value`` of TIFF files, or of the ``window`` (first row, first col, rows, cols) of each.

    Tasks read the headers, then the byte ranges of those strips or tiles alone that meet the window, dealt over tasks in
    lots of a few, so a file of any size is read by many. In a store that only Spark reads, a file is one value and one task.
    """
    ship_package(spark)
    files, ranged = _files(spark, path)
    ddl = "file string, band int, row int, col int, value double"
    if not ranged:
        return files.mapInArrow(_whole_cells(window), ddl)
    parts = files.mapInArrow(_blocks_of(window), _BLOCK_ROWS).withColumn("lot", F.floor(F.col("offset") / F.greatest(F.col("bytes") * _PART, F.lit(1))))
    return parts.repartition("file", "lot").sortWithinPartitions("file", "offset").drop("lot").mapInArrow(_cells_of(window), ddl)


def tiff_info(spark: SparkSession, path: str) -> DataFrame:
    """Header figures of TIFF files, from their tags alone."""
    ship_package(spark)
    files, ranged = _files(spark, path)
    return files.mapInArrow(_infos(ranged), INFO)


def encode_tiff(values: np.ndarray, west: float, north: float, cell_x: float, cell_y: float, nodata: float = -9999.0, strip: int = 64) -> bytes:
    """A single-band 32-bit float TIFF in deflated strips; not-a-number becomes the nodata value."""
    a = np.where(np.isnan(values), nodata, values).astype("<f4")
    parts = [zlib.compress(a[r : r + strip].tobytes()) for r in range(0, len(a), strip)]
    text = f"{nodata:g}\0".encode()
    entries: list[tuple[int, int, int, bytes]] = []
    add = lambda tag, kind, *v: entries.append((tag, kind, len(v), struct.pack(f"<{len(v)}{_CODES[kind]}", *v)))
    add(256, 4, a.shape[1])
    add(257, 4, a.shape[0])
    add(258, 3, 32)
    add(259, 3, 8)
    add(262, 3, 1)
    add(273, 4, *[0] * len(parts))
    add(277, 3, 1)
    add(278, 4, strip)
    add(279, 4, *map(len, parts))
    add(339, 3, 3)
    add(33550, 12, cell_x, cell_y, 0.0)
    add(33922, 12, 0.0, 0.0, 0.0, west, north, 0.0)
    entries.append((42113, 2, len(text), text))
    body_at = 8 + 2 + 12 * len(entries) + 4
    extra, at = b"", body_at
    places = {}
    for tag, _, _, data in entries:
        if len(data) > 4:
            places[tag] = at + len(extra)
            extra += data + b"\0" * (len(data) % 2)
    first = body_at + len(extra)
    offsets = [first + sum(map(len, parts[:k])) for k in range(len(parts))]
    packed = struct.pack(f"<{len(offsets)}I", *offsets)
    if 273 in places:
        k = places[273] - body_at
        extra = extra[:k] + packed + extra[k + len(packed) :]
    out = struct.pack("<2sHIH", b"II", 42, 8, len(entries))
    for tag, kind, n, data in entries:
        if tag == 273 and tag not in places:
            data = packed
        out += struct.pack("<HHI", tag, kind, n) + (struct.pack("<I", places[tag]) if tag in places else data.ljust(4, b"\0"))
    return out + b"\0\0\0\0" + extra + b"".join(parts)


def read_text_grid(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """An ESRI text grid: ``row, col, value`` (nodata null), and its header."""
    head = {}
    for r in spark.read.text(path).limit(6).collect():
        parts = r["value"].split()
        if len(parts) == 2 and parts[0][0].isalpha():
            head[parts[0].lower()] = float(parts[1])
    from ..operators.ranks import global_rank

    lines = global_rank(spark.read.text(path).withColumn("__at", F.monotonically_increasing_id()), ["__at"], "line").filter(F.col("line") >= len(head))
    cells = lines.select((F.col("line") - len(head)).cast("int").alias("row"), F.posexplode(F.split(F.trim("value"), r"\s+")).alias("col", "v"))
    v = F.col("v").try_cast("double")
    return cells.select("row", "col", F.when(v != head.get("nodata_value", -9999.0), v).alias("value")), head


def _tiffs(cols: int, west: float, north: float, cell_x: float, cell_y: float, rows_a_file: int):
    def run(key, part):
        first = int(key[0]) * rows_a_file
        values = np.full((int(part["rows"].iloc[0]), cols), np.nan)
        values[part["row"].to_numpy() - first, part["col"].to_numpy()] = part["value"].to_numpy(float)
        raw = encode_tiff(values, west, north - first * cell_y, cell_x, cell_y)
        return pd.DataFrame({"name": [f"rows-{first:08d}.tif"], "content": [raw]})

    return run


def write_tiff(cells: DataFrame, grid, path: str, rows_a_file: int = 256) -> None:
    """Write ``row, col, value`` as single-band TIFF files, each a band of rows of the grid, so that no task holds more than one band."""
    spark = cells.sparkSession
    ship_package(spark)
    band = F.floor(F.col("row") / rows_a_file).cast("int")
    rows = F.least(F.lit(rows_a_file), F.lit(grid.rows) - band * rows_a_file)
    parts = cells.select("row", "col", F.col("value").cast("double").alias("value"), band.alias("band"), rows.alias("rows"))
    made = parts.groupBy("band").applyInPandas(_tiffs(grid.cols, grid.west, grid.north, grid.cell_x, grid.cell_y, rows_a_file), "name string, content binary")
    write_files(made, path)
