"""GeoTIFF: headers as rows of the catalogue, pixels as rows, and tiles written back.

Headers and pixels are read with ``struct``, ``zlib`` and numpy from what Spark's binary files give: strips or
tiles, uncompressed or deflated, with or without the horizontal predictor. Other files are an error, so
that a folder never gives part of its pixels unnoticed. A file is one row of Spark's, up to 2 GB.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEADER = "path string, array_type string, x_size int, y_size int, raster_count int, geo_transform array<double>, nodata double, epsg int, polygon string, size long"
PIXELS = "path string, band int, py int, px int, value double"
#: Fixed values of the format: sizes of field types, and pixel types by (sample format, bits).
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
_KINDS = {(1, 8): ("Byte", "u1"), (2, 8): ("SignedByte", "i1"), (2, 16): ("Int16", "i2"), (1, 16): ("UInt16", "u2"), (2, 32): ("Int32", "i4"), (1, 32): ("UInt32", "u4"), (3, 32): ("Float32", "f4"), (3, 64): ("Float64", "f8")}
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, SAMPLES, COUNTS, PLANAR, FORMAT = 256, 257, 258, 259, 273, 277, 279, 284, 339
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, STRIP_ROWS = 317, 322, 323, 324, 325, 278
DEFLATED = (8, 32946)
#: Pixels that a task gives out together; so many, or one file, it draws together.
CELLS = 65_536
PIXEL_SCALE, TIEPOINT, GEO_KEYS, NODATA = 33550, 33922, 34735, 42113


def fields(data: bytes) -> tuple[str, dict[int, tuple]]:
    """Byte order and the fields of the first image; no fields if it is no TIFF."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2], "")
    if not order or len(data) < 8 or struct.unpack(order + "H", data[2:4])[0] != 42:
        return order, {}
    at = struct.unpack(order + "I", data[4:8])[0]
    out = {}
    for i in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        size = _SIZES.get(kind, 1) * count
        where = at + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * i)[0]
        if kind == 2:
            out[tag] = (data[where : where + count].split(b"\0")[0].decode("latin-1"),)
        elif kind in _CODES:
            out[tag] = struct.unpack_from(f"{order}{count}{_CODES[kind]}", data, where)
    return order, out


def _header(path: str, data: bytes, size: int) -> tuple | None:
    _, f = fields(data)
    if WIDTH not in f:
        return None
    width, height, bands = f[WIDTH][0], f[HEIGHT][0], f.get(SAMPLES, (1,))[0]
    kind = _KINDS.get((f.get(FORMAT, (1,))[0], f.get(BITS, (8,))[0]), ("Byte", "u1"))[0]
    scale, tie = f.get(PIXEL_SCALE, (1.0, 1.0, 0.0)), f.get(TIEPOINT, (0.0,) * 6)
    transform = [tie[3] - tie[0] * scale[0], scale[0], 0.0, tie[4] + tie[1] * scale[1], 0.0, -scale[1]]
    keys = f.get(GEO_KEYS, ())
    codes = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4)}
    x0, y0 = transform[0], transform[3]
    x1, y1 = x0 + width * transform[1], y0 + height * transform[5]
    ring = ",".join(f"{x:f} {y:f}" for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)))
    nodata = float(f[NODATA][0]) if f.get(NODATA, ("",))[0].strip() else None
    return path, kind, width, height, bands, transform, nodata, codes.get(3072, codes.get(2048)), f"POLYGON (({ring}))", size


def headers(files: DataFrame) -> DataFrame:
    """One catalogue row per file (``path``, ``content``, ``length``); files that are no TIFF are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.strip().split()[0] for c in HEADER.split(", ")]
        for b in batches:
            rows = [h for p, d, n in zip(b["path"], b["content"], b["length"]) if (h := _header(p, d, n))]
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content", "length").mapInPandas(run, HEADER)


def read_headers(spark: SparkSession, root: str, pattern: str = "*.tif") -> DataFrame:
    """``headers`` of the files below ``root``."""
    return headers(_files(spark, root, pattern))


def _files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)


def _blocks(path: str, data: bytes) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """Each strip or tile: first band, first row, first column, and values (rows x columns x bands)."""
    order, f = fields(data)
    width, height, bands = f[WIDTH][0], f[HEIGHT][0], f.get(SAMPLES, (1,))[0]
    kind, packed, predictor = _KINDS.get((f.get(FORMAT, (1,))[0], f.get(BITS, (8,))[0])), f.get(COMPRESSION, (1,))[0], f.get(PREDICTOR, (1,))[0]
    if kind is None or packed not in (1, *DEFLATED) or predictor not in (1, 2):
        raise ValueError(f"{path}: pixels of this kind (compression {packed}, predictor {predictor}) can't be read")
    cell, apart = np.dtype(order + kind[1]), f.get(PLANAR, (1,))[0] == 2
    if TILE_OFFSETS in f:
        wide, high, starts, sizes = f[TILE_WIDTH][0], f[TILE_HEIGHT][0], f[TILE_OFFSETS], f[TILE_COUNTS]
    else:
        wide, high, starts, sizes = width, min(f.get(STRIP_ROWS, (height,))[0], height), f[OFFSETS], f[COUNTS]
    across, down, deep = -(-width // wide), -(-height // high), 1 if apart else bands
    for i, (start, size) in enumerate(zip(starts, sizes)):
        band, place = divmod(i, across * down) if apart else (0, i)
        row, column = place // across * high, place % across * wide
        raw = data[start : start + size]
        cells = np.frombuffer(zlib.decompress(raw) if packed in DEFLATED else raw, cell)
        rows = high if TILE_OFFSETS in f else min(high, height - row)
        grid = cells[: rows * wide * deep].reshape(rows, wide, deep)
        if predictor == 2:
            grid = np.cumsum(grid, axis=1, dtype=cell)
        yield band, row, column, grid[: height - row, : width - column]


def pixels(files: DataFrame) -> DataFrame:
    """The pixels of files (``path``, ``content``) in long form, nodata as null; files that are no TIFF are left out.

    Strips and tiles of many files go out together, ``CELLS`` pixels at a time, so memory depends neither on their number nor,
    beyond one strip or tile, on their size.
    """
    names = [c.split()[0] for c in PIXELS.split(", ")]

    def grids(batch: pd.DataFrame) -> Iterator[tuple]:
        for path, data in zip(batch["path"], batch["content"]):
            _, f = fields(data)
            if WIDTH not in f:
                continue
            nodata = float(f[NODATA][0]) if f.get(NODATA, ("",))[0].strip() else None
            for first, row, column, grid in _blocks(path, data):
                y, x, band = (i.ravel() for i in np.indices(grid.shape, "i4"))
                value = grid.ravel().astype(float)
                yield path, first + band + 1, row + y, column + x, np.where(value == nodata, np.nan, value) if nodata is not None else value

    def frame(parts: list[tuple]) -> pd.DataFrame:
        paths, *cells = zip(*parts)
        return pd.DataFrame(dict(zip(names, (np.repeat(np.array(paths, object), [len(c) for c in cells[0]]), *map(np.concatenate, cells)))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for b in batches:
            for part in grids(b):
                held.append(part)
                n += len(part[1])
                if n >= CELLS:
                    yield frame(held)
                    held, n = [], 0
        if held:
            yield frame(held)

    return files.select("path", "content").mapInPandas(run, PIXELS).withColumn("value", F.nanvl("value", F.lit(None).cast("double")))


def read_pixels(spark: SparkSession, root: str, pattern: str = "*.tif") -> DataFrame:
    """``pixels`` of the files below ``root``."""
    return pixels(_files(spark, root, pattern))


def encode(bands: np.ndarray, transform: list[float], epsg: int, nodata: float) -> bytes:
    """A float32 GeoTIFF of ``bands`` (bands x height x width), one strip per band."""
    count, height, width = bands.shape
    body = np.ascontiguousarray(bands, "<f4").tobytes()
    key = 2048 if epsg == 4326 else 3072
    entries = [
        (WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [32] * count), (COMPRESSION, 3, [1]), (262, 3, [1]),
        (OFFSETS, 4, [8 + i * height * width * 4 for i in range(count)]), (SAMPLES, 3, [count]), (278, 4, [height]),
        (COUNTS, 4, [height * width * 4] * count), (PLANAR, 3, [2]), (FORMAT, 3, [3] * count),
        (PIXEL_SCALE, 12, [transform[1], -transform[5], 0.0]), (TIEPOINT, 12, [0.0, 0.0, 0.0, transform[0], transform[3], 0.0]),
        (GEO_KEYS, 3, [1, 1, 0, 2, 1024, 0, 1, 2 if epsg == 4326 else 1, key, 0, 1, epsg]), (NODATA, 2, f"{nodata:g}\0".encode()),
    ]
    at = 8 + len(body)
    extra_at, extra, table = at + 2 + 12 * len(entries) + 4, b"", b""
    for tag, kind, values in entries:
        raw = values if kind == 2 else struct.pack(f"<{len(values)}{_CODES[kind]}", *values)
        if len(raw) > 4:
            table += struct.pack("<HHII", tag, kind, len(values), extra_at + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
        else:
            table += struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
    return b"II*\0" + struct.pack("<I", at) + body + struct.pack("<H", len(entries)) + table + b"\0\0\0\0" + extra


def tiles(cells: DataFrame, by: list[str], names: list[str], tile: int, transform: list[float], epsg: int, nodata: float) -> DataFrame:
    """One GeoTIFF per tile (``tile_x``, ``tile_y``) of pixels in long form: a task gathers one tile at a time."""
    if tile > 1024:
        raise ValueError("a tile has at most 1024 pixels a side")
    place = F.array_position(F.array(*(F.lit(n) for n in names)), F.col("band")) - 1
    cut = cells.where(F.col("band").isin(names) & F.col("value").isNotNull()).select(
        *by, F.expr(f"px div {tile}").cast("int").alias("tile_x"), F.expr(f"py div {tile}").cast("int").alias("tile_y"),
        ((place * tile + F.col("py") % tile) * tile + F.col("px") % tile).cast("int").alias("at"), F.col("value").cast("float").alias("value"),
    )

    keys = [*by, "tile_x", "tile_y"]
    gathered = cut.groupBy(*keys).agg(F.collect_list(F.struct("at", "value")).alias("c")).select(*keys, F.col("c.at").alias("at"), F.col("c.value").alias("value"))
    schema = T.StructType([*gathered.select(*keys).schema, T.StructField("tiff", T.BinaryType())])
    step = max(1, CELLS // (len(names) * tile * tile))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                b = whole.slice(start, step)
                # The lists of some tiles are read from Arrow's own arrays, without an object for each.
                (ends, at), (_, values) = ((c.offsets.to_numpy() - c.offsets[0].as_py(), c.flatten().to_numpy()) for c in (b["at"], b["value"]))
                files = []
                for x, y, lo, hi in zip(b["tile_x"].to_pylist(), b["tile_y"].to_pylist(), ends[:-1], ends[1:]):
                    grid = np.full((len(names), tile, tile), nodata, "f4")
                    grid.reshape(-1)[at[lo:hi]] = values[lo:hi]
                    own = [transform[0] + x * tile * transform[1], transform[1], 0.0, transform[3] + y * tile * transform[5], 0.0, transform[5]]
                    files.append(encode(grid, own, epsg, nodata))
                yield pa.RecordBatch.from_arrays([*(b[k] for k in keys), pa.array(files, pa.binary())], [*keys, "tiff"])

    return gathered.mapInArrow(draw, schema)
