"""Writing results: tiles, pictures, coverages, lines, logs."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a picture's side and of a chunk of a coverage, at most.
TILE, CHUNK = 256, 0xFFFFFF


def write_tiles(pixels: DataFrame, path: str, tile: int = TILE) -> None:
    """Pixels as Parquet in a folder per band and tile, so that a window's read opens only its tiles."""
    cut = pixels.withColumns({"tile_x": F.expr(f"px div {tile}").cast("int"), "tile_y": F.expr(f"py div {tile}").cast("int")})
    cut.repartition("band", "tile_y", "tile_x").write.mode("overwrite").partitionBy("band", "tile_y", "tile_x").parquet(path)


def png(rgba: np.ndarray) -> bytes:
    """A picture of height x width x 4 bytes."""
    height, width, _ = rgba.shape
    rows = np.concatenate([np.zeros((height, 1), np.uint8), rgba.reshape(height, -1)], axis=1).tobytes()

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def pictures(pixels: DataFrame, by: list[str], width: int, height: int) -> DataFrame:
    """One PNG per group of pixels (``py``, ``px``, ``r``, ``g``, ``b``, ``a``); missing ones are transparent.

    A group is one tile: at most ``width * height`` pixels, which bounds what a task gathers.
    """
    if width > 2 * TILE or height > 2 * TILE:
        raise ValueError("a picture is a tile; cut larger ones")

    @F.pandas_udf("binary")
    def draw(places: pd.Series, colours: pd.Series) -> pd.Series:
        out = []
        for at, colour in zip(places, colours):
            canvas = np.zeros(height * width, "<u4")
            canvas[at] = colour
            out.append(png(canvas.view(np.uint8).reshape(height, width, 4)))
        return pd.Series(out)

    colour = sum(F.shiftleft(F.col(c).cast("long"), 8 * i) for i, c in enumerate("rgba"))
    cells = pixels.select(*by, F.struct((F.col("py") * width + F.col("px")).alias("at"), colour.alias("colour")).alias("c"))
    return cells.groupBy(*by).agg(F.collect_list("c").alias("c")).select(*by, draw("c.at", "c.colour").alias("png"))


def picture_pixels(pictures: DataFrame, by: list[str], column: str = "png") -> DataFrame:
    """The pixels (``py``, ``px``, ``r``, ``g``, ``b``, ``a``) of pictures that ``png`` has written; transparent ones too."""

    @F.pandas_udf("array<struct<py:int,px:int,r:int,g:int,b:int,a:int>>")
    def read(files: pd.Series) -> pd.Series:
        out = []
        for data in files:
            width, height = struct.unpack(">II", data[16:24])
            size = struct.unpack(">I", data[33:37])[0]
            rows = np.frombuffer(zlib.decompress(data[41 : 41 + size]), np.uint8).reshape(height, -1)[:, 1:]
            y, x = np.indices((height, width)).reshape(2, -1)
            cells = np.column_stack([y, x, rows.reshape(-1, 4)]).tolist()
            out.append([dict(zip(("py", "px", "r", "g", "b", "a"), c)) for c in cells])
        return pd.Series(out)

    return pictures.select(*by, F.inline(read(column)))


def empty_picture(width: int = TILE, height: int = TILE) -> bytes:
    """What is shown where nothing is rendered."""
    return png(np.zeros((height, width, 4), np.uint8))


def legend(colours: list[tuple[int, int, int, int]], width: int = 20) -> bytes:
    """A palette from top to bottom."""
    return png(np.repeat(np.array(colours, np.uint8)[::-1, None, :], width, axis=1))


def feature_info(values: DataFrame, dates: DataFrame, links: DataFrame) -> DataFrame:
    """One JSON document of bands' values, dates and links (all short lists)."""
    bands = values.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("band", "value")))).alias("bands"))
    stamps = dates.agg(F.array_sort(F.collect_set("day")).alias("dates"))
    files = links.agg(F.array_sort(F.collect_set("link")).alias("links"))
    joined = bands.join(F.broadcast(stamps)).join(F.broadcast(files))  # one row each
    return joined.select(F.to_json(F.struct("bands", "dates", "links")).alias("json"))


def coverage_header(axes: dict[str, int], variables: list[str], kind: str, width: int, height: int) -> str:
    """The description of a coverage's dimensions and variables."""
    dims = [f'<Dimension name="{n}" size="{s}"/>' for n, s in axes.items()] + [f'<Dimension name="y" size="{height}"/>', f'<Dimension name="x" size="{width}"/>']
    own = [f'<Float64 name="{n}"><Dim name="{n}"/></Float64>' for n in axes]
    inner = "".join(f'<Dim name="{n}"/>' for n in (*axes, "y", "x"))
    made = [f'<{kind} name="{v}">{inner}</{kind}>' for v in variables]
    head = '<Dataset name="D" dapVersion="4.0" dmrVersion="1.0" xmlns="http://xml.opendap.org/ns/DAP/4.0#"><Attribute name="_DAP4_Little_Endian" type="UInt8"><Value value="1"/></Attribute>'
    return head + "".join([*dims, *own, *made]) + "</Dataset>"


def _chunks(data: bytes) -> bytes:
    """``data`` in chunks of at most ``CHUNK`` bytes with their headers: no checksum, little-endian."""
    parts = (data[i : i + CHUNK] for i in range(0, len(data), CHUNK))
    return b"".join(struct.pack(">I", len(p) | (8 | 4) << 24) + p for p in parts)


def coverage_parts(grids: DataFrame, variables: list[str], width: int, height: int, nodata: float) -> DataFrame:
    """The body of a coverage: ``at`` (its place, from 0) and ``bytes``, encoded in tasks.

    A part is some rows of one variable, about a chunk, so no task gathers more than that. Parts without any
    pixel are made too.
    """
    if width * 4 > CHUNK:
        raise ValueError(f"a row of {width} pixels doesn't fit a chunk; cut the coverage into windows")
    high = max(1, min(height, CHUNK // (4 * width)))
    down = -(-height // high)

    @F.pandas_udf("binary")
    def encode(at: pd.Series, places: pd.Series, values: pd.Series) -> pd.Series:
        out = []
        for part, where, value in zip(at, places, values):
            grid = np.full(min(high, height - part % down * high) * width, nodata, "<f4")
            if where is not None:
                grid[where] = value
            out.append(_chunks(grid.tobytes()))
        return pd.Series(out)

    variable = F.array_position(F.array(*(F.lit(v) for v in variables)), F.col("band")) - 1
    inside = F.col("px").between(0, width - 1) & F.col("py").between(0, height - 1) & F.col("value").isNotNull()
    cells = grids.where(F.col("band").isin(variables) & inside).select(
        (variable * down + F.expr(f"py div {high}")).cast("long").alias("at"),
        F.struct(((F.col("py") % high) * width + F.col("px")).cast("int").alias("place"), F.col("value").cast("float").alias("value")).alias("c"),
    )
    found = cells.groupBy("at").agg(F.collect_list("c").alias("c"))
    every = grids.sparkSession.range(len(variables) * down).select(F.col("id").alias("at"))
    return every.join(found, "at", "left").select("at", encode("at", "c.place", "c.value").alias("bytes"))


def write_coverage(path: str, header: str, axes: dict[str, list[float]], grids: DataFrame, variables: list[str], width: int, height: int, nodata: float) -> None:
    """A coverage as rows (``at``, ``bytes``) in order, sorted over the files: their bytes, one after the other, are the document.

    Before the body (``at`` from 0) stand the header and the axes, after it the end mark; only these short ones
    are made by the driver.
    """
    spark = grids.sparkSession
    before = [header.encode(), *(np.asarray(v, "<f8").tobytes() for v in axes.values())]
    ends = [(i - len(before), bytearray(_chunks(b))) for i, b in enumerate(before)]
    body = coverage_parts(grids, variables, width, height, nodata)
    last = body.agg(F.count(F.lit(1)).alias("at")).select("at", F.lit(bytearray([1, 0, 0, 0])).alias("bytes"))
    body.unionByName(spark.createDataFrame(ends, "at long, bytes binary")).unionByName(last).orderBy("at").write.mode("overwrite").parquet(path)


def coverage_chunks(stored: DataFrame) -> Iterator[bytes]:
    """The document of a written coverage, part after part, for who sends it."""
    for row in stored.orderBy("at").toLocalIterator():
        yield bytes(row["bytes"])


def write_log(records: DataFrame, path: str, day: Column) -> None:
    """Metrics as compressed JSON lines in a folder per day."""
    records.withColumn("day", day).write.mode("append").partitionBy("day").option("compression", "gzip").json(path)
