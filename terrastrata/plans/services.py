"""The service operations as functions from requests to DataFrames: map, coverage, point, drill."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import pixels
from ..operators import drill as drills
from ..operators import expressions, raster, requests
from .base import query
from .rasters import KEYS


@dataclass
class Layer:
    """What a layer shows: bands or expressions of them, a mask, scaling and colours."""

    name: str
    bands: list[str]
    products: list[str]
    mask_bits: str | None = None
    offset: float = 0.0
    factor: float = 0.0
    clip: float = 254.0
    colours: list[tuple[int, int, int, int]] = field(default_factory=list)
    zoom_limit: float = 0.0
    accumulate_minutes: int = 0
    mask_tests: list[str] = field(default_factory=list)
    interpolate: bool = True
    sources: list[tuple[str, str]] = field(default_factory=list)


@dataclass
class TileRequest:
    """A window of pixels at a time, or from a time on for the layer's step."""

    x: tuple[int, int]
    y: tuple[int, int]
    start: str
    end: str
    resolution: float = 0.0


def layer_document(text: str) -> dict:
    """A configuration: JSON in which what stands between two ``$gdoc$`` is a text as it is."""
    parts = text.split("$gdoc$")
    if len(parts) % 2 == 0:
        raise ValueError("a $gdoc$ isn't closed")
    return json.loads("".join(json.dumps(p) if i % 2 else p for i, p in enumerate(parts)))


def layer_of(entry: dict) -> Layer:
    """One layer of a configuration; its bands are the variables of its products."""
    products = list(entry.get("rgb_products") or [])
    bands = list(dict.fromkeys(v for p in products for v in expressions.parse(p).variables))
    mask, palette = entry.get("mask") or {}, entry.get("palette") or {}
    step = 1440 * entry.get("step_days", 0) + 60 * entry.get("step_hours", 0) + entry.get("step_minutes", 0)
    return Layer(
        entry["name"], bands, products, mask.get("value") or None, float(entry.get("offset_value", 0)), float(entry.get("scale_value", 0)),
        float(entry.get("clip_value", 254)), [tuple(c[k] for k in "RGBA") for c in palette.get("colours") or []], float(entry.get("zoom_limit", 0)),
        step if entry.get("accum") else 0, list(mask.get("bit_tests") or []), bool(palette.get("interpolate")),
        [(s.get("namespace", ""), s["name"]) for s in entry.get("input_layers") or []],
    )


def read_layers(spark: SparkSession, root: str) -> dict[str, list[Layer]]:
    """The layers of every ``config.json`` below ``root``, by folder (the namespace, ``.`` for ``root`` itself).

    A layer without a namespace among its ``input_layers`` means its own. Configurations are short; they come to the driver.
    """
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "config.json").text(root, wholetext=True)
    out = {}
    for path, text in files.select(F.input_file_name(), "value").collect():
        # The folder below root, whatever scheme its address is written with.
        at = re.search(re.escape(re.sub(r"^\w+:/*", "/", root).rstrip("/")) + r"/(?:(.*)/)?config\.json$", path)
        namespace = at[1] or "." if at else path.rsplit("/", 1)[0]
        out[namespace] = [layer_of(e) for e in layer_document(text).get("layers", [])]
        for layer in out[namespace]:
            layer.sources = [(n or namespace, s) for n, s in layer.sources]
    return out


def source_layers(layers: dict[str, list[Layer]], layer: Layer) -> list[Layer]:
    """The layers that a fused one is made of, in order; an unknown one is an error."""
    return [find_layer(layers.get(n, []), s) for n, s in layer.sources]


def find_layer(layers: list[Layer], name: str) -> Layer:
    """The first layer of that name."""
    for layer in layers:
        if layer.name == name:
            return layer
    raise LookupError(f"no layer {name}")


def _seen(source: DataFrame, layer: Layer, request: TileRequest) -> DataFrame:
    """The granules' pixels that a request reads; all filters reach the scan."""
    start, end = (F.lit(t).cast("timestamp_ntz") for t in (request.start, request.end))
    out = source.where(F.col("band").isin(layer.bands) & F.col("ts").between(start, end))
    out = out.where(F.col("px").between(*request.x) & F.col("py").between(*request.y))
    out = out.where(~raster.masked_by_value(F.col("qa"), layer.mask_bits)) if layer.mask_bits else out
    return out.where(~raster.masked_by_tests(F.col("qa"), layer.mask_tests)) if layer.mask_tests else out


def products(source: DataFrame, layer: Layer, request: TileRequest) -> DataFrame:
    """Mosaic of the layer's bands and its products: one column per product."""
    wide = raster.aligned(raster.mosaic(_seen(source, layer, request), ["band", "py", "px"], KEYS), ["py", "px"], "band", layer.bands)
    made = expressions.parse_all(layer.products, layer.bands)
    return wide.select("py", "px", *(raster.band_math(wide, list(e.variables), e.column()).alias(e.name) for e in made))


def get_map(source: DataFrame, layer: Layer, request: TileRequest) -> DataFrame:
    """Colours of a map tile: one product through the palette, or three as red, green and blue.

    Below the layer's zoom limit there is nothing to show.
    """
    if layer.zoom_limit and request.resolution > layer.zoom_limit:
        return products(source, layer, request).limit(0)
    made = products(source, layer, request)
    names = [c for c in made.columns if c not in ("py", "px")]
    scaled = made.select("py", "px", *(raster.scale(F.col(n), layer.offset, layer.factor, layer.clip).alias(n) for n in names))
    if len(names) == 3:
        return raster.rgb(scaled, *names).select("py", "px", "r", "g", "b", "a")
    if len(names) != 1:
        raise ValueError("a map shows one product or three")
    return raster.coloured(scaled.withColumnRenamed(names[0], "byte"), "byte", layer.colours, layer.interpolate).select("py", "px", "r", "g", "b", "a")


def get_coverage(source: DataFrame, layer: Layer, request: TileRequest, subset: str = "", tile: int = 1024) -> DataFrame:
    """Products of a window in long form with tile numbers, ready to be written tile by tile."""
    for name, choice in requests.parse_subset(subset).items():
        source = source.where(choice.keep(F.col(name)))
    made = products(source, layer, request)
    names = [c for c in made.columns if c not in ("py", "px")]
    long = made.unpivot(["py", "px"], names, "band", "value").where("value IS NOT NULL")
    return raster.tiles(long, tile, tile).select("band", "tile_y", "tile_x", "py", "px", "value")


def feature_info(source: DataFrame, layer: Layer, x: int, y: int, request: TileRequest) -> DataFrame:
    """The layer's bands under one pixel, read from its 2 x 2 neighbourhood only."""
    near = TileRequest((x, x + 1), (y, y + 1), request.start, request.end)
    return raster.point(_seen(source, layer, near), x, y, ["band"], KEYS)


def drill(source: DataFrame, layer: Layer, request: TileRequest, low: float, high: float, algorithm: str = "mean") -> DataFrame:
    """A region's time series per band: ``mean``, ``pixel_count`` or ``deciles``, by month."""
    own = _seen(source, layer, request).withColumn("month", F.date_format(F.trunc("ts", "month"), "yyyy-MM-dd"))
    if algorithm == "mean":
        return drills.zonal_mean(own, ["band", "month"], low, high)
    if algorithm == "pixel_count":
        return drills.pixel_fraction(own, ["band", "month"], low, high)
    if algorithm == "deciles":
        return drills.deciles(own, ["band", "month"])
    raise ValueError(f"no algorithm {algorithm}")


LAYERS = [
    Layer("true", ["A", "N", "R"], ["r = R", "g = A", "b = N"], mask_bits="1000", clip=50.0),
    Layer("index", ["A", "R"], ["v = (A - R) / (A + R) * 100 + 100"], clip=200.0, colours=[(0, 0, 0, 255), (255, 255, 255, 255)]),
]
REQUEST = TileRequest((2, 9), (1, 12), "1995-06-01", "1999-12-31")
SEEN = "px BETWEEN 2 AND 9 AND py BETWEEN 1 AND 12 AND ts BETWEEN TIMESTAMP '1995-06-01' AND TIMESTAMP '1999-12-31'"
_MOSAIC = """m AS (SELECT band, py, px, arg_max(value, row(ts, k1, k2, k3, k4)) AS v FROM pixels WHERE value IS NOT NULL AND {} GROUP BY band, py, px),
    w AS (SELECT py, px, max(v) FILTER (band = 'A') AS a, max(v) FILTER (band = 'N') AS n, max(v) FILTER (band = 'R') AS r FROM m GROUP BY py, px)"""


@query(
    "service_map_rgb",
    f"""WITH {_MOSAIC.format(SEEN + ' AND (qa & 8) = 0')}, s AS (SELECT py, px, CASE WHEN r IS NULL THEN 255 ELSE CAST(floor(least(r, 50.0) * 5.08) AS INT) END AS r,
      CASE WHEN a IS NULL THEN 255 ELSE CAST(floor(least(a, 50.0) * 5.08) AS INT) END AS g, CASE WHEN n IS NULL THEN 255 ELSE CAST(floor(least(n, 50.0) * 5.08) AS INT) END AS b FROM w)
    SELECT *, CASE WHEN r = 255 AND g = 255 AND b = 255 THEN 0 ELSE 255 END AS a FROM s""",
    "pixels",
)
def service_map_rgb(spark, sf_dir):
    """A map request with three products."""
    return get_map(pixels(spark, sf_dir), find_layer(LAYERS, "true"), REQUEST)


@query(
    "service_map_index",
    f"""WITH {_MOSAIC.format(SEEN)}, s AS (SELECT py, px, CASE WHEN a IS NULL OR r IS NULL THEN 255 ELSE CAST(floor(least(greatest((a - r) / (a + r) * 100 + 100, 0.0), 200.0) * 1.27) AS INT) END AS i FROM w)
    SELECT py, px, CAST(trunc(i * 255 / 256) AS INT) AS r, CAST(trunc(i * 255 / 256) AS INT) AS g, CAST(trunc(i * 255 / 256) AS INT) AS b, CASE WHEN i = 255 THEN 0 ELSE 255 END AS a FROM s""",
    "pixels",
)
def service_map_index(spark, sf_dir):
    """A map request with an expression and a palette."""
    return get_map(pixels(spark, sf_dir), find_layer(LAYERS, "index"), REQUEST)


@query(
    "service_coverage",
    f"""WITH {_MOSAIC.format(SEEN + ' AND qa <= 7')} SELECT 'v' AS band, CAST(py // 4 AS INT) AS tile_y, CAST(px // 4 AS INT) AS tile_x, py, px, round((a - r) / (a + r) * 100 + 100, 6) AS value
    FROM w WHERE a IS NOT NULL AND r IS NOT NULL""",
    "pixels",
)
def service_coverage(spark, sf_dir):
    """A coverage request with a subset, as tiles."""
    out = get_coverage(pixels(spark, sf_dir), find_layer(LAYERS, "index"), REQUEST, "qa(*,7)", 4)
    return out.withColumn("value", F.round("value", 6))


@query("service_point", f"SELECT band, coalesce(printf('%.4f', arg_max(value, row(ts, k1, k2, k3, k4)) FILTER (value IS NOT NULL)), 'n/a') AS value FROM pixels WHERE px = 5 AND py = 6 AND {SEEN} AND band IN ('A', 'R') GROUP BY band", "pixels")
def service_point(spark, sf_dir):
    """A point request."""
    return feature_info(pixels(spark, sf_dir), find_layer(LAYERS, "index"), 5, 6, REQUEST)


@query(
    "service_drill",
    f"""SELECT band, strftime(date_trunc('month', ts), '%Y-%m-%d') AS month, round(coalesce(count(CASE WHEN value BETWEEN 10 AND 40 THEN 1 END) / nullif(count(value), 0), 0), 6) AS value, count(value) AS count
    FROM pixels WHERE {SEEN} AND (qa & 8) = 0 GROUP BY 1, 2""",
    "pixels",
)
def service_drill(spark, sf_dir):
    """A drill request by pixel counts (Q8)."""
    return drill(pixels(spark, sf_dir), find_layer(LAYERS, "true"), REQUEST, 10, 40, "pixel_count").withColumn("value", F.round("value", 6))
