"""Raster queries over the virtual pixel tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import bands, footprints, pixels, table
from ..operators import raster
from .base import query

KEYS = ["ts", "k1", "k2", "k3", "k4"]
LATEST = "arg_max(value, row(ts, k1, k2, k3, k4)) FILTER (value IS NOT NULL)"


def _mosaic(spark, sf_dir):
    return raster.mosaic(pixels(spark, sf_dir), ["band", "py", "px"], KEYS)


@query("mosaic_latest", f"SELECT band, py, px, {LATEST} AS value FROM pixels WHERE value IS NOT NULL GROUP BY band, py, px", "pixels")
def mosaic(spark, sf_dir):
    """Latest valid value per pixel."""
    return _mosaic(spark, sf_dir)


@query(
    "mosaic_canvas",
    f"""WITH m AS (SELECT py, px, {LATEST} AS value FROM pixels WHERE value IS NOT NULL AND band = 'N' AND ts < '1998-01-01' GROUP BY py, px)
    SELECT CAST(y AS INT) AS py, CAST(x AS INT) AS px, coalesce(value, -999.0) AS value FROM range(16) a(y), range(16) b(x) LEFT JOIN m ON py = y AND px = x""",
    "pixels",
)
def canvas(spark, sf_dir):
    """A full grid with nodata where nothing was seen (R2)."""
    seen = pixels(spark, sf_dir).where((F.col("band") == "N") & (F.col("ts") < F.lit("1998-01-01").cast("timestamp_ntz")))
    axis = F.sequence(F.lit(0), F.lit(15))
    grid = spark.range(1).select(F.explode(axis).alias("py")).select("py", F.explode(axis).alias("px"))
    return raster.canvas(grid, raster.mosaic(seen, ["py", "px"], KEYS), ["py", "px"], -999.0)


@query("mask_by_value", f"SELECT band, py, px, {LATEST} AS value FROM pixels WHERE value IS NOT NULL AND (qa & 6) = 0 GROUP BY band, py, px", "pixels")
def mask_by_value(spark, sf_dir):
    """Mosaic of the pixels without the bits of a binary mask."""
    clear = pixels(spark, sf_dir).where(~raster.masked_by_value(F.col("qa"), "110"))
    return raster.mosaic(clear, ["band", "py", "px"], KEYS)


@query(
    "mask_by_bit_tests",
    f"SELECT band, py, px, {LATEST} AS value FROM pixels WHERE value IS NOT NULL AND NOT ((qa & 3) = 1 OR (qa & 12) = 8) GROUP BY band, py, px",
    "pixels",
)
def mask_by_bit_tests(spark, sf_dir):
    """Mosaic of the pixels that pass pairs of bit tests."""
    clear = pixels(spark, sf_dir).where(~raster.masked_by_tests(F.col("qa"), ["0011", "0001", "1100", "1000"]))
    return raster.mosaic(clear, ["band", "py", "px"], KEYS)


@query(
    "mask_join",
    """WITH d AS (SELECT * FROM pixels WHERE band = 'A'), m AS (SELECT ts, py, px, max(qa) AS mask FROM pixels WHERE band = 'R' GROUP BY ALL)
    SELECT d.k1, d.k2, d.k3, d.k4, CASE WHEN coalesce((m.mask & 8) > 0, false) THEN NULL ELSE value END AS value
    FROM d LEFT JOIN m USING (ts, py, px)""",
    "pixels",
)
def mask_join(spark, sf_dir):
    """A mask raster applied to data by time and pixel."""
    all_ = pixels(spark, sf_dir)
    mask = all_.where("band = 'R'").groupBy("ts", "py", "px").agg(F.max("qa").alias("mask"))
    out = raster.apply_mask(all_.where("band = 'A'"), mask, ["ts", "py", "px"], raster.masked_by_value(F.col("mask"), "1000"))
    return out.select("k1", "k2", "k3", "k4", "value")


@query(
    "scale_bytes",
    """SELECT k1, k2, k3, k4, CASE WHEN value IS NULL THEN 255 ELSE CAST(floor(least(greatest(value - 3, 0.0), 40.0) * 6.35) AS INT) END AS byte FROM pixels""",
    "pixels",
)
def scale_bytes(spark, sf_dir):
    """Offset, clip and scale to bytes."""
    return pixels(spark, sf_dir).select("k1", "k2", "k3", "k4", raster.scale(F.col("value"), -3, 0, 40).alias("byte"))


@query(
    "scale_auto",
    """WITH r AS (SELECT ns, min(value) AS lo, max(value) AS hi FROM bands GROUP BY ns)
    SELECT ns, t, py, px, CAST(floor((value - lo) * (254 / (CASE WHEN hi = lo THEN hi + 0.1 ELSE hi END - lo))) AS INT) AS byte FROM bands JOIN r USING (ns)""",
    "bands",
)
def scale_auto(spark, sf_dir):
    """Scaled by each variable's own range."""
    return raster.auto_scale(bands(spark, sf_dir), ["ns"]).select("ns", "t", "py", "px", "byte")


@query("scale_range", "SELECT band, min(value) AS lo, max(value) AS hi FROM pixels GROUP BY band", "pixels")
def scale_range(spark, sf_dir):
    """Range of the valid pixels."""
    return pixels(spark, sf_dir).groupBy("band").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))


@query("scale_log", "SELECT t, py, px, CASE WHEN value > 0 THEN round(log10(value), 9) END AS value FROM bands", "bands")
def scale_log(spark, sf_dir):
    """Logarithmic scale; what has no logarithm is nodata."""
    return bands(spark, sf_dir).select("t", "py", "px", F.round(raster.log_scale(F.col("value")), 9).alias("value"))


RAMP = [(255, 255, 229, 255), (120, 198, 121, 255), (0, 69, 41, 255)]


@query(
    "palette_ramp",
    """SELECT i, CAST(CASE WHEN i < 128 THEN 255 + trunc(i * -135 / 128) ELSE 120 + trunc((i - 128) * -120 / 128) END AS INT) AS r,
    CAST(CASE WHEN i < 128 THEN 255 + trunc(i * -57 / 128) ELSE 198 + trunc((i - 128) * -129 / 128) END AS INT) AS g,
    CAST(CASE WHEN i < 128 THEN 229 + trunc(i * -108 / 128) ELSE 121 + trunc((i - 128) * -80 / 128) END AS INT) AS b, 255 AS a
    FROM (SELECT CAST(range AS INT) AS i FROM range(256))""",
)
def palette_ramp(spark, sf_dir):
    """256 interpolated colours."""
    return spark.createDataFrame([(i, *c) for i, c in enumerate(raster.palette(RAMP, True))], "i int, r int, g int, b int, a int")


@query(
    "render_palette",
    f"""WITH m AS (SELECT py, px, {LATEST} AS value FROM pixels WHERE band = 'A' AND value IS NOT NULL GROUP BY py, px),
    s AS (SELECT py, px, CAST(floor(least(greatest(value, 0.0), 50.0) * 5.08) AS INT) AS i FROM m)
    SELECT py, px, CAST(CASE WHEN i < 128 THEN 255 + trunc(i * -135 / 128) ELSE 120 + trunc((i - 128) * -120 / 128) END AS INT) AS r,
    CAST(CASE WHEN i < 128 THEN 255 + trunc(i * -57 / 128) ELSE 198 + trunc((i - 128) * -129 / 128) END AS INT) AS g,
    CAST(CASE WHEN i < 128 THEN 229 + trunc(i * -108 / 128) ELSE 121 + trunc((i - 128) * -80 / 128) END AS INT) AS b,
    CASE WHEN i = 255 THEN 0 ELSE 255 END AS a FROM s""",
    "pixels",
)
def render_palette(spark, sf_dir):
    """Map tile of one band: mosaic, scale, palette (Q6, P7, J-broadcast)."""
    m = raster.mosaic(pixels(spark, sf_dir).where("band = 'A'"), ["py", "px"], KEYS)
    scaled = m.withColumn("byte", raster.scale(F.col("value"), 0, 0, 50))
    return raster.coloured(scaled, "byte", RAMP).select("py", "px", "r", "g", "b", "a")


@query(
    "render_rgb",
    f"""WITH m AS (SELECT band, py, px, CAST(floor(least({LATEST}, 50.0) * 5.08) AS INT) AS v FROM pixels WHERE value IS NOT NULL GROUP BY band, py, px),
    w AS (SELECT py, px, coalesce(max(v) FILTER (band = 'R'), 255) AS r, coalesce(max(v) FILTER (band = 'A'), 255) AS g, coalesce(max(v) FILTER (band = 'N'), 255) AS b
      FROM m GROUP BY py, px)
    SELECT py, px, r, g, b, CASE WHEN r = 255 AND g = 255 AND b = 255 THEN 0 ELSE 255 END AS a FROM w""",
    "pixels",
)
def render_rgb(spark, sf_dir):
    """Three bands as one picture."""
    scaled = _mosaic(spark, sf_dir).withColumn("value", raster.scale(F.col("value"), 0, 0, 50))
    wide = raster.aligned(scaled, ["py", "px"], "band", ["A", "N", "R"]).fillna(255, ["A", "N", "R"])
    return raster.rgb(wide, "R", "A", "N").select("py", "px", "r", "g", "b", "a")


@query(
    "band_math",
    f"""WITH m AS (SELECT band, py, px, {LATEST} AS v FROM pixels WHERE value IS NOT NULL GROUP BY band, py, px),
    w AS (SELECT py, px, max(v) FILTER (band = 'A') AS a, max(v) FILTER (band = 'N') AS n, max(v) FILTER (band = 'R') AS r FROM m GROUP BY py, px)
    SELECT py, px, CASE WHEN a IS NOT NULL AND n IS NOT NULL AND r IS NOT NULL AND a + n <> r THEN round((a - n) / (a + n - r), 6) END AS value FROM w""",
    "pixels",
)
def band_math(spark, sf_dir):
    """An expression over aligned bands; nodata and non-finite results are nodata."""
    wide = raster.aligned(_mosaic(spark, sf_dir), ["py", "px"], "band", ["A", "N", "R"])
    value = F.try_divide(F.col("A") - F.col("N"), F.col("A") + F.col("N") - F.col("R"))
    return wide.select("py", "px", F.round(raster.band_math(wide, ["A", "N", "R"], value), 6).alias("value"))


@query(
    "feature_info",
    f"""SELECT band, coalesce(printf('%.4f', {LATEST}), 'n/a') AS value FROM pixels WHERE px = 4 AND py = 7 GROUP BY band""",
    "pixels",
)
def feature_info(spark, sf_dir):
    """Values under one pixel."""
    return raster.point(pixels(spark, sf_dir), 4, 7, ["band"], KEYS)


@query(
    "warp_nearest",
    """WITH g AS (SELECT CAST(x AS INT) AS dx, CAST(y AS INT) AS dy, CAST(floor((x + 0.5) * 0.7 - 0.9 + 1e-10) AS INT) AS sx, CAST(floor((y + 0.5) * 0.7 - 0.9 + 1e-10) AS INT) AS sy
      FROM range(14) a(x), range(14) b(y))
    SELECT t, dx, dy, value FROM g JOIN bands ON px = sx AND py = sy WHERE sx BETWEEN 0 AND 7 AND sy BETWEEN 0 AND 7""",
    "bands",
)
def warp_nearest(spark, sf_dir):
    """A raster resampled to another grid by nearest neighbour."""
    axis = F.sequence(F.lit(0), F.lit(13))
    grid = spark.range(1).select(F.explode(axis).alias("dx")).select("dx", F.explode(axis).alias("dy"))
    out = raster.warp(bands(spark, sf_dir), grid, (F.col("dx") + 0.5) * 0.7 - 0.9, (F.col("dy") + 0.5) * 0.7 - 0.9, 8, 8)
    return out.select("t", "dx", "dy", "value")


@query(
    "warp_mercator",
    """WITH g AS (SELECT CAST(x AS INT) AS dx, CAST(y AS INT) AS dy, -20000000 + (x + 0.5) * 1250000 AS mx, 15000000 - (y + 0.5) * 937500 AS my FROM range(32) a(x), range(32) b(y)),
    d AS (SELECT dx, dy, CAST(floor((degrees(mx / 6378137.0) + 180) / 22.5 + 1e-10) AS INT) AS sx,
      CAST(floor((90 - degrees(2 * atan(exp(my / 6378137.0)) - pi() / 2)) / 11.25 + 1e-10) AS INT) AS sy FROM g),
    s AS (SELECT py, px, round(avg(value), 6) AS value FROM pixels GROUP BY py, px)
    SELECT dx, dy, value FROM d JOIN s ON px = sx AND py = sy""",
    "pixels",
)
def warp_mercator(spark, sf_dir):
    """A geographic raster on a Mercator grid."""
    from ..functions import geo

    axis = F.sequence(F.lit(0), F.lit(31))
    grid = spark.range(1).select(F.explode(axis).alias("dx")).select("dx", F.explode(axis).alias("dy"))
    lon, lat = geo.to_degrees(-20000000 + (F.col("dx") + 0.5) * 1250000, 15000000 - (F.col("dy") + 0.5) * 937500)
    source = pixels(spark, sf_dir).groupBy("py", "px").agg(F.round(F.avg("value"), 6).alias("value"))
    return raster.warp(source, grid, (lon + 180) / 22.5, (90 - lat) / 11.25, 16, 16).select("dx", "dy", "value")


@query("overview_blocks", "SELECT t, CAST(px // 4 AS INT) AS px, CAST(py // 4 AS INT) AS py, round(avg(value), 6) AS value FROM bands GROUP BY ALL", "bands")
def overview_blocks(spark, sf_dir):
    """The overview level that fits a wanted reduction of five."""
    levels = [2.0, 4.0, 8.0]
    k = int(levels[raster.overview(levels, 5.0)])
    out = raster.reduced(bands(spark, sf_dir), ["t"], k)
    return out.select("t", F.col("px").cast("int").alias("px"), F.col("py").cast("int").alias("py"), F.round("value", 6).alias("value"))


@query(
    "tile_counts",
    """SELECT CAST(px // 4 AS INT) AS tile_x, CAST(py // 8 AS INT) AS tile_y, count(*) AS n, CAST(sum(px % 4) AS BIGINT) AS sx, CAST(sum(py % 8) AS BIGINT) AS sy
    FROM pixels GROUP BY ALL""",
    "pixels",
)
def tile_counts(spark, sf_dir):
    """Pixels cut into tiles."""
    return raster.tiles(pixels(spark, sf_dir), 4, 8).groupBy("tile_x", "tile_y").agg(F.count(F.lit(1)).alias("n"), F.sum("in_x").alias("sx"), F.sum("in_y").alias("sy"))


@query(
    "coverage_windows",
    """WITH c AS (SELECT CAST(x * 1024 AS INT) AS x, CAST(y * 1024 AS INT) AS y, row_number() OVER (ORDER BY y, x) - 1 AS i FROM range(5) a(x), range(3) b(y))
    SELECT x, y, CAST(least(1024, 5000 - x) AS INT) AS width, CAST(least(1024, 3000 - y) AS INT) AS height, CAST(i // 5 AS INT) AS worker FROM c""",
)
def coverage_windows(spark, sf_dir):
    """Windows of a large request, dealt to workers in runs."""
    return spark.createDataFrame(raster.windows(5000, 3000, 1024, 4), "x int, y int, width int, height int, worker int")


@query("missing_bands", "SELECT b AS band FROM (VALUES ('A'), ('Q'), ('Z')) v(b) WHERE b NOT IN (SELECT band FROM pixels)", "pixels")
def missing_bands(spark, sf_dir):
    """Required bands that no granule has."""
    return raster.require_bands(pixels(spark, sf_dir), ["A", "Q", "Z"])


@query(
    "fusion_layers",
    f"""WITH l AS (SELECT band, py, px, {LATEST} AS value FROM pixels WHERE value > 20 GROUP BY band, py, px),
    r AS (SELECT *, row_number() OVER (PARTITION BY py, px ORDER BY band) AS k FROM l)
    SELECT py, px, value, CAST(CASE band WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS INT) AS layer FROM r WHERE k = 1""",
    "pixels",
)
def fusion_layers(spark, sf_dir):
    """Layers blended, the first valid one winning."""
    seen = pixels(spark, sf_dir).where("value > 20")
    layers = [raster.mosaic(seen.where(F.col("band") == b), ["py", "px"], KEYS) for b in ("A", "N", "R")]
    return raster.fuse(layers, ["py", "px"])


@query(
    "fusion_time_weighted",
    """SELECT py, px, round(sum(value * w) / sum(w), 6) AS value FROM bands JOIN (VALUES (3, 0.5), (4, 0.3), (5, 0.2)) v(t2, w) ON t = t2 GROUP BY py, px""",
    "bands",
)
def fusion_time_weighted(spark, sf_dir):
    """Three times combined by weights."""
    out = raster.time_weighted(bands(spark, sf_dir), ["py", "px"], {3: 0.5, 4: 0.3, 5: 0.2})
    return out.withColumn("value", F.round("value", 6))


@query(
    "raster_types",
    """SELECT CASE WHEN count(DISTINCT n_name) > 1 THEN 'mixed types' ELSE 'ok' END AS status FROM nation""",
)
def raster_types(spark, sf_dir):
    """Whether rasters share type and size (P10)."""
    rasters = table(spark, sf_dir, "nation").select(F.col("n_name").alias("kind"), F.lit(8).alias("width"), F.lit(8).alias("height"))
    return raster.same_shape(rasters)


@query(
    "output_sizes",
    """WITH s AS (SELECT id, CAST((xmax - xmin) * 100 AS INT) AS w, CAST((ymax - ymin) * 100 AS INT) AS h FROM footprints),
    k AS (SELECT *, least(least(w, 256.0) / w, least(h, 256.0) / h) AS f FROM s)
    SELECT id, CAST(greatest(floor(w * f + 0.5), 1) AS INT) AS width, CAST(greatest(floor(h * f + 0.5), 1) AS INT) AS height FROM k""",
    "footprints",
)
def output_sizes(spark, sf_dir):
    """Drill raster sizes under a pixel cap that keeps the aspect."""
    s = footprints(spark, sf_dir).select("id", ((F.col("xmax") - F.col("xmin")) * 100).cast("int").alias("w"), ((F.col("ymax") - F.col("ymin")) * 100).cast("int").alias("h"))
    w, h = raster.output_size(F.col("w"), F.col("h"), 256.0, 256.0)
    return s.select("id", w.alias("width"), h.alias("height"))


@query(
    "output_extent",
    """SELECT CAST(max(ceil((xmax - xmin) * 240)) AS BIGINT) AS width, CAST(max(ceil((ymax - ymin) * 240)) AS BIGINT) AS height FROM footprints""",
    "footprints",
)
def output_extent(spark, sf_dir):
    """The largest suggested size over all files."""
    f = footprints(spark, sf_dir)
    return f.agg(F.max(F.ceil((F.col("xmax") - F.col("xmin")) * 240)).alias("width"), F.max(F.ceil((F.col("ymax") - F.col("ymin")) * 240)).alias("height"))
