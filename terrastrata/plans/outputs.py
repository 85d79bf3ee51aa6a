"""Queries of sources, sinks and geometry helpers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import geo
from ..model import bands, footprints, pixels, series
from ..operators import catalog, raster
from ..sources import crawl, sinks
from .base import query
from .rasters import KEYS, LATEST


@query("segmentize", """WITH e AS (SELECT id, xmax - xmin AS w, ymax - ymin AS h FROM footprints)
    SELECT id, CAST(2 * (greatest(ceil(w / 0.75), 1) + greatest(ceil(h / 0.75), 1)) AS INT) AS n, 2 * (w + h) AS length FROM e""", "footprints")  # fmt: skip
def segmentize(spark, sf_dir):
    """Footprints with points along their edges before reprojection."""
    b = [F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")]
    ring = F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in ((b[0], b[1]), (b[2], b[1]), (b[2], b[3]), (b[0], b[3]))))
    out = footprints(spark, sf_dir).select("id", geo.segmentized(geo.ring_edges(ring), 0.75).alias("p"), geo.ring_edges(ring).alias("e"))
    length = F.aggregate("e", F.lit(0.0), lambda a, e: a + F.abs(e["x2"] - e["x1"]) + F.abs(e["y2"] - e["y1"]))
    return out.select("id", F.size("p").alias("n"), length.alias("length"))


@query("dateline_split", "SELECT id, CASE WHEN xmin < 0 AND xmax > 0 THEN 2 ELSE 1 END AS parts, CASE WHEN xmin < 0 AND xmax > 0 THEN (180 - xmax) + (xmin + 180) ELSE xmax - xmin END AS width FROM footprints", "footprints")
def dateline_split(spark, sf_dir):
    """Boxes over the antimeridian as two."""
    parts = geo.split_dateline(tuple(F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")))
    out = footprints(spark, sf_dir).select("id", parts.alias("p"))
    return out.select("id", F.size("p").alias("parts"), F.aggregate("p", F.lit(0.0), lambda a, b: a + b["xmax"] - b["xmin"]).alias("width"))


@query("lossy_transform", "SELECT id, CAST((abs(ymin) < 90)::INT * 2 + (abs(ymax) < 90)::INT * 2 AS INT) AS points FROM footprints", "footprints")
def lossy_transform(spark, sf_dir):
    """Rings in Mercator without the points that don't exist there."""
    b = [F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")]
    ring = F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in ((b[0], b[1]), (b[2], b[1]), (b[2], b[3]), (b[0], b[3]))))
    return footprints(spark, sf_dir).select("id", F.size(geo.lossy_transform(ring, 4326, 3857)).alias("points"))


#: Of each column of points the lowest and the highest; a corner is where the slopes from the left stay below those to
#: the right (above, on the upper side), which leaves out points on an edge.
@query("convex_hull", """WITH c AS (SELECT ns, xmin AS x, min(ymin) AS lo, max(ymin) AS hi FROM footprints GROUP BY ns, xmin),
    s AS (SELECT p.ns, p.x, p.lo, p.hi, max((p.lo - q.lo) / (p.x - q.x)) FILTER (q.x < p.x) AS l1, min((q.lo - p.lo) / (q.x - p.x)) FILTER (q.x > p.x) AS l2,
      min((p.hi - q.hi) / (p.x - q.x)) FILTER (q.x < p.x) AS h1, max((q.hi - p.hi) / (q.x - p.x)) FILTER (q.x > p.x) AS h2 FROM c p JOIN c q USING (ns) GROUP BY 1, 2, 3, 4)
    SELECT ns, x, lo AS y FROM s WHERE l1 IS NULL OR l2 IS NULL OR l1 < l2 UNION SELECT ns, x, hi FROM s WHERE h1 IS NULL OR h2 IS NULL OR h1 > h2""", "footprints")  # fmt: skip
def convex_hull(spark, sf_dir):
    """Corners of the hull of each variable's granules."""
    corners = footprints(spark, sf_dir).select("ns", F.col("xmin").alias("x"), F.col("ymin").alias("y"))
    return catalog.hulls(corners, ["ns"])


@query("picture_tiles")
def picture_tiles(spark, sf_dir):
    """PNG tiles of three bands (K5, Q6)."""
    scaled = raster.mosaic(pixels(spark, sf_dir), ["band", "py", "px"], KEYS).withColumn("value", raster.scale(F.col("value"), 0, 0, 50))
    wide = raster.rgb(raster.aligned(scaled, ["py", "px"], "band", ["A", "N", "R"]).fillna(255, ["A", "N", "R"]), "R", "A", "N")
    tiled = wide.select(F.expr("px div 8").alias("tile_x"), F.expr("py div 8").alias("tile_y"), (F.col("px") % 8).alias("px"), (F.col("py") % 8).alias("py"), "r", "g", "b", "a")
    return sinks.pictures(tiled, ["tile_x", "tile_y"], 8, 8)


@query("feature_info_json")
def feature_info_json(spark, sf_dir):
    """A point's values with dates and links as one document."""
    f = footprints(spark, sf_dir)
    days = catalog.latest_days(f.select("id", F.col("hi").alias("ts")), 5).select(F.date_format("day", "yyyy-MM-dd").alias("day"))
    return sinks.feature_info(raster.point(pixels(spark, sf_dir), 4, 7, ["band"], KEYS), days, catalog.data_links(f, "/v/data/F/", 5))


@query("virtual_raster", f"""WITH m AS (SELECT band, py, px, {LATEST} AS v FROM pixels WHERE value IS NOT NULL GROUP BY band, py, px),
    w AS (SELECT py, px, max(v) FILTER (band = 'A') AS a, max(v) FILTER (band = 'N') AS n FROM m GROUP BY py, px)
    SELECT py, px, (a + n) / 2 AS mean, greatest(a, n) AS top FROM w""", "pixels")  # fmt: skip
def virtual_raster(spark, sf_dir):
    """Bands derived from others by name."""
    own = raster.mosaic(pixels(spark, sf_dir), ["band", "py", "px"], KEYS)
    return crawl.virtual_bands(own, ["py", "px"], ["A", "N"], {"mean": "(A + N) / 2", "top": "greatest(A, N)"})


@query("pixel_function", "SELECT t, py, px, round(greatest(value, 0) * 2, 6) AS value FROM bands", "bands")
def pixel_function(spark, sf_dir):
    """A user's function over pixel arrays."""
    out = crawl.pixel_function(bands(spark, sf_dir).select("t", "py", "px", "value"), "value", lambda v: np.maximum(v, 0) * 2)
    return out.withColumn("value", F.round("value", 6))


@query("metrics_windows", """SELECT strftime(time_bucket(INTERVAL 30 MINUTE, ts), '%Y-%m-%dT%H:%M:%SZ') AS start, ns, count(*) AS requests, CAST(sum(event_id) AS BIGINT) AS bytes FROM series GROUP BY 1, 2""", "series")
def metrics_windows(spark, sf_dir):
    """Metrics per half hour, as the stream computes them."""
    from ..streaming.pipelines import metrics_windows as windows

    records = series(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("ts"), "ns", F.lit(1).cast("long").alias("duration"), F.col("event_id").alias("bytes"))
    out = windows(records, "30 minutes")
    return out.select(F.date_format("window.start", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("start"), "ns", "requests", "bytes")


@query("file_listing", """SELECT name || '.parquet' AS name, true AS filled, 32 AS id_length FROM (VALUES ('region'), ('nation'), ('customer'), ('supplier'), ('part'), ('orders'), ('lineitem'),
    ('events'), ('documents'), ('embeddings'), ('pages'), ('benchmark'), ('labels'), ('conversations')) v(name)""")
def file_listing(spark, sf_dir):
    """Files below a folder by a filter, without reading them."""
    found = crawl.list_files(spark, sf_dir, "path =~ 'parquet$' && !(path =~ 'part-')", whole=".parquet")
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), (F.col("size") > 0).alias("filled"), F.length("id").alias("id_length"))
