"""Queries of scans and of what is written and read back: scenes, rasters, pictures, coverages, rule sets."""

from __future__ import annotations

import json
import struct

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..model import bands, footprints, paths, pixels, table
from ..operators import catalog, ingest, raster
from ..sources import crawl, geotiff, sinks
from .base import query
from .rasters import KEYS, LATEST

SENTINEL = """extent:
  center_dt: '2018-01-%02dT00:11:22Z'
grid_spatial:
  projection:
    spatial_reference: EPSG:32755
    valid_data:
      coordinates: [[[%d, 2], [3, 4]]]
image:
  bands:
    nbar_red: {path: r.tif, info: {width: %d, height: 6, geotransform: [1, 10, 3, 4, 5, -10]}}
    fmask: {path: f.tif, info: {width: %d, height: 6}}
"""
LANDSAT = """crs: EPSG:%d
properties:
  datetime: '2018-01-%02d 00:05:18.123+00:00'
geometry:
  coordinates: [[[%d, 2], [3, 4]]]
measurements:
  blue: {path: b.tif}
  red: {path: sub/r.tif}
"""


def _scenes(spark, sf_dir, template: str, *values) -> object:
    """A document of each part; parts are dealt to all tasks first, since one small file of them makes many documents."""
    dealt = table(spark, sf_dir, "part").select("p_partkey", "p_size").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    return dealt.select(F.concat(F.lit("/s/p"), "p_partkey", F.lit("/scene.yaml")).alias("filename"), F.format_string(template, *values).alias("value"))


@query(
    "yaml_sentinel2",
    """SELECT '/s/p' || p_partkey || '/scene.yaml' AS filename, '/s/p' || p_partkey || '/' || f AS ds_name, n AS namespace, printf('2018-01-%02dT00:11:22Z', 1 + p_partkey % 28) AS timestamp,
    p_size AS x_size, 6 AS y_size, CASE WHEN n = 'nbar_red' THEN 10.0 END AS cell, 'POLYGON ((' || p_partkey || ' 2,3 4))' AS polygon, 'EPSG:32755' AS srs, k AS array_type
    FROM part, (VALUES ('nbar_red', 'r.tif', 'Int16'), ('fmask', 'f.tif', 'Byte')) b(n, f, k)""",
)
def yaml_sentinel2(spark, sf_dir):
    """Bands of Sentinel-2 scenes from their YAML documents (S3)."""
    key = F.col("p_partkey")
    out = crawl.yaml_bands(_scenes(spark, sf_dir, SENTINEL, key % 28 + 1, key, "p_size", "p_size"), "sentinel2")
    return out.withColumn("cell", F.get("geo_transform", F.lit(1))).drop("geo_transform")


@query(
    "yaml_landsat",
    """SELECT '/s/p' || p_partkey || '/' || f AS ds_name, n AS namespace, printf('2018-01-%02dT00:05:18Z', 1 + p_partkey % 28) AS timestamp,
    'POLYGON ((' || p_partkey || '.000000 2.000000,3.000000 4.000000))' AS polygon, 'EPSG:' || (32700 + p_partkey % 60) AS srs, 'Int16' AS array_type
    FROM part, (VALUES ('blue', 'b.tif'), ('red', 'sub/r.tif')) b(n, f)""",
)
def yaml_landsat(spark, sf_dir):
    """Bands of Landsat scenes from their YAML documents."""
    key = F.col("p_partkey")
    out = crawl.yaml_bands(_scenes(spark, sf_dir, LANDSAT, key % 60 + 32700, key % 28 + 1, key), "landsat")
    return out.select("ds_name", "namespace", "timestamp", "polygon", "srs", "array_type")


def _rasters(spark, sf_dir):
    """A GeoTIFF of each small raster."""
    own = bands(spark, sf_dir).withColumn("band", F.lit("v"))
    made = geotiff.tiles(own, ["t"], ["v"], 8, [130.0, 0.5, 0.0, -20.0, 0.0, -0.5], 4326, -9999.0)
    return made.select(F.concat(F.lit("/r/"), "t", F.lit(".tif")).alias("path"), F.col("tiff").alias("content"), F.length("tiff").cast("long").alias("length"))


@query(
    "tiff_headers",
    """SELECT '/r/' || vec_id || '.tif' AS path, 'Float32' AS array_type, 8 AS x_size, 8 AS y_size, 1 AS raster_count, 130.0 AS x0, -0.5 AS dy, -9999.0 AS nodata, 4326 AS epsg,
    'POLYGON ((130.000000 -20.000000,134.000000 -20.000000,134.000000 -24.000000,130.000000 -24.000000,130.000000 -20.000000))' AS polygon FROM embeddings""",
)
def tiff_headers(spark, sf_dir):
    """Catalogue rows from the headers of written rasters."""
    out = geotiff.headers(_rasters(spark, sf_dir))
    at = {"x0": F.get("geo_transform", F.lit(0)), "dy": F.get("geo_transform", F.lit(5))}
    return out.select("path", "array_type", "x_size", "y_size", "raster_count", *(c.alias(n) for n, c in at.items()), "nodata", "epsg", "polygon")


@query("tiff_pixels", "SELECT '/r/' || t || '.tif' AS path, 1 AS band, py, px, value FROM bands", "bands")
def tiff_pixels(spark, sf_dir):
    """Pixels of written rasters read back."""
    return geotiff.pixels(_rasters(spark, sf_dir))


@query("file_filters", "SELECT page_id, path FROM paths WHERE regexp_matches(path, '/(en|de)/') AND NOT (page_id % 3 = 0 OR contains(path, 'example.com'))", "paths")
def file_filters(spark, sf_dir):
    """Paths by a filter expression on path and type."""
    typed = paths(spark, sf_dir).withColumn("type", F.when(F.col("page_id") % 3 == 0, "dir").otherwise("file"))
    return typed.where(crawl.file_filter("path =~ '/(en|de)/' && !(type == 'dir' || path =~ 'example\\.com')")).select("page_id", "path")


@query(
    "posix_documents",
    """SELECT '/' || page_id AS in_path, 'posix' AS in_type, md5('/' || page_id || '|' || length(html) || '|' || (page_id * 1000000)) AS id,
    CAST(length(html) AS BIGINT) AS size, page_id AS mtime FROM pages""",
)
def posix_documents(spark, sf_dir):
    """Listed files written as crawler lines and read again."""
    listed = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("/"), "page_id").alias("path"), F.lit("file").alias("type"), F.length("html").cast("long").alias("size"), F.timestamp_seconds("page_id").alias("mtime")
    )
    doc = F.from_json("in_json", "id string, size long, mtime long")
    return ingest.lines(crawl.posix_lines(crawl.with_ids(listed))).select("in_path", "in_type", doc.alias("d")).select("in_path", "in_type", "d.*")


@query(
    "feature_info_document",
    f"""WITH v AS (SELECT band, coalesce(printf('%.4f', {LATEST}), 'n/a') AS value FROM pixels WHERE px = 4 AND py = 7 GROUP BY band),
    d AS (SELECT DISTINCT CAST(hi AS DATE) AS day FROM footprints ORDER BY day DESC LIMIT 5),
    l AS (SELECT DISTINCT substr(path, 11) AS link FROM footprints WHERE starts_with(path, '/v/data/F/') ORDER BY link LIMIT 5)
    SELECT 'band' AS kind, band AS name, value FROM v UNION ALL SELECT 'date', strftime(day, '%Y-%m-%d'), NULL FROM d UNION ALL SELECT 'link', link, NULL FROM l""",
    "pixels footprints",
)
def feature_info_document(spark, sf_dir):
    """What is read back from the document about a point."""
    f = footprints(spark, sf_dir)
    days = catalog.latest_days(f.select("id", F.col("hi").alias("ts")), 5).select(F.date_format("day", "yyyy-MM-dd").alias("day"))
    doc = sinks.feature_info(raster.point(pixels(spark, sf_dir), 4, 7, ["band"], KEYS), days, catalog.data_links(f, "/v/data/F/", 5))
    read = doc.select(F.from_json("json", "bands map<string,string>, dates array<string>, links array<string>").alias("j"))
    entry = lambda kind, name, value: F.struct(F.lit(kind).alias("kind"), name.alias("name"), value.alias("value"))
    nothing = F.lit(None).cast("string")
    rows = F.concat(
        F.transform(F.map_entries("j.bands"), lambda e: entry("band", e["key"], e["value"])),
        F.transform("j.dates", lambda d: entry("date", d, nothing)), F.transform("j.links", lambda d: entry("link", d, nothing)),
    )
    return read.select(F.inline(rows))


@query(
    "picture_pixels",
    f"""WITH m AS (SELECT band, py, px, CAST(floor(least({LATEST}, 50.0) * 5.08) AS INT) AS v FROM pixels WHERE value IS NOT NULL GROUP BY band, py, px),
    w AS (SELECT py, px, coalesce(max(v) FILTER (band = 'R'), 255) AS r, coalesce(max(v) FILTER (band = 'A'), 255) AS g, coalesce(max(v) FILTER (band = 'N'), 255) AS b
      FROM m GROUP BY py, px),
    t AS (SELECT CAST(y.range AS INT) AS py, CAST(x.range AS INT) AS px FROM range(16) y, range(16) x)
    SELECT CAST(py // 8 AS INT) AS tile_y, CAST(px // 8 AS INT) AS tile_x, CAST(py % 8 AS INT) AS py, CAST(px % 8 AS INT) AS px, coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(b, 0) AS b,
      CASE WHEN r IS NULL OR r = 255 AND g = 255 AND b = 255 THEN 0 ELSE 255 END AS a FROM t LEFT JOIN w USING (py, px)""",
    "pixels",
)
def picture_pixels(spark, sf_dir):
    """Pixels of the PNG tiles, read back (K5, Q6)."""
    from .outputs import picture_tiles

    out = sinks.picture_pixels(picture_tiles(spark, sf_dir), ["tile_x", "tile_y"])
    return out.select(F.col("tile_y").cast("int"), F.col("tile_x").cast("int"), "py", "px", "r", "g", "b", "a")


@query(
    "coverage_body",
    f"""WITH m AS (SELECT band, py, px, {LATEST} AS value FROM pixels WHERE value IS NOT NULL GROUP BY band, py, px)
    SELECT b.band, CAST(y.range AS INT) AS py, CAST(x.range AS INT) AS px, coalesce(value, -9.0) AS value
    FROM (VALUES ('A'), ('N'), ('R')) b(band), range(16) y, range(16) x LEFT JOIN m ON m.band = b.band AND m.py = y.range AND m.px = x.range""",
    "pixels",
)
def coverage_body(spark, sf_dir):
    """Values of a coverage's binary body, read back (K8)."""
    names = ["A", "N", "R"]
    body = sinks.coverage_parts(raster.mosaic(pixels(spark, sf_dir), ["band", "py", "px"], KEYS), names, 16, 16, -9.0)

    @F.pandas_udf("array<double>")
    def read(parts: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(p, "<f4", struct.unpack(">I", p[:4])[0] % 2**24 // 4, 4).astype(float) for p in parts])

    cells = body.select(F.get(F.array(*map(F.lit, names)), F.col("at")).alias("band"), F.posexplode(read("bytes")).alias("i", "value"))
    return cells.select("band", F.expr("i div 16").cast("int").alias("py"), (F.col("i") % 16).cast("int").alias("px"), "value")


#: A user's rules: by the whole path with a fixed box, by the name with rasters of places, and the rest.
OWN_RULES = json.dumps({"rule_sets": [
    {"collection": "finished", "namespace": "ns_combine", "pattern": r"/data/F/c(?P<namespace>\d+)/", "match_full_path": True, "bbox": [-180, 90, 180, -90]},
    {"collection": "tens", "namespace": "ns_path", "pattern": r"^o(?P<namespace>\d+)0\.nc$", "geo_loc": {
        "x_dataset_pattern": r"^(?P<file>.*)\.nc$", "x_dataset_template": "NETCDF:{{ .file }}:lon", "y_dataset_pattern": "c(?P<c>[0-9])/", "y_dataset_template": "lat{{.c}}"}},
    {"collection": "rest", "pattern": ".+"},
]})


@query(
    "own_rule_sets",
    """WITH f AS (SELECT id, path, ns, CASE WHEN contains(path, '/data/F/c') THEN 'finished' WHEN id % 10 = 0 AND id > 9 THEN 'tens' ELSE 'rest' END AS rule FROM footprints)
    SELECT id, rule, CASE rule WHEN 'finished' THEN regexp_extract(path, '/c(\\d+)/', 1) || ':' || ns WHEN 'tens' THEN CAST(id // 10 AS VARCHAR) ELSE ns END AS variable,
    CASE rule WHEN 'finished' THEN 'POLYGON ((-180.000000 90.000000,-180.000000 -90.000000,180.000000 -90.000000,180.000000 90.000000,-180.000000 90.000000))' ELSE 'own' END AS polygon,
    CASE rule WHEN 'tens' THEN 'NETCDF:' || substr(path, 1, length(path) - 3) || ':lon' END AS x_places, CASE rule WHEN 'tens' THEN 'lat' || regexp_extract(path, '/c(\\d+)/', 1) END AS y_places
    FROM f""",
    "footprints",
)
def own_rule_sets(spark, sf_dir):
    """A user's rule sets: whole paths, variable names, fixed boxes, rasters of places."""
    rules = ingest.read_rules(OWN_RULES)
    path, name, rule = F.col("path"), F.element_at(F.split("path", "/"), -1), F.col("rule")
    out = footprints(spark, sf_dir).select("id", "path", "ns", ingest.matched_rule(name, path, rules).alias("rule"))
    variable = ingest.variable_name(ingest.rule_field(name, rule, "namespace", path, rules), F.col("ns"), rule, rules)
    places = (ingest.place_raster(path, rule, a, rules).alias(f"{a}_places") for a in "xy")
    return out.select("id", "rule", variable.alias("variable"), ingest.rule_polygon(rule, F.lit("own"), rules).alias("polygon"), *places)
