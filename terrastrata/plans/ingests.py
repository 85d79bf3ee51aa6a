"""Ingest queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as P
from ..model import footprints, iso, metadata, paths, table
from ..operators import ingest
from .base import query


def _lines(spark, sf_dir):
    """Crawler lines of the page paths, every page twice with another type."""
    p = paths(spark, sf_dir).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    kind = F.when(F.col("k") == 0, "gdal").otherwise("posix")
    doc = F.to_json(F.struct(F.col("page_id").alias("inode"), F.col("size")))
    return p.select(F.concat_ws("\t", "path", kind, doc).alias("value"))


@query(
    "crawl_lines",
    """SELECT path AS in_path, k AS in_type, page_id AS inode, size FROM paths, (VALUES ('gdal'), ('posix')) v(k)""",
    "paths",
)
def crawl_lines(spark, sf_dir):
    """Crawler lines read into columns and their document."""
    own = ingest.lines(_lines(spark, sf_dir)).withColumn("d", F.from_json("in_json", "inode long, size long"))
    return own.select("in_path", "in_type", F.col("d.inode").alias("inode"), F.col("d.size").alias("size"))


@query(
    "upsert_paths",
    """WITH s AS (SELECT path, page_id, 'gdal' AS kind FROM paths UNION ALL SELECT path, page_id + 1000, 'posix' FROM paths WHERE page_id % 3 = 0)
    SELECT md5(path) AS pa_hash, max(page_id) AS pa_ingested, arg_max(kind, page_id) AS pa_type, CAST(max(len(string_split(trim(path, '/'), '/'))) - 1 AS INT) AS parents FROM s GROUP BY path""",
    "paths",
)
def upsert_paths(spark, sf_dir):
    """Paths staged in one batch and merged, the last one winning (K1, K3)."""
    p = paths(spark, sf_dir)
    a = p.select(F.col("path").alias("in_path"), F.lit("gdal").alias("in_type"), F.col("page_id").alias("ingested"))
    b = p.where("page_id % 3 = 0").select(F.col("path").alias("in_path"), F.lit("posix").alias("in_type"), (F.col("page_id") + 1000).alias("ingested"))
    merged = ingest.merge(ingest.staged_paths(a), ingest.staged_paths(b), ["pa_hash"], "pa_ingested")
    return merged.select("pa_hash", "pa_ingested", "pa_type", F.size("pa_parents").alias("parents"))


@query(
    "upsert_metadata",
    "SELECT md5(CAST(event_id % 500 AS VARCHAR)) AS md_hash, md_type, arg_max(md_json, row(md_ingested, md_json)) AS md_json, count(*) > 0 AS kept FROM metadata GROUP BY event_id % 500, md_type",
    "metadata",
)
def upsert_metadata(spark, sf_dir):
    """Documents merged on hash and type (K2)."""
    m = metadata(spark, sf_dir).select(F.md5((F.col("event_id") % 500).cast("string")).alias("md_hash"), "md_type", "md_json", "md_ingested")
    old, new = m.where("md_ingested < timestamp_ntz'2024-01-20 00:00:00'"), m.where("md_ingested >= timestamp_ntz'2024-01-20 00:00:00'")
    return ingest.merge(old, new, ["md_hash", "md_type"], "md_ingested").select("md_hash", "md_type", "md_json", F.lit(True).alias("kept"))


def _documents(spark, sf_dir):
    """One document per file with two datasets."""
    f = footprints(spark, sf_dir)
    one = lambda i: F.struct(F.concat(F.col("path"), F.lit(f":{i}")).alias("ds_name"), F.concat(F.lit("band-"), F.lit(i), F.lit(" "), F.col("ns")).alias("namespace"), F.array(F.col("xmin"), F.lit(1.0), F.lit(0.0), F.col("ymax"), F.lit(0.0), F.lit(-1.0)).alias("geo_transform"), F.transform("stamps", iso).alias("timestamps"))
    doc = F.to_json(F.struct(F.col("path").alias("filename"), F.lit("NetCDF").alias("file_type"), F.array(one(1), one(2)).alias("geo_metadata")))
    return f.select("path", doc.alias("json"))


@query(
    "dataset_projection",
    """SELECT path, path || ':' || i AS ds_name, 'band_' || i || '_' || ns AS namespace, CAST(len(stamps) AS INT) AS n, xmin AS x0 FROM footprints, (VALUES (1), (2)) v(i)
    WHERE 'band_' || i || '_' || ns IN ('band_1_2_HIGH', 'band_2_1_URGENT')""",
    "footprints",
)
def dataset_projection(spark, sf_dir):
    """Datasets unnested from file documents, names made safe and filtered twice."""
    out = ingest.datasets(_documents(spark, sf_dir), "json", ["band_1_2_HIGH", "band_2_1_URGENT"])
    return out.select("path", "ds_name", "namespace", F.size("timestamps").alias("n"), F.get("geo_transform", F.lit(0)).alias("x0"))


@query(
    "header_attributes",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, CASE WHEN event_id % 3 = 0 THEN '2024-01-02T03:04:05Z' END AS stamp, CAST(NULL AS INT) AS missing FROM events""",
)
def header_attributes(spark, sf_dir):
    """Header attributes, null where they don't read."""
    doc = F.concat(F.substr("props", F.lit(1), F.length("props") - 1), F.lit(', "t": "'), F.when(F.col("event_id") % 3 == 0, "2024-01-02 03:04:05").otherwise("soon"), F.lit('"}'))
    e = table(spark, sf_dir, "events").select("event_id", doc.alias("j"))
    return e.select("event_id", ingest.attribute(F.col("j"), "k", "double").alias("k"), iso(ingest.attribute(F.col("j"), "t", "timestamp")).alias("stamp"), ingest.attribute(F.col("j"), "x", "int").alias("missing"))


@query(
    "merged_objects",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, 'new' AS t FROM events""",
)
def merged_objects(spark, sf_dir):
    """Objects merged, the right one winning (U-5)."""
    a = F.from_json("props", "map<string,string>")
    b = F.create_map(F.lit("t"), F.lit("new"))
    kept = F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k))
    m = table(spark, sf_dir, "events").select("event_id", F.map_concat(kept, b).alias("m"))
    return m.select("event_id", F.col("m")["k"].cast("long").alias("k"), F.col("m")["t"].alias("t"))


def _names(spark, sf_dir):
    """File names of several collections, made from the orders."""
    o = table(spark, sf_dir, "orders")
    d, k = F.col("o_orderdate"), F.col("o_orderkey")
    name = (
        F.when(k % 5 == 0, F.concat(F.lit("LC8090085"), F.date_format(d, "yyyyDDD"), F.lit("LGN01_B4.tif")))
        .when(k % 5 == 1, F.concat(F.lit("T55HFA_"), F.date_format(d, "yyyyMMdd"), F.lit("T001122_B04.jp2")))
        .when(k % 5 == 2, F.concat(F.lit("MCD43A4.A"), F.date_format(d, "yyyyDDD"), F.lit(".h29v12.006.123.hdf")))
        .when(k % 5 == 3, F.concat(F.lit("chirps-v2.0."), F.year(d), F.lit(".dekads.nc")))
        .otherwise(F.concat(F.lit("file"), k, F.lit(".dat")))
    )
    return o.select(k.alias("id"), name.alias("name"))


@query(
    "file_name_rules",
    """SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'landsat' WHEN 1 THEN 'sentinel2' WHEN 2 THEN 'modis1' WHEN 3 THEN 'chirps2.0' ELSE 'default' END AS rule,
    CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%dT00:00:00Z') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%dT00:11:22Z') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%dT00:00:00Z')
      WHEN 3 THEN strftime(o_orderdate, '%Y-01-01T00:00:00Z') END AS ts FROM orders""",
)
def file_name_rules(spark, sf_dir):
    """File names by the first rule that matches, and their times."""
    out = _names(spark, sf_dir).withColumn("rule", ingest.matched_rule(F.col("name")))
    return out.select("id", "rule", iso(ingest.name_time(F.col("name"), F.col("rule"))).alias("ts"))


@query("band_types", "SELECT b AS band, t AS type FROM (VALUES ('nbar_red', 'Int16'), ('nbart_swir_3', 'Int16'), ('fmask', 'Byte'), ('timedelta', 'Float32'), ('other', 'Byte')) v(b, t)")
def band_types(spark, sf_dir):
    """Pixel types by band name."""
    names = spark.createDataFrame([(n,) for n in ("nbar_red", "nbart_swir_3", "fmask", "timedelta", "other")], "band string")
    return names.select("band", ingest.band_type(F.col("band")).alias("type"))


@query("try_casts", "SELECT page_id, TRY_CAST(regexp_extract(url, '(\\d+)', 1) AS INT) AS num, TRY_CAST(substr(url, 1, 4) AS INT) AS bad FROM pages")
def try_casts(spark, sf_dir):
    """Casts that give null on failure."""
    num = F.nullif(F.regexp_extract("url", r"(\d+)", 1), F.lit("")).try_cast("int")
    return table(spark, sf_dir, "pages").select("page_id", num.alias("num"), F.substring("url", 1, 4).try_cast("int").alias("bad"))


@query("not_null", "SELECT event_id, event_type FROM events WHERE event_type IS NOT NULL")
def not_null(spark, sf_dir):
    """A column that must not be null."""
    checked = F.when(F.col("event_type").isNull(), F.raise_error(F.lit("event_type is null"))).otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", checked.alias("event_type"))


@query("array_functions", "SELECT id, CAST(len(stamps) AS INT) AS n, strftime(stamps[1], '%Y-%m-%d') AS first, strftime(list_min(stamps), '%Y-%m-%d') AS low, strftime(list_max(stamps), '%Y-%m-%d') AS high FROM footprints", "footprints")
def array_functions(spark, sf_dir):
    """Arrays: size, element, minimum and maximum."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return footprints(spark, sf_dir).select("id", F.size("stamps").alias("n"), day(F.get("stamps", F.lit(0))).alias("first"), day(F.array_min("stamps")).alias("low"), day(F.array_max("stamps")).alias("high"))


@query("lookup_first", "SELECT min(n_nationkey) AS id, n_regionkey AS layer FROM nation GROUP BY n_regionkey HAVING n_regionkey = 2")
def lookup_first(spark, sf_dir):
    """The first layer of a name."""
    return table(spark, sf_dir, "nation").where("n_regionkey = 2").groupBy(F.col("n_regionkey").alias("layer")).agg(F.min("n_nationkey").alias("id"))


@query("cache_keys", "SELECT ns, md5('/v/data' || '|1996-01-01|' || ns) AS token, count(*) AS n FROM footprints WHERE lo >= TIMESTAMP '1996-01-01' GROUP BY ns", "footprints")
def cache_keys(spark, sf_dir):
    """Answers with the token of their parameters."""
    out = footprints(spark, sf_dir).where(F.col("lo") >= F.lit("1996-01-01").cast("timestamp_ntz")).groupBy("ns").agg(F.count(F.lit(1)).alias("n"))
    return out.select("ns", P.path_hash(F.concat(F.lit("/v/data|1996-01-01|"), F.col("ns"))).alias("token"), "n")
