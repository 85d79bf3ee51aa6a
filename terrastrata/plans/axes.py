"""Axis, request and expression queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import bands, pixels, table
from ..operators import axes, expressions, raster, requests
from .base import query


def _files(spark, sf_dir):
    """One file per order: its lines' quantities as one axis, a fixed level axis, and its stamps."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_set("l_quantity")).alias("depth"))
    return lines.withColumns({"ns": F.concat(F.lit("v"), F.col("id") % 3), "level": F.array(F.lit(10.0), F.lit(20.0), F.lit(40.0))})


FILES = "files AS (SELECT l_orderkey AS id, 'v' || (l_orderkey % 3) AS ns, list_sort(list(DISTINCT l_quantity)) AS depth, [10.0, 20.0, 40.0] AS level FROM lineitem GROUP BY l_orderkey)"


@query("select_by_index", f"WITH {FILES}, i AS (SELECT id, depth, unnest([0, 1, 3]) AS pos FROM files WHERE len(depth) > 3) SELECT id, CAST(pos AS INT) AS pos, depth[pos + 1] AS value FROM i")
def select_by_index(spark, sf_dir):
    """Positions along an axis by index, step and duplicates."""
    chosen = axes.by_index(F.col("depth"), [(0, 1, 1), (1, 3, 2)])
    out = _files(spark, sf_dir).select("id", "depth", F.explode(chosen).alias("pos"))
    return out.select("id", "pos", F.get("depth", F.col("pos")).alias("value"))


@query("select_by_range", f"WITH {FILES}, i AS (SELECT id, depth, unnest(range(len(depth))) AS pos FROM files) SELECT id, CAST(pos AS INT) AS pos FROM i WHERE depth[pos + 1] >= 10 AND depth[pos + 1] < 20")
def select_by_range(spark, sf_dir):
    """Half-open value range."""
    return _files(spark, sf_dir).select("id", F.explode(axes.by_range(F.col("depth"), 10.0, 20.0)).alias("pos"))


@query("select_by_time", f"WITH {FILES}, i AS (SELECT id, depth, unnest(range(len(depth))) AS pos FROM files) SELECT id, CAST(pos AS INT) AS pos FROM i WHERE depth[pos + 1] BETWEEN 10 AND 20")
def select_by_time(spark, sf_dir):
    """Closed range, as for stamps."""
    return _files(spark, sf_dir).select("id", F.explode(axes.by_time(F.col("depth"), F.lit(10.0), F.lit(20.0))).alias("pos"))


@query(
    "select_nearest",
    f"""WITH {FILES}, i AS (SELECT id, depth, unnest(range(len(depth))) AS pos FROM files WHERE 25.5 BETWEEN depth[1] - 0.000001 AND depth[len(depth)] + 0.000001)
    SELECT id, CAST(arg_min(pos, row(abs(depth[pos + 1] - 25.5), pos)) AS INT) AS pos FROM i GROUP BY id""",
)
def select_nearest(spark, sf_dir):
    """Nearest value, the earlier of two, none out of bounds."""
    return _files(spark, sf_dir).select("id", axes.nearest(F.col("depth"), F.lit(25.5)).alias("pos")).where("pos IS NOT NULL")


@query(
    "nearest_join",
    """WITH s AS (SELECT user_id % 50 AS grp, CAST(event_id AS DOUBLE) AS t, value, event_type = 'click' AS probe FROM events), r AS (SELECT grp, t, value FROM s WHERE NOT probe),
    b AS (SELECT l.grp, l.t, r.t AS b_t, r.value AS b_value FROM (SELECT grp, t FROM s WHERE probe) l ASOF LEFT JOIN r ON l.grp = r.grp AND l.t >= r.t),
    f AS (SELECT b.*, r.t AS f_t, r.value AS f_value FROM b ASOF LEFT JOIN r ON b.grp = r.grp AND b.t <= r.t)
    SELECT grp, t AS "at", CASE WHEN back THEN b_t ELSE f_t END AS at_near, CASE WHEN back THEN b_value ELSE f_value END AS value
    FROM (SELECT *, f_t IS NULL OR (b_t IS NOT NULL AND t - b_t <= f_t - t) AS back FROM f) WHERE coalesce(b_t, f_t) IS NOT NULL""",
)
def nearest_join(spark, sf_dir):
    """As-of join on the nearest key: each click with the nearest other event of its group of users."""
    s = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("grp"), F.col("event_id").cast("double").alias("at"), "value", "event_type")
    return axes.nearest_join(s.where("event_type = 'click'").select("grp", "at"), s.where("event_type <> 'click'"), ["grp"], "at", "value")


@query(
    "axis_strides",
    """SELECT n_nationkey AS id, CAST((2 + n_nationkey % 3) * (1 + n_nationkey % 4) * 5 AS INT) AS bands, CAST((1 + n_nationkey % 4) * 5 AS INT) AS s0, 5 AS s1, 1 AS s2 FROM nation""",
)
def axis_strides(spark, sf_dir):
    """Strides and number of bands from an axis shape."""
    k = F.col("n_nationkey")
    shape = F.array(2 + k % 3, 1 + k % 4, F.lit(5))
    s = axes.strides(shape)
    return table(spark, sf_dir, "nation").select(k.alias("id"), axes.band_count(shape).alias("bands"), *(F.get(s, F.lit(i)).alias(f"s{i}") for i in range(3)))


@query(
    "granules",
    f"""WITH {FILES}, g AS (SELECT *, unnest(range(len(depth))) AS d FROM files), h AS (SELECT *, unnest(range(3)) AS l FROM g)
    SELECT id, CAST(1 + d * 3 + l AS INT) AS band, ns || '#level=' || level[l + 1] AS key, depth[d + 1] AS order_stamp FROM h""",
)
def granules(spark, sf_dir):
    """One row per file and axis combination, band numbers and names."""
    f = _files(spark, sf_dir)
    chosen = {"depth": axes.default_positions(F.col("depth"), 1), "level": axes.default_positions(F.col("level"), 1)}
    out = axes.granules(f, chosen, {"depth": F.col("depth"), "level": F.col("level")}, {"depth": F.lit(3), "level": F.lit(1)}, aggregated=frozenset(["depth"]))
    return out.select("id", "band", "key", "order_stamp")


@query("default_axis", f"WITH {FILES} SELECT id, depth[1] AS value, 1 AS n FROM files")
def default_axis(spark, sf_dir):
    """An axis that isn't asked for gives its first value."""
    out = _files(spark, sf_dir).withColumn("p", axes.default_positions(F.col("depth"), 0))
    return out.select("id", F.get("depth", F.get("p", F.lit(0))).alias("value"), F.size("p").alias("n"))


@query("axis_order", f"WITH {FILES}, i AS (SELECT id, depth, unnest(range(len(depth))) AS pos FROM files) SELECT id, CAST(pos AS INT) AS pos, CAST(len(depth) - 1 - pos AS INT) AS rank FROM i ORDER BY id, rank")
def axis_order(spark, sf_dir):
    """Mirrored order of an axis."""
    out = _files(spark, sf_dir).select("id", "depth", F.explode(axes.default_positions(F.col("depth"), 1)).alias("pos"))
    return out.select("id", "pos", axes.mirrored(F.col("pos"), F.size("depth"), 1).alias("rank")).orderBy("id", "rank")


@query("dimensions", "SELECT 'level' AS axis, '5.0,10.0,20.0,40.0' AS values")
def dimensions(spark, sf_dir):
    """Axes and values read from output names."""
    f = _files(spark, sf_dir).select("ns", F.explode("level").alias("l"))
    names = f.select(F.concat(F.col("ns"), F.lit("#level="), F.col("l").cast("string")).alias("key"))
    extra = spark.createDataFrame([("v#level=5.0,bad",)], "key string")
    return axes.dimensions(names.union(extra)).select("axis", F.array_join(F.col("values").cast("array<string>"), ",").alias("values"))


@query("subset_request", "SELECT t, px, py, value FROM bands WHERE t >= 10 AND t <= 40 AND px IN (1, 3) AND py <= 5", "bands")
def subset_request(spark, sf_dir):
    """A subset request as filters (Q10)."""
    out = bands(spark, sf_dir)
    for name, choice in requests.parse_subset("t(10,40)order=asc,agg=union;px((1,3));py(*,5)").items():
        out = out.where(choice.keep(F.col(name)))
    return out.select("t", "px", "py", "value")


@query("constraint_request", "SELECT t, px, py, value FROM bands WHERE t > 3 AND t <= 9 AND px >= 2 AND py < 4 AND value IS NOT NULL", "bands")
def constraint_request(spark, sf_dir):
    """A constraint expression as filters, strict and not (Q9)."""
    c = requests.parse_constraint("bands{value}|3<t<=9,px>=2,py<4")
    out = bands(spark, sf_dir)
    for name, choice in c.axes.items():
        out = out.where(choice.keep(F.col(name)))
    return out.select("t", "px", "py", *c.variables)


@query(
    "checked_expressions",
    """WITH m AS (SELECT py, px, avg(value) FILTER (band = 'A') AS a, avg(value) FILTER (band = 'N') AS n, avg(value) FILTER (band = 'R') AS r FROM pixels GROUP BY py, px)
    SELECT py, px, round((a - r) / (a + r), 6) AS ndvi, round(CASE WHEN a > r AND n < 26 THEN sqrt(abs(a - n)) ELSE pow(r, 2) * 2 END, 5) AS mixed FROM m""",
    "pixels",
)
def checked_expressions(spark, sf_dir):
    """Band math from request text, checked before it runs."""
    means = pixels(spark, sf_dir).groupBy("py", "px", "band").agg(F.avg("value").alias("value"))
    wide = raster.aligned(means, ["py", "px"], "band", ["A", "N", "R"])
    made = expressions.parse_all(["ndvi = (A - R) / (A + R)", "mixed = A > R && N < 26 ? sqrt(abs(A - N)) : R ** 2 * 2"], ["A", "N", "R"])
    digits = {"ndvi": 6, "mixed": 5}
    return wide.select("py", "px", *(F.round(raster.band_math(wide, list(e.variables), e.column()), digits[e.name]).alias(e.name) for e in made))


@query("query_strings", "SELECT page_id, CASE WHEN url LIKE '%page=%' THEN regexp_extract(url, 'page=([^&#]*)', 1) END AS page, CASE WHEN url LIKE '%ref=%' THEN regexp_extract(url, 'ref=([^&#]*)', 1) END AS ref FROM pages")
def query_strings(spark, sf_dir):
    """Query strings as maps."""
    q = F.regexp_extract("url", r"\?([^#]*)", 1)
    m = table(spark, sf_dir, "pages").select("page_id", requests.query_map(q).alias("m"))
    return m.select("page_id", F.try_element_at("m", F.lit("page")).alias("page"), F.try_element_at("m", F.lit("ref")).alias("ref"))


@query("remote_addresses", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '10.0.0.' || (event_id % 250) ELSE '192.168.1.' || (event_id % 250) END AS address FROM events")
def remote_addresses(spark, sf_dir):
    """First hop or peer, without port."""
    e = F.col("event_id")
    forwarded = F.when(e % 2 == 0, F.concat(F.lit("10.0.0."), e % 250, F.lit(", 172.16.0.1")))
    peer = F.concat(F.lit("192.168.1."), e % 250, F.lit(":8080"))
    return table(spark, sf_dir, "events").select("event_id", requests.remote_address(forwarded, peer).alias("address"))


@query("scale_ranges", "SELECT n_nationkey AS id, -CAST(n_nationkey AS DOUBLE) AS off, CAST(n_nationkey * 2 AS DOUBLE) AS clip FROM nation")
def scale_ranges(spark, sf_dir):
    """Colour ranges as offset and clip."""
    k = F.col("n_nationkey")
    off, clip = requests.scale_range(F.concat(k, F.lit(","), k * 3))
    return table(spark, sf_dir, "nation").select(k.alias("id"), off.alias("off"), clip.alias("clip"))


@query("request_codes", "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 > 0 THEN 4326 + n_nationkey END AS code, CASE WHEN n_nationkey % 2 = 0 THEN 2 END AS names FROM nation")
def request_codes(spark, sf_dir):
    """Reference system codes and optional name lists."""
    k = F.col("n_nationkey")
    text = F.when(k % 3 > 0, F.concat(F.lit("EPSG:"), k + 4326)).otherwise("WGS84")
    names = requests.name_list(F.when(k % 2 == 0, "a,b").otherwise(""))
    return table(spark, sf_dir, "nation").select(k.alias("id"), requests.crs_code(text).alias("code"), F.when(names.isNotNull(), F.size(names)).alias("names"))


@query("zoom_limit", "SELECT vec_id AS id, CASE WHEN vec_id % 9 > 4 THEN 'zoom in' ELSE 'render' END AS action FROM embeddings")
def zoom_limit(spark, sf_dir):
    """Requests coarser than a limit get a placeholder."""
    resolution = (F.col("vec_id") % 9).cast("double")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.when(resolution > 4.0, "zoom in").otherwise("render").alias("action"))
