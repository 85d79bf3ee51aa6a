"""Catalogue queries over the virtual metadata tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import paths as P
from ..model import clean_name, footprints, iso, metadata, paths, table
from ..operators import catalog
from .base import query

RING = [(-60.0, -20.0), (40.0, -30.0), (70.0, 30.0), (-10.0, 50.0)]
S = "strftime({}, '%Y-%m-%dT%H:%M:%SZ')"

#: Even-odd and touching tests of RING against a box, for the SQL: its four edges in order.
_EDGES = list(zip(RING, RING[1:] + RING[:1]))


def _sql_side(e, cx, cy):
    (x1, y1), (x2, y2) = e
    return f"(({x2} - {x1}) * ({cy} - {y1}) - ({y2} - {y1}) * ({cx} - {x1}))"


def _sql_touch(e):
    (x1, y1), (x2, y2) = e
    sides = ", ".join(_sql_side(e, cx, cy) for cx in ("xmin", "xmax") for cy in ("ymin", "ymax"))
    return f"({min(x1, x2)} <= xmax AND {max(x1, x2)} >= xmin AND {min(y1, y2)} <= ymax AND {max(y1, y2)} >= ymin AND least({sides}) <= 0 AND greatest({sides}) >= 0)"


def _sql_inside(x, y):
    terms = [
        f"CASE WHEN ({y1} > {y}) <> ({y2} > {y}) AND {x} < {x1} + ({y} - {y1}) * ({x2} - {x1}) / ({y2} - {y1}) THEN 1 ELSE 0 END"
        for (x1, y1), (x2, y2) in _EDGES
    ]
    return f"(({' + '.join(terms)}) % 2 = 1)"


MEETS = "(" + " OR ".join(_sql_touch(e) for e in _EDGES) + " OR " + _sql_inside("((xmin + xmax) / 2)", "((ymin + ymax) / 2)") + ")"
TIMES = "lo <= TIMESTAMP '1997-03-01' + INTERVAL 1 SECOND AND hi >= TIMESTAMP '1996-01-01' - INTERVAL 1 SECOND"


@query("intersects", f"SELECT id, ns, path FROM footprints WHERE {MEETS} AND {TIMES} AND ns IN ('1_URGENT', '2_HIGH')", "footprints")
def intersects(spark, sf_dir):
    """Granules that meet a polygon, a time range and variables."""
    return catalog.intersects(footprints(spark, sf_dir), RING, "1996-01-01", "1997-03-01", ["1_URGENT", "2_HIGH"]).select("id", "ns", "path")


@query(
    "intersects_instant",
    "SELECT id, ns FROM footprints WHERE TIMESTAMP '1997-01-15' BETWEEN lo AND hi AND list_contains(stamps, TIMESTAMP '1997-01-15')",
    "footprints",
)
def intersects_instant(spark, sf_dir):
    """Granules with one very stamp."""
    return catalog.intersects(footprints(spark, sf_dir), start="1997-01-15").select("id", "ns")


@query("intersects_no_start", "SELECT ns, count(*) AS n FROM footprints GROUP BY ns", "footprints")
def intersects_no_start(spark, sf_dir):
    """Without a start the end filters nothing."""
    return catalog.intersects(footprints(spark, sf_dir), end="1990-01-01").groupBy("ns").agg(F.count(F.lit(1)).alias("n"))


@query("has_files", f"SELECT count(*) > 0 AS found FROM (SELECT 1 FROM footprints WHERE {MEETS} LIMIT 1)", "footprints")
def has_files(spark, sf_dir):
    """Whether any granule meets the request."""
    return catalog.intersects(footprints(spark, sf_dir), RING, limit=1).agg((F.count(F.lit(1)) > 0).alias("found"))


@query(
    "spatial_join",
    """WITH r AS (SELECT n_nationkey AS rid, CAST(n_nationkey * 14 - 180 AS DOUBLE) AS x, CAST(n_nationkey * 6 - 80 AS DOUBLE) AS y FROM nation)
    SELECT id, rid FROM footprints JOIN r ON xmin <= x + 17 AND xmax >= x AND ymin <= y + 13 AND ymax >= y""",
    "footprints",
)
def spatial_join(spark, sf_dir):
    """Granules and regions that meet, by grid cells."""
    x, y = (F.col("n_nationkey") * 14 - 180).cast("double"), (F.col("n_nationkey") * 6 - 80).cast("double")
    regions = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("rid"), x.alias("xmin"), y.alias("ymin"), (x + 17).alias("xmax"), (y + 13).alias("ymax"))
    out = catalog.spatial_join(footprints(spark, sf_dir).select("id", "xmin", "ymin", "xmax", "ymax"), regions)
    return out.select("id", F.col("r_rid").alias("rid"))


@query(
    "union_of_intersects",
    "SELECT DISTINCT id FROM footprints WHERE (xmax >= 100 AND ymin <= 0) OR (xmin <= -100 AND ymax >= 0)",
    "footprints",
)
def union_of_intersects(spark, sf_dir):
    """Distinct union of two regions' granules (U-1)."""
    f = footprints(spark, sf_dir)
    a, b = f.where("xmax >= 100 AND ymin <= 0"), f.where("xmin <= -100 AND ymax >= 0")
    return a.select("id").union(b.select("id")).distinct()


@query("timestamps", f"SELECT DISTINCT {S.format('ts')} AS ts FROM (SELECT unnest(stamps) AS ts FROM footprints) WHERE ts >= '1996-06-01' AND ts <= '1998-06-01' ORDER BY ts", "footprints")
def timestamps(spark, sf_dir):
    """Distinct stamps of a collection in a range."""
    return catalog.stamps(footprints(spark, sf_dir), "1996-06-01", "1998-06-01").select(iso(F.col("ts")).alias("ts"))


@query(
    "timestamps_coarse",
    "SELECT count(*) AS n FROM footprints WHERE stamps >= [TIMESTAMP '1998-01-01']",
    "footprints",
)
def timestamps_coarse(spark, sf_dir):
    """Stamp lists compared in order with one stamp."""
    return footprints(spark, sf_dir).where(F.col("stamps") >= F.array(F.lit("1998-01-01").cast("timestamp_ntz"))).agg(F.count(F.lit(1)).alias("n"))


@query(
    "extents",
    f"""SELECT round(min(6378137.0 * radians(xmin)), 3) AS xmin, round(min(6378137.0 * ln(tan(pi() / 4 + radians(greatest(ymin, -89.0)) / 2))), 3) AS ymin,
    round(max(6378137.0 * radians(xmax)), 3) AS xmax, round(max(6378137.0 * ln(tan(pi() / 4 + radians(least(ymax, 89.0)) / 2))), 3) AS ymax,
    {S.format('min(lo)')} AS min_stamp, {S.format('max(hi)')} AS max_stamp, array_to_string(list_sort(list(DISTINCT ns)), ',') AS variables FROM footprints""",
    "footprints",
)
def extents(spark, sf_dir):
    """Envelope, first and last stamp, variables."""
    out = catalog.extents(footprints(spark, sf_dir))
    return out.select(
        *(F.round(c, 3).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")), iso(F.col("min_stamp")).alias("min_stamp"), iso(F.col("max_stamp")).alias("max_stamp"), F.array_join("variables", ",").alias("variables")
    )


_PARTS = "string_split(trim(path, '/'), '/')"
_ANC = f"list_transform(range(1, len({_PARTS})), lambda k: '/' || array_to_string(list_slice({_PARTS}, 1, k), '/'))"


@query("parent_paths", f"SELECT page_id, unnest({_ANC}) AS parent FROM paths", "paths")
def parent_paths(spark, sf_dir):
    """All strict ancestors of each path."""
    return paths(spark, sf_dir).select("page_id", F.explode(P.ancestors(F.col("path"))).alias("parent"))


@query(
    "path_parts",
    f"SELECT page_id, md5(path) AS hash, CAST(length(path) - length(replace(path, '/', '')) AS INT) AS depth, {_PARTS}[-1] AS name, '/' || trim(path, '/') AS norm FROM paths",
    "paths",
)
def path_parts(spark, sf_dir):
    """Hash, depth, name and normal form."""
    p = F.col("path")
    return paths(spark, sf_dir).select("page_id", P.path_hash(p).alias("hash"), P.depth(p).alias("depth"), P.basename(p).alias("name"), P.normal(p).alias("norm"))


@query("path_ordinals", f"SELECT page_id, CAST(i AS INT) AS pos, {_PARTS}[i + 1] AS part FROM (SELECT *, unnest(range(len({_PARTS}))) AS i FROM paths)", "paths")
def path_ordinals(spark, sf_dir):
    """Numbered path segments."""
    return paths(spark, sf_dir).select("page_id", F.posexplode(F.split(F.trim("path", F.lit("/")), "/")).alias("pos", "part"))


def _files(spark, sf_dir):
    return catalog.with_parents(footprints(spark, sf_dir).select("id", "path"))


@query("descendants", "SELECT id FROM footprints WHERE starts_with(path, '/v/data/F/')", "footprints")
def descendants(spark, sf_dir):
    """Paths below a directory at any depth (F1)."""
    return _files(spark, sf_dir).where(P.under(F.col("pa_parents"), "/v/data/F")).select("id")


@query("children", "SELECT id FROM footprints WHERE regexp_matches(path, '^/v/data/F/c3/[^/]+$')", "footprints")
def children(spark, sf_dir):
    """Paths directly in a directory."""
    return _files(spark, sf_dir).where(P.child_of(F.col("pa_parents"), "/v/data/F/c3")).select("id")


@query("nth_ancestor", "SELECT id FROM footprints WHERE starts_with(path, '/v/data/O/')", "footprints")
def nth_ancestor(spark, sf_dir):
    """Paths whose third ancestor is given."""
    return _files(spark, sf_dir).where(P.nth_ancestor(F.col("pa_parents"), 3, "/v/data/O")).select("id")


@query("unhash", "SELECT md5(path) AS hash, path FROM footprints", "footprints")
def unhash(spark, sf_dir):
    """Hashes looked up again."""
    files = _files(spark, sf_dir)
    wanted = files.select(F.col("pa_hash").alias("hash"))
    return wanted.join(files.select(F.col("pa_hash").alias("hash"), "path"), "hash")


@query("relative_paths", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '/base/' || page_id ELSE path END AS full_path FROM paths", "paths")
def relative_paths(spark, sf_dir):
    """Relative paths made absolute."""
    rel = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("./"), F.col("page_id"))).otherwise(F.col("path"))
    return paths(spark, sf_dir).select("page_id", P.absolute(rel, F.lit("/base")).alias("full_path"))


@query("namespaces", "SELECT DISTINCT ns FROM footprints ORDER BY ns", "footprints")
def namespaces(spark, sf_dir):
    """Variables of a collection."""
    return footprints(spark, sf_dir).select("ns").distinct().orderBy("ns")


@query("clean_names", "SELECT DISTINCT o_orderpriority AS raw, regexp_replace(trim(o_orderpriority), '[^a-zA-Z0-9_]', '_', 'g') AS name FROM orders")
def clean_names(spark, sf_dir):
    """Variable names made safe."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("raw"), clean_name(F.col("o_orderpriority")).alias("name")).distinct()


@query("sub_paths", "SELECT string_split(path, '/')[5] AS segment, min(path) AS example FROM footprints WHERE starts_with(path, '/v/data/F/') GROUP BY 1 ORDER BY 1", "footprints")
def sub_paths(spark, sf_dir):
    """Next segments below a path, one example each."""
    return catalog.sub_paths(footprints(spark, sf_dir), "/v/data/F")


@query(
    "directory_tallies",
    f"""WITH f AS (SELECT path, max(size) AS size FROM paths GROUP BY path),
    u AS (SELECT path, size, unnest({_ANC}) AS dir FROM f),
    d AS (SELECT dir, count(*) AS files, sum(size) AS bytes FROM u GROUP BY dir),
    n AS (SELECT dir, (SELECT count(*) FROM d e WHERE starts_with(e.dir, d.dir || '/')) AS dirs FROM d)
    SELECT d.dir, files + dirs AS count, CAST(bytes + 4096 * (dirs + 1) AS BIGINT) AS size FROM d JOIN n USING (dir)""",
    "paths",
)
def directory_tallies(spark, sf_dir):
    """Counts and sizes of all directories (A10)."""
    return catalog.tallies(paths(spark, sf_dir))


@query(
    "children_counts",
    """WITH f AS (SELECT DISTINCT path FROM footprints), d AS (SELECT DISTINCT regexp_replace(path, '/[^/]+$', '') AS dir FROM f)
    SELECT d.dir, count(f.path) AS n FROM d LEFT JOIN f ON regexp_replace(f.path, '/[^/]+$', '') = d.dir GROUP BY d.dir""",
    "footprints",
)
def children_counts(spark, sf_dir):
    """Directories joined with their children by the last ancestor's hash."""
    files = _files(spark, sf_dir).select("path", F.element_at("pa_parents", -1).alias("up"))
    dirs = files.select(F.regexp_replace("path", "/[^/]+$", "").alias("dir")).distinct().withColumn("up", F.md5("dir"))
    return dirs.join(files, "up", "left").groupBy("dir").agg(F.count("path").alias("n"))


@query(
    "polygons_with_metadata",
    "SELECT f.id, m.md_type, m.md_json FROM footprints f JOIN metadata m ON md5(CAST(f.id AS VARCHAR)) = m.md_hash WHERE m.md_type <> 'view'",
    "footprints metadata",
)
def polygons_with_metadata(spark, sf_dir):
    """Footprints joined with metadata documents on hash, with a type."""
    f = footprints(spark, sf_dir).select("id", F.md5(F.col("id").cast("string")).alias("md_hash"))
    return f.join(metadata(spark, sf_dir).where("md_type <> 'view'"), "md_hash").select("id", "md_type", "md_json")


@query(
    "files_with_posix",
    "SELECT f.id, m.md_json AS posix FROM footprints f LEFT JOIN metadata m ON md5(CAST(f.id AS VARCHAR)) = m.md_hash AND m.md_type = 'click'",
    "footprints metadata",
)
def files_with_posix(spark, sf_dir):
    """All files, with their metadata of one type where they have it."""
    f = footprints(spark, sf_dir).select("id", F.md5(F.col("id").cast("string")).alias("md_hash"))
    own = metadata(spark, sf_dir).where("md_type = 'click'").select("md_hash", F.col("md_json").alias("posix"))
    return f.join(own, "md_hash", "left").select("id", "posix")


@query(
    "reference_systems",
    """SELECT c.c_custkey AS id, n.n_name AS name FROM customer c JOIN (SELECT *, n_nationkey % 5 AS r FROM nation) n
    ON c.c_nationkey = n.n_nationkey AND c.c_custkey % 5 = n.r""",
)
def reference_systems(spark, sf_dir):
    """A join on two columns."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("a"), (F.col("n_nationkey") % 5).alias("b"), F.col("n_name").alias("name"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("a"), (F.col("c_custkey") % 5).cast("int").alias("b"))
    return c.join(n, ["a", "b"]).select("id", "name")


@query("unknown_systems", "SELECT s_suppkey AS id FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900) AND s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)")
def unknown_systems(spark, sf_dir):
    """What two reference tables lack."""
    c = table(spark, sf_dir, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("s_nationkey"))
    n = table(spark, sf_dir, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").alias("s_nationkey"))
    return table(spark, sf_dir, "supplier").join(c, "s_nationkey", "left_anti").join(n, "s_nationkey", "left_anti").select(F.col("s_suppkey").alias("id"))


@query("known_files", "SELECT id FROM footprints WHERE md5(CAST(id AS VARCHAR)) IN (SELECT md_hash FROM metadata WHERE md_type = 'error')", "footprints metadata")
def known_files(spark, sf_dir):
    """Files that have metadata of a type."""
    f = footprints(spark, sf_dir).select("id", F.md5(F.col("id").cast("string")).alias("md_hash"))
    return f.join(metadata(spark, sf_dir).where("md_type = 'error'"), "md_hash", "left_semi").select("id")


@query(
    "mask_groups",
    """WITH g AS (SELECT l_orderkey AS id, l_partkey AS poly, CAST(l_shipdate AS DATE) AS day, l_returnflag AS ns, l_linenumber AS ln FROM lineitem),
    k AS (SELECT poly, id FROM g WHERE ns IN ('A', 'N', 'R') GROUP BY poly, id HAVING count(*) = 3 AND count(DISTINCT ns) = 3),
    h AS (SELECT o_orderkey AS id, o_custkey AS poly, o_orderstatus AS ns, CAST(date_trunc('month', o_orderdate) AS DATE) AS m FROM orders WHERE o_orderstatus IN ('F', 'O')),
    c AS (SELECT poly, m FROM h GROUP BY poly, m HAVING count(*) = 2 AND count(DISTINCT ns) = 2)
    SELECT d.id, k.id AS mask_id FROM h d JOIN c USING (poly, m) JOIN h k ON k.poly = d.poly AND k.m = d.m AND k.ns = 'O' WHERE d.ns = 'F'""",
)
def mask_groups(spark, sf_dir):
    """Data granules with the mask granules of the same place and time."""
    g = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("poly"), F.col("o_orderstatus").alias("ns"), F.trunc("o_orderdate", "month").alias("m"))
    return catalog.co_grouped(g, ["F"], ["O"], ["poly", "m"]).select("id", "mask_id")


@query(
    "longest_axis",
    """WITH a AS (SELECT l_returnflag AS ns, 'line' || l_linenumber AS axis, l_orderkey, list_sort(list(DISTINCT CAST(l_quantity AS INT))) AS p FROM lineitem GROUP BY ALL)
    SELECT ns, axis, array_to_string(arg_max(p, row(len(p), p)), ',') AS params FROM a GROUP BY ns, axis""",
)
def longest_axis(spark, sf_dir):
    """The longest value list per variable and axis."""
    a = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("ns"), F.concat(F.lit("line"), F.col("l_linenumber")).alias("axis"), "l_orderkey").agg(
        F.array_sort(F.collect_set(F.col("l_quantity").cast("int"))).alias("params")
    )
    return catalog.longest_axis(a).select("ns", "axis", F.array_join(F.col("params").cast("array<string>"), ",").alias("params"))


@query(
    "layer_axes",
    """WITH n AS (SELECT r_name AS ns, r_regionkey AS k FROM region), a AS (SELECT n_regionkey AS k, n_name AS axis FROM nation WHERE n_nationkey < 12)
    SELECT ns, coalesce(array_to_string(list_sort(list(axis) FILTER (axis IS NOT NULL)), ','), '') AS axes FROM n LEFT JOIN a USING (k) GROUP BY ns""",
)
def layer_axes(spark, sf_dir):
    """Variables with all their axes, those without too."""
    region = table(spark, sf_dir, "region").select(F.col("r_name").alias("ns"), F.col("r_regionkey").alias("n_regionkey"))
    axes = table(spark, sf_dir, "nation").where("n_nationkey < 12").join(region, "n_regionkey").select("ns", F.col("n_name").alias("axis"))
    return catalog.layers(region.select("ns"), axes).select("ns", F.array_join("axes", ",").alias("axes"))


@query(
    "axes_over_partition",
    "SELECT n_nationkey AS id, CAST(count(*) OVER w AS BIGINT) AS n, first_value(n_name) OVER (PARTITION BY n_regionkey ORDER BY length(n_name) DESC, n_name) AS longest FROM nation WINDOW w AS (PARTITION BY n_regionkey)",
)
def axes_over_partition(spark, sf_dir):
    """Whole-partition and ordered windows."""
    w = W.partitionBy("n_regionkey")
    longest = F.first("n_name").over(w.orderBy(F.desc(F.length("n_name")), "n_name"))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.count(F.lit(1)).over(w).alias("n"), longest.alias("longest"))


@query(
    "latest_days",
    f"""WITH d AS (SELECT CAST(hi AS DATE) AS day, arg_max(id, row(hi, id)) AS id FROM footprints GROUP BY 1)
    SELECT strftime(day, '%Y-%m-%d') AS day, id FROM (SELECT * FROM d ORDER BY day DESC LIMIT 7) ORDER BY day""",
    "footprints",
)
def latest_days(spark, sf_dir):
    """The newest granule of each of the last seven days."""
    out = catalog.latest_days(footprints(spark, sf_dir).select("id", F.col("hi").alias("ts")), 7)
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "id")


@query("data_links", "SELECT DISTINCT substr(path, 11) AS link FROM footprints WHERE starts_with(path, '/v/data/F/') ORDER BY link LIMIT 20", "footprints")
def data_links(spark, sf_dir):
    """The first links below a root, without it."""
    return catalog.data_links(footprints(spark, sf_dir), "/v/data/F/", 20)


@query("drill_dedupe", "SELECT ns, lo_day, max(id) AS id FROM (SELECT ns, strftime(lo, '%Y-%m-%d') AS lo_day, id FROM footprints) GROUP BY ns, lo_day", "footprints")
def drill_dedupe(spark, sf_dir):
    """Granules met by several index tiles, once each (U-4, I4, I5)."""
    f = footprints(spark, sf_dir).withColumn("lo_day", F.date_format("lo", "yyyy-MM-dd"))
    tiles = [f.where((F.col("xmin") <= t[2]) & (F.col("xmax") >= t[0])) for t in catalog.index_tiles(-180, -90, 180, 90, 180)]
    return catalog.dedupe(catalog.all_of(tiles), ["ns", "lo_day"], ["id"]).select("ns", "lo_day", "id")


@query("shard_union", "SELECT o_orderstatus AS shard, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def shard_union(spark, sf_dir):
    """Shards of one table together, summed (U-2, A15, E13)."""
    o = table(spark, sf_dir, "orders")
    shards = [o.where(F.col("o_orderstatus") == s).withColumn("shard", F.lit(s)) for s in ("F", "O", "P")]
    return catalog.all_of(shards).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(
    "footprint_geometry",
    """SELECT id, printf('POLYGON ((%f %f,%f %f,%f %f,%f %f,%f %f))', xmin, ymin, xmax, ymin, xmax, ymax, xmin, ymax, xmin, ymin) AS wkt,
    (xmax - xmin) * (ymax - ymin) AS area, round(greatest((xmax - xmin) / 256, (ymax - ymin) / 256), 9) AS res FROM footprints""",
    "footprints",
)
def footprint_geometry(spark, sf_dir):
    """WKT, area of its ring and resolution."""
    b = [F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")]
    out = footprints(spark, sf_dir).withColumn("wkt", geo.box_wkt(*b))
    ring = geo.ring_edges(geo.wkt_ring(F.col("wkt")))
    return out.select("id", "wkt", geo.ring_area(ring).alias("area"), F.round(geo.resolution(*b, 256, 256), 9).alias("res"))


@query("area_gate", "SELECT id FROM footprints WHERE (xmax - xmin) * (ymax - ymin) > 0 AND (xmax - xmin) * (ymax - ymin) <= 6", "footprints")
def area_gate(spark, sf_dir):
    """Polygons small enough to drill."""
    area = (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))
    return footprints(spark, sf_dir).where((area > 0) & (area <= 6)).select("id")


@query("extent_clip", "SELECT id, greatest(xmin, -50) AS xmin, greatest(ymin, -40) AS ymin, least(xmax, 60) AS xmax, least(ymax, 45) AS ymax FROM footprints WHERE greatest(xmin, -50) < least(xmax, 60) AND greatest(ymin, -40) < least(ymax, 45)", "footprints")
def extent_clip(spark, sf_dir):
    """Boxes clipped to a layer's extent."""
    out = footprints(spark, sf_dir).select(
        "id", F.greatest("xmin", F.lit(-50.0)).alias("xmin"), F.greatest("ymin", F.lit(-40.0)).alias("ymin"), F.least("xmax", F.lit(60.0)).alias("xmax"), F.least("ymax", F.lit(45.0)).alias("ymax")
    )
    return out.where("xmin < xmax AND ymin < ymax")


@query("pixel_windows", """WITH w AS (SELECT id, floor((xmin + 180) / 0.25 + 0.5) AS a, floor((xmax + 180) / 0.25 + 0.5) AS b FROM footprints)
    SELECT id, CAST(least(greatest(least(a, b), 0), 1439) AS INT) AS off, CAST(least(greatest(greatest(a, b) - least(a, b), 1), 1440 - least(greatest(least(a, b), 0), 1439)) AS INT) AS n FROM w""", "footprints")  # fmt: skip
def pixel_windows(spark, sf_dir):
    """World boxes as pixel windows."""
    off, n = geo.pixel_window(F.col("xmin"), F.col("xmax"), F.lit(-180.0), F.lit(0.25), 1440)
    return footprints(spark, sf_dir).select("id", off.alias("off"), n.alias("n"))


@query("polygon_mask", f"""WITH g AS (SELECT CAST(x AS INT) AS px, CAST(y AS INT) AS py, -180.0 + x * 4 AS xmin, 90.0 - (y + 1) * 4 AS ymin, -180.0 + (x + 1) * 4 AS xmax, 90.0 - y * 4 AS ymax
    FROM range(90) a(x), range(45) b(y)) SELECT px, py FROM g WHERE {MEETS}""")  # fmt: skip
def polygon_mask(spark, sf_dir):
    """Cells that a polygon touches (F16)."""
    x, y = F.explode(F.sequence(F.lit(0), F.lit(89))), F.explode(F.sequence(F.lit(0), F.lit(44)))
    grid = spark.range(1).select(x.alias("px")).select("px", y.alias("py"))
    box = (-180.0 + F.col("px") * 4, 90.0 - (F.col("py") + 1) * 4, -180.0 + (F.col("px") + 1) * 4, 90.0 - F.col("py") * 4)
    return grid.where(geo.ring_meets_box(geo.ring_edges(geo.points(RING)), box))


@query("mercator", """SELECT id, round(6378137.0 * radians(xmin), 3) AS x, round(6378137.0 * ln(tan(pi() / 4 + radians(ymin) / 2)), 3) AS y FROM footprints WHERE abs(ymin) < 89""", "footprints")
def mercator(spark, sf_dir):
    """Corners in Mercator."""
    x, y = geo.transform(F.col("xmin"), F.col("ymin"), 4326, 3857)
    return footprints(spark, sf_dir).where("abs(ymin) < 89").select("id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))
