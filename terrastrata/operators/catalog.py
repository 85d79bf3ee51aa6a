"""The metadata catalogue: which granules meet a place, a time and a variable, and what a collection holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, paths

SECOND = "interval 1 second"


def in_time(lo: Column, hi: Column, stamps: Column, start: str | None, end: str | None) -> Column:
    """Time filter: an overlap of closed ranges with a second's margin; with a start alone, that very
    stamp; without a start, everything (an end alone doesn't filter)."""
    if start is None:
        return F.lit(True)
    a = F.lit(start).cast("timestamp_ntz")
    if end is None:
        return a.between(lo, hi) & F.array_contains(stamps, a)
    b = F.lit(end).cast("timestamp_ntz")
    return (lo <= b + F.expr(SECOND)) & (hi >= a - F.expr(SECOND))


def named(name: Column, names: list[str] | None) -> Column:
    """Variable filter; no list, no filter."""
    return name.isin(names) if names else F.lit(True)


def intersects(
    footprints: DataFrame,
    ring: list[tuple[float, float]] | None = None,
    start: str | None = None,
    end: str | None = None,
    names: list[str] | None = None,
    limit: int = 0,
) -> DataFrame:
    """Granules that meet a polygon (longitude, latitude), a time and variables.

    The polygon's box is compared first: plain comparisons of the granules' box columns, which reach the
    scan. Then the polygon itself. ``limit <= 0`` is no limit.
    """
    found = footprints.where(in_time(F.col("lo"), F.col("hi"), F.col("stamps"), start, end) & named(F.col("ns"), names))
    if ring:
        xs, ys = [p[0] for p in ring], [p[1] for p in ring]
        box = (F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"))
        found = found.where((box[0] <= max(xs)) & (box[2] >= min(xs)) & (box[1] <= max(ys)) & (box[3] >= min(ys)))
        found = found.where(geo.ring_meets_box(geo.ring_edges(geo.points(ring)), box))
    return found.limit(limit) if limit > 0 else found


def spatial_join(granules: DataFrame, regions: DataFrame, cell: float = 10.0) -> DataFrame:
    """Pairs of granules and regions (both with boxes) that meet, by an equality on grid cells.

    Each box is listed in the cells it touches, so the join is an equality however many regions there are; a pair
    is reported only in the cell of its common part's corner, so it appears once.
    """

    def cells(df: DataFrame) -> DataFrame:
        at = {a: F.floor(F.col(c) / cell).cast("int") for a, c in (("x0", "xmin"), ("x1", "xmax"), ("y0", "ymin"), ("y1", "ymax"))}
        spread = df.withColumns(at).withColumn("cx", F.explode(F.sequence("x0", "x1")))
        return spread.withColumn("cy", F.explode(F.sequence("y0", "y1"))).drop("x0", "x1", "y0", "y1")

    g, r = cells(granules).alias("g"), cells(regions.withColumnsRenamed({c: f"r_{c}" for c in regions.columns}).withColumns(
        {c: F.col(f"r_{c}") for c in ("xmin", "ymin", "xmax", "ymax")})).alias("r")
    both = (F.col("g.cx") == F.col("r.cx")) & (F.col("g.cy") == F.col("r.cy"))
    meet = geo.boxes_meet(*(tuple(F.col(f"{s}.{c}") for c in ("xmin", "ymin", "xmax", "ymax")) for s in "gr"))
    corner_x = F.floor(F.greatest("g.xmin", "r.xmin") / cell) == F.col("g.cx")
    corner_y = F.floor(F.greatest("g.ymin", "r.ymin") / cell) == F.col("g.cy")
    kept = [F.col(f"g.{c}") for c in granules.columns] + [F.col(f"r.r_{c}") for c in regions.columns]
    return g.join(r, both & meet & corner_x & corner_y).select(*kept)


def stamps(footprints: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Distinct stamps, sorted; equal stamp lists are merged before they are unnested."""
    lists = footprints.select("stamps").distinct()
    each = lists.select(F.explode("stamps").alias("ts")).distinct()
    if start:
        each = each.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    upper = F.lit(end).cast("timestamp_ntz") if end else F.current_timestamp().cast("timestamp_ntz")
    return each.where(F.col("ts") <= upper).orderBy("ts")


def extents(footprints: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Envelope in Mercator, first and last stamp, and the variables."""
    west, south = geo.to_mercator(F.col("xmin"), F.greatest(F.col("ymin"), F.lit(-89.0)))
    east, north = geo.to_mercator(F.col("xmax"), F.least(F.col("ymax"), F.lit(89.0)))
    own = footprints.select(*(by or []), "ns", "lo", "hi", west.alias("w"), south.alias("s"), east.alias("e"), north.alias("n"))
    return own.groupBy(*(by or [])).agg(
        F.min("w").alias("xmin"), F.min("s").alias("ymin"), F.max("e").alias("xmax"), F.max("n").alias("ymax"),
        F.min("lo").alias("min_stamp"), F.max("hi").alias("max_stamp"), F.array_sort(F.collect_set("ns")).alias("variables"),
    )


def with_parents(files: DataFrame, path: str = "path") -> DataFrame:
    """Paths with their hash and their ancestors' hashes, root first."""
    return files.withColumns({"pa_hash": paths.path_hash(F.col(path)), "pa_parents": paths.ancestor_hashes(F.col(path))})


def tallies(files: DataFrame, block: int = 4096) -> DataFrame:
    """Each directory's number of descendants and total size, in one pass over all levels.

    A directory counts ``block`` bytes for itself and for each directory below it.
    """
    distinct = files.groupBy("path").agg(F.max("size").alias("size"))
    up = distinct.select("path", "size", F.explode(paths.ancestors(F.col("path"))).alias("dir"))
    of_files = up.groupBy("dir").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
    dirs = of_files.select("dir")
    nested = dirs.select(F.explode(paths.ancestors(F.col("dir"))).alias("dir")).groupBy("dir").agg(F.count(F.lit(1)).alias("dirs"))
    joined = of_files.join(nested, "dir", "left").fillna(0, ["dirs"])
    return joined.select("dir", (F.col("files") + F.col("dirs")).alias("count"), (F.col("bytes") + block * (F.col("dirs") + 1)).alias("size"))


def sub_paths(files: DataFrame, root: str) -> DataFrame:
    """The next path segments below ``root`` with one, the smallest, path each."""
    n = root.strip("/").count("/") + 1 if root.strip("/") else 0
    parts = F.split(F.trim(F.col("path"), F.lit("/")), "/")
    below = files.where(F.col("path").startswith(root.rstrip("/") + "/")).select("path", F.get(parts, F.lit(n)).alias("segment"))
    return below.groupBy("segment").agg(F.min("path").alias("example")).orderBy("segment")


def longest_axis(axes: DataFrame) -> DataFrame:
    """Per variable and axis the longest list of values."""
    return axes.groupBy("ns", "axis").agg(F.max_by("params", F.struct(F.size("params"), "params")).alias("params"))


def layers(names: DataFrame, axes: DataFrame) -> DataFrame:
    """Variables with all their axes in one row; variables without any stay."""
    own = axes.groupBy("ns").agg(F.array_sort(F.collect_list("axis")).alias("axes"))
    return names.join(own, "ns", "left").withColumn("axes", F.coalesce("axes", F.array().cast("array<string>")))


def latest_days(granules: DataFrame, days: int) -> DataFrame:
    """The newest granule of each of the last ``days`` distinct days, oldest first."""
    day = granules.withColumn("day", F.date_trunc("day", "ts").cast("date"))
    newest = day.groupBy("day").agg(F.max_by("id", F.struct("ts", "id")).alias("id"))
    return newest.orderBy(F.desc("day")).limit(days).orderBy("day")


def data_links(granules: DataFrame, root: str, most: int) -> DataFrame:
    """Up to ``most`` distinct files below ``root``, without it, in order."""
    below = granules.where(F.col("path").startswith(root)).select(F.substr(F.col("path"), F.lit(len(root) + 1)).alias("link"))
    return below.distinct().orderBy("link").limit(most)


def co_grouped(granules: DataFrame, data: list[str], masks: list[str], key: list[str]) -> DataFrame:
    """Each data granule with all masks of its key; keys that lack or repeat a variable are left out.

    Which keys are complete is a count per key, so no key's granules are gathered.
    """
    wanted = [*data, *masks]
    mine = granules.where(F.col("ns").isin(wanted))
    complete = mine.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ns").alias("d"))
    complete = complete.where((F.col("n") == len(wanted)) & (F.col("d") == len(wanted))).select(*key)
    good = mine.join(complete, key, "left_semi")
    masking = good.where(F.col("ns").isin(masks)).select(*key, F.col("ns").alias("mask_ns"), F.col("id").alias("mask_id"))
    return good.where(F.col("ns").isin(data)).join(masking, key)


def dedupe(granules: DataFrame, key: list[str], newest: list[str]) -> DataFrame:
    """One row per key: the greatest by ``newest``. A maximum, so it combines before the shuffle."""
    others = [c for c in granules.columns if c not in key]
    best = granules.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(*newest)).alias("__row"))
    return best.select(*(c if c in key else F.col("__row")[c].alias(c) for c in granules.columns))


def hulls(points: DataFrame, by: list[str], part: int = 256) -> DataFrame:
    """The corners (``x``, ``y``) of the convex hull of each group's points.

    Points are dealt into parts of about ``part``; the corners of the parts' hulls are the points of the next
    step, until a group fits one part. A corner of the whole is one of its part, so none is lost, and no task
    gathers more than a part. One number per step comes to the driver.
    """
    left, before = points.where("x IS NOT NULL AND y IS NOT NULL").select(*by, "x", "y").distinct(), None
    while True:
        sizes = left.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
        most = sizes.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
        parts = max(1, -(-most // part)) if before is None or most < before else 1
        dealt = left.groupBy(*by, F.pmod(F.xxhash64("x", "y"), F.lit(parts)).alias("__part"))
        left = dealt.agg(F.collect_list(F.struct("x", "y")).alias("__r")).select(*by, F.inline(geo.hull(F.col("__r"))))
        if parts == 1:
            return left
        before = most


def all_of(parts: list[DataFrame]) -> DataFrame:
    """Shards of one table together, by column name."""
    return reduce(DataFrame.unionByName, parts)


def index_tiles(xmin: float, ymin: float, xmax: float, ymax: float, step: float) -> list[tuple[float, float, float, float]]:
    """A box in tiles of at most ``step``, from its top left corner."""
    nx, ny = max(1, -(-(xmax - xmin) // step)), max(1, -(-(ymax - ymin) // step))
    return [
        (xmin + i * step, max(ymax - (j + 1) * step, ymin), min(xmin + (i + 1) * step, xmax), ymax - j * step)
        for j in range(int(ny)) for i in range(int(nx))
    ]
