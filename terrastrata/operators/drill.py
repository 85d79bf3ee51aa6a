"""Drills: what a region's pixels say per band and date."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .nearest import in_cells


def window(pixels: DataFrame, x: tuple[int, int], y: tuple[int, int]) -> DataFrame:
    """Pixels of a rectangle, ends included."""
    return pixels.where(F.col("px").between(*x) & F.col("py").between(*y))


def clipped(pixels: DataFrame, low: float, high: float) -> DataFrame:
    """Valid pixels within the clip bounds, ends included."""
    return pixels.where(F.col("value").isNotNull() & F.col("value").between(low, high))


def zonal_mean(pixels: DataFrame, by: list[str], low: float, high: float) -> DataFrame:
    """Mean and number of the valid pixels within bounds; groups without any have value 0, count 0."""
    inside = F.when(F.col("value").between(low, high), F.col("value"))
    return pixels.groupBy(*by).agg(F.coalesce(F.avg(inside), F.lit(0.0)).alias("value"), F.count(inside).alias("count"))


def pixel_fraction(pixels: DataFrame, by: list[str], low: float, high: float) -> DataFrame:
    """Share of the valid pixels that lie within bounds; the denominator counts before the clip."""
    valid = F.count("value")
    inside = F.count(F.when(F.col("value").between(low, high), 1))
    return pixels.groupBy(*by).agg(F.coalesce(F.try_divide(inside, valid), F.lit(0.0)).alias("value"), valid.alias("count"))


def deciles(pixels: DataFrame, by: list[str], anchors: int = 9) -> DataFrame:
    """``anchors`` order statistics of the valid values, one row each (``decile`` from 1).

    With n values and ``step = n div (anchors + 1)`` the i-th is the value at ``(i + 1) * step`` counted
    from 0, averaged with the next where ``anchors + 1`` divides n; the next is the last at the end.
    Fewer values than anchors + 1 repeat in sorted order.

    Equal values are counted, then counts summed over cells that hold about equally many values. Running
    counts over the cells say which of them hold a wanted rank; values are ranked within these alone. So
    neither a group's values nor its distinct values meet in one task.
    """
    counts = pixels.where(F.col("value").isNotNull()).groupBy(*by, "value").agg(F.count(F.lit(1)).alias("c"))
    span = counts.groupBy(*by).agg(F.sum("c").alias("n"))
    same = lambda a, b: reduce(lambda x, y: x & y, (F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by), F.lit(True))
    placed = in_cells(counts, by, "value", "cell")

    w = W.partitionBy(*by).orderBy("cell").rowsBetween(W.unboundedPreceding, 0)
    running = placed.groupBy(*by, "cell").agg(F.sum("c").alias("m")).withColumn("to", F.sum("m").over(w))
    running = running.select(*by, "cell", (F.col("to") - F.col("m")).alias("from"), "to")

    wanted = span.select(*by, "n", F.explode(F.sequence(F.lit(1), F.lit(anchors))).alias("decile"))
    step = F.expr(f"n div {anchors + 1}")
    first = F.when(step > 0, F.col("decile") * step).otherwise((F.col("decile") - 1) % F.col("n"))
    even = (step > 0) & (F.col("n") % (anchors + 1) == 0)
    second = F.when(even, F.least(first + 1, F.col("n") - 1)).otherwise(first)
    wanted = wanted.select(*by, "n", "decile", F.explode(F.array(first, second)).alias("rank"))
    at = (F.col("r.from") <= F.col("w.rank")) & (F.col("w.rank") < F.col("r.to"))
    cell = wanted.alias("w").join(running.alias("r"), same("w", "r") & at)
    cell = cell.select(*(F.col(f"w.{c}").alias(c) for c in by), "n", "decile", "rank", "cell", "from")

    inner = W.partitionBy(*by, "cell").orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    needed = placed.alias("p").join(cell.select(*by, "cell").distinct().alias("q"), same("p", "q") & (F.col("p.cell") == F.col("q.cell")), "left_semi")
    ranked = needed.withColumn("until", F.sum("c").over(inner)).withColumn("since", F.col("until") - F.col("c"))
    hit = (F.col("k.from") + F.col("v.since") <= F.col("k.rank")) & (F.col("k.rank") < F.col("k.from") + F.col("v.until"))
    both = cell.alias("k").join(ranked.alias("v"), same("k", "v") & (F.col("k.cell") == F.col("v.cell")) & hit)
    return both.groupBy(*(F.col(f"k.{c}").alias(c) for c in by), F.col("k.decile").alias("decile")).agg(F.avg("v.value").alias("value"), F.first("k.n").alias("count"))


def weighted_merge(parts: DataFrame, by: list[str]) -> DataFrame:
    """Means merged by their counts; parts that are not a number or count nothing are left out."""
    good = parts.where(~F.isnan("value") & (F.col("count") > 0))
    return good.groupBy(*by).agg((F.sum(F.col("value") * F.col("count")) / F.sum("count")).alias("value"), F.sum("count").alias("count"))


def band_statistics(pixels: DataFrame, by: list[str]) -> DataFrame:
    """Minimum, maximum, mean, population deviation, valid count and valid share in percent."""
    return pixels.groupBy(*by).agg(
        F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.count("value").alias("valid"), (100 * F.count("value") / F.count(F.lit(1))).alias("valid_percent"),
    )


def from_statistics(files: DataFrame, nodata: float) -> DataFrame:
    """Whole-file answers from stored ``stamps``, ``means`` and ``counts`` where these are complete.

    A mean that is the nodata value gives value 0, count 0.
    """
    complete = (F.size("means") == F.size("stamps")) & (F.size("counts") == F.size("stamps")) & F.forall("counts", lambda c: c >= 0)
    each = files.where(complete).select("id", "ns", F.explode(F.arrays_zip("stamps", "means", "counts")).alias("z"))
    empty = F.col("z.means") == nodata
    return each.select(
        "id", "ns", F.col("z.stamps").alias("ts"), F.when(empty, 0.0).otherwise(F.col("z.means")).alias("value"), F.when(empty, 0).otherwise(F.col("z.counts")).alias("count")
    )


def strided(rows: DataFrame, stride: int, order: str = "band_no", by: list[str] | None = None) -> DataFrame:
    """Read every ``stride``-th band and fill those between by straight lines; counts are rounded means.

    Bands behind the last one read repeat it. Each band finds the two it lies between by their numbers,
    so a long series isn't sorted in one task.
    """
    by = by or []
    read = rows.where(F.col(order) % stride == 0).select(*by, F.col(order).alias("a"), F.col("value").alias("v"), F.col("count").alias("c"))
    low, high = read.withColumnsRenamed({"a": "a0", "v": "v0", "c": "c0"}), read.withColumnsRenamed({"a": "a1", "v": "v1", "c": "c1"})
    placed = rows.select(*by, order, (F.col(order) - F.col(order) % stride).alias("a0"))
    placed = placed.withColumn("a1", F.when(F.col(order) % stride > 0, F.col("a0") + stride))
    near = placed.join(low, [*by, "a0"]).join(high, [*by, "a1"], "left")
    share = F.when(F.col("v1").isNotNull(), (F.col(order) - F.col("a0")) / stride).otherwise(0.0)
    value = F.col("v0") + (F.coalesce("v1", "v0") - F.col("v0")) * share
    count = F.floor((F.col("c0") + F.coalesce("c1", "c0")) / 2 + 0.5)
    return near.select(*by, order, value.alias("value"), count.cast("long").alias("count"))


def csv_lines(values: DataFrame, date: str, name: str, names: list[str], decimals: int = 6) -> DataFrame:
    """One text line per date: the date and a value per name, blank where there is none."""
    wide = values.groupBy(date).pivot(name, names).agg(F.first("value"))
    cells = [F.coalesce(F.format_string(f"%.{decimals}f", F.col(n)), F.lit("")) for n in names]
    return wide.select(date, F.concat_ws(",", F.col(date).cast("string"), *cells).alias("line"))


def on_series(values: DataFrame, date: str, name: str, names: list[str], expression: Column) -> DataFrame:
    """Band math per date; a missing variable leaves the result null."""
    wide = values.groupBy(date).pivot(name, names).agg(F.first("value"))
    return wide.select(date, F.when(F.greatest(*(F.col(n).isNull().cast("int") for n in names)) == 0, expression).alias("value"))
