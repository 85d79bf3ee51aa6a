"""Axes of n-dimensional files: selecting along them, and the granules their combinations make."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .nearest import nearest as nearest_on_line


def by_index(params: Column, indices: list[tuple[int, int, int]]) -> Column:
    """Positions (from 0, sorted, once each) chosen by ``(start, end, step)`` with the end included.

    None, or all of them, if ``indices`` is empty; null (drop the file) where one lies outside.
    """
    n = F.size(params)
    if any(a > b or s < 1 for a, b, s in indices):
        raise ValueError("a selection's start is beyond its end, or its step is below 1")
    if not indices:
        return F.when(n > 0, F.sequence(F.lit(0), n - 1))
    wanted = sorted({i for a, b, s in indices for i in range(a, b + 1, s)})
    return F.when(n > max(wanted), F.array(*map(F.lit, wanted)))


def by_range(params: Column, low: float, high: float) -> Column:
    """Positions whose value v has ``low <= v < high``."""
    every = F.sequence(F.lit(0), F.size(params) - 1)
    hit = F.filter(every, lambda i: (F.get(params, i) >= low) & (F.get(params, i) < high))
    return F.when(F.size(params) > 0, hit).otherwise(F.array().cast("array<int>"))


def by_time(params: Column, low: Column, high: Column | None = None) -> Column:
    """Positions whose time lies from ``low`` to ``high``, both included; without ``high``: equals ``low``."""
    high = low if high is None else high
    every = F.sequence(F.lit(0), F.size(params) - 1)
    hit = F.filter(every, lambda i: F.get(params, i).between(low, high))
    return F.when(F.size(params) > 0, hit).otherwise(F.array().cast("array<int>"))


def nearest(params: Column, wanted: Column, tolerance: float = 1e-6) -> Column:
    """Position of the value nearest to ``wanted``, the earlier of two; null beyond the values' bounds."""
    every = F.transform(params, lambda v, i: F.struct(F.abs(v - wanted).alias("d"), i.alias("i")))
    inside = (wanted >= F.array_min(params) - tolerance) & (wanted <= F.array_max(params) + tolerance)
    return F.when(inside, F.array_min(every)["i"])


def nearest_join(left: DataFrame, right: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """Each row of ``left`` with the nearest row of ``right`` (``at``, ``value``) in its group; the earlier of two."""
    out = nearest_on_line(left, right, by, at, value, lambda a, b: b - a)
    return out.where("__at IS NOT NULL").select(*by, at, F.col("__at").alias(f"{at}_near"), F.col("__value").alias(value))


def strides(shape: Column) -> Column:
    """The last axis has stride 1, the others the product of the shapes behind them."""
    n = F.size(shape)
    return F.transform(
        F.sequence(F.lit(1), n), lambda i: F.aggregate(F.slice(shape, i + 1, n), F.lit(1), lambda a, x: a * x)
    )


def band_count(shape: Column) -> Column:
    return F.aggregate(shape, F.lit(1), lambda a, x: a * x)


def band_number(positions: list[Column], stride: list[Column]) -> Column:
    """Band of a combination of positions, from 1."""
    return reduce(lambda a, b: a + b, (p * s for p, s in zip(positions, stride)), F.lit(1))


def default_positions(params: Column, mapping: int) -> Column:
    """What an axis that isn't asked for contributes: its first value under mapping 0, else all."""
    every = F.sequence(F.lit(0), F.size(params) - 1)
    return F.slice(every, 1, 1) if mapping == 0 else every


def granules(files: DataFrame, chosen: dict[str, Column], params: dict[str, Column], stride: dict[str, Column], name: str = "ns", aggregated: frozenset[str] = frozenset()) -> DataFrame:
    """One row per combination of the chosen positions: ``band`` from 1, ``key`` and ``order_stamp``.

    Axes that aren't aggregated name their value in ``key`` (``ns#a=1.0,b=2.0``); aggregated ones add
    theirs to ``order_stamp``. Files with a null choice make no granules.
    """
    out = files
    for a, c in chosen.items():
        out = out.withColumn(f"i_{a}", F.explode(c))
    value = {a: F.get(params[a], F.col(f"i_{a}")) for a in chosen}
    shown = [F.concat(F.lit(f"{a}="), value[a].cast("string")) for a in chosen if a not in aggregated]
    key = F.concat(F.col(name), F.lit("#"), F.concat_ws(",", *shown)) if shown else F.col(name)
    stamp = reduce(lambda a, b: a + b, (value[a] for a in chosen if a in aggregated), F.lit(0.0))
    return out.withColumns({"band": band_number([F.col(f"i_{a}") for a in chosen], [stride[a] for a in chosen]), "key": key, "order_stamp": stamp})


def mirrored(position: Column, count: Column, order: int) -> Column:
    """The position that orders an axis: from the end where ``order`` isn't 0."""
    return count - 1 - position if order else position


def dimensions(names: DataFrame, column: str = "key") -> DataFrame:
    """Axes and values in names like ``var#a=1,b=2``: one row per axis with its distinct values in order."""
    tail = F.regexp_extract(F.col(column), r"^[^#]*#(.*)$", 1)
    pairs = names.select(F.explode(F.split(tail, ",")).alias("p")).where(F.col("p").contains("="))
    each = pairs.select(F.substring_index("p", "=", 1).alias("axis"), F.substring_index("p", "=", -1).try_cast("double").alias("v"))
    return each.where(F.col("v").isNotNull()).groupBy("axis").agg(F.array_sort(F.collect_set("v")).alias("values"))
