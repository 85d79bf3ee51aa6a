"""Date generators, and observed dates on a regular grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import times
from .nearest import nearest

#: Days by which a series that keeps within months steps near their end.
MONTH_END_STEP = 4


def _stamp(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def _bounds(spark: SparkSession, start: str, end: str) -> DataFrame:
    return spark.range(1).select(_stamp(start).alias("a"), _stamp(end).alias("b"))


def _every(a: Column, b: Column, minutes: int) -> Column:
    """Stamps from ``a`` to ``b`` every ``minutes``; none if ``b`` is before ``a``."""
    n = F.timestamp_diff("MINUTE", a, b)
    return F.when(b >= a, F.transform(F.sequence(F.lit(0), F.expr("0") + (n / minutes).cast("int")), lambda k: a + F.make_dt_interval(F.lit(0), F.lit(0), k * minutes)))


def regular(spark: SparkSession, start: str, end: str, minutes: int) -> DataFrame:
    """Every ``minutes``; none for a step of 0 or less."""
    if minutes <= 0:
        return spark.createDataFrame([], "ts timestamp_ntz")
    return _bounds(spark, start, end).select(F.explode(_every(F.col("a"), F.col("b"), minutes)).alias("ts"))


def _years(spark: SparkSession, start: str, end: str) -> DataFrame:
    """The part of the range in each year it touches."""
    years = _bounds(spark, start, end).select("a", "b", F.explode(F.sequence(F.year("a"), F.year("b"))).alias("y"))
    first, last = F.make_timestamp_ntz("y", F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)), F.make_timestamp_ntz("y", F.lit(12), F.lit(31), F.lit(23), F.lit(59), F.lit(59.999999))
    return years.select(F.greatest("a", first).alias("a"), F.least("b", last).alias("b"), "y")


def restarting(spark: SparkSession, start: str, end: str, minutes: int) -> DataFrame:
    """Every ``minutes``, anew from each first of January."""
    if minutes <= 0:
        return spark.createDataFrame([], "ts timestamp_ntz")
    return _years(spark, start, end).select(F.explode(_every(F.col("a"), F.col("b"), minutes)).alias("ts"))


def within_months(spark: SparkSession, start: str, end: str, minutes: int) -> DataFrame:
    """Every ``minutes``, but four days on where that leaves the month; anew from each first of January.

    A recursive rule, unrolled by an aggregate over as many steps as a year can have.
    """
    if minutes <= 0:
        return spark.createDataFrame([], "ts timestamp_ntz")
    steps = 366 * 1440 // min(minutes, MONTH_END_STEP * 1440) + 2
    four = F.expr(f"interval '{MONTH_END_STEP}' day")
    step = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))

    def grow(done: Column, _: Column) -> Column:
        last = F.element_at(done, -1)
        ahead = last + four
        new = F.when(F.month(last) == F.month(ahead), last + step).otherwise(ahead)
        return F.when((new <= F.col("b")) & (F.year(new) == F.year(last)), F.array_append(done, new)).otherwise(done)

    chain = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.array("a"), grow)
    return _years(spark, start, end).where("a <= b").select(F.explode(chain).alias("ts"))


def new_years(spark: SparkSession, start: str, end: str) -> DataFrame:
    """The start, then every first of January up to the end."""
    b = _bounds(spark, start, end)
    first = F.make_timestamp_ntz("y", F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    later = b.select("a", "b", F.explode(F.sequence(F.year("a"), F.year("b"))).alias("y")).select(first.alias("ts"), "a", "b").where("ts > a AND ts <= b")
    return b.where("a <= b").select(F.col("a").alias("ts")).union(later.select("ts"))


def _months(spark: SparkSession, start: str, end: str, each: int) -> DataFrame:
    """The start moved by 0, ``each``, ... months, one after another with overflow of the day."""
    b = _bounds(spark, start, end)
    n = F.months_between("b", "a").cast("int") + 1

    def grow(done: Column, _: Column) -> Column:
        new = times.add_months(F.element_at(done, -1), F.lit(each))
        return F.when(new <= F.col("b"), F.array_append(done, new)).otherwise(done)

    chain = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.array("a"), grow)
    return b.where("a <= b").select(F.explode(chain).alias("ts"))


def monthly(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Midnights, one per month."""
    return _months(spark, start, end, 1).select(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts"))


def yearly(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Midnights, one per year, the end included."""
    return _months(spark, start, end, 12).select(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts"))


def dekads(spark: SparkSession, start: str, end: str) -> DataFrame:
    """The 1st, 11th and 21st of each month."""
    first = F.date_trunc("month", "ts").cast("timestamp_ntz")
    days = F.explode(F.array(F.lit(0), F.lit(10), F.lit(20)))
    return _months(spark, start, end, 1).select(first.alias("m"), days.alias("d")).select((F.col("m") + F.make_dt_interval(F.col("d"))).alias("ts"))


#: Generators by the names that configurations use.
GENERATORS = {
    "aux": lambda s, a, b, m: new_years(s, a, b), "mcd43": restarting, "geoglam": within_months, "chirps20": lambda s, a, b, m: dekads(s, a, b),
    "regular": regular, "monthly": lambda s, a, b, m: monthly(s, a, b), "yearly": lambda s, a, b, m: yearly(s, a, b),
}


def generate(spark: SparkSession, name: str, start: str, end: str, minutes: int = 0) -> DataFrame:
    """Dates by a named generator; none for an unknown name."""
    made = GENERATORS.get(name)
    return made(spark, start, end, minutes) if made else spark.createDataFrame([], "ts timestamp_ntz")


def on_grid(observed: DataFrame, grid: DataFrame, by: list[str]) -> DataFrame:
    """For each grid date the nearest observed one of its group, the earlier of two."""
    known = observed.select(*by, "ts", F.lit(1).alias("one"))
    gap = lambda a, b: F.timestamp_diff("MICROSECOND", a, b)
    out = nearest(grid, known, by, "ts", "one", gap)
    return out.select(*by, "ts", F.col("__at").alias("nearest"))


def accumulated(rows: DataFrame, start: str, minutes: int, by: list[str]) -> DataFrame:
    """Sums over windows of ``minutes`` counted from ``start``."""
    k = F.floor(F.timestamp_diff("SECOND", _stamp(start), F.col("ts")) / (60 * minutes))
    return rows.groupBy(*by, k.alias("window")).agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("n"))


def layer_dates(observed: DataFrame, start: str | None, unit: str = "day") -> DataFrame:
    """A layer's dates from what was observed: from ``start`` (cut to ``unit``) on."""
    cut = observed.select(F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("ts")).distinct()
    return cut.where(F.col("ts") >= F.date_trunc(unit, _stamp(start)).cast("timestamp_ntz")) if start else cut


def current(observed: DataFrame) -> DataFrame:
    """The last date, or now if there is none."""
    return observed.agg(F.coalesce(F.max("ts"), F.current_timestamp().cast("timestamp_ntz")).alias("ts"))


def slices(spark: SparkSession, start: str, end: str, years: int) -> DataFrame:
    """A time range in pieces of ``years``."""
    b = _bounds(spark, start, end)
    made = b.select("b", F.explode(F.sequence("a", "b", F.expr(f"interval {years} year"))).alias("from"))
    return made.where(F.col("from") < F.col("b")).select("from", F.least("b", F.col("from") + F.expr(f"interval {years} year")).alias("to"))
