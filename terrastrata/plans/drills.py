"""Drill queries over the virtual pixel tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import bands, iso, pixels, series, table
from ..operators import drill
from .base import query

MONTH = "strftime(date_trunc('month', ts), '%Y-%m-%d')"


def _monthly(spark, sf_dir):
    inside = drill.window(pixels(spark, sf_dir), (2, 11), (3, 12))
    return inside.withColumn("month", F.date_format(F.trunc("ts", "month"), "yyyy-MM-dd"))


@query(
    "drill_zonal_mean",
    f"""SELECT band, month, round(coalesce(avg(value) FILTER (value BETWEEN 5 AND 45), 0), 6) AS value,
    count(value) FILTER (value BETWEEN 5 AND 45) AS count
    FROM (SELECT *, {MONTH} AS month FROM pixels WHERE px BETWEEN 2 AND 11 AND py BETWEEN 3 AND 12) GROUP BY band, month ORDER BY band, month""",
    "pixels",
)
def zonal_mean(spark, sf_dir):
    """Polygon drill: per band and month the mean of valid, clipped pixels."""
    out = drill.zonal_mean(_monthly(spark, sf_dir), ["band", "month"], 5, 45)
    return out.withColumn("value", F.round("value", 6)).orderBy("band", "month")


@query(
    "drill_pixel_fraction",
    f"""SELECT band, month, round(coalesce(count(CASE WHEN value BETWEEN 5 AND 25 THEN 1 END) / nullif(count(value), 0), 0), 6) AS value,
    count(value) AS count FROM (SELECT *, {MONTH} AS month FROM pixels WHERE px BETWEEN 2 AND 11 AND py BETWEEN 3 AND 12) GROUP BY band, month""",
    "pixels",
)
def pixel_fraction(spark, sf_dir):
    """Share of valid pixels within the clip bounds (A2)."""
    return drill.pixel_fraction(_monthly(spark, sf_dir), ["band", "month"], 5, 25).withColumn("value", F.round("value", 6))


@query(
    "drill_deciles",
    """WITH s AS (SELECT band, list_sort(list(value) FILTER (value IS NOT NULL)) AS v FROM pixels GROUP BY band HAVING count(value) > 0),
    i AS (SELECT band, v, len(v) AS n, len(v) // 10 AS step, unnest(range(1, 10)) AS decile FROM s)
    SELECT band, CAST(decile AS INT) AS decile, n AS count, CASE WHEN step = 0 THEN v[(decile - 1) % n + 1]
      WHEN n % 10 = 0 THEN (v[decile * step + 1] + v[least(decile * step + 2, n)]) / 2 ELSE v[decile * step + 1] END AS value FROM i""",
    "pixels",
)
def deciles(spark, sf_dir):
    """Nine order statistics per band by counting equal values (A3)."""
    return drill.deciles(pixels(spark, sf_dir), ["band"])


@query(
    "drill_deciles_by_date",
    """WITH s AS (SELECT band, strftime(ts, '%Y-%m-%d') AS date, list_sort(list(value) FILTER (value IS NOT NULL)) AS v FROM pixels GROUP BY ALL HAVING count(value) > 0),
    i AS (SELECT band, date, v, len(v) AS n, len(v) // 10 AS step, unnest(range(1, 10)) AS decile FROM s)
    SELECT band, date, CAST(decile AS INT) AS decile, n AS count, CASE WHEN step = 0 THEN v[(decile - 1) % n + 1]
      WHEN n % 10 = 0 THEN (v[decile * step + 1] + v[least(decile * step + 2, n)]) / 2 ELSE v[decile * step + 1] END AS value FROM i""",
    "pixels",
)
def deciles_by_date(spark, sf_dir):
    """The same per band and date: small groups repeat their values (A3)."""
    return drill.deciles(pixels(spark, sf_dir).withColumn("date", F.date_format("ts", "yyyy-MM-dd")), ["band", "date"])


@query(
    "drill_weighted_merge",
    """WITH parts AS (SELECT band, px, date_trunc('month', ts) AS m, avg(value) AS value, count(value) AS count FROM pixels GROUP BY ALL)
    SELECT band, strftime(m, '%Y-%m-%d') AS month, round(sum(value * count) / sum(count), 6) AS value, CAST(sum(count) AS BIGINT) AS count
    FROM parts WHERE count > 0 GROUP BY band, m""",
    "pixels",
)
def weighted_merge(spark, sf_dir):
    """Partial means of pixel columns merged by their counts (A4)."""
    monthly = pixels(spark, sf_dir).withColumn("month", F.date_format(F.trunc("ts", "month"), "yyyy-MM-dd"))
    parts = monthly.groupBy("band", "px", "month").agg(F.avg("value").alias("value"), F.count("value").alias("count"))
    return drill.weighted_merge(parts, ["band", "month"]).withColumn("value", F.round("value", 6))


@query(
    "drill_from_statistics",
    """SELECT l_orderkey AS id, l_returnflag AS ns, strftime(l_shipdate, '%Y-%m-%d') AS date,
      CASE WHEN avg(l_quantity) = 25 THEN 0.0 ELSE round(avg(l_quantity), 6) END AS value, CASE WHEN avg(l_quantity) = 25 THEN 0 ELSE count(*) END AS count
    FROM lineitem GROUP BY l_orderkey, l_returnflag, l_shipdate""",
)
def from_statistics(spark, sf_dir):
    """Means answered from stored statistics instead of pixels (A5)."""
    each = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("ns"), F.col("l_shipdate").alias("ts")).agg(
        F.avg("l_quantity").alias("m"), F.count(F.lit(1)).alias("c")
    )
    files = each.groupBy("id", "ns").agg(F.sort_array(F.collect_list(F.struct("ts", "m", "c"))).alias("z"))
    files = files.select("id", "ns", F.col("z.ts").alias("stamps"), F.col("z.m").alias("means"), F.col("z.c").alias("counts"))
    out = drill.from_statistics(files, nodata=25.0)
    return out.select("id", "ns", F.date_format("ts", "yyyy-MM-dd").alias("date"), F.round("value", 6).alias("value"), "count")


@query(
    "drill_strided",
    """WITH b AS (SELECT t AS band_no, avg(value) AS value, count(*) + t % 3 AS count FROM bands GROUP BY t),
    a AS (SELECT b.band_no, l.value AS v0, l.count AS c0, l.band_no AS a0, coalesce(h.value, l.value) AS v1, coalesce(h.count, l.count) AS c1,
      coalesce(h.band_no, l.band_no) AS a1 FROM b JOIN b l ON l.band_no = b.band_no - b.band_no % 4
      LEFT JOIN b h ON h.band_no = l.band_no + 4 AND b.band_no % 4 > 0)
    SELECT band_no, round(v0 + (v1 - v0) * CASE WHEN a1 > a0 THEN (band_no - a0) / (a1 - a0) ELSE 0 END, 6) AS value,
      CAST(floor((c0 + c1) / 2 + 0.5) AS BIGINT) AS count FROM a""",
    "bands",
)
def strided(spark, sf_dir):
    """Every fourth band read, those between interpolated."""
    rows = bands(spark, sf_dir).groupBy(F.col("t").alias("band_no")).agg(F.avg("value").alias("value"), (F.count(F.lit(1)) + F.first("t") % 3).alias("count"))
    return drill.strided(rows, 4).withColumn("value", F.round("value", 6))


@query(
    "band_statistics",
    """SELECT ns, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(value) AS valid,
    round(100.0 * count(value) / count(*), 6) AS valid_percent FROM (SELECT band AS ns, value FROM pixels) GROUP BY ns""",
    "pixels",
)
def band_statistics(spark, sf_dir):
    """Raster statistics per band."""
    out = drill.band_statistics(pixels(spark, sf_dir).withColumnRenamed("band", "ns"), ["ns"])
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std", "valid_percent")})


@query(
    "drill_csv",
    f"""WITH m AS (SELECT band, {MONTH} AS month, round(avg(value), 4) AS value FROM pixels GROUP BY ALL)
    SELECT month, month || ',' || coalesce(printf('%.4f', max(value) FILTER (band = 'A')), '') || ',' || coalesce(printf('%.4f', max(value) FILTER (band = 'N')), '')
      || ',' || coalesce(printf('%.4f', max(value) FILTER (band = 'R')), '') AS line FROM m GROUP BY month""",
    "pixels",
)
def csv(spark, sf_dir):
    """Time series as text lines, blank for missing values (K9)."""
    monthly = pixels(spark, sf_dir).withColumn("month", F.date_format(F.trunc("ts", "month"), "yyyy-MM-dd"))
    means = monthly.groupBy("month", "band").agg(F.round(F.avg("value"), 4).alias("value"))
    return drill.csv_lines(means, "month", "band", ["A", "N", "R"], 4)


@query(
    "drill_band_math",
    f"""WITH m AS (SELECT {MONTH} AS month, avg(value) FILTER (band = 'A') AS a, avg(value) FILTER (band = 'R') AS r FROM pixels GROUP BY ALL)
    SELECT month, round((a - r) / (a + r), 6) AS value FROM m""",
    "pixels",
)
def band_math(spark, sf_dir):
    """An expression of two bands per date; missing variables leave it blank (P5)."""
    monthly = pixels(spark, sf_dir).withColumn("month", F.date_format(F.trunc("ts", "month"), "yyyy-MM-dd"))
    means = monthly.groupBy("month", "band").agg(F.avg("value").alias("value"))
    out = drill.on_series(means, "month", "band", ["A", "R"], (F.col("A") - F.col("R")) / (F.col("A") + F.col("R")))
    return out.withColumn("value", F.round("value", 6))


@query(
    "metrics_rollup",
    """SELECT ns, count(*) AS granules, count(DISTINCT strftime(ts, '%Y-%m-%d')) AS files, round(sum(value), 4) AS bytes FROM series GROUP BY ns""",
    "series",
)
def metrics_rollup(spark, sf_dir):
    """Sums and counts of a request's work."""
    return series(spark, sf_dir).groupBy("ns").agg(
        F.count(F.lit(1)).alias("granules"), F.count_distinct(F.date_format("ts", "yyyy-MM-dd")).alias("files"), F.round(F.sum("value"), 4).alias("bytes")
    )


@query(
    "stamps_of_variable",
    """SELECT strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts, count(*) AS n FROM series WHERE ns = 'click' GROUP BY 1""",
    "series",
)
def events_by_second(spark, sf_dir):
    """Stamps of one variable with their counts."""
    return series(spark, sf_dir).where("ns = 'click'").groupBy(iso(F.col("ts")).alias("ts")).agg(F.count(F.lit(1)).alias("n"))
