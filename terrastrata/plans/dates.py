"""Date queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import times
from ..model import footprints, iso, series, table
from ..operators import dates
from .base import query

DAY = "strftime({}, '%Y-%m-%d')"
FMT = "strftime({}, '%Y-%m-%dT%H:%M:%SZ')"


def _generated(name, *args):
    return lambda spark, sf_dir: dates.generate(spark, name, *args).select(iso(F.col("ts")).alias("ts"))


query("dates_regular", f"SELECT {FMT.format('ts')} AS ts FROM (SELECT unnest(generate_series(TIMESTAMP '2015-03-01 06:00:00', TIMESTAMP '2016-03-01', INTERVAL 11520 MINUTE)) AS ts)")(
    _generated("regular", "2015-03-01 06:00:00", "2016-03-01", 11520)
)
query(
    "dates_mcd43",
    f"""WITH y AS (SELECT greatest(TIMESTAMP '2013-02-10', make_timestamp(y, 1, 1, 0, 0, 0)) AS a, least(TIMESTAMP '2016-05-01', make_timestamp(y, 12, 31, 23, 59, 59)) AS b FROM range(2013, 2017) t(y))
    SELECT {FMT.format('ts')} AS ts FROM (SELECT unnest(generate_series(a, b, INTERVAL 11520 MINUTE)) AS ts FROM y)""",
)(_generated("mcd43", "2013-02-10", "2016-05-01", 11520))
query(
    "dates_geoglam",
    f"""WITH RECURSIVE g AS (SELECT TIMESTAMP '2014-11-05' AS ts UNION ALL SELECT n FROM (
      SELECT CASE WHEN year(s) <> year(ts) THEN date_trunc('year', s) ELSE s END AS n FROM (
      SELECT ts, CASE WHEN month(ts) = month(ts + INTERVAL 4 DAY) THEN ts + INTERVAL 8 DAY ELSE ts + INTERVAL 4 DAY END AS s FROM g)) WHERE n <= TIMESTAMP '2016-02-20')
    SELECT {FMT.format('ts')} AS ts FROM g""",
)(_generated("geoglam", "2014-11-05", "2016-02-20", 11520))
query("dates_aux", "SELECT ts FROM (VALUES ('2012-05-03T00:00:00Z'), ('2013-01-01T00:00:00Z'), ('2014-01-01T00:00:00Z'), ('2015-01-01T00:00:00Z')) v(ts)")(_generated("aux", "2012-05-03", "2015-06-01"))
query(
    "dates_chirps20",
    f"""WITH m AS (SELECT unnest(generate_series(TIMESTAMP '2014-10-01', TIMESTAMP '2015-03-01', INTERVAL 1 MONTH)) AS m)
    SELECT {FMT.format("m + to_days(d)")} AS ts FROM m, (VALUES (0), (10), (20)) v(d)""",
)(_generated("chirps20", "2014-10-05", "2015-03-12"))
query("dates_monthly", f"SELECT {FMT.format('ts')} AS ts FROM (SELECT unnest(generate_series(TIMESTAMP '2014-01-15', TIMESTAMP '2015-04-20', INTERVAL 1 MONTH)) AS ts)")(_generated("monthly", "2014-01-15", "2015-04-20"))
query("dates_monthly_overflow", "SELECT ts FROM (VALUES ('2015-01-31T00:00:00Z'), ('2015-03-03T00:00:00Z'), ('2015-04-03T00:00:00Z'), ('2015-05-03T00:00:00Z')) v(ts)")(_generated("monthly", "2015-01-31", "2015-05-20"))
query("dates_yearly", "SELECT ts FROM (VALUES ('2015-01-01T00:00:00Z'), ('2016-01-01T00:00:00Z'), ('2017-01-01T00:00:00Z'), ('2018-01-01T00:00:00Z')) v(ts)")(_generated("yearly", "2015-01-01", "2018-01-01"))
query("dates_unknown", "SELECT 'x' AS ts WHERE false")(_generated("nothing", "2015-01-01", "2018-01-01"))


@query(
    "nearest_on_grid",
    f"""WITH g AS (SELECT ns, unnest(generate_series(TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-29', INTERVAL 6 HOUR)) AS ts FROM (SELECT DISTINCT ns FROM series)),
    n AS (SELECT g.ns, g.ts, arg_min(s.ts, row(abs(date_diff('microsecond', s.ts, g.ts)), s.ts)) AS nearest FROM g JOIN series s ON s.ns = g.ns
      AND s.ts BETWEEN g.ts - INTERVAL 1 DAY AND g.ts + INTERVAL 1 DAY GROUP BY ALL)
    SELECT ns, {FMT.format('ts')} AS ts, strftime(nearest, '%Y-%m-%dT%H:%M:%S.%f') AS nearest FROM n""",
    "series",
)
def nearest_on_grid(spark, sf_dir):
    """Observed stamps on a regular grid."""
    own = series(spark, sf_dir).select("ns", "ts")
    grid = own.select("ns").distinct().crossJoin(F.broadcast(dates.regular(spark, "2024-01-02", "2024-01-29", 360)))  # 109 dates
    out = dates.on_grid(own, grid, ["ns"])
    return out.select("ns", iso(F.col("ts")).alias("ts"), F.date_format("nearest", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("nearest"))


@query(
    "accumulation_windows",
    """SELECT ns, CAST(floor(date_diff('second', TIMESTAMP '2024-01-01 03:00:00', ts) / 21600) AS BIGINT) AS win, round(sum(value), 4) AS value, count(*) AS n FROM
    (SELECT *, ts AS t FROM series WHERE ts >= TIMESTAMP '2024-01-01 03:00:00') GROUP BY 1, 2""",
    "series",
)
def accumulation_windows(spark, sf_dir):
    """Sums over six-hour windows from a requested start (T4)."""
    own = series(spark, sf_dir).where(F.col("ts") >= F.lit("2024-01-01 03:00:00").cast("timestamp_ntz"))
    out = dates.accumulated(own, "2024-01-01 03:00:00", 360, ["ns"])
    return out.select("ns", F.col("window").alias("win"), F.round("value", 4).alias("value"), "n")


@query("layer_dates", f"SELECT DISTINCT {FMT.format('date_trunc(' + chr(39) + 'day' + chr(39) + ', lo)')} AS ts FROM footprints WHERE lo >= TIMESTAMP '1998-07-04'", "footprints")
def layer_dates(spark, sf_dir):
    """A layer's dates from what was observed."""
    return dates.layer_dates(footprints(spark, sf_dir).select(F.col("lo").alias("ts")), "1998-07-04 13:00:00").select(iso(F.col("ts")).alias("ts"))


@query("current_stamp", f"SELECT {FMT.format('max(ts)')} AS ts FROM series", "series")
def current_stamp(spark, sf_dir):
    """The last stamp."""
    return dates.current(series(spark, sf_dir)).select(iso(F.col("ts")).alias("ts"))


@query("time_slices", "SELECT f AS \"from\", t AS \"to\" FROM (VALUES ('2010-03-01T00:00:00Z', '2012-03-01T00:00:00Z'), ('2012-03-01T00:00:00Z', '2014-03-01T00:00:00Z'), ('2014-03-01T00:00:00Z', '2015-01-01T00:00:00Z')) v(f, t)")
def time_slices(spark, sf_dir):
    """A range in two-year pieces (T5)."""
    return dates.slices(spark, "2010-03-01", "2015-01-01", 2).select(iso(F.col("from")).alias("from"), iso(F.col("to")).alias("to"))


@query("fusion_dates", f"SELECT DISTINCT {DAY.format('d')} AS day FROM (SELECT o_orderdate AS d FROM orders UNION SELECT l_shipdate FROM lineitem) ORDER BY day")
def fusion_dates(spark, sf_dir):
    """Distinct dates of two layers together (U-3)."""
    a = table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("d"))
    b = table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").alias("d"))
    return a.union(b).select(F.date_format("d", "yyyy-MM-dd").alias("day")).distinct().orderBy("day")


@query(
    "effective_layers",
    "SELECT id FROM footprints WHERE NOT ((TIMESTAMP '1996-01-01' < lo OR TIMESTAMP '1996-01-01' > hi) AND (TIMESTAMP '1996-03-01' < lo OR TIMESTAMP '1996-03-01' > hi))",
    "footprints",
)
def effective_layers(spark, sf_dir):
    """Input layers whose dates hold an end of the request."""
    a, b = (F.lit(x).cast("timestamp_ntz") for x in ("1996-01-01", "1996-03-01"))
    return footprints(spark, sf_dir).where(a.between(F.col("lo"), F.col("hi")) | b.between(F.col("lo"), F.col("hi"))).select("id")


@query(
    "cf_times",
    f"""SELECT event_id, {FMT.format('''CASE event_id % 5 WHEN 0 THEN TIMESTAMP '1970-01-01' + to_seconds(CAST(event_id AS BIGINT) * 60)
      WHEN 1 THEN TIMESTAMP '1970-01-01' + to_hours(CAST(event_id AS BIGINT)) WHEN 2 THEN TIMESTAMP '1970-01-01' + to_seconds(CAST((event_id + 0.5) * 86400 AS BIGINT))
      WHEN 3 THEN TIMESTAMP '1970-01-01' + to_months(CAST(event_id AS INT) % 900) ELSE TIMESTAMP '1970-01-01' + to_years(CAST(event_id AS INT) % 90) END''')} AS ts FROM events""",
)
def cf_times(spark, sf_dir):
    """Values in `<unit> since <date>` as times."""
    e = F.col("event_id")
    unit = F.element_at(F.array(*map(F.lit, ("seconds", "hours", "days", "months", "years"))), (e % 5 + 1).cast("int"))
    value = F.when(e % 5 == 0, e * 60).when(e % 5 == 1, e).when(e % 5 == 2, e + 0.5).when(e % 5 == 3, e % 900).otherwise(e % 90).cast("double")
    return table(spark, sf_dir, "events").select("event_id", iso(times.decode_cf(value, F.concat(unit, F.lit(" since 1970-01-01 00:00:00.0")))).alias("ts"))


@query(
    "month_series",
    f"""SELECT n_nationkey AS id, {DAY.format('unnest(generate_series(DATE ' + chr(39) + '2020-01-01' + chr(39) + ' + to_months(n_nationkey), DATE ' + chr(39) + '2022-03-01' + chr(39) + ', INTERVAL 1 MONTH))')} AS month FROM nation""",
)
def month_series(spark, sf_dir):
    """First days of months up to one."""
    start = F.add_months(F.lit("2020-01-17").cast("date"), F.col("n_nationkey"))
    months = times.month_series(start, F.lit("2022-03-20").cast("date"))
    each = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.explode(months).alias("m"))
    return each.select("id", F.date_format("m", "yyyy-MM-dd").alias("month"))


@query(
    "months_apart",
    """SELECT o_orderkey AS id, CAST(CASE WHEN day(o_orderdate) = 1 THEN m WHEN m > 0 THEN m - 1 ELSE m END AS INT) AS months FROM (SELECT *,
      (year(DATE '1997-06-01') - year(o_orderdate)) * 12 + 6 - month(o_orderdate) AS m FROM orders)""",
)
def months_apart(spark, sf_dir):
    """Whole months from a date to another's month."""
    d = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), times.months_apart(d, F.lit("1997-06-20").cast("date")).alias("months"))


@query("current_periods", "SELECT count(*) AS n, count(*) FILTER (year(ts) = year(current_date)) AS this_year FROM series", "series")
def current_periods(spark, sf_dir):
    """Stamps of this year (X11)."""
    now = F.date_trunc("year", F.col("ts")).cast("date") == F.trunc(F.current_date(), "year")
    return series(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(now, 1)).alias("this_year"))


@query("epoch_stamps", f"SELECT event_id, {FMT.format('to_timestamp(event_id * 3600)::TIMESTAMP')} AS ts, CAST(floor(epoch(ts)) AS BIGINT) AS secs FROM series", "series")
def epoch_stamps(spark, sf_dir):
    """Seconds to stamps and back."""
    return series(spark, sf_dir).select("event_id", iso(F.timestamp_seconds(F.col("event_id") * 3600)).alias("ts"), times.epoch(F.date_trunc("second", "ts").cast("timestamp_ntz")).alias("secs"))
