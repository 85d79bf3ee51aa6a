"""Golden values, parsers and properties of the operators."""

import random

import pytest
from pyspark.sql import functions as F

from terrastrata.functions import geo, paths, times
from terrastrata.operators import axes, catalog, dates, drill, expressions, ingest, raster, requests


def values(spark, data, kind, *columns):
    return [tuple(r) for r in spark.createDataFrame(data, kind).select(*columns).collect()]


@pytest.mark.parametrize(
    ("offset", "factor", "clip", "given", "wanted"),
    [(1, 1, 1000, [1, 2], [2, 3]), (0, 0, 2, [1, 2], [127, 254]), (3, 2, 1000, [1, 2], [8, 10]), (3, 2, 2, [1, 2], [4, 4]), (3, 2, 2, [-100, -200], [0, 0]), (0, 1, 5, [None], [255])],
)
def test_scaling(spark, offset, factor, clip, given, wanted):
    got = values(spark, [(None if v is None else float(v),) for v in given], "v double", raster.scale(F.col("v"), offset, factor, clip))
    assert [g for (g,) in got] == wanted


def test_mosaic_in_any_order(spark):
    rows = [("A", 1, 0, 5.0), ("A", 1, 1, None), ("B", 3, 0, None), ("B", 3, 1, 7.0), ("C", 2, 0, 6.0), ("C", 2, 1, 6.0)]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        out = raster.mosaic(spark.createDataFrame(rows, "g string, ts int, px int, value double"), ["px"], ["ts", "g"])
        assert sorted(tuple(r) for r in out.collect()) == [(0, 6.0), (1, 7.0)]


def test_deciles(spark):
    def run(data):
        df = spark.createDataFrame([(1, float(v)) for v in data], "k int, value double")
        return [r["value"] for r in drill.deciles(df, ["k"]).orderBy("decile").collect()]

    assert run(range(1, 20)) == [float(v) for v in range(2, 11)]
    assert run(range(1, 21)) == [3.5, 5.5, 7.5, 9.5, 11.5, 13.5, 15.5, 17.5, 19.5]
    assert run([4, 9]) == [4.0, 9.0] * 4 + [4.0]
    assert run([1] * 500 + [2] * 500)[4] == 2.0


def test_partial_means_merge_to_the_global_one(spark):
    rows = [(i % 3, i % 7, float(i * i % 11)) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, part int, value double")
    parts = df.groupBy("k", "part").agg(F.avg("value").alias("value"), F.count("value").alias("count"))
    whole = {r["k"]: r["v"] for r in df.groupBy("k").agg(F.avg("value").alias("v")).collect()}
    for r in drill.weighted_merge(parts, ["k"]).collect():
        assert r["value"] == pytest.approx(whole[r["k"]])


def test_palettes_have_256_colours():
    for n in range(2, 12):
        ramp = raster.palette([(i * 20, 255 - i * 20, 0, 255) for i in range(n)], True)
        assert len(ramp) == 256 and ramp[0] == (0, 255, 0, 255)
        assert len(raster.palette([(i, i, i, 255) for i in range(n)], False)) == 256


def test_overview_and_windows():
    assert raster.overview([2, 4, 8], 5) == 1 and raster.overview([2, 4, 8], 1.5) == -1 and raster.overview([2, 4, 8], 8) == 2
    cells = raster.windows(2500, 1100, 1000, 2)
    assert sum(w * h for _, _, w, h, _ in cells) == 2500 * 1100 and max(c[4] for c in cells) == 1


def test_bit_tests_come_in_pairs():
    with pytest.raises(ValueError, match="pairs"):
        raster.masked_by_tests(F.col("m"), ["01", "01", "10"])


def test_path_functions(spark):
    data = [("/a/b/c.nc",), ("/a",), ("/",)]
    got = values(spark, data, "p string", paths.ancestors(F.col("p")), paths.depth(F.col("p")), paths.basename(F.col("p")))
    assert got == [(["/a", "/a/b"], 3, "c.nc"), ([], 1, "a"), ([], 1, "")]


def test_geometry(spark):
    ring = geo.ring_edges(geo.points([(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)]))
    data = [(1.0, 1.0), (2.0, 3.0), (3.9, 3.0), (-1.0, 1.0)]
    assert [r[0] for r in values(spark, data, "x double, y double", geo.in_ring(F.col("x"), F.col("y"), ring))] == [True, False, True, False]
    assert values(spark, [(1,)], "k int", geo.ring_area(ring)) == [(10.0,)]
    x, y = geo.transform(F.col("x"), F.col("y"), 4326, 3857)
    back = geo.transform(x, y, 3857, 4326)
    for a, b in values(spark, [(13.0, 52.0)], "x double, y double", *back):
        assert (a, b) == (pytest.approx(13.0), pytest.approx(52.0))
    hull = geo.hull(geo.points([(0, 0), (2, 2), (4, 0), (4, 4), (0, 4), (1, 1), (2, 0)]))
    assert [(p["x"], p["y"]) for p in values(spark, [(1,)], "k int", hull)[0][0]] == [(0, 0), (4, 0), (4, 4), (0, 4)]
    assert values(spark, [("POLYGON ((1 2,3 4,5 6))",), ("POINT (1 1)",)], "w string", F.size(geo.wkt_ring(F.col("w")))) in ([(3,), (-1,)], [(3,), (None,)])


def test_spatial_join_reports_pairs_once(spark):
    rng = random.Random(2)
    box = lambda i: (i, *(lambda x, y: (x, y, x + rng.uniform(0, 30), y + rng.uniform(0, 30)))(rng.uniform(-90, 60), rng.uniform(-60, 30)))
    a, b = [box(i) for i in range(60)], [box(i) for i in range(40)]
    kind = "id int, xmin double, ymin double, xmax double, ymax double"
    got = sorted((r["id"], r["r_id"]) for r in catalog.spatial_join(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind)).collect())
    assert got == sorted((p[0], q[0]) for p in a for q in b if p[1] <= q[3] and p[3] >= q[1] and p[2] <= q[4] and p[4] >= q[2])


def test_index_tiles_cover_the_box():
    tiles = catalog.index_tiles(-10, -5, 15, 8, 7)
    assert sum((t[2] - t[0]) * (t[3] - t[1]) for t in tiles) == pytest.approx(25 * 13)


def test_axis_selection(spark):
    data = [([1.0, 2.0, 4.0, 8.0],), ([5.0],), ([],)]
    got = values(spark, data, "p array<double>", axes.by_index(F.col("p"), [(0, 2, 2)]), axes.by_range(F.col("p"), 2.0, 8.0), axes.nearest(F.col("p"), F.lit(3.0)))
    assert got == [([0, 2], [1, 2], 1), (None, [0], None), (None, [], None)]
    with pytest.raises(ValueError, match="beyond"):
        axes.by_index(F.col("p"), [(3, 1, 1)])


def test_dates(spark):
    days = lambda *a: [str(r["ts"])[:10] for r in dates.generate(spark, *a).orderBy("ts").collect()]
    assert days("yearly", "2015-01-01", "2018-01-01") == ["2015-01-01", "2016-01-01", "2017-01-01", "2018-01-01"]
    assert days("mcd43", "2015-01-01", "2018-01-01", 0) == [] and days("none", "2015-01-01", "2018-01-01") == []
    assert days("mcd43", "2014-12-20", "2015-01-10", 11520) == ["2014-12-20", "2014-12-28", "2015-01-01", "2015-01-09"]
    assert days("chirps20", "2015-01-15", "2015-02-20") == ["2015-01-01", "2015-01-11", "2015-01-21", "2015-02-01", "2015-02-11", "2015-02-21"]


def test_expressions(spark):
    e = expressions.parse("out = (a + b) * 2 ** 3 > 10 && !(a == b) ? a : 0 - b", ["a", "b"])
    assert e.name == "out" and e.variables == ("a", "b") and not e.bare
    assert values(spark, [(1.0, 2.0), (0.1, 0.2)], "a double, b double", e.column()) == [(1.0,), (-0.2,)]
    assert expressions.parse("red").bare
    for bad in ("a; drop", "f(a)", "a + c", "(a", "a)", "", "`a`", "a ? b", "'x'"):
        with pytest.raises(ValueError):
            expressions.parse(bad, ["a", "b"])


def test_subsets_and_constraints():
    s = requests.parse_subset("time(*,5)order=desc;level((1,2.5));z(3)agg=none")
    assert (s["time"].low, s["time"].high, s["time"].order) == (requests.LOWEST, 5.0, "desc")
    assert s["level"].values == [1.0, 2.5] and (s["z"].low, s["z"].high, s["z"].aggregate) == (3.0, 3.0, False)
    c = requests.parse_constraint("/ds{v;w[2:2:8][3][]}|x>=1,x<5,-2<y<=3")
    assert c.variables == {"v": [], "w": [(2, 8, 2), (3, 3, 1), None]}
    assert (c.axes["x"].low_open, c.axes["x"].high_open, c.axes["y"].low_open) == (False, True, True)
    for bad in ("v", "ds{v[5:2]}", "ds{v}|x~3"):
        with pytest.raises(ValueError):
            requests.parse_constraint(bad)


def test_file_names(spark):
    names = [("T55HFA_20180102T001122_B04.jp2",), ("x_roms_y.nc",), ("S2_20180102T001122_abc_NBART_B02.TIF",), ("other",)]
    rule = ingest.matched_rule(F.col("n"))
    got = values(spark, names, "n string", rule, ingest.rule_field(F.col("n"), rule, "namespace"), ingest.name_time(F.col("n"), rule).cast("string"))
    assert got == [("sentinel2", "B04", "2018-01-02 00:11:22"), ("ereef", None, None), ("sentinel2_ard_nbar_nbart", "NBART_B02", "2018-01-02 00:11:22"), ("default", None, None)]


def test_query_maps(spark):
    got = values(spark, [("A=1&b=x\\&y&a=2&flag",)], "q string", requests.query_map(F.col("q")))
    assert got == [({"a": "2", "b": "x&y"},)]


def test_powers_of_calls_brackets_and_signs(spark):
    df = spark.createDataFrame([(4.0, 2.0)], "a double, b double")
    for text, want in (
        ("sqrt(a)**2", 4.0), ("a ** -1", 0.25), ("2 ** 3 ** b", 512.0), ("-a ** 2", -16.0), ("(a + b) ** (b - 1)", 6.0), ("b ** sqrt(a) ** 2", 16.0),
        ("pow(a, b) ** 0.5 + 1", 5.0), ("a ** - -b", 16.0),
    ):
        assert df.select(expressions.parse(text, ["a", "b"]).column()).first()[0] == pytest.approx(want), text


def test_cells_hold_equally_many_rows_beside_an_outlier(spark):
    rows = [(1, float(i)) for i in range(5000)] + [(1, 1e12), (2, 3.0)]
    df = spark.createDataFrame(rows, "k int, value double")
    from terrastrata.operators.nearest import in_cells

    placed = in_cells(df, ["k"], "value", "cell")
    sizes = [r["count"] for r in placed.groupBy("k", "cell").count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) < 100
    order = [r["cell"] for r in placed.where("k = 1").orderBy("value").collect()]
    assert order == sorted(order)
    assert [r["value"] for r in drill.deciles(df, ["k"]).where("k = 1").orderBy("decile").collect()] == [float(500 * (i + 1)) for i in range(9)]


def test_hulls_of_many_points_in_steps(spark):
    rng = random.Random(4)
    points = [(1, float(rng.randint(0, 300)), float(rng.randint(0, 300))) for _ in range(3000)] + [(2, 1.0, 1.0), (3, 0.0, 0.0), (3, 2.0, 2.0), (3, 1.0, 1.0)]
    got = {k: sorted((r["x"], r["y"]) for r in rows) for k, rows in _grouped(catalog.hulls(spark.createDataFrame(points, "k int, x double, y double"), ["k"], part=64)).items()}

    def chain(p):
        out = []
        for c in p:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (c[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (c[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(c)
        return out[:-1]

    own = sorted({p[1:] for p in points if p[0] == 1})
    assert got[1] == sorted(chain(own) + chain(own[::-1])) and got[2] == [(1.0, 1.0)] and got[3] == [(0.0, 0.0), (2.0, 2.0)]


def _grouped(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["k"], []).append(r)
    return out


def test_far_times_equal_sql(spark, tmp_path):
    import duckdb

    from terrastrata.plans.registry import ORACLES, QUERIES

    days = [2, 7, 99_997, 2_932_892, 2_932_897, 5_999_997, 11_574_072, 11_574_077, 35_999_997]  # to years 9999, 10000, 33658, 100534
    spark.createDataFrame([(i,) for d in days for i in range(d - 2, d + 3)], "event_id long").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = {r["event_id"]: r["ts"] for r in QUERIES["cf_times"](spark, str(tmp_path)).collect()}
    assert got == dict(con.execute(ORACLES["cf_times"]).fetchall()) and got[2_932_897] == "10000-01-01T12:00:00Z"
    units = F.lit("days since 1970-01-01")
    row = spark.range(1).select(*(times.decode_cf(F.lit(v), units).cast("string").alias(n) for n, v in (("a", -0.25), ("b", float("nan")), ("c", float("inf"))))).first()
    assert tuple(row) == ("1969-12-31 18:00:00", None, None)


def test_nearest_dates_match_brute_force_without_frames_to_the_end(spark):
    rng = random.Random(5)
    known = [(rng.choice("ab"), rng.randrange(2000), i) for i in range(900)] + [("d", 7, 900), (None, 9, 901)]
    asked = [(g, rng.randrange(-50, 2050)) for g in "abcd" for _ in range(150)] + [("a", 3), ("a", 3), (None, 4)]
    kind = "ns string, s int"
    stamp = F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts")
    observed = spark.createDataFrame(known, f"{kind}, i int").select("ns", stamp)
    out = dates.on_grid(observed, spark.createDataFrame(asked, kind).select("ns", stamp), ["ns"])
    plan = out._jdf.queryExecution().executedPlan().toString().lower()
    assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan  # such frames cost the square of a cell's rows
    seconds = lambda c: times.epoch(F.col(c)).cast("int").alias(c)
    got = sorted(map(tuple, out.select("ns", seconds("ts"), seconds("nearest")).collect()), key=repr)
    best = lambda g, s: min((k for h, k, _ in known if h == g), key=lambda k: (abs(k - s), k), default=None)
    assert [r for r in got if r[0]] == sorted(((g, s, best(g, s)) for g, s in asked if g), key=repr)
