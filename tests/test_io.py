"""Sources, sinks and streams over small files."""

import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from terrastrata.plans.registry import QUERIES
from terrastrata.sources import crawl, sinks
from terrastrata.streaming import pipelines


def test_crawler_lines(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('/a/b.nc\tgdal\t{"x": "q \\"t\\""}\n/a/c\tposix\t{"y": 1}\n')
    out = crawl.read_lines(spark, str(tmp_path)).orderBy("in_path").collect()
    assert [r["in_type"] for r in out] == ["gdal", "posix"] and json.loads(out[0]["in_json"]) == {"x": 'q "t"'}


def test_file_listing_and_filters(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.nc").write_bytes(b"123")
    (tmp_path / "b.txt").write_bytes(b"1")
    out = crawl.list_files(spark, str(tmp_path), "path =~ '\\.nc$' && type == 'file'").collect()
    assert [(r["path"].rsplit("/", 1)[1], r["size"]) for r in out] == [("a.nc", 3)]
    assert crawl.posix_lines(crawl.list_files(spark, str(tmp_path))).count() == 2
    with pytest.raises(ValueError, match="cannot read"):
        crawl.file_filter("path; drop")


def test_tables_of_parts_are_listed_once(spark, tmp_path):
    for name in ("a.parquet/part-0.parquet", "a.parquet/part-1.parquet", "a.parquet/_SUCCESS", "b.parquet", "c.parquet/k=1/l=x y/data_0.parquet", "c.parquet/k=2/l=z/data_0.parquet", "d/e.parquet", "d/f.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"123")
    (tmp_path / "c.parquet" / "empty.parquet").write_bytes(b"")
    out = crawl.list_files(spark, str(tmp_path), whole=".parquet").collect()
    assert sorted((r["path"].split(f"{tmp_path}/")[1], r["size"]) for r in out) == [("a.parquet", 6), ("b.parquet", 3), ("c.parquet", 6), ("d/e.parquet", 3), ("d/f.txt", 3)]
    assert len({r["id"] for r in out}) == 5
    listed = sorted((r["name"], r["filled"], r["id_length"]) for r in QUERIES["file_listing"](spark, str(tmp_path)).collect())
    assert listed == [(n, True, 32) for n in ("a.parquet", "b.parquet", "c.parquet", "e.parquet")]


def test_yaml_documents(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "ard.yaml").write_text(
        "extent: {center_dt: '2018-01-02T00:11:22Z'}\ngrid_spatial: {projection: {spatial_reference: EPSG:32755, valid_data: {coordinates: [[[1, 2], [3, 4]]]}}}\n"
        "image: {bands: {nbar_red: {path: r.tif, info: {width: 5, height: 6, geotransform: [1, 2, 3, 4, 5, 6]}}, fmask: {path: f.tif, info: {width: 5, height: 6}}}}\n"
    )
    out = {r["namespace"]: r for r in crawl.read_yaml(spark, str(tmp_path / "s"), "sentinel2").collect()}
    assert out["nbar_red"]["array_type"] == "Int16" and out["fmask"]["array_type"] == "Byte"
    assert out["nbar_red"]["ds_name"].endswith("/r.tif") and out["nbar_red"]["polygon"] == "POLYGON ((1 2,3 4))"
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "x.yaml").write_text("crs: EPSG:1\nproperties: {datetime: '2018-01-02 00:05:18.123+00:00'}\ngeometry: {coordinates: [[[1, 2], [3, 4]]]}\nmeasurements: {blue: {path: b.tif}}\n")
    row = crawl.read_yaml(spark, str(tmp_path / "l"), "landsat").first()
    assert row["timestamp"] == "2018-01-02T00:05:18Z" and row["polygon"] == "POLYGON ((1.000000 2.000000,3.000000 4.000000))"


@pytest.mark.parametrize("name", ["yaml_sentinel2", "yaml_landsat"])
def test_scenes_of_one_small_file_are_read_in_all_tasks(spark, sf_dir, name):
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = QUERIES[name](spark, sf_dir).groupBy(F.spark_partition_id()).count().collect()
    assert len(rows) == parts and max(r["count"] for r in rows) < 2 * sum(r["count"] for r in rows) / parts


def test_yaml_fields_alone_are_made_into_values():
    pytest.importorskip("yaml")
    rest = "lineage: !local {inputs: [" + "{id: 1, at: 2018-01-02}, " * 50 + "]}\n"
    landsat = "base: &b {path: b.tif}\nproperties: null\ncrs: EPSG:1\ngeometry: {coordinates: [[[1, 2.5], ['3', 0x10]]]}\nmeasurements: {blue: *b, red: {<<: *b, path: r.tif}}\n"
    out = list(crawl._datasets("/s/x.yaml", rest + landsat, "landsat"))
    assert [(r[1], r[2], r[3]) for r in out] == [("/s/b.tif", "blue", ""), ("/s/r.tif", "red", "")]
    assert {(r[7], r[8]) for r in out} == {("POLYGON ((1.000000 2.500000,3.000000 16.000000))", "EPSG:1")}
    sentinel2 = "extent: {center_dt: 2018-01-02 00:11:22}\nimage: {bands: {fmask: {path: f.tif, info: null}, red: {path: r.tif, info: {width: 5, geotransform: [1, .5]}}}}\n"
    out = list(crawl._datasets("/s/x.yaml", rest + sentinel2, "sentinel2"))
    assert [r[1:7] for r in out] == [("/s/f.tif", "fmask", "2018-01-02 00:11:22", None, None, []), ("/s/r.tif", "red", "2018-01-02 00:11:22", 5, None, [1.0, 0.5])]
    assert list(crawl._datasets("/s/x.yaml", "", "landsat")) == []
    with pytest.raises(ValueError, match="a mapping is expected"):
        list(crawl._datasets("/s/x.yaml", "measurements: [1]", "landsat"))


def test_tiles_are_pruned(spark, tmp_path):
    grid = spark.range(64 * 64).select(F.lit("b").alias("band"), (F.col("id") % 64).cast("int").alias("px"), F.expr("id div 64").cast("int").alias("py"), F.col("id").cast("double").alias("value"))
    sinks.write_tiles(grid, str(tmp_path / "t"), 16)
    out = crawl.read_window(spark, str(tmp_path / "t"), ["b"], (10, 20), (0, 3), 16)
    assert out.count() == 44 and len(out.inputFiles()) == 16
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in plan or "tile_x" in plan.split("PartitionFilters")[1][:300]


def test_pictures():
    data = sinks.empty_picture(4, 2)
    assert data[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", data[16:24]) == (4, 2)
    assert zlib.decompress(data[41 : 41 + struct.unpack(">I", data[33:37])[0]]) == bytes(2 * 17)
    assert struct.unpack(">II", sinks.legend([(i, 0, 0, 255) for i in range(256)])[16:24]) == (20, 256)


def test_coverage_chunks(spark, tmp_path):
    grid = spark.createDataFrame([("v", 0, 1, 2.5), ("v", 2, 0, 7.0)], "band string, py int, px int, value double")
    header = sinks.coverage_header({"t": 2}, ["v"], "Float32", 2, 3)
    sinks.write_coverage(str(tmp_path / "c"), header, {"t": [1.0, 2.0]}, grid, ["v"], 2, 3, -9.0)
    out = list(sinks.coverage_chunks(spark.read.parquet(str(tmp_path / "c"))))
    assert out[0][4:].decode() == header and struct.unpack("<2d", out[1][4:]) == (1.0, 2.0) and out[-1] == bytes([1, 0, 0, 0])
    body = b"".join(c[4:] for c in out[2:-1])
    assert struct.unpack("<6f", body) == (-9.0, 2.5, -9.0, -9.0, 7.0, -9.0)


def test_coverage_parts_hold_some_rows_each(spark, monkeypatch):
    monkeypatch.setattr(sinks, "CHUNK", 40)  # five rows of two pixels
    rows = [(b, y, x, float(100 * i + 2 * y + x)) for i, b in enumerate("vw") for y in range(12) for x in range(2) if not (b == "w" and y in (5, 6, 7, 8, 9))]
    parts = sinks.coverage_parts(spark.createDataFrame(rows, "band string, py int, px int, value double"), ["v", "w"], 2, 12, -1.0).orderBy("at").collect()
    assert [(r["at"], len(r["bytes"])) for r in parts] == [(0, 44), (1, 44), (2, 20), (3, 44), (4, 44), (5, 20)]
    got = [v for r in parts for (v,) in struct.iter_unpack("<f", r["bytes"][4:])]
    held = {(b, y, x): v for b, y, x, v in rows}
    assert got == [held.get((b, y, x), -1.0) for b in "vw" for y in range(12) for x in range(2)]


def test_ingest_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    run = lambda: pipelines.ingest_stream(spark, str(source), str(tmp_path / "store"), str(tmp_path / "ck")).awaitTermination(120)
    (source / "1.tsv").write_text("/a/b\tgdal\t{}\n/a/c\tgdal\t{}\n")
    run()
    (source / "2.tsv").write_text("/a/b\tposix\t{}\n")
    run()
    assert spark.read.parquet(str(tmp_path / "store" / "batch=1")).count() == 1  # a batch writes what it brings
    pipelines.compact(spark, str(tmp_path / "store"), str(tmp_path / "compact"))
    for stored in (pipelines.stored_paths(spark, str(tmp_path / "store")), spark.read.parquet(str(tmp_path / "compact"))):
        assert {r["pa_path"]: r["pa_type"] for r in stored.collect()} == {"/a/b": "posix", "/a/c": "gdal"}


def test_metrics_stream(spark, tmp_path):
    source = tmp_path / "m"
    log = [{"ts": f"2024-01-01T00:{m:02d}:00Z", "ns": "a", "duration": m, "bytes": 10} for m in range(0, 60, 2)]
    sinks.write_log(spark.createDataFrame([(x["ts"], "a", x["duration"], 10) for x in log], "ts string, ns string, duration long, bytes long"), str(source), F.lit("d"))
    pipelines.metrics_stream(spark, f"{source}/day=d", str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sum(r["requests"] for r in out) >= 20 and all(r["bytes"] == 10 * r["requests"] for r in out)


def test_geotiff_round_trip(spark, tmp_path):
    from terrastrata.sources import geotiff

    rows = [(b, y, x, float(100 * (b == "q") + 10 * y + x)) for b in ("p", "q") for y in range(6) for x in range(5) if (y, x) != (2, 3)]
    out = geotiff.tiles(spark.createDataFrame(rows, "band string, py int, px int, value double"), [], ["p", "q"], 4, [130.0, 0.5, 0, -20.0, 0, -0.5], 4326, -999.0)
    for r in out.collect():
        (tmp_path / f"{r['tile_x']}_{r['tile_y']}.tif").write_bytes(r["tiff"])
    (tmp_path / "no.tif").write_bytes(b"nothing")
    heads = {r["path"].rsplit("/", 1)[1]: r for r in geotiff.read_headers(spark, str(tmp_path)).collect()}
    assert set(heads) == {"0_0.tif", "0_1.tif", "1_0.tif", "1_1.tif"}
    h = heads["1_1.tif"]
    assert (h["array_type"], h["x_size"], h["y_size"], h["raster_count"], h["nodata"], h["epsg"]) == ("Float32", 4, 4, 2, -999.0, 4326)
    assert h["geo_transform"] == [132.0, 0.5, 0.0, -22.0, 0.0, -0.5] and h["polygon"].startswith("POLYGON ((132.000000 -22.000000,134.000000")
    got = geotiff.read_pixels(spark, str(tmp_path)).where("value IS NOT NULL").collect()
    seen = sorted(("pq"[r["band"] - 1], r["py"] + 4 * int(r["path"][-5]), r["px"] + 4 * int(r["path"][-7]), r["value"]) for r in got)
    assert seen == sorted(rows)


def test_geotiff_tiles_and_deflate(spark, tmp_path):
    import struct
    import zlib

    import numpy as np

    from terrastrata.sources import geotiff as G

    grid = np.arange(2 * 7 * 9).reshape(7, 9, 2).astype("<i2")  # rows x columns x bands, 4 x 4 tiles
    blocks = []
    for y in range(0, 7, 4):
        for x in range(0, 9, 4):
            block = np.zeros((4, 4, 2), "<i2")
            part = grid[y : y + 4, x : x + 4]
            block[: part.shape[0], : part.shape[1]] = part
            block[:, 1:] = np.diff(block, axis=1)
            blocks.append(zlib.compress(block.tobytes()))
    at, where = 8, []
    for b in blocks:
        where.append(at)
        at += len(b)
    extra = at
    body = b"".join(blocks) + struct.pack(f"<{len(blocks)}I", *where) + struct.pack(f"<{len(blocks)}I", *map(len, blocks)) + struct.pack("<2H2H", 16, 16, 2, 2)
    n = len(blocks)
    entries = [(256, 4, 1, 9), (257, 4, 1, 7), (258, 3, 2, None), (259, 3, 1, 8), (277, 3, 1, 2), (317, 3, 1, 2), (322, 4, 1, 4), (323, 4, 1, 4), (324, 4, n, extra), (325, 4, n, extra + 4 * n), (339, 3, 2, None)]
    table = b"".join(struct.pack("<HHI", t, k, c) + (struct.pack("<I", v) if v is not None else struct.pack("<2H", *((16, 16) if t == 258 else (2, 2)))) for t, k, c, v in entries)
    data = b"II*\0" + struct.pack("<I", 8 + len(body)) + body + struct.pack("<H", len(entries)) + table + b"\0\0\0\0"
    (tmp_path / "a.tif").write_bytes(data)
    got = {(r["band"], r["py"], r["px"]): r["value"] for r in G.read_pixels(spark, str(tmp_path)).collect()}
    assert got == {(b + 1, y, x): float(grid[y, x, b]) for b in range(2) for y in range(7) for x in range(9)}
    packed = data.replace(struct.pack("<HHII", 259, 3, 1, 8), struct.pack("<HHII", 259, 3, 1, 5))
    with pytest.raises(ValueError, match="can't be read"):
        list(G._blocks("b.tif", packed))


def test_many_rasters_are_drawn_and_read_some_pixels_at_a_time(spark, monkeypatch):
    import numpy as np
    import pandas as pd

    from terrastrata.sources import geotiff as G

    class Taken:
        def select(self, *_):
            return self

        def mapInPandas(self, run, _):
            self.run = run
            return self

        def withColumn(self, *_):
            return self

    files = [G.encode(np.full((1, 8, 8), float(i), "f4"), [0.0, 1.0, 0, 0.0, 0, -1.0], 4326, 7.0) for i in range(300)] + [b"no"]
    frames = list(G.pixels(Taken()).run([pd.DataFrame({"path": [str(i) for i in range(301)], "content": files})]))
    assert len(frames) == 1 and (pixels := frames[0].groupby("path")["value"]).size().eq(64).all() and len(pixels) == 300
    assert all(set(v) == {float(k)} for k, v in pixels if k != "7") and frames[0]["value"].isna().sum() == 64
    monkeypatch.setattr(G, "CELLS", 1000)
    frames = list(G.pixels(Taken()).run([pd.DataFrame({"path": ["a"] * 300, "content": files[:300]})]))
    assert {len(f) for f in frames[:-1]} == {1024} and sum(map(len, frames)) == 300 * 64

    rows = spark.range(700 * 64).where("id % 64 < 40 OR id % 128 < 64").select(
        F.expr("id div 64").alias("t"), F.lit("v").alias("band"), F.expr("id % 64 div 8").cast("int").alias("py"), F.expr("cast(id % 8 as int)").alias("px"), F.col("id").cast("double").alias("value"),
    )
    made = G.tiles(rows.coalesce(1), ["t"], ["v"], 8, [0.0, 1.0, 0, 0.0, 0, -1.0], 4326, -1.0)
    assert "MapInArrow" in made._jdf.queryExecution().executedPlan().toString()
    got = G.pixels(made.select(F.col("t").cast("string").alias("path"), F.col("tiff").alias("content")))
    assert got.count() == 700 * 64
    wanted = rows.select(F.col("t").cast("string").alias("path"), "py", "px", "value")
    found = got.where("value IS NOT NULL").select("path", "py", "px", "value")
    assert found.exceptAll(wanted).count() == 0 and wanted.exceptAll(found).count() == 0


def test_layer_configuration(spark, tmp_path):
    from terrastrata.plans import services as S

    (tmp_path / "land").mkdir()
    (tmp_path / "config.json").write_text(
        '{"layers": [{"name": "a", "rgb_products": [$gdoc$x = (A -\n N) / \t2$gdoc$], "mask": {"bit_tests": ["110", "100"]}, "step_hours": 2, "accum": true,'
        ' "palette": {"interpolate": false, "colours": [{"R": 1, "G": 2, "B": 3, "A": 255}]}}, {"name": "b", "input_layers": [{"name": "a"}, {"namespace": "land", "name": "c"}]}]}'
    )
    (tmp_path / "land" / "config.json").write_text('{"layers": [{"name": "c", "rgb_products": ["R"], "zoom_limit": 10}]}')
    out = S.read_layers(spark, str(tmp_path))
    a, b = out["."]
    assert set(out) == {".", "land"} and a.bands == ["A", "N"] and a.mask_tests == ["110", "100"] and a.accumulate_minutes == 120
    assert a.colours == [(1, 2, 3, 255)] and not a.interpolate and out["land"][0].zoom_limit == 10
    assert [x.name for x in S.source_layers(out, b)] == ["a", "c"]
    with pytest.raises(ValueError, match="isn't closed"):
        S.layer_document("{} $gdoc$")
    with pytest.raises(LookupError):
        S.source_layers({}, b)
    rows = [("A", 1.0), ("N", 4.0)]
    pixels = spark.createDataFrame([(n, 0, 0, v, q, 1, 1, 1, 1) for n, v in rows for q in (0, 4)], "band string, px int, py int, value double, qa int, k1 int, k2 int, k3 int, k4 int")
    pixels = pixels.withColumn("value", F.when(F.col("qa") == 4, -9.0).otherwise(F.col("value"))).withColumn("ts", F.lit("2020-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("qa")))
    seen = S.products(pixels, a, S.TileRequest((0, 1), (0, 1), "2020-01-01", "2020-01-02")).collect()
    assert [r["x"] for r in seen] == [-1.5]  # the later, masked value isn't seen


def test_rule_sets_of_a_user():
    from terrastrata.operators import ingest

    rules = ingest.read_rules('{"rule_sets": [{"pattern": "roms", "bbox": [-180, 90, 180, -90]}]}')
    assert rules[0].box == (-180, 90, 180, -90) and rules[0].namespace == "dataset" and rules[0].name == "rule0"
    for bad, error in (('{"pattern": "a", "namespace": "ns_x"}', "no namespace"), ('{"pattern": "a", "bbox": [1]}', "a box is"), ('{"pattern": "a", "collection": "r"}, {"pattern": "b", "collection": "r"}', "one name")):
        with pytest.raises(ValueError, match=error):
            ingest.read_rules(f'{{"rule_sets": [{bad}]}}')
    whole = ingest.read_rules('{"rule_sets": [{"pattern": "/a/", "match_full_path": true}]}')
    with pytest.raises(ValueError, match="whole paths"):
        ingest.matched_rule(F.lit("x"), rules=whole)
