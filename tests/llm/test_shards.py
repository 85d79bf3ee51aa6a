import numpy as np

from terrastrata.llm import shards

from .helpers import DOCS, rows, table


def test_curve_visits_every_cell_once_and_steps_by_one():
    for dims, bits in ((2, 3), (3, 3), (3, 2)):
        n = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(n)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
        order = shards.hilbert_index(cells, bits)
        assert sorted(order) == list(range(n**dims))
        path = cells[np.argsort(order)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def check(out, shards_=8):
    sizes = [0] * shards_
    for s in range(shards_):
        slots = sorted(r["slot"] for r in out if r["shard"] == s)
        assert slots == list(range(len(slots)))
        sizes[s] = len(slots)
    assert sum(sizes) == len(out) and max(sizes) - min(sizes) <= 1


def test_query(spark, sf_dir):
    import zlib

    out = shards.query(spark, sf_dir).collect()
    check(out)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in out:
        assert r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) and r["size"] == len(texts[r["doc_id"]].encode()) + 1
        assert r["law"] == "rows" and r["grown_shard"] is None
    # Shards are runs of the curve.
    bounds = [(min(r["curve"] for r in out if r["shard"] == s), max(r["curve"] for r in out if r["shard"] == s)) for s in range(8)]
    assert all(a[1] <= b[0] for a, b in zip(bounds, bounds[1:]))


def test_edges(spark):
    out = shards.along_curve(table(spark)).collect()
    assert len(out) == len(rows())
    check(out)
    assert sorted(r["size"] for r in out)[:3] == [1, 1, 1] and all(r["key"] in ("k", None) for r in out)
    assert shards.along_curve(spark.createDataFrame([], DOCS)).count() == 0


def test_filters_skip_shards(spark, sf_dir, tmp_path):
    """How many of 16 shards a filter must open by their minimum and maximum, against runs in order of doc_id."""
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    shards.write_shards(docs, f"{tmp_path}/s", 16)
    rows = [r.asDict() for r in spark.read.parquet(f"{tmp_path}/s").select("doc_id", "lang", "source", "size", "shard").collect()]
    assert len(rows) == docs.count()

    def opened(of, column, low, high):
        ends = {}
        for r in rows:
            a, b = ends.get(of(r), (r[column], r[column]))
            ends[of(r)] = min(a, r[column]), max(b, r[column])
        return sum(a <= high and low <= b for a, b in ends.values())

    ids = {d: i * 16 // len(rows) for i, d in enumerate(sorted(r["doc_id"] for r in rows))}
    sizes = sorted(r["size"] for r in rows)
    filters = [("lang", v, v) for v in {r["lang"] for r in rows}] + [("source", v, v) for v in {r["source"] for r in rows}]
    filters += [("size", sizes[i * len(sizes) // 8], sizes[(i + 1) * len(sizes) // 8 - 1]) for i in range(8)]
    for column, most in (("lang", 10), ("source", 10), ("size", 10)):
        mine = [f for f in filters if f[0] == column]
        curve = sum(opened(lambda r: r["shard"], *f) for f in mine) / len(mine)
        by_id = sum(opened(lambda r: ids[r["doc_id"]], *f) for f in mine) / len(mine)
        print(column, curve, by_id)
        assert curve < most < 15 < by_id


def test_clashing_columns(spark):
    odd = table(spark).selectExpr("*", "1 AS __at", "2 AS __part", "3 AS __place", "4 AS __k0", "'x' AS curve")
    out = shards.along_curve(odd).collect()
    assert {(r["__at"], r["__part"], r["__place"], r["__k0"]) for r in out} == {(1, 2, 3, 4)} and all(isinstance(r["curve"], int) for r in out)
