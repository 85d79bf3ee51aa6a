"""Sharding along a Hilbert curve.

Language, source and size are quantised to eight bits each by their quantiles over all rows, in their own
order, and turned into a curve index. So rows close on the curve are close in every dimension, each bit halves
the rows, and minimum and maximum of a run of rows tell on any of the three whether a filter can skip it. Rows are range-partitioned and sorted by index (then text checksum and id); each row's global
place is its partition's offset plus its place there. Shards are runs of places: their row counts differ
by one at most (the law ``rows``). Only one count per partition comes to the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import guarded, table, without, written

SHARDS, BITS = 8, 8
ADDED = ("size", "text_crc32", "law", "shard", "slot", "grown_shard", "curve")


def hilbert_index(axes: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points (rows of ``axes``, each below ``2**bits``).

    Bit by bit from the top: undo the rotation of the cell entered, Gray-decode, and interleave
    (J. Skilling, Programming the Hilbert curve, 2004).
    """
    x = axes.astype(np.int64).copy()
    n = x.shape[1]
    for q in (1 << k for k in range(bits - 1, 0, -1)):
        low = q - 1
        for i in range(n):
            flip = (x[:, i] & q) != 0
            swap = np.where(flip, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] = np.where(flip, x[:, 0] ^ low, x[:, 0] ^ swap)
            x[:, i] ^= swap
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), np.int64)
    for q in (1 << k for k in range(bits - 1, 0, -1)):
        turn ^= np.where(x[:, n - 1] & q, q - 1, 0)
    x ^= turn[:, None]
    index = np.zeros(len(x), np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            index = (index << 1) | ((x[:, i] >> bit) & 1)
    return index


def _name_key(name: Column, skip: int) -> Column:
    """Seven bytes of a name behind its first ``skip`` as a number in the names' order (null: -1)."""
    part = F.hex(F.substring(name.cast("binary"), F.lit(skip + 1), F.lit(7)))
    return F.coalesce(F.conv(F.rpad(part, 14, "0"), 16, 10).cast("long"), F.lit(-1))


def _common(low: str | None, high: str | None) -> int:
    """Bytes that all names from ``low`` to ``high`` begin with."""
    a, b = (low or "").encode(), (high or "").encode()
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def with_curve(rows: DataFrame) -> DataFrame:
    """``rows`` (``lang``, ``source``, ``size``) with ``curve``.

    Two aggregates look at all rows: one row of ends of the names, so that what all share is left out of their
    keys, and one of mergeable quantile sketches, 255 numbers a dimension. A value that many rows have
    stands in the middle of the quantiles it takes.
    """
    names = ("lang", "source")
    ends = rows.agg(*(f(F.col(c).cast("string")) for c in names for f in (F.min, F.max))).first()
    keys = [_name_key(F.col(c).cast("string"), _common(ends[2 * i], ends[2 * i + 1])) for i, c in enumerate(names)] + [F.col("size")]
    keyed = rows.withColumns({f"__k{i}": k for i, k in enumerate(keys)})
    top = 1 << BITS
    shares = [i / top for i in range(1, top)]
    cuts = [np.array(c or [], np.int64) for c in keyed.agg(*(F.percentile_approx(f"__k{i}", shares, 10_000) for i in range(3))).first()]

    @F.pandas_udf(T.LongType())
    def curve(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        axes = [(np.searchsorted(q, x, "left") + np.searchsorted(q, x, "right")) // 2 for q, x in zip(cuts, (a, b, c))]
        return pd.Series(hilbert_index(np.stack(axes, axis=1), BITS))

    return keyed.withColumn("curve", curve("__k0", "__k1", "__k2")).drop("__k0", "__k1", "__k2")


def _measured(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({"size": (F.octet_length(text) + 1).cast("long"), "text_crc32": F.crc32(text.cast("binary"))})


def along_curve(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``docs`` with ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``, ``curve``.

    A null text has size 1 and checksum 0; null languages and sources come before all others on their axis. Ties
    on the curve are ordered by checksum and id, fully equal rows in any order. ``slot`` counts from 0
    without gaps in each shard; ``grown_shard`` is null under the law ``rows``. Very long texts are rows like
    others. Input columns with these names are replaced, others pass through; an empty table gives no rows.
    """
    own, back = guarded(without(docs, *ADDED))
    return back(_cut_runs(with_curve(_measured(own)), shards), *ADDED)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """``along_curve`` as Parquet, a folder per shard; rows follow the curve, so that files and row groups prune as well."""
    along_curve(docs, shards).write.partitionBy("shard").parquet(path)


def _cut_runs(keyed: DataFrame, shards: int) -> DataFrame:
    spark = keyed.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), shards)
    order = ["curve", "text_crc32", "doc_id"]
    ranged = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # The id holds the partition above bit 33 and the place in it below; written, so that it never changes.
    placed = written(ranged.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("__at"), 33)
    counts = sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, total = {}, 0
    for p, n in counts:
        offsets[p], total = total, total + n
    rows = [(p, o) for p, o in offsets.items()]
    offset = spark.createDataFrame(rows, "__part long, __offset long")
    out = placed.withColumn("__part", part).join(F.broadcast(offset), "__part")  # one row per partition
    place = F.col("__offset") + F.col("__at").bitwiseAND((1 << 33) - 1)
    out = out.withColumn("__place", place).withColumn("shard", F.expr(f"cast(__place * {shards} div {max(total, 1)} as int)"))
    # The first place of a shard s is the least p with p * shards >= s * total.
    first = F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")
    out = out.withColumns({"slot": F.col("__place") - first, "law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})
    return out.drop("__part", "__offset", "__at", "__place")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard every document; the text itself isn't moved."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    slim = written(_measured(docs).drop("text"))  # some 40 bytes a row, so that texts are read once
    out = _cut_runs(with_curve(slim), SHARDS)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "curve")
