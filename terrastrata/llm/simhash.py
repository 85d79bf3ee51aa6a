"""SimHash near-duplicates by pigeonhole blocks.

Two 64-bit fingerprints that differ in at most ``d`` bits, cut into ``b`` blocks, agree in at least
``b - d`` of them. Each distinct fingerprint is sent to one key per choice of ``b - d`` blocks, joined on
that key, and the Hamming distance is verified in the join. Exact copies share a fingerprint and count
as one node from the start.

A key that many fingerprints share would make all their pairs. Such a group isn't paired: its members
agree in the key's bits, so the pigeonhole is applied again to the bits left, which narrows the key and
splits the group. When few bits are left, a group can't hold more distinct fingerprints than those bits
allow. No link is lost on the way and no group is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, cut, let, table, without, words_of, written

SHINGLE, DISTANCE, BLOCKS = 3, 2, 4
#: Members up to which a key's group is paired at once; with at most FREE bits left it always is.
SMALL_GROUP, FREE = 128, 8
ADDED = ("fingerprint", "component_id")


def shingle_hashes(text: Column, width: int = SHINGLE) -> Column:
    """XXH64 (seed 42) of every run of ``width`` words, joined by blanks; fewer words: of them all."""

    def hashes(w: Column) -> Column:
        each = F.transform(
            F.sequence(F.lit(0), F.size(w) - width),
            lambda i: F.xxhash64(F.concat_ws(" ", *(F.get(w, i + k) for k in range(width)))),
        )
        short = F.array(F.xxhash64(F.array_join(w, " ")))
        return F.when(F.size(w) >= width, each).when(F.size(w) > 0, short).otherwise(F.array().cast("array<bigint>"))

    return let(words_of(ascii_lower(F.coalesce(text, F.lit("")))), hashes)


def majority(hashes: np.ndarray) -> int:
    """The 64 majority bits of an array of hashes: set where over half of them have a one."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 50_000):  # bounded memory for texts of any length
        part = np.ascontiguousarray(hashes[i : i + 50_000], "<i8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def with_print(rows: DataFrame, name: str, text_col: str = "text", carry_text: bool = True) -> DataFrame:
    """``rows`` with the fingerprint (the 64 bits as a signed long) of the text as the last column.

    Texts without words get zero. Without ``carry_text`` the text is left out and never sent to Python.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, others = batch.column(batch.num_columns - 1), batch.columns[:-1]
            values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            prints = [majority(values[i:j]) for i, j in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([*others, pa.array(prints, pa.int64())], names=[*batch.schema.names[:-1], name])

    others = rows if carry_text else rows.drop(text_col)
    hashed = rows.select(*others.columns, shingle_hashes(F.col(text_col)).alias("__hashes"))
    return hashed.mapInArrow(run, T.StructType([*others.schema.fields, T.StructField(name, T.LongType())]))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``fp`` of each row."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return with_print(slim, "fp", carry_text=False)


def _mask(bits: list[int]) -> int:
    value = reduce(lambda a, b: a | (1 << b), bits, 0)
    return value - (1 << 64) if value >> 63 else value


def _keys(bits: list[int], distance: int, blocks: int) -> list[list[int]]:
    """The bits of each choice of ``blocks - distance`` blocks of ``bits``."""
    parts = [list(map(int, p)) for p in np.array_split(bits, blocks)]
    return [sum(chosen, []) for chosen in combinations(parts, blocks - distance)]


def links(nodes: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """All pairs ``a < b`` of distinct fingerprints (column ``fp``) at 1 to ``distance`` differing bits."""
    everything = list(range(64))
    # A key is a mask of bits and the fingerprint's bits under it.
    masks = [(_mask(k), [b for b in everything if b not in k]) for k in _keys(everything, distance, blocks)]
    level = nodes.select(
        "fp", F.explode(F.array(*(F.struct(F.lit(m).alias("m"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for m, _ in masks))).alias("k")
    ).select("fp", "k.m", "k.v")
    free = {m: rest for m, rest in masks}
    found = []
    while True:
        sizes = level.groupBy("m", "v").agg(F.count(F.lit(1)).alias("n"))
        last = all(len(rest) <= FREE for rest in free.values())
        small = sizes.where(F.col("n") > 1) if last else sizes.where(F.col("n").between(2, SMALL_GROUP))
        members = level.join(small.drop("n"), ["m", "v"])
        near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
        left, right = members.withColumnRenamed("fp", "a"), members.withColumnRenamed("fp", "b")
        same = (F.col("l.m") == F.col("r.m")) & (F.col("l.v") == F.col("r.v"))
        found.append(left.alias("l").join(right.alias("r"), same & (F.col("a") < F.col("b")) & near).select("a", "b"))
        if last:
            break
        hot = cut(level.join(sizes.where(F.col("n") > SMALL_GROUP).drop("n"), ["m", "v"]))
        if hot.isEmpty():
            break
        narrower: dict[int, list[int]] = {}
        per_mask = []
        for m, rest in free.items():
            deeper = []
            for k in _keys(rest, distance, blocks):
                wider = _mask([b for b in everything if b not in rest] + k)
                deeper.append(wider)
                narrower[wider] = [b for b in rest if b not in k]
            per_mask.append((m, F.array(*map(F.lit, deeper))))
        choose = reduce(lambda w, x: w.when(F.col("m") == x[0], x[1]), per_mask[1:], F.when(F.col("m") == per_mask[0][0], per_mask[0][1]))
        level = hot.select("fp", F.explode(choose).alias("m")).select("fp", "m", F.col("fp").bitwiseAND(F.col("m")).alias("v")).distinct()
        free = narrower
    return reduce(DataFrame.unionByName, found).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and the smallest node it reaches as ``root``, for the nodes of ``edges`` (``a``, ``b``).

    Alternates large and small stars: neighbours move to the smallest node known, so that chains halve
    in each round. Rounds end when the edges no longer change; only a count and a checksum come to the
    driver. Every round is a reliable checkpoint.
    """

    def smallest(pairs: DataFrame) -> DataFrame:
        least = pairs.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
        return pairs.join(least, "a")

    def state(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    current = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = state(current)
    while before[0]:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = smallest(both).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = large.where(F.col("a") != F.col("b")).distinct()
        small = smallest(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
        moved = small.select(F.col("b").alias("a"), F.col("least").alias("b"))
        current = cut(moved.unionByName(small.select("a", F.col("least").alias("b"))).where("a <> b").distinct())
        now = state(current)
        if now == before:
            break
        before = now
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def group(prints: DataFrame) -> DataFrame:
    """Rows ``id``, ``fp`` with ``component_id`` (the smallest id reachable) and ``root`` (its smallest
    fingerprint). Ids may be null or repeat; a component whose ids are all null has a null id."""
    nodes = cut(prints.groupBy("fp").agg(F.min("id").alias("low")))
    reached = components(links(nodes))
    named = nodes.join(reached.withColumnRenamed("node", "fp"), "fp", "left")
    named = named.withColumn("root", F.coalesce("root", "fp"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    return prints.join(named.join(lowest, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``, one row per input row.

    Null and empty texts have fingerprint zero, which links like any other. Repeated rows stay, each
    with the same result; null doc_ids are kept and never chosen as the smallest; an empty table gives
    no rows; extra columns are ignored.
    """
    grouped = group(written(fingerprints(docs)))
    return grouped.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, one row for each near-duplicate group: that with the smallest doc_id.

    Rows that repeat this doc_id (or share a null one) within the group count as copies: one stays.
    Texts are shuffled once, on the keys of the chosen rows, which also tells copies of these apart.
    """
    kid = F.when(F.col("doc_id").isNull(), "-").otherwise(F.concat(F.lit("+"), F.col("doc_id").cast("string")))
    keys = {"__kid": kid, "__h": F.xxhash64(F.coalesce(F.col("text"), F.lit("")))}
    own = without(docs, *keys).withColumns(keys)
    slim = own.select(F.col("doc_id").alias("id"), "text", *keys)
    grouped = group(written(with_print(slim, "fp", carry_text=False)))
    first = grouped.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min(F.struct(*keys)).alias("k"))
    chosen = own.join(first.select("k.*"), [*keys], "left_semi")
    return chosen.dropDuplicates([*keys]).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group every document."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
