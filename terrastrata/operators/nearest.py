"""Nearest neighbours on a line, without pairs and without a group in one task.

Each group's line is cut into cells that hold about equally many rows, wherever these lie. The last known place of every cell, and the first, are small
tables; a window over them says what is known before and behind each cell. Within a cell two more windows,
one each way, say it for each row. So the rows that a task sorts are those of a cell, however large a group is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Cells of a group: SIDE blocks of SIDE cells.
SIDE = 16


def in_cells(rows: DataFrame, by: list[str], at: str, name: str = "__cell") -> DataFrame:
    """``rows`` with the cell of ``at`` in its group: how many of the group's approximate quantiles don't exceed it.

    Cells rise with ``at`` and hold about equally many rows, so an outlier or a dense stretch fills none. A
    cell is found in two steps, first its block.
    """
    shares = [k / (SIDE * SIDE) for k in range(1, SIDE * SIDE)]
    cuts = rows.groupBy(*by).agg(F.percentile_approx(at, shares, 10_000).alias("__cuts"))
    cuts = cuts.withColumn("__coarse", F.filter("__cuts", lambda _, i: (i + 1) % SIDE == 0)).withColumnsRenamed({c: f"__of_{c}" for c in by})
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in by), F.lit(True))
    block = F.size(F.filter("__coarse", lambda x: x <= F.col(at)))
    within = lambda k: k * SIDE + F.size(F.filter(F.slice("__cuts", k * SIDE + 1, SIDE - 1), lambda x: x <= F.col(at)))
    cell = F.get(F.transform(F.array(block), within), F.lit(0))  # the block, found once
    return rows.join(cuts, same).select(*rows.columns, cell.alias(name))


def nearest(probes: DataFrame, known: DataFrame, by: list[str], at: str, value: str, gap) -> DataFrame:
    """``probes`` (``by``, ``at``) with ``__at`` and ``__value`` of the nearest ``known`` row, the earlier of two.

    ``gap(a, b)`` is the distance from ``a`` up to ``b``. Groups without known rows give nulls.
    """
    found = F.struct(F.col(at).alias("at"), F.col(value).alias("value"))
    none = F.lit(None).cast(known.select(found.alias("f")).schema["f"].dataType)
    rows = known.select(*by, at, found.alias("__known"), F.lit(False).alias("__probe"), F.lit(0).cast("long").alias("__n"))
    asked = probes.groupBy(*by, at).agg(F.count(F.lit(1)).alias("__n")).select(*by, at, none.alias("__known"), F.lit(True).alias("__probe"), "__n")
    both = in_cells(rows.unionByName(asked), by, at)

    ends = both.groupBy(*by, "__cell").agg(F.max(F.when(~F.col("__probe"), F.col("__known"))).alias("last"), F.min(F.when(~F.col("__probe"), F.col("__known"))).alias("first"))
    line = W.partitionBy(*by).orderBy("__cell")
    # What follows is looked up backwards: a frame up to the end is gone through anew for every row.
    back = W.partitionBy(*by).orderBy(F.desc("__cell"))
    before = F.last("last", True).over(line.rowsBetween(W.unboundedPreceding, -1))
    behind = F.last("first", True).over(back.rowsBetween(W.unboundedPreceding, -1))
    ends = ends.select(*by, "__cell", before.alias("__before"), behind.alias("__behind"))

    own = W.partitionBy(*by, "__cell").orderBy(at, "__probe")
    turned = W.partitionBy(*by, "__cell").orderBy(F.desc(at), F.desc("__probe"))
    near = both.withColumns(
        {
            "__b": F.last("__known", True).over(own.rowsBetween(W.unboundedPreceding, 0)),
            "__f": F.last("__known", True).over(turned.rowsBetween(W.unboundedPreceding, 0)),
        }
    ).where("__probe")
    near = near.join(ends, [*by, "__cell"])
    b, f = F.coalesce("__b", "__before"), F.coalesce("__f", "__behind")
    near = near.withColumns({"__b": b, "__f": f})
    closer = gap(F.col("__b.at"), F.col(at)) <= gap(F.col(at), F.col("__f.at"))
    best = F.when(F.col("__f").isNull() | (F.col("__b").isNotNull() & closer), F.col("__b")).otherwise(F.col("__f"))
    copies = near.withColumn("__best", best).withColumn("__k", F.explode(F.array_repeat(F.lit(0), F.col("__n").cast("int"))))
    return copies.select(*by, at, F.col("__best.at").alias("__at"), F.col("__best.value").alias("__value"))
