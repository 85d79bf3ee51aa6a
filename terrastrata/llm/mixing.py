"""Mixing sources to target weights by iterative proportional fitting, in DataFrames only.

Token counts are summed by source, language and topic. Raking scales the cells to each dimension's
target shares in turn until all three hold, with no cell beyond its own tokens: what one lacks goes to
the others. A document is then drawn with its cell's calibrated probability: its tokens to draw over
those at hand. Cells number at most sources x languages x topics and
stay a DataFrame throughout.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, guarded, hinted, one_of, table, without, written

DIMENSIONS = ("source", "lang", "topic")
#: Target share of a value: its own share to this power, normalised (1: as found, 0: all equal).
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.7}
#: Tokens to draw, as a share of all; sweeps and the largest relative miss of a target allowed.
BUDGET, SWEEPS, TOLERANCE = 0.5, 30, 1e-3
SEED = 20
#: Cells up to which the rates (some 60 bytes each) are broadcast.
MAX_BROADCAST = 50_000
ADDED = ("topic", "n_tokens", "probability", "sampled")
_WHITE = r"[\x20\x09\x0A\x0B\x0C\x0D]+"


def _count_of(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are among ``chars``, which are few in most texts."""
    return F.size(F.split(text, one_of(chars), -1)) - 1


def n_tokens(pieces: Column) -> Column:
    """Runs of characters other than white space, from a text split at white space."""
    blank = lambda at: (F.get(pieces, at) == "").cast("int")
    return F.greatest(F.size(pieces) - blank(F.lit(0)) - blank(F.size(pieces) - 1), F.lit(0)).cast("long")


def topic_of(text: Column, tokens: Column) -> Column:
    """A document's kind by its form: what of it is symbols, table cells or capitals, else its length.

    For tables without topics; those that have a column or a classifier's output give it to ``mix``.
    """
    text = F.coalesce(text, F.lit(""))
    size = F.length(text)
    symbols, cells = _count_of(text, "#*$%&<>{}=;"), _count_of(text, "|")
    capitals = size - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return (
        F.when(tokens == 0, "empty").when(4 * symbols > tokens, "symbols").when(4 * cells > tokens, "table")
        .when(3 * capitals > size, "capitals").when(tokens < 100, "note").when(tokens < 1000, "article").otherwise("book")
    )


def _values(docs: DataFrame, topic: Column | None) -> DataFrame:
    """Add ``n_tokens``, ``topic`` and the dimensions as names without nulls (``__source`` and so on)."""
    given = {} if topic is None else {"__given": topic}
    docs = docs.withColumns({**given, "__pieces": F.split(F.coalesce(F.col("text"), F.lit("")), _WHITE, -1)})
    docs = docs.withColumn("n_tokens", n_tokens(F.col("__pieces"))).drop("__pieces")
    own = topic_of(F.col("text"), F.col("n_tokens")) if topic is None else F.col("__given").cast("string")
    return docs.withColumn("topic", own).withColumns({f"__{d}": F.coalesce(F.col(d).cast("string"), F.lit("")) for d in DIMENSIONS})


def tempered(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """Target shares (``value``, ``target``) of one dimension: its token shares to ``power``."""
    each = cells.groupBy(F.col(dimension).alias("value")).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("m"))
    whole = each.agg(F.sum("m").alias("__all"))
    return each.join(F.broadcast(whole)).select("value", (F.col("m") / F.col("__all")).alias("target"))  # one row


def weighted(cells: DataFrame, dimension: str, weights: dict[str, float]) -> DataFrame:
    """Target shares (``value``, ``target``) of one dimension by given weights; values that aren't named get none."""
    if not weights or any(w < 0 for w in weights.values()) or not sum(weights.values()):
        raise ValueError(f"the weights of {dimension} must be 0 or more, and one of them above 0")
    given = F.array(*(F.struct(F.lit(str(v)).alias("value"), F.lit(float(w)).alias("m")) for v, w in weights.items()))
    found = cells.sparkSession.range(1).select(F.inline(given)).join(cells.select(F.col(dimension).alias("value")).distinct(), "value")
    whole = found.agg(F.sum("m").alias("__all"))
    return found.join(F.broadcast(whole)).select("value", (F.col("m") / F.col("__all")).alias("target")).where("target > 0")  # one row


def rake(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = SWEEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` with ``weight``: the share of all tokens that raking gives each cell.

    Values without a target get none. Stops when every marginal misses its target by at most
    ``tolerance``, or after ``sweeps``; one number per sweep comes to the driver.
    """
    for d, t in targets.items():
        cells = cells.join(t.select(F.col("value").alias(d), F.col("target").alias(f"t_{d}")), d, "left").fillna(0.0, [f"t_{d}"])
    cells = cut(cells.withColumn("weight", F.col("tokens").cast("double")))
    for _ in range(sweeps):
        for d in targets:
            sums = cells.groupBy(d).agg(F.sum("weight").alias("__sum"))
            # How far off the target this marginal was before; for the first dimension after a whole sweep.
            off = F.when(F.col(f"t_{d}") > 0, F.abs(F.col("__sum") / F.nullif(F.col(f"t_{d}"), F.lit(0.0)) - 1))
            factor = F.coalesce(F.col(f"t_{d}") / F.nullif(F.col("__sum"), F.lit(0.0)), F.lit(0.0))
            cells = cells.join(sums, d).withColumns({"weight": F.col("weight") * factor, f"__off_{d}": off}).drop("__sum")
        cells = cut(cells)
        worst = cells.agg(*(F.max(f"__off_{d}") for d in targets)).first()
        cells = cells.drop(*(f"__off_{d}" for d in targets))
        if all(m is None or m <= tolerance for m in worst):
            break
    return cells.drop(*(f"t_{d}" for d in targets))


def _filled(df: DataFrame, by: list[str], goal: Column, have: str, weight: str, key: list[str]) -> DataFrame:
    """``df`` with ``__factor`` f per ``by``, for which the sum of ``least(have, f * weight)`` is ``goal``.

    That sum is the least, over what is full first by ``have / weight``, of the full ones' own and f times
    the others' weights; so f is the largest of the quotients. Weights are above 0.
    """
    ratio = F.col(have) / F.col(weight)
    up, down = (W.partitionBy(*by).orderBy(*order) for order in ([ratio, *key], [ratio.desc(), *(F.col(k).desc() for k in key)]))
    full = F.coalesce(F.sum(have).over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum(weight).over(down.rowsBetween(W.unboundedPreceding, 0))
    df = df.withColumn("__factor", (goal - full) / rest)
    return df.withColumn("__factor", F.greatest(F.lit(0.0), F.max("__factor").over(W.partitionBy(*by))))


def reachable(cells: DataFrame, dimension: str, goal: float | dict[str, float], budget: float = BUDGET) -> DataFrame:
    """Tokens to draw (``value``, ``target``, ``wanted``) of one dimension.

    ``wanted`` is the share of the budget by ``goal``: weights by value, or the power of tempered shares. A
    value gets all it has where that is less, and the
    others share what it lacks in proportion: ``target``. Where the two differ, the wish can't be met.
    """
    have = cells.groupBy(F.col(dimension).alias("value")).agg(F.sum("tokens").cast("double").alias("have"))
    whole = have.agg(F.least(F.lit(1.0), F.lit(budget)) * F.sum("have"))
    shares = weighted(cells, dimension, goal) if isinstance(goal, dict) else tempered(cells, dimension, goal)
    each = have.join(shares, "value").where("have > 0")
    each = each.join(F.broadcast(whole.toDF("__goal"))).withColumn("wanted", F.col("target") * F.col("__goal"))  # one row
    each = _filled(each.withColumn("__one", F.lit(1)), ["__one"], F.col("__goal"), "have", "wanted", ["value"])
    return each.select("value", F.least(F.col("have"), F.col("__factor") * F.col("wanted")).alias("target"), "wanted")


def bounded(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = SWEEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` with ``drawn``: raked to ``targets`` (in tokens) with no cell beyond its own tokens.

    A cell that is full keeps its weight, so that it can fall below again. Warns if a target is missed by more
    than ``tolerance`` after ``sweeps``; one row per sweep comes to the driver.
    """
    key = list(targets)
    for d, t in targets.items():
        cells = cells.join(t.select(F.col("value").alias(d), F.col("target").alias(f"t_{d}")), d)
    cells = cut(cells.where("tokens > 0").withColumns({"tokens": F.col("tokens").cast("double"), "weight": F.col("tokens").cast("double")}))
    worst = None
    for _ in range(sweeps):
        for d in targets:
            now = F.sum(F.least("tokens", "weight")).over(W.partitionBy(d))
            cells = cells.withColumn(f"__off_{d}", F.abs(now / F.col(f"t_{d}") - 1))
            cells = _filled(cells, [d], F.col(f"t_{d}"), "tokens", "weight", key)
            cells = cells.withColumn("weight", F.col("weight") * F.col("__factor")).drop("__factor")
        cells = cut(cells)
        worst = max((m for m in cells.agg(*(F.max(f"__off_{d}") for d in targets)).first() if m is not None), default=0.0)
        cells = cells.drop(*(f"__off_{d}" for d in targets))
        if worst <= tolerance:
            break
    else:
        warnings.warn(f"mixing: a target is still missed by {worst:.4f} of it after {sweeps} sweeps", stacklevel=2)
    return cells.withColumn("drawn", F.least("tokens", "weight"))


def rates(values: DataFrame, budget: float = BUDGET, targets: dict[str, float | dict[str, float]] | None = None) -> DataFrame:
    """Cells (``source``, ``lang``, ``topic``) with the ``probability`` of their documents."""
    goals = {**TEMPER, **(targets or {})}
    cells = cut(values.groupBy(*(F.col(f"__{d}").alias(d) for d in DIMENSIONS)).agg(F.sum("n_tokens").alias("tokens")))
    raked = bounded(cells, {d: cut(reachable(cells, d, goals[d], budget)) for d in DIMENSIONS})
    drawn = raked.select(*DIMENSIONS, (F.col("drawn") / F.col("tokens")).alias("probability"))
    return cut(cells.join(drawn, list(DIMENSIONS), "left").select(*DIMENSIONS, F.coalesce("probability", F.lit(0.0)).alias("probability")))


def mix(
    docs: DataFrame, keep: list[str] | None = None, budget: float = BUDGET, targets: dict[str, float | dict[str, float]] | None = None, topic: Column | None = None
) -> DataFrame:
    """``docs`` (or their columns ``keep``) with ``topic``, ``n_tokens``, ``probability`` and ``sampled``.

    ``targets`` gives for ``source``, ``lang`` or ``topic`` the weights of its values (``{"web": 3, "books": 1}``;
    values without one aren't drawn) or the power of tempered shares; ``TEMPER`` holds for the others. ``topic``
    is a column of ``docs`` or made of them; without it documents are told apart by form (``topic_of``).

    Tokens are counted over all documents. No document is drawn twice: what a cell lacks is drawn from
    others, and what a source, language or topic lacks as a whole from the others (see ``reachable``). The draw depends on doc_id and text only, so
    repeated rows share it. Null and empty sources, languages or topics are one value; texts without tokens
    have probability 0; very long ones are read whole, in one task each. Input columns with the names of added
    ones are replaced, others pass through; an empty table gives no rows.
    """
    own, given = [c for c in without(docs, *ADDED).columns if keep is None or c in keep], "given_topic"
    while given in docs.columns:
        given += "_"
    if topic is not None:
        docs = docs.withColumn(given, topic)
    needed = (*own, "doc_id", "text", "source", "lang", *([given] if topic is not None else []))
    plain, back = guarded(without(docs, *ADDED).select(*dict.fromkeys(needed)))
    draw = F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(SEED))
    values = _values(plain, None if topic is None else F.col(given))
    values = values.withColumn("__draw", F.shiftrightunsigned(draw, 11) / F.lit(float(1 << 53)))
    if "text" not in own:  # whole documents are read twice rather than written in between
        values = written(values.drop("text")).withColumn("text", F.lit(None).cast("string"))
    cells = hinted(rates(values, budget, targets), MAX_BROADCAST).withColumnsRenamed({d: f"__r_{d}" for d in DIMENSIONS})
    on = reduce(lambda a, b: a & b, [F.col(f"__{d}") == F.col(f"__r_{d}") for d in DIMENSIONS])
    out = values.join(cells, on, "left").withColumn("sampled", F.col("__draw") < F.col("probability"))
    return back(out, *ADDED).select(*own, *ADDED)


def draw(docs: DataFrame, budget: float = BUDGET, targets: dict[str, float | dict[str, float]] | None = None) -> DataFrame:
    """The rows of ``docs`` that ``mix`` draws, with their columns as they were."""
    own, back = guarded(docs, *ADDED)
    return back(mix(own, budget=budget, targets=targets).where("sampled"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's calibrated probability and draw."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return mix(docs, keep=["doc_id", "source", "lang"])
