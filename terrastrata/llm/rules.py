"""Quality rules with adaptive thresholds.

Signals are counted per text with array functions. Their quantiles come from KLL sketches per
language and source; the sketches merge into one per language and one over all. A sketch's threshold
lies in the middle of the first gap in its tail, or just above its largest value where the tail has no
gap. A small group's threshold is drawn toward its language's, and that toward the one over all, the
more so the fewer texts it has. The thresholds join back on language and source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, guarded, hinted, let, one_of, table, without, written

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 50, 50, 3
#: Signal -> the least gap that sets a tail apart, and the room above the largest value without one.
GUARD = {"symbols_per_word": 0.1, "dup_line_share": 0.25, "repeat_share": 0.1, "upper_share": 0.02, "mean_word": 0.5}
#: What a gap must exceed beyond that, as a share of the way from the median to it; ranks of the median and the tail.
SPREAD, RANKS = 0.25, (0.5, *(round(0.75 + i / 400, 4) for i in range(101)))
#: Signal -> slack over the fence ``q75 + reach * (q75 - q25)`` of tables too small to show a tail.
SLACK = {"symbols_per_word": 0.25, "dup_line_share": 0.5, "repeat_share": 0.3, "upper_share": 0.4, "mean_word": 4.0}
REACH, MIN_GROUP, SKETCH_K = 4.0, 200, 400
#: Groups up to which the thresholds (some 100 bytes each) are broadcast.
MAX_BROADCAST = 50_000
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
ADDED = (*BASE, "base_failed", "kept")


def with_repeats(df: DataFrame, name: str, words: str, width: int = WINDOW) -> DataFrame:
    """``df`` with ``name``: the words that lie in windows of ``width`` words found twice or more in the text.

    Windows are hashed; where all hashes differ nothing repeats. Else they are sorted with their places, equal
    neighbours are repeats, and their places, sorted, are covered from left to right: O(n log n), one text at a
    time. The steps are columns of their own, so that each runs as compiled code over the one before.
    """
    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - width), lambda i: F.xxhash64(*(F.get(F.col(words), i + k) for k in range(width)))
    )
    df = df.withColumn("__hashes", F.when(F.size(words) >= width, windows))
    placed = F.transform("__hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    twice = F.size(F.array_distinct("__hashes")) < F.size("__hashes")
    df = df.withColumn("__twice", twice).withColumn("__sorted", F.when(F.col("__twice"), F.sort_array(placed)))

    def equal(e: Column, k: Column) -> Column:
        return F.coalesce(e["h"] == F.get("__sorted", k)["h"], F.lit(False))

    repeats = F.filter("__sorted", lambda e, k: equal(e, k - 1) | equal(e, k + 1))
    df = df.withColumn("__places", F.sort_array(F.transform(repeats, lambda e: e["i"])))
    steps = F.transform("__places", lambda at, k: F.least(F.lit(width), F.coalesce(F.get("__places", k + 1) - at, F.lit(width))))
    covered = F.coalesce(F.aggregate(steps, F.lit(0), lambda x, y: x + y), F.lit(0))
    return df.withColumn(name, covered.cast("long")).drop("__hashes", "__twice", "__sorted", "__places")


def measure(docs: DataFrame) -> DataFrame:
    """Add the counts of ``BASE`` (long), ``base_failed`` and what the signals need (``__upper``, ``__lines``).

    A null text counts like an empty one; a very long one is read whole, in one task. Write the result before
    filtering on it: Spark pushes filters down by repeating the expressions below them.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    blank = " \t\n\x0b\f\r"

    def lines(x: Column) -> Column:
        return F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))

    said = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = without(docs, *ADDED).withColumn("__pieces", F.split(text, one_of(blank) + "+", -1))
    first = (F.get("__pieces", F.lit(0)) == "").cast("int")  # white space before the first word, or no word
    size = F.size("__pieces") - first - (F.get("__pieces", F.size("__pieces") - 1) == "").cast("int")
    counted = counted.withColumn("__words", F.slice("__pieces", 1 + first, F.greatest(size, F.lit(0)))).drop("__pieces")
    counted = counted.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.array_join("__words", "")).cast("long"),
            "n_symbols": (F.size(F.split(text, one_of(SYMBOLS), -1)) - 1).cast("long"),
            "__upper": (F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}+", ""))).cast("long"),
            "__said": let(said, lines),
        }
    )
    counted = with_repeats(counted, "n_repeat_words", "__words").drop("__words")
    counted = counted.withColumns({"n_dup_lines": F.col("__said.dup").cast("long"), "__lines": F.col("__said.n").cast("long")}).drop("__said")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def _signals() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols_per_word": F.col("n_symbols") / words,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("__lines"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / words,
        "upper_share": F.col("__upper") / F.greatest(F.col("word_chars"), F.lit(1)),
        "mean_word": F.col("word_chars") / words,
    }


def thresholds(measured: DataFrame) -> DataFrame:
    """Threshold of each signal by ``lang`` and ``source`` (null is a value of its own).

    Sketches are aggregates that merge: one pass gives those of the groups, which then merge by
    language and over all. A group of fewer than ``MIN_GROUP`` texts takes the rest of its weight from
    the next larger sketch. Texts that failed the base rules are left out; of fewer than ``MIN_GROUP``
    texts over all, the fence over all holds.
    """
    names = list(SLACK)
    signals = measured.where(~F.col("base_failed")).select(
        "lang", "source", *(c.cast("double").alias(n) for n, c in _signals().items())
    )
    groups = signals.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("n"), *(F.kll_sketch_agg_double(n, F.lit(SKETCH_K)).alias(n) for n in names)
    )
    groups = cut(groups)

    def merged(*by: str) -> DataFrame:
        both = groups.groupBy(*by).agg(F.sum("n").alias("n"), *(F.kll_merge_agg_double(n).alias(n) for n in names))
        return both.select(*by, F.struct("n", *names).alias("up" if by else "all"))

    def fence(sketch: Column, slack: float) -> Column:
        low, high = (F.kll_sketch_get_quantile_double(sketch, F.lit(q)) for q in (0.25, 0.75))
        return high + REACH * (high - low) + F.lit(slack)

    def edge(sketch: Column, guard: float) -> Column:
        def first_gap(q: Column) -> Column:
            steps = F.transform(F.slice(q, 2, len(RANKS) - 2), lambda v, i: F.struct(v.alias("low"), F.get(q, i + 2).alias("high")))
            gaps = F.filter(steps, lambda e: e["high"] - e["low"] > guard + SPREAD * (e["low"] - F.get(q, F.lit(0))))
            first = F.get(gaps, F.lit(0))
            return F.coalesce((first["low"] + first["high"]) / 2, F.get(q, F.lit(len(RANKS) - 1)) + guard)

        return let(F.kll_sketch_get_quantile_double(sketch, F.array(*map(F.lit, RANKS))), first_gap)

    def drawn(n: Column, own: Column, wider: Column) -> Column:
        share = F.least(F.lit(1.0), n / MIN_GROUP)
        return share * own + (1 - share) * wider

    by_lang = merged("lang").withColumnRenamed("lang", "__lang")
    joined = groups.join(by_lang, F.col("lang").eqNullSafe(F.col("__lang")), "left").drop("__lang")
    joined = joined.join(F.broadcast(merged()))  # one row: the sketches over all

    def threshold(name: str) -> Column:
        group, lang, whole = (edge(F.col(f"{at}{name}"), GUARD[name]) for at in ("", "up.", "all."))
        shown = drawn(F.col("n"), group, drawn(F.col("up.n"), lang, whole))
        return F.when(F.col("all.n") >= MIN_GROUP, shown).otherwise(fence(F.col(f"all.{name}"), SLACK[name]))

    return cut(joined.select("lang", "source", *(threshold(n).alias(f"__max_{n}") for n in names)))


def _judged(measured: DataFrame) -> DataFrame:
    limits = hinted(thresholds(measured), MAX_BROADCAST).withColumnsRenamed({"lang": "__l", "source": "__s"})
    same = F.col("lang").eqNullSafe(F.col("__l")) & F.col("source").eqNullSafe(F.col("__s"))
    inside = F.lit(True)
    for n, c in _signals().items():
        inside = inside & F.coalesce(c <= F.col(f"__max_{n}"), F.lit(True))
    return measured.join(limits, same, "left").withColumn("kept", ~F.col("base_failed") & inside)


def judge(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or their columns ``keep``) with the counts, ``base_failed`` and ``kept``.

    Rows are measured once and written with what is carried along. ``kept`` is false where
    ``base_failed``; else true if no signal is beyond its threshold. Nulls in ``lang`` or ``source`` form
    groups of their own; null and empty texts fail the base rules; very long texts are read whole, in one
    task each; repeated rows are judged alike; an empty table gives no rows. Input columns with
    the names of added ones are replaced, others pass through.
    """
    docs = without(docs, *ADDED)
    own = [c for c in docs.columns if keep is None or c in keep]
    docs, back = guarded(docs.select(*dict.fromkeys((*own, "text", "lang", "source"))))
    measured = measure(docs)
    if "text" not in own:
        measured = measured.withColumn("text", F.lit(None).cast("string"))
    return back(_judged(written(measured)), *ADDED).select(*own, *ADDED)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their columns as they were; texts that fail the base rules aren't written."""
    own, back = guarded(docs, *ADDED)
    measured = measure(own)
    slim = measured.withColumn("text", F.when(~F.col("base_failed"), F.col("text")))
    return back(_judged(written(slim)).where("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every document; only the slim counts are kept between the two passes."""
    judged = judge(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return judged.select("doc_id", *BASE, "base_failed", "kept")
