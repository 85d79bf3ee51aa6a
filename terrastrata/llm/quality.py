"""Quality classifier with hierarchical empirical Bayes.

A logistic regression on a text's form gives each document's own evidence. Grouped sums of it give each
host's mean quality, shrunk toward that of all, and each path's, shrunk toward its host's; how much a
site's own rows count against the level above (the prior's strength) is estimated from the spread
between sites. A document's score is its evidence moved by the log-odds of its path's other documents
against those of all; it doesn't count twice. Labels of one document in five are never read, for testing.
For ``documents`` the host is the source and the path the language below it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, guarded, hinted, one_of, table, without, words_of, written
from .fitting import fit_logistic, held_out, labelled_sample

#: Labelled documents the classifier is fitted on, at most (about).
FIT_ROWS = 20_000
#: Bounds of the prior's strength, in documents; posterior means stay off 0 and 1 by MARGIN.
STRENGTH, MARGIN = (20.0, 2000.0), 1e-3
KEEP_FROM = 0.3
#: Sites up to which the posteriors (some 100 bytes each) are broadcast.
MAX_BROADCAST = 50_000
ADDED = ("evidence", "host_quality", "path_quality", "score", "kept")


def features() -> list[Column]:
    """Shares and rates of a text's form, each bounded, from ``__t`` and its words ``__w``."""
    text, size = F.col("__t"), F.greatest(F.length("__t"), F.lit(1))
    n = F.greatest(F.size("__w"), F.lit(1))

    def rate(chars: str, most: float) -> Column:
        return F.least((F.size(F.split(text, one_of(chars), -1)) - 1) / n, F.lit(most))

    again = F.size(F.filter("__w", lambda w, i: F.coalesce(w == F.get("__w", i - 1), F.lit(False)))) / n
    symbols, cells, cries = rate("#*$%&<>", 3.0), rate("|", 2.0), rate("!?", 2.0)
    capitals = (F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}+", ""))) / size
    return [
        F.least(F.log1p(F.size("__w")) / 10, F.lit(1.2)),
        symbols, cells, cries, capitals, again,
        # What is rare in running text says most by being there at all: the first tenth counts beside the rest.
        *(F.least(10 * x, F.lit(1.0)) for x in (symbols, cells, capitals, again)),
        F.size(F.array_distinct("__w")) / n,
        F.least(F.length(text) / n / 10, F.lit(3.0)),
        rate("0123456789", 3.0),
    ]


def _with_features(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with the features; a null text counts like an empty one."""
    made = features()
    names = [f"__f{i}" for i in range(len(made))]
    docs = docs.withColumn("__t", F.coalesce(F.col("text"), F.lit(""))).withColumn("__w", words_of(F.col("__t")))
    return docs.withColumns(dict(zip(names, made))).drop("__t", "__w"), names


def fit(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> np.ndarray:
    """Weights of the document classifier, from about ``most`` labelled documents that aren't held out."""
    sample = cut(labelled_sample(labels.where(~held_out(F.col("doc_id"))), "quality", most))
    rows, names = _with_features(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"))
    table_ = np.array([tuple(r) for r in rows.select("y", *names).toLocalIterator()], float).reshape(-1, len(names) + 1)
    return fit_logistic(table_[:, 1:], table_[:, 0])


def _odds(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(MARGIN)), F.lit(1 - MARGIN))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, mean: str) -> Column:
    """Documents that the level above counts for, by the method of moments (one row: ``__k``)."""
    p, m = F.col("good") / F.col("n"), F.col(mean)
    spread = F.sum(F.col("n") * (p - m) * (p - m)) / F.sum("n")
    noise = F.sum(m * (1 - m)) / F.sum("n")  # what chance alone would give
    between = F.greatest(spread - noise, F.lit(1e-6))
    within = F.sum(F.col("n") * m * (1 - m)) / F.sum("n")
    return F.greatest(F.lit(STRENGTH[0]), F.least(F.lit(STRENGTH[1]), within / between - 1)).alias("__k")


def shrunk(good: Column, n: Column, above: Column, strength: Column) -> Column:
    """Mean of ``n`` documents with the sum ``good``, drawn toward ``above`` as by ``strength`` documents more."""
    return (good + strength * above) / (n + strength)


def posteriors(scored: DataFrame) -> DataFrame:
    """``__host``, ``__path`` with ``host_quality``, ``path_quality`` and ``__all`` from rows with ``__p``.

    Beside them what they are made of: sums, numbers and strengths of host (``__hg``, ``__hn``, ``__hk``) and path
    (``__pg``, ``__pn``, ``__pk``).
    """
    paths = cut(scored.groupBy("__host", "__path").agg(F.sum("__p").alias("good"), F.count(F.lit(1)).alias("n")))
    whole = paths.agg((F.sum("good") / F.sum("n")).alias("__all"))  # one row, as those below
    hosts = paths.groupBy("__host").agg(F.sum("good").alias("good"), F.sum("n").alias("n")).join(F.broadcast(whole))
    hosts = hosts.join(F.broadcast(hosts.agg(_strength(hosts, "__all")))).select(
        "__host", "__all", F.col("good").alias("__hg"), F.col("n").alias("__hn"), F.col("__k").alias("__hk"),
        shrunk(F.col("good"), F.col("n"), F.col("__all"), F.col("__k")).alias("host_quality"),
    )
    paths = paths.join(hosts, "__host")
    paths = paths.join(F.broadcast(paths.agg(_strength(paths, "host_quality").alias("__pk"))))
    own = shrunk(F.col("good"), F.col("n"), F.col("host_quality"), F.col("__pk")).alias("path_quality")
    return cut(paths.select("__host", "__path", "host_quality", own, "__all", "__hg", "__hn", "__hk", F.col("good").alias("__pg"), F.col("n").alias("__pn"), "__pk"))


def judge(docs: DataFrame, labels: DataFrame, host: Column, path: Column, keep: list[str] | None = None, most: int = FIT_ROWS) -> DataFrame:
    """``docs`` (or their columns ``keep``) with ``evidence`` (log-odds), ``host_quality``,
    ``path_quality``, ``score`` (0 to 1) and ``kept`` (score of ``KEEP_FROM`` or more).

    All documents count in the sites' sums. Null hosts and paths form sites of their own; repeated rows
    score alike. Null and empty texts score by what an empty form shows; very long ones are read whole, in one
    task each. A score of just ``KEEP_FROM`` is kept. Without labels every document's evidence is that of an
    even chance. Input columns with the names of added ones are replaced, others pass through; an empty table
    gives no rows.
    """
    own = [c for c in without(docs, *ADDED).columns if keep is None or c in keep]
    sites = {"host_of": F.coalesce(host.cast("string"), F.lit("")), "path_of": F.coalesce(path.cast("string"), F.lit(""))}
    sites = {n + "_" * sum(c.startswith(n) for c in docs.columns): c for n, c in sites.items()}
    plain, back = guarded(without(docs.withColumns(sites), *ADDED))
    named = dict(zip(sites, ("__host", "__path")))
    weights = fit(plain, labels, most)
    rows, names = _with_features(plain)
    evidence = F.lit(float(weights[-1]))
    for n, w in zip(names, weights):
        evidence = evidence + F.lit(float(w)) * F.col(n)
    rows = rows.withColumn("evidence", evidence).withColumnsRenamed(named).drop(*names)
    if "text" not in own:
        rows = rows.withColumn("text", F.lit(None).cast("string"))
    rows = written(rows.withColumn("__p", 1 / (1 + F.exp(-F.col("evidence")))))
    joined = rows.join(hinted(posteriors(rows), MAX_BROADCAST), ["__host", "__path"])
    p = F.col("__p")  # each site without the document itself
    up = shrunk(F.col("__hg") - p, F.col("__hn") - 1, F.col("__all"), F.col("__hk"))
    others = shrunk(F.col("__pg") - p, F.col("__pn") - 1, up, F.col("__pk"))
    total = F.col("evidence") + _odds(others) - _odds(F.col("__all"))
    joined = joined.withColumn("score", 1 / (1 + F.exp(-total))).withColumn("kept", F.col("score") >= KEEP_FROM)
    return back(joined.withColumnsRenamed({v: k for k, v in named.items()}), *ADDED).select(*own, *ADDED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every document, by source and language below it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return judge(docs, table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"), keep=["doc_id"])
