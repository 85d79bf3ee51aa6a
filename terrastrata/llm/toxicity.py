"""Toxicity by a weighted finite-state pattern grammar.

A lexical transducer turns each token into a class: insult, threat, target, negation, reported speech,
border of a clause, or other. Five small machines read the classes of a clause. Their product is one
machine with weights on its arcs, which scores the clause as a whole: an insult or threat counts for
more beside a target, and for less in the scope of a negation or of reported speech. A document's score is a
logistic function of its clauses' scores.

Insults are prefixes and whole words, learned in Spark from how many toxic and other labelled
documents hold them; general English ones are given. Only texts enter a score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .fitting import fit_logistic, held_out, labelled_sample
from .simhash import shingle_hashes

#: Labelled documents the lexicon and the calibration are fitted on, at most (about).
FIT_ROWS = 16_000
PREFIX = (3, 9)
SEED_WEIGHT = 1.5
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, BORDER = range(7)
#: Fixed words of each class, in English, German, French and Spanish.
WORDS = {
    INSULT: "idiot moron loser scum trash stupid pathetic worthless disgusting clown imbecile dumb filth vermin dummkopf abschaum trottel imbécile ordure idiota imbécil basura",
    THREAT: "kill hurt destroy beat murder strangle crush töten umbringen vernichten tuer détruire frapper matar destruir golpear",
    TARGET: "you your you're he she they them him her people du dich ihr sie tu te toi vous ils tú ti usted ustedes ellos",
    NEGATION: "not no never isn't aren't wasn't don't nicht kein keine nie ne pas jamais nunca ni",
    REPORT: "said says wrote claimed quoted called sagte schrieb behauptete dit écrit dijo escribió llamó",
}
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?;:\n]+")


class Machine:
    """A weighted transducer over token classes: ``step(state, symbol) -> (state, factor, bonus)``."""

    def __init__(self, states: int, arcs: dict[tuple[int, int], tuple[int, float, float]]) -> None:
        self.states, self.arcs = states, arcs

    def step(self, state: int, symbol: int) -> tuple[int, float, float]:
        return self.arcs.get((state, symbol), (state, 1.0, 0.0))


def machines() -> tuple[Machine, ...]:
    """Insult, threat, target, negation and reported speech."""
    insult = Machine(2, {(0, INSULT): (1, 1.0, 0.0), (1, INSULT): (1, 1.1, 0.0)})
    threat = Machine(2, {(0, THREAT): (1, 1.0, 0.0), (1, TARGET): (0, 1.0, 1.0)})
    target = Machine(2, {(0, TARGET): (1, 1.0, 0.0), (1, INSULT): (1, 1.25, 0.0), (1, THREAT): (1, 1.25, 0.0)})
    # A negation reaches over the next three tokens.
    negation = {(s, NEGATION): (3, 1.0, 0.0) for s in range(4)}
    for s in (1, 2, 3):
        negation |= {(s, x): (s - 1, 0.4 if x in (INSULT, THREAT) else 1.0, 0.0) for x in (OTHER, INSULT, THREAT, TARGET, REPORT)}
    report = Machine(2, {(0, REPORT): (1, 1.0, 0.0), (1, INSULT): (1, 0.5, 0.0), (1, THREAT): (1, 0.5, 0.0)})
    return insult, threat, target, Machine(4, negation), report


def composed() -> dict[tuple[tuple[int, ...], int], tuple[tuple[int, ...], float, float]]:
    """The product of the five: factors multiply, bonuses add."""
    parts, arcs = machines(), {}
    for state in product(*(range(m.states) for m in parts)):
        for symbol in range(BORDER):
            steps = [m.step(s, symbol) for m, s in zip(parts, state)]
            factor, bonus = math.prod(f for _, f, _ in steps), sum(b for _, _, b in steps)
            arcs[state, symbol] = (tuple(s for s, _, _ in steps), factor, bonus)
    return arcs


class Lexicon(dict):
    """Token -> (class, weight), found once per token by its longest weighted prefix."""

    def __init__(self, learned: dict[str, float]) -> None:
        super().__init__()
        self.learned, self.arcs = learned, composed()
        self.fixed = {w: c for c, words in WORDS.items() for w in words.split()}

    def __missing__(self, token: str) -> tuple[int, float]:
        fixed = self.fixed.get(token)
        weight = self.learned.get(f"{token}$")
        if weight is None and (fixed is None or fixed == INSULT):
            found = (self.learned.get(token[:k]) for k in range(min(len(token), PREFIX[1] - 1), PREFIX[0] - 1, -1))
            weight = next((w for w in found if w is not None), None)
        if weight is not None:
            out = INSULT, max(weight, SEED_WEIGHT) if fixed == INSULT else weight
        elif fixed is not None:
            out = fixed, SEED_WEIGHT if fixed == INSULT else 0.0
        else:
            out = (OTHER, 0.0) if token[0].isalpha() else (BORDER, 0.0)
        if len(self) < 500_000:  # a cache; what doesn't fit is looked up again
            self[token] = out
        return out


def clause_scores(text: str, lexicon: Lexicon) -> Iterator[float]:
    """Scores of the clauses of ``text`` that hold an insult or a threat."""
    return _scored(_TOKEN.findall(text.lower()), lexicon)


def _scored(tokens: list[str], lexicon: Lexicon) -> Iterator[float]:
    arcs, start = lexicon.arcs, (0,) * 5
    classes = [lexicon[t] for t in tokens]
    if not any(c in (INSULT, THREAT) for c, _ in classes):
        return
    state, score, matched = start, 0.0, False
    for symbol, weight in [*classes, (BORDER, 0.0)]:
        if symbol == BORDER:
            if matched:
                yield score
            state, score, matched = start, 0.0, False
            continue
        state, factor, bonus = arcs[state, symbol]
        score += weight * factor + bonus
        matched = matched or symbol == INSULT or bonus > 0


#: What a text's clauses say about it.
EVIDENCE = ("total", "top", "clauses", "density")


def evidence(text: str | None, lexicon: Lexicon) -> tuple[float, float, float, float]:
    """``EVIDENCE`` of a text: its clauses' sum, the strongest, their number, and the sum in a hundred tokens.

    In a long text a clause matches now and then by chance; the last one tells this from a short text with one.
    """
    tokens = _TOKEN.findall(text.lower()) if text else []
    scores = list(_scored(tokens, lexicon))
    total, top = max(sum(scores), 0.0), max(scores, default=0.0)
    return math.log1p(total), min(max(top, 0.0), 10.0) / 5, math.log1p(len(scores)), math.log1p(100 * total / max(len(tokens), 1))


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Weights of the prefixes and words (marked ``$``) that toxic texts of ``sample`` (``text``, ``y``) hold.

    Documents are counted per entry. An entry must be tied to toxic texts beyond what chance would give among as
    many candidates (likelihood ratio); of prefixes of one another the strongest stays, of equal ones the
    longest. Weights are smoothed log-odds.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col("text")), F.lit(r"\p{L}+"), F.lit(0)))
    long_enough = F.filter(words, lambda w: F.length(w) >= PREFIX[0])
    entries = F.transform(
        long_enough,
        lambda w: F.concat(
            F.array(F.concat(w, F.lit("$"))),
            F.transform(F.sequence(F.lit(PREFIX[0]), F.least(F.length(w), F.lit(PREFIX[1] - 1))), lambda k: F.substring(w, 1, k)),
        ),
    )
    each = sample.select("y", F.explode(F.array_distinct(F.flatten(entries))).alias("e"))
    counts = each.groupBy("e").agg(F.sum("y").alias("a"), F.count(F.lit(1)).alias("n")).where("a >= 3")
    counts = cut(counts)
    texts, toxic = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not toxic or toxic == texts:
        return {}
    tried = max(counts.count(), 2)
    rate = toxic / texts
    a, n = F.col("a").cast("double"), F.col("n").cast("double")
    b = n - a
    ratio = 2 * (a * F.log(a / (n * rate)) + F.when(b > 0, b * F.log(b / (n * (1 - rate)))).otherwise(0.0))
    weight = F.log((a + 0.5 * rate) / (b + 0.5 * (1 - rate)) * (1 - rate) / rate) / 2
    strong = counts.withColumns({"g": ratio, "weight": weight}).where((a / n > max(3 * rate, 0.5)) & (F.col("g") > 2 * math.log(tried)))
    stem_length = F.length(F.rtrim("e", F.lit("$")))
    # All that pass the test come to the driver; the sample's bound also bounds how many these can be.
    best = strong.orderBy(F.desc("g"), F.desc(stem_length), "e").collect()
    learned: dict[str, float] = {}
    inner: set[str] = set()  # all prefixes of what is kept
    for r in best:
        stem = r["e"].rstrip("$")
        if stem not in inner and not any(stem[:k] in learned for k in range(PREFIX[0], len(stem) + 1)):
            learned[r["e"]] = float(r["weight"])
            inner |= {stem[:k] for k in range(PREFIX[0], len(stem) + 1)}
    return learned


def fit(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> tuple[dict[str, float], np.ndarray]:
    """Lexicon and calibration from about ``most`` labelled documents that aren't held out."""
    chosen = cut(labelled_sample(labels.where(~held_out(F.col("doc_id"))), "toxic", most))
    found = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "y")
    # Copies would count as evidence again and again: of texts with the same least shingle hash one stays.
    least = F.array_min(shingle_hashes(F.col("text")))
    sample = found.groupBy(least.alias("m")).agg(F.min(F.struct("doc_id", "text", "y")).alias("r"))
    sample = cut(sample.select("r.*"))
    learned = learn_lexicon(sample)
    rows = sample.select("y", _features(learned)(F.col("text")).alias("f")).select("y", "f.*").toPandas().to_numpy(float)
    return learned, fit_logistic(rows[:, 1:], rows[:, 0], ridge=0.1)


def _features(learned: dict[str, float]):
    @F.pandas_udf(", ".join(f"{e} double" for e in EVIDENCE))
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(learned)
        for texts in batches:
            yield pd.DataFrame([evidence(t, lexicon) for t in texts], columns=list(EVIDENCE), dtype=float)

    return features


def score(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 from 0.5) of every row of ``docs``.

    Null and empty texts hold no clause and get the score of any text without one. Repeated rows score alike;
    null ids count as held out; without usable labels all scores are alike. Extra columns are ignored; an
    empty table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    learned, weights = fit(docs, labels, most)
    scored = docs.select("doc_id", _features(learned)(F.col("text")).alias("f"))
    linear = F.lit(float(weights[-1]))
    for name, w in zip(EVIDENCE, weights):
        linear = linear + F.lit(float(w)) * F.col(f"f.{name}")
    scored = scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), (1 / (1 + F.exp(-linear))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document."""
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
