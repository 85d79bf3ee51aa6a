import numpy as np
from pyspark.sql import functions as F

from terrastrata.llm import mixing


def test_expected_tokens_meet_the_targets(spark):
    """With a hot source and cells that are too small for their share."""
    rng = np.random.default_rng(3)
    data = [(f"s{i}", f"l{j}", f"t{k}", int(rng.integers(50, 150) * (60 if i == 0 else 1) * (8 if j == 0 else 1) * (1, 6, 12)[k])) for i in range(6) for j in range(3) for k in range(3)]
    data.append(("s1", "l1", "empty", 0))
    values = spark.createDataFrame(data, "__source string, __lang string, __topic string, n_tokens long")
    rate = {tuple(r[d] for d in mixing.DIMENSIONS): r["probability"] for r in mixing.rates(values).collect()}
    assert len(rate) == len(data) and all(0 <= p <= 1 for p in rate.values()) and max(rate.values()) == 1
    expected = {r[:3]: rate[r[:3]] * r[3] for r in data}
    goal = mixing.BUDGET * sum(r[3] for r in data)
    assert abs(sum(expected.values()) / goal - 1) < 2e-3
    cells = values.select(*(F.col(f"__{d}").alias(d) for d in mixing.DIMENSIONS), F.col("n_tokens").alias("tokens"))
    for k, d in enumerate(mixing.DIMENSIONS):
        have = {v: sum(r[3] for r in data if r[k] == v) for v in {r[k] for r in data}}
        for r in mixing.reachable(cells, d, mixing.TEMPER[d]).collect():
            got = sum(e for c, e in expected.items() if c[k] == r["value"])
            assert abs(got / r["target"] - 1) < 2e-3
            assert r["target"] >= r["wanted"] * (1 - 1e-9) or abs(r["target"] - have[r["value"]]) < 1e-6


def test_given_weights_and_topics_are_met_like_in_numpy(spark):
    """The whole query: shares of expected tokens against plain raking with bounds, and the draws themselves."""
    rng = np.random.default_rng(5)
    data = []
    for i in range(3000):
        source, lang, kind = (str(rng.choice(x, p=p)) for x, p in ((("web", "books", "code"), (0.7, 0.2, 0.1)), (("en", "de"), (0.8, 0.2)), (("law", "art"), (0.5, 0.5))))
        data.append((i, "w " * int(rng.integers(20, 200)), source, lang, kind, "mine"))
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, lang string, kind string, topic string")
    goals = {"source": {"web": 1, "books": 2, "code": 1}, "lang": {"en": 6, "de": 4}, "topic": {"law": 3, "art": 7}}
    out = mixing.mix(docs, budget=0.3, targets=goals, topic=F.col("kind")).toPandas()
    assert set(out.topic) == {"law", "art"} and len(out) == 3000
    whole = 0.3 * out.n_tokens.sum()
    cells = out.groupby(["source", "lang", "topic"]).agg(tokens=("n_tokens", "sum"), p=("probability", "first")).reset_index()
    weight, have = cells.tokens.to_numpy(float), cells.tokens.to_numpy(float)
    for _ in range(400):  # raking with bounds: scale each marginal by the factor that meets it with no cell beyond its own
        for d, goal in goals.items():
            for v, w in goal.items():
                own, want = (cells[d] == v).to_numpy(), whole * w / sum(goal.values())
                low, high = 0.0, 1e6
                for _ in range(60):
                    mid = (low + high) / 2
                    low, high = (mid, high) if np.minimum(have[own], mid * weight[own]).sum() < want else (low, mid)
                weight[own] *= high
    assert np.allclose(cells.p, np.minimum(have, weight) / have, atol=2e-3)
    for d, goal in goals.items():
        for v, w in goal.items():
            got = (cells.tokens * cells.p)[cells[d] == v].sum() / whole
            assert abs(got / (w / sum(goal.values())) - 1) < 1e-3
    drawn = out[out.sampled]
    assert abs(drawn.n_tokens.sum() / whole - 1) < 0.1 and (drawn.probability > 0).all()


def test_values_without_a_weight_are_not_drawn(spark):
    docs = spark.createDataFrame([(i, "a b c " * 20, ("x", "y", "z")[i % 3], "en") for i in range(90)], "doc_id long, text string, source string, lang string")
    out = mixing.mix(docs, targets={"source": {"x": 1, "y": 1, "absent": 5}}).toPandas()
    assert (out.probability[out.source == "z"] == 0).all() and (out.probability[out.source != "z"] > 0.7).all()


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(i, "a b c " * 20, "s", "en") for i in range(40)], "doc_id long, text string, source string, lang string")
    odd = docs.selectExpr("*", "'mine' AS topic", "-5 AS n_tokens", "7 AS __draw", "8 AS given_topic", "'p' AS __source")
    drawn = mixing.draw(odd).collect()
    assert 0 < len(drawn) < 40 and {(r["topic"], r["n_tokens"], r["__draw"], r["given_topic"], r["__source"]) for r in drawn} == {("mine", -5, 7, 8, "p")}
    mixed = mixing.mix(odd, topic=F.col("topic")).collect()
    assert {(r["topic"], r["n_tokens"], r["__draw"], r["__source"]) for r in mixed} == {("mine", 60, 7, "p")}
