import zlib

import numpy as np
from pyspark.sql import functions as F

from terrastrata.llm import fitting, mixing, quality, toxicity

from .helpers import DOCS, rows, table, words

LABELS = "doc_id long, quality int, toxic int"


def test_logistic_regression():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 2))
    y = (rng.random(3000) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1] + 0.5)))).astype(float)
    assert np.allclose(fitting.fit_logistic(x, y), [2, -1, 0.5], atol=0.2)
    assert fitting.fit_logistic(np.zeros((0, 2)), np.zeros(0)).tolist()[:2] == [0, 0]


def test_rake_reaches_targets_like_numpy(spark):
    cells = [("a", "en", "x", 50), ("a", "de", "x", 10), ("b", "en", "y", 30), ("b", "de", "x", 5), ("c", "en", "x", 20), ("c", "de", "y", 15)]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    goals = {"source": {"a": 0.4, "b": 0.3, "c": 0.3}, "lang": {"en": 0.5, "de": 0.5}, "topic": {"x": 0.7, "y": 0.3}}
    targets = {d: spark.createDataFrame(list(g.items()), "value string, target double") for d, g in goals.items()}
    got = {(r["source"], r["lang"], r["topic"]): r["weight"] for r in mixing.rake(df, targets, tolerance=1e-9, sweeps=40).collect()}
    w = np.array([c[3] for c in cells], float)
    for _ in range(40):
        for k, d in enumerate(goals):
            for v, t in goals[d].items():
                m = np.array([c[k] == v for c in cells])
                w[m] *= t / w[m].sum()
    assert np.allclose([got[c[:3]] for c in cells], w, atol=1e-6)


def test_mix(spark, sf_dir):
    out = mixing.query(spark, sf_dir).toPandas()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas().set_index("doc_id")
    assert len(out) == len(docs) and out.probability.between(0, 1).all()
    assert (out.n_tokens.values == [len(docs.text[i].split()) for i in out.doc_id]).all()
    per = out.groupby(["source", "lang", "topic"]).probability.nunique()
    assert (per == 1).all()
    edges = mixing.mix(table(spark)).collect()
    assert len(edges) == len(rows()) and all(r["sampled"] in (True, False) for r in edges)
    assert not any(r["sampled"] for r in edges if not r["n_tokens"])
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0


def test_quality(spark, sf_dir):
    sf = sf_dir.replace("0.001", "0.01")
    out = quality.query(spark, sf).toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().set_index("doc_id").quality
    both = out.join(labels, how="inner")
    assert len(out) == 1000 and both[both.quality == 1].kept.mean() > 0.97 and both[both.quality == 0].kept.mean() < 0.4
    none = spark.createDataFrame([], LABELS)
    edges = quality.judge(table(spark), none, F.col("source"), F.col("lang")).collect()
    assert len(edges) == len(rows()) and all(0 <= r["score"] <= 1 for r in edges)
    labels = spark.createDataFrame([(1, 1, 0), (8, 0, 1), (None, 1, 1), (7, None, None)], LABELS)
    assert quality.judge(spark.createDataFrame([], DOCS), labels, F.col("source"), F.col("lang")).count() == 0
    assert quality.judge(table(spark), labels, F.col("source"), F.col("lang")).count() == len(rows())


def test_sparse_sites_shrink_toward_the_prior(spark):
    data = [("big", "p", 0.9)] * 400 + [("small", "p", 0.0)] + [("bad", "p", 0.1)] * 400
    out = {r["__host"]: r for r in quality.posteriors(spark.createDataFrame(data, "__host string, __path string, __p double")).collect()}
    assert out["bad"]["path_quality"] < 0.2 < out["small"]["path_quality"] < out["big"]["path_quality"]


def test_toxicity_held_out(spark, sf_dir):
    sf = sf_dir.replace("0.001", "0.1")
    out = toxicity.query(spark, sf).toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().set_index("doc_id").toxic
    both = out.join(labels, how="inner")
    assert ((both.index.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)) == both.held_out).all()
    test = both[both.held_out]
    hit = test.predicted == test.toxic
    assert hit.mean() > 0.98
    assert (test[test.toxic == 1].predicted == 1).mean() > 0.85 and (test[test.toxic == 0].predicted == 0).mean() > 0.99


def test_grammar():
    lexicon = toxicity.Lexicon({"blarg": 2.0})
    score = lambda t: sum(toxicity.clause_scores(t, lexicon))
    assert score("you are a blargish idiot") > score("an idiot walks") > score("he said idiot words") > 0
    assert score("never idiot") < score("the idiot") and score("a calm day. nothing here") == 0
    assert score("kill the lights") == 0 < score("kill you")


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (None, 1, 1), (3, None, None)], LABELS)
    for own in (labels, spark.createDataFrame([], LABELS)):
        out = toxicity.score(table(spark), own).collect()
        assert len(out) == len(rows()) and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.score(spark.createDataFrame([], DOCS), labels).count() == 0
    assert words(3)


def test_quality_on_held_out_labels(spark, sf_dir):
    sf = sf_dir.replace("0.001", "0.1")
    out = quality.query(spark, sf).toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().set_index("doc_id").quality
    both = out.join(labels, how="inner")
    test = both[both.index.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)]
    assert test[test.quality == 1].kept.mean() > 0.99 and test[test.quality == 0].kept.mean() < 0.1


def _sites():
    """Documents of good and bad sites that differ little in form: one symbol more is weak evidence."""
    rng, docs, labels = np.random.default_rng(11), [], []
    for i in range(2400):
        host, path = f"h{i % 6}", f"p{i % 12 // 6}"
        good = rng.random() < (0.95 if i % 6 < 3 else 0.12)
        marks = rng.binomial(40, 0.04 if good else 0.07)
        text = " ".join(w + "#" * (k < marks) for k, w in enumerate(words(40, int(rng.integers(1000))).split()))
        docs.append((i, text, host, path))
        labels.append((i, int(good), 0))
    return docs, labels


def test_sites_raise_held_out_accuracy_and_match_numpy(spark):
    docs, labels = _sites()
    df = spark.createDataFrame(docs, "doc_id long, text string, host string, path string")
    out = quality.judge(df, spark.createDataFrame(labels, LABELS), F.col("host"), F.col("path")).toPandas().set_index("doc_id").sort_index()
    good = np.array([g for _, g, _ in labels])
    test = np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i in range(len(docs))])
    alone = ((1 / (1 + np.exp(-out.evidence)) >= 0.5) == good)[test].mean()
    with_sites = ((out.score >= 0.5) == good)[test].mean()
    assert with_sites > alone + 0.02

    p, hosts, paths = 1 / (1 + np.exp(-out.evidence.to_numpy())), out.host.to_numpy(), (out.host + "/" + out.path).to_numpy()
    mean_all = p.mean()

    def strength(sums, counts, above):
        share, weight = sums / counts, counts / counts.sum()
        noise = (weight * above * (1 - above)).sum()
        between = max((weight * (share - above) ** 2).sum() - (above * (1 - above) * np.ones(len(counts))).sum() / counts.sum(), 1e-6)
        return min(max(noise / between - 1, quality.STRENGTH[0]), quality.STRENGTH[1])

    hs = {h: (p[hosts == h].sum(), (hosts == h).sum()) for h in set(hosts)}
    hk = strength(np.array([v[0] for v in hs.values()]), np.array([v[1] for v in hs.values()]), np.full(len(hs), mean_all))
    hq = {h: (s + hk * mean_all) / (n + hk) for h, (s, n) in hs.items()}
    ps = {x: (p[paths == x].sum(), (paths == x).sum()) for x in set(paths)}
    pk = strength(np.array([v[0] for v in ps.values()]), np.array([v[1] for v in ps.values()]), np.array([hq[x.split("/")[0]] for x in ps]))
    odds = lambda q: np.log(np.clip(q, quality.MARGIN, 1 - quality.MARGIN) / (1 - np.clip(q, quality.MARGIN, 1 - quality.MARGIN)))
    for i in range(0, len(docs), 37):
        (s, n), (t, m) = hs[hosts[i]], ps[paths[i]]
        up = (s - p[i] + hk * mean_all) / (n - 1 + hk)
        own = (t - p[i] + pk * up) / (m - 1 + pk)
        want = 1 / (1 + np.exp(-(out.evidence[i] + odds(own) - odds(mean_all))))
        assert abs(out.score[i] - want) < 1e-9 and abs(out.host_quality[i] - hq[hosts[i]]) < 1e-9


def test_quality_keeps_columns_of_the_input(spark):
    odd = table(spark).selectExpr("*", "1 AS __p", "2 AS __w", "3 AS host_of", "4 AS evidence")
    out = quality.judge(odd, spark.createDataFrame([], LABELS), F.col("source"), F.col("lang"))
    assert out.columns == [c for c in odd.columns if c != "evidence"] + list(quality.ADDED)
    assert {(r["__p"], r["__w"], r["host_of"]) for r in out.collect()} == {(1, 2, 3)}


def test_the_product_of_machines_is_each_of_them_run_alone():
    rng = np.random.default_rng(2)
    vocabulary = {c: toxicity.WORDS[c].split()[:3] for c in (toxicity.INSULT, toxicity.THREAT, toxicity.TARGET, toxicity.NEGATION, toxicity.REPORT)}
    vocabulary[toxicity.OTHER], vocabulary[toxicity.BORDER] = ["calm", "day", "walk"], [".", ";", "!"]
    lexicon = toxicity.Lexicon({"calm$": 0.7})
    for _ in range(400):
        tokens = [str(rng.choice(vocabulary[int(rng.integers(7))])) for _ in range(int(rng.integers(1, 25)))]
        want, clause = [], []
        for token in [*tokens, "."]:
            if token[0].isalpha():
                clause.append(token)
                continue
            states, score, matched = [0] * 5, 0.0, False
            for word in clause:
                symbol, weight = lexicon[word]
                factor = 1.0
                for k, machine in enumerate(toxicity.machines()):
                    states[k], f, bonus = machine.step(states[k], symbol)
                    factor *= f
                    score += bonus
                    matched = matched or bonus > 0
                score += weight * factor
                matched = matched or symbol == toxicity.INSULT
            if matched:
                want.append(score)
            clause = []
        got = list(toxicity.clause_scores(" ".join(tokens), lexicon))
        assert np.allclose(got, want) and len(got) == len(want)
