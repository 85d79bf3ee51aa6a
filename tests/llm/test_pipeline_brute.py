"""The whole pipeline against a plain version, on the smallest table."""

import math

import numpy as np
import xxhash

import corpus_pipeline
from terrastrata.llm import mixing, rules

from .test_decontaminate import brute as contamination
from .test_rules import brute as counts
from .test_shards import check
from .test_simhash import brute_components, fingerprint


def signals(text):
    n, chars, symbols, dups, repeats = counts(text)
    upper = sum(c.isupper() for c in text)
    lines = sum(any(c not in " \t\n\x0b\x0c\r" for c in x) for x in text.split("\n"))
    return {"symbols_per_word": symbols / max(n, 1), "dup_line_share": dups / max(lines, 1), "repeat_share": repeats / max(n, 1), "upper_share": upper / max(chars, 1), "mean_word": chars / max(n, 1)}


def kept_by_rules(docs):
    usable = [signals(d["text"]) for d in docs if counts(d["text"])[0] >= rules.MIN_WORDS]
    assert len(usable) < rules.MIN_GROUP  # so that every group uses the sketch over all, which is exact here
    fence = {}
    for s, slack in rules.SLACK.items():
        v = sorted(u[s] for u in usable)
        low, high = (v[math.ceil(q * len(v)) - 1] for q in (0.25, 0.75))
        fence[s] = high + rules.REACH * (high - low) + slack
    out = []
    for d in docs:
        n, _, _, _, r = counts(d["text"])
        if n >= rules.MIN_WORDS and 100 * r <= rules.MAX_REPEAT_PERCENT * n and all(x <= fence[s] for s, x in signals(d["text"]).items()):
            out.append(d)
    return out


def topic(text, n):
    of = lambda chars: sum(text.count(c) for c in chars)
    if n == 0:
        return "empty"
    if 4 * of("#*$%&<>{}=;") > n:
        return "symbols"
    if 4 * of("|") > n:
        return "table"
    if 3 * sum("A" <= c <= "Z" for c in text) > len(text):
        return "capitals"
    return "note" if n < 100 else "article" if n < 1000 else "book"


def drawn(docs):
    cell = [(d["source"], d["lang"], topic(d["text"], len(d["text"].split()))) for d in docs]
    tokens = np.array([len(d["text"].split()) for d in docs], float)
    cells = sorted(set(cell))
    mass = np.array([sum(t for c, t in zip(cell, tokens) if c == x) for x in cells])
    def filled(have, weight, goal):
        """The factor f for which the sum of min(have, f * weight) is goal, by halving."""
        low, high = 0.0, 1e12
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if np.minimum(have, mid * weight).sum() < goal else (low, mid)
        return high

    goals = []
    for k, d in enumerate(mixing.DIMENSIONS):
        values = [v for v in sorted({c[k] for c in cells}) if mass[[c[k] == v for c in cells]].sum()]
        have = np.array([mass[[c[k] == v for c in cells]].sum() for v in values])
        want = mixing.BUDGET * mass.sum() * have ** mixing.TEMPER[d] / (have ** mixing.TEMPER[d]).sum()
        goals.append(dict(zip(values, np.minimum(have, filled(have, want, mixing.BUDGET * mass.sum()) * want))))
    weight = mass.copy()
    for _ in range(mixing.SWEEPS):
        worst = 0
        for k, goal in enumerate(goals):
            for v, t in goal.items():
                own = np.array([c[k] == v for c in cells]) & (mass > 0)
                worst = max(worst, abs(np.minimum(mass, weight)[own].sum() / t - 1))
                weight[own] *= filled(mass[own], weight[own], t)
        if worst <= mixing.TOLERANCE:
            break
    rate = {c: min(m, w) / m if m else 0.0 for c, m, w in zip(cells, mass, weight)}

    def draw(d):
        h = xxhash.xxh64((d["doc_id"]).to_bytes(8, "little"), seed=42).intdigest()
        h = xxhash.xxh64(d["text"].encode(), seed=h).intdigest()
        h = xxhash.xxh64(mixing.SEED.to_bytes(4, "little"), seed=h).intdigest()
        return (h >> 11) / float(1 << 53)

    return [d for d, c in zip(docs, cell) if draw(d) < rate[c]]


def test_run_matches_brute_force(spark, sf_dir):
    docs = sorted((r.asDict() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()), key=lambda d: d["doc_id"])
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    docs = kept_by_rules(docs)
    ids = [d["doc_id"] for d in docs]
    groups = brute_components(ids, [fingerprint(d["text"]) for d in docs])
    docs = [d for d, g in zip(docs, groups) if d["doc_id"] == g]
    docs = [d for d in docs if not contamination(d["text"], items)[3]]
    docs = drawn(docs)
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in out) == [d["doc_id"] for d in docs]
    assert {r["doc_id"]: r["text"] for r in out} == {d["doc_id"]: d["text"] for d in docs}
    check(out)
