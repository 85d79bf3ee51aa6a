import random
import re

import numpy as np
import xxhash

from terrastrata.llm import simhash

from .helpers import DOCS, rows, table


def fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", low) if x]
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hs = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, prints):
    n, root = len(ids), list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                root[find(i)] = find(j)
    groups = {}
    for i in range(n):
        groups.setdefault(find(i), []).append(ids[i])
    low = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return [low[find(i)] for i in range(n)]


def test_query_matches_brute_force(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = {r["doc_id"]: r for r in simhash.query(spark, sf_dir).collect()}
    ids = sorted(texts)
    prints = [fingerprint(texts[i]) for i in ids]
    assert [out[i]["fingerprint"] for i in ids] == [f"{p:016x}" for p in prints]
    assert [out[i]["component_id"] for i in ids] == brute_components(ids, prints)


def test_links_of_crowded_keys_match_brute_force(spark, monkeypatch):
    """Groups far over the limit for pairing, in which keys must be narrowed."""
    monkeypatch.setattr(simhash, "SMALL_GROUP", 4)
    rng = random.Random(5)
    base = rng.getrandbits(64)
    prints = {base}
    for _ in range(250):
        p = base
        for _ in range(rng.randint(1, 6)):
            p ^= 1 << rng.choice(range(20))
        prints.add(p)
    prints |= {rng.getrandbits(64) for _ in range(100)}
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    nodes = spark.createDataFrame([(p,) for p in signed], "fp long")
    got = {(r["a"], r["b"]) for r in simhash.links(nodes).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 2}
    assert got == want


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 3)]
    out = dict(simhash.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert out == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}


def test_edges(spark):
    out = simhash.near_duplicates(table(spark)).collect()
    assert len(out) == len(rows())
    empty = [r for r in out if r["fingerprint"] == "0" * 16]
    assert len(empty) == 4 and {r["component_id"] for r in empty} == {3}
    kept = simhash.keep_one(table(spark))
    assert kept.columns == table(spark).columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 6, 7, 8] and ids.count(None) == 1
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    assert simhash.keep_one(spark.createDataFrame([], DOCS)).count() == 0
