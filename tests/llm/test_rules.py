import re
from collections import Counter

from terrastrata.llm import rules

from .helpers import DOCS, rows, table


def brute(text):
    text = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    wins = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if wins[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_counts_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    out = {r["doc_id"]: r for r in rules.measure(docs).collect()}
    for r in out.values():
        b = brute(r["text"])
        assert tuple(r[c] for c in rules.BASE) == b
        assert r["base_failed"] == (b[0] < 50 or 100 * b[4] > 50 * b[0])


def test_edges(spark):
    out = rules.judge(table(spark)).collect()
    assert len(out) == len(rows())
    for r in out:
        assert tuple(r[c] for c in rules.BASE) == brute(r["text"])
        assert r["kept"] is not None and not (r["kept"] and r["base_failed"])
        assert r["key"] in ("k", None)
    assert rules.judge(spark.createDataFrame([], DOCS)).count() == 0


def test_adaptive_thresholds_drop_outliers(spark):
    from .helpers import words

    plain = [(i, words(60 + i % 30, i * 13), "en", f"s{i % 3}", 1, 1, "", "") for i in range(300)]
    odd = [(1000 + i, words(60, i).replace(" ", "### "), "en", "s1", 1, 1, "", "") for i in range(5)]
    out = {r["doc_id"]: r["kept"] for r in rules.judge(table(spark, plain + odd)).collect()}
    assert all(out[i] for i in range(300)) and not any(out[1000 + i] for i in range(5))


def test_groups_judge_the_same_text_by_their_own_sketches(spark):
    from .helpers import words

    def marked(n, start, tenths):  # a symbol at so many of ten words
        return " ".join(w + "#" * (i % 10 < tenths) for i, w in enumerate(words(n, start).split()))

    plain = [(i, words(60 + i % 30, i * 13), "en", "plain", 1, 1, "", "") for i in range(600)]
    coded = [(1000 + i, marked(60 + i % 3 * 10, i * 13, i % 6), "en", "coded", 1, 1, "", "") for i in range(600)]
    same = marked(80, 7, 2)
    probes = [(5000, same, "en", "plain", 1, 1, "", ""), (5001, same, "en", "coded", 1, 1, "", "")]
    longer = [(6000 + i, words(60, i).replace(" ", "abcdefgh "), "en", "plain", 1, 1, "", "") for i in range(6)]
    out = {r["doc_id"]: r["kept"] for r in rules.judge(table(spark, plain + coded + probes + longer)).collect()}
    assert not out[5000] and out[5001]
    assert all(out[d[0]] for d in plain + coded) and not any(out[d[0]] for d in longer)


def test_labels_at_a_hundredth(spark, sf_dir):
    sf = sf_dir.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("quality IS NOT NULL").select("doc_id", "quality")
    docs = spark.read.parquet(f"{sf}/documents.parquet").join(labels, "doc_id")
    out = [r for r in rules.judge(docs).collect() if not r["base_failed"]]
    assert all(r["kept"] == bool(r["quality"]) for r in out)
