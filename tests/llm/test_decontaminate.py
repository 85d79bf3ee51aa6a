import re

from terrastrata.llm import decontaminate as D

from .helpers import DOCS, rows, table, words

GAP = re.compile(D.GAP)


def normal(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in GAP.split(low) if w]


def brute(text, items):
    w, hit, seen = normal(text), set(), set()
    for item, body in items:
        b = normal(body)
        n = min(13, len(b))
        wins = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
        for i in range(len(w) - n + 1) if n else ():
            if tuple(w[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                seen.add(str(item))
    return len(w), len(hit), sorted(seen), len(hit) > 0 and 20 * len(hit) >= len(w)


ITEMS = [(1, words(30, 3)), (10, words(13, 50)), (2, "Only Three words"), (3, ""), (4, None), (5, "!!"), (6, words(20, 3))]


def items(spark, data=ITEMS):
    return spark.createDataFrame(data, "item_id long, text string")


def test_matches_brute_force(spark, monkeypatch):
    data = [
        (1, words(25, 1), "", "", 0, 0, "", ""), (2, "x " * 400 + words(13, 50).upper().replace(" ", ", "), "", "", 0, 0, "", ""),
        (3, "only three-words here; ONLY  three words", "", "", 0, 0, "", ""), (4, words(12, 50), "", "", 0, 0, "", ""), *rows(),
    ]
    for hashes, size in ((4_000_000, 1 << 26), (5, 0)):  # one set and broadcasts; sets in blocks and joins by shuffle
        monkeypatch.setattr(D, "BROADCAST_HASHES", hashes)
        monkeypatch.setattr(D, "BROADCAST_BYTES", size)
        out = D.inspect(table(spark, data), items(spark)).collect()
        assert len(out) == len(data)
        for r in out:
            assert (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) == brute(r["text"], ITEMS)
        slim = D.inspect(table(spark, data), items(spark), keep=["doc_id", "n_chars"])
        assert slim.columns == ["doc_id", "n_chars", *D.ADDED]
        got = [(r["doc_id"], r["n_chars"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in slim.collect()]
        assert sorted(got, key=str) == sorted(((r[0], r[4], *brute(r[1], ITEMS)) for r in data), key=str)


def test_items_of_every_length_in_one_scan(spark, tmp_path):
    bodies = [(n, words(n, 31 * n)) for n in range(1, 15)]
    data = [(n, f"{words(40, 3)} {body.upper()}! {words(5, 9)}", "", "", 0, 0, "", "") for n, body in bodies]
    table(spark, data).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    windows = D.cut(D.item_windows(items(spark, bodies)))
    scan = D._scan(docs.select("doc_id", "text"), windows, D.WINDOW, counts=True)
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    for r in D.inspect(docs, items(spark, bodies)).collect():
        assert (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) == brute(r["text"], bodies)


def test_a_long_text_full_of_hits(spark):
    body = " ".join([words(30, 3)] * 3000)
    data = [(1, body, "", "", 0, 0, "", ""), (2, f"before {body} after", "", "", 0, 0, "", "")]
    for r in D.inspect(table(spark, data), items(spark)).collect():
        assert r["n_hit"] == 90_000
    cut = {r["doc_id"]: r["text"] for r in D.remove_spans(table(spark, data), items(spark)).collect()}
    assert cut[1].strip() == "" and cut[2].split() == ["before", "after"]


def test_columns_with_clashing_names_stay(spark):
    docs = table(spark, [(1, words(30, 3), "", "", 0, 0, "", ""), (2, "clean", "", "", 0, 0, "", "")])
    odd = docs.selectExpr("*", "'i' AS items", "1 AS n_words", "2 AS __key", "3 AS p", "4 AS h", "5 AS at", "6 AS window")
    kept = D.drop_documents(odd, items(spark)).collect()
    assert [r["doc_id"] for r in kept] == [2] and kept[0].asDict()["items"] == "i" and kept[0]["__key"] == 2
    cut = D.remove_spans(odd, items(spark))
    assert cut.columns == odd.columns and {(r["items"], r["n_words"], r["__key"], r["h"]) for r in cut.collect()} == {("i", 1, 2, 4)}
    seen = D.inspect(odd, items(spark), keep=["doc_id", "p", "__key", "at"]).collect()
    assert {(r["p"], r["__key"], r["at"]) for r in seen} == {(3, 2, 5)} and {r["n_words"] for r in seen} == {30, 1}


def test_removal(spark):
    data = [(1, "A b; " + words(13, 50).title() + " -- end.", "", "", 0, 0, "", ""), (2, None, "", "", 0, 0, "", ""), (3, "clean text", "", "", 0, 0, "", "")]
    kept = D.drop_documents(table(spark, data), items(spark))
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3] and kept.columns == table(spark).columns
    cut = {r["doc_id"]: r["text"] for r in D.remove_spans(table(spark, data), items(spark)).collect()}
    assert cut[2] is None and cut[3] == "clean text" and cut[1].startswith("A b; ") and cut[1].endswith(" -- end.")
    assert brute(cut[1], ITEMS)[1] == 0


def test_empty_tables(spark):
    assert D.inspect(spark.createDataFrame([], DOCS), items(spark)).count() == 0
    out = D.inspect(table(spark), items(spark, [])).collect()
    assert len(out) == len(rows()) and not any(r["contaminated"] or r["n_hit"] for r in out)
