"""Benchmark decontamination with DataFrame operations only.

Every window of thirteen normalised words of an item (all words of a shorter item) is hashed over some of
its words, and the set of these hashes is broadcast, in blocks if a count shows it too large. Training texts
are split into words once and scanned window by window against the set; what passes is joined with the
items' windows and all its words are compared. Only what passes is shuffled. The words covered by hits
decide about a text; its hit spans can be removed instead.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, cut, guarded, let, table, without, written

WINDOW = 13
#: Hashes (a long each) up to which the set is broadcast in one block.
BROADCAST_HASHES = 4_000_000
#: Bytes, by the sum of their words, spans and items, up to which windows and texts with hits are broadcast.
BROADCAST_BYTES = 64 << 20
#: Words of a window that its hash covers: enough to let little pass that no item holds.
HASHED = (0, 4, 8, 12)
#: A text is contaminated if hit words are one in SHARE or more.
SHARE = 20
#: ``[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``, character by character, which Java looks up in one table.
GAP = "[" + "".join(f"\\x{c:02X}" for r in (range(0x00, 0x30), range(0x3A, 0x61), range(0x7B, 0x80)) for c in r) + "]+"
ADDED = ("n_words", "n_hit", "n_items", "items", "contaminated")


def _pieces(text: Column) -> Column:
    """Runs of letters a-z (A-Z lower-cased), digits and all characters beyond ASCII; the first and last piece may be empty."""
    return F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP)


def _before(pieces: Column) -> Column:
    """1 if the first piece is empty, else 0."""
    return (F.get(pieces, F.lit(0)) == "").cast("int")


def _count(pieces: Column) -> Column:
    """How many pieces are words."""
    return F.greatest(F.size(pieces) - _before(pieces) - (F.get(pieces, F.size(pieces) - 1) == "").cast("int"), F.lit(0))


def normal_words(text: Column) -> Column:
    """The words of ``text``: its pieces but for empty ones."""
    return let(_pieces(text), lambda p: F.slice(p, 1 + _before(p), _count(p)))


def _key(words: Column, start: Column, length: int, window: int) -> Column:
    """Hash of the window of ``length`` words at ``start``: over some of the words, and the length."""
    spread = HASHED if length == window == WINDOW else range(length)
    return F.xxhash64(F.lit(length), *(F.get(words, start + k) for k in spread))


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``window`` (words), ``len``, ``h`` (their hash) and ``items`` (ids, as strings, of all that hold it)."""
    w = items.select(F.col("item_id").cast("string").alias("item"), normal_words(F.col("text")).alias("w"))
    w = w.where((F.size("w") > 0) & F.col("item").isNotNull())
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0))))
    each = w.select("item", "w", starts.alias("i")).select("item", F.slice("w", F.col("i") + 1, window).alias("window"))
    each = each.groupBy("window").agg(F.collect_set("item").alias("items")).withColumn("len", F.size("window"))
    own = reduce(lambda c, n: c.when(F.col("len") == n, _key(F.col("window"), F.lit(0), n, window)), range(1, window + 1), F)
    return each.withColumn("h", own)


def _bytes(strings: Column) -> Column:
    return F.aggregate(strings, F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x) + 16)


def _small(df: DataFrame, size: Column) -> DataFrame:
    """``df`` (cut) marked for broadcast if the sum of ``size`` shows it small enough; else Spark shuffles."""
    total = df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def _scan(texts: DataFrame, windows: DataFrame, window: int, counts: bool = False) -> DataFrame:
    """``h``, ``len``, ``window``, ``at`` and ``n_words`` of each window of ``texts`` whose hash items have, beside
    their columns but ``text``. With ``counts`` also a row per text, whose ``at`` and ``window`` are null.

    One pass for all lengths (one for each block of hashes, if there are more than one holds): a text gives a
    row for each place, and a place one for each length that items have, while they stay in one task.
    """
    shape = windows.groupBy("len").agg(F.count(F.lit(1)).alias("n")).collect()  # at most ``window`` rows
    lengths = sorted(r["len"] for r in shape) or [window]
    blocks = max(1, -(-sum(r["n"] for r in shape) // BROADCAST_HASHES))
    own = [c for c in texts.columns if c != "text"]
    pieces = texts.select(*own, _pieces(F.col("text")).alias("p"))
    found = []
    for b in range(blocks):
        hashes = windows.where(F.pmod("h", F.lit(blocks)) == b).select("h").distinct()
        whole = counts and b == 0  # place -1 stands for the text
        last = F.size("p") - lengths[0]
        places = F.sequence(F.lit(-1), F.greatest(last, F.lit(-1))) if whole else F.when(last >= 0, F.sequence(F.lit(0), last))
        rows = pieces.select(*own, "p", F.explode(places).alias("at"))
        if len(lengths) == 1:
            rows = rows.withColumns({"len": F.lit(lengths[0]), "h": _key(F.col("p"), F.col("at"), lengths[0], window)})
        else:
            several = F.array(*map(F.lit, lengths))
            rows = rows.select(*own, "p", "at", F.explode(F.when(F.col("at") < 0, F.slice(several, 1, 1)).otherwise(several)).alias("len"))
            rows = rows.withColumn("h", reduce(lambda c, n: c.when(F.col("len") == n, _key(F.col("p"), F.col("at"), n, window)), lengths, F))
        if whole:
            marked = rows.join(F.broadcast(hashes.withColumn("__in", F.lit(True))), "h", "left")
            found.append(marked.where(F.col("__in") | (F.col("at") < 0)).drop("__in"))
        else:
            found.append(rows.join(F.broadcast(hashes), "h", "left_semi"))
    words = F.when(F.col("at") >= 0, F.slice("p", F.greatest("at", F.lit(0)) + 1, F.col("len")))
    at = F.when(F.col("at") >= 0, F.col("at") - _before(F.col("p")))
    rows = reduce(DataFrame.unionByName, found)
    return rows.select(*own, "h", "len", words.alias("window"), at.alias("at"), _count(F.col("p")).cast("long").alias("n_words"))


def _verified(passed: DataFrame, windows: DataFrame) -> DataFrame:
    """What of ``passed`` items hold, word for word, with their ``items``."""
    found = passed.join(_small(windows, _bytes(F.col("window")) + _bytes(F.col("items"))), ["h", "len", "window"])
    return found.select("key", "n_words", "at", "len", "items")


def _covered(spans: Column) -> Column:
    """How many words the spans ``(at, len)``, sorted, cover: each counts from where those before it end."""

    def add(done: Column, s: Column) -> Column:
        end = s["at"] + s["len"]
        new = F.greatest(end - F.greatest(s["at"], done["end"]), F.lit(0))
        return F.struct((done["n"] + new).alias("n"), F.greatest(done["end"], end).alias("end"))

    return F.aggregate(spans, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), add, lambda d: d["n"].cast("long"))


def _key_of(id_col: str) -> Column:
    """Equal id and text give equal results, so these two are the key: ids may repeat or be null."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), F.crc32(text.cast("binary")).alias("c"))


def _per_text(hits: DataFrame) -> DataFrame:
    per_text = hits.groupBy("key").agg(
        F.first("n_words").alias("__n_words"), F.sort_array(F.collect_set(F.struct("at", "len"))).alias("__spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("__items"),
    )
    out = per_text.withColumnRenamed("key", "__hit").withColumn("__n_hit", _covered(F.col("__spans")))
    return cut(out.withColumn("__bad", SHARE * F.col("__n_hit") >= F.col("__n_words")))


def found(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """Of each text with hits its key (``__hit``), ``__n_words``, ``__spans`` hit (sorted), ``__n_hit``, ``__items`` and ``__bad``."""
    windows = cut(item_windows(items, window))
    passed = _scan(docs.select(_key_of(id_col).alias("key"), "text"), windows, window)
    return _per_text(_verified(passed, windows))


def _same() -> Column:
    return (F.col("__key.h") == F.col("__hit.h")) & (F.col("__key.c") == F.col("__hit.c")) & F.col("__key.id").eqNullSafe(F.col("__hit.id"))


def _joined(keyed: DataFrame, hits: DataFrame, *needed: str) -> DataFrame:
    size = F.lit(64) + 8 * F.size("__spans") + _bytes(F.col("__items"))
    return keyed.join(_small(hits, size).select("__hit", *needed), _same(), "left").drop("__key", "__hit")


def inspect(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", window: int = WINDOW, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or their columns ``keep``) with ``n_words``, ``n_hit`` (words inside occurrences),
    ``n_items``, ``items`` (ids found, sorted as strings) and ``contaminated`` (one word in ``SHARE`` or
    more is hit).

    Null and empty texts have no words and are clean, as is everything if ``items`` is empty; items
    without words or id are ignored. Very long texts are read whole, in one task each. Repeated rows get the
    same result each; input columns with the names of added ones are replaced, others pass through.
    """
    docs = without(docs, *ADDED)
    own = [c for c in docs.columns if keep is None or c in keep]
    docs, back = guarded(docs.select(*dict.fromkeys((*own, id_col, "text"))), "key", "p", "at", "len", "h", "window")
    if "text" in own:
        counted = docs.withColumns({"n_words": let(_pieces(F.col("text")), _count).cast("long"), "__key": _key_of(id_col)})
        hits = found(docs, items, id_col, window)
    else:  # what is carried along is small, so that one pass, written, gives the hits and the counts
        windows = cut(item_windows(items, window))
        passed = written(_scan(docs.withColumn("key", _key_of(id_col)), windows, window, counts=True))
        counted = passed.where("at IS NULL").drop("at", "len", "h", "window").withColumnRenamed("key", "__key")
        hits = _per_text(_verified(passed.where("at IS NOT NULL"), windows))
    out = _joined(counted, hits, "__n_hit", "__items", "__bad")
    out = out.withColumns(
        {
            "n_hit": F.coalesce("__n_hit", F.lit(0).cast("long")), "items": F.coalesce("__items", F.array().cast("array<string>")),
            "contaminated": F.coalesce("__bad", F.lit(False)),
        }
    )
    added = out.withColumn("n_items", F.size("items").cast("long"))
    return back(added if "text" in own else added.withColumn("text", F.lit(None).cast("string")), *ADDED).select(*own, *ADDED)


def drop_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with their columns as they were.

    Only keys of contaminated texts are joined: clean texts need no counts.
    """
    keyed, back = guarded(docs)
    bad = found(keyed, items, id_col).where("__bad").select("__hit")
    return back(keyed.withColumn("__key", _key_of(id_col)).join(_small(cut(bad), F.lit(64)), _same(), "left_anti"))


def remove_spans(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """``docs`` with the hit words cut out of ``text``; the rest, and what separates words, stays.

    A text without hits, null included, stays as it is, as do all other columns. Time is linear in the
    text's length, however many hits it holds.
    """
    keyed, back = guarded(docs)
    out = _joined(keyed.withColumn("__key", _key_of(id_col)), found(keyed, items, id_col, window), "__spans", "__items")
    gaps = F.split(F.col("text"), r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", -1)
    words = F.filter(F.split(F.col("text"), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda w: w != "")
    places = F.array_sort(F.array_distinct(F.flatten(F.transform("__spans", lambda s: F.sequence(s["at"], s["at"] + s["len"] - 1)))))
    starts = lambda p: F.filter(p, lambda x, i: (i == 0) | (F.get(p, i - 1) != x - 1))
    ends = lambda p: F.filter(p, lambda x, i: (i == F.size(p) - 1) | (F.get(p, i + 1) != x + 1))

    def flags(s: Column, e: Column) -> Column:
        runs = F.transform(s, lambda a, i: F.concat(F.array_repeat(F.lit(False), a - F.coalesce(F.get(e, i - 1) + 1, F.lit(0))), F.array_repeat(F.lit(True), F.get(e, i) - a + 1)))
        return F.flatten(runs)

    def rebuilt(w: Column, g: Column, hit: Column) -> Column:
        word = lambda i: F.when(F.coalesce(F.get(hit, i), F.lit(False)), "").otherwise(F.coalesce(F.get(w, i), F.lit("")))
        return F.array_join(F.transform(g, lambda gap, i: F.concat(gap, word(i))), "")

    hit = let(places, lambda p: let(starts(p), lambda s: let(ends(p), lambda e: flags(s, e))))
    clean = let(words, lambda w: let(gaps, lambda g: let(hit, lambda h: rebuilt(w, g, h))))
    return back(out.withColumn("text", F.when(F.size(F.coalesce("__spans", F.array())) > 0, clean).otherwise(F.col("text"))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inspect every document against the whole benchmark."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = inspect(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"), keep=["doc_id"])
    return out.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item, list_slice(w, i + 1, i + 13) AS win
  FROM (SELECT item, w, unnest(range(0, greatest(len(w) - 13, 0) + 1)) AS i FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT len(win) AS n FROM bw
), dw AS (
  SELECT doc_id, n, i, list_slice(w, i + 1, i + n) AS win
  FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, lens WHERE len(w) >= n)
), hits AS (SELECT doc_id, n, i, item FROM dw JOIN bw USING (win)
), cover AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), per AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN per USING (doc_id)
"""
