"""Chat formatting with Spark expressions only.

A conversation's rows are collected as turn structs, sorted, and adjacent turns of one role are
merged into a block. A block is written as::

    <|turn|>ROLE<|body|>TEXT[<|next|>TEXT ...]<|end|>\\n

``<|next|>`` keeps the borders of merged turns, so the output can be parsed back into the very rows it
came from. Control strings inside roles and texts are escaped reversibly (``escape``/``unescape``).
The loss covers each assistant text, without markers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table

TURN, BODY, NEXT, END = "<|turn|>", "<|body|>", "<|next|>", "<|end|>"
#: What chat templates may read as control: any run without blanks in angle brackets (ours, <s>, <bos>, <start_of_turn>,
#: <|im-end|>, <<SYS>>), and upper-case names in square ones ([INST], [/INST], [SYSTEM_PROMPT]).
_ANGLE, _SQUARE, _ESCAPED = r"<(?=[^<>\s]{1,64}>)", r"\[(?=/?[A-Z][A-Z0-9_]*\])", r"(?=(?:amp|lt|lsqb);)"


def escape(text: Column) -> Column:
    """Make every control string in ``text`` plain, and mark what already looks escaped."""
    text = F.regexp_replace(text, f"&{_ESCAPED}", "&amp;")
    return F.regexp_replace(F.regexp_replace(text, _ANGLE, "&lt;"), _SQUARE, "&lsqb;")


def unescape(text: Column) -> Column:
    """Undo ``escape``."""
    text = F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&lsqb;"), F.lit("["))
    return F.regexp_replace(text, f"&amp;{_ESCAPED}", "&")


def _blocks(turns: Column) -> Column:
    """Runs of one role in sorted turns, in time linear in their number."""

    def runs(t: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(t) - 1),
            lambda i: (i == 0) | (F.get(t, i)["role"] != F.get(t, i - 1)["role"]),
        )
        return let(
            starts,
            lambda s: F.transform(
                s,
                lambda at, k: F.struct(
                    F.get(t, at)["role"].alias("role"),
                    F.transform(
                        F.slice(t, at + 1, F.coalesce(F.get(s, k + 1), F.size(t)) - at), lambda x: x["text"]
                    ).alias("texts"),
                ),
            ),
        )

    return let(turns, runs)


def _segments(blocks: Column) -> Column:
    """The output in pieces, each with its loss flag."""

    def piece(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def of(b: Column) -> Column:
        own = b["role"] == "assistant"
        inner = F.transform(
            b["texts"],
            lambda x, i: F.when(i == 0, F.array(piece(x, own))).otherwise(
                F.array(piece(F.lit(NEXT), F.lit(False)), piece(x, own))
            ),
        )
        return F.concat(
            F.array(piece(F.concat(F.lit(TURN), b["role"], F.lit(BODY)), F.lit(False))),
            F.flatten(inner),
            F.array(piece(F.lit(END + "\n"), F.lit(False))),
        )

    return F.flatten(F.transform(blocks, of))


def format_chats(rows: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted`` and ``segments`` (pieces of ``formatted``
    in order, with ``loss``).

    Rows are ordered by turn, then role, then text (nulls first), which also settles ties and repeated
    rows: each input row stays one turn. Null texts and roles are empty; rows whose ``conv_id`` is null
    form one conversation. Extra columns are ignored; an empty table gives no rows. Escaping runs before
    the shuffle, so that even a conversation with a large share of all rows only has its finished
    texts joined in one place: its output is one string. Very long texts are handled whole.
    """
    raw = {c: F.coalesce(F.col(c), F.lit("")) for c in ("role", "text")}
    # Sorted as they stand; the escaped form goes along only where it differs.
    changed = [F.nullif(escape(x), x).alias(f"escaped_{c}") for c, x in raw.items()]
    turn = F.struct(F.col("turn").alias("turn"), *(x.alias(c) for c, x in raw.items()), *changed)
    sorted_turns = F.transform(
        F.sort_array(F.collect_list("turn")),
        lambda t: F.struct(*(F.coalesce(t[f"escaped_{c}"], t[c]).alias(c) for c in raw)),
    )
    merged = rows.select("conv_id", turn.alias("turn")).groupBy("conv_id").agg(sorted_turns.alias("turns"))
    segments = merged.select("conv_id", _segments(_blocks(F.col("turns"))).alias("segments"))
    return segments.select(
        "conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments"
    )


def parse_chat(formatted: Column) -> Column:
    """Read the turns (role, text) back from formatted text; a merged block gives each of its turns."""
    blocks = F.slice(F.split(formatted, r"<\|turn\|>", -1), 2, 2_000_000_000)

    def turns(block: Column) -> Column:
        role = unescape(F.substring_index(block, BODY, 1))
        body = F.substring_index(F.substring_index(block, BODY, -1), END, 1)
        return F.transform(
            F.split(body, r"<\|next\|>", -1), lambda x: F.struct(role.alias("role"), unescape(x).alias("text"))
        )

    return F.flatten(F.transform(blocks, turns))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format every conversation and digest what is read back from the output."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    each = F.array(*(F.struct(F.lit(-7).alias("conv_id"), F.lit(i).alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text")) for i, r in enumerate(("user", "assistant"))))
    probe = spark.range(1).select(F.inline(each)).select(*(F.col(f.name).cast(f.dataType) for f in rows.schema))
    out = format_chats(rows.unionByName(probe))
    read = out.select(
        "conv_id",
        parse_chat(F.col("formatted")).alias("turns"),
        loss_text(F.col("segments")).alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


#: Markers take 24 characters a block besides the role, 8 between merged turns.
ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
    regexp_replace(regexp_replace(regexp_replace(text, '&(amp|lt|lsqb);', '&amp;\1;', 'g'),
      '<([^<>\s]{1,64}>)', '&lt;\1', 'g'), '\[(/?[A-Z][A-Z0-9_]*\])', '&lsqb;\1', 'g') AS escaped
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(escaped) + CASE WHEN before IS NULL OR before <> role THEN 24 + length(role) ELSE 8 END)
    AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""
