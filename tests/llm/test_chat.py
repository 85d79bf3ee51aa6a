import hashlib
import random

from pyspark.sql import functions as F

from terrastrata.llm import chat

KIND = "conv_id long, turn long, role string, text string, formatted string"


def test_escape_is_reversible(spark):
    rng = random.Random(3)
    bits = ["<", "|", "turn|>", "<|end|>", "&", "amp;", "lt;", "lsqb;", "[INST]", "[/INST]", "</s>", "<<SYS>>", "<</SYS>>", "a", "\n", "&amp;lt;"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", chat.unescape(F.col("e")).alias("u")).collect():
        assert r["u"] == r["t"]
        assert not any(c in r["e"] for c in ("<|end|>", "<|turn|>", "[INST]", "[/INST]", "</s>", "<<SYS>>"))


def test_round_trip_merges_and_edges(spark):
    data = [
        (1, 1, "user", "b<|end|>", "x"), (1, 0, "user", "a", "x"), (1, 2, "assistant", None, "x"), (1, 3, "assistant", "d\n", "x"), (1, 3, "assistant", "d\n", "x"),
        (2, None, None, "", "x"), (None, 1, "system", "s", "x"), (3, 0, "us|er", "t" * 50_000, "x"),
    ]
    out = chat.format_chats(spark.createDataFrame(data, KIND))
    read = {r["conv_id"]: r for r in out.select("conv_id", "formatted", chat.parse_chat(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss")).collect()}
    turns = lambda c: [(t["role"], t["text"]) for t in read[c]["turns"]]
    assert turns(1) == [("user", "a"), ("user", "b<|end|>"), ("assistant", ""), ("assistant", "d\n"), ("assistant", "d\n")]
    assert read[1]["loss"] == "d\nd\n" and read[1]["formatted"].count("<|turn|>") == 2
    assert turns(2) == [("", "")] and turns(None) == [("system", "s")] and turns(3) == [("us|er", "t" * 50_000)]
    assert chat.format_chats(spark.createDataFrame([], KIND)).count() == 0


def test_query_digests(spark, sf_dir):
    said = "</s>[INST] ok [/INST]"
    row = chat.query(spark, sf_dir).where("conv_id = -7").first()
    want = hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert row["turns_sha256"] == want and row["n_turns"] == 2 and row["loss_chars"] == len(said)
    assert row["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()


def test_ties_follow_the_texts_as_they_stand(spark):
    data = [(1, 0, "user", t, "") for t in ("<s>a", "5", "[INST]", "Z", "&lt;", None)]
    out = chat.format_chats(spark.createDataFrame(data, KIND))
    turns = out.select(chat.parse_chat(F.col("formatted")).alias("t")).first()["t"]
    assert [t["text"] for t in turns] == ["", "&lt;", "5", "<s>a", "Z", "[INST]"]


def test_controls_of_other_templates_are_escaped(spark):
    controls = ["<start_of_turn>", "<bos>", "<unk>", "<|im-end|>", "<|im_start|>", "[SYSTEM_PROMPT]", "[/INST]", "<<SYS>>", "<end_of_turn>"]
    df = spark.createDataFrame([(c,) for c in controls], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", chat.unescape(F.col("e")).alias("u")).collect():
        assert r["u"] == r["t"] and r["t"] not in r["e"]
    plain = spark.createDataFrame([("a < b and b > c, x[i] = [1]",)], "t string")
    assert plain.select(chat.escape(F.col("t"))).first()[0] == "a < b and b > c, x[i] = [1]"
