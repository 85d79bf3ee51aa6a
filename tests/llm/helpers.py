"""A small table of awkward documents."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, key string, fp string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def words(n: int, start: int = 0) -> str:
    return " ".join(f"{WORDS[(start + i) % 20]}{(start + i) * 7 % 101}" for i in range(n))


def rows() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    long = words(60) + ".\n"
    return [
        (1, words(80), "en", "a", 5, 9, "k", "x"),
        (2, words(80), "en", "a", 5, 9, "k", "x"),
        (2, words(80), "en", "a", 5, 9, "k", "x"),
        (3, None, "en", "a", None, None, None, None),
        (4, "", None, "b", 0, 9, "k", "x"),
        (None, words(90, 7), "de", None, 3, 9, "k", "x"),
        (None, None, None, None, None, None, None, None),
        (5, " \t\n ", "fr", "", 1, 9, "k", "x"),
        (6, long * 700, "en", "c", 7, 9, "k", "x"),
        (7, "Kurz.", "de", "c", 7, 9, "k", "x"),
        (8, words(70, 3) + "\n" + words(70, 3), "de", "c", 7, 9, "k", "x"),
    ]


def table(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, DOCS)
