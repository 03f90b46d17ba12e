"""Tables with everything that may be wrong in a table of documents."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
PASSAGE = " ".join(f"passage{i}" for i in range(60))
ROWS = [
    (1, "The quick brown fox and the lazy dog are here today, my friends.", "en", "a", 64),
    (2, None, "en", "a", None),
    (3, "", None, None, 0),
    (4, " \t\n\x0b\f\r ", "en", "b", 7),
    (5, "12345 67890 !!! ###", "de", "b", 19),
    (None, "a text of no id at all, and quite some words in it", "en", None, 1),
    (None, None, None, None, None),
    (6, LONG, "en", "c", len(LONG)),
    (7, f"intro one two {PASSAGE} and out", "en", "c", 1),
    (8, f"something else\n{PASSAGE} then the end", "fr", "c", 1),
    (8, f"something else\n{PASSAGE} then the end", "fr", "c", 1),
    (9, "Der schnelle braune Fuchs    \x1c\n\n 日本語 <|endoftext|> é́", "de", "d", 1),
    (10, "THE QUICK BROWN FOX and the lazy dog are here today, my friends.", "en", "a", 64),
]


def docs(spark, rows=None):
    """The rows, with more columns whose names operators might use themselves."""
    table = spark.createDataFrame(ROWS if rows is None else rows, DOCS)
    return table.selectExpr(
        "*",
        "1 AS length",
        "'x' AS language",
        "2L AS text_hash",
        "false AS holds_item",
        "named_struct('n', 3) AS cut",
        "4 AS label",
        "5L AS fp",
        "6 AS shard",
        "7 AS `row`",
        "8 AS runs",
    )


def words(text):
    return (text or "").encode().split()
