"""Rows that every operator has to cope with."""

from pyspark.sql import functions as F

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use for columns of their own.
CLASHING = ("key", "node", "n", "size", "row", "start", "spot", "parts", "score", "kept", "bucket", "_clean", "_spot", "place")


def documents(spark, rows):
    """Rows (doc_id, text) or (doc_id, text, source) as a documents table."""
    full = [
        (r[0], r[1], "en", r[2] if len(r) > 2 else "src0", None if r[1] is None else len(r[1])) for r in rows
    ]
    return spark.createDataFrame(full, DOCUMENTS)


def clashing(df):
    """The same rows with further columns that have the names of operators' own columns."""
    return df.withColumns({name: F.lit("x") for name in CLASHING})


#: Nulls, empty and very long texts, ties, repeated rows, odd characters.
ODD = [
    (1, None),
    (2, ""),
    (3, " \t\n\r\x0b\x0c "),
    (4, "the cat sat on the mat and the dog ran to the house in a wood of old trees."),
    (5, "the cat sat on the mat and the dog ran to the house in a wood of old trees."),
    (5, "the cat sat on the mat and the dog ran to the house in a wood of old trees."),
    (6, "Ünï çødé   日本 語 \U0001f600\U0001f600 <|endoftext|> x\x1cy \x85z"),
    (7, "word " * 6000),
    (8, "a"),
    (None, "a null key with the words of a text"),
    (9, "one two\n\n\none two\none two three four five six seven eight nine ten"),
    (-3, "THE CAT sat on the mat and the dog ran to the house in a wood of old trees."),
]
