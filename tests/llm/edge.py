"""Small documents with every defined case, and columns that clash with inner names."""

from pyspark.sql import functions as F

WORDS = [f"word{i}" for i in range(60)]
BASE = " ".join(WORDS)
NEAR = " ".join([*WORDS[:30], "changed", *WORDS[31:]])  # one of 60 words: similarity 51/61
LONG = " ".join(f"long{i % 997}x{i}" for i in range(20_000))

ROWS = [
    (1, None),
    (2, ""),
    (3, "   \n"),
    (4, "two words"),
    (5, "Two  Words"),
    (6, BASE),
    (7, BASE),
    (8, BASE + " and one more tail"),
    (9, NEAR),
    (10, LONG),
    (11, LONG + " end"),
    (12, "a completely different text about nothing in particular, alone here"),
    (12, "a completely different text about nothing in particular, alone here"),
    (13, "né à la façon d'un <|endoftext|> 中文 😀 \x1c\t tab"),
    (None, "a row without an id"),
]


def docs(spark, rows=None):
    made = spark.createDataFrame(ROWS if rows is None else rows, "doc_id long, text string")
    for clash in ("row", "ident", "id", "group", "_sha", "_gone", "component", "task", "label"):
        made = made.withColumn(clash, F.lit("clash"))
    return made
