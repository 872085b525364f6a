import pytest

from hourglass.llm.common import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_frame(spark, rows, extra=False):
    """Documents of (doc_id, text); with columns whose names clash with results where asked."""
    df = spark.createDataFrame([(i, t, "en" if t else None, "s", len(t or "")) for i, t in rows], DOCS)
    if extra:
        from pyspark.sql import functions as F
        for c in ("spans", "id", "piece", "length", "n_words", "component_id", "score", "keep", "part", "row", "copy"):
            df = df.withColumn(c, F.lit("x"))
    return df


LONG = " ".join(f"w{i % 997}x{i // 997}" for i in range(20000))
HARD = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one"), (5, "one"), (None, "one two three four five six"),
        (7, LONG), (8, LONG), (9, "é ñ 日本 \x1c \x85 🙂"), (10, "a" * 5000)]


@pytest.fixture()
def scratch(spark):
    return Scratch(spark, "test")
