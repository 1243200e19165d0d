import pytest
from pyspark.sql import types as T

CLASHING = "size kept keep_id node root of packed marks version recipe digest bucket range salt rank copy target base p n item spans sketch".split()
LONG = " ".join(f"word{k % 977}" for k in range(40_000))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns named like the operators' own."""
    sentence = "one two three four five six seven eight nine ten eleven twelve thirteen"
    rows = [
        (1, None, "en", "a"), (2, "", None, None), (3, " \n\t ", "en", "b"), (4, sentence, "en", "a"), (4, sentence, "en", "a"),
        (5, sentence.replace(" ", "  "), "en", "a"), (6, "der die das " * 40, "de", "a"), (7, "1234 ... !?", "de", "c"),
        (8, LONG, "en", None), (9, LONG, "en", "a"), (10, "été à l'œuvre\nété à l'œuvre\nété à l'œuvre", "fr", "é"),
        (11, sentence + "\n" + sentence, None, "a"), (None, sentence, "en", "b"), (-5, "alone", "en", "z"), (12, "\0<|endoftext|> x\u2003y", "en", "z"),
    ]
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("text", "lang", "source")]]
        + [T.StructField(c, T.StringType()) for c in CLASHING]
    )
    return spark.createDataFrame([(*r, *["x"] * len(CLASHING)) for r in rows], schema)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def texts(spark):
    from tests.conftest import SF

    return sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
