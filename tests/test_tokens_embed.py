import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from tests.conftest import rows_of
from volscribe.operators import embed, tokens

TEXTS = ["", "a", "buy gme now", "abc " * 50, "exactly four small words", None]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(str(n), "T", t) for n, t in enumerate(TEXTS)], "id string, ticker string, clean_text string")


def check_shape(rows, length, pad=0):
    for r in rows:
        assert len(r.input_ids) == len(r.attention_mask) == length
        used = sum(r.attention_mask)
        assert list(r.attention_mask) == [1] * used + [0] * (length - used)
        assert all(t == pad for t in r.input_ids[used:])


@pytest.mark.parametrize("length", [4, 32, 64])
def test_hashed_tokens(texts, length):
    rows = sorted(tokens.tokenize_hashed(texts, length).collect(), key=lambda r: int(r.id))
    check_shape(rows, length)
    counts = [len((t or "").split()) for t in TEXTS]
    assert [sum(r.attention_mask) for r in rows] == [min(c, length) for c in counts]
    assert len(set(rows[3].input_ids[: min(50, length)])) == 1
    assert all(1 <= t <= tokens.HASH_VOCABULARY for t in rows[3].input_ids[: min(50, length)])


def test_one_vector_per_row_on_any_layout(spark):
    many = spark.range(5000).select(
        F.col("id").cast("string").alias("id"), F.lit("T").alias("ticker"),
        F.concat_ws(" ", F.col("id").cast("string"), F.lit("word"), (F.col("id") % 7).cast("string")).alias("clean_text"),
    )
    ids = tokens.tokenize_hashed(many, 8)
    base = rows_of(embed.batch_embed(ids, dimensions=6))
    assert len(base) == 5000 and {len(r[2]) for r in base} == {6}
    assert rows_of(embed.batch_embed(ids.coalesce(1), dimensions=6, batch_rows=7)) == base
    assert rows_of(embed.batch_embed(ids, dimensions=6, tasks=5)) == base


def test_vector_values(texts):
    rows = {r.id: r.embed for r in embed.batch_embed(tokens.tokenize_hashed(texts, 8), dimensions=3).collect()}
    assert rows["0"] == [0.0, 0.0, 0.0]
    token = next(r.input_ids[0] for r in tokens.tokenize_hashed(texts, 8).filter("id = '1'").collect())
    want = [((token * (7919 + 104729 * j)) % 10007) / 10007 - 0.5 for j in range(3)]
    assert np.allclose(rows["1"], want, atol=1e-6)


class Wrong:
    def __call__(self, ids, mask):
        return np.zeros((len(ids), 2))


class Counting:
    """Reports the batch size it was given."""

    def __call__(self, ids, mask):
        return np.full((len(ids), 1), len(ids))


def test_encoder_of_another_width_fails(texts):
    with pytest.raises(PythonException, match="encoder gave shape"):
        embed.batch_embed(tokens.tokenize_hashed(texts), _factory(Wrong), dimensions=3).collect()


def test_batch_size_is_respected(spark):
    ids = tokens.tokenize_hashed(
        spark.range(0, 250, 1, 1).selectExpr("cast(id as string) AS id", "'T' AS ticker", "'w' AS clean_text"), 4
    )
    sizes = [r.embed[0] for r in embed.batch_embed(ids, _factory(Counting), dimensions=1, batch_rows=100).collect()]
    assert sorted(set(sizes)) == [50.0, 100.0]


def _factory(kind):
    from pyspark import cloudpickle

    shipped = cloudpickle.dumps(kind())
    return lambda: __import__("pickle").loads(shipped)


def test_security_day_mean(spark):
    df = spark.createDataFrame(
        [(1, "d", [1.0, 2.0]), (1, "d", [3.0, 6.0]), (1, "e", [5.0, 5.0]), (1, "e", None)], "PERMNO int, date string, embed array<float>"
    )
    rows = {r.date: (r.embed, r.texts) for r in embed.security_day_mean(df).collect()}
    assert rows == {"d": ([2.0, 4.0], 2), "e": ([5.0, 5.0], 1)}


def test_null_arrays_never_reach_the_vector_step(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, None)], "k int, embed array<float>")
    assert embed.vector_from_array(df).count() == 1
