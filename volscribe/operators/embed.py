"""Batched text vectors from token ids."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import partial

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

# Rows per forward pass and vector width of the delivered model.
BATCH_ROWS = 2048
DIMENSIONS = 768

Encoder = Callable[[np.ndarray, np.ndarray], np.ndarray]

# Fixed values of the hashed encoder: odd multipliers and a prime modulus.
HASH_ROW, HASH_COLUMN, HASH_MODULUS = 7919, 104729, 10007


class HashedProjection:
    """Encoder without weights: the mean of one pseudo-random vector per token.

    Component ``j`` of token ``t`` is ``(t * (7919 + 104729 j)) mod 10007``, put
    into [-0.5, 0.5). It stands in where no model file is at hand.
    """

    def __init__(self, dimensions: int = DIMENSIONS):
        self.multipliers = HASH_ROW + HASH_COLUMN * np.arange(dimensions, dtype=np.int64)

    def __call__(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        total = np.zeros((len(ids), len(self.multipliers)), dtype=np.int64)
        # Token by token position, so that memory stays at rows x dimensions.
        for place in range(ids.shape[1]):
            parts = (ids[:, place, None].astype(np.int64) * self.multipliers) % HASH_MODULUS
            total += parts * mask[:, place, None]
        count = np.maximum(mask.sum(axis=1, dtype=np.int64), 1)[:, None]
        present = (mask.sum(axis=1) > 0)[:, None]
        return np.where(present, total / (count * HASH_MODULUS) - 0.5, 0.0)


def hashed_projection(dimensions: int = DIMENSIONS) -> Callable[[], Encoder]:
    return partial(HashedProjection, dimensions)


def batch_embed(
    tokens: DataFrame,
    encoder_factory: Callable[[], Encoder] | None = None,
    dimensions: int = DIMENSIONS,
    batch_rows: int = BATCH_ROWS,
    tasks: int | None = None,
    keep: Sequence[str] = ("id", "ticker"),
) -> DataFrame:
    """One float vector per token row, beside the columns to ``keep``.

    The factory is called once per task; rows go through the encoder in batches
    of ``batch_rows``. ``tasks`` deals the rows out evenly over that many tasks,
    say one per accelerator. A vector of another length fails the job.
    """
    make = encoder_factory or hashed_projection(dimensions)

    def embed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder = make()
        for batch in batches:
            for at in range(0, batch.num_rows, batch_rows):
                part = batch.slice(at, batch_rows)
                ids, mask = (
                    part.column(c).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                    for c in (len(keep), len(keep) + 1)
                )
                vectors = np.ascontiguousarray(encoder(ids, mask), dtype=np.float32)
                if vectors.shape != (part.num_rows, dimensions):
                    raise ValueError(f"encoder gave shape {vectors.shape}, wanted {(part.num_rows, dimensions)}")
                offsets = np.arange(0, vectors.size + 1, dimensions, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(keep)], pa.ListArray.from_arrays(offsets, vectors.reshape(-1))],
                    names=[*keep, "embed"],
                )

    narrow = tokens.select(*keep, "input_ids", "attention_mask")
    if tasks:
        narrow = narrow.repartition(tasks)
    schema = StructType(narrow.schema.fields[:-2] + [StructField("embed", ArrayType(FloatType()))])
    return narrow.mapInArrow(embed, schema)


def vector_from_array(df: DataFrame, column: str = "embed", out: str = "embed_vec") -> DataFrame:
    """ML vector of an array column; rows without an array are dropped."""
    return df.na.drop(subset=[column]).withColumn(out, array_to_vector(column))


def security_day_mean(df: DataFrame, keys=("PERMNO", "date"), column: str = "embed") -> DataFrame:
    """Element-wise mean of all vectors of a security and day.

    The mean is combined within each task before the exchange, so a busy day
    sends one partial vector per task.
    """
    mean = Summarizer.mean(F.col("_vec"))
    return (
        vector_from_array(df, column, "_vec")
        .groupBy(*keys)
        .agg(vector_to_array(mean).alias(column), F.count("*").alias("texts"))
    )
