"""Counts, key lists and regression metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F


def stage_counts(stages: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per named stage, as one frame."""
    counts = [df.agg(F.count("*").alias("row_count")).select(F.lit(n).alias("stage"), "row_count") for n, df in stages.items()]
    return reduce(DataFrame.unionByName, counts)


def distinct_keys_sorted(df: DataFrame, key: str) -> DataFrame:
    return df.select(key).distinct().orderBy(key)


def regression_metrics(
    predictions: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    """Mean squared error and R² about the mean label, per group."""
    squared = (F.col(label) - F.col(prediction)) * (F.col(label) - F.col(prediction))
    spread = F.var_pop(label) * F.count(label)
    return predictions.groupBy(*by).agg(
        F.count(label).alias("n"),
        F.avg(squared).alias("mse"),
        (1 - F.try_divide(F.sum(squared), spread)).alias("r2"),
    )


def mean_window_metrics(windows: DataFrame) -> DataFrame:
    """Plain average over windows, and the average weighted by test rows."""
    return windows.agg(
        F.count("*").alias("windows"),
        F.avg("mse").alias("mse"),
        F.avg("r2").alias("r2"),
        F.try_divide(F.sum(F.col("mse") * F.col("n_test")), F.sum("n_test")).alias("mse_by_row"),
    )
