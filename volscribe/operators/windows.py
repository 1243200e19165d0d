"""Walk-forward windows over calendar years."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F


@dataclass(frozen=True)
class Scheme:
    """Years of training, years left out after them, years of test."""

    train_years: int
    gap_years: int = 0
    test_years: int = 1

    @property
    def test_offset(self) -> int:
        return self.train_years + self.gap_years


# The two back-test schemes in use.
ROLLING_FOUR = Scheme(4, 0, 1)
THREE_AND_GAP = Scheme(3, 1, 1)
MIN_TRAIN_ROWS = 100


def with_roles(yearly: DataFrame, scheme: Scheme) -> DataFrame:
    """Repeat each per-year row for every window it takes part in.

    Adds ``train_start``, which names the window, and ``role``.
    """
    roles = [(k, "train") for k in range(scheme.train_years)]
    roles += [(scheme.test_offset + k, "test") for k in range(scheme.test_years)]
    structs = [
        F.struct((F.col("year") - k).cast("int").alias("train_start"), F.lit(role).alias("role")) for k, role in roles
    ]
    return yearly.select("*", F.inline(F.array(*structs)))


def window_bounds(scheme: Scheme) -> dict:
    start = F.col("train_start")
    return {
        "train_end": (start + scheme.train_years - 1).cast("int"),
        "test_start": (start + scheme.test_offset).cast("int"),
        "test_end": (start + scheme.test_offset + scheme.test_years - 1).cast("int"),
    }


def window_row_guards(
    rows: DataFrame,
    scheme: Scheme,
    date: str = "date",
    all_train_years: bool = True,
    min_train_rows: int = 1,
) -> DataFrame:
    """Row counts of every window and whether it may be fitted.

    Counts rows once per year; windows add up their years.
    """
    yearly = rows.groupBy(F.year(date).alias("year")).agg(F.count("*").alias("n"))
    is_train, is_test = F.col("role") == "train", F.col("role") == "test"
    counted = (
        with_roles(yearly, scheme)
        .groupBy("train_start")
        .agg(
            F.coalesce(F.sum(F.when(is_train, F.col("n"))), F.lit(0)).alias("n_train"),
            F.coalesce(F.sum(F.when(is_test, F.col("n"))), F.lit(0)).alias("n_test"),
            F.count(F.when(is_train, 1)).alias("train_years"),
        )
        .withColumns(window_bounds(scheme))
    )
    usable = (F.col("n_train") >= min_train_rows) & (F.col("n_test") > 0)
    if all_train_years:
        usable = usable & (F.col("train_years") == scheme.train_years)
    return counted.withColumn("usable", usable)
