"""Least squares on lagged volatility, walked forward year by year.

One pass over the rows yields a triangular factor per year, by a tall-skinny QR: each
task reduces its own rows, and factors are merged in a tree. Everything else (fits, test
errors, pooled errors) follows from those few numbers, so no window scans the panel
again. Unlike sums of products, a factor keeps its digits where lags are nearly equal.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F, types as T

from volscribe.operators.quantiles import pooled_quantiles
from volscribe.operators.windows import ROLLING_FOUR, Scheme, window_bounds, window_row_guards, with_roles

# Regressors and target.
FEATURES = ("vol_1", "vol_5", "vol_22", "vol_63")
LABEL = "y_1"

# What is clipped on either side, and the volatility that logarithms begin at.
TAIL, LEAST_VOLATILITY = 0.01, 1e-6

# Parts of a group's factors that are merged first.
BRANCHES = 32

_FIT = (
    "train_start int, n_train long, n_test long, intercept double, coefficients array<double>, "
    "mse double, r2 double, test_mean double, test_var double"
)


def complete_rows(panel: DataFrame, features: Sequence[str] = FEATURES, label: str = LABEL) -> DataFrame:
    """Rows in which every selected column is present."""
    return panel.select("PERMNO", "date", label, *features).na.drop()


def assemble_features(
    df: DataFrame, features: Sequence[str] = FEATURES, vector: str | None = None, out: str = "features"
) -> DataFrame:
    """One ML vector of the scalar columns and, optionally, a vector column."""
    columns = [*features, *([vector] if vector else [])]
    return VectorAssembler(inputCols=columns, outputCol=out, handleInvalid="error").transform(df)


def gram_matrix(
    df: DataFrame, by: Column, features: Sequence[str] = FEATURES, label: str = LABEL
) -> DataFrame:
    """Sums of products of all pairs of (1, features, label) per group, one row per pair."""
    terms = {"one": F.lit(1.0), **{f: F.col(f) for f in features}, label: F.col(label)}
    pairs = list(combinations_with_replacement(terms, 2))
    sums = df.groupBy(by).agg(*[F.sum(terms[a] * terms[b]).alias(f"{a}:{b}") for a, b in pairs])
    cells = [
        F.struct(F.lit(a).alias("left_term"), F.lit(b).alias("right_term"), F.col(f"`{a}:{b}`").alias("total"))
        for a, b in pairs
    ]
    return sums.select(sums.columns[0], F.inline(F.array(*cells)))


def _reduced(blocks: list[np.ndarray]) -> np.ndarray:
    """The square triangular factor of all rows of ``blocks``."""
    factor = np.linalg.qr(np.vstack(blocks), mode="r")
    size = factor.shape[1]
    return factor if len(factor) == size else np.vstack([factor, np.zeros((size - len(factor), size))])


def factors(rows: DataFrame, by: Sequence[str], features: Sequence[str] = FEATURES, label: str = LABEL) -> DataFrame:
    """Count and triangular factor of the rows (1, features, label) for each value of ``by``, which are integers.

    A task holds one factor for each group it meets and sends those, so rows are never
    shuffled. Factors of a group are merged ``BRANCHES`` parts at a time, then once more.
    """
    size, number = len(features) + 2, len(by)

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.column_stack([np.asarray(c) for c in batch.columns[:number]])
            table = np.column_stack([np.ones(batch.num_rows), *(np.asarray(c) for c in batch.columns[number:])])
            groups, codes = np.unique(keys, axis=0, return_inverse=True)
            for code, group in enumerate(groups.tolist()):
                block = table[codes.ravel() == code]
                n, factor = held.get(tuple(group), (0, np.empty((0, size))))
                held[tuple(group)] = [n + len(block), _reduced([factor, block])]
        part = TaskContext.get().partitionId() % BRANCHES
        columns = [pa.array([g[k] for g in held], pa.int32()) for k in range(number)]
        columns += [pa.array([part] * len(held), pa.int32()), pa.array([n for n, _ in held.values()], pa.int64())]
        columns.append(pa.array([f.ravel().tolist() for _, f in held.values()], pa.list_(pa.float64())))
        yield pa.RecordBatch.from_arrays(columns, [*by, "part", "n", "factor"])

    def merged(part: pd.DataFrame) -> pd.DataFrame:
        n, factor = _pool(part)
        return part.head(1).assign(n=n, factor=[factor.ravel().tolist()])

    keys = ", ".join(f"{c} int" for c in by)
    schema = f"{keys}, part int, n bigint, factor array<double>"
    narrow = rows.select(*[F.col(c).cast("int") for c in by], *[F.col(c).cast("double") for c in (*features, label)])
    parts = narrow.mapInArrow(reduced, schema).groupBy(*by, "part").applyInPandas(merged, schema)
    return parts.groupBy(*by).applyInPandas(merged, schema).drop("part")


def yearly_factors(rows: DataFrame, features: Sequence[str] = FEATURES, label: str = LABEL, date: str = "date") -> DataFrame:
    """``factors`` per calendar year."""
    return factors(rows.withColumn("year", F.year(date)), ["year"], features, label)


def _pool(part: pd.DataFrame) -> tuple[int, np.ndarray]:
    """Count and factor of several factors' rows taken together."""
    blocks = [np.reshape(f, (round(len(f) ** 0.5), -1)) for f in part["factor"]]
    return int(part["n"].sum()), _reduced(blocks)


def _solve(factor: np.ndarray) -> tuple[float, np.ndarray]:
    """Intercept and slopes of the last variable on the others.

    Below its first row, a factor that begins with the constant is that of the centred
    rows. Slopes of equal variables are shared; one without spread gets none.
    """
    sizes = np.linalg.norm(factor[1:, 1:-1], axis=0)
    used = sizes > 1e-13 * np.abs(factor[0, 1:-1]) + 1e-300
    slopes = np.zeros(len(sizes))
    if used.any():
        slopes[used] = np.linalg.lstsq(factor[1:, 1:-1][:, used] / sizes[used], factor[1:, -1], rcond=None)[0] / sizes[used]
    return float((factor[0, -1] - factor[0, 1:-1] @ slopes) / factor[0, 0]), slopes


def _errors(intercept: float, slopes: np.ndarray, n: int, factor: np.ndarray) -> tuple[float, float]:
    """Mean squared error and R² of a fit on rows known by their factor."""
    squares = float(np.sum((factor @ np.concatenate([[-intercept], -slopes, [1.0]])) ** 2))
    spread = float(np.sum(factor[1:, -1] ** 2))
    return squares / n, 1.0 - squares / spread if spread > 0 else float("nan")


def _fit_record(start: int, train: pd.DataFrame, test: pd.DataFrame) -> dict:
    n_train, factor = _pool(train)
    intercept, slopes = _solve(factor)
    n_test, tested = _pool(test)
    mse, r2 = _errors(intercept, slopes, n_test, tested)
    return {
        "train_start": start, "n_train": n_train, "n_test": n_test, "intercept": intercept,
        "coefficients": slopes.tolist(), "mse": mse, "r2": r2,
        "test_mean": float(tested[0, -1] / tested[0, 0]), "test_var": float(np.sum(tested[1:, -1] ** 2)) / n_test,
    }


def walk_forward(
    rows: DataFrame, scheme: Scheme = ROLLING_FOUR, features: Sequence[str] = FEATURES, label: str = LABEL
) -> DataFrame:
    """One fit per window: coefficients, test error and R².

    A window counts when all its training years and a test year hold rows. Each
    group below holds one row per year of a window.
    """
    needed = scheme.train_years

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        train, test = part[part["role"] == "train"], part[part["role"] == "test"]
        if len(train) < needed or test.empty:
            return pd.DataFrame()
        return pd.DataFrame([_fit_record(int(part["train_start"].iloc[0]), train, test)])

    fits = with_roles(yearly_factors(rows, features, label), scheme).groupBy("train_start").applyInPandas(fit, _FIT)
    return fits.withColumns(window_bounds(scheme))


def winsor_bounds(
    rows: DataFrame, scheme: Scheme = ROLLING_FOUR, columns: Sequence[str] = (*FEATURES, LABEL), tail: float = TAIL
) -> DataFrame:
    """train_start, metric, low and high: the exact quantiles ``tail`` and 1 - ``tail`` of each window's training rows."""

    def windows(group: tuple) -> list[tuple]:
        (year,) = group
        return [(None,)] if year is None else [(year - k,) for k in range(scheme.train_years)]

    # Each row counts for its year alone; windows add up their years.
    yearly = rows.select(F.year("date").alias("year"), *columns)
    named = T.StructType([T.StructField("train_start", T.IntegerType())])
    found = pooled_quantiles(yearly, ("year",), columns, (tail, 1 - tail), windows, named)
    low, high = (F.max(F.when(F.col("probability") == p, F.col("value"))).alias(name) for p, name in ((tail, "low"), (1 - tail, "high")))
    return found.groupBy("train_start", "metric").agg(low, high)


def winsorised_rows(
    rows: DataFrame, scheme: Scheme = ROLLING_FOUR, features: Sequence[str] = FEATURES, label: str = LABEL, tail: float = TAIL
) -> DataFrame:
    """The training and test rows of every window that may be fitted, clipped at its bounds, which test rows have no say in.

    Test targets stay as they are, so that errors are those of the real values.
    """
    columns = (*features, label)
    bounds = winsor_bounds(rows, scheme, columns, tail)
    ends = [F.max(F.when(F.col("metric") == c, F.col(end))).alias(f"{end}_{c}") for c in columns for end in ("low", "high")]
    usable = window_row_guards(rows, scheme).where("usable").select("train_start")
    # A row for each window, so bounded by the calendar.
    wide = bounds.groupBy("train_start").agg(*ends).join(usable, "train_start")
    every = with_roles(rows.withColumn("year", F.year("date")), scheme).join(F.broadcast(wide), "train_start")
    clipped = {c: F.least(F.greatest(F.col(c), F.col(f"low_{c}")), F.col(f"high_{c}")) for c in columns}
    clipped[label] = F.when(F.col("role") == "train", clipped[label]).otherwise(F.col(label))
    return every.select("train_start", "role", *[clipped[c].alias(c) for c in columns])


def winsorised_walk_forward(
    rows: DataFrame, scheme: Scheme = ROLLING_FOUR, features: Sequence[str] = FEATURES, label: str = LABEL, tail: float = TAIL
) -> DataFrame:
    """``walk_forward`` on rows clipped at the outer quantiles of each window's training rows."""

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([_fit_record(int(part["train_start"].iloc[0]), part[part["testing"] == 0], part[part["testing"] == 1])])

    every = winsorised_rows(rows, scheme, features, label, tail).withColumn("testing", (F.col("role") == "test").cast("int"))
    fits = factors(every, ("train_start", "testing"), features, label).groupBy("train_start").applyInPandas(fit, _FIT)
    return fits.withColumns(window_bounds(scheme))


def log_rows(rows: DataFrame, columns: Sequence[str] = (*FEATURES, LABEL), least: float = LEAST_VOLATILITY) -> DataFrame:
    """Logarithms of volatilities, those below ``least`` as if they were that."""
    return rows.withColumns({c: F.log(F.greatest(F.col(c), F.lit(least))) for c in columns})


def pooled_refit(
    rows: DataFrame,
    scheme: Scheme = ROLLING_FOUR,
    shift: int = 4,
    features: Sequence[str] = FEATURES,
    label: str = LABEL,
) -> DataFrame:
    """Fit and score on the same rows: all years from the first test year + ``shift``.

    In-sample by definition; ``pooled_out_of_sample`` is the honest figure.
    """
    train_years, offset = scheme.train_years, scheme.test_offset

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        present = set(part["year"])
        tests = [y for y in present if all(y - offset + k in present for k in range(train_years))]
        if not tests:
            return pd.DataFrame()
        first = min(tests) + shift
        chosen = part[part["year"] >= first]
        if chosen.empty:
            return pd.DataFrame()
        record = _fit_record(first, chosen, chosen)
        return pd.DataFrame([{"first_year": first, "n": record["n_train"], "mse": record["mse"], "r2": record["r2"]}])

    # One group with a row per calendar year.
    return (
        yearly_factors(rows, features, label)
        .groupBy()
        .applyInPandas(fit, "first_year int, n long, mse double, r2 double")
    )


def pooled_out_of_sample(fits: DataFrame) -> DataFrame:
    """Error and R² of all windows' test predictions taken as one sample."""
    n = F.sum("n_test")
    mean = F.sum(F.col("n_test") * F.col("test_mean")) / n
    squares = F.sum(F.col("n_test") * (F.col("test_var") + F.col("test_mean") * F.col("test_mean")))
    errors = F.sum(F.col("n_test") * F.col("mse"))
    return fits.agg(
        n.alias("n"), (errors / n).alias("mse"), (1 - F.try_divide(errors, squares - n * mean * mean)).alias("r2")
    )


def predict(rows: DataFrame, fits: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Test rows of every window with the prediction of that window's fit."""
    tests = fits.select(
        "train_start",
        "intercept",
        "coefficients",
        F.explode(F.sequence("test_start", "test_end")).alias("year"),
    )
    # One row per window and test year, so this broadcast is bounded by the calendar.
    joined = rows.withColumn("year", F.year("date")).join(F.broadcast(tests), "year")
    value = F.col("intercept")
    for k, feature in enumerate(features):
        value = value + F.col("coefficients")[k] * F.col(feature)
    return joined.withColumn("prediction", value).drop("intercept", "coefficients")
