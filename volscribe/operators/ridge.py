"""Cross-validated ridge and elastic net on lagged volatility plus text vectors, walked forward.

The rows are read once to add up cross products per (year, fold). Those matrices
have a fixed size, whatever the number of rows, and are enough to fit any window,
fold and penalty and to score it. The penalty is scaled as in Spark ML's
LinearRegression with standardization, which ``ridge_cv`` uses directly.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.ml.stat import Summarizer
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame, functions as F

from volscribe.functions.dates import year_range
from volscribe.functions.numeric import md5_head
from volscribe.operators.windows import MIN_TRAIN_ROWS, THREE_AND_GAP, Scheme, window_bounds, with_roles
from volscribe.session import written

# Penalty grid, folds and concurrent fits.
PENALTIES = (1e-4, 1e-3, 1e-2, 1e-1, 1.0)
FOLDS = 3
PARALLELISM = 8

# Rows of a year and fold that one part adds up, about. A part sends one matrix, 2.4 MB
# with 768 dimensions, which is then less than its rows.
PART_ROWS = 20_000

# Coordinate descent ends when no slope of a standardized feature moves by more, or after so many cycles.
SETTLED, MAX_CYCLES = 1e-11, 10_000

LAGS = ("c_vol_1", "c_vol_5", "c_vol_22", "c_vol_63")
LABEL = "c_y_1"
EMBED = "r_embed"


def design_rows(
    linked: DataFrame,
    grain: str = "post",
    folds: int = FOLDS,
    lags: Sequence[str] = LAGS,
    label: str = LABEL,
    embed: str = EMBED,
) -> DataFrame:
    """(PERMNO, date, id, fold, x, y) from linked rows that have all parts.

    ``grain='post'`` keeps a row per text; ``'security_day'`` averages the vectors
    of a security-day first. Folds come from a hash of the row key.
    """
    from volscribe.operators.embed import security_day_mean

    whole = linked.na.drop(subset=[label, *lags, embed])
    if grain == "security_day":
        scalars = [label, *lags]
        # The lags are the same on every text of a day and ride along as grouping keys.
        whole = security_day_mean(whole, ("PERMNO", "c_date", *scalars), embed)
        key = F.concat_ws("_", F.col("PERMNO").cast("string"), F.col("c_date").cast("string"))
    elif grain == "post":
        key = F.concat_ws("_", "r_id", "r_ticker")
    else:
        raise ValueError(f"unknown grain {grain!r}")
    return whole.select(
        "PERMNO",
        F.col("c_date").cast("date").alias("date"),
        key.alias("id"),
        (md5_head(key) % folds).cast("int").alias("fold"),
        F.concat(F.array(*lags), F.col(embed).cast("array<double>")).alias("x"),
        F.col(label).alias("y"),
    )


def parts_for(rows: DataFrame, part_rows: int = PART_ROWS) -> int:
    """Into how many parts to deal the rows of a year and fold, so that the largest ones have about ``part_rows`` each."""
    most = rows.groupBy(F.year("date"), "fold").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    return max(1, -(-(most or 0) // part_rows))


def cross_products(rows: DataFrame, salts: int | None = None) -> DataFrame:
    """Upper triangle of Z'Z per (year, fold), with Z = (x, y, 1), one row per matrix row.

    Rows are dealt out by year, fold and one of ``salts`` parts, so that a task holds
    one or a few matrices and sends those, however many rows it saw. Without ``salts``
    the rows are counted first, which reads nothing but dates and folds of stored rows.
    """
    salts = salts or parts_for(rows)

    def partial_sums(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            years, folds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)
            z = np.column_stack([x, batch.column(3).to_numpy(), np.ones(batch.num_rows)])
            pairs, codes = np.unique(np.column_stack([years, folds]), axis=0, return_inverse=True)
            for code, pair in enumerate(pairs.tolist()):
                part = z[codes.ravel() == code]
                sums[tuple(pair)] = sums.get(tuple(pair), 0.0) + part.T @ part
        for (year, fold), total in sums.items():
            size = len(total)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(size, year, dtype=np.int32)),
                    pa.array(np.full(size, fold, dtype=np.int32)),
                    pa.array(np.arange(size, dtype=np.int32)),
                    pa.array([total[i, i:] for i in range(size)], pa.list_(pa.float64())),
                ],
                names=["year", "fold", "i", "values"],
            )

    salt = F.pmod(F.xxhash64("id"), F.lit(salts))
    dealt = rows.select(F.year("date").alias("year"), "fold", "x", "y", salt.alias("salt")).repartition("year", "fold", "salt")
    partial = dealt.drop("salt").mapInArrow(partial_sums, "year int, fold int, i int, values array<double>")
    return (
        partial.groupBy("year", "fold", "i")
        .agg(Summarizer.sum(array_to_vector("values")).alias("total"))
        .select("year", "fold", "i", vector_to_array("total").alias("values"))
    )


def _matrix(part: pd.DataFrame) -> np.ndarray:
    """Sum of the stored upper triangles, as one symmetric matrix."""
    size = int(part["i"].max()) + 1
    total = np.zeros((size, size))
    for i, values in zip(part["i"], part["values"]):
        total[i, i:] += values
    return total + np.triu(total, 1).T


def _standardized(total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, covariances and deviations of (x, y) from Z'Z."""
    mean = total[-1, :-1] / total[-1, -1]
    cov = total[:-1, :-1] / total[-1, -1] - np.outer(mean, mean)
    return mean, cov, np.sqrt(np.maximum(np.diag(cov), 0.0))


def _soft(value: float, by: float) -> float:
    return value - by if value > by else value + by if value < -by else 0.0


def _descended(scaled: np.ndarray, target: np.ndarray, l1: float, l2: float, start: np.ndarray) -> np.ndarray:
    """The slopes that minimise b'Ab/2 - t'b + l1 |b| + l2 b'b/2, by cyclic coordinate descent from ``start``.

    Slopes that are not zero are cycled through until they settle; then all others are
    looked at, and those whose gradient exceeds ``l1`` join in.
    """
    slopes = start.copy()
    # What is left of the target, kept up to date.
    left = target - scaled @ slopes
    active = np.flatnonzero(slopes)
    while True:
        for _ in range(MAX_CYCLES):
            moved = 0.0
            for j in active.tolist():
                old = slopes[j]
                new = _soft(left[j] + scaled[j, j] * old, l1) / (scaled[j, j] + l2)
                if new != old:
                    left -= scaled[j] * (new - old)
                    slopes[j] = new
                    moved = max(moved, abs(new - old))
            if moved < SETTLED:
                break
        free = (slopes == 0) & (np.abs(left) > l1 * (1 + 1e-10) + SETTLED)
        if not free.any() or np.isin(np.flatnonzero(free), active).all():
            return slopes
        active = np.union1d(np.flatnonzero(slopes), np.flatnonzero(free))


def _path(total: np.ndarray, penalties: Sequence[float], alpha: float) -> list[tuple[float, np.ndarray]]:
    """Intercept and slopes from Z'Z for each penalty on standardized features, in their order.

    ``alpha`` is the share of the penalty that is on absolute values. With 0 each penalty
    is a linear system; otherwise fits go from the largest penalty to the smallest, each
    from where the last one ended.
    """
    mean, cov, std = _standardized(total)
    used = std[:-1] > 1e-12
    fits, slopes = {}, np.zeros(int(used.sum()))
    for k in sorted(range(len(penalties)), key=lambda k: -penalties[k]):
        out = np.zeros(len(std) - 1)
        if std[-1] > 0 and used.any():
            scaled = cov[:-1, :-1][np.ix_(used, used)] / np.outer(std[:-1][used], std[:-1][used])
            target = cov[:-1, -1][used] / (std[:-1][used] * std[-1])
            size = penalties[k] / std[-1]
            if alpha:
                slopes = _descended(scaled, target, alpha * size, (1 - alpha) * size, slopes)
            else:
                scaled[np.diag_indices_from(scaled)] += size
                slopes = np.linalg.solve(scaled, target)
            out[used] = slopes * std[-1] / std[:-1][used]
        fits[k] = float(mean[-1] - out @ mean[:-1]), out
    return [fits[k] for k in range(len(penalties))]


def _score(total: np.ndarray, intercept: float, slopes: np.ndarray) -> tuple[float, float]:
    n = total[-1, -1]
    weights = np.concatenate([-slopes, [1.0, -intercept]])
    mse = float(weights @ total @ weights) / n
    spread = total[-2, -2] / n - (total[-1, -2] / n) ** 2
    return mse, 1.0 - mse / spread if spread > 0 else float("nan")


def ridge_walk_forward(
    rows: DataFrame,
    scheme: Scheme = THREE_AND_GAP,
    start_year: int | None = None,
    end_year: int | None = None,
    penalties: Sequence[float] = PENALTIES,
    min_train_rows: int = MIN_TRAIN_ROWS,
    alpha: float = 0.0,
    all_train_years: bool = False,
) -> DataFrame:
    """Per window: cross-validation error of every penalty, the best one, test error.

    ``alpha`` mixes the penalty: 0 is ridge, 1 the lasso, and in between elastic net.

    Windows start at ``start_year`` and later, and those that would reach
    ``end_year`` are left out; without these bounds every window with rows is there.
    A window is fitted if it has ``min_train_rows`` and test rows and, with
    ``all_train_years``, rows in each of its training years. Others have their counts and ``usable`` false, and null
    otherwise. Each group holds the matrices of one window.
    """
    grid = [float(p) for p in penalties]

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        train, test = part[part["role"] == "train"], part[part["role"] == "test"]
        folds = {fold: _matrix(rows) for fold, rows in train.groupby("fold")}
        tested = _matrix(test) if len(test) else None
        counts = {
            "train_start": int(part["train_start"].iloc[0]),
            "n_train": int(round(sum(m[-1, -1] for m in folds.values()))),
            "n_test": int(round(tested[-1, -1])) if len(test) else 0,
        }
        whole = not all_train_years or train["year"].nunique() == scheme.train_years
        if not whole or not len(train) or not len(test) or counts["n_train"] < min_train_rows:
            return pd.DataFrame([{**dict.fromkeys(names), **counts, "usable": False}])
        total = sum(folds.values())
        held_out = [[_score(held, *fit)[0] for fit in _path(total - held, grid, alpha)] for held in folds.values()]
        errors = np.mean(held_out, axis=0).tolist()
        best = int(np.argmin(errors))
        # Down to the chosen penalty, as the folds went.
        way = [p for p in grid if p >= grid[best]] if alpha else [grid[best]]
        intercept, slopes = _path(total, way, alpha)[way.index(grid[best])]
        mse, r2 = _score(tested, intercept, slopes)
        return pd.DataFrame(
            [
                {
                    **counts, "usable": True, "penalties": grid, "cv_mse": errors, "best_lambda": grid[best], "intercept": intercept, "coefficients": slopes.tolist(),
                    "mse": mse, "r2": r2,
                }
            ]
        )

    schema = (
        "train_start int, n_train long, n_test long, usable boolean, penalties array<double>, cv_mse array<double>, "
        "best_lambda double, intercept double, coefficients array<double>, mse double, r2 double"
    )
    names = [c.split()[0] for c in schema.split(", ")]
    # Stored, as vectors are dear to make and the rows are counted before they are added up.
    roles = with_roles(cross_products(written(rows, "design")), scheme)
    if start_year is not None:
        roles = roles.filter(F.col("train_start") >= start_year)
    if end_year is not None:
        last = end_year - scheme.test_offset - scheme.test_years
        roles = roles.filter(F.col("train_start") <= last)
    fits = roles.groupBy("train_start").applyInPandas(fit, schema)
    return fits.withColumns(window_bounds(scheme))


def scored_rows(rows: DataFrame, fits: DataFrame) -> DataFrame:
    """The test rows of every fitted window with its prediction, a dot product in built-in functions.

    Rows in no test year are left out; where test years overlap a row comes once for
    each window. ``fits`` has a row for each window, so its broadcast is bounded by the calendar.
    """
    models = fits.filter("usable").select("train_start", "intercept", "coefficients", F.explode(F.sequence("test_start", "test_end")).alias("year"))
    joined = rows.withColumn("year", F.year("date")).join(F.broadcast(models), "year")
    products = F.zip_with("x", "coefficients", lambda x, c: x * c)
    value = F.aggregate(products, F.col("intercept"), lambda total, p: total + p)
    return joined.select("train_start", "PERMNO", "date", "id", "y", value.alias("prediction"))


def cv_scores(fits: DataFrame) -> DataFrame:
    """Cross-validation error per window and penalty."""
    zipped = F.arrays_zip("penalties", "cv_mse")
    return fits.filter("usable").select("train_start", F.inline(zipped)).withColumnsRenamed({"penalties": "penalty"})


def mean_metrics(fits: DataFrame) -> DataFrame:
    """Number of fitted windows, the mean of their test errors, and that weighted by test rows."""
    fitted = fits.filter("usable")
    by_row = F.try_divide(F.sum(F.col("mse") * F.col("n_test")), F.sum("n_test"))
    return fitted.agg(F.count("*").alias("windows"), F.avg("mse").alias("mse"), F.avg("r2").alias("r2"), by_row.alias("mse_by_row"))


def best_lambda(fits: DataFrame) -> DataFrame:
    return fits.filter("usable").select("train_start", "train_end", "test_start", "test_end", "best_lambda")


def ml_rows(rows: DataFrame) -> DataFrame:
    """Design rows with the vector column Spark ML expects."""
    return rows.withColumn("features", array_to_vector("x")).withColumnRenamed("y", "label")


def linear_regression(penalty: float = 0.0, alpha: float = 0.0) -> LinearRegression:
    return LinearRegression(
        featuresCol="features", labelCol="label", regParam=penalty, elasticNetParam=alpha, fitIntercept=True
    )


def ridge_cv(
    train: DataFrame,
    penalties: Sequence[float] = PENALTIES,
    alpha: float = 0.0,
    folds: int = FOLDS,
    fold_col: str = "fold",
    parallelism: int = PARALLELISM,
) -> CrossValidatorModel:
    """Spark ML cross-validation of one training set; refits on all of it."""
    model = linear_regression(alpha=alpha)
    return CrossValidator(
        estimator=model,
        estimatorParamMaps=ParamGridBuilder().addGrid(model.regParam, list(penalties)).build(),
        evaluator=RegressionEvaluator(metricName="mse"),
        numFolds=folds,
        foldCol=fold_col,
        parallelism=parallelism,
    ).fit(train)


def last_window_model(rows: DataFrame, fits: DataFrame) -> tuple[LinearRegressionModel, DataFrame]:
    """Spark ML model of the latest window with its chosen penalty, and that window's test rows."""
    last = fits.filter("usable").orderBy(F.desc("train_start")).select(
        "train_start", "train_end", "test_start", "test_end", "best_lambda"
    ).first()
    if last is None:
        raise ValueError("no window has enough rows to be fitted")
    train, test = (
        ml_rows(rows.filter(year_range("date", first, final)))
        for first, final in ((last.train_start, last.train_end), (last.test_start, last.test_end))
    )
    return linear_regression(last.best_lambda).fit(train), test
