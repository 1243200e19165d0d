"""Frames behind the diagnostic figures."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations
from math import pi

from pyspark.sql import DataFrame, functions as F

from volscribe.operators.panel import daily_mean_vol, rolling_beta_by_security, rolling_beta_daily
from volscribe.operators.sampling import SCATTER_ROWS, sample_topn_random
from volscribe.session import written

SCATTER_COLUMNS = ("vol_1", "vol_5", "vol_22", "vol_63", "y_1")
# Fixed value: points of a density curve in the figure.
DENSITY_POINTS = 1000
CELLS_PER_BANDWIDTH, KERNEL_REACH = 8, 8

fig_vol_timeseries = daily_mean_vol
fig_beta_rolling = rolling_beta_daily
fig_beta_by_security = rolling_beta_by_security


def scatter_sample(panel: DataFrame, keys: Sequence[str], n: int = SCATTER_ROWS) -> DataFrame:
    return sample_topn_random(panel, keys, n, "scatter").select(*keys, *SCATTER_COLUMNS)


def density(panel: DataFrame, columns: Sequence[str] = SCATTER_COLUMNS, bins: int = 50) -> DataFrame:
    """Equal-width histogram of each column over all rows.

    The spans are one row, read as a scalar subquery. Each row turns into one
    (metric, bin) pair per column, which are counted before the exchange.
    """
    spans = panel.agg(
        F.struct(
            *[F.min(c).alias(f"lo_{c}") for c in columns], *[F.max(c).alias(f"hi_{c}") for c in columns]
        ).alias("_spans")
    )

    def place(c: str) -> str:
        width = f"((_spans.hi_{c} - _spans.lo_{c}) / {bins})"
        bin_of = f"coalesce(floor(try_divide({c} - _spans.lo_{c}, {width})), 0)"
        return f"named_struct('metric', '{c}', 'bin', cast(least({bin_of}, {bins - 1}) AS int), 'present', {c} IS NOT NULL)"

    counted = (
        panel.select(*columns, spans.scalar().alias("_spans"))
        .selectExpr(f"inline(array({', '.join(map(place, columns))}))")
        .filter("present")
        .groupBy("metric", "bin")
        .agg(F.count("*").alias("row_count"))
        .select("*", spans.scalar().alias("_spans"))
    )
    starts = " ".join(
        f"WHEN '{c}' THEN _spans.lo_{c} + bin * (_spans.hi_{c} - _spans.lo_{c}) / {bins}" for c in columns
    )
    return counted.selectExpr("metric", "bin", "row_count", f"CASE metric {starts} END AS bin_start")


def kernel_density(
    panel: DataFrame, columns: Sequence[str] = SCATTER_COLUMNS, points: int = DENSITY_POINTS, cells: int = CELLS_PER_BANDWIDTH
) -> DataFrame:
    """metric, point, x and density: a Gaussian kernel density of each column over all rows.

    The bandwidth is Scott's, the sample deviation over the fifth root of the count. It
    and the span come from one aggregate. Each value is dealt linearly to the two nearest
    of a grid's cells, which are an eighth of a bandwidth apart and counted before the
    exchange. Their number is the span over the bandwidth, and grows with the fifth root of the rows. Each of
    the ``points``, evenly from the smallest to the largest value, then meets the cells within eight
    bandwidths. Nulls are left out; a column without spread has no density, and no rows.
    """
    moments = panel.agg(
        *[F.count(c).alias(f"n_{c}") for c in columns], *[F.min(c).alias(f"lo_{c}") for c in columns],
        *[F.max(c).alias(f"hi_{c}") for c in columns], *[F.stddev_samp(c).alias(f"sd_{c}") for c in columns],
    )
    spans = moments.select(
        F.inline(F.array(*[
            F.struct(F.lit(c).alias("metric"), F.col(f"n_{c}").alias("n"), F.col(f"lo_{c}").alias("lo"), F.col(f"hi_{c}").alias("hi"),
                     F.try_divide(F.col(f"sd_{c}"), F.pow(F.col(f"n_{c}").cast("double"), F.lit(0.2))).alias("width"))
            for c in columns
        ]))
    ).where("width > 0")
    # A row for each column, read three times below.
    spans = written(spans, "spans")
    values = panel.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])))
    place = values.where("value IS NOT NULL").join(F.broadcast(spans), "metric").selectExpr("metric", f"(value - lo) / (width / {cells}) AS place")
    parts = place.selectExpr(
        "metric",
        "inline(array(named_struct('cell', floor(place), 'weight', 1 - (place - floor(place))), named_struct('cell', floor(place) + 1, 'weight', place - floor(place))))",
    )
    grid = parts.groupBy("metric", "cell").agg(F.sum("weight").alias("weight"))
    at = spans.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point")).withColumn("x", F.expr(f"lo + point * ((hi - lo) / {points - 1})"))
    reach = KERNEL_REACH * cells
    near = at.withColumn("middle", F.expr(f"floor((x - lo) / (width / {cells}))")).withColumn("cell", F.explode(F.sequence(F.col("middle") - reach, F.col("middle") + reach + 1)))
    # Beside a point without any cell near it there is no density.
    met = near.join(grid, ["metric", "cell"], "left")
    away = F.expr(f"(x - (lo + cell * (width / {cells}))) / width")
    total = F.sum(F.coalesce("weight", F.lit(0.0)) * F.exp(-0.5 * away * away))
    summed = met.groupBy("metric", "point").agg(F.first("x").alias("x"), (total / (F.first("n") * F.first("width") * float((2 * pi) ** 0.5))).alias("density"))
    return summed.select("metric", "point", "x", "density")


def correlations(panel: DataFrame, columns: Sequence[str] = SCATTER_COLUMNS) -> DataFrame:
    """Pearson correlation of every column pair, from one pass."""
    pairs = list(combinations(columns, 2))
    one = panel.agg(*[F.corr(a, b).alias(f"{a}_{b}") for a, b in pairs])
    return one.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(a).alias("left_metric"), F.lit(b).alias("right_metric"), F.col(f"{a}_{b}").alias("corr"))
                    for a, b in pairs
                ]
            )
        )
    )
