"""Daily returns to a volatility panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from volscribe.functions.dates import parse_compact_date
from volscribe.functions.numeric import first_return
from volscribe.session import written

# Window lengths in trading days.
WINDOWS = (1, 5, 22, 63)

CHUNK_ROWS = 100_000


def parse_returns(raw: DataFrame) -> DataFrame:
    """Text returns to (PERMNO, date, ret), taking RET, else RETX, else DLRET."""
    return raw.select(
        "PERMNO",
        parse_compact_date("date").alias("date"),
        first_return("RET", "RETX", "DLRET").alias("ret"),
    )


def _panel_columns(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], windows: Sequence[int], min_periods: int | None
) -> DataFrame:
    """``df`` with vol_w and y_w; both window steps share one sort."""
    over = f"PARTITION BY {_names(keys)} ORDER BY {_names(order)}"

    def volatility(size: int) -> str:
        frame = f"OVER ({over} ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW)"
        root = f"sqrt(sum(ret * ret) {frame})"
        if min_periods:
            return f"CASE WHEN count(ret) {frame} >= {min(min_periods, size)} THEN {root} END"
        return root

    vols = df.selectExpr("*", *[f"{volatility(w)} AS vol_{w}" for w in windows])
    return vols.selectExpr("*", *[f"lead(vol_{w}) OVER ({over}) AS y_{w}" for w in windows])


def _names(columns: Sequence[str]) -> str:
    return ", ".join(f"`{c}`" for c in columns)


def volatility_panel(
    returns: DataFrame,
    windows: Sequence[int] = WINDOWS,
    min_periods: int | None = None,
    tie_break: Sequence[str] = (),
    split: bool = False,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Rolling realised volatility per security and its value on the next row.

    ``vol_w`` is the root of the summed squared returns of the last ``w`` rows,
    shorter at the start of a series unless ``min_periods`` is given; ``y_w`` is
    ``vol_w`` of the security's next row. Rows of one security and date need a
    ``tie_break`` to have an order.

    One exchange and one sort by (PERMNO, date) serve all frames, with one task for
    a series. That fits series of a row for each trading day. With ``split=True``
    series are cut into overlapping chunks instead, for inputs in which one security
    has more rows than a task should hold; the result is the same.
    """
    if split:
        return _chunked_panel(returns, windows, min_periods, tie_break, chunk_rows)
    return _panel_columns(returns, ["PERMNO"], ["date", *tie_break], windows, min_periods)


def _chunked_panel(
    returns: DataFrame, windows: Sequence[int], min_periods: int | None, tie_break: Sequence[str], chunk_rows: int
) -> DataFrame:
    """The same panel when one series is too long for a task.

    A range-partitioned sort spreads a long series over many partitions and gives
    each row its place in its partition. Row counts per (security, partition) turn
    that into the row's position in the series. Series are cut every ``chunk_rows``
    positions; a chunk also gets the rows before it that its frames reach back to,
    and the first row after it, which holds its last target.
    """
    overlap = max(windows) - 1
    if chunk_rows <= overlap:
        raise ValueError("chunk_rows must exceed the longest window")
    order = ["PERMNO", "date", *tie_break]
    kept = returns.columns
    # The sorted rows are stored: positions must not change if a task runs again.
    placed = written(
        returns.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()),
        "series",
    ).withColumn("_part", F.shiftright("_at", 33))
    runs = placed.groupBy("PERMNO", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy("PERMNO").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        F.col("PERMNO").alias("_key"), F.col("_part").alias("_run"), "_first",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
    )
    placed = placed.join(
        runs, F.col("PERMNO").eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_run"))
    ).withColumn("_pos", F.col("_before") + F.col("_at") - F.col("_first"))

    size = F.lit(chunk_rows)
    own = F.floor(F.col("_pos") / size)
    offset = F.col("_pos") % size
    copies = F.array_compact(
        F.array(
            own,
            F.when(offset >= size - F.lit(overlap), own + 1),
            F.when((offset == 0) & (own > 0), own - 1),
        )
    )
    copied = placed.select(*kept, "_pos", own.alias("_own"), F.explode(copies).alias("_chunk"))
    panel = _panel_columns(copied, ["PERMNO", "_chunk"], ["_pos"], windows, min_periods)
    return panel.filter("_own = _chunk").drop("_own", "_chunk", "_pos")


def daily_mean_vol(panel: DataFrame, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """Average volatility over all rows of a date."""
    dated = panel.na.drop(subset=["date"])
    return dated.groupBy("date").agg(*[F.avg(f"vol_{w}").alias(f"v{w}") for w in windows])


def _beta(over):
    frame = over.rowsBetween(-(22 - 1), 0)
    return F.try_divide(F.covar_pop("vol_1", "y_1").over(frame), F.var_pop("vol_1").over(frame))


def rolling_beta_daily(panel: DataFrame) -> DataFrame:
    """22-day beta of next-day on same-day volatility, of the daily means.

    Rows are averaged per date before the ordered window, so the one task that
    runs it sees a row per calendar day, however many rows a day holds.
    """
    daily = (
        panel.na.drop(subset=["date"])
        .groupBy("date")
        .agg(F.avg("vol_1").alias("vol_1"), F.avg("y_1").alias("y_1"))
    )
    return daily.select("date", _beta(Window.orderBy("date")).alias("beta"))


def rolling_beta_by_security(panel: DataFrame) -> DataFrame:
    """The same beta within each security; rows of a security and day are averaged first."""
    daily = (
        panel.na.drop(subset=["date"])
        .groupBy("PERMNO", "date")
        .agg(F.avg("vol_1").alias("vol_1"), F.avg("y_1").alias("y_1"))
    )
    return daily.select("PERMNO", "date", _beta(Window.partitionBy("PERMNO").orderBy("date")).alias("beta"))
