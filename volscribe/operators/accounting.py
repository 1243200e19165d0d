"""Row accounts: how many rows each stage saw and dropped, counted while it is written.

Counts are observed metrics of the pass that writes the stage, so nothing is run again
for them. They are exact when no shuffle follows the observed frame in that pass, for
the scheduler then counts each finished task once, also after an executor was lost.
``Accounts.stored`` observes a frame right where it is written.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from volscribe.session import written

SCHEMA = "stage string, reason string, rows bigint, dropped bigint"


class Accounts:
    """The accounts of one run. A stage is listed once its frame has been written."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._stages: list[tuple[str, tuple[str, ...], Observation]] = []

    def observed(self, df: DataFrame, stage: str, reasons: Mapping[str, Column] | None = None, drop: bool = True) -> DataFrame:
        """``df`` without the rows that some condition in ``reasons`` holds for, counted.

        The first condition that holds is a row's reason. A null condition does not hold.
        With ``drop`` false these rows are counted all the same, and stay.
        """
        names, first, name = tuple(reasons or ()), None, "_reason"
        while name in df.columns:
            name += "_"
        for k, (_, condition) in enumerate((reasons or {}).items()):
            first = F.when(condition, k) if first is None else first.when(condition, k)
        seen = Observation(f"{stage} {uuid.uuid4().hex[:12]}")
        self._stages.append((stage, names, seen))
        metrics = [F.count(F.lit(1)).alias("seen")]
        if first is None:
            return df.observe(seen, *metrics)
        metrics += [F.count_if(F.col(name) == k).alias(f"dropped_{k}") for k in range(len(names))]
        counted = df.withColumn(name, first).observe(seen, *metrics)
        return (counted.where(F.col(name).isNull()) if drop else counted).drop(name)

    def stored(self, df: DataFrame, stage: str, reasons: Mapping[str, Column] | None = None, drop: bool = True) -> DataFrame:
        """As ``observed``, written to the shared folder and read back."""
        return written(self.observed(df, stage, reasons, drop), "accounted")

    def run(self, df: DataFrame, stage: str, reasons: Mapping[str, Column] | None = None) -> None:
        """Count a last stage whose rows nobody needs."""
        self.observed(df, stage, reasons).write.format("noop").mode("overwrite").save()

    def counts(self) -> dict[str, tuple[int, dict[str, int]]]:
        """Rows seen and dropped by reason, for each stage."""
        found = [(stage, names, seen.get) for stage, names, seen in self._stages]
        return {stage: (got["seen"], {name: got[f"dropped_{k}"] for k, name in enumerate(names)}) for stage, names, got in found}

    def frame(self) -> DataFrame:
        """stage, reason, rows (seen by the stage) and dropped (for that reason), one row for each reason.

        A stage that drops nothing has one row without a reason. All stages must have
        been written; the number of rows here is that of stages and reasons.
        """
        rows = []
        for stage, (seen, dropped) in self.counts().items():
            rows += [(stage, name, seen, n) for name, n in dropped.items()] or [(stage, None, seen, 0)]
        return self.spark.createDataFrame(rows, SCHEMA)
