import pytest
from pyspark.sql import functions as F

from tests.conftest import SF, plan_of
from volscribe.operators.accounting import Accounts
from volscribe.operators import accounting
from volscribe.plans import pipelines
from volscribe.plans.queries import QUERIES


def test_the_first_reason_counts(spark):
    rows = spark.createDataFrame([(k, None if k % 5 == 0 else k) for k in range(100)], "id long, value long").withColumn("_reason", F.lit("own"))
    accounts = Accounts(spark)
    kept = accounts.stored(rows.repartition(7), "first", {"missing": F.col("value").isNull(), "even": F.col("id") % 2 == 0, "never": F.col("value") > 1000})
    again = accounts.stored(kept, "second")
    flagged = accounts.stored(kept, "third", {"large": F.col("id") > 50}, drop=False)
    assert kept.columns == rows.columns and kept.count() == again.count() == flagged.count() == 40
    got = [tuple(r) for r in accounts.frame().collect()]
    large = sum(1 for k in range(51, 100) if k % 5 and k % 2)
    assert got == [("first", "missing", 100, 20), ("first", "even", 100, 40), ("first", "never", 100, 0), ("second", None, 40, 0), ("third", "large", 40, large)]


def test_an_empty_stage_has_zero_rows(spark):
    accounts = Accounts(spark)
    accounts.run(spark.range(5).where("id < 0"), "none", {"any": F.col("id") >= 0})
    assert [tuple(r) for r in accounts.frame().collect()] == [("none", "any", 0, 0)]


@pytest.mark.parametrize("name", ["row_accounts", "count_rows"])
def test_texts_are_scanned_once(spark, monkeypatch, name):
    """Over all that a query writes, each table of texts is read by a single scan, and counts add no scan."""
    plans = []

    def recording(module):
        write = module.written

        def written(df, label="stage"):
            plans.append(plan_of(df))
            return write(df, label)

        monkeypatch.setattr(module, "written", written)

    recording(pipelines)
    recording(accounting)
    QUERIES[name](spark, SF).collect()
    scans = "\n".join(line for plan in plans for line in plan.splitlines() if "FileScan" in line)
    assert scans.count("conversations.parquet") == 1
    # Posts are read once; vectors are derived from documents too.
    assert sum("documents.parquet" in line and "text" in line.split("[")[1].split("]")[0] for line in scans.splitlines()) == 1
