import math
import re
from pathlib import Path

import duckdb
import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.sql import functions as F

import __spark_entry__ as contract
from tests.conftest import SF
from volscribe.functions.dates import year_range
from volscribe.operators import ridge
from volscribe.plans import pipelines
from volscribe.plans.queries import ORACLES, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

# No SQL: cross-validated model fits, which are compared with Spark ML below.
WITHOUT_SQL = {
    "sink_model", "ridge_cv", "ridge_cv_spark_ml", "ridge_walk_forward", "ridge_walk_forward_security_day",
    "best_lambda", "text_to_forecast", "mean_window_metrics_ridge", "elastic_net_walk_forward",
    "sink_model_table",
}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return None if value is None else str(value)


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted((tuple(plain(r[k]) for k in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cursor = duck.execute(ORACLES[name])
    want = table_of([c[0] for c in cursor.description], cursor.fetchall())
    got = table_of(df.columns, df.collect())
    assert got == want
    assert got[1], "the query gave no rows"


def test_every_query_has_sql_but_the_listed_ones():
    assert QUERIES.keys() - ORACLES.keys() == WITHOUT_SQL
    assert ORACLES.keys() <= QUERIES.keys()


def test_contract_has_all_queries():
    assert QUERIES.items() <= contract.queries().items()
    assert ORACLES.items() <= contract.oracle_sql().items()
    assert contract.oracle_sql().keys() <= contract.queries().keys()


def evaluated(model, test):
    metrics = RegressionEvaluator(labelCol="label", metricName="mse")
    return metrics.evaluate(model.transform(test)), metrics.setMetricName("r2").evaluate(model.transform(test))


@pytest.mark.parametrize("grain", ["post", "security_day"])
def test_ridge_queries_equal_spark_ml(spark, inputs, grain):
    """Each window of the registered queries, fitted and scored by the library's own cross-validation."""
    frames = (inputs.texts(), inputs.securities(), inputs.ticker_map(), inputs.panel("symbol"), inputs.embeddings())
    rows = ridge.design_rows(pipelines.linked_with_vectors(*frames), grain=grain).persist()
    name = "ridge_walk_forward" if grain == "post" else "ridge_walk_forward_security_day"
    got = {r.train_start: r for r in QUERIES[name](spark, SF).collect()}
    years = {r.y: r.n for r in rows.groupBy(F.year("date").alias("y")).agg(F.count("*").alias("n")).collect()}
    scores = []
    for start, row in got.items():
        train = {y: years[y] for y in range(start, start + 3) if y in years}
        n_test = years.get(start + 4, 0)
        assert (row.n_train, row.n_test) == (sum(train.values()), n_test)
        assert row.usable == (n_test > 0 and row.n_train >= 100)
        if row.usable:
            model = ridge.ridge_cv(ridge.ml_rows(rows.filter(year_range("date", start, start + 2))))
            mse, r2 = evaluated(model.bestModel, ridge.ml_rows(rows.filter(year_range("date", start + 4, start + 4))))
            assert row.best_lambda == model.bestModel.getRegParam() and row.mse == pytest.approx(mse, abs=2e-8)
            scores.append((start, model, mse, r2))
        else:
            assert row.best_lambda is None and row.mse is None
    if grain == "post":
        best = {r.train_start: r.best_lambda for r in QUERIES["best_lambda"](spark, SF).collect()}
        assert best == {start: model.bestModel.getRegParam() for start, model, _, _ in scores}
        errors = {(r.train_start, r.penalty): r.cv_mse for r in QUERIES["ridge_cv"](spark, SF).collect()}
        want = {(s, p): e for s, m, _, _ in scores for p, e in zip(ridge.PENALTIES, m.avgMetrics, strict=True)}
        assert errors.keys() == want.keys() and all(errors[k] == pytest.approx(want[k], rel=1e-6) for k in want)
        if scores:
            mean = QUERIES["mean_window_metrics_ridge"](spark, SF).first()
            assert mean.windows == len(scores) and mean.mse == pytest.approx(sum(s[2] for s in scores) / len(scores), abs=2e-8)
            table = {r.train_start: (r.n, r.mse) for r in QUERIES["sink_model_table"](spark, SF).collect()}
            assert table.keys() == {s[0] for s in scores}
            assert all(table[s][0] == got[s].n_test and table[s][1] == pytest.approx(mse, abs=2e-8) for s, _, mse, _ in scores)
            guards = {r.train_start: r.usable for r in QUERIES["window_row_guards_ridge"](spark, SF).collect()}
            assert guards == {start: r.usable for start, r in got.items()}
            saved = QUERIES["sink_model"](spark, SF).first()
            assert saved.mse == pytest.approx(max(scores, key=lambda s: s[0])[2], abs=2e-8)
    rows.unpersist()


def test_forecast_pipeline_has_every_window(spark):
    got = {r.train_start: r for r in QUERIES["text_to_forecast"](spark, SF).collect()}
    assert got and all((r.best_lambda is None) == (not r.usable) for r in got.values())


def test_entry_gives_rows(spark):
    df = contract.entry(spark)
    assert df.count() > 0
    assert {"r_id", "r_ticker", "PERMNO", "c_vol_1", "c_y_1"} <= set(df.columns)


def test_sources_hold_no_forbidden_calls():
    for source in (Path(contract.__file__).parent / "volscribe").rglob("*.py"):
        assert not re.search(r"localCheckpoint|crossJoin|toPandas\(|\.collect\(\)", source.read_text()), source
