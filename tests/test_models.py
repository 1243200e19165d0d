import datetime as dt
import math

import numpy as np
import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import functions as F

from tests.conftest import rows_of
from volscribe.operators import aggregates, ols, quantiles, ridge, windows
from volscribe.operators.windows import ROLLING_FOUR, THREE_AND_GAP, Scheme
from volscribe.sources.sinks import save_model


@pytest.fixture(scope="module")
def har(spark):
    rng = np.random.default_rng(0)
    rows = []
    for year in (2000, 2001, 2002, 2003, 2004, 2005, 2007, 2008):
        for n in range(60):
            x = np.abs(rng.normal(0.03, 0.02, 4)).cumsum()
            y = 0.01 + x @ [0.3, 0.1, -0.05, 0.02] + rng.normal(0, 0.01)
            rows.append((n % 5, dt.date(year, 1, 1) + dt.timedelta(days=n), float(y), *map(float, x)))
    return spark.createDataFrame(rows, "PERMNO int, date date, y_1 double, vol_1 double, vol_5 double, vol_22 double, vol_63 double").cache()


def between(df, first, last):
    return df.filter(F.year("date").between(first, last))


def ml(df):
    return ols.assemble_features(df)


def evaluate(model, df, label="y_1"):
    scored = model.transform(df)
    return [RegressionEvaluator(labelCol=label, metricName=m).evaluate(scored) for m in ("mse", "r2")]


def test_walk_forward_equals_spark_ml(har):
    fits = {r.test_start: r for r in ols.walk_forward(har).collect()}
    # 2007 lacks 2006 in its history, 2008 too.
    assert sorted(fits) == [2004, 2005]
    for test, fit in fits.items():
        model = LinearRegression(labelCol="y_1", solver="normal").fit(ml(between(har, test - 4, test - 1)))
        assert np.allclose(fit.coefficients, model.coefficients.toArray(), atol=1e-9)
        assert abs(fit.intercept - model.intercept) < 1e-9
        assert np.allclose([fit.mse, fit.r2], evaluate(model, ml(between(har, test, test))), atol=1e-9)
        assert (fit.train_start, fit.train_end, fit.test_end, fit.n_train, fit.n_test) == (test - 4, test - 1, test, 240, 60)


def test_predictions_and_metrics(har):
    fits = ols.walk_forward(har)
    scored = ols.predict(har, fits)
    got = {r.year: r for r in aggregates.regression_metrics(scored, "y_1", by=("year",)).collect()}
    for fit in fits.collect():
        assert abs(got[fit.test_start].mse - fit.mse) < 1e-12 and abs(got[fit.test_start].r2 - fit.r2) < 1e-9
    pooled = ols.pooled_out_of_sample(fits).first()
    whole = aggregates.regression_metrics(scored, "y_1").first()
    assert np.allclose([pooled.n, pooled.mse, pooled.r2], [whole.n, whole.mse, whole.r2])


def test_pooled_refit(har):
    row = ols.pooled_refit(har, shift=3).first()
    part = between(har, 2007, 2008)
    model = LinearRegression(labelCol="y_1", solver="normal").fit(ml(part))
    assert (row.first_year, row.n) == (2007, 120)
    assert np.allclose([row.mse, row.r2], evaluate(model, ml(part)), atol=1e-9)
    assert ols.pooled_refit(har, shift=10).count() == 0


def test_collinear_lags_still_predict(har):
    same = har.withColumn("vol_5", F.col("vol_1"))
    fit = ols.walk_forward(same).first()
    assert np.isfinite(fit.mse) and fit.r2 > 0.1


def test_nearly_equal_lags_keep_their_digits(spark):
    """Slopes of lags that differ by 3e-9 come out right, where products of sums lose them."""
    rng = np.random.default_rng(9)
    rows, truth = [], np.array([0.5, -0.25, 0.2, 0.1])
    for year in range(2000, 2005):
        for n in range(400):
            a, b, c = rng.normal(0.3, 0.05, 3)
            lags = np.array([a, a + 3e-9 * rng.normal(), b, c])
            rows.append((n, dt.date(year, 1, 1) + dt.timedelta(days=n % 360), *map(float, lags), float(0.01 + lags @ truth)))
    frame = spark.createDataFrame(rows, "PERMNO int, date date, vol_1 double, vol_5 double, vol_22 double, vol_63 double, y_1 double").repartition(11)
    fit = ols.walk_forward(frame).first()
    assert np.allclose(fit.coefficients, truth, atol=1e-6) and fit.mse < 1e-20
    data = np.array([r[2:] for r in rows if r[1].year < 2004])
    cov = np.cov(data.T, bias=True)
    lost = np.linalg.lstsq(cov[:-1, :-1], cov[:-1, -1], rcond=None)[0]
    assert np.abs(lost - truth).max() > 1e-3


def test_factors_do_not_depend_on_partitions(har):
    one, many = (sorted(ols.walk_forward(har.repartition(n)).collect()) for n in (1, 13))
    assert all(np.allclose(a.coefficients, b.coefficients, atol=1e-10) and abs(a.mse - b.mse) < 1e-13 for a, b in zip(one, many, strict=True))


def test_winsor_bounds_come_from_training_years_alone(har):
    plain = {(r.train_start, r.metric): (r.low, r.high) for r in ols.winsor_bounds(har).collect()}
    wild = har.withColumn("vol_1", F.when(F.year("date") == 2004, F.col("vol_1") * 1000).otherwise(F.col("vol_1")))
    moved = {(r.train_start, r.metric): (r.low, r.high) for r in ols.winsor_bounds(wild).collect()}
    assert {s for s, m in plain if plain[s, m] != moved[s, m]} == {2001, 2002, 2003, 2004}
    usable = {r.train_start for r in ols.winsorised_walk_forward(har).collect()}
    assert usable == {r.train_start for r in ols.walk_forward(har).collect()}
    start = min(usable)
    rows = ols.winsorised_rows(har, tail=0.05).where(F.col("train_start") == start)
    bounds = {r.metric: (r.low, r.high) for r in ols.winsor_bounds(har, tail=0.05).where(F.col("train_start") == start).collect()}
    for name in ols.FEATURES:
        low, high = rows.agg(F.min(name), F.max(name)).first()
        assert bounds[name] == (low, high)
    raw = sorted(r.y_1 for r in between(har, start + 4, start + 4).collect())
    assert sorted(r.y_1 for r in rows.where("role = 'test'").collect()) == raw


def test_winsor_bounds_keep_each_row_once(har, monkeypatch):
    """A year's rows are stored and counted once, not again for every window and column."""
    kept, written = [], quantiles.written

    def seen(df, label="stage"):
        out = written(df, label)
        kept.append(out.count())
        return out

    monkeypatch.setattr(quantiles, "written", seen)
    ols.winsor_bounds(har)
    assert 0 < sum(kept) <= har.count()


def test_log_rows(spark):
    frame = spark.createDataFrame([(0.0, 1.0), (math.e, 1e-9)], "vol_1 double, y_1 double")
    got = rows_of(ols.log_rows(frame, ("vol_1", "y_1"), least=1e-6))
    assert np.allclose(got, sorted([(math.log(1e-6), 0.0), (1.0, math.log(1e-6))], key=repr))


def test_row_scores_equal_the_window_errors(linked):
    rows = ridge.design_rows(linked)
    fits = ridge.ridge_walk_forward(rows).cache()
    scored = aggregates.regression_metrics(ridge.scored_rows(rows, fits), "y", by=("train_start",)).collect()
    want = {f.train_start: f for f in fits.filter("usable").collect()}
    assert {r.train_start for r in scored} == want.keys()
    for r in scored:
        assert r.n == want[r.train_start].n_test and np.allclose([r.mse, r.r2], [want[r.train_start].mse, want[r.train_start].r2], rtol=1e-9)


def test_gram_matrix(har):
    rows = ols.gram_matrix(har, F.year("date").alias("year")).filter("year = 2000").collect()
    data = np.array([(1.0, r.vol_1, r.vol_5, r.vol_22, r.vol_63, r.y_1) for r in between(har, 2000, 2000).collect()])
    names = ["one", "vol_1", "vol_5", "vol_22", "vol_63", "y_1"]
    product = data.T @ data
    assert len(rows) == 21
    for r in rows:
        assert abs(r.total - product[names.index(r.left_term), names.index(r.right_term)]) < 1e-9


def test_mean_window_metrics(har):
    fits = ols.walk_forward(har)
    got, rows = aggregates.mean_window_metrics(fits).first(), fits.collect()
    assert got.windows == 2
    assert abs(got.mse - np.mean([r.mse for r in rows])) < 1e-12
    assert abs(got.mse_by_row - np.average([r.mse for r in rows], weights=[r.n_test for r in rows])) < 1e-12


def test_guards(har):
    rows = {r.test_start: r for r in windows.window_row_guards(har, ROLLING_FOUR).collect()}
    assert [t for t, r in sorted(rows.items()) if r.usable] == [2004, 2005]
    assert rows[2007].train_years == 3 and rows[2007].n_test == 60
    assert rows[2006].n_test == 0
    lenient = windows.window_row_guards(har, ROLLING_FOUR, all_train_years=False, min_train_rows=180)
    assert {r.test_start for r in lenient.filter("usable").collect()} == {2003, 2004, 2005, 2007, 2008}
    assert windows.window_row_guards(har, ROLLING_FOUR, min_train_rows=241).filter("usable").count() == 0


def test_scheme_offsets():
    assert (THREE_AND_GAP.test_offset, ROLLING_FOUR.test_offset, Scheme(2, 3).test_offset) == (4, 4, 5)


DIM = 5


@pytest.fixture(scope="module")
def linked(spark):
    rng = np.random.default_rng(2)
    rows = []
    for year in range(2000, 2007):
        for n in range(80):
            lags, vector = rng.normal(0.05, 0.02, 4), rng.normal(0, 1, DIM).astype(np.float32)
            y = lags @ [0.4, 0.1, 0.1, 0.05] + 0.01 * vector[0] + rng.normal(0, 0.01)
            day = dt.date(year, 2, 1) + dt.timedelta(days=n // 4)
            rows.append((f"p{year}-{n}", "T", n % 2, day, *map(float, lags), float(y), None if n % 20 == 0 else vector.tolist()))
    return spark.createDataFrame(
        rows,
        "r_id string, r_ticker string, PERMNO int, c_date date, c_vol_1 double, c_vol_5 double, c_vol_22 double, "
        "c_vol_63 double, c_y_1 double, r_embed array<float>",
    ).cache()


def test_rows_without_vectors_are_dropped(linked):
    rows = ridge.design_rows(linked)
    assert rows.count() == linked.filter("r_embed is not null").count() == 7 * 76
    assert {r.size for r in rows.select(F.size("x").alias("size")).collect()} == {4 + DIM}


def test_cross_products_do_not_depend_on_partitions(linked):
    def total(df):
        return {(r.year, r.fold, r.i): np.array(r["values"]) for r in ridge.cross_products(df).collect()}

    rows = ridge.design_rows(linked)
    one, many = total(rows.coalesce(1)), total(rows.repartition(11))
    assert one.keys() == many.keys()
    assert all(np.allclose(one[k], many[k], rtol=1e-12) for k in one)


def test_ridge_equals_spark_ml_cross_validation(linked):
    rows = ridge.design_rows(linked)
    fits = ridge.ridge_walk_forward(rows, start_year=2000, end_year=2006, min_train_rows=100).filter("usable").collect()
    assert sorted(f.train_start for f in fits) == [2000, 2001]
    fit = next(f for f in fits if f.train_start == 2001)
    train = ridge.ml_rows(between(rows, 2001, 2003))
    model = ridge.ridge_cv(train)
    assert np.allclose(fit.cv_mse, model.avgMetrics, rtol=1e-7)
    assert fit.best_lambda == model.bestModel.getRegParam()
    assert np.allclose(fit.coefficients, model.bestModel.coefficients.toArray(), atol=1e-8)
    assert abs(fit.intercept - model.bestModel.intercept) < 1e-8
    tested = ridge.ml_rows(between(rows, 2005, 2005))
    assert np.allclose([fit.mse, fit.r2], evaluate(model.bestModel, tested, "label"), rtol=1e-6)
    assert (fit.n_train, fit.n_test, fit.train_end, fit.test_start) == (228, 76, 2003, 2005)


@pytest.mark.parametrize("alpha", [0.3, 1.0])
def test_elastic_net_equals_spark_ml_in_every_window(linked, alpha):
    rows = ridge.design_rows(linked)
    fits = ridge.ridge_walk_forward(rows, alpha=alpha, all_train_years=True).filter("usable").collect()
    assert sorted(f.train_start for f in fits) == [2000, 2001, 2002]
    for fit in fits:
        train = ridge.ml_rows(between(rows, fit.train_start, fit.train_end)).cache()
        errors = []
        for penalty in ridge.PENALTIES:
            model = ridge.linear_regression(penalty, alpha).setTol(1e-13).setMaxIter(2000)
            errors.append(np.mean([evaluate(model.fit(train.filter(F.col("fold") != k)), train.filter(F.col("fold") == k), "label")[0] for k in range(ridge.FOLDS)]))
        assert np.allclose(fit.cv_mse, errors, rtol=1e-6)
        assert fit.best_lambda == ridge.PENALTIES[int(np.argmin(errors))]
        best = ridge.linear_regression(fit.best_lambda, alpha).setTol(1e-13).setMaxIter(2000).fit(train)
        assert np.allclose(fit.coefficients, best.coefficients.toArray(), atol=1e-6) and abs(fit.intercept - best.intercept) < 1e-6
        tested = ridge.ml_rows(between(rows, fit.test_start, fit.test_end))
        assert np.allclose([fit.mse, fit.r2], evaluate(best, tested, "label"), rtol=1e-6)
        train.unpersist()


def test_elastic_net_without_absolute_part_is_ridge(linked):
    rows = ridge.design_rows(linked)
    plain, tiny = (sorted(ridge.ridge_walk_forward(rows, alpha=a).filter("usable").collect()) for a in (0.0, 1e-9))
    for one, other in zip(plain, tiny, strict=True):
        assert one.best_lambda == other.best_lambda and np.allclose(one.coefficients, other.coefficients, atol=1e-7)
        assert np.allclose(one.cv_mse, other.cv_mse, rtol=1e-6)


def test_coordinate_descent_meets_the_optimality_conditions():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 30)) @ rng.normal(size=(30, 30))
    x = (x - x.mean(0)) / x.std(0)
    a, t, l1, l2 = x.T @ x / 60, x.T @ rng.normal(size=60) / 60, 0.05, 0.02
    slopes = ridge._descended(a, t, l1, l2, np.zeros(30))
    gradient = t - a @ slopes - l2 * slopes
    used = slopes != 0
    assert 0 < used.sum() < 30 and np.allclose(gradient[used], l1 * np.sign(slopes[used]), atol=1e-8) and (np.abs(gradient[~used]) <= l1 + 1e-8).all()


def test_constant_features_get_no_weight(linked):
    flat = linked.withColumn("c_vol_63", F.lit(0.1))
    fit = ridge.ridge_walk_forward(ridge.design_rows(flat), start_year=2000, end_year=2005).first()
    assert fit.coefficients[3] == 0.0 and np.isfinite(fit.mse)


def test_small_windows_are_skipped(linked):
    rows = ridge.design_rows(linked)
    few = ridge.ridge_walk_forward(rows, min_train_rows=229).collect()
    assert few and not any(f.usable for f in few) and max(f.n_train for f in few) == 228
    # No test year after 2006, and training years before 2000 are missing.
    windows = {f.train_start: f for f in ridge.ridge_walk_forward(rows, min_train_rows=1, all_train_years=True).collect()}
    assert {start for start, f in windows.items() if f.usable} == {2000, 2001, 2002}
    assert windows[1999].n_train == 152 and windows[1999].mse is None and windows[1999].train_end == 2001
    assert ridge.mean_metrics(ridge.ridge_walk_forward(rows, all_train_years=True)).first().windows == 3
    assert {f.train_start for f in ridge.ridge_walk_forward(rows).filter("usable").collect()} == {1999, 2000, 2001, 2002}


def test_security_day_grain(linked):
    rows = ridge.design_rows(linked, grain="security_day")
    # The lags of this made-up panel differ by text, so each text is its own day here.
    assert rows.count() == 7 * 76
    shared = linked.withColumns({c: F.lit(0.1) for c in ("c_vol_1", "c_vol_5", "c_vol_22", "c_vol_63", "c_y_1")})
    merged = ridge.design_rows(shared, grain="security_day")
    assert merged.count() == shared.na.drop(subset=["r_embed"]).select("PERMNO", "c_date").distinct().count()
    with pytest.raises(ValueError):
        ridge.design_rows(linked, grain="week")


def test_scores_and_best_lambda(linked):
    fits = ridge.ridge_walk_forward(ridge.design_rows(linked))
    scores, best = ridge.cv_scores(fits).collect(), {r.train_start: r.best_lambda for r in ridge.best_lambda(fits).collect()}
    for start, chosen in best.items():
        by_penalty = {r.penalty: r.cv_mse for r in scores if r.train_start == start}
        assert len(by_penalty) == 5 and min(by_penalty, key=by_penalty.get) == chosen


def test_model_is_saved_and_reloaded(linked, tmp_path):
    rows = ridge.ml_rows(ridge.design_rows(linked))
    model = ridge.linear_regression(0.1).fit(rows)
    path = str(tmp_path / "m")
    save_model(model, path)
    save_model(model, path)
    again = LinearRegressionModel.load(path)
    fits = ridge.ridge_walk_forward(ridge.design_rows(linked))
    best, test = ridge.last_window_model(ridge.design_rows(linked), fits)
    last = fits.filter("usable").orderBy(F.desc("train_start")).first()
    assert best.getRegParam() == last.best_lambda and test.count() == last.n_test
    assert np.allclose(evaluate(best, test, "label"), [last.mse, last.r2], rtol=1e-6)
    assert np.allclose(again.coefficients.toArray(), model.coefficients.toArray())
