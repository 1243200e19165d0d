import math
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from volscribe.operators import panel

from tests.conftest import plan_of

WINDOWS = (1, 5, 22, 63)
SCHEMA = "PERMNO long, date date, ret double"


def make(spark, series):
    import datetime as dt

    start = dt.date(2000, 1, 1)
    rows = [(k, start + dt.timedelta(days=3 * n), r) for k, rets in series.items() for n, r in enumerate(rets)]
    random.Random(7).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def brute(rets, size, min_periods=None):
    out = []
    for t in range(len(rets)):
        frame = [r for r in rets[max(0, t - size + 1): t + 1] if r is not None]
        enough = len(frame) >= (min(min_periods, size) if min_periods else 1)
        out.append(math.sqrt(sum(r * r for r in frame)) if frame and enough else None)
    return out


def close(a, b):
    return (a is None and b is None) or (a is not None and b is not None and abs(a - b) < 1e-12)


def assert_matches(df, series, min_periods=None):
    for key, rets in series.items():
        rows = df.filter(F.col("PERMNO") == key).orderBy("date").collect()
        assert len(rows) == len(rets)
        for size in WINDOWS:
            want = brute(rets, size, min_periods)
            assert all(close(r[f"vol_{size}"], w) for r, w in zip(rows, want))
            assert all(close(r[f"y_{size}"], w) for r, w in zip(rows, want[1:] + [None]))


def sample_series():
    rng = random.Random(3)
    return {
        1: [0.01],
        2: [None, 0.02, None, -0.01],
        3: [None] * 70,
        4: [rng.uniform(-0.1, 0.1) if rng.random() > 0.2 else None for _ in range(300)],
    }


def test_rolling_volatility_matches_a_plain_loop(spark):
    series = sample_series()
    assert_matches(panel.volatility_panel(make(spark, series)), series)


def test_min_periods(spark):
    series = sample_series()
    assert_matches(panel.volatility_panel(make(spark, series), min_periods=5), series, 5)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(-0.5, 0.5)), min_size=1, max_size=90))
def test_rolling_volatility_property(spark, rets):
    series = {9: rets}
    assert_matches(panel.volatility_panel(make(spark, series)), series)


@pytest.mark.parametrize("chunk_rows", [63, 64, 100])
def test_chunked_plan_gives_the_same_panel(spark, chunk_rows):
    rng = random.Random(5)
    # One series holds most rows, as a hot key would.
    series = {1: [rng.uniform(-0.1, 0.1) for _ in range(700)], 2: [0.1, None, 0.2], 3: [0.01] * 63}
    out = panel.volatility_panel(make(spark, series), split=True, chunk_rows=chunk_rows)
    assert out.columns == panel.volatility_panel(make(spark, series), split=False).columns
    assert_matches(out, series)


def test_chunk_must_exceed_the_longest_window(spark):
    with pytest.raises(ValueError):
        panel.volatility_panel(make(spark, {1: [0.1]}), split=True, chunk_rows=62)


def test_one_exchange_and_one_sort(spark, tmp_path):
    make(spark, sample_series()).write.parquet(str(tmp_path / "r"))
    plan = plan_of(panel.volatility_panel(spark.read.parquet(str(tmp_path / "r"))))
    assert plan.count("Exchange") == 1
    assert plan.count("Sort ") == 1


def test_parse_returns_falls_back(spark):
    raw = spark.createDataFrame(
        [
            ("1", "20120103", "0.01", "0.5", None), ("1", "20120104", "C", "0.02", "0.9"),
            ("1", "20120105", "", "B", "-0.3"), ("1", "bad", "C", None, "S"),
        ],
        "PERMNO string, date string, RET string, RETX string, DLRET string",
    )
    got = [(str(r.date), r.ret) for r in panel.parse_returns(raw).collect()]
    assert got == [("2012-01-03", 0.01), ("2012-01-04", 0.02), ("2012-01-05", -0.3), ("None", None)]


def test_daily_means(spark):
    df = panel.volatility_panel(make(spark, {1: [0.1, 0.2], 2: [0.3, None]}))
    rows = panel.daily_mean_vol(df).orderBy("date").collect()
    assert [round(r.v1, 9) for r in rows] == [0.2, 0.2]


def numpy_beta(x, y, size=22):
    out = []
    for t in range(len(x)):
        pairs = [(a, b) for a, b in zip(x[max(0, t - size + 1): t + 1], y[max(0, t - size + 1): t + 1])]
        xs = np.array([a for a, _ in pairs if a is not None])
        both = np.array([(a, b) for a, b in pairs if a is not None and b is not None])
        var = xs.var() if len(xs) else 0
        out.append(np.cov(both.T, bias=True)[0, 1] / var if var > 1e-18 and len(both) else None)
    return out


def test_beta_by_security_and_daily(spark):
    rng = random.Random(1)
    rets = [rng.uniform(-0.1, 0.1) for _ in range(60)]
    df = panel.volatility_panel(make(spark, {1: rets}))
    source = df.orderBy("date").collect()
    want = numpy_beta([r.vol_1 for r in source], [r.y_1 for r in source])
    for out in (panel.rolling_beta_by_security(df), panel.rolling_beta_daily(df)):
        got = [r.beta for r in out.orderBy("date").collect()]
        assert got[0] is None
        assert all(w is None or abs(g - w) < 1e-9 for g, w in zip(got, want))


def test_beta_of_constant_volatility_is_null(spark):
    df = panel.volatility_panel(make(spark, {1: [0.1] * 30}))
    assert {r.beta for r in panel.rolling_beta_by_security(df).collect()} == {None}


def test_daily_beta_averages_before_its_single_task_window(spark, tmp_path):
    df = panel.volatility_panel(make(spark, {1: [0.1, 0.2], 2: [0.3, 0.1]}))
    df.write.parquet(str(tmp_path / "p"))
    plan = plan_of(panel.rolling_beta_daily(spark.read.parquet(str(tmp_path / "p"))))
    assert plan.index("Exchange SinglePartition") < plan.index("HashAggregate")
