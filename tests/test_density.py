import numpy as np

from volscribe.operators.diagnostics import kernel_density


def direct(values, x):
    """A sum of Gaussians over all values, with Scott's bandwidth."""
    width = values.std(ddof=1) * len(values) ** -0.2
    return np.exp(-0.5 * ((x[:, None] - values) / width) ** 2).sum(axis=1) / (len(values) * width * np.sqrt(2 * np.pi))


def test_density_equals_a_direct_kernel_sum(spark):
    rng = np.random.default_rng(5)
    near, far = rng.normal(0.02, 0.004, 3000), np.r_[rng.lognormal(-4, 0.7, 2999), 4.0]
    rows = [(float(a), float(b)) for a, b in zip(near, far, strict=True)] + [(None, None)] * 50
    out = kernel_density(spark.createDataFrame(rows, "a double, b double").repartition(5), ["a", "b"], points=101).collect()
    for metric, values in (("a", near), ("b", far)):
        own = sorted((r.point, r.x, r.density) for r in out if r.metric == metric)
        assert [p for p, _, _ in own] == list(range(101))
        x, density = np.array([p[1] for p in own]), np.array([p[2] for p in own])
        assert np.allclose(x, np.linspace(values.min(), values.max(), 101))
        want = direct(values, x)
        # Linear binning at an eighth of a bandwidth is off by less than a few thousandths of the peak.
        assert np.abs(density - want).max() < 3e-3 * want.max()


def test_density_integrates_to_one_and_ignores_layout(spark):
    values = np.random.default_rng(6).normal(0, 1, 2000)
    frame = spark.createDataFrame([(float(v),) for v in values], "a double")
    one, two = (sorted((r.point, r.x, r.density) for r in kernel_density(frame.repartition(n), ["a"], points=400).collect()) for n in (1, 9))
    assert np.allclose(one, two, rtol=1e-12, atol=1e-15)
    x, density = np.array(one)[:, 1], np.array(one)[:, 2]
    assert 0.97 < np.trapezoid(density, x) < 1.0


def test_columns_without_spread_have_no_density(spark):
    rows = [(1.0, None, 2.0), (1.0, 3.0, 4.0)]
    frame = spark.createDataFrame(rows, "a double, b double, c double")
    assert {r.metric for r in kernel_density(frame, ["a", "b", "c"], points=5).collect()} == {"c"}
    assert kernel_density(frame.where("false"), ["a", "b", "c"]).count() == 0
