import math
import random

import numpy as np
from hypothesis import given, strategies as st

from pyspark.sql import types as T

from volscribe.operators import quantiles
from volscribe.operators.quantiles import exact_quantiles, from_bits, ordered_bits, pooled_quantiles


@given(st.lists(st.floats(allow_nan=False), min_size=1, max_size=50))
def test_bits_keep_the_order(values):
    bits = ordered_bits(np.array(values))
    assert [from_bits(int(b)) for b in np.sort(bits)] == sorted(v + 0.0 for v in values)


def brute(values, p):
    return sorted(values)[max(1, len(values) - math.floor(len(values) - len(values) * p)) - 1]


def test_quantiles_equal_sorting(spark):
    rng = random.Random(4)
    draws = {"a": lambda: rng.gauss(0, 1), "b": lambda: rng.choice([0.0, -0.0, 1.0]), "c": lambda: rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300), None: lambda: 7.5}
    rows = [(k, draw()) for k, draw in draws.items() for _ in range(700)]
    frame = spark.createDataFrame([*rows, ("a", None), ("a", float("nan")), ("d", None), ("c", math.inf)], "k string, v double").repartition(6)
    probabilities = (0.0, 0.01, 0.5, 0.99, 1.0)
    got = {(r.k, r.probability): r.value for r in exact_quantiles(frame, ("k",), "v", probabilities).collect()}
    rows.append(("c", math.inf))
    assert got == {(k, p): brute([v for g, v in rows if g == k], p) for k in draws for p in probabilities}
    assert exact_quantiles(frame.where("false"), ("k",), "v", probabilities).count() == 0


def test_many_groups(spark):
    rows = [(k % 90, k % 3, float((k * 7919) % 1009)) for k in range(9000)]
    got = exact_quantiles(spark.createDataFrame(rows, "a int, b int, v double"), ("a", "b"), "v", (0.25,)).collect()
    assert len(got) == 90 and all(r.value == brute([v for a, b, v in rows if (a, b) == (r.a, r.b)], 0.25) for r in got)


def test_pools_that_overlap(spark, monkeypatch):
    """Pools share groups, columns have gaps, tasks send their counts early; all agree with sorting."""
    monkeypatch.setattr(quantiles, "HELD", 50)
    rng = random.Random(8)
    rows = [(rng.choice([2000, 2001, 2002, 2004, None]), rng.choice([rng.gauss(0, 1), 0.5, None]), float(rng.randrange(5))) for _ in range(900)]
    rows += [(2009, None, 1.0), (2009, float("nan"), 3.0)]
    frame = spark.createDataFrame(rows, "year int, a double, b double").repartition(5)
    named = T.StructType([T.StructField("start", T.IntegerType())])

    def pools(group):
        return [(None,)] if group[0] is None else [(group[0] - k,) for k in range(3)]

    probabilities = (0.01, 0.4, 1.0)
    got = {(r.start, r.metric, r.probability): r.value for r in pooled_quantiles(frame, ("year",), ("a", "b"), probabilities, pools, named).collect()}
    want = {}
    for start in {p for y, _, _ in rows for (p,) in pools((y,))}:
        for place, name in ((1, "a"), (2, "b")):
            values = [r[place] for r in rows if (start,) in pools((r[0],)) and r[place] is not None and not math.isnan(r[place])]
            want |= {(start, name, p): brute(values, p) for p in probabilities if values}
    assert got == want and (2009, "b", 1.0) in got and (2009, "a", 1.0) not in got
