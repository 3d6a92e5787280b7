"""Exact quantiles by refined histograms."""

import math
import random

import numpy as np
import pytest

from riskscope.operators import evaluate as EV
from riskscope.operators.quantiles import exact_quantiles

PROBS = {"p0": 0.0, "q1": 0.25, "median": 0.5, "p99": 0.99, "p100": 1.0}


def groups():
    rng = random.Random(3)
    out = {
        "uniform": [rng.random() for _ in range(501)],
        "ties": [float(rng.randrange(3)) for _ in range(400)],
        "one value": [7.5] * 90,
        "wide": [rng.choice([-1, 1]) * 10.0 ** rng.randrange(-4, 8) for _ in range(300)],
        "extremes": [1.7e308, -1.7e308, 0.0, -0.0, 5e-324] * 4,
        "infinite": [math.inf] * 30 + [-math.inf] * 20 + [1.0, 2.0],
        "single": [3.0],
        None: [float(i) for i in range(100)],
    }
    return out


@pytest.mark.parametrize("bins, few", [(4_096, 10_000), (256, 20)])
def test_quantiles_equal_numpy(spark, bins, few):
    data = groups()
    rows = [(g, v) for g, vs in data.items() for v in vs] + [("uniform", None), ("uniform", math.nan), ("empty", None)]
    random.Random(1).shuffle(rows)
    got = {r.g: r for r in exact_quantiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", PROBS, bins=bins, few=few).collect()}
    assert got.keys() == {*data, "empty"}
    assert all(got["empty"][n] is None for n in PROBS)
    for g, values in data.items():
        ordered = sorted(values)
        for name, p in PROBS.items():
            at = (len(ordered) - 1) * p
            a, b = ordered[math.floor(at)], ordered[math.ceil(at)]
            want = a if a == b else (math.ceil(at) - at) * a + (at - math.floor(at)) * b
            assert got[g][name] == want or np.isclose(got[g][name], want, rtol=1e-12), (g, name, got[g][name], want)


def test_quantiles_of_an_empty_table_and_of_all_rows(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 4.0)], "a int, x double")
    assert exact_quantiles(df, [], "x", {"m": 0.5}).first().m == 3.0
    assert exact_quantiles(df.limit(0), ["a"], "x", PROBS).collect() == []


def test_no_percentile_in_box_statistics(spark):
    df = spark.createDataFrame([(i % 2, float(i), i) for i in range(50)], "label int, a double, b int")
    out = EV.box_stats(df, ["a", "b"])
    assert "percentile" not in out._jdf.queryExecution().toString()
    assert EV.medians(df, ["a", "b"]) == {"a": 24.5, "b": 24.5}
    assert EV.medians(df.limit(0), ["a"]) == {"a": None}
