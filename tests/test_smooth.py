import numpy as np
import pytest

from kohort.operators.smooth import even_points, local_linear


def brute(x, y, p, h):
    u = (x - p) / h
    w = np.clip(1 - np.abs(u) ** 3, 0, None) ** 3
    if not (w > 0).any():
        return None
    if len(set(x[w > 0])) == 1:
        return np.average(y, weights=w)
    design = np.stack([np.ones_like(u), u], axis=1) * np.sqrt(w)[:, None]
    return np.linalg.lstsq(design, y * np.sqrt(w), rcond=None)[0][0]


@pytest.mark.parametrize("parts", [1, 5])
def test_lines_against_least_squares(spark, parts):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(-40, 60, 400).astype(float), np.full(500, 7.0), [300.0]])
    y = np.sin(x / 9) + rng.standard_normal(len(x))
    rows = [(float(a), float(b), "g") for a, b in zip(x, y)] + [(None, 1.0, "g"), (1.0, None, "g"), (1.0, float("nan"), "g")]
    df = spark.createDataFrame(rows, "x double, y double, g string").repartition(parts)
    points = even_points(df, "x", 31)
    got = {r.point: r.fit for r in local_linear(df, "x", "y", points, 13.0, ["g"]).collect()}
    want = {p: brute(x, y, p, 13.0) for p in np.linspace(x.min(), x.max(), 31)}
    want = {p: v for p, v in want.items() if v is not None}
    assert len(got) == len(want)
    for (p, a), (q, b) in zip(sorted(got.items()), sorted(want.items())):
        assert abs(p - q) < 1e-9 and abs(a - b) < 1e-8


def test_edges(spark):
    empty = spark.createDataFrame([], "x double, y double")
    assert local_linear(empty, "x", "y", even_points(empty, "x"), 1.0).count() == 0
    one = spark.createDataFrame([(2.0, 3.0), (2.0, 5.0)], "x double, y double")
    assert [tuple(r) for r in local_linear(one, "x", "y", even_points(one, "x"), 1.0).collect()] == [(2.0, 4.0)]
    with pytest.raises(ValueError):
        local_linear(one, "x", "y", even_points(one, "x"), 0.0)
    plan = local_linear(one, "x", "y", even_points(one, "x"), 1.0)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
