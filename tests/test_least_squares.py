"""Bounded least squares against scipy-free references: closed forms, dense grids and the gradient at the answer."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from halocline.functions import dual
from halocline.operators import fitting
from halocline.operators.least_squares import CONVERGED, FLAT, NO_ROWS, UNFINISHED, least_squares_fit


def test_derivatives_of_columns(spark):
    x, y = dual.Dual(F.col("x"), {"x": F.lit(1.0)}), dual.Dual(F.col("y"), {"y": F.lit(1.0)})
    c = dual.col("c")
    forms = {
        "a": (dual.exp(x * y) + c / y - 3.0, lambda x, y, c: math.exp(x * y) + c / y - 3),
        "b": (2.0 / dual.sqrt(x + y * y) - dual.log(x) * c, lambda x, y, c: 2 / math.sqrt(x + y * y) - math.log(x) * c),
        "d": (c - dual.tanh(x - y) ** 3 + dual.atan(x / y), lambda x, y, c: c - math.tanh(x - y) ** 3 + math.atan(x / y)),
        "e": (dual.where(F.col("x") > 1.0, dual.sin(x) * 2.0, dual.cos(-y)) * x, lambda x, y, c: (math.sin(x) * 2 if x > 1 else math.cos(-y)) * x),
    }
    pts = [(0.7, 1.3, 2.0), (2.1, 0.4, -1.0)]
    df = spark.createDataFrame(pts, "x double, y double, c double")
    for name, (d, f) in forms.items():
        got = df.select(d.value, *[d.slopes.get(n, F.lit(0.0)) for n in "xy"]).collect()
        for (x0, y0, c0), r in zip(pts, got):
            h = 1e-6
            want = (f(x0, y0, c0), (f(x0 + h, y0, c0) - f(x0 - h, y0, c0)) / (2 * h), (f(x0, y0 + h, c0) - f(x0, y0 - h, c0)) / (2 * h))
            assert np.allclose(tuple(r), want, rtol=1e-7, atol=1e-7), name


MODEL = lambda p: p["v0"] * (1.0 - dual.exp(-dual.col("r") / p["a"]))


def curves(spark, truth, noise=0.0, n=60):
    rng = np.random.default_rng(4)
    rows = [(k, float(r), v * (1 - math.exp(-r / a)) + noise * float(rng.normal()), 1.0 + k % 3) for k, (v, a) in truth.items() for r in np.linspace(0.3, 30, n)]
    return spark.createDataFrame(rows, "k long, r double, v double, s double").repartition(4)


def test_exact_curves_are_recovered(spark):
    truth = {i: (100.0 + 37 * i, 1.5 + 0.8 * i) for i in range(12)}
    out = least_squares_fit(curves(spark, truth), MODEL, {"v0": 50.0, "a": 5.0}, observed="v", sigma="s", bounds={"v0": (1, 1000), "a": (0.1, 50)}, group_cols=["k"]).collect()
    assert len(out) == len(truth)
    for r in out:
        assert r.success and r.message in (CONVERGED, FLAT) and r.n == 60 and r.passes < 30
        assert r.v0 == pytest.approx(truth[r.k][0], rel=1e-8) and r.a == pytest.approx(truth[r.k][1], rel=1e-8)


def test_noisy_curves_have_no_gradient_left_and_beat_a_grid(spark):
    df = curves(spark, {i: (150.0, 2.0 + i) for i in range(4)}, noise=12.0)
    fit = {r.k: r for r in least_squares_fit(df, MODEL, {"v0": 90.0, "a": 9.0}, observed="v", sigma="s", bounds={"v0": (50, 400), "a": (1, 20)}, group_cols=["k"]).collect()}
    pdf = df.toPandas()
    for k, f in fit.items():
        d = pdf[pdf.k == k]
        e = np.exp(-d.r / f.a)
        pull = (f.v0 * (1 - e) - d.v) / d.s
        jac = np.column_stack([(1 - e) / d.s, -f.v0 * e * d.r / f.a**2 / d.s])
        assert (np.abs(jac.T @ pull) < 1e-7 * np.linalg.norm(jac, axis=0) * np.linalg.norm(pull)).all()
        assert f.chi2 == pytest.approx((pull**2).sum(), rel=1e-10)
    scan = fitting.parameter_scan(df, lambda p: p["v0"] * (F.lit(1.0) - F.exp(-F.col("r") / p["a"])), {"v0": (50, 400), "a": (1, 20)}, observed="v", sigma="s", refinements=1, group_cols=["k"])
    assert all(fit[r.k].chi2 <= r.chi2 + 1e-9 for r in scan.collect())


def test_bounds_hold_and_are_a_success(spark):
    df = curves(spark, {1: (300.0, 4.0)})
    r = least_squares_fit(df, MODEL, {"v0": 100.0, "a": 2.0}, observed="v", bounds={"v0": (50, 200), "a": (0.5, 20)}).first()
    assert r.success and r.v0 == 200.0
    best = min(((200 * (1 - np.exp(-p.r / a)) - p.v) ** 2).sum() for p in [df.toPandas()] for a in np.linspace(r.a - 0.01, r.a + 0.01, 201))
    assert r.chi2 == pytest.approx(best, rel=1e-8)
    both = least_squares_fit(df, MODEL, {"v0": 1.0, "a": 99.0}, observed="v", bounds={"v0": (50, 60), "a": (5, 6)}).first()
    assert both.success and (both.v0, both.a) == (60.0, 5.0)


def test_linear_models_take_their_closed_form(spark):
    df = curves(spark, {1: (100.0, 3.0), 2: (50.0, 9.0)}, noise=3.0)
    line = lambda p: p["c"] + p["m"] * dual.col("r")
    for r in least_squares_fit(df, line, {"c": 0.0, "m": 0.0}, observed="v", sigma="s", group_cols=["k"]).collect():
        d = df.filter(F.col("k") == r.k).toPandas()
        m, c = np.polyfit(d.r, d.v, 1, w=1 / d.s)
        assert r.success and (r.m, r.c) == (pytest.approx(m, rel=1e-8), pytest.approx(c, rel=1e-8))


def test_odd_groups(spark):
    rows = [("none", 1.0, None, 1.0), ("zero", 1.0, 2.0, 0.0), ("nan", float("nan"), 2.0, 1.0), ("one", 2.0, 5.0, 1.0), (None, 1.0, 7.0, 1.0), (None, 2.0, 7.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, r double, v double, s double")
    fit = lambda d, **kw: {r.k: r for r in least_squares_fit(d, lambda p: p["c"] + dual.col("r") * 0.0, {"c": 1.0}, observed="v", sigma="s", group_cols=["k"], **kw).collect()}
    got = fit(df)
    assert all(not got[k].success and got[k].message == NO_ROWS and got[k].n == 0 for k in ("none", "zero", "nan"))
    assert got["one"].c == pytest.approx(5.0) and got[None].c == pytest.approx(7.0) and got[None].n == 2
    assert fit(df.limit(0)) == {}
    assert got["one"].success and not fit(df, max_passes=1)["one"].success and fit(df, max_passes=1)["one"].message == UNFINISHED
