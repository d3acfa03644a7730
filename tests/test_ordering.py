"""Order-based operators give the same result for any number of partitions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from halocline.operators import curves, keys, ordering, splines

PARTITIONS = [None, 1, 2, 12, 60]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    n = 600
    # a third of all rows share one radius, and one group holds most rows
    pdf = pd.DataFrame(
        {
            "g": np.where(rng.random(n) < 0.7, "big", rng.choice(["a", "b"], n)),
            "id": np.arange(n),
            "x": np.where(rng.random(n) < 0.35, 5.0, rng.integers(0, 120, n) / 10.0),
            "w": rng.integers(1, 9, n) / 8.0,
        }
    )
    return pdf, spark.createDataFrame(pdf).repartition(5).cache()


def _sorted(pdf, by):
    return pdf.sort_values(by).reset_index(drop=True)


@pytest.mark.parametrize("partitions", PARTITIONS)
def test_running_totals(rows, partitions):
    pdf, df = rows
    out = ordering.running_totals(
        df, ["x", "id"], {"s": F.col("w"), "k": F.lit(1)}, group_cols=["g"], partitions=partitions
    )
    want = _sorted(pdf, ["g", "x", "id"])
    want["s"] = want.groupby("g")["w"].cumsum()
    want["k"] = want.groupby("g").cumcount() + 1
    got = _sorted(out.toPandas(), ["g", "x", "id"])
    assert np.allclose(got["s"], want["s"]) and (got["k"] == want["k"]).all() and len(got) == len(want)


@pytest.mark.parametrize("partitions", PARTITIONS)
@pytest.mark.parametrize("n", [1, 50, 10_000])
def test_first_in_order(rows, partitions, n):
    pdf, df = rows
    out = ordering.first_in_order(df, ["x", "id"], F.lit(n), group_cols=["g"], partitions=partitions)
    want = pdf.sort_values(["x", "id"]).groupby("g").head(n)
    assert sorted(out.toPandas()["id"]) == sorted(want["id"])


@pytest.mark.parametrize("partitions", PARTITIONS)
def test_neighbours(rows, partitions):
    pdf, df = rows
    out = ordering.neighbours(df, ["x", "id"], ["id"], group_cols=["g"], partitions=partitions)
    got = _sorted(out.select("g", "x", "id", F.col("prev.id").alias("p"), F.col("next.id").alias("n")).toPandas(), ["g", "x", "id"])
    want = _sorted(pdf, ["g", "x", "id"])
    assert got["p"].equals(want.groupby("g")["id"].shift(1)) and got["n"].equals(want.groupby("g")["id"].shift(-1))


@pytest.mark.parametrize("partitions", [None, 1, 3, 30])
def test_as_of(spark, rows, partitions):
    pdf, df = rows
    marks = pd.DataFrame([(g, s, f"{g}{s}") for g in ("big", "a") for s in (2.0, 5.0, 5.5, 11.0)], columns=["g", "start", "name"])
    out = ordering.as_of(df, spark.createDataFrame(marks), point_x="x", start="start", group_cols=["g"], partitions=partitions)
    got = out.toPandas().set_index("id")["name"]
    assert len(got) == len(pdf)
    for r in pdf.itertuples():
        before = marks[(marks.g == r.g) & (marks.start <= r.x)]
        assert got[r.id] == (before["name"].iloc[-1] if len(before) else None)


def test_assign_ids_are_consecutive(rows):
    pdf, df = rows
    out = ordering.assign_ids(df, ["x", "id"], "n", partitions=25).toPandas()
    assert sorted(out["n"]) == list(range(1, len(pdf) + 1))
    assert _sorted(out, "n")["id"].tolist() == _sorted(pdf, ["x", "id"])["id"].tolist()


def test_subsample_is_exact_and_repeatable(rows):
    _, df = rows
    take = lambda seed, **kw: ordering.component_subsample(df, {"big": 37, "a": 5, "b": 0}, seed=seed, component_col="g", id_cols=("id",), **kw)
    one = take(5).toPandas()
    assert one.groupby("g").size().to_dict() == {"big": 37, "a": 5}
    assert sorted(one["id"]) == sorted(take(5, partitions=20).toPandas()["id"])
    assert sorted(one["id"]) != sorted(take(6).toPandas()["id"])
    assert take(1).select("id").distinct().count() == 42
    assert ordering.component_subsample(df, {"big": 0}, component_col="g", id_cols=("id",)).count() == 0


def test_salted_join_equals_plain_join(rows, spark):
    pdf, df = rows
    right = spark.createDataFrame([("big", 1), ("a", 2)], "g string, v int")
    for how in ("inner", "left"):
        plain = keys.lookup_join(df, right, ["g"], how).toPandas()
        salted = keys.lookup_join(df, right, ["g"], how, hot=[("big",)], salts=7).toPandas()
        assert salted.columns.tolist() == plain.columns.tolist()
        a, b = (_sorted(f, "id").fillna(-1) for f in (plain, salted))
        assert a.equals(b) and len(a) == (len(pdf) if how == "left" else (pdf.g != "b").sum())
    spread = keys.lookup_join(df, right, ["g"], hot=[("big",)], salts=7)._jdf.queryExecution().optimizedPlan().toString()
    assert "__salt" in spread


def test_measured_join_chooses_before_the_shuffle(rows, spark):
    pdf, df = rows
    right = df.groupBy("g").agg(F.sum("w").alias("s"))
    want = keys.attach(df, right, ["g"]).toPandas()
    small = keys.attach(df, right, ["g"], measure=True)
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    out = small.toPandas()
    assert np.allclose(_sorted(out, "id")["s"], _sorted(want, "id")["s"]) and len(out) == len(pdf)


def test_hot_group_is_split_at_run_time(spark):
    hot = F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 997).cast("string")))
    df = spark.range(0, 300_000, 1, 12).select("id", hot.alias("g"), F.md5(F.col("id").cast("string")).alias("load"))
    stats = df.groupBy("g").agg(F.count("*").alias("n"))
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        out = keys.attach(df, stats, ["g"])
        got = out.toPandas()
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert "skew=true" in plan
    assert got["id"].nunique() == len(got) == 300_000 and set(got[got.g == "hot"]["n"]) == {200_000}


def test_order_is_one_range_exchange(rows, spark, monkeypatch):
    df = spark.createDataFrame(rows[0])
    plans = []
    stored = ordering.materialise
    monkeypatch.setattr(ordering, "materialise", lambda d, name, *a: plans.append(d._jdf.queryExecution().executedPlan().toString()) or stored(d, name, *a))
    totals = ordering.running_totals(df, ["x", "id"], {"s": F.col("w")}, group_cols=["g"], partitions=9)
    ids = ordering.assign_ids(df, ["x", "id"], "n", partitions=9)
    for plan in plans:
        assert plan.count("Exchange rangepartitioning(") == 1 and plan.count("Exchange ") == 1
    # what crosses the cuts is broadcast, and the rows aren't shuffled again
    for out in (totals, ids):
        rows_side = out._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
        assert "BroadcastHashJoin" in rows_side and "Exchange" not in rows_side and "Window" not in rows_side
    # equal rows are parted too
    same = spark.range(2000).select(F.lit(1).alias("g"), F.lit(2.0).alias("x"))
    sizes = ordering.in_order(same, ["x"], ["g"], partitions=8).groupBy(ordering.part_of()).count().toPandas()["count"]
    assert len(sizes) == 8 and sizes.max() < 600


def test_groups_of_any_type_and_null_values(spark):
    rows = [(float(i % 3) if i % 4 else float("nan"), i % 2 == 0, i, None if i % 5 == 0 else i) for i in range(300)]
    df = spark.createDataFrame(rows, "a double, b boolean, id int, v int").repartition(4)
    for p in (1, 7):
        out = ordering.running_totals(df, ["id"], {"s": F.col("v"), "f": F.col("v") / 2}, group_cols=["a", "b"], partitions=p)
        assert dict(out.dtypes)["s"] == "bigint" and dict(out.dtypes)["f"] == "double"
        got = out.toPandas().sort_values("id")
        want = got.assign(v=got.v.fillna(0)).groupby(["a", "b"], dropna=False)["v"].cumsum()
        assert np.allclose(got["s"], want) and np.allclose(got["f"], want / 2)
        near = ordering.neighbours(df, ["id"], ["id", "v"], group_cols=["a", "b"], partitions=p).toPandas().sort_values("id")
        want = near.groupby(["a", "b"], dropna=False)["id"].shift(1)
        assert [r and r.id for r in near["prev"]] == [None if np.isnan(w) else int(w) for w in want]
    empty = df.limit(0)
    assert ordering.running_totals(empty, ["id"], {"s": F.col("v")}, group_cols=["a"]).count() == 0
    assert ordering.neighbours(empty, ["id"], ["v"]).count() == ordering.assign_ids(empty, ["id"]).count() == 0


def test_ranks_within_groups(rows):
    pdf, df = rows
    for p in (None, 13):
        got = _sorted(ordering.ranked(df, ["x", "id"], ["g"], rank="k", partitions=p).toPandas(), ["g", "x", "id"])
        assert got["k"].tolist() == _sorted(pdf, ["g", "x", "id"]).groupby("g").cumcount().tolist()


def test_prefix_sums_in_two_levels(spark):
    parts = spark.range(0, 5000, 7).select(F.col("id").cast("int").alias(ordering.PART), (F.col("id") % 11).alias("n"))
    got = ordering.prefix_sums(parts, {"b": F.col("n")}).orderBy(ordering.PART).toPandas()
    assert got["b"].tolist() == (got["n"].cumsum() - got["n"]).tolist()


def test_null_group_is_an_error_in_order(spark):
    df = spark.createDataFrame([(None, 1)], "g string, x int")
    with pytest.raises(Exception, match="null in a group column"):
        ordering.running_totals(df, ["x"], {"s": F.col("x")}, group_cols=["g"]).collect()


def test_null_keys_are_kept(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2)], "g string, v int")
    stats = left.groupBy("g").agg(F.sum("v").alias("s"))
    assert keys.attach(left, stats, ["g"]).count() == 2


def test_hot_keys(spark):
    df = spark.range(3_000_000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"))
    assert keys.hot_keys(df, ["k"]) == [(-1,)]


@pytest.mark.parametrize("block", [2, 3, 7, 1000])
def test_spline_blocks_solve_the_whole_system(spark, block):
    rng = np.random.default_rng(1)
    tables = {}
    for t, n in (("two", 2), ("three", 3), ("long", 41)):
        x = np.sort(rng.choice(1000, n, replace=False)) / 10.0
        tables[t] = (x, rng.normal(size=n))
    rows = [(t, float(a), float(b)) for t, (x, y) in tables.items() for a, b in zip(x, y)]
    knots = spark.createDataFrame(rows, "table_id string, x double, y double")
    out = splines.spline_coefficients(knots, block=block, partitions=5)
    got = out.toPandas().sort_values(["table_id", "knot"])
    for t, (x, y) in tables.items():
        h, n = np.diff(x), len(x)
        A, b = np.eye(n), np.zeros(n)
        for i in range(1, n - 1):
            A[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
            b[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
        mine = got[got.table_id == t]
        assert mine["knot"].tolist() == list(range(n))
        assert np.allclose(mine["y2"], np.linalg.solve(A, b), atol=1e-10)
    # the curve passes through its knots, and the end cubics extrapolate
    at = knots.select("table_id", F.col("x").alias("q"), F.col("y").alias("want"))
    back = splines.spline_lookup(at, out, at="q", partitions=4).toPandas()
    assert len(back) == len(rows) and np.allclose(back["value"], back["want"], atol=1e-10)
    ends = spark.createDataFrame([("two", -5.0), ("two", 500.0)], "table_id string, q double")
    x, y = tables["two"]
    line = splines.spline_lookup(ends, out, at="q").toPandas().sort_values("q")["value"]
    assert np.allclose(line, y[0] + (y[1] - y[0]) / (x[1] - x[0]) * (np.array([-5.0, 500.0]) - x[0]))


def test_spline_maximum_against_dense_sampling(spark):
    rng = np.random.default_rng(11)
    tables = {}
    for t in range(8):
        x = np.sort(rng.choice(400, rng.integers(2, 30), replace=False)) / 20.0
        tables[t] = (x, rng.normal(size=len(x)))
    tables[90], tables[91] = (np.array([0.0, 1.0, 3.0]), np.zeros(3)), (np.array([0.0, 2.0]), np.array([1.0, 5.0]))
    knots = spark.createDataFrame([(t, float(a), float(b)) for t, (x, y) in tables.items() for a, b in zip(x, y)], "table_id int, x double, y double")
    coef = splines.spline_coefficients(knots)
    best = {r.table_id: r for r in curves.spline_maximum(coef).collect()}
    dense = [(t, float(q)) for t, (x, _) in tables.items() for q in np.unique(np.concatenate([np.linspace(x[0], x[-1], 4001), np.linspace(max(x[0], best[t].x_max - 1e-3), min(x[-1], best[t].x_max + 1e-3), 2001)]))]
    seen = splines.spline_lookup(spark.createDataFrame(dense, "table_id int, q double"), coef, at="q").toPandas()
    for t, r in best.items():
        mine = seen[seen.table_id == t]
        top = mine.loc[mine["value"].idxmax()]
        assert r.y_max >= top["value"] - 1e-12 and r.y_max - top["value"] < 1e-9
        if t != 90:
            assert abs(r.x_max - top["q"]) <= 1.01e-6
    assert (best[90].x_max, best[90].y_max, best[91].x_max) == (0.0, 0.0, 2.0)


def test_maximize_to_a_tolerance(spark):
    rows = [(1, 0.0, 10.0, 3.3), (2, -5.0, 5.0, 9.0), (3, 2.0, 2.0, 1.0), (4, None, 1.0, 1.0), (5, 3.0, 1.0, 1.0), (6, 0.0, 1e6, 12345.678)]
    b = spark.createDataFrame(rows, "k int, a double, b double, c double")
    for xtol in (1e-3, 1e-6):
        got = {r.k: r for r in curves.maximize(b, lambda x: -F.pow(x - F.col("c"), F.lit(2.0)), xtol=xtol).collect()}
        for k, want in ((1, 3.3), (2, 5.0), (3, 2.0), (6, 12345.678)):
            assert abs(got[k].x_max - want) <= xtol
        assert got[4].x_max is None and got[4].y_max is None and got[5].x_max is None
    assert curves.maximize(b.limit(0), lambda x: x).count() == 0


def test_a_long_spline_in_short_blocks(spark):
    n = 1_000_000
    rows = spark.range(n, numPartitions=8).select(
        F.lit("t").alias("table_id"), (F.col("id") + (F.col("id") * 7919 % 1000) / 2500.0).alias("x"), F.sin(F.col("id") / 3.0).alias("y")
    )
    got = splines.spline_coefficients(rows, block=20).orderBy("knot").toPandas()
    x, y = got["x"].to_numpy(), got["y"].to_numpy()
    h, slope = np.diff(x), np.diff(y) / np.diff(x)
    diag, rhs = np.ones(n), np.zeros(n)
    lower, upper = np.zeros(n), np.zeros(n)
    diag[1:-1], rhs[1:-1], lower[1:-1], upper[1:-1] = 2 * (h[1:] + h[:-1]), 6 * np.diff(slope), h[:-1], h[1:]
    for k in range(1, n):  # the undivided system, by elimination from one end to the other
        w = lower[k] / diag[k - 1]
        diag[k] -= w * upper[k - 1]
        rhs[k] -= w * rhs[k - 1]
    rhs[-1] /= diag[-1]
    for k in range(n - 2, -1, -1):
        rhs[k] = (rhs[k] - upper[k] * rhs[k + 1]) / diag[k]
    assert got["knot"].tolist() == list(range(n)) and np.abs(got["y2"] - rhs).max() < 1e-11


def test_no_group_of_a_spline_holds_a_table(spark, monkeypatch):
    sizes = []
    arrays = splines._arrays

    def seen(rows, by):
        out = arrays(rows, by)
        sizes.append(out.select(F.max(F.size(splines.ROW))).first()[0])
        return out

    monkeypatch.setattr(splines, "_arrays", seen)
    knots = spark.range(1000).select(F.lit(1).alias("table_id"), F.col("id").cast("double").alias("x"), F.rand(3).alias("y"))
    assert splines.spline_coefficients(knots, block=4).count() == 1000
    assert len(sizes) == 5 and max(sizes) == 5


def test_spline_needs_two_knots(spark):
    one = spark.createDataFrame([("t", 1.0, 2.0)], "table_id string, x double, y double")
    with pytest.raises(Exception, match="at least two points"):
        splines.spline_coefficients(one).collect()


def test_linear_resample_equals_interp(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([[0.4, 0.8, 2.0], np.sort(rng.random(30) * 7 + 0.4)])
    x = np.unique(x)
    y = rng.normal(size=len(x))
    curve = spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "r double, v double")
    out = curves.linear_resample(curve, start=0.0, stop=10.0, num=26).toPandas().sort_values("i")
    want = np.interp(np.linspace(0, 10, 26), x, y, left=0.0, right=0.0)
    assert np.allclose(out["y"], want)
    single = spark.createDataFrame([(2.0, 5.0)], "r double, v double")
    one = curves.linear_resample(single, start=0.0, stop=4.0, num=5).toPandas().sort_values("i")["y"]
    assert one.tolist() == [0, 0, 5, 0, 0]


def test_finite_difference_simpson_argmax(spark):
    b = spark.createDataFrame([("c", 0.0, 1.0), ("d", 1.0, 3.0)], "f string, a double, b double")
    t = curves.tabulate(b, lambda x: x * x * x - x, n=7)
    got = dict(curves.simpson_table(t, group_cols=["f"]).collect())
    assert got["c"] == pytest.approx(0.25 - 0.5, abs=1e-12) and got["d"] == pytest.approx(20 - 4, abs=1e-12)
    with pytest.raises(Exception, match="odd number"):
        curves.simpson_table(t.filter("i < 8"), group_cols=["f"]).collect()
    top = curves.tabulate(b, lambda x: -(x - 0.73) * (x - 0.73) + 2.0, n=10)
    best = {r.f: (r.x_max, r.y_max) for r in curves.argmax_table(top, group_cols=["f"]).collect()}
    assert best["c"] == pytest.approx((0.73, 2.0)) and best["d"][0] == 1.0
    # uneven samples of a parabola give its top as well
    uneven = spark.createDataFrame([("u", i, x, 5.0 - 2.0 * (x - 1.37) ** 2) for i, x in enumerate([0.0, 0.2, 1.0, 1.9, 2.0, 7.0])], "f string, i int, x double, y double")
    r = curves.argmax_table(uneven, group_cols=["f"]).first()
    assert (r.x_max, r.y_max) == (pytest.approx(1.37), pytest.approx(5.0))
    slope = curves.finite_difference(top, x="x", y="y", group_cols=["f"], partitions=6).filter("f = 'd'").orderBy("x").toPandas()
    inner = slope.iloc[1:-1]
    assert np.allclose(inner["dydx"], -2 * (inner["x"] - 0.73)) and slope["dydx"].isna().sum() == 2
