"""Moments, profiles, centring and fits against numpy, with edge rows."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from halocline.operators import curves, fitting, frames, moments, profiles
from halocline.plans.report import galaxy_report
from halocline.storage import materialise

SCHEMA = "particle_id long, component string, mass double, x double, y double, z double, vx double, vy double, vz double"


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(11)
    n = 900
    pos = rng.normal(size=(n, 3)) * [4, 4, 0.7]
    pos[: n // 3] = rng.normal(size=(n // 3, 3)) * 0.8 + [2.0, -1.0, 0.3]
    pdf = pd.DataFrame(pos, columns=list("xyz"))
    pdf[["vx", "vy", "vz"]] = rng.normal(size=(n, 3)) + [1e6, 0, 0]
    pdf["mass"] = rng.integers(1, 5, n) / 4.0
    pdf["component"] = np.where(np.arange(n) % 3 == 0, "halo", "disk")
    pdf["particle_id"] = np.arange(n)
    return pdf, spark.createDataFrame(pdf)


def row(i, c="disk", m=1.0, pos=(0.0, 0.0, 0.0), vel=(0.0, 0.0, 0.0)):
    return (i, c, m, *pos, *vel)


def test_moments_without_groups(cloud):
    pdf, df = cloud
    m = pdf["mass"]
    assert moments.total_mass(df).first()[0] == pytest.approx(m.sum())
    com = moments.center_of_mass(df).first()
    assert np.allclose(list(com), [(m * pdf[c]).sum() / m.sum() for c in "xyz"])
    sig = moments.velocity_dispersion(df).first()
    v = pdf["vx"]
    mean = (m * v).sum() / m.sum()
    # a bulk speed a million times the dispersion does not hurt
    assert sig["sigma_vx"] == pytest.approx(math.sqrt((m * (v - mean) ** 2).sum() / m.sum()), rel=1e-9)


def test_recenter_moves_the_centre_of_mass_to_zero(cloud):
    _, df = cloud
    out = frames.recenter(df, vel=frames.VEL, group_cols=["component"])
    for r in moments.center_of_mass(out, group_cols=["component"]).collect():
        assert np.allclose(r[1:], 0.0, atol=1e-12)


def test_axis_and_massless_rows(spark):
    df = spark.createDataFrame([row(1), row(2, "halo", 0.0, (1.0, 0.0, 0.0))], SCHEMA)
    r = {x.particle_id: x for x in frames.cylindrical_kinematics(df).collect()}
    assert r[1].v_phi is None and r[2].v_phi == 0.0
    com = {x.component: x.com_x for x in moments.center_of_mass(df, group_cols=["component"]).collect()}
    assert com == {"disk": 0.0, "halo": None}
    assert frames.recenter(df, group_cols=["component"]).count() == 2


def test_profile_leaves_out_thin_bins(spark):
    many = [row(i, pos=(1.0 + i * 1e-3, 0.0, (-1.0) ** i), vel=(0.0, 2.0, 0.0)) for i in range(12)]
    few = [row(100 + i, pos=(5.0, 0.0, 0.0)) for i in range(10)]
    df = spark.createDataFrame(many + few, SCHEMA)
    out = profiles.radial_profile_disk(df).collect()
    assert len(out) == 1
    r = out[0]
    assert (r.bin, r.n, r.sigma_z, r.mean_vphi) == (2, 12, 1.0, 200.0)
    assert r.r == pytest.approx(1.0)
    assert r.surface_density == pytest.approx(12 / (math.pi * (1.2**2 - 0.8**2)))
    cells = profiles.map_2d_profile(df).toPandas()
    assert set(cells["bin"]) == {2} and len(cells) == 9
    hit = cells[cells["n"] > 0].sort_values("iz")
    assert hit["iz"].tolist() == [2, 6] and (hit["mean_vphi"] == 200.0).all()
    assert (cells[cells["n"] == 0]["log_number_density"] == -100.0).all()


def test_histograms_equal_numpy(cloud):
    pdf, df = cloud
    got = profiles.velocity_histogram(df).toPandas()
    for axis in ("vx", "vy", "vz"):
        want, edges = np.histogram(pdf[axis], bins=50)
        mine = got[got["axis"] == axis].sort_values("bin")
        assert mine["n"].tolist() == want.tolist() and np.allclose(mine["v_lo"], edges[:-1])
    edges = np.linspace(0.1, 200, 400)
    want, _ = np.histogram(np.sqrt((pdf[list("xyz")] ** 2).sum(axis=1)), bins=edges)
    d = profiles.density_histogram(df).toPandas().set_index("bin")
    assert d["n"].to_dict() == {i: n for i, n in enumerate(want) if n}
    assert np.allclose(d["weighted"], [want[i] / edges[i + 1] ** 2 for i in d.index])


def test_velocity_histogram_of_equal_values(spark):
    df = spark.createDataFrame([row(i) for i in range(3)], SCHEMA)
    out = profiles.velocity_histogram(df, vel=["vx"]).filter("n > 0").first()
    assert (out.n, out.bin) == (3, 25)


def test_enclosed_mass_equals_rescan(cloud):
    pdf, df = cloud
    out = profiles.enclosed_mass(df).toPandas().sort_values("bin")
    r = np.sqrt((pdf[list("xyz")] ** 2).sum(axis=1)).to_numpy()
    edges = np.geomspace(r.min(), r.max(), 41)
    edges[-1] = r.max()
    assert np.allclose(out["r_edge"], edges[1:])
    assert np.allclose(out["m_enc"], [pdf["mass"][r <= e].sum() for e in edges[1:]])
    assert out["m_enc"].iloc[-1] == pytest.approx(pdf["mass"].sum())


def test_enclosed_mass_edges(spark):
    flat = spark.createDataFrame([row(1), row(2)], SCHEMA)
    with pytest.raises(Exception, match="zero extent"):
        profiles.enclosed_mass(flat).collect()
    assert profiles.enclosed_mass(flat, strict=False).count() == 0
    single = spark.createDataFrame([row(1, pos=(3.0, 0.0, 4.0)), row(2)], SCHEMA)
    out = profiles.enclosed_mass(single, n_bins=4).orderBy("bin").toPandas()
    assert out["m_enc"].iloc[-1] == 2.0 and out["r_max"].iloc[0] == 5.0


def _reference_center(p, core, tol=0.001, rounds=20):
    x, m, off = p[list("xyz")].to_numpy(), p["mass"].to_numpy(), np.zeros(3)
    for _ in range(rounds):
        d = x - off
        inside = (d * d).sum(axis=1) < core * core
        if not inside.any() or m[inside].sum() <= 0:
            break
        step = (m[inside, None] * d[inside]).sum(axis=0) / m[inside].sum()
        if (abs(step) < tol * core).all():
            break
        off = off + step
    return off


@pytest.mark.parametrize("group", [[], ["component"]])
def test_center_on_core(spark, cloud, group):
    pdf, df = cloud
    empty = spark.createDataFrame([row(5000, "far", 1.0, (90.0, 0.0, 0.0)), row(5001, "void", 0.0, (1.0, 0.0, 0.0))], SCHEMA)
    both = df.unionByName(empty)
    every = both.toPandas()
    off = fitting.core_center(both, core_radius=3.0, group_cols=group).collect()
    if not group:
        assert np.allclose(off[0][:3], _reference_center(every, 3.0))
        return
    got = {r["component"]: r for r in off}
    assert set(got) == {"disk", "halo", "far", "void"}
    for c, r in got.items():
        assert np.allclose(r[1:4], _reference_center(every[every.component == c], 3.0)), c
        assert r["settled"]
    out = fitting.center_on_core(both, core_radius=3.0, group_cols=group)
    assert out.count() == len(every) and out.filter("component = 'far'").first()["x"] == 90.0


@pytest.mark.parametrize("local_rows", [0, 40, 10**6])
def test_core_centre_by_tasks_and_by_rounds(spark, monkeypatch, local_rows):
    """Groups of any size, with nulls, have the centres of the reference whether a task or jobs take their rounds."""
    monkeypatch.setattr(fitting, "BATCH_ROWS", 64)
    rng = np.random.default_rng(5)
    sizes = {None: 30, 1: 90, 2: 35, 3: 1, 4: 40, 5: 41}
    rows = [(g, float(m), *map(float, p)) for i, (g, n) in enumerate(sizes.items()) for m, p in zip(rng.uniform(1, 2, n), rng.normal(0.9 * i, 2.0, (n, 3)))]
    odd = [(1, None, 0.5, 0.5, 0.5), (2, 5.0, None, 0.0, 0.0), (6, 1.0, None, None, None), (7, 0.0, 0.1, 0.1, 0.1), (8, 1.0, 99.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows + odd, "k long, mass double, x double, y double, z double").repartition(3)
    got = {r["k"]: r for r in fitting.core_center(df, core_radius=3.0, max_iter=4, group_cols=["k"], local_rows=local_rows).collect()}
    assert set(got) == {*sizes, 6, 7, 8}
    for k, r in got.items():
        p = pd.DataFrame([x for x in rows if x[0] == k], columns=["k", "mass", *"xyz"])
        off = _reference_center(p, 3.0, rounds=4) if len(p) else np.zeros(3)
        assert np.allclose(r[1:4], off, atol=1e-12), k
        assert r["settled"] == np.allclose(off, _reference_center(p, 3.0, rounds=3) if len(p) else off, atol=1e-12, rtol=0), k


def test_core_centres_of_small_groups_take_no_round_of_jobs(spark, monkeypatch):
    """However many rounds they need, what is stored stays the same."""
    stored = []
    monkeypatch.setattr(fitting, "materialise", lambda df, name, *path: stored.append(name) or materialise(df, name, *path))
    rows = [(g, 1.0, 0.2 * i + g, 0.0, 0.0) for g in range(5) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, mass double, x double, y double, z double")
    out = fitting.core_center(df, core_radius=2.0, tolerance=1e-4, group_cols=["k"]).collect()
    for r in out:
        p = pd.DataFrame([x for x in rows if x[0] == r["k"]], columns=["k", "mass", *"xyz"])
        assert np.allclose(r[1:4], _reference_center(p, 2.0, tol=1e-4))
    assert len(out) == 5 and len(stored) <= 3


def nfw(r, a):
    return math.log(1 + r / a) - (r / a) / (1 + r / a)


def test_nfw_fit_recovers_synthetic_halo(spark):
    radii = np.logspace(-1, 2.2, 200)
    enc = np.array([80.0 * nfw(r, 15.0) for r in radii])
    mass = np.diff(enc, prepend=0.0)
    rows = [row(i, "halo", float(m), (float(r), 0.0, 0.0)) for i, (r, m) in enumerate(zip(radii, mass))]
    df = spark.createDataFrame(rows, SCHEMA)
    fit = fitting.fit_halo(df, center=False).first()
    assert fit["rms_residual"] < 0.05 and fit["r_outer"] == pytest.approx(radii[-1])
    edge = fitting.fit_halo(df, center=False, radius_at="edge").first()
    assert edge["a"] == pytest.approx(15.0, rel=0.02) and edge["m_scale"] == pytest.approx(80.0, rel=0.02)
    exact = spark.createDataFrame([(k, float(r), 80.0 * nfw(r, 15.0), 50.0) for k, r in enumerate(radii[::5].tolist())], "bin int, r double, m_enc double, r_max double")
    f = fitting.nfw_fit(exact).first()
    assert f["a"] == pytest.approx(15.0, rel=1e-5) and f["m_scale"] == pytest.approx(80.0, rel=1e-5)
    v = math.sqrt(80.0 * (math.log(3) - 2 / 3) / 30.0) / math.sqrt(math.log(3) / 2)
    assert f["v0"] == pytest.approx(v, rel=1e-5)
    assert fitting.nfw_fit(exact.limit(2)).count() == 0
    with pytest.raises(Exception, match="fewer than three bins"):
        fitting.nfw_fit(exact.limit(2), strict=True).collect()


def test_parameter_scan_finds_the_minimum(spark):
    data = [(g, float(x), a * x + b, 0.5) for g, a, b in (("p", 2.0, 1.0), ("q", -1.0, 3.0)) for x in range(6)]
    df = spark.createDataFrame(data, "g string, x double, y double, s double")
    model = lambda p: p["a"] * F.col("x") + p["b"]
    out = fitting.parameter_scan(df, model, {"a": (-4, 4), "b": (-5, 5)}, observed="y", sigma="s", steps=8, refinements=5, group_cols=["g"])
    best = {r.g: r for r in out.collect()}
    assert best["p"].a == pytest.approx(2.0, abs=0.02) and best["q"].b == pytest.approx(3.0, abs=0.03)
    assert best["p"].n == 6
    whole = fitting.parameter_scan(df.filter("g = 'p'"), model, {"a": (-4, 4), "b": (-5, 5)}, observed="y", sigma="s", refinements=1).first()
    assert whole["chi2"] >= 0


def test_rotation_curve_scale(spark):
    rows = [("g", v, 130.0 * v, 5.0 + v) for v in (1.0, 1.5, 2.0)]
    df = spark.createDataFrame(rows, "galaxy_id string, v_model double, V_kms double, sigma_kms double")
    out = fitting.rotation_curve_scale(df).first()
    assert out["v_scale"] == pytest.approx(1.3) and out["rms"] == pytest.approx(0.0, abs=1e-6)


def test_rotation_curve_scale_with_long_masses(spark):
    rows = [(g, v, 100.0 * v, 5.0) for g in ("a", "b", "c") for v in (1.0, 2.0)]
    df = spark.createDataFrame(rows, "galaxy_id string, v_model double, V_kms double, sigma_kms double")
    given = [("a", "disk", 2.0, 3.0), ("a", "halo", 5.0, 80.0), ("a", "gas", 9.0, 9.0), ("b", "bulge", 1.0, 1.0), ("b", "bulge", 2.0, 1.0)]
    masses = spark.createDataFrame(given, "galaxy_id string, component string, mass double, radius double")
    got = {r["galaxy_id"]: r for r in fitting.rotation_curve_scale(df, masses).collect()}
    assert got.keys() == {"a", "b", "c"}
    unit = 1 / 4.3e-6
    for name, want in (("a", (2.0, 0.0, 5.0)), ("b", (0.0, 3.0, 0.0)), ("c", (0.0, 0.0, 0.0))):
        assert [got[name][f"{c}_mass_msun"] for c in ("disk", "bulge", "halo")] == pytest.approx([m * unit for m in want])
    assert got["a"]["halo_radius_kpc"] == 80.0 and got["b"]["halo_radius_kpc"] is None


def test_particle_curve_equals_naive(cloud):
    pdf, df = cloud
    out = curves.particle_rotation_curve(df, partitions=5, G=2.0).toPandas().set_index("particle_id")
    for _, part in pdf.groupby("component"):
        r = np.sqrt((part[list("xyz")] ** 2).sum(axis=1))
        order = r.sort_values().index
        enc = part.loc[order, "mass"].cumsum()
        ids = part.loc[order, "particle_id"]
        assert np.allclose(out.loc[ids, "v"], np.sqrt(2.0 * enc / r[order]))


def test_filters_and_components(cloud, spark):
    pdf, df = cloud
    R = np.hypot(pdf["x"], pdf["y"])
    assert frames.annulus_filter(df, 1.0, 2.0).count() == ((R > 1) & (R < 2)).sum()
    assert frames.sphere_filter(df, 3.0).count() == ((pdf[list("xyz")] ** 2).sum(axis=1) < 9).sum()
    ext = df.filter("component = 'disk'").limit(4).drop("component")
    swapped = frames.replace_component(df, "halo", ext)
    assert swapped.filter("component = 'halo'").count() == 4
    assert swapped.count() == (pdf.component == "disk").sum() + 4


def test_galaxy_report_runs_its_sections_apart(spark):
    """What the report returns reads stored sections, so that no plan holds them all."""
    columns = "particle_id long, component string, mass double, x double, y double, z double, vx double, vy double, vz double"
    rows = [(i, "halo" if i % 3 else "disk", 1.0 + i % 2, i * 0.5, -i * 0.25, 0.1 * i, 1.0, i * 0.1, -1.0) for i in range(1, 31)]
    checks = spark.createDataFrame([(7, "round_trip", True, 0.0, "ok"), (7, "force_inward", False, 1.0, "failed")], "model_id long, rule string, passed boolean, observed double, detail string")
    out = galaxy_report(spark.createDataFrame(rows, columns), checks=checks, curve_points=20)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not any(step in plan for step in ("Join", "Aggregate", "Generate", "Window"))
    got = out.collect()
    assert {r.section for r in got} >= {"summary", "curve", "check"}
    assert {(r.component, r.value) for r in got if r.section == "summary" and r.metric == "n"} == {("halo", 20.0), ("disk", 10.0)}
    assert {(r.model_id, r.item, r.value) for r in got if r.section == "check"} == {(7, "round_trip", 1.0), (7, "force_inward", 0.0)}
    assert sum(r.section == "curve" for r in got) == 40
