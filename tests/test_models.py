"""Catalog, analytic fields, multipoles and rules: identities and edge rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from halocline import fixtures as fx
from halocline.functions import special
from halocline.functions.units import DEFAULT_UNITS, UnitSystem
from halocline.operators import fields, grids, harmonics, models, multipoles, quality
from halocline.plans.halo import superposition_from_particles


@pytest.fixture(scope="module")
def catalog(spark, sf_dir):
    return fx.catalog(spark, sf_dir).cache()


@pytest.fixture(scope="module")
def cells(spark, sf_dir):
    return harmonics.harmonic_cells(fx.coefficients(spark, sf_dir), fx.LMAX).cache()


def test_erfc(spark):
    xs = np.linspace(-5, 5, 401).tolist()
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(special.erfc(F.col("x"))).collect()]
    assert max(abs(g - math.erfc(x)) for g, x in zip(got, xs)) < 2e-7


def test_erfc_to_double_precision(spark):
    xs = np.concatenate([np.linspace(-6, 26, 3201), [0.46875, 4.0, 1e-300, -0.0, 27.2, 40.0, -40.0, math.inf, -math.inf]]).tolist()
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for x, g in zip(xs, [r[0] for r in df.select(special.erfc(F.col("x"))).collect()]):
        want = math.erfc(x)
        assert g == want or abs(g - want) <= 1e-14 * want or want < 1e-306
    odd = spark.createDataFrame([(None,), (math.nan,)], "x double").select(special.erfc(F.col("x"))).collect()
    assert odd[0][0] is None and math.isnan(odd[1][0])


def test_erfc_twin_shares_nothing_and_agrees():
    import duckdb

    from halocline.queries.model_queries import erfc_sql

    xs = np.linspace(-6, 6, 2001)
    got = duckdb.sql(f"SELECT t, {erfc_sql('t')} FROM (SELECT unnest({xs.tolist()}) AS t)").fetchall()
    assert all(abs(v - math.erfc(t)) <= 2e-14 * math.erfc(t) for t, v in got)


def test_legendre(spark):
    df = spark.createDataFrame([(c,) for c in np.linspace(-1, 1, 21).tolist()], "c double")
    cols = special.even_legendre(F.col("c"), 8)
    out = df.select("c", *[p.alias(f"p{i}") for i, (p, _) in enumerate(cols)], *[d.alias(f"d{i}") for i, (_, d) in enumerate(cols)]).toPandas()
    for i, l in enumerate(range(0, 9, 2)):
        poly = np.polynomial.legendre.Legendre.basis(l)
        assert np.allclose(out[f"p{i}"], poly(out["c"])) and np.allclose(out[f"d{i}"], poly.deriv()(out["c"]) if l else 0.0)
    with pytest.raises(ValueError):
        special.even_legendre(F.col("c"), 3)


def test_units(spark):
    u = UnitSystem(length_kpc=2.0, mass_msun=1e9)
    row = spark.range(1).select(
        DEFAULT_UNITS.to_physical(F.lit(17.0), "mass"), u.from_physical(F.lit(8.0), "length"), u.to_physical(F.lit(2.0), "velocity")
    ).first()
    assert tuple(row) == (17.0 * 2.325e9, 4.0, 200.0)


def test_defaults_in_internal_units(spark):
    m = models.model_from_physical(spark.createDataFrame([(1,)], "model_id int")).first()
    assert m.halo.v0 == pytest.approx(3.7) and m.disk.mass == pytest.approx(17.0) and m.grid.nr == 800
    assert m.disk2 is None and m.kinematics.sigma_r0 == pytest.approx(0.85)


def test_psi0_rule(spark):
    base = models.model_from_physical(spark.createDataFrame([(1,)], "model_id int"))
    bulge = models.component("bulge", n_sersic=4.0, ppp=0.5, v0=2.5, a=0.5, enabled=True)
    with_bulge = base.withColumn("bulge", bulge)
    psi0 = lambda c: models.component_constants(c).first()["psi0"]
    assert psi0(with_bulge) == pytest.approx(3.7**2)
    assert psi0(models.baryons_only(with_bulge)) == 2.5**2
    assert psi0(models.baryons_only(base)) == 0.0
    assert psi0(models.halo_only(with_bulge)) == pytest.approx(3.7**2)


def test_apply_fit_adds_and_grows_halos(spark, catalog):
    none = catalog.filter("model_id < 3").withColumn("halo", F.when(F.col("model_id") != 1, F.col("halo")))
    fits = spark.createDataFrame([(0, 1.0, 2.0, 500.0), (1, 3.0, 4.0, 50.0)], "model_id long, v0 double, a double, r_outer double")
    out = {r.model_id: r.halo for r in models.apply_fit(none, fits).collect()}
    assert (out[0].r_outer, out[0].v0, out[0].enabled) == (500.0, 1.0, True)
    assert (out[1].r_outer, out[1].dr_trunc, out[1].cusp) == (50.0, 12.0, 1.0)
    assert out[2].v0 == 2.2


POINTS = [(R, z) for R in (0.5, 3.0, 8.1, 14.0, 26.0, 40.0) for z in (-1.3, 0.07, 0.4, 2.9)]


def _eval(spark, fn, pts, models_=(0, 1, 3, 5, 6)):
    rows = [(i, m, float(R), float(z)) for m in models_ for i, (R, z) in enumerate(pts)]
    df = spark.createDataFrame(rows, "i int, model_id long, R double, z double")
    return fn(df).toPandas().sort_values(["model_id", "i"]).reset_index(drop=True)


def test_force_is_gradient_of_potential(spark, catalog, cells):
    """Inside cells and beyond the edge, with disks and gas; the table's fr is a blend, so r-gradients there are close, not exact."""
    ev = lambda df: harmonics.evaluate_force(df, cells, catalog, lmax=fx.LMAX)
    base = _eval(spark, ev, POINTS)
    h = 1e-5
    for axis, name in ((0, "f_r"), (1, "f_z")):
        shift = lambda s: [(R + s * (axis == 0), z + s * (axis == 1)) for R, z in POINTS]
        up, down = _eval(spark, ev, shift(h)), _eval(spark, ev, shift(-h))
        slope = (up["psi"] - down["psi"]) / (2 * h)
        outside = np.hypot(base["R"], base["z"]) > fx.DR * fx.NR
        assert np.allclose(slope[outside], base[name][outside], rtol=1e-6, atol=1e-6)
        assert np.allclose(slope, base[name], rtol=0.03, atol=0.06)


def test_analytic_force_and_density_match_potential(spark, catalog):
    ev = lambda df: fields.analytic_field(df, catalog)
    inner = [p for p in POINTS if p[0] < 20]
    h = 1e-4
    base = _eval(spark, ev, inner)
    d = lambda a, b: {n: [(getattr(x, "psi"), getattr(y, "psi")) for x, y in zip(a[n], b[n])] for n in ("field_disk", "field_disk2", "field_gas")}
    step = lambda dr, dz: _eval(spark, ev, [(R + dr, z + dz) for R, z in inner])
    pR, mR, pz, mz = step(h, 0), step(-h, 0), step(0, h), step(0, -h)
    rho = _eval(spark, lambda df: fields.density_field(df, catalog), inner)
    for n, dens in (("field_disk", "rho_disk_pot"), ("field_disk2", "rho_disk2_pot"), ("field_gas", "rho_gas")):
        psi = np.array([x.psi for x in base[n]])
        up, dn, zu, zd = (np.array([x.psi for x in f[n]]) for f in (pR, mR, pz, mz))
        assert np.allclose((up - dn) / (2 * h), [x.f_r for x in base[n]], rtol=1e-4, atol=3e-5)
        assert np.allclose((zu - zd) / (2 * h), [x.f_z for x in base[n]], rtol=1e-4, atol=3e-5)
        lap = (up + dn - 2 * psi) / h**2 + (up - dn) / (2 * h) / base["R"] + (zu + zd - 2 * psi) / h**2
        # second differences of values near 1e2 keep seven digits; the taper's ends, at four widths, jump by 1e-8
        ok = np.abs(lap + 4 * math.pi * rho[dens]) < 1e-4 * np.abs(lap).max() + 1e-3
        assert ok.mean() > 0.97


def test_switched_off_components_are_zero(spark, catalog):
    off = models.halo_only(catalog).withColumn("gas", models.absent("gas"))
    out = _eval(spark, lambda df: fields.density_field(df, off), POINTS)
    assert (out[["rho_disk", "rho_disk_pot", "rho_disk2_pot", "rho_gas"]] == 0.0).all().all()
    assert (out[out["model_id"] != 0]["rho_halo"] > 0).all() and (out[out["model_id"] == 0]["rho_halo"] == 0).all()
    # zeros for lengths, as ingested for missing components, do no harm
    zero = catalog.withColumn("disk2", models.component("disk2", mass=0.0, scale_length=0.0, outer_radius=0.0, scale_height=0.0, trunc_width=0.0, enabled=False))
    assert _eval(spark, lambda df: fields.surface_density_field(df, zero), POINTS)["sigma_disk2"].eq(0.0).all()


def test_origin_and_midplane(spark, catalog, cells):
    out = _eval(spark, lambda df: harmonics.evaluate_force(df, cells, catalog, lmax=fx.LMAX), [(0.0, 0.0), (8.0, 0.0), (0.0, 2.0)])
    centre, mid, axis = out[out.i == 0], out[out.i == 1], out[out.i == 2]
    assert (centre[["f_r", "f_z"]] == 0.0).all().all() and np.isfinite(centre["psi"]).all()
    assert np.allclose(mid["f_z"], 0.0, atol=1e-12) and (mid["psi"] > 0).all() and (mid["f_r"] < 0).all()
    # a flaring gas layer has a cusp on the axis
    assert np.allclose(axis[axis["model_id"].isin([0, 1, 5])]["f_r"], 0.0, atol=1e-12)


def test_merge_is_symmetric_and_guarded(spark, sf_dir, catalog):
    a, b = fx.coefficients(spark, sf_dir, 1.0), fx.coefficients(spark, sf_dir, 0.3)
    key = ["model_id", "l", "ir"]
    x = harmonics.merge_harmonics(a, b).toPandas().sort_values(key).reset_index(drop=True)
    y = harmonics.merge_harmonics(b, a).toPandas().sort_values(key).reset_index(drop=True)
    assert x.equals(y)
    for bad in (b.filter("ir < 60"), b.filter("l < 4"), b.withColumn("r", F.col("r") * 2)):
        with pytest.raises(Exception, match="grids differ"):
            harmonics.merge_harmonics(a, bad).collect()
    other = models.baryons_only(catalog, {"dr": 0.1, "nr": 9, "lmax": 2})
    with pytest.raises(Exception, match="grids differ"):
        harmonics.merge_catalogs(catalog, other).collect()


def test_cells_pair_shells(spark, sf_dir, cells):
    c = fx.coefficients(spark, sf_dir).filter("l = 2").toPandas().set_index(["model_id", "ir"])["apot"]
    out = cells.toPandas()
    assert len(out) == out["model_id"].nunique() * fx.NR and set(out["cell"]) == set(range(1, fx.NR + 1))
    assert np.allclose(out["apot_hi_2"], c.loc[list(zip(out["model_id"], out["cell"]))])
    assert np.allclose(out["apot_lo_2"], c.loc[list(zip(out["model_id"], out["cell"] - 1))])


def test_uniform_sphere(spark):
    dr, nr, edge, rho = 0.1, 100, 50, 0.3
    shells = spark.createDataFrame([(0, s, rho) for s in range(edge)], "l int, shell int, rho double")
    out = multipoles.multipole_potential(shells, dr=dr, nr=nr).toPandas().sort_values("ir")
    n = special.harmonic_norm(0)
    r, a = out["r"].to_numpy(), edge * dr
    mass = 4 * math.pi / 3 * rho * a**3
    inside = r <= a
    want = np.where(inside, 2 * math.pi * rho * (a**2 - r**2 / 3), mass / np.maximum(r, 1e-9))
    assert np.allclose(out["apot"] * n, want, rtol=1e-9)
    assert np.allclose(out["fr"] * n, np.where(inside, mass * r / a**3, mass / np.maximum(r, 1e-9) ** 2), rtol=1e-9)
    shifted = multipoles.multipole_potential(shells, dr=dr, nr=nr, edge_zero=True).toPandas().sort_values("ir")
    assert shifted["apot"].iloc[-1] == 0.0


def test_multipoles_match_direct_sum(spark):
    rng = np.random.default_rng(2)
    p = rng.normal(size=(4000, 3)) * [2.0, 2.0, 1.0]
    p = np.concatenate([p, p * [1, 1, -1], p * [-1, 1, 1], p * [1, -1, 1]])
    df = spark.createDataFrame([(1.0 / len(p), *map(float, q)) for q in p], "mass double, x double, y double, z double")
    rho = multipoles.multipole_density(df, dr=0.1, nr=150, lmax=4)
    coef = multipoles.multipole_potential(rho, dr=0.1, nr=150).withColumn("model_id", F.lit(1).cast("long"))
    c = spark.createDataFrame([(1,)], "model_id long").select("model_id", models.component("grid", dr=0.1, nr=150, lmax=4).alias("grid"))
    pts = [(12.0, 0.5), (9.0, 6.0), (1.0, 13.0), (20.0, 5.0)]
    ev = lambda d: harmonics.evaluate_force(d, harmonics.harmonic_cells(coef, 4), c, lmax=4, analytic=False)
    got = _eval(spark, ev, pts, (1,))
    phi = rng.random(400) * 2 * math.pi
    for (R, z), psi in zip(pts, got["psi"]):
        ring = np.column_stack([R * np.cos(phi), R * np.sin(phi), np.full(400, z)])
        direct = np.mean([np.mean(1.0 / np.linalg.norm(p - q, axis=1)) for q in ring[:60]])
        assert psi == pytest.approx(direct, rel=0.004)
    gap = harmonics.edge_correction(coef, c).first()["edge_correction"]
    assert abs(gap) < 1e-9


@pytest.mark.parametrize("with_mass_inside", [True, False])
def test_mass_beyond_the_grid_is_felt_inside(spark, with_mass_inside):
    rng = np.random.default_rng(9)
    # an axisymmetric lens far out, mirrored in z, beyond a grid that ends at r = 6
    far = rng.normal(size=(300, 3)) * [4.0, 4.0, 0.5]
    far = far[np.hypot(far[:, 0], far[:, 1]) > 6.5][:60]
    near = rng.normal(size=(200, 3)) * [0.4, 0.4, 0.2] if with_mass_inside else np.zeros((0, 3))
    p = np.concatenate([far, near])
    turn = [np.array([[math.cos(a), -math.sin(a), 0], [math.sin(a), math.cos(a), 0], [0, 0, s]]) for a in np.linspace(0, 2 * math.pi, 48, endpoint=False) for s in (1, -1)]
    p = np.concatenate([p @ t.T for t in turn])
    m = 1.0 / len(p)
    df = spark.createDataFrame([(m, *map(float, q)) for q in p], "mass double, x double, y double, z double")
    dr, nr, lmax = 0.05, 120, 10
    rho = multipoles.multipole_density(df, dr=dr, nr=nr, lmax=lmax)
    coef = multipoles.multipole_potential(rho, dr=dr, nr=nr).withColumn("model_id", F.lit(1).cast("long"))
    c = spark.createDataFrame([(1,)], "model_id long").select("model_id", models.component("grid", dr=dr, nr=nr, lmax=lmax).alias("grid"))
    pts = [(3.0, 0.0), (2.5, 1.5), (0.0, 3.5), (4.0, 1.0)]
    got = _eval(spark, lambda d: harmonics.evaluate_force(d, harmonics.harmonic_cells(coef, lmax), c, lmax=lmax, analytic=False), pts, (1,))
    for (R, z), psi, f_r, f_z in zip(pts, got["psi"], got["f_r"], got["f_z"]):
        d = p - np.array([R, 0.0, z])
        s = np.linalg.norm(d, axis=1)
        assert psi == pytest.approx((m / s).sum(), rel=2e-3)
        scale = np.abs(m / s**2).sum()
        assert abs(f_r - (m * d[:, 0] / s**3).sum()) < 0.01 * scale and abs(f_z - (m * d[:, 2] / s**3).sum()) < 0.01 * scale


def test_decay_is_continuous_at_the_edge(spark):
    rows = [(1, l, ir, ir * 0.5, 0.0, (0.0 if ir == 0 else (ir * 0.5) ** -(l + 1.0)), (0.0 if ir == 0 else (l + 1.0) * (ir * 0.5) ** -(l + 2.0))) for l in (0, 2) for ir in range(41)]
    coef = spark.createDataFrame(rows, "model_id long, l int, ir int, r double, adens double, apot double, fr double")
    c = spark.createDataFrame([(1,)], "model_id long").select("model_id", models.component("grid", dr=0.5, nr=40, lmax=2).alias("grid"))
    ev = lambda d: harmonics.evaluate_force(d, harmonics.harmonic_cells(coef, 2), c, lmax=2, analytic=False)
    out = _eval(spark, ev, [(20.0 - 1e-9, 0.0), (20.0 + 1e-9, 0.0)], (1,))
    assert out["psi"][0] == pytest.approx(out["psi"][1], rel=1e-8) and out["f_r"][0] == pytest.approx(out["f_r"][1], rel=1e-8)


def test_decomposition_clamps_and_allows_no_bulge(spark):
    force = lambda v: spark.createDataFrame([(1, 1, 2.0, -v * v / 2.0)], "model_id long, i int, R double, f_r double")
    out = harmonics.rotation_decomposition(force(1.0), force(3.0)).first()
    assert out["v_disk"] == 0.0 and out["v_bulge"] is None
    out = harmonics.rotation_decomposition(force(3.0), force(2.0), force(1.0)).first()
    assert out["v_disk"] == pytest.approx(2.0) and out["v_bulge"] == pytest.approx(1.0)


def test_bilinear_is_exact_for_bilinear_functions(spark):
    f = lambda r, z: 2.0 + 3.0 * r - z + 0.5 * r * z
    nodes = [(r * 0.5, z * 0.25 - 1.0, f(r * 0.5, z * 0.25 - 1.0)) for r in range(6) for z in range(9)]
    g = spark.createDataFrame(nodes, "r double, z double, psi double")
    pts = [(0.3, 0.1), (2.5, 1.0), (0.0, -1.0), (4.0, 3.0), (-1.0, -2.0)]
    p = spark.createDataFrame([(i, R, z) for i, (R, z) in enumerate(pts)], "i int, R double, z double")
    out = grids.grid_lookup_bilinear(p, g, values=["psi"]).orderBy("i").toPandas()
    assert np.allclose(out["psi"], [f(*q) for q in pts])


def test_stability_infinite_where_not_oscillating(spark):
    freq = spark.createDataFrame([(1, 1.0, 0.0, -1.0, 2.0), (1, 2.0, 1.0, 1.0, 2.0)], "model_id long, R double, omega_h double, d2psi_dr2 double, sigma_d double")
    corr = spark.createDataFrame([(1, 1.0, 1.0), (1, 2.0, 1.0)], "model_id long, R double, f_d double")
    kin = spark.createDataFrame([(1, 0.5, 2.0)], "model_id long, sigma_r0 double, sigma_r_scale double")
    out = fields.stability_table(freq, corr, kin).orderBy("R").collect()
    assert out[0]["Q"] == float("inf") and out[1]["kappa"] == 2.0
    assert out[1]["Q"] == pytest.approx(0.5 * math.exp(-0.5) * 2.0 / (3.36 * 2.0))


def test_rules_on_missing_sides(spark, catalog):
    fewer = catalog.filter("model_id > 0")
    out = {r.model_id: r.matches for r in quality.grid_match(catalog, fewer).collect()}
    assert not out[0] and out[1]
    a = spark.createDataFrame([(1, 0, 1.0), (1, 1, 2.0)], "model_id long, ir int, apot double")
    b = spark.createDataFrame([(1, 0, 1.0 + 1e-9)], "model_id long, ir int, apot double")
    assert quality.close_check(a, b, on=["model_id", "ir"], values=["apot"]).first()["different"] == 1


def test_presets_are_whole_catalog_rows(spark):
    names = spark.createDataFrame([(n,) for n in models.PRESETS], "model_id string")
    rows = {r["model_id"]: r for r in models.component_constants(models.with_preset(names, "model_id")).collect()}
    assert rows.keys() == models.PRESETS.keys()
    for name, parts in models.PRESETS.items():
        for kind in (*models.COMPONENTS, *models.SETTINGS):
            got = rows[name][kind]
            want = parts.get(kind)
            assert (got is None) == (want is None)
            if want:
                assert {k: got[k] for k in want} == want and got.asDict().get("enabled", True)
    assert rows["nfw_halo"]["psi0"] == 4.0 and rows["sersic_bulge"]["psi0"] == 6.25
    with pytest.raises(Exception, match="no such model"):
        models.with_preset(spark.createDataFrame([("other",)], "m string"), "m").collect()


def test_tagged_evaluation_is_one_lookup_and_equals_three(spark, catalog, sf_dir):
    radii = harmonics.midplane_radii(catalog, n=20, rmax=40.0)
    cells = harmonics.harmonic_cells(fx.coefficients(spark, sf_dir), fx.LMAX)
    low = harmonics.harmonic_cells(fx.coefficients(spark, sf_dir, 0.3), fx.LMAX)
    some = low.filter(F.col("model_id") % 4 != 0)
    ev = lambda r, c, **kw: harmonics.evaluate_force(r, c, catalog, lmax=fx.LMAX, **kw)
    three = harmonics.rotation_decomposition(ev(radii, cells), ev(radii, low, analytic=False), ev(radii.filter(F.col("model_id") % 4 != 0), some, analytic=False))
    tagged = harmonics.tagged_cells({"total": cells, "halo": low, "bulge": some})
    one = harmonics.tagged_decomposition(radii, tagged, catalog, lmax=fx.LMAX)
    by = ["model_id", "i"]
    a, b = (d.toPandas().sort_values(by).reset_index(drop=True) for d in (three, one))
    for c in ("r", "v_total", "v_halo", "v_bulge", "v_disk"):
        assert np.allclose(a[c].astype(float), b[c].astype(float), equal_nan=True, atol=1e-9)
    assert a["v_bulge"].isna().any() and not a["v_bulge"].isna().all()
    joins = lambda d: d._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    # the constants and the cells, once each instead of three times, and no join of the parts
    assert joins(one) == 2 and joins(three) >= 6


def test_superposition_from_particles_of_spheres(spark):
    # shells of evenly spread particles: a speed squared is the mass inside over the radius
    k = np.arange(300) + 0.5
    height, turn = 1.0 - 2.0 * k / 300, math.pi * (1.0 + math.sqrt(5.0)) * k
    sphere = np.column_stack([np.sqrt(1.0 - height**2) * np.cos(turn), np.sqrt(1.0 - height**2) * np.sin(turn), height])
    size = {"halo": 12.0, "bulge": 1.0, "disk": 4.0}
    shells = {c: (np.arange(160) + 0.5) / 160 * size[c] for c in size}
    mass = {"halo": 5.0, "bulge": 1.0, "disk": 2.0}
    rows = [(1, c, mass[c] / len(r) / 300, *map(float, q)) for c, r in shells.items() for s in r for q in sphere * s]
    rows += [(2, "halo", 1.0, 0.1, 0.0, 0.0), (3, "disk", 1.0, 1.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "model_id long, component string, mass double, x double, y double, z double")
    out = superposition_from_particles(df, dr=0.05, nr=120, lmax=4, n=8, rmax=5.6).toPandas()
    assert set(out["model_id"]) == {1, 2} and out[out["model_id"] == 2]["v_bulge"].isna().all()
    for x in out[out["model_id"] == 1].itertuples():
        # half of the halo lies beyond the grid and pulls no way
        inside = {c: mass[c] * min(1.0, x.r / size[c]) for c in size}
        assert x.v_halo**2 == pytest.approx(inside["halo"] / x.r, rel=0.04)
        assert x.v_bulge**2 == pytest.approx(inside["bulge"] / x.r, rel=0.04)
        assert x.v_total**2 == pytest.approx(sum(inside.values()) / x.r, rel=0.04)
        assert x.v_disk**2 == pytest.approx(x.v_total**2 - x.v_halo**2 - x.v_bulge**2)


def test_cells_made_of_few_rows_are_shuffled_not_gathered(spark, tmp_path):
    """The planner takes a table that each row of a small file is spread into for as small as the file."""
    spark.range(300).select(F.col("id").alias("s_suppkey")).write.parquet(str(tmp_path / "supplier.parquet"))
    coefficients = fx.coefficients(spark, str(tmp_path))
    assert coefficients.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    points = spark.range(10).select(F.lit(7).cast("long").alias("model_id"), F.col("id").cast("double").alias("R"), F.lit(0.0).alias("z"))
    cells = harmonics.harmonic_cells(coefficients, fx.LMAX)
    grid = models.component("grid", dr=fx.DR, nr=fx.NR, lmax=fx.LMAX)
    catalog = spark.range(300).select(F.col("id").alias("model_id"), grid.alias("grid"))
    plans = [harmonics.harmonic_interpolate(points, cells, catalog, lmax=fx.LMAX), harmonics.evaluate_force(points, cells, catalog, lmax=fx.LMAX, analytic=False)]
    for out in plans:
        assert "SortMergeJoin" in out._jdf.queryExecution().executedPlan().toString()
        assert all(r["cell"] is not None if "cell" in out.columns else r["f_r"] is not None for r in out.collect())


def test_lattices_of_a_small_file_are_made_by_all_tasks(spark, tmp_path):
    """One task would sort every node of every lattice to gather the values of the axes."""
    from halocline.queries.model_queries import _grid

    spark.range(30).coalesce(1).select(F.col("id").alias("s_suppkey")).write.parquet(str(tmp_path / "supplier.parquet"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for made, rows in ((_grid(spark, str(tmp_path)), 41 * 7), (fx.knots(spark, str(tmp_path)), 51)):
        sizes = [r.n for r in made.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert sum(sizes) == 30 * rows and 1 < len(sizes) <= tasks and max(sizes) < 30 * rows
