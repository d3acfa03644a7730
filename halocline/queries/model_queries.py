"""Model catalog, analytic fields, multipole tables, forces, rules."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from halocline import fixtures as fx
from halocline.operators import (
    fields,
    fitting,
    grids,
    harmonics,
    models,
    multipoles,
    profiles,
    quality,
)
from halocline.plans.halo import fixed_halo_superposition, halo_from_particles, superposition_from_particles
from halocline.plans.report import galaxy_report
from halocline.queries import curve_queries as cq
from halocline.queries import particle_queries as pq
from halocline.queries.registry import query


# ---- SQL text for the analytic parts --------------------------------------------------

def erfc_sql(t: str, step: float = 0.5, terms: int = 13) -> str:
    """erfc by the midpoint rule on its integral 2 x exp(-x^2)/pi * int exp(-s^2)/(s^2 + x^2) ds, with the pole's share added."""
    x = f"abs({t})"
    nodes = [(k + 0.5) * step for k in range(terms)]
    total = " + ".join(f"{math.exp(-s * s)!r}/({s * s!r} + {x}*{x})" for s in nodes)
    value = f"({2 * step / math.pi!r}*{x}*exp(-{x}*{x})*({total}) + 2/(1 + exp({2 * math.pi / step!r}*{x})))"
    return f"(CASE WHEN {t} >= 0 THEN {value} ELSE 2 - {value} END)"


def radial_sql(c: str, norm: str) -> str:
    """Aliases {c}_f, {c}_f1, {c}_f2 of a tapered exponential (over lateral aliases)."""
    return f"""
      (rs - {c}_out)/{c}_tw*sqrt(0.5e0) AS {c}_t,
      CASE WHEN {c}_t < -4 THEN 1 WHEN {c}_t <= 4 THEN 0.5e0*{erfc_sql(c + '_t')} ELSE 0 END AS {c}_keep,
      CASE WHEN {c}_t >= -4 AND {c}_t <= 4 THEN exp(-{c}_t*{c}_t)/(sqrt(2*pi())*{c}_tw) ELSE 0 END AS {c}_slope,
      ({norm})*exp(-rs/{c}_rd) AS {c}_e,
      {c}_e*{c}_keep AS {c}_f,
      CASE WHEN rs > 0 THEN -{c}_e*({c}_keep/{c}_rd + {c}_slope)/rs ELSE 0 END AS {c}_f1,
      CASE WHEN rs > 0 THEN {c}_e*({c}_keep/({c}_rd*{c}_rd) + {c}_slope*(2/{c}_rd + (rs - {c}_out)/({c}_tw*{c}_tw))) ELSE 0 END AS {c}_f2"""


def disk_sql(c: str) -> str:
    return f"""{radial_sql(c, f'{c}_mass*{c}_zd/(4*pi()*{c}_rd*{c}_rd)')},
      abs(z/{c}_zd) AS {c}_zz, {c}_zz + ln(0.5e0*(1 + exp(-2*{c}_zz))) AS {c}_lc,
      -4*pi()*{c}_f*{c}_lc AS {c}_psi, -4*pi()*{c}_f1*R*{c}_lc AS {c}_fr,
      -4*pi()*({c}_f1*z*{c}_lc + {c}_f/{c}_zd*tanh(z/{c}_zd)) AS {c}_fz,
      {c}_f2*{c}_lc + 2*{c}_f1*({c}_zz*tanh({c}_zz) + {c}_lc) + {c}_f/(cosh({c}_zz)*cosh({c}_zz)*{c}_zd*{c}_zd) AS {c}_rho"""


HEIGHT_SQL = """
      exp(-R/g_rz) AS g_ez,
      CASE WHEN g_rz < 0 THEN g_zs ELSE (g_zm + 1)*g_zs/(g_zm*g_ez + 1) END AS g_h,
      CASE WHEN g_rz < 0 THEN 0 ELSE (g_zm + 1)*g_zs*g_ez*g_zm/(g_rz*(g_zm*g_ez + 1)**2) END AS g_h1,
      CASE WHEN g_rz < 0 THEN 0 ELSE -(g_zm + 1)*g_zs*g_zm*g_ez*(1 - g_zm*g_ez)/(g_rz**2*(1 + g_zm*g_ez)**3) END AS g_h2"""

GAS_SQL = f"""{radial_sql('g', 'g_mass/(2*pi()*g_rd*g_rd)')}, {HEIGHT_SQL},
      z/g_h AS g_u,
      CASE WHEN abs(g_u) < 1 THEN 0.375e0*(g_u**2 - g_u**4/6) ELSE 0.5e0*(abs(g_u) - 0.375e0) END AS g_v,
      CASE WHEN abs(g_u) < 1 THEN 0.75e0*(g_u - g_u**3/3) ELSE 0.5e0*sign(g_u) END AS g_v1,
      CASE WHEN abs(g_u) < 1 THEN 0.75e0*(1 - g_u**2) ELSE 0 END AS g_v2,
      -4*pi()*g_f*g_h*g_v AS g_psi,
      -4*pi()*(R*g_f1*g_h*g_v + g_f*g_h1*g_v - z*g_h1/g_h*g_f*g_v1) AS g_fr,
      -4*pi()*(z*g_f1*g_h*g_v + g_f*g_v1) AS g_fz,
      {{'g': g_h*g_v, 'dR': g_h1*(g_v - g_u*g_v1), 'dz': g_v1, 'dRR': g_h2*(g_v - g_u*g_v1) + g_v2*(g_u*g_h1)**2/g_h, 'dzz': g_v2/g_h}} AS g_layer,
      g_layer['dRR'] + g_layer['dzz'] + CASE WHEN R > 0 THEN g_layer['dR']/R ELSE 0 END AS g_laplacian,
      (g_f2 + 2*g_f1)*g_layer['g'] + 2*g_f1*(R*g_layer['dR'] + z*g_layer['dz']) + g_f*g_laplacian AS g_rho"""


def with_models(points: str, *parts: str) -> str:
    """Points joined to their models, with rs and the lateral aliases of ``parts``."""
    extra = "".join(f", {p}" for p in parts)
    return f"(SELECT *{extra} FROM (SELECT q.*, m.* EXCLUDE (model_id), sqrt(R*R + z*z) AS rs FROM {points} q JOIN models m USING (model_id)) j)"


def on(c: str, value: str) -> str:
    return f"CASE WHEN {c}_on THEN {value} ELSE 0 END"


# ---- catalog ---------------------------------------------------------------------------

@query(
    "model_from_physical",
    "model_id v0:6 a:6 r_outer:6 disk_mass:6 scale_length:6 sigma_r0:6 halo_on disk_on nr:i disk2_absent",
    """SELECT s_suppkey AS model_id, CASE WHEN s_suppkey % 3 = 0 THEN 3.7e0 ELSE (s_suppkey % 50 + 180)/100.0 END AS v0,
         33e0 AS a, 200e0 AS r_outer, (s_suppkey % 20 + 10)*1e9/2.325e9 AS disk_mass, 2.5e0 AS scale_length, 0.85e0 AS sigma_r0,
         s_suppkey % 2 = 0 AS halo_on, true AS disk_on, 800 AS nr, true AS disk2_absent FROM supplier""",
    uses="",
)
def model_from_physical(spark, sf):
    k = F.col("s_suppkey")
    given = fx.table(spark, sf, "supplier").select(
        k.alias("model_id"),
        F.when(k % 3 != 0, k % 50 + 180.0).alias("halo_v0_kms"),
        ((k % 20 + 10) * 1e9).alias("disk_mass_msun"),
        (k % 2 == 0).alias("halo_enabled"),
    )
    return models.model_from_physical(given).select(
        "model_id",
        "halo.v0",
        "halo.a",
        "halo.r_outer",
        F.col("disk.mass").alias("disk_mass"),
        "disk.scale_length",
        "kinematics.sigma_r0",
        F.col("halo.enabled").alias("halo_on"),
        F.col("disk.enabled").alias("disk_on"),
        "grid.nr",
        F.col("disk2").isNull().alias("disk2_absent"),
    )


@query(
    "preset_models",
    "model_id preset r_outer:6 halo_v0:6 disk_mass:6 bulge_v0:6 nr:i lmax:i sigma_r0:6 psi0:6",
    """SELECT s_suppkey AS model_id, v.*, CASE WHEN halo_v0 IS NOT NULL THEN halo_v0*halo_v0 ELSE bulge_v0*bulge_v0 END AS psi0
       FROM supplier JOIN (VALUES
         (0, 'milky_way', 200e0, 3.7e0, 17e0, NULL, 20000, 6, 0.85e0),
         (1, 'milky_way_coarse', 80e0, 3.7e0, 17e0, NULL, 800, 2, 0.85e0),
         (2, 'nfw_halo', 100e0, 2e0, NULL, NULL, 2000, 0, NULL),
         (3, 'sersic_bulge', NULL, NULL, NULL, 2.5e0, 5000, 4, NULL),
         (4, 'nfw_bulge', 100e0, 2.5e0, NULL, 1.5e0, 8000, 4, NULL)
       ) v(i, preset, r_outer, halo_v0, disk_mass, bulge_v0, nr, lmax, sigma_r0) ON s_suppkey % 5 = i""",
    uses="",
)
def preset_models(spark, sf):
    names = F.element_at(F.array(*[F.lit(n) for n in models.PRESETS]), (F.col("s_suppkey") % 5 + 1).cast("int"))
    rows = fx.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("model_id"), names.alias("preset"))
    return models.component_constants(models.with_preset(rows, "preset")).select(
        "model_id", "preset", "halo.r_outer", F.col("halo.v0").alias("halo_v0"), F.col("disk.mass").alias("disk_mass"),
        F.col("bulge.v0").alias("bulge_v0"), "grid.nr", "grid.lmax", "kinematics.sigma_r0", "psi0",
    )


@query(
    "component_constants",
    "model_id halo_const:9 disk_const:9 disk2_const:9 gas_const:9 bulge_const:9 psi0:6",
    """SELECT model_id, h_v0*h_v0/(4*pi()*h_a*h_a) AS halo_const, d1_mass/(2*pi()*d1_rd*d1_rd) AS disk_const,
         d2_mass/(4*pi()*d2_rd*d2_rd*d2_zd) AS disk2_const, g_mass/(2*pi()*g_rd*g_rd) AS gas_const,
         CASE WHEN b_on THEN b_v0*b_v0/(4*pi()*b_a*b_a) END AS bulge_const,
         CASE WHEN h_on THEN h_v0*h_v0 WHEN b_on THEN b_v0*b_v0 ELSE 0 END AS psi0 FROM models""",
    uses="models",
)
def component_constants(spark, sf):
    return models.component_constants(fx.catalog(spark, sf))


@query(
    "toggle_components",
    "model_id view halo_on disk_on disk2_on gas_on bulge_on nr:i",
    """SELECT model_id, 'halo_only' AS view, h_on AS halo_on, false AS disk_on, false AS disk2_on, false AS gas_on,
         CASE WHEN b_on THEN false END AS bulge_on, 60 AS nr FROM models
       UNION ALL SELECT model_id, 'baryons_only', false, d1_on, d2_on, g_on, CASE WHEN b_on THEN true END, 400 FROM models""",
    uses="models",
)
def toggle_components(spark, sf):
    c = fx.catalog(spark, sf)
    views = {
        "halo_only": models.halo_only(c),
        "baryons_only": models.baryons_only(c, {"dr": 0.1, "nr": 400, "lmax": 2}),
    }
    flat = [
        v.select(
            "model_id",
            F.lit(name).alias("view"),
            *[F.col(f"{n}.enabled").alias(f"{n}_on") for n in ("halo", "disk", "disk2", "gas", "bulge")],
            "grid.nr",
        )
        for name, v in views.items()
    ]
    return flat[0].unionByName(flat[1])


FITTED = "model_id v0:5 a:3 r_outer:5 halo_on disk_mass:6"


@query(
    "apply_fit",
    FITTED,
    """SELECT model_id, CASE WHEN f THEN 1 + model_id % 7 ELSE h_v0 END AS v0, CASE WHEN f THEN 5 + model_id % 11 ELSE h_a END AS a,
         CASE WHEN f THEN greatest(h_out, 50 + model_id % 90) ELSE h_out END AS r_outer, f OR h_on AS halo_on, d1_mass AS disk_mass
       FROM (SELECT *, model_id % 2 = 0 AS f FROM models)""",
    uses="models",
)
def apply_fit(spark, sf):
    c = fx.catalog(spark, sf)
    k = F.col("model_id")
    fits = c.filter(k % 2 == 0).select(
        k, (k % 7 + 1.0).alias("v0"), (k % 11 + 5.0).alias("a"), (k % 90 + 50.0).alias("r_outer")
    )
    return _flat_halo(models.apply_fit(c, fits))


def _flat_halo(c):
    return c.select(
        "model_id", "halo.v0", "halo.a", "halo.r_outer", F.col("halo.enabled").alias("halo_on"),
        F.col("disk.mass").alias("disk_mass"),
    )


# ---- analytic fields --------------------------------------------------------------------

@query(
    "density_field",
    "particle_id mass model_id rho_halo:8 rho_disk:8 rho_disk_pot:7 rho_disk2_pot:7 rho_gas:7",
    f"""SELECT particle_id, mass, model_id,
          {on('h', 'h_v0*h_v0/(4*pi()*h_a*h_a)/((rs/h_a)*(1 + rs/h_a)**2)')} AS rho_halo,
          d1_mass/(2*pi()*d1_rd*d1_rd)*exp(-R/d1_rd)*CASE WHEN dt < -4 THEN 1 WHEN dt > 4 THEN 0 ELSE 0.5e0*{erfc_sql('dt')} END
            /(2*d1_zd)/cosh(z/d1_zd)**2 AS rho_disk,
          d1_rho AS rho_disk_pot, {on('d2', 'd2_rho')} AS rho_disk2_pot, {on('g', 'g_rho')} AS rho_gas
        FROM (SELECT *, (R - d1_out)/d1_tw AS dt FROM {with_models('pts', disk_sql('d1'), disk_sql('d2'), GAS_SQL)})""",
    uses="pts models",
)
def density_field(spark, sf):
    return fields.density_field(fx.points(spark, sf), fx.catalog(spark, sf))


@query(
    "surface_density_field",
    "particle_id mass model_id R:6 sigma_disk:7 sigma_disk2:7 sigma_gas:7 gas_h:7 gas_h1:7 gas_h2:7",
    f"""SELECT particle_id, mass, model_id, R,
          d1_mass/(2*pi()*d1_rd*d1_rd)*exp(-R/d1_rd)*CASE WHEN dt < -4 THEN 1 WHEN dt > 4 THEN 0 ELSE 0.5e0*{erfc_sql('dt')} END AS sigma_disk,
          {on('d2', 'd2_f')} AS sigma_disk2, {on('g', 'g_f')} AS sigma_gas, {on('g', 'g_h')} AS gas_h, {on('g', 'g_h1')} AS gas_h1,
          {on('g', 'g_h2')} AS gas_h2
        FROM (SELECT *, (R - d1_out)/d1_tw AS dt FROM {with_models('(SELECT particle_id, mass, model_id, R, 0e0 AS z FROM pts)',
              radial_sql('d2', 'd2_mass/(2*pi()*d2_rd*d2_rd)'), radial_sql('g', 'g_mass/(2*pi()*g_rd*g_rd)'), HEIGHT_SQL)})""",
    uses="pts models",
)
def surface_density_field(spark, sf):
    return fields.surface_density_field(fx.points(spark, sf), fx.catalog(spark, sf))


@query(
    "analytic_field",
    "particle_id mass model_id psi_disk:6 fr_disk:6 fz_disk:6 psi_disk2:6 fr_disk2:6 fz_disk2:6 psi_gas:6 fr_gas:6 fz_gas:6",
    f"""SELECT particle_id, mass, model_id, d1_psi AS psi_disk, d1_fr AS fr_disk, d1_fz AS fz_disk,
          {on('d2', 'd2_psi')} AS psi_disk2, {on('d2', 'd2_fr')} AS fr_disk2, {on('d2', 'd2_fz')} AS fz_disk2,
          {on('g', 'g_psi')} AS psi_gas, {on('g', 'g_fr')} AS fr_gas, {on('g', 'g_fz')} AS fz_gas
        FROM {with_models('pts', disk_sql('d1'), disk_sql('d2'), GAS_SQL)}""",
    uses="pts models",
)
def analytic_field(spark, sf):
    out = fields.analytic_field(fx.points(spark, sf), fx.catalog(spark, sf))
    names = {"psi": "psi", "f_r": "fr", "f_z": "fz"}
    return out.select(
        "particle_id", "mass", "model_id",
        *[F.col(f"field_{c}")[f].alias(f"{n}_{c}") for c in ("disk", "disk2", "gas") for f, n in names.items()],
    )


STABILITY_SQL = """
    SELECT model_id, i, k.R, kappa, s2 AS sigma_r_sq, CASE WHEN kappa <= 0 THEN 'Infinity'::DOUBLE ELSE sqrt(s2)*kappa/(3.36e0*sigma_d) END AS Q
    FROM (SELECT *, sqrt(greatest(0, d2psi_dr2 + 3*omega_h*omega_h)) AS kappa, k_s0*k_s0*exp(-R/k_sc)*f_d AS s2
          FROM knots JOIN models USING (model_id)) k"""


@query("stability_table", "model_id R:6 kappa:6 sigma_r_sq:6 Q:5", STABILITY_SQL, uses="knots models")
def stability_table(spark, sf):
    k = fx.knots(spark, sf)
    kin = fx.catalog(spark, sf).select("model_id", "kinematics.*")
    return fields.stability_table(k.select("model_id", "R", "omega_h", "d2psi_dr2", "sigma_d"), k, kin)


@query(
    "log_profile",
    "bin:i ln_r:6 ln_disk:6 ln_halo:6 ln_bulge:6",
    f"""SELECT bin, ln(r) AS ln_r, ln(max(surface_density) FILTER (component = 'disk')) AS ln_disk,
          ln(max(surface_density) FILTER (component = 'halo')) AS ln_halo, ln(max(surface_density) FILTER (component = 'bulge')) AS ln_bulge
        FROM ({pq.DISK_PROFILE_SQL}) GROUP BY bin, r""",
)
def log_profile(spark, sf):
    prof = profiles.radial_profile_disk(fx.particles(spark, sf), group_cols=["component"])
    parts = {c: prof.filter(F.col("component") == c) for c in ("disk", "halo", "bulge")}
    return profiles.log_profile(parts, on=["bin", "r"], value="surface_density", radius="r")


# ---- multipole tables -------------------------------------------------------------------

@query(
    "merge_harmonics",
    "model_id l:i ir:i r:6 adens:6 apot:6 fr:6",
    """SELECT model_id, l, ir, c.r, c.adens + b.adens AS adens, c.apot + b.apot AS apot, c.fr + b.fr AS fr
       FROM coef c JOIN bary b USING (model_id, l, ir)""",
    uses="coef bary",
)
def merge_harmonics(spark, sf):
    return harmonics.merge_harmonics(fx.coefficients(spark, sf, 1.0), fx.coefficients(spark, sf, 0.3))


@query(
    "merge_catalogs",
    "model_id halo_v0:6 halo_on disk_on gas_on dr:6 psi0:6 bulge_const:9",
    """SELECT model_id, h_v0 AS halo_v0, true AS halo_on, d1_on AS disk_on, g_on AS gas_on, 0.4e0 AS dr,
         CASE WHEN h_on THEN h_v0*h_v0 WHEN b_on THEN b_v0*b_v0 ELSE 0 END AS psi0,
         CASE WHEN b_on THEN b_v0*b_v0/(4*pi()*b_a*b_a) END AS bulge_const FROM models""",
    uses="models",
)
def merge_catalogs(spark, sf):
    c = models.component_constants(fx.catalog(spark, sf))
    out = harmonics.merge_catalogs(models.halo_only(c), models.baryons_only(c))
    return out.select(
        "model_id", F.col("halo.v0").alias("halo_v0"), F.col("halo.enabled").alias("halo_on"),
        F.col("disk.enabled").alias("disk_on"), F.col("gas.enabled").alias("gas_on"), "grid.dr", "psi0", "bulge_const",
    )


def cells_sql(coef: str = "coef") -> str:
    pair = ", ".join(
        f"max({v}) FILTER (l = {l} AND k = {k}) AS {v}{l}{side}"
        for l in (0, 2, 4) for v in ("apot", "fr") for k, side in ((0, "h"), (1, "l"))
    )
    return f"""(SELECT model_id, ir + k AS cell, {pair} FROM {coef}, (SELECT unnest([0, 1]) AS k) kk
      WHERE ir + k BETWEEN 1 AND 60 GROUP BY model_id, ir + k)"""


def located_sql(points: str) -> str:
    return f"(SELECT *, sqrt(R*R + z*z) AS rs, least(greatest(floor(sqrt(R*R + z*z)/0.4e0)::BIGINT + 1, 1), 60) AS cell FROM {points})"


def interpolated_sql(points: str, coef: str = "coef") -> str:
    mix = ", ".join(f"{v}{l}h*t + {v}{l}l*(1 - t) AS {v}_{l}" for l in (0, 2, 4) for v in ("apot", "fr"))
    return f"(SELECT *, rs/0.4e0 - (cell - 1) AS t, {mix} FROM {located_sql(points)} JOIN {cells_sql(coef)} USING (model_id, cell))"


def force_sql(points: str, coef: str = "coef", analytic: bool = True) -> str:
    """psi, f_r, f_z of the points; the analytic parts are added from the model table."""
    norm = {l: f"sqrt({2 * l + 1}/(4*pi()))" for l in (0, 2, 4)}
    p = {0: "1", 2: "(3*c*c - 1)/2", 4: "(35*c**4 - 30*c*c + 3)/8"}
    dp = {0: "0", 2: "3*c", 4: "(140*c**3 - 60*c)/8"}
    a = {l: f"(CASE WHEN rs > 24e0 THEN apot{l}h*(24e0/rs)**{l + 1} ELSE apot_{l} END)" for l in p}
    f = {l: f"(CASE WHEN rs > 24e0 THEN apot{l}h*{l + 1}/24e0*(24e0/rs)**{l + 2} ELSE fr_{l} END)" for l in p}
    psi = " + ".join(f"{norm[l]}*({p[l]})*{a[l]}" for l in p)
    rad = " + ".join(f"{norm[l]}*({p[l]})*{f[l]}" for l in p)
    turn = " + ".join(f"{norm[l]}*s*({dp[l]})*{a[l]}" for l in p)
    base = f"""(SELECT * EXCLUDE (rs), -(s*rad + c/rs*turn) AS hr, -(c*rad - s/rs*turn) AS hz FROM (
        SELECT *, {psi} AS hpsi, {rad} AS rad, {turn} AS turn FROM (SELECT *, z/rs AS c, R/rs AS s FROM {interpolated_sql(points, coef)})))"""
    if not analytic:
        return f"(SELECT *, hpsi AS psi, hr AS f_r, hz AS f_z FROM {base})"
    return f"""(SELECT *, hpsi + d1_psi + {on('d2', 'd2_psi')} + {on('g', 'g_psi')} AS psi,
        hr + d1_fr + {on('d2', 'd2_fr')} + {on('g', 'g_fr')} AS f_r, hz + d1_fz + {on('d2', 'd2_fz')} + {on('g', 'g_fz')} AS f_z
        FROM {with_models(base, disk_sql('d1'), disk_sql('d2'), GAS_SQL)})"""


def _cells(spark, sf, scale: float = 1.0):
    return harmonics.harmonic_cells(fx.coefficients(spark, sf, scale), fx.LMAX)


@query(
    "harmonic_interpolate",
    "particle_id mass model_id cell:i r_sph:6 apot_0:6 apot_2:6 apot_4:6 fr_0:6 fr_2:6 fr_4:6",
    f"SELECT *, rs AS r_sph FROM {interpolated_sql('pts')}",
    uses="pts coef",
)
def harmonic_interpolate(spark, sf):
    return harmonics.harmonic_interpolate(
        fx.points(spark, sf), _cells(spark, sf), fx.catalog(spark, sf), lmax=fx.LMAX
    )


@query(
    "evaluate_potential",
    "particle_id mass model_id R:6 z psi:6",
    f"SELECT * FROM {force_sql('pts')}",
    uses="pts coef models",
)
def evaluate_potential(spark, sf):
    return harmonics.evaluate_potential(
        fx.points(spark, sf), _cells(spark, sf), fx.catalog(spark, sf), lmax=fx.LMAX
    )


@query(
    "evaluate_force",
    "particle_id mass model_id psi:6 f_r:6 f_z:6",
    f"SELECT * FROM {force_sql('pts')}",
    uses="pts coef models",
)
def evaluate_force(spark, sf):
    return harmonics.evaluate_force(fx.points(spark, sf), _cells(spark, sf), fx.catalog(spark, sf), lmax=fx.LMAX)


@query(
    "circular_velocity",
    "particle_id mass v:5",
    f"SELECT particle_id, mass, sqrt(greatest(0, -f_r*R))*100 AS v FROM {force_sql('pts')}",
    uses="pts coef models",
)
def circular_velocity(spark, sf):
    out = evaluate_force(spark, sf)
    return out.withColumn("v", harmonics.circular_velocity(F.col("f_r"), F.col("R"), 100.0))


RADII_SQL = "(SELECT s_suppkey AS model_id, i, i*(100e0/300) AS R, 0e0 AS z FROM supplier, (SELECT unnest(range(1, 301)) AS i) ii)"


def _speed(columns: str, source: str) -> str:
    return f"(SELECT model_id, i, R, sqrt(greatest(0, -f_r*R))*100 AS {columns} FROM {source})"


def decomposition_sql(total: str, halo: str, bulge: str | None) -> str:
    join = f"LEFT JOIN {_speed('vb', bulge)} b USING (model_id, i)" if bulge else ""
    vb = "vb" if bulge else "NULL"
    return f"""
      SELECT model_id, i, t.R AS r, vt AS v_total, vh AS v_halo, {vb} AS v_bulge,
        sqrt(greatest(0, vt*vt - vh*vh - coalesce({vb}*{vb}, 0))) AS v_disk
      FROM {_speed('vt', total)} t JOIN {_speed('vh', halo)} h USING (model_id, i) {join}"""


@query(
    "rotation_decomposition",
    "model_id i:i r:6 v_total:5 v_halo:5 v_bulge:5 v_disk:4",
    decomposition_sql(
        force_sql(RADII_SQL),
        force_sql(RADII_SQL, "bary", analytic=False),
        force_sql(f"(SELECT * FROM {RADII_SQL} WHERE model_id % 4 <> 0)", "bary", analytic=False),
    ),
    uses="coef bary models",
)
def rotation_decomposition(spark, sf):
    c = fx.catalog(spark, sf)
    radii = harmonics.midplane_radii(c)
    low = _cells(spark, sf, 0.3)
    cells = harmonics.tagged_cells({"total": _cells(spark, sf), "halo": low, "bulge": low.filter(F.col("model_id") % 4 != 0)})
    return harmonics.tagged_decomposition(radii, cells, c, lmax=fx.LMAX, scale=100.0)


COMPARED_SQL = f"(SELECT *, sqrt(greatest(0, -f_r*R)) AS v_model FROM {force_sql('(SELECT *, R_kpc/4.465e0 AS R, 0e0 AS z FROM obs)')})"


@query(
    "compare_to_observed",
    "galaxy_id obs_id R_kpc:6 v_model:6",
    f"SELECT * FROM {COMPARED_SQL}",
    uses="obs coef models",
)
def compare_to_observed(spark, sf):
    return harmonics.compare_to_observed(
        fx.observed(spark, sf), _cells(spark, sf), fx.catalog(spark, sf), lmax=fx.LMAX
    )


@query(
    "rotation_curve_scale",
    "galaxy_id n:i v_scale:6 rms:5 disk_mass_msun:0 halo_mass_msun:0 halo_radius_kpc:6",
    f"""SELECT galaxy_id, n, v_scale, rms, 10*v_scale**2/4.3e-6 AS disk_mass_msun, 80*v_scale**2/4.3e-6 AS halo_mass_msun, 90 AS halo_radius_kpc
        FROM (SELECT galaxy_id, count(*) AS n, any_value(k) AS v_scale, sqrt(avg(((v_model*k - V_kms/100)/(sigma_kms/100))**2)) AS rms
              FROM {COMPARED_SQL} c JOIN (SELECT galaxy_id, sum(v_model*V_kms/100)/sum(v_model*v_model) AS k FROM {COMPARED_SQL} GROUP BY 1) s
              USING (galaxy_id) GROUP BY galaxy_id)""",
    uses="obs coef models",
)
def rotation_curve_scale(spark, sf):
    masses = fx.observed(spark, sf).select("galaxy_id").distinct().withColumns(
        {"mass_disk": F.lit(10.0), "mass_bulge": F.lit(1.0), "mass_halo": F.lit(80.0), "radius_halo": F.lit(90.0)}
    )
    return fitting.rotation_curve_scale(compare_to_observed(spark, sf), masses)


@query(
    "rotation_curve_masses",
    "galaxy_id n:i v_scale:6 disk_mass_msun:0 bulge_mass_msun:0 halo_mass_msun:0 halo_radius_kpc:6",
    f"""SELECT galaxy_id, n, v_scale, coalesce(md, 0)*v_scale**2/4.3e-6 AS disk_mass_msun, coalesce(mb, 0)*v_scale**2/4.3e-6 AS bulge_mass_msun,
          coalesce(mh, 0)*v_scale**2/4.3e-6 AS halo_mass_msun, halo_radius_kpc
        FROM (SELECT galaxy_id, count(*) AS n, sum(v_model*V_kms/100)/sum(v_model*v_model) AS v_scale FROM {COMPARED_SQL} GROUP BY 1) s
        LEFT JOIN (SELECT p_brand AS galaxy_id, sum(l_quantity/1000.0) FILTER (l_returnflag = 'A') AS md,
            sum(l_quantity/1000.0) FILTER (l_returnflag NOT IN ('A', 'N') AND p_brand NOT LIKE '%1') AS mb,
            sum(l_quantity/1000.0) FILTER (l_returnflag = 'N') AS mh, max(l_linenumber*10.0) FILTER (l_returnflag = 'N') AS halo_radius_kpc
          FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) m USING (galaxy_id)""",
    uses="obs coef models",
)
def rotation_curve_masses(spark, sf):
    """Masses in long form: of each part's lines, by galaxy and component; some galaxies have no bulge."""
    flag = F.col("l_returnflag")
    lines = fx.table(spark, sf, "lineitem").select(
        "l_partkey",
        F.when(flag == "A", "disk").when(flag == "N", "halo").otherwise("bulge").alias("component"),
        (F.col("l_quantity") / 1000.0).alias("mass"),
        (F.col("l_linenumber") * 10.0).alias("radius"),
    )
    brands = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("galaxy_id"))
    rows = lines.join(brands, "l_partkey").where(~((F.col("component") == "bulge") & F.col("galaxy_id").endswith("1")))
    masses = rows.groupBy("galaxy_id", "component").agg(F.sum("mass").alias("mass"), F.max("radius").alias("radius"))
    return fitting.rotation_curve_scale(compare_to_observed(spark, sf), masses)


@query(
    "edge_correction",
    "model_id edge_correction:6",
    "SELECT model_id, sqrt(1/(4*pi()))*sum(apot - fr*24e0/(l + 1)) AS edge_correction FROM coef WHERE ir = 60 GROUP BY model_id",
    uses="coef",
)
def edge_correction(spark, sf):
    return harmonics.edge_correction(fx.coefficients(spark, sf), fx.catalog(spark, sf))


# ---- multipoles from particles ------------------------------------------------------------

def shells_sql(source: str = "p", group: str = "halo_id") -> str:
    rows = f"(SELECT {group}, mass, z/{pq.RSPH} AS c, floor({pq.RSPH}/0.4e0)::BIGINT AS shell FROM {source})"
    return f"""(SELECT {group}, l, shell, (shell + 0.5)*0.4e0 AS r,
        (2*l + 1)*sum(mass*CASE l WHEN 0 THEN 1 WHEN 2 THEN (3*c*c - 1)/2 ELSE (35*c**4 - 30*c*c + 3)/8 END)
          /(4*pi()/3*(((shell + 1)*0.4e0)**3 - (shell*0.4e0)**3)) AS rho
      FROM {rows}, (SELECT unnest([0, 2, 4]) AS l) ll WHERE shell < 60 GROUP BY {group}, l, shell)"""


def outside_sql(source: str = "p", group: str = "halo_id") -> str:
    """Mass by order beyond the grid and inside it, shell by shell."""
    rows = f"(SELECT {group}, mass, z/{pq.RSPH} AS c, least(floor({pq.RSPH}/0.4e0)::BIGINT, 60) AS shell FROM {source})"
    return f"""SELECT {group}, l, shell, sum(mass*CASE l WHEN 0 THEN 1 WHEN 2 THEN (3*c*c - 1)/2 ELSE (35*c**4 - 30*c*c + 3)/8 END) AS mass_l
      FROM {rows}, (SELECT unnest([0, 2, 4]) AS l) ll GROUP BY {group}, l, shell"""


@query(
    "multipole_density",
    "halo_id l:i shell:i r:6 rho:7 mass_l:6",
    f"SELECT m.*, s.r, s.rho FROM ({outside_sql()}) m LEFT JOIN {shells_sql()} s ON s.halo_id = m.halo_id AND s.l = m.l AND s.shell = m.shell",
)
def multipole_density(spark, sf):
    return multipoles.multipole_density(
        fx.particles(spark, sf), dr=fx.DR, nr=fx.NR, lmax=fx.LMAX, group_cols=["halo_id"]
    )


def multipole_sql(group: str = "halo_id") -> str:
    beyond = f"""beyond AS MATERIALIZED (SELECT {group}, l, (2*l + 1)/(4*pi())*sum(mass*CASE l WHEN 0 THEN 1 WHEN 2 THEN (3*c*c - 1)/2 ELSE (35*c**4 - 30*c*c + 3)/8 END/s**(l + 1)) AS moment
        FROM (SELECT {group}, mass, {pq.RSPH} AS s, z/s AS c FROM p) q, (SELECT unnest([0, 2, 4]) AS l) ll WHERE s >= 60*0.4e0 GROUP BY {group}, l),"""
    outer = """CASE WHEN shell = 0 AND l >= 2 THEN 0 WHEN l = 2 THEN rho*ln((shell + 1)*0.4e0/nullif(shell*0.4e0, 0))
      WHEN l = 0 THEN rho*(((shell + 1)*0.4e0)**2 - (shell*0.4e0)**2)/2
      ELSE rho*(1/((shell + 1)*0.4e0)**2 - 1/nullif(shell*0.4e0, 0)**2)/(-2) END"""
    return f"""
      SELECT {group}, l, ir, r, coalesce(rho, 0)/norm AS adens,
        4*pi()/(2*l + 1)/norm*CASE WHEN ir = 0 THEN CASE WHEN l = 0 THEN o ELSE 0 END ELSE i/r**(l + 1) + o*r**l END AS apot,
        4*pi()/(2*l + 1)/norm*CASE WHEN ir = 0 THEN 0 ELSE (l + 1)*i/r**(l + 2) - l*o*r**(l - 1) END AS fr
      FROM (SELECT n.*, s.rho, coalesce((SELECT sum(ri) FROM parts q WHERE q.{group} = n.{group} AND q.l = n.l AND q.shell < n.ir), 0) AS i,
              coalesce((SELECT sum(ro) FROM parts q WHERE q.{group} = n.{group} AND q.l = n.l AND q.shell >= n.ir), 0)
                + coalesce((SELECT moment FROM beyond b WHERE b.{group} = n.{group} AND b.l = n.l), 0) AS o
            FROM (SELECT *, ir*0.4e0 AS r, sqrt((2*l + 1)/(4*pi())) AS norm FROM (SELECT DISTINCT {group}, l FROM parts) d,
                    (SELECT unnest(range(0, 61)) AS ir) ii) n
            LEFT JOIN parts s ON s.{group} = n.{group} AND s.l = n.l AND s.shell = n.ir)""", f"""{beyond}
      parts AS MATERIALIZED (SELECT {group}, l, shell, rho,
        rho*(((shell + 1)*0.4e0)**(l + 3) - (shell*0.4e0)**(l + 3))/(l + 3) AS ri, {outer} AS ro FROM {shells_sql(group=group)})"""


_body, _parts = multipole_sql()


@query(
    "multipole_potential",
    "halo_id l:i ir:i r:6 adens:6 apot:6 fr:6",
    f"WITH {_parts} {_body}",
)
def multipole_potential(spark, sf):
    return multipoles.multipole_potential(multipole_density(spark, sf), dr=fx.DR, nr=fx.NR, group_cols=["halo_id"])


GRID_SQL = """(SELECT s_suppkey AS model_id, i, j, i*0.5e0 AS r, j*0.5e0 - 1.5e0 AS z, (s_suppkey % 5 + 1)*exp(-i/10e0)*cos(j/3e0) AS psi,
    sin(i/4e0)*(j - 3) AS f_r, (i + 1)/(j + 2e0) AS f_z
  FROM supplier, (SELECT unnest(range(0, 41)) AS i) ii, (SELECT unnest(range(0, 7)) AS j) jj)"""


@query(
    "grid_lookup_bilinear",
    "particle_id mass model_id psi:6 f_r:6 f_z:6",
    "WITH g AS MATERIALIZED " + GRID_SQL + """, q AS (SELECT *, least(greatest(floor(R/0.5e0)::BIGINT, 0), 39) AS ix,
         least(greatest(floor((z + 1.5e0)/0.5e0)::BIGINT, 0), 5) AS iz, R/0.5e0 - ix AS s, (z + 1.5e0)/0.5e0 - iz AS t FROM pts)
       SELECT particle_id, mass, q.model_id, """
    + ", ".join(
        f"(1-s)*(1-t)*a.{v} + s*(1-t)*b.{v} + (1-s)*t*c.{v} + s*t*d.{v} AS {v}" for v in ("psi", "f_r", "f_z")
    )
    + """ FROM q JOIN (SELECT model_id, i, j, {'psi': psi, 'f_r': f_r, 'f_z': f_z} AS a,
          lead(a) OVER (PARTITION BY model_id, j ORDER BY i) AS b, lead(a) OVER (PARTITION BY model_id, i ORDER BY j) AS c FROM g) l
         ON l.model_id = q.model_id AND l.i = ix AND l.j = iz
       JOIN (SELECT model_id, i - 1 AS i, j - 1 AS j, {'psi': psi, 'f_r': f_r, 'f_z': f_z} AS d FROM g) u ON u.model_id = q.model_id AND u.i = ix AND u.j = iz""",
    uses="pts",
)
def grid_lookup_bilinear(spark, sf):
    return grids.grid_lookup_bilinear(fx.points(spark, sf), _grid(spark, sf), group_cols=["model_id"])


def _grid(spark, sf):
    k = F.col("s_suppkey")
    g = fx.suppliers(spark, sf).select(k.alias("model_id"), F.explode(F.sequence(F.lit(0), F.lit(40))).alias("i"))
    g = g.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(6))))
    i, j = F.col("i"), F.col("j")
    return g.select(
        "model_id",
        (i * F.lit(0.5)).alias("r"),
        (j * F.lit(0.5) - 1.5).alias("z"),
        ((F.col("model_id") % 5 + 1) * F.exp(-i / 10.0) * F.cos(j / 3.0)).alias("psi"),
        (F.sin(i / 4.0) * (j - 3)).alias("f_r"),
        ((i + 1) / (j + 2.0)).alias("f_z"),
    )


# ---- rules ---------------------------------------------------------------------------------

REQUIRED = ("disk", "halo", "bulge", "gasdisk", "manifest")

# every component that has particles, a gas disk where the model has gas on, and a manifest of the models that the other catalog has
PRESENT_SQL = """(SELECT DISTINCT halo_id AS model_id, component AS name FROM p
    UNION SELECT s_suppkey, 'gasdisk' FROM supplier WHERE s_suppkey % 3 = 0 UNION SELECT s_suppkey, 'manifest' FROM supplier WHERE s_suppkey % 6 <> 5)"""
MISSING_SQL = f"""SELECT s_suppkey AS model_id, name FROM supplier, (SELECT unnest(['disk', 'halo', 'bulge', 'gasdisk', 'manifest']) AS name) n
       WHERE (s_suppkey, name) NOT IN (SELECT (model_id, name) FROM {PRESENT_SQL} present)"""


@query("missing_artifacts", "model_id name", MISSING_SQL)
def missing_artifacts(spark, sf):
    c = fx.catalog(spark, sf)
    present = fx.particles(spark, sf).select(F.col("halo_id").alias("model_id"), F.col("component").alias("name"))
    gas = c.filter(F.col("gas.enabled")).select("model_id", F.lit("gasdisk").alias("name"))
    manifests = _other_catalog(c).select("model_id", F.lit("manifest").alias("name"))
    return quality.missing_artifacts(c, present.unionByName(gas).unionByName(manifests), REQUIRED)


def _spoiled(spark, sf):
    """Coefficients with a few infinities and NaNs."""
    bad = (F.col("model_id") % 10 == 3) & (F.col("ir") == 7)
    worse = (F.col("model_id") % 10 == 4) & (F.col("l") == 2) & (F.col("ir") > 50)
    return fx.coefficients(spark, sf).withColumns(
        {
            "apot": F.when(bad, F.lit(float("inf"))).otherwise(F.col("apot")),
            "fr": F.when(worse, F.lit(float("nan"))).otherwise(F.col("fr")),
        }
    )


@query(
    "finite_check",
    "model_id bad_adens:i bad_apot:i bad_fr:i n:i passed",
    """SELECT model_id, count(*) AS n, count(*) FILTER (NOT isfinite(adens)) AS bad_adens, count(*) FILTER (NOT isfinite(apot)) AS bad_apot,
         count(*) FILTER (NOT isfinite(fr)) AS bad_fr, bad_adens + bad_apot + bad_fr = 0 AS passed
       FROM (SELECT model_id, adens, CASE WHEN model_id % 10 = 3 AND ir = 7 THEN 'inf'::DOUBLE ELSE apot END AS apot,
               CASE WHEN model_id % 10 = 4 AND l = 2 AND ir > 50 THEN 'nan'::DOUBLE ELSE fr END AS fr FROM coef) GROUP BY model_id""",
    uses="coef",
)
def finite_check(spark, sf):
    return quality.finite_check(_spoiled(spark, sf))


@query(
    "grid_match",
    "model_id matches",
    "SELECT s_suppkey AS model_id, s_suppkey % 6 NOT IN (2, 5) AS matches FROM supplier",
    uses="",
)
def grid_match(spark, sf):
    c = fx.catalog(spark, sf)
    return quality.grid_match(c, _other_catalog(c))


def _other_catalog(c):
    """The catalog with other grids and disks for some models, and some models gone."""
    k = F.col("model_id")
    other = c.withColumns(
        {
            "grid": F.when(k % 6 == 2, F.col("grid").withField("nr", F.lit(99))).otherwise(F.col("grid")),
            "disk": F.when(k % 4 == 1, F.col("disk").withField("mass", F.lit(1.0))).otherwise(F.col("disk")),
        }
    )
    return other.filter(k % 6 != 5)


AT_8_SQL = "(SELECT s_suppkey AS model_id, 8e0 AS R, 0e0 AS z FROM supplier)"


def report_sql() -> str:
    """Rules of the consistency report, one SELECT per input."""

    def rule(name: str, ok: str, seen: str, source: str) -> str:
        return f"""SELECT model_id, '{name}' AS rule, coalesce({ok}, false) AS passed, CAST({seen} AS DOUBLE) AS observed FROM {source}"""

    f8 = force_sql(AT_8_SQL)
    v8 = "sqrt(greatest(0, -f_r*8))"
    grid = "(SELECT s_suppkey AS model_id, s_suppkey % 6 NOT IN (2, 5) AS m FROM supplier)"
    mass = """(SELECT halo_id AS model_id, sum(mass) FILTER (component = 'disk') AS d, sum(mass) FILTER (component = 'halo') AS h FROM p GROUP BY 1)"""
    disk = """(SELECT model_id, d1_mass AS a, CASE WHEN model_id % 6 <> 5 THEN CASE WHEN model_id % 4 = 1 THEN 1 ELSE d1_mass END END AS b FROM models)"""
    spoiled = """(SELECT model_id, count(*) FILTER (model_id % 10 = 3 AND ir = 7) AS bad FROM coef GROUP BY model_id)"""
    k5 = "(SELECT model_id, omega_h, sqrt(greatest(0, d2psi_dr2 + 3*omega_h*omega_h)) AS kappa FROM knots WHERE i = 10)"
    missing = f"(SELECT s_suppkey AS model_id, count(name) AS n FROM supplier LEFT JOIN ({MISSING_SQL}) m ON m.model_id = s_suppkey GROUP BY 1)"
    scalars = "(SELECT s_suppkey AS model_id, s_suppkey % 50 - 1 AS rt, (s_suppkey % 40)/10.0 AS q FROM supplier)"
    rules = [
        rule("artifacts_present", "n = 0", "n", missing),
        rule("grid_matches_manifest", "m", "NULL", grid),
        rule("grid_matches_model", "m", "NULL", grid),
        rule("disk_mass_matches", "a IS NOT DISTINCT FROM b", "b", disk),
        rule("round_trip", "bad = 0", "bad", spoiled),
        rule("merge_finite", "bad = 0", "bad", spoiled),
        rule("potential_positive", "psi > 0", "psi", f8),
        rule("force_inward", "f_r < 0", "f_r", f8),
        rule("midplane_force_flat", "abs(f_z) <= 0.1", "f_z", f8),
        rule("circular_velocity_range", f"{v8} > 1 AND {v8} < 4", v8, f8),
        rule("masses_positive", "d > 0 AND h > 0", "least(d, h)", mass),
        rule("halo_outweighs_disk", "h >= d", "h - d", mass),
        rule("omega_positive", "omega_h > 0", "omega_h", k5),
        rule("kappa_positive", "kappa > 0", "kappa", k5),
        rule("central_correction", "f_d >= 0.5", "f_d", "(SELECT * FROM knots WHERE i = 0)"),
        rule("tidal_radius_positive", "rt > 0", "rt", scalars),
        rule("toomre_range", "q > 0.5 AND q < 3", "q", scalars),
    ]
    return " UNION ALL ".join(rules)


REPORT_SQL = f"SELECT *, CASE WHEN passed THEN 'ok' ELSE 'failed: ' || rule END AS detail FROM ({report_sql()})"


@query(
    "consistency_report",
    "model_id rule passed observed:5 detail",
    REPORT_SQL,
    uses="p models coef knots",
)
def consistency_report(spark, sf):
    c = fx.catalog(spark, sf)
    k = F.col("model_id")
    knots = fx.knots(spark, sf)
    p = fx.particles(spark, sf).withColumnRenamed("halo_id", "model_id")
    at_8 = c.select("model_id", F.lit(8.0).alias("R"), F.lit(0.0).alias("z"))
    omega = F.col("omega_h")
    other = _other_catalog(c)
    return quality.consistency_report(
        c,
        manifest=other,
        stored=other,
        merged=_spoiled(spark, sf),
        reread=(_spoiled(spark, sf), fx.coefficients(spark, sf)),
        force_at_8=harmonics.evaluate_force(at_8, _cells(spark, sf), c, lmax=fx.LMAX),
        masses=p.groupBy("model_id", "component").agg(F.sum("mass").alias("mass")),
        at_5=knots.filter(F.col("i") == 10).select(
            "model_id",
            omega.alias("omega"),
            F.sqrt(F.greatest(F.lit(0.0), F.col("d2psi_dr2") + omega * omega * 3.0)).alias("kappa"),
        ),
        correction=knots.filter(F.col("i") == 0).select("model_id", "f_d"),
        scalars=c.select("model_id", (k % 50 - 1.0).alias("tidal_radius"), (k % 40 / 10.0).alias("toomre_q")),
        missing=missing_artifacts(spark, sf),
    )


# ---- composites -----------------------------------------------------------------------------

_centred = f"""(SELECT particle_id, halo_id AS model_id, mass, x - cx AS x, y - cy AS y, z - cz AS z
  FROM p JOIN o{cq.ROUNDS} USING (halo_id))"""


@query(
    "halo_from_particles",
    FITTED,
    f"""WITH {cq.core_ctes('halo_id', 10.0)}, ctr AS MATERIALIZED {_centred},
        fit AS MATERIALIZED ({cq.nfw_fit_sql(pq.enclosed_mass_sql('model_id', 'ctr'), 'model_id')})
        SELECT m.model_id, coalesce(f.v0, h_v0) AS v0, coalesce(f.a, h_a) AS a, greatest(h_out, f.r_outer) AS r_outer,
          f.a IS NOT NULL OR h_on AS halo_on, d1_mass AS disk_mass FROM models m LEFT JOIN fit f ON f.model_id = m.model_id""",
    uses="p models",
)
def halo_from_particles_query(spark, sf):
    p = fx.particles(spark, sf).withColumnRenamed("halo_id", "model_id")
    return _flat_halo(halo_from_particles(p, fx.catalog(spark, sf)))


SUPER_COEF = """(SELECT model_id, l, ir, r, c.apot + b.apot AS apot, c.fr + b.fr AS fr FROM coef c JOIN bary b USING (model_id, l, ir, r))"""


@query(
    "fixed_halo_superposition",
    "model_id i:i r:6 v_total:6 v_halo:6 v_disk:5",
    decomposition_sql(force_sql(RADII_SQL, SUPER_COEF), force_sql(RADII_SQL, analytic=False), None).replace("*100", ""),
    uses="coef bary models",
)
def fixed_halo_superposition_query(spark, sf):
    c = models.component_constants(fx.catalog(spark, sf))
    return fixed_halo_superposition(
        fx.coefficients(spark, sf), models.halo_only(c), fx.coefficients(spark, sf, 0.3), models.baryons_only(c), lmax=fx.LMAX
    )


# the same shells for (halo, component), and forces in the plane, where only the values of the polynomials at 0 are left
_KEYED = "(SELECT * REPLACE (halo_id*10 + CASE component WHEN 'disk' THEN 0 WHEN 'halo' THEN 1 ELSE 2 END AS halo_id) FROM particles)"
PARTICLE_CURVES_SQL = f"""
    WITH particles AS (SELECT * FROM p), keyed AS {_KEYED}, {_parts.replace('FROM p', 'FROM keyed')}, every AS MATERIALIZED ({_body}),
    part AS MATERIALIZED (SELECT halo_id // 10 AS model_id, halo_id % 10 AS k, ir, sum(fr*sqrt((2*l + 1)/(4*pi()))*CASE l WHEN 0 THEN 1 WHEN 2 THEN -0.5e0 ELSE 0.375e0 END) AS pull
      FROM every GROUP BY ALL),
    pts AS (SELECT m.model_id, k, g.i, g.i*(20e0/50) AS R, least(floor(R/0.4e0)::INT, 59) AS cell, R/0.4e0 - cell AS t
      FROM (SELECT DISTINCT model_id, k FROM part) m, (SELECT unnest(range(1, 51)) AS i) g),
    v AS (SELECT pts.model_id, pts.k, i, R, R*(a.pull*(1 - t) + b.pull*t) AS vv FROM pts JOIN part a ON a.model_id = pts.model_id AND a.k = pts.k AND a.ir = cell
      JOIN part b ON b.model_id = pts.model_id AND b.k = pts.k AND b.ir = cell + 1),
    s AS (SELECT model_id, i, max(R) AS r, greatest(0, sum(vv)) AS t, greatest(0, max(vv) FILTER (k = 1)) AS h, greatest(0, max(vv) FILTER (k = 2)) AS b FROM v GROUP BY model_id, i)
    SELECT model_id, i, r, sqrt(t) AS v_total, sqrt(h) AS v_halo, sqrt(b) AS v_bulge, sqrt(greatest(0, t - h - coalesce(b, 0))) AS v_disk FROM s WHERE h IS NOT NULL"""


@query("superposition_from_particles", "model_id i:i r:6 v_total:4 v_halo:5 v_bulge:5 v_disk:3", PARTICLE_CURVES_SQL)
def superposition_from_particles_query(spark, sf):
    p = fx.particles(spark, sf).withColumnRenamed("halo_id", "model_id")
    return superposition_from_particles(p, dr=fx.DR, nr=fx.NR, lmax=fx.LMAX, n=50, rmax=20.0)


@query(
    "galaxy_report",
    "section component model_id:i item metric value:5",
    f"""WITH prof AS ({pq.DISK_PROFILE_SQL}), summ AS ({pq._dispersion_sql('component')}), crv AS ({cq.RESAMPLE_SQL}), chk AS ({REPORT_SQL})
        SELECT 'summary' AS section, component, NULL::BIGINT AS model_id, 'all' AS item, metric, value FROM (
          SELECT component, unnest(['n', 'total_mass', 'sigma_vx', 'sigma_vy', 'sigma_vz']) AS metric,
            unnest([n, total_mass, sigma_vx, sigma_vy, sigma_vz]) AS value FROM summ)
        UNION ALL SELECT 'profile', component, NULL, bin::INT::VARCHAR, metric, value FROM (
          SELECT component, bin, unnest(['n', 'sigma_z', 'sigma_vz', 'mean_vphi', 'sigma_vR', 'surface_density']) AS metric,
            unnest([n, sigma_z, sigma_vz, mean_vphi, sigma_vR, surface_density]) AS value FROM prof)
        UNION ALL SELECT 'curve', component, NULL, i::VARCHAR, 'v', y FROM crv
        UNION ALL SELECT 'check', NULL, model_id, rule, 'passed', passed::INT::DOUBLE FROM chk""",
    uses="p models coef knots",
)
def galaxy_report_query(spark, sf):
    return galaxy_report(fx.particles(spark, sf), checks=consistency_report(spark, sf))
