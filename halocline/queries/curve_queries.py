"""Curves, splines, centring and fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from halocline import fixtures as fx
from halocline.functions import dual
from halocline.operators import curves, fitting, profiles, splines
from halocline.operators.least_squares import least_squares_fit
from halocline.queries.particle_queries import RSPH, enclosed_mass_sql
from halocline.queries.registry import query

CURVE_SQL = f"""
    SELECT component, particle_id, mass, r, m_enc, sqrt(m_enc/r) AS v FROM (
      SELECT component, particle_id, mass, {RSPH} AS r,
        sum(mass) OVER (PARTITION BY component ORDER BY {RSPH}, particle_id, mass
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m_enc FROM p)"""


@query("particle_rotation_curve", "component particle_id mass r:6 m_enc:6 v:6", CURVE_SQL)
def particle_rotation_curve(spark, sf):
    return curves.particle_rotation_curve(fx.particles(spark, sf))


RESAMPLE_SQL = f"""
    SELECT component, i, x, coalesce(any_value(v0 + (v1 - v0)/(r1 - r0)*(x - r0)), 0) AS y
    FROM (SELECT component, i, i*(100e0/499) AS x FROM (SELECT DISTINCT component FROM p) k,
            (SELECT unnest(range(0, 500)) AS i) g) grid
    LEFT JOIN (SELECT component AS c, r AS r0, v AS v0, lead(r) OVER w AS r1, lead(v) OVER w AS v1 FROM ({CURVE_SQL})
               WINDOW w AS (PARTITION BY component ORDER BY r, particle_id, mass)) s
      ON c = component AND r0 < x AND r1 >= x
    GROUP BY component, i, x"""


@query("linear_resample", "component i:i x:6 y:6", RESAMPLE_SQL)
def linear_resample(spark, sf):
    curve = curves.particle_rotation_curve(fx.particles(spark, sf))
    return curves.linear_resample(curve, start=0.0, stop=100.0, num=500, group_cols=["component"])


@query(
    "combined_rotation_curve",
    "i:i r:6 v_halo:6 v_disk:6 v_total:6",
    f"""SELECT i, x AS r, vh AS v_halo, vd AS v_disk, sqrt(vh*vh + vd*vd) AS v_total FROM (
          SELECT i, x, max(y) FILTER (component = 'halo') AS vh, max(y) FILTER (component = 'disk') AS vd
          FROM ({RESAMPLE_SQL}) GROUP BY i, x)""",
)
def combined_rotation_curve(spark, sf):
    return curves.combined_rotation_curve(fx.particles(spark, sf))


@query(
    "finite_difference",
    "model_id i:i R:6 dydx:6",
    """SELECT model_id, i, R, (lead(omega_h) OVER w - lag(omega_h) OVER w)/(lead(R) OVER w - lag(R) OVER w) AS dydx
       FROM knots WINDOW w AS (PARTITION BY model_id ORDER BY i)""",
    uses="knots",
)
def finite_difference(spark, sf):
    return curves.finite_difference(fx.knots(spark, sf), x="R", y="omega_h", group_cols=["model_id"])


@query(
    "simpson_table",
    "model_id integral:6",
    """SELECT model_id, sum(omega_h*CASE WHEN i = 0 OR i = 50 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)*0.5e0/3 AS integral
       FROM knots GROUP BY model_id""",
    uses="knots",
)
def simpson_table(spark, sf):
    return curves.simpson_table(fx.knots(spark, sf), group_cols=["model_id"], x="R", y="omega_h")


@query(
    "argmax_table",
    "model_id x_max:6 y_max:6",
    """WITH b AS (SELECT model_id, arg_max(i, (wave, -i)) AS k FROM knots GROUP BY model_id),
       n AS (SELECT model_id, max(R) FILTER (i = k) AS x0, max(wave) FILTER (i = k) AS y0,
               max(wave) FILTER (i = k - 1) AS ym, max(wave) FILTER (i = k + 1) AS yp FROM knots JOIN b USING (model_id) GROUP BY model_id)
       SELECT model_id, CASE WHEN ym IS NULL OR yp IS NULL THEN x0 ELSE x0 + 0.5*(ym - yp)/2/(ym - 2*y0 + yp) END AS x_max,
         CASE WHEN ym IS NULL OR yp IS NULL THEN y0 ELSE y0 - (ym - yp)*(0.5*(ym - yp)/(ym - 2*y0 + yp))/4 END AS y_max FROM n""",
    uses="knots",
)
def argmax_table(spark, sf):
    return curves.argmax_table(fx.knots(spark, sf), group_cols=["model_id"], x="R", y="wave")


# for equal spacing the inverse of the (1, 4, 1) matrix is known in closed form
_RATE = "ln(2 + sqrt(3e0))"
_TOEPLITZ = f"(CASE WHEN (i + j) % 2 = 0 THEN 1 ELSE -1 END)*sinh(least(i, j)*{_RATE})*sinh((50 - greatest(i, j))*{_RATE})/(sinh({_RATE})*sinh(50*{_RATE}))"


# one row holds a table's bends, so that there is no pair of knots to join
@query(
    "spline_coefficients",
    "model_id knot:i R:6 wave:6 y2:6",
    f"""WITH d AS (SELECT model_id, i, 6*(lead(wave) OVER w - 2*wave + lag(wave) OVER w)/0.25e0 AS bend
                  FROM knots WINDOW w AS (PARTITION BY model_id ORDER BY i)),
        b AS (SELECT model_id, list(bend ORDER BY i) AS bends FROM d WHERE i BETWEEN 1 AND 49 GROUP BY model_id)
        SELECT model_id, i AS knot, R, wave,
          CASE WHEN i BETWEEN 1 AND 49 THEN list_sum([bends[j]*{_TOEPLITZ} for j in range(1, 50)]) ELSE 0 END AS y2
        FROM knots JOIN b USING (model_id)""",
    uses="knots",
)
def spline_coefficients(spark, sf):
    return splines.spline_coefficients(fx.knots(spark, sf), x="R", y="wave", group_cols=["model_id"], block=20)


# the same cubics in powers of the share of the interval; the slope's roots from the textbook formula
@query(
    "spline_maximum",
    "model_id x_max:6 y_max:6",
    f"""WITH d AS (SELECT model_id, i, 6*(lead(wave) OVER w - 2*wave + lag(wave) OVER w)/0.25e0 AS bend
                  FROM knots WINDOW w AS (PARTITION BY model_id ORDER BY i)),
        b AS (SELECT model_id, list(bend ORDER BY i) AS bends FROM d WHERE i BETWEEN 1 AND 49 GROUP BY model_id),
        k AS (SELECT model_id, i, R, wave AS y, CASE WHEN i BETWEEN 1 AND 49 THEN list_sum([bends[j]*{_TOEPLITZ} for j in range(1, 50)]) ELSE 0 END AS m FROM knots JOIN b USING (model_id)),
        s AS (SELECT *, (m1 - m)*0.25e0/6 AS c3, m*0.25e0/2 AS c2, y1 - y - c3 - c2 AS c1, sqrt(greatest(0, c2*c2 - 3*c1*c3)) AS root
              FROM (SELECT *, lead(y) OVER w AS y1, lead(m) OVER w AS m1 FROM k WINDOW w AS (PARTITION BY model_id ORDER BY i))),
        t AS (SELECT model_id, R, y, c1, c2, c3, unnest([0e0, (-c2 - root)/(3*c3), (-c2 + root)/(3*c3)]) AS t FROM s),
        v AS (SELECT model_id, R + coalesce(t*0.5e0, 0) AS x, CASE WHEN t = 0 THEN y ELSE y + t*(c1 + t*(c2 + t*c3)) END AS y FROM t WHERE t >= 0 AND t < 1)
        SELECT model_id, arg_max(x, (y, -x)) AS x_max, max(y) AS y_max FROM v GROUP BY model_id""",
    uses="knots",
)
def spline_maximum(spark, sf):
    return curves.spline_maximum(spline_coefficients(spark, sf), x="R", y="wave", group_cols=["model_id"])


# a curve R exp(-R/a) is highest at a, or at the bound nearest to it
@query(
    "bounded_maximum",
    "model_id x_max:5 y_max:6",
    "SELECT model_id, x AS x_max, x*exp(-x/h_a) AS y_max FROM (SELECT model_id, h_a, least(greatest(h_a, 10), 30) AS x FROM models)",
    uses="models",
)
def bounded_maximum(spark, sf):
    bounds = fx.catalog(spark, sf).select("model_id", F.col("halo.a").alias("s"), F.lit(10.0).alias("a"), F.lit(30.0).alias("b"))
    return curves.maximize(bounds, lambda r: r * F.exp(-r / F.col("s")), xtol=1e-8)


@query(
    "spline_lookup",
    "particle_id mass model_id R:6 value:6",
    """SELECT particle_id, mass, model_id, R, a*y0 + b*y1 + ((a*a*a - a)*m0 + (b*b*b - b)*m1)*0.25e0/6 AS value FROM (
         SELECT q.*, k0.omega_h AS y0, k1.omega_h AS y1, (k1.R - q.R)/0.5e0 AS a, (q.R - k0.R)/0.5e0 AS b,
           k0.omega_h*0.125e0/((1 + k0.R/4e0)*(1 + k0.R/4e0)) AS m0, k1.omega_h*0.125e0/((1 + k1.R/4e0)*(1 + k1.R/4e0)) AS m1
         FROM (SELECT *, least(floor(R*2), 49)::INT AS cell FROM pts) q
         JOIN knots k0 ON k0.model_id = q.model_id AND k0.i = cell
         JOIN knots k1 ON k1.model_id = q.model_id AND k1.i = cell + 1)""",
    uses="pts knots",
)
def spline_lookup(spark, sf):
    u = F.col("R") / 4.0 + 1.0
    k = fx.knots(spark, sf).withColumn("y2", F.col("omega_h") * 0.125 / (u * u))
    return splines.spline_lookup(
        fx.points(spark, sf), k, at="R", x="R", y="omega_h", group_cols=["model_id"]
    )


# ---- centring and fits -------------------------------------------------------------------

# the library's own default
ROUNDS = 20


def core_ctes(group: str, radius: float, rounds: int = ROUNDS) -> str:
    """CTEs o0 .. o{rounds}: the offset of every group after each round."""
    eps = radius * 0.001
    out = [f"o0 AS MATERIALIZED (SELECT DISTINCT {group}, 0e0 AS cx, 0e0 AS cy, 0e0 AS cz, false AS settled FROM p)"]
    for i in range(rounds):
        out.append(
            f"""o{i + 1} AS MATERIALIZED (SELECT {group},
              CASE WHEN still THEN cx ELSE cx + dx END AS cx, CASE WHEN still THEN cy ELSE cy + dy END AS cy,
              CASE WHEN still THEN cz ELSE cz + dz END AS cz, still AS settled
            FROM (SELECT *, abs(dx) < {eps} AND abs(dy) < {eps} AND abs(dz) < {eps} AS still FROM (
              SELECT o{i}.*, coalesce(dx, 0) AS dx, coalesce(dy, 0) AS dy, coalesce(dz, 0) AS dz FROM o{i} LEFT JOIN (
                SELECT {group}, sum(mass*(x - cx))/sum(mass) AS dx, sum(mass*(y - cy))/sum(mass) AS dy,
                  sum(mass*(z - cz))/sum(mass) AS dz
                FROM p JOIN o{i} USING ({group})
                WHERE (x - cx)*(x - cx) + (y - cy)*(y - cy) + (z - cz)*(z - cz) < {radius * radius}e0 GROUP BY {group})
              USING ({group}))))"""
        )
    return ", ".join(out)


@query(
    "center_on_core",
    "particle_id mass halo_id x:5 y:5 z:5 settled",
    f"""WITH {core_ctes("halo_id", 10.0)} SELECT particle_id, mass, halo_id, x - cx AS x, y - cy AS y, z - cz AS z, settled
        FROM p JOIN o{ROUNDS} USING (halo_id)""",
)
def center_on_core(spark, sf):
    return fitting.center_on_core(fx.particles(spark, sf), group_cols=["halo_id"], settled="settled")


def nfw_fit_sql(profile: str, g: str, steps: int = 64, refinements: int = 4) -> str:
    f = "(ln(1 + r/a) - (r/a)/(1 + r/a))"
    out = [
        f"prof AS MATERIALIZED (SELECT {g}, r, m_enc AS m, r_max FROM ({profile}) WHERE m_enc > 0)",
        f"""f0 AS (SELECT {g}, ln(min(r)*0.5) AS lo, ln(max(r)*2) AS hi, NULL AS best FROM prof GROUP BY {g}
              HAVING count(*) >= 3)""",
    ]
    for i in range(refinements + 1):
        out.append(
            f"""f{i + 1} AS MATERIALIZED (SELECT {g}, greatest(any_value(lo), min(la) - any_value((hi - lo)/{steps})) AS lo,
                  least(any_value(hi), min(la) + any_value((hi - lo)/{steps})) AS hi, min(la) AS best
                FROM (SELECT *, min(sse) OVER (PARTITION BY {g}) AS least_sse FROM (
                      SELECT {g}, lo, hi, la, sum(m*m) AS mm, sum(m*m) - sum(m*{f})*sum(m*{f})/sum({f}*{f}) AS sse
                      FROM (SELECT {g}, lo, hi, la, exp(la) AS a FROM (
                              SELECT {g}, lo, hi, lo + k*(hi - lo)/{steps} AS la FROM f{i}, (SELECT unnest(range(0, {steps + 1})) AS k) ks))
                      JOIN prof USING ({g}) GROUP BY {g}, lo, hi, la))
                WHERE sse <= least_sse + 1e-12*mm GROUP BY {g})"""
        )
    last = f"f{refinements + 1}"
    return f"""
    WITH {", ".join(out)}, s AS (SELECT {g}, any_value(a) AS a, sum(m*{f})/sum({f}*{f}) AS m_scale, any_value(r_max) AS r_outer
      FROM (SELECT {g}, exp(best) AS a FROM {last}) JOIN prof USING ({g}) GROUP BY {g})
    SELECT {g}, a, m_scale, r_outer, sqrt(m_scale*(ln(3) - 2e0/3)/(2*a))/sqrt(ln(3)/2) AS v0,
      (SELECT sqrt(avg(((s.m_scale*{f} - m)/m)**2)) FROM prof WHERE prof.{g} = s.{g}) AS rms_residual
    FROM s"""


# Near its minimum the residual is flat to rounding over several steps of the last refinement, so the point with
# the least one depends on the order of summing. Both sides take the smallest radius within 1e-12 of the masses' square sum instead.
@query(
    "nfw_fit",
    "halo_id v0:4 a:3 r_outer:5 m_scale:2 rms_residual:4",
    nfw_fit_sql(enclosed_mass_sql(), "halo_id"),
)
def nfw_fit(spark, sf):
    profile = profiles.enclosed_mass(fx.particles(spark, sf), group_cols=["halo_id"])
    return fitting.nfw_fit(profile, group_cols=["halo_id"])


SCAN_BOUNDS = {"v0": (50.0, 400.0), "a": (1.0, 20.0)}


def _scan_sql(rounds: int = 2, steps: int = 8) -> str:
    ks = f"(SELECT unnest(range(0, {steps + 1})) AS kv) x, (SELECT unnest(range(0, {steps + 1})) AS ka) y"
    out = ["b0 AS (SELECT DISTINCT galaxy_id, 50e0 AS vlo, 400e0 AS vhi, 1e0 AS alo, 20e0 AS ahi FROM obs)"]
    for i in range(rounds):
        hv, ha = ((hi - lo) / steps * (2.0 / steps) ** i for lo, hi in SCAN_BOUNDS.values())
        out.append(
            f"""s{i} AS (SELECT galaxy_id, kv, ka, v, a, sum(((v*(1 - exp(-R_kpc/a)) - V_kms)/sigma_kms)**2) AS chi2, count(*) AS n
               FROM (SELECT galaxy_id, kv, ka, vlo + (vhi - vlo)*kv/{steps} AS v, alo + (ahi - alo)*ka/{steps} AS a FROM b{i}, {ks})
               JOIN obs USING (galaxy_id) GROUP BY ALL)"""
        )
        out.append(
            f"""b{i + 1} AS (SELECT galaxy_id, greatest(50e0, v - {hv}) AS vlo, least(400e0, v + {hv}) AS vhi, greatest(1e0, a - {ha}) AS alo,
                 least(20e0, a + {ha}) AS ahi, v, a, chi2, n
               FROM s{i} QUALIFY row_number() OVER (PARTITION BY galaxy_id ORDER BY chi2, kv, ka) = 1)"""
        )
    return f"WITH {', '.join(out)} SELECT galaxy_id, v AS v0, a, chi2, n FROM b{rounds}"


@query("parameter_scan", "galaxy_id v0:6 a:6 chi2:3 n:i", _scan_sql(), uses="obs")
def parameter_scan(spark, sf):
    return fitting.parameter_scan(
        fx.observed(spark, sf),
        lambda p: p["v0"] * (F.lit(1.0) - F.exp(-F.col("R_kpc") / p["a"])),
        SCAN_BOUNDS,
        observed="V_kms",
        sigma="sigma_kms",
        steps=8,
        refinements=1,
        group_cols=["galaxy_id"],
    )


def _fit_sql(steps: int = 64, refinements: int = 6) -> str:
    """The same minimum found otherwise: the speed is linear, so only the length is searched, on a narrowing ladder."""
    out = ["l0 AS (SELECT DISTINCT galaxy_id, 1e0 AS lo, 20e0 AS hi, 0e0 AS a, 0e0 AS v, 0e0 AS chi2, 0 AS n FROM obs)"]
    for i in range(refinements + 1):
        out.append(
            f"""l{i + 1} AS MATERIALIZED (SELECT galaxy_id, greatest(1e0, a - (hi - lo)/{steps}) AS lo, least(20e0, a + (hi - lo)/{steps}) AS hi, a, v, chi2, n FROM (
                SELECT *, oo - 2*v*vo + v*v*vv AS chi2 FROM (
                  SELECT galaxy_id, lo, hi, a, count(*) AS n, sum(f*f/(s*s)) AS vv, sum(f*V_kms/(s*s)) AS vo, sum(V_kms*V_kms/(s*s)) AS oo, least(400e0, greatest(50e0, vo/vv)) AS v
                  FROM (SELECT galaxy_id, lo, hi, a, V_kms, sigma_kms AS s, 1 - exp(-R_kpc/a) AS f
                        FROM (SELECT galaxy_id, lo, hi, lo + k*(hi - lo)/{steps} AS a FROM l{i}, (SELECT unnest(range(0, {steps + 1})) AS k) ks) JOIN obs USING (galaxy_id))
                  GROUP BY galaxy_id, lo, hi, a))
              QUALIFY row_number() OVER (PARTITION BY galaxy_id ORDER BY chi2, a) = 1)"""
        )
    return f"WITH {', '.join(out)} SELECT galaxy_id, v AS v0, a, chi2, n, true AS success FROM l{refinements + 1}"


@query("least_squares_fit", "galaxy_id v0:3 a:4 chi2:3 n:i success", _fit_sql(), uses="obs")
def least_squares(spark, sf):
    return least_squares_fit(
        fx.observed(spark, sf),
        lambda p: p["v0"] * (1.0 - dual.exp(-dual.col("R_kpc") / p["a"])),
        {"v0": 200.0, "a": 5.0},
        observed="V_kms",
        sigma="sigma_kms",
        bounds=SCAN_BOUNDS,
        group_cols=["galaxy_id"],
    )
