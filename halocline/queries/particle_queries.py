"""Particle projections, filters, moments, profiles, centring."""

from __future__ import annotations

from pyspark.sql import functions as F

from halocline import fixtures as fx
from halocline.operators import frames, moments, ordering, profiles
from halocline.queries.registry import query

RCYL = "sqrt(x*x + y*y)"
RSPH = "sqrt(x*x + y*y + z*z)"


# ---- component tables ------------------------------------------------------------

@query(
    "union_components",
    "particle_id component mass x vz",
    "SELECT particle_id, component, mass, x, vz FROM p",
)
def union_components(spark, sf):
    p = fx.particles(spark, sf)
    return frames.union_components(
        {c: p.filter(F.col("component") == c).drop("component") for c in ("disk", "bulge", "halo")}
    )


@query(
    "replace_component",
    "particle_id component mass x",
    """SELECT particle_id, component, mass, x FROM p WHERE component <> 'halo'
       UNION ALL SELECT particle_id, 'halo', mass*2, -x FROM p WHERE component = 'disk'""",
)
def replace_component(spark, sf):
    p = fx.particles(spark, sf)
    external = p.filter(F.col("component") == "disk").withColumns({"mass": F.col("mass") * 2, "x": -F.col("x")})
    return frames.replace_component(p, "halo", external)


# ---- projections --------------------------------------------------------------------

@query(
    "unit_convert",
    "particle_id mass:0 x:6 vx:6 mass_back:9 vx_back:6",
    """SELECT particle_id, mass*2.325e9 AS mass, x*1.0 AS x, vx*100 AS vx,
       mass*2.325e9/2.325e9 AS mass_back, vx*100/100 AS vx_back FROM p""",
)
def unit_convert(spark, sf):
    kinds = {"mass": "mass", "x": "length", "vx": "velocity"}
    out = frames.unit_convert(fx.particles(spark, sf), kinds)
    back = {"mass_back": "mass", "vx_back": "velocity"}
    out = out.withColumns({"mass_back": F.col("mass"), "vx_back": F.col("vx")})
    return frames.unit_convert(out, back, to_physical=False)


@query(
    "cylindrical_kinematics",
    "particle_id mass r:6 R_cyl:6 v_phi:6 v_R:6 v_z:6 v_phi_sq:6 v_R_sq:6 R_dot_a:6",
    f"""SELECT particle_id, mass, {RSPH} AS r, {RCYL} AS R_cyl, (x*vy - y*vx)/{RCYL} AS v_phi,
        (x*vx + y*vy)/{RCYL} AS v_R, vz AS v_z, ((x*vy - y*vx)/{RCYL})**2 AS v_phi_sq,
        ((x*vx + y*vy)/{RCYL})**2 AS v_R_sq, x*(vy/10) + y*(vz/10) AS R_dot_a FROM p""",
)
def cylindrical_kinematics(spark, sf):
    p = fx.particles(spark, sf).withColumns({"ax": F.col("vy") / 10, "ay": F.col("vz") / 10})
    return frames.cylindrical_kinematics(p, acc=("ax", "ay"))


@query(
    "frame_shift",
    "particle_id mass:9 x:6 y:6 z:6 vx:6 vy:6 vz:6",
    """SELECT particle_id, mass/(1e10/2.325e9) AS mass, x + 10 AS x, y - 5 AS y, z + 2.5 AS z,
       (vx*100 + 30)/(0.8e0**1.5e0) AS vx, (vy*100 - 20)/(0.8e0**1.5e0) AS vy, (vz*100 + 5)/(0.8e0**1.5e0) AS vz FROM p""",
)
def frame_shift(spark, sf):
    return frames.frame_shift(fx.particles(spark, sf), (10.0, -5.0, 2.5), (30.0, -20.0, 5.0), scale_factor=0.8)


@query(
    "recenter",
    "particle_id mass x:6 y:6 z:6 vx:6 vy:6 vz:6",
    """SELECT particle_id, mass, x - cx AS x, y - cy AS y, z - cz AS z, vx - cu AS vx, vy - cv AS vy, vz - cw AS vz
       FROM p JOIN (SELECT halo_id, sum(mass*x)/sum(mass) cx, sum(mass*y)/sum(mass) cy, sum(mass*z)/sum(mass) cz,
         sum(mass*vx)/sum(mass) cu, sum(mass*vy)/sum(mass) cv, sum(mass*vz)/sum(mass) cw FROM p GROUP BY halo_id) c
       USING (halo_id)""",
)
def recenter(spark, sf):
    return frames.recenter(fx.particles(spark, sf), vel=frames.VEL, group_cols=["halo_id"])


# ---- filters ------------------------------------------------------------------------

@query(
    "annulus_filter",
    "particle_id mass x y z vx vy vz",
    f"SELECT * FROM p WHERE {RCYL} > 2.6e0 AND {RCYL} < 2.8e0",
)
def annulus_filter(spark, sf):
    return frames.annulus_filter(fx.particles(spark, sf))


@query("sphere_filter", "particle_id mass x y z", "SELECT * FROM p WHERE x*x + y*y + z*z < 5e0*5e0")
def sphere_filter(spark, sf):
    return frames.sphere_filter(fx.particles(spark, sf), 5.0)


@query(
    "min_count_filter",
    "halo_id bin:i n:i",
    f"""SELECT halo_id, floor({RCYL}/0.4e0) AS bin, count(*) AS n FROM p GROUP BY ALL HAVING count(*) > 10""",
)
def min_count_filter(spark, sf):
    p = frames.cylindrical_kinematics(fx.particles(spark, sf))
    counts = p.groupBy("halo_id", profiles.radial_bin(F.col("R_cyl"), 50, 20.0).alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return frames.min_count_filter(counts)


@query(
    "limit_particles",
    "particle_id component mass",
    """SELECT particle_id, component, mass FROM p
       QUALIFY row_number() OVER (PARTITION BY component ORDER BY particle_id, mass) <= 1000""",
)
def limit_particles(spark, sf):
    return ordering.limit_particles(fx.particles(spark, sf), 1000)


# ---- order --------------------------------------------------------------------------

@query(
    "assign_ids",
    "particle_id mass id:i",
    "SELECT particle_id, mass, row_number() OVER (ORDER BY particle_id, mass) AS id FROM p",
)
def assign_ids(spark, sf):
    return ordering.assign_ids(fx.particles(spark, sf).select("particle_id", "mass"), ["particle_id", "mass"])


@query(
    "component_subsample",
    "particle_id component mass",
    """SELECT particle_id, component, mass FROM (
         SELECT *, row_number() OVER (PARTITION BY component ORDER BY draw, particle_id, mass) AS k FROM (
           SELECT *, (first*48271 + 12345) % 2147483647 AS draw FROM (
             SELECT *, ((particle_id % 2147483647)*48271 + 42*7919 + 12345) % 2147483647 AS first FROM p)))
       WHERE (component = 'disk' AND k <= 500) OR (component = 'halo' AND k <= 2500)""",
)
def component_subsample(spark, sf):
    return ordering.component_subsample(fx.particles(spark, sf), {"disk": 500, "halo": 2500, "bulge": 0}, seed=-42)


# ---- moments -------------------------------------------------------------------------

@query("total_mass", "halo_id total_mass:6", "SELECT halo_id, sum(mass) AS total_mass FROM p GROUP BY halo_id")
def total_mass(spark, sf):
    return moments.total_mass(fx.particles(spark, sf), group_cols=["halo_id"])


@query(
    "center_of_mass",
    "halo_id com_x:6 com_y:6 com_z:6",
    """SELECT halo_id, sum(mass*x)/sum(mass) AS com_x, sum(mass*y)/sum(mass) AS com_y, sum(mass*z)/sum(mass) AS com_z
       FROM p GROUP BY halo_id""",
)
def center_of_mass(spark, sf):
    return moments.center_of_mass(fx.particles(spark, sf), group_cols=["halo_id"])


def _dispersion_sql(g: str) -> str:
    return f"""
    SELECT {g}, count(*) AS n, sum(mass) AS total_mass, sqrt(sum(mass*(vx-mu)**2)/sum(mass)) AS sigma_vx,
      sqrt(sum(mass*(vy-mv)**2)/sum(mass)) AS sigma_vy, sqrt(sum(mass*(vz-mw)**2)/sum(mass)) AS sigma_vz
    FROM p JOIN (SELECT {g}, sum(mass*vx)/sum(mass) mu, sum(mass*vy)/sum(mass) mv, sum(mass*vz)/sum(mass) mw
                 FROM p GROUP BY {g}) c USING ({g}) GROUP BY {g}"""


@query(
    "velocity_dispersion", "halo_id n:i total_mass:6 sigma_vx:6 sigma_vy:6 sigma_vz:6", _dispersion_sql("halo_id")
)
def velocity_dispersion(spark, sf):
    return moments.velocity_dispersion(fx.particles(spark, sf), group_cols=["halo_id"])


@query(
    "component_summary", "component n:i total_mass:6 sigma_vx:6 sigma_vy:6 sigma_vz:6", _dispersion_sql("component")
)
def component_summary(spark, sf):
    return moments.component_summary(fx.particles(spark, sf))


@query(
    "frame_means",
    "component mean_x:6 mean_y:6 mean_z:6 mean_vx:6 mean_vy:6 mean_vz:6",
    """SELECT component, avg(x + 10) AS mean_x, avg(y) AS mean_y, avg(z) AS mean_z, avg(vx*100 + 30) AS mean_vx,
       avg(vy*100) AS mean_vy, avg(vz*100) AS mean_vz FROM p GROUP BY component""",
)
def frame_means(spark, sf):
    shifted = frames.frame_shift(fx.particles(spark, sf), (10.0, 0.0, 0.0), (30.0, 0.0, 0.0))
    return moments.frame_means(shifted, group_cols=["component"])


@query(
    "expected_mass_check",
    "halo_id first_mass n:i declared_n:i implied_mass:6 within",
    """SELECT f.*, declared_n, first_mass*declared_n AS implied_mass,
         abs(first_mass*declared_n/model_mass - 1) <= 0.05e0 AS within
       FROM (SELECT halo_id, arg_min(mass, (particle_id, mass)) AS first_mass, count(*) AS n FROM p GROUP BY halo_id) f
       JOIN (SELECT s_suppkey AS halo_id, s_suppkey % 50 + 600 AS declared_n, s_suppkey % 9 + 10.0 AS model_mass
             FROM supplier) e USING (halo_id)""",
)
def expected_mass_check(spark, sf):
    k = F.col("s_suppkey")
    expected = fx.table(spark, sf, "supplier").select(
        k.alias("halo_id"), (k % 50 + 600).alias("declared_n"), (k % 9 + 10.0).alias("model_mass")
    )
    return moments.expected_mass_check(fx.particles(spark, sf), expected, group_cols=["halo_id"])


# ---- profiles -------------------------------------------------------------------------

DISK_PROFILE_SQL = f"""
    SELECT component, bin, count(*) AS n, avg(z) AS mean_z, stddev_pop(z) AS sigma_z, avg(vz*100) AS mean_vz,
      stddev_pop(vz*100) AS sigma_vz, avg(vphi) AS mean_vphi, avg(vr) AS mean_vR, stddev_pop(vr) AS sigma_vR,
      avg(vphi*vphi) AS mean_vphi_sq, avg(ra) AS mean_R_dot_a, (bin + 0.5)*0.4e0 AS r,
      sum(mass)/(pi()*(((bin + 1)*0.4e0)**2 - (bin*0.4e0)**2)) AS surface_density
    FROM (SELECT *, floor({RCYL}/0.4e0) AS bin, (x*vy - y*vx)*100/{RCYL} AS vphi, (x*vx + y*vy)*100/{RCYL} AS vr,
            x*(vy/10) + y*(vz/10) AS ra FROM p)
    WHERE bin < 50 GROUP BY component, bin HAVING count(*) > 10"""

DISK_PROFILE_COLUMNS = (
    "component bin:i n:i r:6 mean_z:6 sigma_z:6 mean_vz:5 sigma_vz:5 mean_vphi:5 mean_vR:5 sigma_vR:5 "
    "mean_vphi_sq:3 mean_R_dot_a:6 surface_density:6"
)


@query("radial_profile_disk", DISK_PROFILE_COLUMNS, DISK_PROFILE_SQL)
def radial_profile_disk(spark, sf):
    p = fx.particles(spark, sf).withColumns({"ax": F.col("vy") / 10, "ay": F.col("vz") / 10})
    return profiles.radial_profile_disk(p, acc=("ax", "ay"), group_cols=["component"])


@query(
    "radial_profile_gas",
    "component bin:i n:i r:6 log_number_density:6 mean_z:6 sigma_z:6 mean_vz:6 sigma_vz:6 mean_vphi:6 sigma_vphi:6 mean_vR:6 sigma_vR:6",
    f"""SELECT component, bin, count(*) AS n, avg(z) AS mean_z, stddev_pop(z) AS sigma_z, avg(vz) AS mean_vz,
          stddev_pop(vz) AS sigma_vz, avg(vphi) AS mean_vphi, stddev_pop(vphi) AS sigma_vphi, avg(vr) AS mean_vR,
          stddev_pop(vr) AS sigma_vR, 2 + (bin + 0.5)*0.36e0 AS r,
          log10(count(*)/(pi()*((2 + (bin + 1)*0.36e0)**2 - (2 + bin*0.36e0)**2))) AS log_number_density
        FROM (SELECT *, floor(({RCYL} - 2e0)/0.36e0) AS bin, (x*vy - y*vx)/{RCYL} AS vphi, (x*vx + y*vy)/{RCYL} AS vr FROM p)
        WHERE bin >= 0 AND bin < 50 GROUP BY component, bin HAVING count(*) > 10""",
)
def radial_profile_gas(spark, sf):
    return profiles.radial_profile_gas(fx.particles(spark, sf), rmin=2.0, group_cols=["component"])


@query(
    "map_2d_profile",
    "component bin:i iz:i n:i r:6 log_number_density:6 mean_vphi:4",
    f"""WITH q AS (SELECT *, floor({RCYL}/0.4e0) AS bin, (x*vy - y*vx)*100/{RCYL} AS vphi FROM p),
        s AS (SELECT component, bin, 2*stddev_pop(z) AS zmax FROM q WHERE bin < 50 GROUP BY component, bin HAVING count(*) > 10),
        c AS (SELECT component, bin, round((z + zmax)/(zmax/4)) AS iz, count(*) AS k, avg(vphi) AS v
              FROM q JOIN s USING (component, bin) GROUP BY ALL)
        SELECT component, bin, f.iz, coalesce(k, 0) AS n, (bin + 0.5)*0.4e0 AS r,
          coalesce(log10(k/(pi()*(((bin + 1)*0.4e0)**2 - (bin*0.4e0)**2))), -100) AS log_number_density, coalesce(v, 0) AS mean_vphi
        FROM (SELECT component, bin, unnest(range(0, 9)) AS iz FROM s) f LEFT JOIN c USING (component, bin, iz)""",
)
def map_2d_profile(spark, sf):
    return profiles.map_2d_profile(fx.particles(spark, sf), group_cols=["component"])


@query(
    "density_histogram",
    "component bin:i n:i r:6 weighted:6",
    f"""SELECT component, bin, n, 0.1e0 + bin*(199.9e0/399) AS r, n/(0.1e0 + (bin + 1)*(199.9e0/399))**2 AS weighted
        FROM (SELECT component, least(floor(({RSPH} - 0.1e0)/(199.9e0/399)), 398) AS bin, count(*) AS n FROM p
              WHERE {RSPH} >= 0.1e0 AND {RSPH} <= 200e0 GROUP BY ALL)""",
)
def density_histogram(spark, sf):
    return profiles.density_histogram(fx.particles(spark, sf), group_cols=["component"])


@query(
    "velocity_histogram",
    "component axis bin:i v_lo:6 n:i",
    """WITH v AS (SELECT component, unnest(['vx', 'vy', 'vz']) AS axis, unnest([vx, vy, vz]) AS v FROM p),
       b AS (SELECT component, axis, min(v) AS lo, max(v) AS hi FROM v GROUP BY ALL),
       c AS (SELECT component, axis, least(floor((v - lo)/(hi - lo)*50), 49) AS bin, count(*) AS n
             FROM v JOIN b USING (component, axis) GROUP BY ALL)
       SELECT component, axis, f.bin, lo + (hi - lo)/50*f.bin AS v_lo, coalesce(n, 0) AS n
       FROM (SELECT *, unnest(range(0, 50)) AS bin FROM b) f LEFT JOIN c USING (component, axis, bin)""",
)
def velocity_histogram(spark, sf):
    return profiles.velocity_histogram(fx.particles(spark, sf), group_cols=["component"])


def enclosed_mass_sql(g: str = "halo_id", source: str = "p", n: int = 40) -> str:
    return f"""
    SELECT {g}, bin, lo*exp(step*(bin + 0.5)) AS r, edge AS r_edge, sum(CASE WHEN rr <= edge THEN mass ELSE 0 END) AS m_enc,
      any_value(r_max) AS r_max
    FROM (SELECT *, CASE WHEN bin = {n - 1} THEN r_max ELSE lo*exp(step*(bin + 1)) END AS edge
          FROM (SELECT *, ln(r_max/lo)/{n} AS step, unnest(range(0, {n})) AS bin
                FROM (SELECT {g}, greatest(min(rr), 1e-3) AS lo, max(rr) AS r_max
                      FROM (SELECT {g}, {RSPH} AS rr FROM {source}) WHERE rr > 0 GROUP BY {g})))
    JOIN (SELECT {g}, mass, {RSPH} AS rr FROM {source}) USING ({g})
    GROUP BY {g}, bin, lo, step, edge"""


@query("enclosed_mass", "halo_id bin:i r:6 r_edge:6 m_enc:6 r_max:6", enclosed_mass_sql())
def enclosed_mass(spark, sf):
    return profiles.enclosed_mass(fx.particles(spark, sf), group_cols=["halo_id"])
