"""Particle, point, curve and model tables derived from the star-schema tables.

Each adapter returns a lazy DataFrame that grows with its source table; the
``*_SQL`` constants are the same tables as SQL for the parity check.  Values are
built from non-negative integers, with the division by a literal last, so both
engines start from identical doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halocline.operators.keys import spread
from halocline.operators.models import component

DR, NR, LMAX = 0.4, 60, 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _big(name: str) -> Column:
    return F.col(name).cast("bigint")


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of ``supplier`` over all tasks, for tables that have many rows for each."""
    return spread(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey")


def particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven-column particles with id, component and halo id, from ``lineitem``."""
    o, p, s, n = (_big(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    flag = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").select(
        (((o * 100000 + p) * 10000 + s) * 10 + n).alias("particle_id"),
        F.when(flag == "A", "disk").when(flag == "N", "halo").otherwise("bulge").alias("component"),
        s.alias("halo_id"),
        (F.col("l_quantity") / 1000.0).alias("mass"),
        (((p * 7919 + o * 31 + n * 613) % 4001 - 2000) / 100.0).alias("x"),
        (((s * 104729 + o * 17 + n * 13) % 4001 - 2000) / 100.0).alias("y"),
        (((o * 1299709 + p * 101) % 401 - 200) / 100.0).alias("z"),
        (((p * 15485863 + n * 31) % 601 - 300) / 100.0).alias("vx"),
        (((s * 32452843 + o * 7) % 601 - 300) / 100.0).alias("vy"),
        (((o * 49979687 + s * 3) % 201 - 100) / 100.0).alias("vz"),
    )


PARTICLES_SQL = """
SELECT ((l_orderkey*100000 + l_partkey)*10000 + l_suppkey)*10 + l_linenumber::BIGINT AS particle_id,
  CASE l_returnflag WHEN 'A' THEN 'disk' WHEN 'N' THEN 'halo' ELSE 'bulge' END AS component,
  l_suppkey AS halo_id,
  l_quantity/1000.0 AS mass,
  ((l_partkey*7919 + l_orderkey*31 + l_linenumber::BIGINT*613) % 4001 - 2000)/100.0 AS x,
  ((l_suppkey*104729 + l_orderkey*17 + l_linenumber::BIGINT*13) % 4001 - 2000)/100.0 AS y,
  ((l_orderkey*1299709 + l_partkey*101) % 401 - 200)/100.0 AS z,
  ((l_partkey*15485863 + l_linenumber::BIGINT*31) % 601 - 300)/100.0 AS vx,
  ((l_suppkey*32452843 + l_orderkey*7) % 601 - 300)/100.0 AS vy,
  ((l_orderkey*49979687 + l_suppkey*3) % 201 - 100)/100.0 AS vz
FROM lineitem"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(R, z) points of many models: every particle, seen in its halo's model."""
    p = particles(spark, sf_dir)
    R = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    return p.select("particle_id", "mass", F.col("halo_id").alias("model_id"), R.alias("R"), "z")


POINTS_SQL = "SELECT particle_id, mass, halo_id AS model_id, sqrt(x*x + y*y) AS R, z FROM p"


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model per supplier."""
    k = F.col("s_suppkey")
    m = lambda n: k % n
    return table(spark, sf_dir, "supplier").select(
        k.alias("model_id"),
        component(
            "halo", r_outer=m(80) + 60.0, v0=m(21) / 10.0 + 2.0, a=m(25) + 8.0, dr_trunc=m(5) + 8.0, cusp=1.0,
            enabled=m(7) != 0,
        ).alias("halo"),
        component(
            "disk", mass=m(13) + 10.0, scale_length=m(11) / 10.0 + 2.0, outer_radius=m(9) + 12.0,
            scale_height=m(7) / 20.0 + 0.2, trunc_width=m(3) / 2.0 + 1.0, hole_radius=0.0, core_radius=1.5,
            enabled=True,
        ).alias("disk"),
        component(
            "disk2", mass=m(5) + 3.0, scale_length=m(4) / 4.0 + 3.0, outer_radius=m(6) + 14.0,
            scale_height=m(5) / 10.0 + 0.6, trunc_width=1.5, enabled=m(2) == 1,
        ).alias("disk2"),
        component(
            "gas", mass=m(4) + 2.0, scale_length=m(3) + 4.0, outer_radius=m(7) + 15.0, z_scale=m(4) / 20.0 + 0.1,
            trunc_width=2.0, rz_scale=F.when(m(5) == 0, -1.0).otherwise(m(6) + 5.0), z_max=m(4) + 3.0, gamma=1.5,
            enabled=m(3) == 0,
        ).alias("gas"),
        F.when(
            m(4) != 0,
            component("bulge", n_sersic=4.0, ppp=0.5, v0=m(9) / 10.0 + 1.5, a=m(6) / 10.0 + 0.4, enabled=True),
        ).alias("bulge"),
        component("black_hole", mass=0.0, enabled=False).alias("black_hole"),
        component("grid", dr=DR, nr=NR, lmax=LMAX).alias("grid"),
        component(
            "kinematics", sigma_r0=m(5) / 10.0 + 0.7, sigma_r_scale=m(8) / 10.0 + 2.4, n_radial_steps=50,
            n_iterations=10,
        ).alias("kinematics"),
    )


MODELS_SQL = """
SELECT s_suppkey AS model_id,
  s_suppkey % 80 + 60.0 AS h_out, (s_suppkey % 21)/10.0 + 2.0 AS h_v0, s_suppkey % 25 + 8.0 AS h_a,
  s_suppkey % 5 + 8.0 AS h_tr, s_suppkey % 7 <> 0 AS h_on,
  s_suppkey % 13 + 10.0 AS d1_mass, (s_suppkey % 11)/10.0 + 2.0 AS d1_rd, s_suppkey % 9 + 12.0 AS d1_out,
  (s_suppkey % 7)/20.0 + 0.2 AS d1_zd, (s_suppkey % 3)/2.0 + 1.0 AS d1_tw, true AS d1_on,
  s_suppkey % 5 + 3.0 AS d2_mass, (s_suppkey % 4)/4.0 + 3.0 AS d2_rd, s_suppkey % 6 + 14.0 AS d2_out,
  (s_suppkey % 5)/10.0 + 0.6 AS d2_zd, 1.5e0 AS d2_tw, s_suppkey % 2 = 1 AS d2_on,
  s_suppkey % 4 + 2.0 AS g_mass, s_suppkey % 3 + 4.0 AS g_rd, s_suppkey % 7 + 15.0 AS g_out,
  (s_suppkey % 4)/20.0 + 0.1 AS g_zs, 2e0 AS g_tw,
  CASE WHEN s_suppkey % 5 = 0 THEN -1.0 ELSE s_suppkey % 6 + 5.0 END AS g_rz,
  s_suppkey % 4 + 3.0 AS g_zm, s_suppkey % 3 = 0 AS g_on,
  s_suppkey % 4 <> 0 AS b_on, (s_suppkey % 9)/10.0 + 1.5 AS b_v0, (s_suppkey % 6)/10.0 + 0.4 AS b_a,
  (s_suppkey % 5)/10.0 + 0.7 AS k_s0, (s_suppkey % 8)/10.0 + 2.4 AS k_sc
FROM supplier"""


def coefficients(spark: SparkSession, sf_dir: str, scale: float = 1.0) -> DataFrame:
    """Closed-form multipole rows (l = 0, 2, 4) on the common grid of every supplier's model."""
    k = F.col("s_suppkey")
    rows = suppliers(spark, sf_dir).select(
        k.alias("model_id"),
        ((k % 5 / 10.0 + 1.0) * scale).alias("s"),
        F.explode(F.array(*[F.lit(l) for l in range(0, LMAX + 1, 2)])).alias("l"),
    )
    rows = rows.withColumn("ir", F.explode(F.sequence(F.lit(0), F.lit(NR))))
    rows = rows.withColumn("r", F.col("ir") * F.lit(DR))
    s, r, l = F.col("s"), F.col("r"), F.col("l")
    base = r / 5.0 + 1.0
    well = r * r + 1.0
    amp = F.when(l == 2, 0.5).otherwise(0.1)
    return rows.select(
        "model_id",
        "l",
        "ir",
        "r",
        (s * F.exp(-r / 5.0) / (l + 1)).alias("adens"),
        F.when(l == 0, s * 40.0 / base).otherwise(s * amp * r / well).alias("apot"),
        F.when(l == 0, s * 8.0 / (base * base)).otherwise(-s * amp * (F.lit(1.0) - r * r) / (well * well)).alias("fr"),
    )


def coefficients_sql(scale: float = 1.0) -> str:
    return f"""
SELECT model_id, l, ir, r, s*exp(-r/5e0)/(l+1) AS adens,
  CASE WHEN l = 0 THEN s*40e0/(1e0 + r/5e0) ELSE s*amp*r/(1e0 + r*r) END AS apot,
  CASE WHEN l = 0 THEN s*8e0/((1e0 + r/5e0)*(1e0 + r/5e0)) ELSE -s*amp*(1e0 - r*r)/((1e0 + r*r)*(1e0 + r*r)) END AS fr
FROM (SELECT s_suppkey AS model_id, ((s_suppkey % 5)/10.0 + 1.0)*{scale!r}e0 AS s, l, ir, ir*0.4e0 AS r,
        CASE WHEN l = 2 THEN 0.5e0 ELSE 0.1e0 END AS amp
      FROM supplier, (SELECT unnest([0, 2, 4]) AS l) ll, (SELECT unnest(range(0, 61)) AS ir) ii) t"""


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed rotation curves, from ``part``."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("galaxy_id"),
        (k % 10).alias("model_id"),
        k.alias("obs_id"),
        F.col("p_size").cast("double").alias("R_kpc"),
        (F.col("p_retailprice") / 5.0).alias("V_kms"),
        (k % 7 + 5.0).alias("sigma_kms"),
    )


OBSERVED_SQL = """
SELECT p_brand AS galaxy_id, p_partkey % 10 AS model_id, p_partkey AS obs_id, p_size::DOUBLE AS R_kpc,
  p_retailprice/5.0 AS V_kms, p_partkey % 7 + 5.0 AS sigma_kms
FROM part"""


def knots(spark: SparkSession, sf_dir: str, n: int = 50) -> DataFrame:
    """Frequency and correction tables of every supplier's model at R = 0, 0.5 ... n/2."""
    k = F.col("s_suppkey")
    rows = suppliers(spark, sf_dir).select(
        k.alias("model_id"), F.explode(F.sequence(F.lit(0), F.lit(n))).alias("i")
    ).withColumn("R", F.col("i") / 2.0)
    r, amp = F.col("R"), F.col("model_id") % 5 / 10.0 + 1.0
    return rows.select(
        "model_id",
        "i",
        "R",
        (amp * 2.0 / (r / 4.0 + 1.0)).alias("omega_h"),
        (amp / ((r + 1.0) * (r + 1.0)) - F.when(F.col("model_id") % 3 == 0, 14.0).otherwise(0.0) * F.exp(-r)).alias("d2psi_dr2"),
        (amp * F.exp(-r / 2.5)).alias("sigma_d"),
        (F.lit(1.0) - r / 100.0).alias("f_d"),
        (F.lit(1.0) + r / 200.0).alias("f_sz"),
        F.sin(r + F.col("model_id") % 7).alias("wave"),
    )


KNOTS_SQL = """
SELECT model_id, i, R, amp*2e0/(R/4e0 + 1e0) AS omega_h,
  amp/((R + 1e0)*(R + 1e0)) - CASE WHEN model_id % 3 = 0 THEN 14e0 ELSE 0e0 END * exp(-R) AS d2psi_dr2,
  amp*exp(-R/2.5e0) AS sigma_d, 1e0 - R/100e0 AS f_d, 1e0 + R/200e0 AS f_sz, sin(R + model_id % 7) AS wave
FROM (SELECT s_suppkey AS model_id, i, i/2e0 AS R, (s_suppkey % 5)/10.0 + 1.0 AS amp
      FROM supplier, (SELECT unnest(range(0, 51)) AS i) ii) t"""
