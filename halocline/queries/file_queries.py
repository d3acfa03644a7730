"""Text and parquet round trips: every file is written from the given tables, then read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halocline import fixtures as fx
from halocline.operators import profiles
from halocline.queries import particle_queries as pq
from halocline.queries.model_queries import GRID_SQL, _grid
from halocline.queries.registry import query
from halocline.sources import harmonic_files, model_runs, run_folders, text
from halocline.storage import scratch_path

BY_MODEL = r"model_id=([^/]+)/[^/]+$"


def _text(*cols: Column) -> Column:
    """Numbers of a line in shortest exact form."""
    return F.concat_ws(" ", *[c.cast("string") for c in cols])


def _one_file_each(lines: DataFrame, path: str, *kinds: str) -> None:
    """Write (model_id, order, line) rows as one text file per model (and kind)."""
    text.write_keyed_text(lines, path, [*kinds, "model_id"], ["order"])


@query("scan_particles", "component mass x y z vx vy vz", "SELECT component, mass, x, y, z, vx, vy, vz FROM p")
def scan_particles(spark, sf):
    path = scratch_path(spark, "particles")
    p = fx.particles(spark, sf)
    i = F.col("particle_id")
    # some lines carry a comment, some more numbers than are read
    line = F.concat(
        text.particle_line(),
        F.when(i % 5 == 0, " 9.0 8.0").otherwise(""),
        F.when(i % 7 == 0, " # note 1 2 3").otherwise(""),
    )
    noise = p.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    noise = noise.select(
        "component",
        F.explode(
            F.array(F.concat(F.col("n").cast("string"), F.lit(" 1")), F.lit("# a comment"), F.lit(""), F.lit("1 2 3 4 5 6"), F.lit("1 2 3 4 x 6 7"))
        ).alias("value"),
    )
    p.select("component", line.alias("value")).unionByName(noise).write.partitionBy("component").text(path)
    rows = text.scan_particles(spark, path)
    return rows.withColumn("component", F.regexp_extract("file", "component=([^/]+)/", 1))


@query(
    "scan_first_particles",
    "halo_id:i mass x y z vx vy vz",
    """SELECT halo_id, mass, x, y, z, vx, vy, vz FROM p
       QUALIFY row_number() OVER (PARTITION BY halo_id ORDER BY vx, x, y, z, vy, vz, mass, particle_id) <= 100""",
)
def scan_first_particles(spark, sf):
    path = scratch_path(spark, "ordered-particles")
    order = ["vx", "x", "y", "z", "vy", "vz", "mass", "particle_id"]
    # one file for each halo, in an order of its own
    lines = fx.particles(spark, sf).withColumn("line", _text(*[F.col(c) for c in text.PARTICLE_COLUMNS]))
    text.write_keyed_text(lines, path, ["halo_id"], order)
    rows = text.scan_particles(spark, path, first=100)
    return rows.withColumn("halo_id", F.regexp_extract("file", "halo_id=([^/]+)/", 1))


@query(
    "load_components",
    "folder component mass x y z",
    """SELECT 'a' AS folder, component, mass, x, y, z FROM p WHERE component <> 'halo'
       UNION ALL SELECT 'a', 'halo', mass, x, y, z FROM p WHERE component = 'halo' AND particle_id % 2 = 0
       UNION ALL SELECT 'b', 'halo', mass, x, y, z FROM p WHERE component = 'halo'""",
)
def load_components(spark, sf):
    path = scratch_path(spark, "components")
    p = fx.particles(spark, sf)
    halo = p.filter(F.col("component") == "halo")
    for c in ("disk", "bulge"):
        text.write_particle_text(p.filter(F.col("component") == c), f"{path}/a/{c}")
    text.write_particle_text(halo, f"{path}/a/halo")
    text.write_particle_text(halo.filter(F.col("particle_id") % 2 == 0), f"{path}/a/Xhalo")
    text.write_particle_text(halo, f"{path}/b/halo")
    out = text.load_components(spark, f"{path}/*")
    return out.withColumn("folder", F.regexp_extract("folder", "([^/]+)$", 1))


@query(
    "write_particles",
    "particle_id component mass x y z vx vy vz",
    "SELECT particle_id, component, mass, x, y, z, vx, vy, vz FROM p",
)
def write_particles(spark, sf):
    path = scratch_path(spark, "sink")
    text.write_particles(fx.particles(spark, sf), path)
    return spark.read.parquet(path)


@query(
    "scan_rotation_curve",
    "R_kpc:6 V_kms:6 sigma_kms:6",
    "SELECT R_kpc, V_kms, sigma_kms FROM obs",
    uses="obs",
)
def scan_rotation_curve(spark, sf):
    path = scratch_path(spark, "observed")
    o = fx.observed(spark, sf)
    o.select(_text(F.col("R_kpc"), F.col("V_kms"), F.col("sigma_kms")).alias("value")).write.text(path)
    return text.scan_rotation_curve(spark, path)


def _harmonic_lines(spark, sf) -> DataFrame:
    """(model_id, order, line) of every model's coefficient file."""
    c = fx.catalog(spark, sf)
    d, g, k = F.col("disk"), F.col("gas"), F.col("model_id")
    zero, one = F.lit(0), F.lit(1)
    head = [
        F.lit("# chalo v0 a n v0 a dr nr lmax"),
        F.concat(F.lit("# "), _text(F.col("halo.r_outer"), F.col("halo.v0"), F.col("halo.a"), F.lit(4.0), F.lit(1.5), F.lit(0.5), F.lit(fx.DR), F.lit(fx.NR), F.lit(fx.LMAX))),
        F.lit("# constants"),
        F.concat(F.lit("# "), _text(F.lit(12.25), F.lit(0.5), F.lit(0.25))),
        # the first disk has five numbers in some files and seven in others
        F.concat(
            F.lit("# "),
            _text(d["mass"], d["scale_length"], d["scale_height"], d["outer_radius"], d["trunc_width"]),
            F.when(k % 2 == 0, " 0.5 1.5").otherwise(""),
        ),
        F.concat(F.lit("# "), _text(*[F.col("disk2")[n] for n in ("mass", "scale_length", "scale_height", "outer_radius", "trunc_width")])),
        F.concat(F.lit("# "), _text(*[g[n] for n in ("mass", "scale_length", "outer_radius", "z_scale", "trunc_width", "rz_scale", "z_max", "gamma")])),
        F.concat(F.lit("# "), _text(F.lit(3.5), F.lit(2.25), F.lit(0.125))),
        F.concat(F.lit("# "), _text(one, zero, F.col("gas.enabled").cast("int"), zero, F.col("halo.enabled").cast("int"), zero)),
        F.lit("#  OUTPUT FROM SOLVER. TOTAL POTENTIAL."),
    ]
    lines = F.posexplode(F.array(*head)).alias("pos", "line")
    header = c.select(k, lines).select("model_id", F.array(F.lit(-1), F.col("pos")).alias("order"), "line")
    rows = fx.coefficients(spark, sf)
    cols = [F.max(F.when(F.col("l") == l, F.col(v))).alias(f"{v}{l}") for v in harmonic_values for l in (0, 2, 4)]
    wide = rows.groupBy("model_id", "ir", "r").agg(*cols)
    # orders that are all zero are left off, as short rows are padded
    block = lambda v: _text(F.col("r"), F.col(f"{v}0"), F.col(f"{v}2"), F.when(F.col(f"{v}4") != 0.0, F.col(f"{v}4")))
    body = wide.select(
        "model_id", "ir", F.posexplode(F.array(*[block(v) for v in harmonic_values])).alias("block", "line")
    )
    labels = c.select(k, F.posexplode(F.array(F.lit("# potential"), F.lit("# radial force"))).alias("pos", "line"))
    body = body.select("model_id", F.array(F.col("block"), F.col("ir")).alias("order"), "line")
    labels = labels.select("model_id", F.array(F.col("pos") + 1, F.lit(-1)).alias("order"), "line")
    return header.unionByName(body).unionByName(labels)


harmonic_values = ("adens", "apot", "fr")


@query(
    "ingest_harmonics",
    "model_id:i l:i ir:i r:6 adens:6 apot:6 fr:6 disk_mass:6 outer_radius:6 hole:6 gas_on halo_on psid:6 nr:i",
    """SELECT model_id, l, ir, r, adens, apot, fr, d1_mass AS disk_mass, d1_out AS outer_radius,
         CASE WHEN model_id % 2 = 0 THEN 0.5 ELSE 0 END AS hole, g_on AS gas_on, h_on AS halo_on, 10 AS psid, 60 AS nr
       FROM coef JOIN models USING (model_id)""",
    uses="coef models",
)
def ingest_harmonics(spark, sf):
    path = scratch_path(spark, "harmonics")
    _one_file_each(_harmonic_lines(spark, sf), path)
    cat, rows, _ = harmonic_files.ingest_harmonics(spark, path, key_pattern=BY_MODEL)
    flat = cat.select(
        "model_id", F.col("disk.mass").alias("disk_mass"), "disk.outer_radius", F.col("disk.hole_radius").alias("hole"),
        F.col("gas.enabled").alias("gas_on"), F.col("halo.enabled").alias("halo_on"), "psid", "grid.nr",
    )
    return rows.join(flat, "model_id")


@query(
    "run_folder_check",
    "model_id name problem",
    """SELECT * FROM (SELECT s_suppkey::VARCHAR AS model_id, unnest(['tidal', 'manifest', 'coef', 'coef']) AS name,
         unnest([CASE WHEN s_suppkey % 6 = 5 THEN 'missing' END, CASE WHEN s_suppkey % 4 = 1 THEN 'missing' END,
           CASE WHEN s_suppkey % 10 = 4 THEN 'no coefficient block marker' END, CASE WHEN s_suppkey % 10 = 3 THEN 'wrong number of coefficient rows' END]) AS problem
       FROM supplier) each WHERE problem IS NOT NULL""",
    uses="",
)
def run_folder_check(spark, sf):
    base = scratch_path(spark, "run-folders")
    c = fx.catalog(spark, sf)
    k, first = F.col("model_id"), F.array(F.lit(0), F.lit(0)).alias("order")
    lines = _harmonic_lines(spark, sf)
    # some files lack the line before the blocks, others their last row
    unmarked = (k % 10 == 4) & F.col("line").contains(harmonic_files.MARKER)
    cut = (k % 10 == 3) & (F.col("order") == F.array(F.lit(2), F.lit(fx.NR)))
    coef = lines.filter(~unmarked & ~cut).withColumn("name", F.lit("coef"))
    tidal = c.filter(k % 6 != 5).select("model_id", first, _text(F.col("halo.r_outer")).alias("line"), F.lit("tidal").alias("name"))
    manifest = c.filter(k % 4 != 1).select("model_id", first, F.to_json("grid").alias("line"), F.lit("manifest").alias("name"))
    _one_file_each(coef.unionByName(tidal).unionByName(manifest), base, "name")
    pattern = {"run_pattern": r"model_id=([^/]+)/", "name_pattern": r"name=([^/]+)/"}
    listed = run_folders.artifact_listing(spark, f"{base}/name=*/model_id=*/*", **pattern)
    _, _, broken = harmonic_files.ingest_harmonics(spark, f"{base}/name=coef/model_id=*/*", key_pattern=BY_MODEL)
    runs = c.select(k.cast("string").alias("model_id"))
    return run_folders.folder_problems(runs, listed, ("coef", "tidal", "manifest"), ("coef", broken))


@query(
    "ingest_model_runs",
    "kind model_id:i item:6 value:6",
    """SELECT 'omega' AS kind, model_id, R AS item, omega_h AS value FROM knots
       UNION ALL SELECT 'curvature', model_id, R, d2psi_dr2 FROM knots
       UNION ALL SELECT 'f_d', model_id, R, f_d FROM knots
       UNION ALL SELECT 'sigma_r0', model_id, R, k_s0 FROM knots JOIN models USING (model_id)
       UNION ALL SELECT 'disk', model_id, d1_rd, d1_mass FROM models
       UNION ALL SELECT 'bulge', model_id, 0.5, 1 FROM models
       UNION ALL SELECT 'halo', model_id, h_a, h_out FROM models
       UNION ALL SELECT 'tidal_radius', model_id, 0, h_out*2 FROM models
       UNION ALL SELECT 'toomre_q', model_id, 0, (model_id % 40)/10.0 FROM models
       UNION ALL SELECT 'gas_norm', model_id, R, wave FROM knots
       UNION ALL SELECT 'manifest_nr', model_id, 0.4, 60 FROM models
       UNION ALL SELECT 'manifest_v0', model_id, h_a, h_v0 FROM models""",
    uses="knots models",
)
def ingest_model_runs(spark, sf):
    base = scratch_path(spark, "runs")
    tables: list[DataFrame] = []
    k, c = fx.knots(spark, sf), fx.catalog(spark, sf)
    R, i, m = F.col("R"), F.col("i"), F.col("model_id")
    zero = F.lit(0.0)
    kin = c.select("model_id", "kinematics.*")

    def table(name: str, rows: DataFrame, order, line: Column, head: DataFrame | None = None) -> str:
        out = rows.select("model_id", F.array(F.lit(0), order.cast("int")).alias("order"), line.alias("line"))
        if head is not None:
            out = out.unionByName(head)
        tables.append(out.withColumn("kind", F.lit(name)))
        return f"{base}/kind={name}"

    def head(rows: DataFrame, line: Column) -> DataFrame:
        return rows.select("model_id", F.array(F.lit(-1), F.lit(0)).alias("order"), line.alias("line"))

    freq = table(
        "frequencies",
        k,
        i,
        _text(R, F.col("omega_h"), zero, F.col("sigma_d"), zero, zero, zero, zero, F.col("d2psi_dr2")),
        head(c, F.lit("# R omega nu sigma vt vb nu psi d2psi\n1 2 3\n")),
    )
    corr = table(
        "corrections",
        k,
        i,
        _text(R, F.col("f_d"), F.col("f_sz")),
        head(kin, F.concat(F.lit("# "), _text(F.col("sigma_r0"), F.col("sigma_r_scale"), F.lit(51)))),
    )
    mass_lines = c.select(
        "model_id",
        F.posexplode(
            F.array(
                _text(F.col("disk.mass"), F.col("disk.scale_length")),
                _text(F.lit(1.0), F.lit(0.5)),
                _text(F.col("halo.r_outer"), F.col("halo.a")),
            )
        ).alias("pos", "line"),
    )
    masses = table("masses", mass_lines, F.col("pos"), F.col("line"))
    tidal = table("tidal", c, F.lit(0), _text(F.col("halo.r_outer") * 2))
    toomre = table("toomre", c, F.lit(0), _text(m % 40 / 10.0))
    norms = table("gas-norms", k, i, _text(R, F.col("wave"), zero, F.lit(1.5)))
    manifest = F.to_json(
        F.struct(
            F.lit("fixture").alias("model"),
            F.col("grid"),
            F.struct(
                F.col("halo.r_outer").alias("r_outer_kpc"), F.col("halo.v0").alias("v0_100kms"), F.col("halo.a").alias("a_kpc")
            ).alias("halo"),
        )
    )
    manifests = table("manifests", c, F.lit(0), manifest)

    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    _one_file_each(every, base, "kind")

    by = {"key_pattern": BY_MODEL}
    f = model_runs.read_frequency_tables(spark, freq, **by)
    d = model_runs.read_disk_corrections(spark, corr, **by)
    g = model_runs.read_gas_norms(spark, norms, **by)
    j = model_runs.read_manifests(spark, manifests, **by)
    mr = model_runs.read_component_masses(spark, masses, **by)

    def long(kind, df: DataFrame, item, value) -> DataFrame:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return df.select(kind.alias("kind"), "model_id", F.col(item).alias("item") if isinstance(item, str) else item.alias("item"), F.col(value).cast("double").alias("value"))

    parts = [
        long("omega", f, "R", "omega_h"),
        long("curvature", f, "R", "d2psi_dr2"),
        long("f_d", d, "R", "f_d"),
        long("sigma_r0", d, "R", "sigma_r0"),
        long(F.col("component"), mr, "radius", "mass"),
        long("tidal_radius", model_runs.read_scalars(spark, tidal, "tidal_radius", **by), zero, "tidal_radius"),
        long("toomre_q", model_runs.read_scalars(spark, toomre, "toomre_q", **by), zero, "toomre_q"),
        long("gas_norm", g, "R", "value"),
        long("manifest_nr", j, F.col("grid.dr"), "grid.nr"),
        long("manifest_v0", j, F.col("halo.a_kpc"), "halo.v0_100kms"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(
    "scan_potential_grid",
    "model_id:i block:i r:6 z:6 psi:6 f_r:6 f_z:6",
    f"""SELECT model_id, block, r, z, psi*(block + 1) AS psi, f_r, f_z FROM {GRID_SQL} g, (SELECT unnest([0, 1]) AS block) b""",
    uses="",
)
def scan_potential_grid(spark, sf):
    path = scratch_path(spark, "grid")
    rows = _grid(spark, sf).withColumn("block", F.explode(F.array(F.lit(0), F.lit(1))))
    line = _text(F.col("r"), F.col("z"), F.col("psi") * (F.col("block") + 1), F.col("f_r"), F.col("f_z"))
    body = rows.select("model_id", F.array(F.col("block"), (F.col("r") * 100).cast("int"), (F.col("z") * 100).cast("int")).alias("order"), line.alias("line"))
    gaps = rows.select("model_id", F.array(F.col("block"), F.lit(1000000), F.lit(0)).alias("order"), F.lit(" \n").alias("line")).distinct()
    _one_file_each(body.unionByName(gaps), path)
    out = text.scan_potential_grid(spark, path)
    return out.withColumn("model_id", F.regexp_extract("file", BY_MODEL, 1))


@query(
    "write_curve_table",
    "component bin:i n:i r:6 sigma_z:6 mean_vphi:5 surface_density:6",
    pq.DISK_PROFILE_SQL,
)
def write_curve_table(spark, sf):
    path = scratch_path(spark, "profile")
    prof = profiles.radial_profile_disk(fx.particles(spark, sf), group_cols=["component"])
    text.write_curve_table(prof, path, fmt="csv")
    return spark.read.csv(path, header=True, schema=prof.schema, enforceSchema=False)


@query(
    "parse_manifest",
    "event_id k:i",
    """SELECT event_id, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k FROM events""",
    uses="",
)
def parse_manifest(spark, sf):
    # event properties stand in for manifests of another shape
    e = fx.table(spark, sf, "events")
    return e.select("event_id", model_runs.parse_manifest(F.col("props"), "struct<k:bigint>")["k"].alias("k"))
