"""Text sources and sinks, with malformed lines."""

import random

import pytest
from pyspark.sql import functions as F

from halocline import storage
from halocline.operators import frames
from halocline.sources import harmonic_files, model_runs, run_folders, text
from halocline.sources import text as text_source


def test_scan_particles_rules(spark, tmp_path):
    f = tmp_path / "disk"
    f.write_text(
        "3 1\n# heading 1 2 3 4 5 6 7\n1 2 3 4 5 6 7\n\n  1.5e0\t2 3 4 5 6 7 8 # tail\n1 2 3 4 5 6\n1 2 x 4 5 6 7\n1d 2 3 4 5 6 7\n-.5 +2. 3 4 5 6 7#x\n"
    )
    out = sorted(tuple(r[1:8]) for r in text.scan_particles(spark, str(f)).collect())
    assert out == [(-0.5, 2, 3, 4, 5, 6, 7), (1, 2, 3, 4, 5, 6, 7), (1.5, 2, 3, 4, 5, 6, 7)]
    assert text.scan_particles(spark, str(f), "disk").columns[-1] == "component"


def test_load_components_precedence(spark, tmp_path):
    line = lambda m: f"{m} 1 2 3 4 5 6\n"
    for folder, files in {"m1": ("disk", "halo", "Xhalo", "disk2"), "m2": ("halo", "gasdisk")}.items():
        (tmp_path / folder).mkdir()
        for i, name in enumerate(files):
            (tmp_path / folder / name).write_text(line(i + 1))
    out = text.load_components(spark, f"{tmp_path}/*").collect()
    got = sorted((r.folder.rsplit("/", 1)[1], r.component, r.mass) for r in out)
    assert got == [("m1", "disk", 1.0), ("m1", "halo", 3.0), ("m2", "gasdisk", 2.0), ("m2", "halo", 1.0)]


def test_rotation_curve_rows(spark, tmp_path):
    f = tmp_path / "rc"
    f.write_text("1 200 5 extra\n2 210\n\n3 220 6\n")
    assert sorted(r.R_kpc for r in text.scan_rotation_curve(spark, str(f)).collect()) == [1.0, 3.0]
    f.write_text("a b c\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        text.scan_rotation_curve(spark, str(f)).collect()


def test_potential_grid_blocks(spark, tmp_path):
    f = tmp_path / "grid"
    f.write_text("\n\n0 0 1 2 3\n0 1 1 2 3\n \n\n1 0 4 5 6 7\nshort 1\n\n\n")
    out = sorted((r.block, r.r, r.z, r.psi) for r in text.scan_potential_grid(spark, str(f)).collect())
    assert out == [(0, 0.0, 0.0, 1.0), (0, 0.0, 1.0, 1.0), (1, 1.0, 0.0, 4.0)]


@pytest.fixture
def small_splits(spark):
    """Files come in splits of at most 96 bytes."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "96")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def _blocks_of(text):
    """Blocks as one reader from front to back numbers them."""
    blocks, current = [], []
    for line in text.split("\n"):
        if not line.strip():
            if current:
                blocks.append(current)
                current = []
        elif len(line.split()) >= 5:
            current.append(float(line.split()[0]))
    return [*blocks, current] if current else blocks


def test_grid_blocks_over_many_splits(spark, tmp_path, small_splits):
    rng = random.Random(4)
    want = []
    for f in range(4):
        lines, k = [], 0
        for _ in range(80):
            kind = rng.random()
            if kind < 0.6 or f == 3:
                lines.append(f"{k} 1 2 3 {'4' * rng.randrange(1, 60)}.5{rng.choice(['', ' ', ' 6 7'])}")
                k += 1
            else:
                lines += rng.choice([[""], [" \t"], ["", ""], ["short 1"], ["", "short 1", ""]])
        text = "\n".join(lines)
        (tmp_path / f"grid{f}").write_text(text)
        want += [(f"grid{f}", b, r) for b, rows in enumerate(_blocks_of(text)) for r in rows]
    out = text_source.scan_potential_grid(spark, str(tmp_path)).collect()
    assert sorted((r.file.rsplit("/", 1)[1], r.block, r.r) for r in out) == sorted(want)
    assert text_source.lines_in_place(spark, str(tmp_path)).select("file", text_source.SPLIT).distinct().count() > 40


def test_first_particles_in_file_order(spark, tmp_path, small_splits):
    rng = random.Random(5)
    for f, n in (("a", 90), ("b", 3), ("c", 0)):
        rows = [f"{i} 1 2 3 4 5 {rng.randrange(10**6)}" for i in range(n)]
        for _ in range(20):
            rows.insert(rng.randrange(len(rows) + 1), rng.choice(["", "1 2 3", "# 1 2 3 4 5 6 7", "1 2 x 4 5 6 7"]))
        (tmp_path / f).write_text("\n".join([f"{n} 1", *rows]))
    for first in (7, 80):
        out = text_source.scan_particles(spark, str(tmp_path), first=first).collect()
        got = {f: sorted(r.mass for r in out if r.file.endswith(f"/{f}")) for f in "abc"}
        assert got == {"a": list(range(first)), "b": list(range(min(first, 3))), "c": []}


def _coefficients(nr=2, rows=None):
    head = ["# label", "# 100 3 12 4 2 0.5 0.5 %d 2" % nr, "9 0.5 0.25", "10 2.5 0.3 20 3", "1 2 3 4 5", "1 2 3 4 5 6 7 8", "0.5 4 0.125", "# 1 0 1 0 0 1", "#  OUTPUT FROM X"]
    block = ["%g %g %g" % (i * 0.5, i + 1, i + 2) for i in range(nr + 1)]
    block[-1] = "%g 7" % (nr * 0.5)
    return "\n".join([*head, *block, "# potential", *block, "#", *(block if rows is None else block[:rows])])


def test_harmonic_files(spark, tmp_path):
    for m in ("a", "b"):
        (tmp_path / m).mkdir()
        (tmp_path / m / "coef").write_text(_coefficients())
    path = f"{tmp_path}/*/coef"
    rows = harmonic_files.read_harmonics(spark, path).filter("model_id = 'b'").orderBy("l", "ir").collect()
    assert [(r.l, r.ir, r.r, r.adens) for r in rows] == [(0, 0, 0.0, 1.0), (0, 1, 0.5, 2.0), (0, 2, 1.0, 7.0), (2, 0, 0.0, 2.0), (2, 1, 0.5, 3.0), (2, 2, 1.0, 0.0)]
    c = harmonic_files.read_harmonic_catalog(spark, path).first()
    assert (c.psid, c.disk.hole_radius, c.disk.outer_radius, c.grid.nr) == (5.0, 0.0, 20.0, 2)
    assert (c.disk.enabled, c.gas.enabled, c.halo.enabled, c.black_hole.enabled) == (True, True, False, True)
    assert harmonic_files.read_harmonic_catalog(spark, path, isolated_halo=True).first().halo.enabled
    (tmp_path / "b" / "coef").write_text(_coefficients(rows=1))
    with pytest.raises(Exception, match="wrong number of coefficient rows"):
        harmonic_files.read_harmonics(spark, path).collect()
    (tmp_path / "b" / "coef").write_text("1 2 3\n")
    with pytest.raises(Exception, match="no coefficient block marker"):
        harmonic_files.read_harmonics(spark, path).collect()


def test_folders_with_absent_empty_and_broken_files(spark, tmp_path):
    for m, text in {"good": _coefficients(), "short": _coefficients(rows=1), "head": "1 2\n# OUTPUT FROM X\n", "none": "1 2 3\n", "void": ""}.items():
        (tmp_path / m).mkdir()
        (tmp_path / m / "coef").write_text(text)
        (tmp_path / m / "disk").write_text("x")
    (tmp_path / "good" / "disk").unlink()
    (tmp_path / "short" / "disk").write_text("")
    cat, rows, faults = harmonic_files.ingest_harmonics(spark, f"{tmp_path}/*/coef")
    assert [r.model_id for r in cat.collect()] == ["good"] and {r.model_id for r in rows.collect()} == {"good"} and rows.count() == 6
    assert {(r.model_id, r.fault) for r in faults.collect()} >= {
        ("short", harmonic_files.BAD_ROWS), ("head", harmonic_files.BAD_HEADER), ("none", harmonic_files.NO_MARKER),
    }
    listing = run_folders.artifact_listing(spark, f"{tmp_path}/*/*")
    plan = listing._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string,length:bigint>" in plan and listing.count() == 7
    runs = spark.createDataFrame([(m,) for m in ("good", "short", "head", "none", "void", "gone")], "model_id string")
    got = {tuple(r) for r in run_folders.folder_problems(runs, listing, ("coef", "disk"), ("coef", faults)).collect()}
    assert got == {
        ("good", "disk", "missing"), ("short", "disk", "missing"), ("short", "coef", harmonic_files.BAD_ROWS), ("head", "coef", harmonic_files.BAD_HEADER),
        ("none", "coef", harmonic_files.NO_MARKER), ("void", "coef", "missing"), ("gone", "coef", "missing"), ("gone", "disk", "missing"),
    }


def test_run_tables(spark, tmp_path):
    d = tmp_path / "run7"
    d.mkdir()
    (d / "masses").write_text("1 2\n\n3 4\n5 6\n")
    (d / "corr").write_text("# 0.8 2.5 2\n0 1 1\nbad\n1 0.9 1.1\n")
    (d / "manifest").write_text('{"model": "m",\n "grid": {"dr": 0.1, "nr": 8, "lmax": 2}}\n')
    m = model_runs.read_component_masses(spark, f"{tmp_path}/*/masses").collect()
    assert [(r.model_id, r.component, r.mass, r.radius) for r in m] == [("run7", "disk", 1, 2), ("run7", "bulge", 3, 4), ("run7", "halo", 5, 6)]
    c = model_runs.read_disk_corrections(spark, f"{tmp_path}/*/corr").collect()
    assert [(r.sigma_r0, r.n_declared, r.R, r.f_d) for r in c] == [(0.8, 2, 0.0, 1.0), (0.8, 2, 1.0, 0.9)]
    assert model_runs.read_manifests(spark, f"{tmp_path}/*/manifest").first().grid.nr == 8
    (d / "masses").write_text("1 2\n3 4\n")
    with pytest.raises(Exception, match="three lines"):
        model_runs.read_component_masses(spark, f"{tmp_path}/*/masses").collect()


def test_sinks_round_trip(spark, tmp_path):
    rows = [("disk", 1e-3, 1.5, -2.0, 0.25, 1.0, 2.0, 3.0), ("halo", 2e-3, 1e4, -2e-4, 0.0, 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "component string, mass double, x double, y double, z double, vx double, vy double, vz double")
    text.write_particles(df, f"{tmp_path}/pq")
    plan = spark.read.parquet(f"{tmp_path}/pq").filter("component = 'halo'")
    assert plan.count() == 1 and "PartitionFilters: [isnotnull(component" in plan._jdf.queryExecution().toString()
    text.write_particle_text(df, f"{tmp_path}/txt")
    line = spark.read.text(f"{tmp_path}/txt").filter(F.col("value").contains("1.00000E-03")).first()[0]
    assert line == " 1.00000E-03  1.50000E+00 -2.00000E+00  2.50000E-01  1.00000E+00  2.00000E+00  3.00000E+00"
    assert text.scan_particles(spark, f"{tmp_path}/txt").count() == 2


def test_filters_skip_what_lies_elsewhere(spark, tmp_path):
    spread = lambda seed: (F.rand(seed) - 0.5) * 40
    df = spark.range(0, 400_000, 1, 4).select(
        F.when(F.col("id") % 3 == 0, "disk").otherwise("halo").alias("component"), F.lit(1.0).alias("mass"), spread(1).alias("x"), spread(2).alias("y"), spread(3).alias("z"), "id"
    )
    df.write.partitionBy("component").parquet(f"{tmp_path}/plain")
    text_source.write_particles(df, f"{tmp_path}/placed", rows_per_page=256)

    def scanned(name, keep):
        rows = keep(spark.read.parquet(f"{tmp_path}/{name}"))
        ids = sorted(r.id for r in rows.select("id", "x", "y", "z").collect())
        kept = keep(spark.read.parquet(f"{tmp_path}/{name}")).select("id", "x", "y", "z")
        plan = kept._jdf.queryExecution().executedPlan()
        kept._jdf.collectToPython()
        return ids, plan.collectLeaves().head().metrics().get("numOutputRows").get().value()

    for keep, most in (
        (lambda d: frames.annulus_filter(d, 2.6, 2.8), 0.15),
        (lambda d: frames.annulus_filter(d, 18.0, 18.5), 0.85),
        (lambda d: frames.sphere_filter(d, 3.0), 0.1),
    ):
        (plain, all_rows), (placed, some) = scanned("plain", keep), scanned("placed", keep)
        assert plain == placed and len(plain) > 100
        assert all_rows > 0.95 * 400_000 and some < most * 400_000
    # the bounds follow from the radius: rows at its very edge stay
    edge = spark.createDataFrame([(3.0 * (1 - 2**-53), 0.0, 0.0), (0.0, -3.0, 0.0), (3.0 * 0.7071067811865475, 3.0 * 0.7071067811865475, 0.0)], "x double, y double, z double")
    assert frames.annulus_filter(edge, 2.0, 3.0).count() == 2 and frames.sphere_filter(edge, 3.0).count() == 2
    assert frames.annulus_filter(edge, -1.0, 99.0).count() == 3 and frames.annulus_filter(edge, 1.0, -1.0).count() == 0


def test_shared_folder_comes_from_the_session(spark, tmp_path, monkeypatch):
    class Session:
        conf = {"spark.checkpoint.dir": "hdfs://shared/folder/"}

    assert storage.shared_dir(Session()) == "hdfs://shared/folder"
    assert storage.shared_dir(spark).startswith("/")

    class Cluster:
        conf = {}
        sparkContext = type("Context", (), {"master": "yarn"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(Cluster())
    monkeypatch.setattr(storage, "shared_dir", lambda s: f"{tmp_path}/shared")
    df = storage.materialise(spark.range(3).toDF("k"), "t")
    assert df.inputFiles()[0].startswith(f"file://{tmp_path}/shared/halocline/t-") and df.count() == 3


def test_keyed_text_is_one_ordered_file_for_each_key(spark, tmp_path):
    rows = [(m, k, [i, -i], f"{m}{k} {i}") for m in (3, 11, None) for k in ("a", "b") for i in range(700)]
    rows += [(5, "a", None, "x\ny"), (5, "a", [0], None), (6, "b", None, None)]
    lines = spark.createDataFrame(rows, "m int, kind string, order array<int>, line string").repartition(5)
    path = f"{tmp_path}/keyed"
    text.write_keyed_text(lines, path, ["kind", "m"], ["order"])
    files = {"/".join(r.path.split("/")[-3:-1]): r.content.decode() for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).collect()}
    name = lambda m: "__HIVE_DEFAULT_PARTITION__" if m is None else m
    want = {f"kind={k}/m={name(m)}": "".join(f"{m}{k} {i}\n" for i in range(700)) for m in (3, 11, None) for k in ("a", "b")}
    assert files == want | {"kind=a/m=5": "x\ny\n", "kind=b/m=6": "\n"}


def test_lines_of_replaced_components_are_not_parsed(spark, tmp_path):
    line = lambda m: f"{m} 1 2 3 4 5 6\n"
    for name, masses in {"halo": range(50), "Xhalo": (1, 2), "disk": (3,)}.items():
        (tmp_path / "m1" / name).mkdir(parents=True)
        (tmp_path / "m1" / name / "part-0").write_text("".join(map(line, masses)))
    out = text.load_components(spark, f"{tmp_path}/*")
    assert sorted((r.component, r.mass) for r in out.collect()) == [("disk", 3.0), ("halo", 1.0), ("halo", 2.0)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # the join on the file stands below the generator that parses lines
    assert plan.index("Generate inline") < plan.index("Join ")


def test_sessions_read_many_small_files_in_few_tasks(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"m{i}").mkdir()
        (tmp_path / f"m{i}" / "q").write_text("1.5\n")
    out = model_runs.read_scalars(spark, f"{tmp_path}/*/q", "q")
    assert out.count() == 300
    # one task for each core at most, where Spark would make one for every 32 files
    assert out.rdd.getNumPartitions() <= 8
