"""Run folders listed and read by tasks: the driver holds no list of their files, and paths mean what they mean to Spark's source."""

import gzip
import re

import pytest
from pyspark.sql import functions as F

from halocline.sources import harmonic_files, listing, model_runs, run_folders


def _folders(tmp_path, n, name, text):
    for i in range(n):
        (tmp_path / f"m{i}").mkdir()
        (tmp_path / f"m{i}" / name).write_text(text(i))
    return f"{tmp_path}/*/{name}"


def _listed_on_driver(df, name):
    """Files of that name among those that the plan of ``df`` lists."""
    return [f for f in df.inputFiles() if f.endswith(f"/{name}")]


def test_tables_of_runs_are_listed_by_tasks(spark, tmp_path):
    path = _folders(tmp_path, 600, "q", lambda i: f"{i}.5\n")
    out = model_runs.read_scalars(spark, path, "q")
    assert sorted((r.model_id, r.q) for r in out.collect()) == sorted((f"m{i}", i + 0.5) for i in range(600))
    assert not _listed_on_driver(out, "q")
    for reader in (model_runs.read_frequency_tables, model_runs.read_disk_corrections, model_runs.read_component_masses, model_runs.read_gas_norms, model_runs.read_manifests):
        assert not _listed_on_driver(reader(spark, path), "q")


def test_run_folders_are_checked_by_tasks(spark, tmp_path):
    path = _folders(tmp_path, 600, "coef", lambda i: "1 2\n")
    listed = run_folders.artifact_listing(spark, path)
    assert listed.count() == 600 and not _listed_on_driver(listed, "coef")
    assert not _listed_on_driver(harmonic_files.read_harmonics(spark, path), "coef")
    _, _, broken = harmonic_files.ingest_harmonics(spark, path)
    runs = spark.range(650).select(F.concat(F.lit("m"), "id").alias("model_id"))
    out = run_folders.folder_problems(runs, listed, ("coef",), ("coef", broken))
    assert {(r.problem, r["count"]) for r in out.groupBy("problem").count().collect()} == {("missing", 50), (harmonic_files.NO_MARKER, 600)}
    # neither the names nor the runs are gathered on the driver
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    top = tmp_path_factory.mktemp("odd")

    def put(name, value):
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_bytes(value)

    for run in ("r1", "r 2", "r%203", "ré4", "_r5", ".r6", "r+7&", "r=8"):
        for name in ("masses", "_tmp", ".hid", "empty", "a._COPYING_", "k=1"):
            put(f"runs/{run}/{name}", b"" if name == "empty" else f"{run} {name}\n".encode())
    for i in range(30):
        put(f"keyed/kind=a/model_id={i}/part-0", b"a%d" % i)
        put(f"keyed/kind=b/model_id={i}/part-0", b"b%d" % i)
    put("keyed/kind=b/_SUCCESS", b"x")
    for name in ("mixed/f", "mixed/k=1/g", "mixed/k=1/plain/h", "plain/f", "plain/sub/g", "unlike/k=1/f", "unlike/j=1/f"):
        put(name, name.encode())
    put("packed/a.gz", gzip.compress(b"one") + gzip.compress(b"two"))
    put("packed/raw", b"\xff\xfe\x00x\r\n")
    put("void/e", b"")
    return top


PATHS = [
    "runs/*/masses", "runs/*/*", "runs/*", "runs/r1", "runs/r1/masses", "runs/r 2/masses", "runs/r\\ 2/m*", "runs/r%203", "runs/_r5", "runs/.r6/masses", "runs/.r6/.hid",
    "keyed", "keyed/kind=a", "keyed/kind={a,b}/model_id=*", "keyed/kind=*/model_id=[1-3]*/*", "keyed/kind=?/model_id=[^1]/*", "{runs/r1,keyed/kind=a/model_id=1}/*",
    "mixed", "m*/*", "plain", "plain/*", "packed", "void", ["plain/*", "void"], ["runs/r1", "runs/r 2/masses"], ["plain/f", "plain"], ["keyed", "keyed"],
]


@pytest.mark.parametrize("folders", [1, 256])
def test_paths_mean_what_they_mean_to_spark(spark, odd, monkeypatch, folders):
    monkeypatch.setattr(listing, "LISTINGS", folders)
    for path in PATHS if folders > 1 else ["keyed", "runs/*/*", "m*/*"]:
        at = f"{odd}/{path}" if isinstance(path, str) else [f"{odd}/{p}" for p in path]
        found = listing.list_files(spark, at)
        if folders > 1:
            with monkeypatch.context() as once:
                once.setattr(listing, "list_files", lambda *_: found)
                got = listing.whole_files(spark, at).select("file", F.col("value").cast("binary"))
            want = spark.read.text(at, wholetext=True).select("_metadata.file_path", F.col("value").cast("binary"))
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())), path
        want = spark.read.format("binaryFile").load(at).select("path", "length").collect()
        assert sorted(map(tuple, found.files.collect() if found else [])) == sorted(map(tuple, want)), path
        assert found is None or found.bytes >= sum(r.length for r in want)
    assert listing.list_files(spark, f"{odd}/keyed").count == 60


def test_folders_that_are_absent_or_unlike_are_errors_as_before(spark, odd):
    for path, error in ((f"{odd}/gone", "PATH_NOT_FOUND"), (f"{odd}/gone/*", "PATH_NOT_FOUND"), ([f"{odd}/plain", f"{odd}/gone"], "PATH_NOT_FOUND"), (f"{odd}/unlike", "CONFLICTING")):
        with pytest.raises(Exception, match=error):
            listing.whole_files(spark, path).collect()


def test_files_that_arrow_cannot_open_are_left_to_spark(spark, odd):
    spark.conf.set("fs.viewfs.mounttable.store.link./odd", f"file://{odd}")
    assert listing.list_files(spark, "viewfs://store/odd/plain") is None
    assert [r.value for r in listing.whole_files(spark, "viewfs://store/odd/plain").collect()] == ["plain/f"]
    spark.conf.unset("fs.viewfs.mounttable.store.link./odd")


def test_a_packed_file_is_told_by_its_ending():
    assert re.search(listing.PACKED, "file:/a/b.snappy") and not re.search(listing.PACKED, "file:/a.lz4/b.gz")
