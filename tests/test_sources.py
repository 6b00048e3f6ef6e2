"""Scene sets as files, run folders and mean views against plain Python."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from probelake.sources import runs as RS
from probelake.sources import scenes as SS
from probelake.sources.files import write_files, write_lines_file


def write_set(root, entries, samples, **header):
    root.mkdir()
    (root / "manifest.json").write_text(json.dumps({"version": 2, "generator": "g", "split_summary": {"n_train": 2}, "scenes": entries, **header}, indent=2))
    for scene_id, record in samples.items():
        (root / scene_id).mkdir()
        (root / scene_id / "sample.json").write_text(json.dumps(record))
    return root.as_uri()


def entry(i, split, prefix=None):
    return {"scene_id": f"{prefix or split}_{i:06d}", "split": split, "shape": "box", "material": "glass"}


def sample(e, **more):
    return {"scene_id": e["scene_id"], "split": e["split"], "input": {"shape": "sphere", "material": None}, "behavior": {"probes": [{"probe": "drop", "outcome": {"toppled": True, "path_length": 1.5}}]}, **more}


def test_manifest_is_read_in_splits(spark, tmp_path):
    entries = [entry(i, "train" if i % 3 else "test") for i in range(3000)]
    root = write_set(tmp_path / "set", entries, {}, holdout_region={"kind": "region", "density": [0.5, 0.8]})
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        index = SS.read_manifest(spark, root)
        assert index.rdd.getNumPartitions() > 5
        got = sorted(tuple(r) for r in index.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == sorted((e["scene_id"], e["split"], "box", "glass") for e in entries)
    head = SS.read_manifest_header(spark, root).first()
    assert head["version"] == 2 and head["split_summary"] == {"n_train": 2} and head["holdout_region"]["density"] == [0.5, 0.8]


def test_a_brace_in_a_value_is_an_error_and_a_missing_file_too(spark, tmp_path):
    root = write_set(tmp_path / "set", [{**entry(1, "train"), "material": "a}b"}], {})
    with pytest.raises(Exception, match="brace"):
        SS.read_manifest(spark, root).collect()
    with pytest.raises(Exception, match="manifest.json"):
        SS.read_manifest(spark, (tmp_path / "none").as_uri()).collect()
    assert SS.read_manifest(spark, write_set(tmp_path / "empty", [], {})).count() == 0


def test_scenes_of_a_split(spark, tmp_path):
    listed = [entry(i, s) for s in ("train", "test") for i in range(4)]
    samples = {e["scene_id"]: sample(e) for e in listed[1:]}  # one listed scene has no file
    samples["train_000099"] = sample(entry(99, "train"))  # and one file is not listed
    root = write_set(tmp_path / "set", listed, samples)
    got = {r["scene_id"]: r for r in SS.read_scenes(spark, root, "train").collect()}
    assert set(got) == {f"train_{i:06d}" for i in (1, 2, 3)}
    r = got["train_000001"]
    assert r["input"]["shape"] == "sphere" and r["input"]["material"] == "glass" and r["behavior"]["probes"][0]["outcome"]["toppled"] == 1.0
    assert SS.read_scenes(spark, root).count() == 7 and SS.read_scenes(spark, root, "other").count() == 0
    with pytest.raises(Exception, match="no record for scene train_000000"):
        SS.read_scenes(spark, root, on_missing="error").collect()
    assert {r["scene_id"] for r in SS.scan_scene_glob(spark, root).collect()} == set(samples)


def test_split_of_scenes_with_other_names(spark, tmp_path):
    listed = [entry(1, "test", "val"), entry(2, "test"), entry(3, "train")]
    root = write_set(tmp_path / "set", listed, {e["scene_id"]: sample(e) for e in listed})
    assert {r["scene_id"] for r in SS.read_scenes(spark, root, "test").collect()} == {"val_000001", "test_000002"}


def test_written_files_are_what_was_given(spark, tmp_path):
    rows = spark.createDataFrame([(f"a{i % 3}/b/f{i}.txt", f"text {i}\n") for i in range(50)], "rel_path string, content string")
    assert write_files(rows, tmp_path.as_uri()) == 50
    assert (tmp_path / "a2" / "b" / "f5.txt").read_text() == "text 5\n" and len(list(tmp_path.rglob("*.txt"))) == 50
    write_lines_file(spark.range(100).orderBy("id").select(F.col("id").cast("string").alias("line")), f"{tmp_path.as_uri()}/x/one.json", "[", ",", "]")
    assert json.loads((tmp_path / "x" / "one.json").read_text()) == list(range(100))


def test_run_folders_are_pruned_by_name(spark, tmp_path):
    for name in ("aw0p5_s3", "aw0p5_s13", "aw2_s3", "g15_cont_s3", "other"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "model.safetensors").write_bytes(b"x")
        (tmp_path / name / "metrics.json").write_text(json.dumps({"config": {"seed": 7, "new_knob": [1]}, "history": [{"step": 0, "train": 1.0}, {"step": 10, "test": 2.0, "extra": "y"}]}))
    names = lambda df: {r["path"].split("/")[-2]: (r["seed"], r["weight"], r["tag"]) for r in df.collect()}
    root = tmp_path.as_uri()
    glob = f"{root}/*/model.safetensors"
    with pytest.raises(ValueError, match="prune"):
        RS.scan_runs(spark, f"{root}/a*/model.safetensors", seeds=[3])
    assert names(RS.scan_runs(spark, glob)) == {"aw0p5_s3": (3, 0.5, "aw0p5"), "aw0p5_s13": (13, 0.5, "aw0p5"), "aw2_s3": (3, 2.0, "aw2"), "g15_cont_s3": (3, None, "g15_cont"), "other": (-1, None, None)}
    assert set(names(RS.scan_runs(spark, glob, seeds=[3]))) == {"aw0p5_s3", "aw2_s3", "g15_cont_s3"}
    assert set(names(RS.scan_runs(spark, glob, weights=[0.5]))) == {"aw0p5_s3", "aw0p5_s13"}
    assert set(names(RS.scan_runs(spark, glob, seeds=[3, 4], weights=[0.5, 2]))) == {"aw0p5_s3", "aw2_s3"}
    rows = RS.read_run_metrics(spark, f"{root}/*/metrics.json").orderBy("path", "entry").collect()
    assert len(rows) == 10 and rows[0]["path_seed"] == 13 and rows[0]["seed"] == 7 and rows[1]["test"] == 2.0 and rows[1]["train"] is None


def test_mean_view_holds_one_image(spark):
    rng = np.random.default_rng(1)
    views = [("hot", rng.random((4, 3, 3))) for _ in range(400)] + [("b", rng.random((2, 2, 3))) for _ in range(3)] + [("c", rng.random((4, 3, 3)))]
    rows = [(k, v.shape[0], v.shape[1], v.ravel().tolist()) for k, v in views]
    df = spark.createDataFrame(rows, "scene_id string, height int, width int, pixels array<double>").repartition(20)
    mean = SS.mean_view(df)
    assert "Generate" not in mean._jdf.queryExecution().executedPlan().toString()  # no row per pixel
    got = {r["scene_id"]: r for r in mean.collect()}
    assert set(got) == {"hot", "b", "c"} and (got["hot"]["height"], got["hot"]["width"]) == (4, 3)
    for k in got:
        assert got[k]["pixels"] == pytest.approx(np.mean([v.ravel() for n, v in views if n == k], axis=0))
    with pytest.raises(Exception, match="different sizes"):
        SS.mean_view(df.withColumn("scene_id", F.lit("x"))).collect()
    assert SS.mean_view(df.limit(0)).count() == 0
