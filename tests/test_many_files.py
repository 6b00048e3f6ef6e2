"""Sets of many small files: read by name inside tasks, with the same values as a scan."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from probelake.plans import scene_queries as Q
from probelake.sources import scenes as SS


def png(a, kinds):
    """A PNG file of the levels (height, width, channels), line y filtered by kinds[y]."""
    h, w, n = a.shape
    lines, above = [], np.zeros(w * n, int)
    for y in range(h):
        x = a[y].ravel().astype(int)
        left, corner = np.r_[np.zeros(n, int), x][:w * n], np.r_[np.zeros(n, int), above][:w * n]
        p = left + above - corner
        paeth = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        lines.append(bytes([kinds[y]]) + ((x - [0, left, above, (left + above) // 2, paeth][kinds[y]]) % 256).astype(np.uint8).tobytes())
        above = x
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    data, color = zlib.compress(b"".join(lines)), {1: 0, 2: 4, 3: 2, 4: 6}[n]
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, color, 0, 0, 0)) + chunk(b"IDAT", data[:9]) + chunk(b"IDAT", data[9:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_every_filter_and_channel_count(n):
    a = np.random.default_rng(n).integers(0, 256, (12, 7, n), dtype=np.uint8)
    for kinds in ([0] * 12, [0, 1, 2, 3, 4, 4, 3, 2, 1, 0, 4, 3]):
        assert (SS.png_levels(png(a, kinds)) == a).all()
    with pytest.raises(ValueError, match="not a PNG"):
        SS.png_levels(b"GIF89a")


def test_listed_views_equal_scanned_ones(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(5)
    for i in range(12):
        (tmp_path / f"s{i}" / "renders").mkdir(parents=True)
        for j in range(3):
            a = rng.integers(0, 256, (4 + i, 5, (1, 3)[i % 2]), dtype=np.uint8)
            (tmp_path / f"s{i}" / "renders" / f"v{j}.png").write_bytes(png(a, [(y + j) % 5 for y in range(4 + i)]))
    frames = F.array(*[F.struct(F.lit(f"v{j}.png").alias("file")) for j in range(3)])
    scenes = spark.range(12).select(F.format_string("s%d", "id").alias("scene_id"), F.struct(frames.alias("frames")).alias("appearance"))
    monkeypatch.setattr(SS, "READ_BYTES", 600)  # batches are cut inside
    got = {(r["scene_id"], r["index"]): (r["height"], r["width"], r["pixels"]) for r in SS.load_views(SS.explode_views(scenes, str(tmp_path)), str(tmp_path)).collect()}
    want = {(p[-3], int(p[-1][1])): (r["height"], r["width"], r["pixels"]) for r in SS.load_pixels(spark, f"{tmp_path}/*/renders/*.png").collect() for p in [r["path"].split("/")]}
    assert got == want and len(got) == 36
    with pytest.raises(Exception, match="no view"):
        SS.load_views(SS.explode_views(scenes.withColumn("scene_id", F.lit("none")), str(tmp_path)), str(tmp_path)).collect()


@pytest.mark.parametrize("query", [Q.load_views, Q.mean_view, Q.pixel_features])
def test_tasks_do_not_grow_with_files(spark, tmp_path, query):
    v = np.random.default_rng(2).normal(0, 0.4, (700, 64)).round(2).tolist()
    spark.createDataFrame(list(enumerate(v)), "vec_id bigint, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    df = query(spark, str(tmp_path))
    assert "Scan image" not in df._jdf.queryExecution().executedPlan().toString()  # one task for every 32 files, one listing task for every folder
    assert df.select("scene_id").distinct().count() == 700


def test_pixel_features_by_hand(spark):
    rng = np.random.default_rng(3)
    images = {"a": rng.random((5, 7, 3)), "b": np.full((3, 3, 3), 0.1)}
    rows = [(k, *a.shape[:2], a.ravel().tolist()) for k, a in images.items()] + [("c", 1, 1, None)]
    out = SS.pixel_features(spark.createDataFrame(rows, "scene_id string, height int, width int, pixels array<double>"), grid=2)
    assert "lambda" not in out._jdf.queryExecution().executedPlan().toString()  # no interpreted function per pixel
    got = {r["scene_id"]: r["features"] for r in out.collect()}
    a = images["a"]
    assert got["a"] == pytest.approx([*a.mean((0, 1)), *a.std((0, 1)), *a[0, 0], *a[0, 3], *a[2, 0], *a[2, 3]])
    assert got["b"] == [0.1] * 3 + [0.0] * 3 + [0.1] * 12 and got["c"] is None


def test_scenes_are_opened_by_name(spark, tmp_path, monkeypatch):
    entries = [{"scene_id": f"{s}_{i:06d}", "split": s, "shape": "box", "material": "glass"} for s in ("train", "test") for i in range(60)]
    for e in entries[1:]:
        (tmp_path / e["scene_id"]).mkdir()
        (tmp_path / e["scene_id"] / "sample.json").write_text(json.dumps({"scene_id": e["scene_id"], "input": {"shape": "sphere"}, "behavior": {"probes": [
            {"probe": "drop", "outcome": {"toppled": True, "path_length": 1.5}}]}}, indent=1))
    (tmp_path / "train_000007" / "sample.json").write_text("{broken")
    (tmp_path / "manifest.json").write_text(json.dumps({"scenes": entries}, indent=1))
    monkeypatch.setattr(SS, "READ_BYTES", 300)  # batches are cut inside
    train = SS.read_scenes(spark, str(tmp_path), "train")
    assert "Scan json" not in train._jdf.queryExecution().executedPlan().toString()  # one task for every 32 files, one listing task for every folder
    got = {r["scene_id"]: r for r in train.collect()}
    assert set(got) == {f"train_{i:06d}" for i in range(60)} - {"train_000000", "train_000007"}
    r = got["train_000009"]
    assert (r["split"], r["input"]["shape"], r["input"]["material"], r["behavior"]["probes"][0]["outcome"]["toppled"]) == ("train", "sphere", "glass", 1.0)
    assert SS.read_scenes(spark, str(tmp_path)).count() == 118
    index, samples = SS.read_manifest(spark, str(tmp_path)), SS.read_samples(spark, f"{tmp_path}/*").drop("path")
    joined = {r["scene_id"]: r.asDict(True) for r in SS.join_manifest(index, samples, "train").collect()}
    assert joined == {k: r.asDict(True) for k, r in got.items()}
    with pytest.raises(Exception, match="no record for scene train_00000[07]"):
        SS.read_scenes(spark, str(tmp_path), "train", "error").collect()


def test_a_scan_lists_names_once(spark, tmp_path):
    for name in ("train_000001", "train_000002", "test_000001", "other_000001"):
        (tmp_path / name).mkdir()
        if name != "train_000002":
            (tmp_path / name / "sample.json").write_text(json.dumps({"scene_id": name, "behavior": {"probes": [{"probe": "drop", "outcome": {"toppled": False}}]}}))
    want = SS.read_samples(spark, f"{tmp_path}/t*")
    for root in (str(tmp_path), tmp_path.as_uri()):
        scan = SS.scan_scene_glob(spark, root)
        assert "Scan json" not in scan._jdf.queryExecution().executedPlan().toString()
        assert sorted(str(r.asDict(True)) for r in scan.select(want.columns).collect()) == sorted(str(r.asDict(True)) for r in want.collect())
    assert scan.count() == 2 and SS.scan_scene_glob(spark, str(tmp_path), ["none_*"]).count() == 0
