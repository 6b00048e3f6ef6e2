"""Listings, object directories, scene files, reply parsing and scoring."""

import gzip
import json
import math
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from probelake import constants as K
from probelake import schemas as S
from probelake.functions import scalars as C
from probelake.operators import catalog as CAT
from probelake.operators import records as R
from probelake.operators import replies as RE
from probelake.operators import scoring as SC
from probelake.operators import targets as TG
from probelake.sources import catalogs as CS
from probelake.sources import runs as RS
from probelake.sources import scenes as SS


def listing(mid, weight, kind="CHAIR"):
    return {"3dmodel_id": mid, "item_weight": weight, "product_type": [{"value": kind}] if kind else []}


def test_listings(spark, tmp_path):
    nested = lambda u, v: [{"normalized_value": {"unit": u, "value": v}}]
    shards = {
        "listings_0.json.gz": [listing("A", nested("pounds", 2)), listing("B", [{"unit": "kilograms", "value": 3.5}]),
                               listing("C", nested("furlongs", 3) + nested("pounds", 1)), listing("D", nested("pounds", "heavy"))],
        "listings_1.json.gz": [listing("A", nested("grams", 1)), listing("E", nested("ounces", 16), None), listing(None, nested("grams", 5)),
                               listing("F", nested("pounds", 0)), listing("G", None)],
    }
    for name, rows in shards.items():
        with gzip.open(tmp_path / name, "wt") as f:
            f.write("\n".join(json.dumps(r) for r in rows))
    got = {r["model_id"]: (r["kg"], r["category"]) for r in CS.read_listings(spark, str(tmp_path)).collect()}
    assert set(got) == {"A", "B", "C", "E"}
    assert got["A"][0] == pytest.approx(0.90718474) and got["B"][0] == 3.5 and got["C"][0] == pytest.approx(0.45359237)
    assert got["E"] == (pytest.approx(0.453592368), "UNKNOWN")


def test_round_robin(spark):
    rows = [(f"CH{i}", "CHAIR") for i in range(5)] + [(f"TB{i}", "TABLE") for i in range(5)] + [("RG0", "RUG")]
    kept, rejected = CAT.drop_categories(spark.createDataFrame(rows, "model_id string, category string"))
    assert [r["model_id"] for r in CAT.round_robin_select(kept, 6, 3).collect()] == ["CH0", "TB0", "CH1", "TB1", "CH2", "TB2"]
    assert rejected.count() == 1


def test_density_gates(spark):
    df = spark.createDataFrame([(10.0, 0.05), (1000.0, 0.001), (0.001, 1.0), (5.0, None)], "m double, v double")
    g = [r["g"] for r in df.select(CAT.density_gate("m", "v").alias("g")).collect()]
    assert [x["passes"] for x in g] == [True, False, False, True] and g[0]["density"] == 200 and g[3]["density"] is None


def test_object_directories(spark, tmp_path):
    def put(path, text):
        f = tmp_path / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)

    put("ObjectA/meshes/model.obj", "o")
    put("ObjectA/materials/textures/texture.png", "x")
    put("ObjectA/model.sdf", "<inertial><mass>0.25</mass></inertial>")
    put("ObjectA/metadata.pbtxt", 'categories: "Mug"')
    put("ObjectB/thing.glb", "o")
    put("ObjectB/meta.json", '{"mass_grams": 500, "category": " Shoe "}')
    put("ObjectC/readme.txt", "no mesh")
    put("Plain/mesh.stl", "o")
    files = CS.scan_object_files(spark, str(tmp_path))
    rows = {r["object_id"]: r for r in CAT.discover_objects(files).collect()}
    assert set(rows) == {"ObjectA", "ObjectB", "Plain"}
    a, b, p = rows["ObjectA"], rows["ObjectB"], rows["Plain"]
    assert (a["mass_kg"], a["mass_source"], a["category"], a["texture_path"]) == (0.25, "sdf", "mug", "materials/textures/texture.png")
    assert (b["mass_kg"], b["mass_source"], b["category"]) == (0.5, "json", "shoe")
    assert (p["mass_kg"], p["mass_source"], p["category"], p["texture_path"]) == (None, "unknown", "unknown", None)
    assert [r["object_id"] for r in CAT.discover_objects(files, 2).collect()] == ["ObjectA", "ObjectB"]


def _png(path, rows, channels):
    h, w = len(rows), len(rows[0])
    raw = b"".join(b"\0" + b"".join(bytes(p) for p in r) for r in rows)
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    kind = {1: 0, 3: 2, 4: 6}[channels]
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw))
                     + chunk(b"IEND", b""))


def test_images(spark, tmp_path):
    _png(tmp_path / "v" / "rgb.png", [[(255, 0, 51), (0, 102, 0)]], 3)
    _png(tmp_path / "v" / "gray.png", [[(51,), (102,)]], 1)
    got = {r["path"].rsplit("/", 1)[1]: [round(v, 3) for v in r["pixels"]] for r in SS.load_pixels(spark, str(tmp_path / "v")).collect()}
    assert got["rgb.png"] == [1.0, 0.0, 0.2, 0.0, 0.4, 0.0]
    assert got["gray.png"] == [0.2, 0.2, 0.2, 0.4, 0.4, 0.4]
    px = SS.load_pixels(spark, str(tmp_path / "v")).withColumn("scene_id", F.lit("s"))
    mean = SS.mean_view(px).first()
    assert [round(v, 3) for v in mean["pixels"]] == [0.6, 0.1, 0.2, 0.2, 0.4, 0.2]
    feats = SS.pixel_features(SS.mean_view(px), grid=2).first()["features"]
    assert len(feats) == 6 + 2 * 2 * 3 and feats[0] == pytest.approx(0.4, abs=1e-6) and feats[3] == pytest.approx(0.2, abs=1e-6)


def test_scene_files(spark, tmp_path):
    def record(sid, split, shape, toppled):
        out = {"toppled": toppled, "settle_time": 0.5, "slid_distance": 0.1, "n_bounces": 0, "max_height": 0.3, "path_length": 0.4, "final_tilt_deg": 5}
        return {"scene_id": sid, "split": split, "input": {"shape": shape, "material": "m"},
                "behavior": {"probes": [{"probe": p, "outcome": out} for p in ("push", "drop")]}}

    scenes = [("train_000000", "train", "box", True), ("train_000001", "train", "sphere", 0.25), ("test_000000", "test", "cylinder", False)]
    for sid, split, shape, top in scenes:
        (tmp_path / sid).mkdir()
        (tmp_path / sid / "sample.json").write_text(json.dumps(record(sid, split, shape, top), indent=1))
    index = [{"scene_id": s, "split": sp, "shape": sh, "material": "m"} for s, sp, sh, _ in scenes]
    index.append({"scene_id": "train_000009", "split": "train", "shape": "box", "material": "m"})
    (tmp_path / "manifest.json").write_text(json.dumps({"version": 2, "scenes": index}, indent=1))
    train = SS.read_scenes(spark, str(tmp_path), "train")
    v = {r["scene_id"]: r["v"] for r in train.select("scene_id", TG.behavior_target("behavior.probes").alias("v")).collect()}
    assert set(v) == {"train_000000", "train_000001"}
    assert v["train_000000"][0] == 1.0 and v["train_000001"][14] == 0.25 and v["train_000000"][7:14] == [0.0] * 7
    assert SS.scan_scene_glob(spark, str(tmp_path)).count() == 3
    with pytest.raises(Exception, match="no record for scene"):
        SS.read_scenes(spark, str(tmp_path), "train", on_missing="error").collect()
    with pytest.raises(Exception):
        SS.read_manifest(spark, str(tmp_path / "nowhere")).collect()


def test_run_files(spark, tmp_path):
    for p in ("aw0p3_s2", "g15_cont_s11", "other"):
        (tmp_path / p).mkdir()
        (tmp_path / p / "model.safetensors").write_text("x")
    runs = {r["tag"]: (r["seed"], r["weight"]) for r in RS.scan_runs(spark, str(tmp_path / "*" / "model.safetensors")).collect()}
    assert runs == {"aw0p3": (2, 0.3), "g15_cont": (11, None), None: (-1, None)}
    assert RS.weighted_runs(RS.scan_runs(spark, str(tmp_path / "*" / "model.safetensors"))).count() == 1
    (tmp_path / "metrics.json").write_text(json.dumps({"config": {"latent_dim": 32, "unknown": 1}, "history": [{"step": 1, "train": 0.5}]}, indent=1))
    m = RS.read_run_metrics(spark, str(tmp_path / "metrics.json")).first()
    assert m["latent_dim"] == 32 and m["step"] == 1 and m["train"] == 0.5


REPLIES = {
    "fenced": ('Hm.\n```json\n{"toppled": false, "settle_time": 1.5, "slid_distance": 0.2, "n_bounces": 1, "max_height": 0.6, '
               '"path_length": 0.9, "final_tilt_deg": 3}\n```', {"toppled": 0.0, "settle_time": 1.5, "final_tilt_deg": 3.0}),
    "last": ('{"settle_time": 1} and {"settle_time": 2}', {"settle_time": 2.0, "toppled": None}),
    "texts": ('```{"toppled":"true","n_bounces":"2","unrelated":1}```', {"toppled": 1.0, "n_bounces": 2.0}),
    "none": ("no json", None),
    "unrelated": ('{"a": 1}', None),
    "trailing": ('```json\n{"settle_time": 3} oops }\n``` ```json\n{"settle_time": 4} nope }\n```', None),
    "skip_bad": ('{"settle_time": 5} {broken}', {"settle_time": 5.0}),
    "nested": ('x } {"max_height": 1, "o": {"settle_time": 9}} {', {"max_height": 1.0, "settle_time": None}),
    "booleans": ('{"n_bounces": true, "max_height": "true", "settle_time": null}', {"n_bounces": 1.0, "max_height": None}),
}


def test_reply_parsing(spark):
    df = spark.createDataFrame([(k, v[0]) for k, v in REPLIES.items()], "k string, text string")
    got = {r["k"]: r["prediction"] for r in RE.parse_replies(df).collect()}
    for k, (_, want) in REPLIES.items():
        if want is None:
            assert got[k] is None, k
        else:
            assert all(got[k][f] == v for f, v in want.items()), (k, got[k])


def test_scoring(spark):
    from probelake import constants as K

    zero = dict.fromkeys(K.OUTCOME_FIELDS, 0.0)
    off = {f: K.OUTCOME_NORMALIZERS[f] for f in K.OUTCOME_FIELDS}
    kind = "scene_id string, probe string, prediction struct<" + ",".join(f"{f}:double" for f in K.OUTCOME_FIELDS) + ">, truth struct<" + ",".join(
        f"{f}:double" for f in K.OUTCOME_FIELDS) + ">"
    train = spark.createDataFrame([("push", *[0.5] * 7)], "probe string, " + ", ".join(f"{f} double" for f in K.OUTCOME_FIELDS))
    means = SC.train_mean_outcomes(train)
    assert means.count() == 21 and means.where("probe = 'drop'").agg(F.max("train_mean")).first()[0] == 0.0

    def overall(rows):
        out = SC.score_predictions(spark.createDataFrame(rows, kind), means)
        return out.where("probe is null").first()

    perfect = overall([("s", "push", zero, zero)])
    assert perfect["mse"] == 0 and perfect["push_toppled_brier"] == 0 and perfect["gain_over_mean"] is None
    assert overall([("s", "push", off, zero)])["mse"] == pytest.approx(1.0)
    partial = {**dict.fromkeys(K.OUTCOME_FIELDS), "toppled": 0.0}
    mixed = overall([("s", "push", None, zero), ("t", "push", partial, zero)])
    assert mixed["n_parse_failures"] == 1 and mixed["n_imputed_fields"] == 13 and 0 < mixed["mse"] <= mixed["baseline_mse"]


def test_missing_products_and_train_means_are_errors(spark):
    ids, two = spark.createDataFrame([("a",), ("b",)], "scene_id string"), spark.createDataFrame([("a", 1), ("b", 2)], "scene_id string, v int")
    one = two.where("scene_id = 'a'")
    both = R.assemble(ids, two.withColumnRenamed("v", "f"), two.withColumnRenamed("v", "g"))
    assert sorted(map(tuple, both.select("scene_id", "f", "g").collect())) == [("a", 1, 1), ("b", 2, 2)]
    for frames, behavior, name in ((one, two, "frames"), (two, one, "behavior")):
        with pytest.raises(Exception, match=f"no {name} for scene b"):
            R.assemble(ids, frames.withColumnRenamed("v", "f"), behavior.withColumnRenamed("v", "g")).collect()
    assert R.assemble(ids, one, one.withColumnRenamed("v", "g"), on_missing="skip").count() == 1
    fields = ",".join(f"{f}:double" for f in K.OUTCOME_FIELDS)
    rows = spark.createDataFrame([("s", "push", None, dict.fromkeys(K.OUTCOME_FIELDS, 0.0)), ("s", "roll", None, dict.fromkeys(K.OUTCOME_FIELDS, 0.0))],
                                 f"scene_id string, probe string, prediction struct<{fields}>, truth struct<{fields}>")
    means = spark.createDataFrame([("push", f, 0.5) for f in K.OUTCOME_FIELDS], "probe string, field string, train_mean double")
    assert SC.score_predictions(rows.where("probe = 'push'"), means).where("probe is null").first()["n_parse_failures"] == 1
    with pytest.raises(Exception, match="no train mean for roll"):
        SC.score_predictions(rows, means).collect()


def test_records(spark):
    df = spark.createDataFrame([("train_0", "train", "box", "steel", 64)], "scene_id string, split string, shape string, mat string, resolution int")
    df = df.withColumn("frames", F.array(R.build_frame(F.lit(0), F.lit("v.png"), F.array(F.lit(1)), F.array(F.lit(2)))))
    named = R.build_scene_record(df, "sim", material_name="mat").first()
    assert named["physics"]["normalized"]["density"] == pytest.approx(7850 / 8000) and named["input"]["material"] == "steel"
    measured = R.build_scene_record(df.withColumn("p", R.physics_labels_measured(F.lit(2.0))), "scan", physics="p").first()
    assert measured["physics"]["provenance"]["density"] == "unknown" and measured["input"]["material"] == "object"
    with pytest.raises(Exception, match="unknown material"):
        R.lookup_material(df.withColumn("mat", F.lit("gold")), "mat").collect()
    with pytest.raises(ValueError):
        R.build_scene_record(df, "sim")
    assert R.validate_material(R.materials_dim(spark)).where(F.size("violations") > 0).count() == 0
    anchors = R.materials_dim(spark).select("name", R.nearest_anchor("density", "friction", "restitution").alias("a"))
    assert anchors.where("name <> a").count() == 0
    spec = S.SPEC.fieldNames()
    assert set(spec) >= {"kind", "height", "topple_jitter"}


def test_prompt_texts(spark):
    one = spark.range(1)
    for expr in (RE.shape_text(F.lit("torus")), RE.action_text(F.lit("spin"), R.probe_spec()),
                 RE.build_messages(F.lit("vision"), F.lit("s"), F.lit("a"))[1]["text"].isNotNull() & RE.build_messages(
                     F.lit("vision"), F.lit("s"), F.lit("a"))[1]["images"].isNotNull()):
        with pytest.raises(Exception):
            one.select(expr).collect()
    texts = one.select(C.fixed(F.lit(0.125), 2).alias("a"), C.fixed(F.lit(2.675), 2).alias("b"), C.fixed(F.lit(80.0), 0).alias("c")).first()
    assert tuple(texts) == ("0.12", "2.67", "80")


def test_reply_styles_of_other_writers(spark):
    from probelake.functions.scalars import coerce_outcome, weight_to_kg
    from probelake.operators.replies import parse_replies

    texts = ['{"toppled": "yes\\n", "settle_time": "\\t3"}', '{"toppled": 0, "toppled": 1}', '{"toppled": 1, "settle_time": NaN}', '{"settle_time": Infinity}']
    out = [r["prediction"] for r in parse_replies(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).orderBy("i").collect()]
    assert (out[0]["toppled"], out[0]["settle_time"]) == (1.0, 3.0)
    assert out[1]["toppled"] == 1.0
    assert out[2]["toppled"] == 1.0 and math.isnan(out[2]["settle_time"])
    assert out[3]["settle_time"] == math.inf
    df = spark.createDataFrame([("\t3\n", [("grams", "1.5f", None), ("grams", " 2000\n", None)])],
                               "t string, w array<struct<unit:string,value:string,normalized_value:struct<unit:string,value:string>>>")
    r = df.select(coerce_outcome("settle_time", "t").alias("s"), weight_to_kg("w").alias("kg")).first()
    assert r["s"] == 3.0 and r["kg"] == pytest.approx(2.0)
