"""Queries on rows that the given tables do not hold."""

import datetime as dt

import numpy as np


def events(spark, folder, rows):
    start = dt.datetime(2024, 1, 1)
    data = [(i, start + dt.timedelta(hours=i), user, kind, value, "{}") for i, (user, kind, value) in enumerate(rows)]
    spark.createDataFrame(data, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_unknown_event_types_reply_to_toppled_only(spark, tmp_path):
    from probelake.plans.reply_queries import coerce_field

    sf = events(spark, tmp_path, [(1, "error", 1.0), (1, "other", 1.0), (1, None, 1.0), (1, "purchase", None), (1, "purchase", 2.5)])
    got = [(r["toppled"], r["n_bounces"]) for r in coerce_field(spark, sf).orderBy("event_id").collect()]
    inf = float("inf")
    assert got == [(inf, inf), (inf, None), (inf, None), (None, None), (2.5, 2.5)]


def test_missing_probes_have_no_entries(spark, tmp_path):
    from probelake.plans.scene_queries import behavior_target

    sf = events(spark, tmp_path, [(1, k, float(v)) for k, v in [("click", 1), ("click", 2), ("purchase", 1), ("purchase", 3), ("view", 1)]])
    got = {r["pos"] for r in behavior_target(spark, sf).collect()}
    assert got == {*range(7), *range(14, 21)}          # one frame of the tilt is no outcome


def test_levels_keep_their_digits(spark, tmp_path):
    from probelake.plans.scene_queries import _png
    from probelake.sources import scenes as SS

    levels = np.arange(192) % 256
    (tmp_path / "a.png").write_bytes(_png(levels))
    pixels = SS.load_pixels(spark, str(tmp_path / "a.png")).first()["pixels"]
    assert pixels == [v / 255.0 for v in levels.tolist()]
