"""The streaming summary equals the batch one on the same frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from probelake.operators.trajectories import summarize
from probelake.streaming.trajectories import summarize_stream


def test_stream_matches_batch(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(5):
        n = int(rng.integers(3, 12))
        rows += [(f"t{k}", i, float(i), [float(v) for v in rng.choice([0.0, 0.3, 1.0], 3)], [float(v) for v in rng.normal(size=3)]) for i in range(n)]
    rows.append(("late", 0, 100_000.0, [0.0, 0.0, 0.0], [0.0, 0.0, 1.0]))       # moves the watermark past the others
    df = spark.createDataFrame(rows, "k string, frame_idx int, t double, pos array<double>, up array<double>")
    df = df.withColumn("ts", F.timestamp_seconds(F.col("t") + 1_000_000))  # the watermark starts at the epoch
    src = str(tmp_path / "src")
    for lo, hi in ((0, 4), (4, 1e9)):                                            # two triggers
        df.where((F.col("t") >= lo) & (F.col("t") < hi)).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = (summarize_stream(stream, "k", "ts", "1 second", 1000).writeStream.format("memory").queryName("summaries").outputMode("append")
         .option("checkpointLocation", str(tmp_path / "ck")).start())
    q.processAllAvailable()
    q.stop()
    got = {r["k"]: r for r in spark.sql("select * from summaries").collect()}
    want = {r["k"]: r for r in summarize(df.where("k <> 'late'"), ["k"]).collect()}
    assert set(got) == set(want)
    for k, w in want.items():
        for c in w.asDict():
            if c != "k":
                assert got[k][c] == pytest.approx(w[c], abs=1e-9), (k, c)


def test_frames_out_of_order_within_the_watermark_count(spark, tmp_path):
    triggers = [[0.0, 3.0, 4.0, 9.0], [2.0, 9.0, 1.0], [8.0, 30.0, 5.0], [25.0]]    # a frame of a time seen before, and earlier ones
    heights, rows = iter([0.5, 0.1, 2.0, 0.3, 0.9, 0.3, 7.0, 0.2, 0.4, 0.1, 0.6]), []
    for n, times in enumerate(triggers):
        rows += [("a", n, t, [0.1 * t, 0.0, next(heights)], [0.0, 0.0, 1.0]) for t in times]
    rows.append(("late", 4, 100_000.0, [0.0, 0.0, 0.0], [0.0, 0.0, 1.0]))
    df = spark.createDataFrame(rows, "k string, n int, t double, pos array<double>, up array<double>")
    df = df.withColumn("ts", F.timestamp_seconds(F.col("t") + 1_000_000)).withColumn("frame_idx", F.col("n"))
    src = str(tmp_path / "src")
    for n in range(5):
        df.where(F.col("n") == n).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = (summarize_stream(stream, "k", "ts", "10 seconds", 1000).writeStream.format("memory").queryName("unordered").outputMode("append")
         .option("checkpointLocation", str(tmp_path / "ck")).start())
    q.processAllAvailable()
    q.stop()
    got = spark.sql("select * from unordered where k = 'a'").collect()
    want = summarize(df.where("k = 'a'"), ["k"], ["t", "n"]).first()
    assert len(got) == 1 and got[0]["n_frames"] == 11
    for c in want.asDict():
        if c != "k":
            assert got[0][c] == pytest.approx(want[c], abs=1e-9), c


def test_late_frames_have_a_table_and_counts_add_up(spark, tmp_path):
    from probelake.streaming.trajectories import write_summaries

    triggers = [[0.0, 3.0, 30.0], [31.0, 19.0, 21.0], [5.0, 40.0], [7.0, 2.0], [33.0]]  # the watermark is 10 behind the last trigger's latest
    rows = [("a", n, t, [0.1 * t, 0.0, 0.5], [0.0, 0.0, 1.0]) for n, times in enumerate(triggers) for t in times]
    rows += [("b", 3, 4.0, [0.0, 0.0, 0.1], [0.0, 0.0, 1.0]), ("end", 5, 100_000.0, [0.0, 0.0, 0.0], [0.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "k string, n int, t double, pos array<double>, up array<double>").withColumn("ts", F.timestamp_seconds(F.col("t") + 1_000_000))
    src = str(tmp_path / "src")
    for n in range(6):
        df.where(F.col("n") == n).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = write_summaries(summarize_stream(stream, "k", "ts", "10 seconds", 1000, late=True), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    late = {(r["k"], r["late_t"]): r for r in spark.read.parquet(str(tmp_path / "out" / "late")).collect()}
    done = {r["k"]: r for r in spark.read.parquet(str(tmp_path / "out" / "summaries")).collect()}
    assert set(late) == {("a", 19.0), ("a", 5.0), ("a", 7.0), ("a", 2.0), ("b", 4.0)} and set(done) == {"a"}
    assert late["a", 19.0]["late_pos"] == pytest.approx([1.9, 0.0, 0.5]) and late["a", 19.0]["late_ms"] == 1_000_019_000
    assert done["a"]["n_frames"] + len(late) == len(rows) - 1
    kept = df.where("k = 'a'").where(~F.col("t").isin(19.0, 5.0, 7.0, 2.0))
    want = summarize(kept.withColumn("frame_idx", F.col("n")), ["k"], ["t", "n"]).first()
    for c in ("n_frames", "path_length", "max_height", "slid_distance"):
        assert done["a"][c] == pytest.approx(want[c], abs=1e-9), c
