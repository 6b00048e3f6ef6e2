"""The trajectory summary (A2) on a stream of frames.

State per trajectory is a dozen numbers, whatever its length, and the frames the watermark has not passed: these
wait, since earlier ones can still arrive, and are then taken in the order of t. A trajectory is emitted once
the watermark has passed its last frame by ``gap_ms``. What arrives behind the watermark is not summarized: it is
dropped, or, with ``late=True``, emitted as it came, so that summarized and late frames add up to all frames;
``write_summaries`` gives both kinds a table of their own. t that runs against the event time by more than the
watermark orders is an error.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from probelake import constants as K

_STATE = ("n bigint, t0 double, x0 double, y0 double, t double, x double, y double, z double, vz double, tilt double, "
          "path double, top double, bounces bigint, moving double, last bigint, "
          "wait_ms array<bigint>, wait_t array<double>, wait_pos array<array<double>>, wait_up array<array<double>>")
_OUT = ("n_frames bigint, toppled double, settle_time double, slid_distance double, n_bounces double, max_height double, "
        "path_length double, final_tilt_deg double")
_LATE = "late_ms bigint, late_t double, late_pos array<double>, late_up array<double>"
_NAMES, _OUT_NAMES, _LATE_NAMES = ([c.split()[0] for c in x.split(", ")] for x in (_STATE, _OUT, _LATE))


def _advance(s: dict | None, f: pd.DataFrame) -> dict:
    """Fold frames (sorted, none earlier than the state) into the state."""
    p = np.stack(f["pos"].to_numpy()).astype(float)
    t = f["t"].to_numpy(float)
    up = np.asarray(f["up"].iloc[-1], float)
    if s is None or not s["n"]:
        s = {**(s or {}), "n": 0, "t0": t[0], "x0": p[0, 0], "y0": p[0, 1], "vz": None, "path": 0.0, "top": -np.inf, "bounces": 0, "moving": t[0]}
        chain_p, chain_t = p, t
    else:
        chain_p = np.vstack([[s["x"], s["y"], s["z"]], p])
        chain_t = np.concatenate([[s["t"]], t])
    dt = np.maximum(np.diff(chain_t), 1e-9)
    move = np.diff(chain_p, axis=0)
    step = np.sqrt((move ** 2).sum(1))
    vz = move[:, 2] / dt
    before = vz if s["vz"] is None else np.concatenate([[s["vz"]], vz])
    fast = np.flatnonzero(step / dt > K.REST_SPEED)
    norm = np.sqrt((up ** 2).sum()) or 1.0
    return {**s, "n": s["n"] + len(t), "t": t[-1], "x": p[-1, 0], "y": p[-1, 1], "z": p[-1, 2],
            "vz": float(vz[-1]) if len(vz) else s["vz"], "tilt": float(np.degrees(np.arccos(np.clip(up[2] / norm, -1, 1)))),
            "path": s["path"] + float(step.sum()), "top": max(s["top"], float(p[:, 2].max())),
            "bounces": s["bounces"] + int(((before[:-1] < -K.REST_SPEED) & (before[1:] > K.REST_SPEED)).sum()),
            "moving": float(chain_t[fast[-1] + 1]) if len(fast) else s["moving"]}


def summarize_stream(frames: DataFrame, key: str, event_time: str, delay: str = "10 minutes", gap_ms: int = 600_000, late: bool = False) -> DataFrame:
    """Streaming A2: ``frames`` has ``key``, a timestamp ``event_time``, and t (seconds), pos, up as in the batch form.

    With ``late`` frames behind the watermark are rows of the result too: ``late_ms`` (event time), ``late_t``, ``late_pos`` and
    ``late_up`` are set and the columns of the summary are null.
    """
    kind = frames.schema[key].dataType.simpleString()

    def take(s, f):
        """Advance over frames the watermark has passed."""
        if not len(f):
            return s
        f = f.sort_values("t", kind="stable")
        if s["n"] and f["t"].iloc[0] < s["t"]:
            raise ValueError(f"t {f['t'].iloc[0]} is earlier than t {s['t']} of a frame with an earlier {event_time}")
        return _advance(s, f)

    def run(k, batches, state):
        s = dict(zip(_NAMES, state.get)) if state.exists else {**dict.fromkeys(_NAMES), "n": 0}
        waiting = pd.DataFrame({c: list(s["wait_" + c.lstrip("_")] or []) for c in ("_ms", "t", "pos", "up")})
        if state.hasTimedOut:
            s = take(s, waiting)
            state.remove()
            yield pd.DataFrame({
                key: [k[0]], "n_frames": [s["n"]], "toppled": [float(s["tilt"] > K.TOPPLE_ANGLE_DEG)], "settle_time": [s["moving"] - s["t0"]],
                "slid_distance": [float(np.hypot(s["x"] - s["x0"], s["y"] - s["y0"]))], "n_bounces": [float(s["bounces"])],
                "max_height": [s["top"]], "path_length": [s["path"]], "final_tilt_deg": [s["tilt"]], **(dict.fromkeys(_LATE_NAMES) if late else {})})
            return
        new = pd.concat([x[["_ms", "t", "pos", "up"]] for x in batches])
        if late:
            new = new[new["_ms"].notna()].astype({"_ms": "int64"})
            behind = new["_ms"] <= state.getCurrentWatermarkMs()
            out, new = new[behind], new[~behind]
            if len(out):
                yield pd.DataFrame({key: [k[0]] * len(out), **{n: None for n in _OUT_NAMES}, **{f"late_{c.lstrip('_')}": list(out[c]) for c in out.columns}})
            if not len(new):
                return
        frames_ = pd.concat([waiting, new], ignore_index=True) if len(waiting) else new
        passed = frames_["_ms"] <= state.getCurrentWatermarkMs()
        s, left = take(s, frames_[passed]), frames_[~passed]
        s["last"] = max(int(frames_["_ms"].max()), s["last"] or 0)
        s |= {"wait_ms": [int(v) for v in left["_ms"]], "wait_t": [float(v) for v in left["t"]],
              "wait_pos": [[float(v) for v in p] for p in left["pos"]], "wait_up": [[float(v) for v in p] for p in left["up"]]}
        state.update(tuple(v.item() if isinstance(v := s[n], np.generic) else v for n in _NAMES))
        state.setTimeoutTimestamp(max(s["last"], state.getCurrentWatermarkMs()) + gap_ms)

    rows = frames.withWatermark(event_time, delay).select(key, event_time, "t", "pos", "up", F.unix_millis(F.col(event_time).cast("timestamp")).alias("_ms"))
    if late:
        # Spark drops rows behind the watermark in front of the state. A frame goes in twice: its time alone, which moves
        # the watermark, and the frame without a watermarked time, which nothing drops.
        fields = ["t", "pos", "up", "_ms"]
        plain = frames.withColumn("_ms", F.unix_millis(F.col(event_time).cast("timestamp")))
        kinds = plain.select(*fields).schema
        mark = F.struct(F.col(event_time).alias("_time"), *[F.lit(None).cast(kinds[c].dataType).alias(c) for c in fields])
        frame = F.struct(F.lit(None).cast(frames.schema[event_time].dataType).alias("_time"), *fields)
        rows = plain.select(key, F.explode(F.array(mark, frame)).alias("r")).select(key, "r.*").withWatermark("_time", delay)
    schema = f"{key} {kind}, {_OUT}" + (f", {_LATE}" if late else "")
    return rows.groupBy(key).applyInPandasWithState(run, schema, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def write_summaries(results: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Start the query of ``summarize_stream(..., late=True)`` with two tables below ``folder``: ``summaries`` and ``late``.

    Each trigger writes folders of its own (``trigger=<n>``) and writes the same ones when it is repeated.
    """
    summary = [c for c in results.columns if c not in _LATE_NAMES]

    def write(batch: DataFrame, trigger: int) -> None:
        batch = batch.persist()
        try:
            is_late = F.col("late_ms").isNotNull()
            batch.where(~is_late).select(*summary).write.mode("overwrite").parquet(f"{folder}/summaries/trigger={trigger}")
            batch.where(is_late).select(summary[0], *_LATE_NAMES).write.mode("overwrite").parquet(f"{folder}/late/trigger={trigger}")
        finally:
            batch.unpersist()

    return results.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).start()
