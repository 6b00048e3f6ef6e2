"""Trajectory summaries: frame deltas, bounces, outcomes, tipping statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probelake import constants as K
from probelake.functions.scalars import angle_from_up, col, dist


def _speed(a: Column, b: Column) -> Column:
    return dist(a["pos"], b["pos"]) / F.greatest(F.lit(1e-9), b["t"] - a["t"])


def _vertical(a: Column, b: Column) -> Column:
    return (b["pos"][2] - a["pos"][2]) / F.greatest(F.lit(1e-9), b["t"] - a["t"])


def _bounce(v_before: Column, v_after: Column) -> Column:
    return (v_before < -K.REST_SPEED) & (v_after > K.REST_SPEED)


def frame_deltas(frames: DataFrame, keys: Sequence[str], order: Sequence[str], band: str | None = None) -> DataFrame:
    """Per frame the step length, speed, vertical speed and bounce flag against the previous frame.

    With ``band`` the lags run inside (trajectory, band) slices, and the last two frames of the earlier
    slices are joined to the head of each slice, so no task ever holds a whole long trajectory.
    """
    w = Window.partitionBy(*keys, *([band] if band else [])).orderBy(*order)
    frame = F.struct("t", "pos")
    lagged = frames.withColumn("_f", frame).withColumn("_q", F.lag(frame).over(w)).withColumn(
        "_qq", F.lag(frame, 2).over(w))
    if band:
        lagged = lagged.withColumn("_n", F.row_number().over(w))
        tails = lagged.groupBy(*keys, band).agg(F.max_by("_f", "_n").alias("_last"), F.max_by("_q", "_n").alias("_pen"))
        across = Window.partitionBy(*keys).orderBy(band)
        heads = tails.select(
            *keys, band, F.lag("_last").over(across).alias("_b"),
            F.coalesce(F.lag("_pen").over(across), F.lag("_last", 2).over(across)).alias("_a"))
        n = F.col("_n")
        lagged = (
            lagged.join(heads, [*keys, band])
            .withColumn("_qq", F.when(n == 1, F.col("_a")).when(n == 2, F.col("_b")).otherwise(F.col("_qq")))
            .withColumn("_q", F.when(n == 1, F.col("_b")).otherwise(F.col("_q")))
            .drop("_n", "_a", "_b")
        )
    return (
        lagged.withColumn("step", dist(F.col("_q.pos"), F.col("pos")))
        .withColumn("speed", _speed(F.col("_q"), F.col("_f")))
        .withColumn("vz", _vertical(F.col("_q"), F.col("_f")))
        .withColumn("bounce", F.coalesce(_bounce(_vertical(F.col("_qq"), F.col("_q")), F.col("vz")), F.lit(False)))
        .drop("_f", "_q", "_qq")
    )


def summarize(frames: DataFrame, keys: Sequence[str], order: Sequence[str] = ("frame_idx",),
              band: str | None = None) -> DataFrame:
    """A2: one row of seven outcomes (plus ``n_frames``) per trajectory.

    ``band`` names an optional column that rises with ``order``. With it, a trajectory of any length is
    cut into (trajectory, band) slices that are summarized independently; every slice keeps its first
    and last two frames, and a second, small pass adds the motion across slice borders. Without it a
    trajectory is one slice and the second pass disappears.
    """
    slice_keys = [*keys, band] if band else list(keys)
    w = Window.partitionBy(*slice_keys).orderBy(*order)
    moved = frame_deltas(
        frames.select(*slice_keys, *[o for o in order if o not in slice_keys], "t", "pos", "up"), slice_keys, order)
    ranked = (
        moved.withColumn("_n", F.row_number().over(w))
        .withColumn("_tilt", angle_from_up("up"))
        .withColumn("_f", F.struct("t", "pos"))
    )
    if band:
        ranked = ranked.withColumn("_before", F.lag("_f").over(w))
    at = lambda c, k: F.max(F.when(F.col("_n") == k, col(c)))
    aggs = [
        F.count(F.lit(1)).alias("n_frames"),
        F.coalesce(F.sum("step"), F.lit(0.0)).alias("path_length"),
        F.max(F.col("pos")[2]).alias("max_height"),
        F.count_if("bounce").alias("n_bounces"),
        F.max_by("t", F.when(F.col("speed") > K.REST_SPEED, F.col("_n"))).alias("_moving"),
        F.max_by("_tilt", "_n").alias("final_tilt_deg"),
        F.min_by("_f", "_n").alias("_first"),
        F.max_by("_f", "_n").alias("_last"),
    ]
    if band:
        aggs += [at("_f", 2).alias("_second"), F.max_by("_before", "_n").alias("_penult")]
    slices = ranked.groupBy(*slice_keys).agg(*aggs)
    whole = _stitch(slices, keys, band) if band else slices
    return whole.select(
        *keys,
        "n_frames",
        F.when(F.col("final_tilt_deg") > K.TOPPLE_ANGLE_DEG, 1.0).otherwise(0.0).alias("toppled"),
        (F.coalesce("_moving", F.col("_first.t")) - F.col("_first.t")).alias("settle_time"),
        F.hypot(F.col("_last.pos")[0] - F.col("_first.pos")[0],
                F.col("_last.pos")[1] - F.col("_first.pos")[1]).alias("slid_distance"),
        F.col("n_bounces").cast("double").alias("n_bounces"),
        "max_height", "path_length", "final_tilt_deg",
    )


def _stitch(slices: DataFrame, keys: Sequence[str], band: str) -> DataFrame:
    """Add the motion between the last frames of one slice and the first frames of the next."""
    w = Window.partitionBy(*keys).orderBy(band)
    earlier = F.coalesce(F.lag("_penult").over(w), F.lag("_last", 2).over(w))
    out = slices.withColumn("_b", F.lag("_last").over(w)).withColumn("_a", earlier)
    a, b, f1, f2 = (F.col(c) for c in ("_a", "_b", "_first", "_second"))
    into = _speed(b, f1)
    at_first = F.coalesce(_bounce(_vertical(a, b), _vertical(b, f1)), F.lit(False))
    at_second = F.coalesce(_bounce(_vertical(b, f1), _vertical(f1, f2)), F.lit(False))
    out = (
        out.withColumn("path_length", F.col("path_length") + F.coalesce(dist(b["pos"], f1["pos"]), F.lit(0.0)))
        .withColumn("n_bounces", F.col("n_bounces") + at_first.cast("int") + at_second.cast("int"))
        .withColumn("_moving", F.coalesce("_moving", F.when(into > K.REST_SPEED, f1["t"])))
    )
    return out.groupBy(*keys).agg(
        F.sum("n_frames").alias("n_frames"),
        F.sum("path_length").alias("path_length"),
        F.max("max_height").alias("max_height"),
        F.sum("n_bounces").alias("n_bounces"),
        F.max_by("_moving", F.when(F.col("_moving").isNotNull(), F.col(band))).alias("_moving"),
        F.max_by("final_tilt_deg", band).alias("final_tilt_deg"),
        F.min_by("_first", band).alias("_first"),
        F.max_by("_last", band).alias("_last"),
    )


def enough_frames(summaries: DataFrame, on_short: str = "error") -> DataFrame:
    """trajectories with fewer than two frames are an error, or are set aside with a flag."""
    if on_short == "flag":
        return summaries.withColumn("too_short", F.col("n_frames") < 2)
    checked = F.when(F.col("n_frames") < 2, F.raise_error(F.lit("trajectory needs at least two frames")).cast("double"))
    return summaries.withColumn("toppled", F.coalesce(checked, F.col("toppled")))


def soft_topple(tilts: DataFrame, tilt: str, by: Sequence[str] = ()) -> DataFrame:
    """A3: share of repetitions whose final tilt exceeds the threshold (strict)."""
    return tilts.groupBy(*by).agg(
        F.avg((col(tilt) > K.TOPPLE_ANGLE_DEG).cast("double")).alias("p_topple"), F.count(tilt).alias("n_tilts"))


def deadband(tilts: DataFrame, tilt: str, widths: Sequence[float] = (5.0, 10.0, 15.0),
             by: Sequence[str] = ()) -> DataFrame:
    """Share of tilts within an inclusive band around the threshold, one row per width."""
    off = F.abs(col(tilt) - K.TOPPLE_ANGLE_DEG)
    names = [f"_w{i}" for i in range(len(widths))]
    wide = tilts.groupBy(*by).agg(*[F.avg((off <= w).cast("double")).alias(n) for w, n in zip(widths, names)])
    pairs = ", ".join(f"{float(w)}D, {n}" for w, n in zip(widths, names))
    return wide.selectExpr(*by, f"stack({len(widths)}, {pairs}) AS (half_width, share)")


def histogram(values: DataFrame, value: str, edges: Sequence[float]) -> DataFrame:
    """Half-open bins, the last one also takes everything at or above the last edge."""
    v, last = col(value), len(edges) - 2
    conds = [((v >= edges[i]) & (v < edges[i + 1])) if i < last else (v >= edges[i]) for i in range(last + 1)]
    wide = values.agg(*[F.count_if(c).alias(f"_b{i}") for i, c in enumerate(conds)])
    cells = ", ".join(f"{i}, {float(edges[i])}D, _b{i}" for i in range(last + 1))
    return wide.selectExpr(f"stack({last + 1}, {cells}) AS (bin, edge, n)")


def topple_rates(outcomes: DataFrame, group: str, seed: str, toppled: str = "toppled") -> DataFrame:
    """Topple rate per group and overall for every seed, then mean and population sd over seeds."""
    per_seed = outcomes.groupBy(seed, group).agg(F.sum(toppled).alias("_s"), F.count(toppled).alias("_n"))
    overall = per_seed.groupBy(seed).agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n")).withColumn(
        group, F.lit("overall"))
    rates = per_seed.withColumn(group, F.col(group).cast("string")).unionByName(overall)
    return (
        rates.withColumn("_rate", F.try_divide(F.col("_s"), F.col("_n"))).groupBy(group)
        .agg(F.avg("_rate").alias("mean_rate"), F.stddev_pop("_rate").alias("sd_rate"),
             F.count("_rate").alias("n_seeds"))
    )


def jitter_stats(tilts: DataFrame, tilt: str, by: Sequence[str]) -> DataFrame:
    """Mean and population sd of tilt, topple probability, flip rate."""
    p = F.avg((col(tilt) > K.TOPPLE_ANGLE_DEG).cast("double"))
    return tilts.groupBy(*by).agg(
        F.avg(tilt).alias("mean_tilt"), F.stddev_pop(tilt).alias("sd_tilt"), p.alias("p_topple"),
        F.least(p, F.lit(1.0) - p).alias("flip_rate"))


def determinism_check(repetitions: DataFrame, keys: Sequence[str], rep: str, fields: Sequence[str]) -> DataFrame:
    """Largest absolute difference of any field to the first repetition.

    ``|x - base|`` is largest at the extremes of x, so min, max and the first value per key suffice:
    one aggregate, no self join.
    """
    aggs = [f for c in fields for f in (F.min(c).alias(f"_lo_{c}"), F.max(c).alias(f"_hi_{c}"),
                                        F.min_by(c, rep).alias(f"_base_{c}"))]
    far = [F.greatest(F.abs(F.col(f"_hi_{c}") - F.col(f"_base_{c}")), F.abs(F.col(f"_lo_{c}") - F.col(f"_base_{c}")))
           for c in fields]
    worst = F.greatest(*far) if len(far) > 1 else far[0]
    return repetitions.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_reps"), *aggs).select(
        *keys, "n_reps", worst.alias("max_abs_diff"))


def crossover(sweep: DataFrame, keys: Sequence[str], level: str, tilt: str) -> DataFrame:
    """Where a sweep first changes its toppled label (interpolated at the threshold), and its steepest slope."""
    w = Window.partitionBy(*keys).orderBy(level)
    h1, d1 = F.lag(level).over(w), F.lag(tilt).over(w)
    rows = sweep.select(*keys, col(level).alias("_h"), col(tilt).alias("_d"), h1.alias("_h1"), d1.alias("_d1"))
    limit = F.lit(K.TOPPLE_ANGLE_DEG)
    flips = (F.col("_d1") > limit) != (F.col("_d") > limit)
    share = F.when(F.col("_d") == F.col("_d1"), 0.5).otherwise(
        F.try_divide(limit - F.col("_d1"), F.col("_d") - F.col("_d1")))
    at = F.col("_h1") + share * (F.col("_h") - F.col("_h1"))
    slope = F.abs(F.col("_d") - F.col("_d1")) / F.greatest(F.lit(1e-9), F.col("_h") - F.col("_h1"))
    return rows.groupBy(*keys).agg(
        F.min_by(at, F.when(flips, F.col("_h"))).alias("crossover"),
        F.coalesce(F.max(slope), F.lit(0.0)).alias("max_slope"),
        F.avg((F.col("_d") > limit).cast("double")).alias("topple_rate"),
    )


def classify_label(rate, crossing) -> Column:
    """Never / always / boundary / mixed_no_crossover."""
    r = col(rate)
    return (F.when(r <= 0.02, "never").when(r >= 0.98, "always")
            .when(col(crossing).isNotNull(), "boundary").otherwise("mixed_no_crossover"))
