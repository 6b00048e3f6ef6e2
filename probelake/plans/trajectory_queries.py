"""Trajectory queries: A2, A3, A30-A34, W1, W2, W4, W5, P14, P15, C5, C6."""

from __future__ import annotations

from pyspark.sql import functions as F

from probelake import constants as K
from probelake.functions.scalars import angle_from_up, dist
from probelake.operators import trajectories as TR
from probelake.operators.targets import behavior_vector, outcome_vector
from probelake.plans import standins as ST
from probelake.plans.registry import query, r6, rounded, table

OUT = list(K.OUTCOME_FIELDS)
ROUNDED_OUT = ", ".join(f"round({f}, 6) + 0.0 AS {f}" for f in OUT)


@query("A2_traj_summary", f"WITH {ST.FRAMES_SQL} SELECT user_id, event_type, n_frames, {ROUNDED_OUT} FROM outcomes")
def traj_summary(spark, sf):
    return rounded(ST.outcomes(spark, sf), *OUT)


@query("W1_frame_deltas", f"""WITH {ST.FRAMES_SQL}
SELECT user_id, event_type, event_id, round(step, 6) + 0.0 AS step, round(speed, 4) + 0.0 AS speed,
       round(vz, 4) + 0.0 AS vz FROM bounced""")
def frame_deltas(spark, sf):
    d = TR.frame_deltas(ST.banded_frames(spark, sf), ST.KEYS, ST.ORDER, ST.BAND)
    return d.select("user_id", "event_type", "event_id", r6("step").alias("step"), r6("speed", 4).alias("speed"),
                    r6("vz", 4).alias("vz"))


@query("W2_bounces", f"""WITH {ST.FRAMES_SQL}
SELECT user_id, event_type, event_id, bounce FROM bounced WHERE bounce""")
def bounces(spark, sf):
    return TR.frame_deltas(ST.banded_frames(spark, sf), ST.KEYS, ST.ORDER, ST.BAND).where("bounce").select(
        "user_id", "event_type", "event_id", "bounce")


_P21 = ", ".join(
    f"round(coalesce(max(CASE WHEN probe = '{p}' THEN {f} END), 0.0) / {K.OUTCOME_NORMALIZERS[f]}::DOUBLE, 6) + 0.0 "
    f"AS {p}_{f}" for p in K.PROBE_ORDER for f in K.OUTCOME_FIELDS)


@query("P15_behavior_vector", f"WITH {ST.FRAMES_SQL} SELECT user_id, {_P21} FROM probes GROUP BY user_id")
def behavior(spark, sf):
    wide = behavior_vector(ST.probe_outcomes(spark, sf), ["user_id"], order="event_type")
    return rounded(wide, *[c for c in wide.columns if c != "user_id"])


@query("P14_outcome_vector", f"""WITH {ST.FRAMES_SQL} SELECT user_id, probe,
{', '.join(f'round({f} / {K.OUTCOME_NORMALIZERS[f]}::DOUBLE, 6) + 0.0 AS {f}' for f in OUT)} FROM probes""")
def outcome_vectors(spark, sf):
    return rounded(ST.probe_outcomes(spark, sf).select("user_id", "probe", *outcome_vector(normalize=True)), *OUT)


@query("F12_enough_frames", """
SELECT user_id, event_type, count(*) AS n_frames, count(*) < 2 AS too_short FROM events GROUP BY user_id, event_type""")
def enough_frames(spark, sf):
    counts = ST.frames(spark, sf).groupBy(*ST.KEYS).agg(F.count(F.lit(1)).alias("n_frames"))
    return TR.enough_frames(counts, on_short="flag")


_TILT = "degrees(acos(greatest(-1.0, least(1.0, uz / sqrt(ux*ux+uy*uy+uz*uz)))))"


@query("C5_angle_from_up", f"WITH {ST.FRAMES_SQL} SELECT event_id, round({_TILT}, 6) + 0.0 AS tilt FROM frames")
def angle(spark, sf):
    return ST.frames(spark, sf).select("event_id", r6(angle_from_up("up")).alias("tilt"))


@query("C6_dist", f"WITH {ST.FRAMES_SQL} SELECT event_id, "
       "round(sqrt((x-ux)*(x-ux)+(y-uy)*(y-uy)+(z-uz)*(z-uz)), 6) + 0.0 AS d FROM frames")
def distance(spark, sf):
    return ST.frames(spark, sf).select("event_id", r6(dist("pos", "up")).alias("d"))


@query("A3_soft_topple", f"""WITH {ST.FRAMES_SQL}
SELECT event_type, round(avg((final_tilt_deg > 50)::INT), 6) + 0.0 AS p_topple, count(*) AS n_tilts
FROM outcomes GROUP BY event_type""")
def soft_topple(spark, sf):
    return rounded(TR.soft_topple(ST.outcomes(spark, sf), "final_tilt_deg", ["event_type"]), "p_topple")


@query("A31_deadband", f"""WITH {ST.FRAMES_SQL}
SELECT event_type, w AS half_width, round(avg((abs(final_tilt_deg - 50) <= w)::INT), 6) + 0.0 AS share
FROM outcomes, (VALUES (5.0::DOUBLE), (10.0::DOUBLE), (15.0::DOUBLE)) v(w) GROUP BY event_type, w""")
def deadband(spark, sf):
    return rounded(TR.deadband(ST.outcomes(spark, sf), "final_tilt_deg", by=["event_type"]), "share")


EDGES = (0.0, 10.0, 20.0, 30.0, 40.0, 50.0, 60.0, 70.0)


@query("A30_tilt_histogram", f"""WITH {ST.FRAMES_SQL}
SELECT i::INT AS bin, (i * 10.0)::DOUBLE AS edge, count(final_tilt_deg) AS n FROM range(7) r(i)
LEFT JOIN outcomes ON least(6, floor(final_tilt_deg / 10)) = i AND final_tilt_deg >= 0 GROUP BY i""")
def tilt_histogram(spark, sf):
    return TR.histogram(ST.outcomes(spark, sf), "final_tilt_deg", EDGES)


@query("A32_topple_rates", f"""WITH {ST.FRAMES_SQL},
o AS (SELECT event_type, user_id % 5 AS seed, toppled FROM outcomes),
r AS (SELECT event_type, seed, avg(toppled) AS rate FROM o GROUP BY 1, 2
      UNION ALL SELECT 'overall', seed, avg(toppled) FROM o GROUP BY seed)
SELECT event_type, round(avg(rate), 6) + 0.0 AS mean_rate, round(stddev_pop(rate), 6) + 0.0 AS sd_rate,
       count(rate) AS n_seeds FROM r GROUP BY event_type""")
def topple_rates(spark, sf):
    o = ST.outcomes(spark, sf).withColumn("seed", F.col("user_id") % 5)
    return rounded(TR.topple_rates(o, "event_type", "seed"), "mean_rate", "sd_rate")


@query("A33_jitter_stats", f"""WITH {ST.FRAMES_SQL}
SELECT user_id, round(avg(final_tilt_deg), 6) + 0.0 AS mean_tilt, round(stddev_pop(final_tilt_deg), 6) + 0.0 AS sd_tilt,
  round(avg((final_tilt_deg > 50)::INT), 6) + 0.0 AS p_topple,
  round(least(avg((final_tilt_deg > 50)::INT), 1 - avg((final_tilt_deg > 50)::INT)), 6) + 0.0 AS flip_rate
FROM outcomes GROUP BY user_id""")
def jitter_stats(spark, sf):
    s = TR.jitter_stats(ST.outcomes(spark, sf), "final_tilt_deg", ["user_id"])
    return rounded(s, "mean_tilt", "sd_tilt", "p_topple", "flip_rate")


@query("A34_determinism", f"""WITH {ST.FRAMES_SQL},
b AS (SELECT user_id, arg_min(slid_distance, event_type) AS s0, arg_min(max_height, event_type) AS h0
      FROM outcomes GROUP BY user_id)
SELECT user_id, count(*) AS n_reps,
  round(max(greatest(abs(slid_distance - s0), abs(max_height - h0))), 6) + 0.0 AS max_abs_diff
FROM outcomes JOIN b USING (user_id) GROUP BY user_id""")
def determinism(spark, sf):
    d = TR.determinism_check(ST.outcomes(spark, sf), ["user_id"], "event_type", ["slid_distance", "max_height"])
    return rounded(d, "max_abs_diff")


# a sweep: a stand-in tilt (mean price scaled to degrees) per quantity level, per return flag
_SWEEP = """sweep AS (SELECT l_returnflag, l_quantity AS h, avg(l_extendedprice) / 1060.0::DOUBLE AS d
  FROM lineitem GROUP BY 1, 2),
s AS (SELECT *, lag(h) OVER w AS h1, lag(d) OVER w AS d1 FROM sweep
      WINDOW w AS (PARTITION BY l_returnflag ORDER BY h)),
c AS (SELECT l_returnflag,
   arg_min(h1 + CASE WHEN d = d1 THEN 0.5 ELSE (50 - d1) / (d - d1) END * (h - h1), h)
     FILTER ((d1 > 50) <> (d > 50)) AS crossover,
   coalesce(max(abs(d - d1) / greatest(1e-9, h - h1)), 0) AS max_slope, avg((d > 50)::INT) AS topple_rate
   FROM s GROUP BY l_returnflag)"""


def _sweep(spark, sf):
    li = table(spark, sf, "lineitem")
    levels = li.groupBy("l_returnflag", F.col("l_quantity").alias("h")).agg(
        (F.avg("l_extendedprice") / 1060.0).alias("d"))
    return TR.crossover(levels, ["l_returnflag"], "h", "d")


@query("W4_crossover", f"""WITH {_SWEEP} SELECT l_returnflag, round(crossover, 6) + 0.0 AS crossover,
round(max_slope, 6) + 0.0 AS max_slope, round(topple_rate, 6) + 0.0 AS topple_rate FROM c""")
def crossover(spark, sf):
    return rounded(_sweep(spark, sf), "crossover", "max_slope", "topple_rate")


@query("W5_label_class", f"""WITH {_SWEEP} SELECT l_returnflag, CASE WHEN topple_rate <= 0.02 THEN 'never'
WHEN topple_rate >= 0.98 THEN 'always' WHEN crossover IS NOT NULL THEN 'boundary' ELSE 'mixed_no_crossover' END
AS label_class FROM c""")
def label_class(spark, sf):
    return _sweep(spark, sf).select("l_returnflag", TR.classify_label("topple_rate", "crossover").alias("label_class"))
