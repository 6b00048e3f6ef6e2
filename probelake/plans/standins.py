"""Stand-in inputs: the driver tables hold no scenes, so each operator reads a derived view of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probelake.operators.ranking import value_bands
from probelake.operators.trajectories import enough_frames, summarize
from probelake.plans.registry import table

PROBE_OF_EVENT = {"click": "drop", "view": "tilt", "purchase": "push"}


def hours(ts: str):
    """Hours since the epoch, independent of the session time zone."""
    n = f"cast({ts} AS timestamp_ntz)"
    micros = F.expr(f"unix_date(cast({n} AS date)) * 86400000000L + hour({n}) * 3600000000L + minute({n}) * 60000000L "
                    f"+ cast(extract(SECOND FROM {n}) * 1000000 AS bigint)")
    return micros / F.lit(3.6e9)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectory frames from ``events``: one trajectory per (user_id, event_type), ordered by (t, event_id)."""
    e = table(spark, sf_dir, "events")
    i, v = F.col("event_id"), F.col("value")
    return e.select(
        "user_id", "event_type", "event_id", hours("ts").alias("t"),
        F.array(v / 10.0, (i % 97) / F.lit(10.0), v).alias("pos"),
        F.array((i % 7 - 3).cast("double"), (i % 5 - 2).cast("double"), (1 + i % 3).cast("double")).alias("up"))


KEYS, ORDER = ("user_id", "event_type"), ("t", "event_id")

FRAMES_SQL = """
frames AS (
  SELECT user_id, event_type, event_id, epoch_us(ts) / CAST(3600000000 AS DOUBLE) AS t,
         value / 10.0::DOUBLE AS x, (event_id % 97) / 10.0::DOUBLE AS y, value AS z,
         (event_id % 7 - 3)::DOUBLE AS ux, (event_id % 5 - 2)::DOUBLE AS uy, (1 + event_id % 3)::DOUBLE AS uz
  FROM events),
lag1 AS (
  SELECT *, lag(t) OVER w AS pt, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(z) OVER w AS pz,
         row_number() OVER w AS rn
  FROM frames WINDOW w AS (PARTITION BY user_id, event_type ORDER BY t, event_id)),
deltas AS (
  SELECT *, sqrt((x-px)*(x-px) + (y-py)*(y-py) + (z-pz)*(z-pz)) AS step,
         sqrt((x-px)*(x-px) + (y-py)*(y-py) + (z-pz)*(z-pz)) / greatest(1e-9, t - pt) AS speed,
         (z - pz) / greatest(1e-9, t - pt) AS vz,
         degrees(acos(greatest(-1.0, least(1.0,
            uz / CASE WHEN sqrt(ux*ux+uy*uy+uz*uz) = 0 THEN 1.0 ELSE sqrt(ux*ux+uy*uy+uz*uz) END)))) AS tilt
  FROM lag1),
bounced AS (
  SELECT *, coalesce(lag(vz) OVER w < -0.03 AND vz > 0.03, false) AS bounce
  FROM deltas WINDOW w AS (PARTITION BY user_id, event_type ORDER BY t, event_id)),
outcomes AS (
  SELECT user_id, event_type, count(*) AS n_frames,
         CASE WHEN arg_max(tilt, rn) > 50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS toppled,
         coalesce(max(t) FILTER (speed > 0.03), min(t)) - min(t) AS settle_time,
         sqrt(pow(arg_max(x, rn) - arg_min(x, rn), 2) + pow(arg_max(y, rn) - arg_min(y, rn), 2)) AS slid_distance,
         (count(*) FILTER (bounce))::DOUBLE AS n_bounces,
         max(z) AS max_height, coalesce(sum(step), 0.0) AS path_length, arg_max(tilt, rn) AS final_tilt_deg
  FROM bounced GROUP BY user_id, event_type HAVING count(*) >= 2),
probes AS (
  SELECT user_id, CASE event_type WHEN 'click' THEN 'drop' WHEN 'view' THEN 'tilt' WHEN 'purchase' THEN 'push' END
           AS probe, outcomes.* EXCLUDE (user_id)
  FROM outcomes WHERE event_type IN ('click', 'view', 'purchase'))
"""


BAND, BAND_HOURS = "_band", 48.0  # a task holds two days of one trajectory at most


def banded_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return value_bands(frames(spark, sf_dir), "t", BAND_HOURS, BAND)


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2 on the stand-in trajectories; those with one frame are set aside by F12."""
    flagged = enough_frames(summarize(banded_frames(spark, sf_dir), KEYS, ORDER, BAND), on_short="flag")
    return flagged.where(~F.col("too_short")).drop("too_short")


def probe_kind(event_type="event_type"):
    kind = F.when(F.lit(False), F.lit(""))
    for event, probe in PROBE_OF_EVENT.items():
        kind = kind.when(F.col(event_type) == event, probe)
    return kind


def probe_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of the three probe kinds; a scene is a user."""
    return outcomes(spark, sf_dir).withColumn("probe", probe_kind()).where(F.col("probe").isNotNull())


# essence of a lineitem row: (density, friction, restitution), already normalized
ESSENCE = {"density": F.col, "friction": F.col, "restitution": F.col}
ESSENCE_SQL = "l_quantity / 50.0::DOUBLE AS density, l_discount * 10.0::DOUBLE AS friction, " \
              "l_tax * 12.5::DOUBLE AS restitution"


def essence_rows(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", *extra, (F.col("l_quantity") / 50.0).alias("density"),
        (F.col("l_discount") * 10.0).alias("friction"), (F.col("l_tax") * 12.5).alias("restitution"))


def latents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two 32-wide representations of the same rows: the halves of ``embedding``."""
    e = table(spark, sf_dir, "embeddings")
    z = F.transform("embedding", lambda v: v.cast("double"))
    return e.select("vec_id", "label", F.slice(z, 1, 32).alias("x"), F.slice(z, 33, 32).alias("y"))


LATENTS_SQL = """
latents AS (
  SELECT vec_id, label, list_transform(embedding[1:32], lambda v: v::DOUBLE) AS x,
         list_transform(embedding[33:64], lambda v: v::DOUBLE) AS y
  FROM embeddings)
"""
