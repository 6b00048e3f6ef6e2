"""Statistics and scoring queries: A4-A17, A22, A23, A35, A38-A41, A44, J11, T2-T4, V6, W7, F13."""

from __future__ import annotations

from pyspark.sql import functions as F

from probelake import constants as K
from probelake.operators import scoring as SC
from probelake.operators import stats as ST_
from probelake.plans import standins as ST
from probelake.plans.registry import query, r6, rounded, table

# one value per (arm, seed): arm = market segment, seed = nation
RUNS_SQL = """runs AS (SELECT c_mktsegment AS arm, c_nationkey AS seed, avg(c_acctbal) / 10000.0::DOUBLE AS value,
  CASE WHEN c_nationkey % 3 = 0 THEN 'untrained' ELSE 'trained' END AS kind FROM customer GROUP BY 1, 2)"""


def runs(spark, sf):
    c = table(spark, sf, "customer")
    return c.groupBy(F.col("c_mktsegment").alias("arm"), F.col("c_nationkey").alias("seed")).agg(
        (F.avg("c_acctbal") / 10000.0).alias("value")).withColumn(
        "kind", F.when(F.col("seed") % 3 == 0, "untrained").otherwise("trained"))


_ANY_CORR = """coalesce(covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0), 0)"""


@query("A11_pearson", f"""SELECT l_returnflag, round({_ANY_CORR.format(x='l_quantity', y='l_extendedprice')}, 6) + 0.0 AS r
FROM lineitem GROUP BY l_returnflag""")
def pearson(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        r6(ST_.pearson("l_quantity", "l_extendedprice")).alias("r"))


@query("A11_pearson_constant", "SELECT l_linestatus, 0.0::DOUBLE AS r FROM lineitem GROUP BY l_linestatus")
def pearson_constant(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_linestatus").agg(
        ST_.pearson(F.lit(1.0) + F.col("l_linenumber") * 0, "l_quantity").alias("r"))


@query("A41_coupling_r", f"""SELECT l_returnflag AS arm, round({_ANY_CORR.format(x='l_discount', y='l_tax')}, 6) + 0.0 AS r
FROM lineitem GROUP BY l_returnflag""")
def coupling_r(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("arm")).agg(
        r6(ST_.pearson("l_discount", "l_tax")).alias("r"))


@query("A12_spearman", f"""WITH r AS (SELECT o_orderpriority,
  row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey)::DOUBLE AS rx,
  row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey, o_orderkey)::DOUBLE AS ry FROM orders)
SELECT o_orderpriority, round({_ANY_CORR.format(x='rx', y='ry')}, 6) + 0.0 AS rho, count(*) AS n FROM r GROUP BY 1""")
def spearman(spark, sf):
    o = table(spark, sf, "orders")
    return rounded(ST_.spearman(o, "o_totalprice", "o_custkey", ["o_orderkey"], ["o_orderpriority"]), "rho")


@query("W7_rank", """SELECT l_orderkey, l_linenumber,
row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS rank FROM lineitem""")
def rank(spark, sf):
    from probelake.operators.ranking import sorted_rank

    tie = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    ranked = sorted_rank(table(spark, sf, "lineitem").select("l_extendedprice", *tie), ["l_extendedprice", *tie])
    return ranked.select("l_orderkey", "l_linenumber", (F.col("rank") - 1).alias("rank"))


@query("A13_describe", f"""WITH {RUNS_SQL} SELECT arm, round(avg(value), 6) + 0.0 AS mean,
round(stddev_pop(value), 6) + 0.0 AS sd, round(min(value), 6) + 0.0 AS min, round(max(value), 6) + 0.0 AS max,
count(*) AS n FROM runs GROUP BY arm""")
def describe(spark, sf):
    return rounded(runs(spark, sf).groupBy("arm").agg(*ST_.describe("value")), "mean", "sd", "min", "max")


@query("A14_sample_sd", """SELECT c_mktsegment, c_nationkey, round(coalesce(stddev_samp(c_acctbal), 0), 6) + 0.0 AS sd
FROM customer GROUP BY 1, 2""")
def sample_sd(spark, sf):
    return table(spark, sf, "customer").groupBy("c_mktsegment", "c_nationkey").agg(
        r6(ST_.sample_sd("c_acctbal")).alias("sd"))


def _welch_sql(sd):
    return f"""WITH {RUNS_SQL}, s AS (SELECT arm, avg(value) AS m, coalesce({sd}(value), 0) AS sd, count(*) AS n
  FROM runs GROUP BY arm), p AS (SELECT a.m - b.m AS diff, a.n AS na, b.n AS nb,
  sqrt(a.sd * a.sd / a.n + b.sd * b.sd / b.n) AS se FROM s a, s b WHERE a.arm = 'BUILDING' AND b.arm = 'MACHINERY')
SELECT round(diff, 6) + 0.0 AS diff, round(CASE WHEN na >= 2 AND nb >= 2 AND se > 0 THEN diff / se ELSE 'nan'::DOUBLE END, 6)
  + 0.0 AS t FROM p"""


@query("A15_welch_t", _welch_sql("stddev_samp"))
def welch_t(spark, sf):
    w = ST_.welch_between(runs(spark, sf), "value", "arm", "BUILDING", "MACHINERY")
    return rounded(w.select("diff", "t"), "diff", "t")


@query("A16_welch_t_summary", _welch_sql("stddev_pop"))
def welch_t_summary(spark, sf):
    w = ST_.welch_between(runs(spark, sf), "value", "arm", "BUILDING", "MACHINERY", spread="population")
    return rounded(w.select("diff", "t"), "diff", "t")


@query("A17_one_sample_t", f"""WITH {RUNS_SQL} SELECT arm, round(CASE WHEN count(*) >= 2 AND stddev_samp(value) > 0
THEN avg(value - 0.4) / (stddev_samp(value - 0.4) / sqrt(count(*))) ELSE 'nan'::DOUBLE END, 6) + 0.0 AS t
FROM runs GROUP BY arm""")
def one_sample_t(spark, sf):
    return runs(spark, sf).groupBy("arm").agg(r6(ST_.one_sample_t(F.col("value") - 0.4)).alias("t"))


_LEARNED = """l AS (SELECT arm, avg(value) FILTER (kind = 'trained') AS tm, coalesce(stddev_pop(value) FILTER (kind = 'trained'), 0) AS ts,
  avg(value) FILTER (kind = 'untrained') AS um, coalesce(stddev_pop(value) FILTER (kind = 'untrained'), 0) AS us
  FROM runs GROUP BY arm)"""


@query("A22_learned", f"WITH {RUNS_SQL}, {_LEARNED} SELECT arm, round(tm - um, 6) + 0.0 AS learned FROM l")
def learned(spark, sf):
    return rounded(ST_.learned(runs(spark, sf), "value", "kind", ["arm"]).select("arm", "learned"), "learned")


@query("A22_learned_per_seed", f"""WITH {RUNS_SQL}, {_LEARNED} SELECT runs.arm, seed, round(value - um, 6) + 0.0 AS learned
FROM runs JOIN l USING (arm) WHERE kind = 'trained'""")
def learned_per_seed(spark, sf):
    return rounded(ST_.learned_per_seed(runs(spark, sf), "value", "kind", "arm", "seed"), "learned")


@query("A23_clears_band", f"WITH {RUNS_SQL}, {_LEARNED} SELECT arm, tm - um > ts + us AS clears_band FROM l")
def clears_band(spark, sf):
    return ST_.learned(runs(spark, sf), "value", "kind", ["arm"]).select("arm", "clears_band")


# ---------------------------------------------------------------- losses and gains
# target and prediction of a lineitem: two fields; split by order key parity hash
_LOSS_SQL = """v AS (SELECT l_orderkey, l_linenumber, [l_quantity / 50, l_discount * 10] AS y,
  [(l_quantity + l_linenumber) / 55, l_tax * 12] AS p, [l_extendedprice / 100000.0::DOUBLE] AS ey,
  [l_quantity / 48] AS ep, CASE WHEN l_orderkey % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM lineitem),
f AS (SELECT split, unnest([1, 2]) - 1 AS pos, unnest(y) AS y, unnest(p) AS p FROM v)"""


def loss_rows(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(
        F.array(F.col("l_quantity") / 50, F.col("l_discount") * 10).alias("y"),
        F.array((F.col("l_quantity") + F.col("l_linenumber")) / 55, F.col("l_tax") * 12).alias("p"),
        F.array(F.col("l_extendedprice") / 100000.0).alias("ey"), F.array(F.col("l_quantity") / 48).alias("ep"),
        F.when(F.col("l_orderkey") % 5 == 0, "test").otherwise("train").alias("split"))


@query("A5_mse", f"WITH {_LOSS_SQL} SELECT round(avg((y - p) * (y - p)), 6) + 0.0 AS mse FROM f")
def mse(spark, sf):
    return loss_rows(spark, sf).agg(r6(SC.mse("p", "y")).alias("mse"))


@query("A6_per_field_mse", f"WITH {_LOSS_SQL} SELECT pos::INT AS pos, round(avg((y - p) * (y - p)), 6) + 0.0 AS mse FROM f GROUP BY pos")
def per_field_mse(spark, sf):
    return rounded(SC.per_field_mse(loss_rows(spark, sf), "p", "y"), "mse")


@query("A7_combined_loss", f"""WITH {_LOSS_SQL}, b AS (SELECT avg((y - p) * (y - p)) AS behavior FROM f),
e AS (SELECT avg((ey[1] - ep[1]) * (ey[1] - ep[1])) AS essence FROM v)
SELECT round(behavior, 6) + 0.0 AS behavior, round(essence, 6) + 0.0 AS essence,
round(essence, 6) + 0.0 AS render, round(behavior + 0.3 * essence + essence, 6) + 0.0 AS total FROM b, e""")
def combined_loss(spark, sf):
    heads = {"behavior": ("p", "y"), "essence": ("ep", "ey"), "render": ("ep", "ey"), "appearance": ("p", "y")}
    out = loss_rows(spark, sf).agg(*SC.combined_loss(heads))
    return rounded(out, *out.columns)


@query("A8_evaluate_split", f"""WITH {_LOSS_SQL}, b AS (SELECT split, avg((y - p) * (y - p)) AS m FROM f GROUP BY split),
e AS (SELECT split, avg((ey[1] - ep[1]) * (ey[1] - ep[1])) AS em, count(*) AS n FROM v GROUP BY split)
SELECT split, round(m, 6) + 0.0 AS behavior_mse, round(em, 6) + 0.0 AS essence_mse, n FROM b JOIN e USING (split)""")
def evaluate_split(spark, sf):
    out = SC.evaluate_split(loss_rows(spark, sf), {"behavior": ("p", "y"), "essence": ("ep", "ey")})
    return rounded(out, "behavior_mse", "essence_mse")


_FIELDS = """m AS (SELECT pos, avg(y) AS tm FROM f WHERE split = 'train' GROUP BY pos),
g AS (SELECT f.pos, avg((y - tm) * (y - tm)) AS base, avg((y - p) * (y - p)) AS mse, avg((y - y * 1.01) * (y - y * 1.01)) AS mse2
  FROM f JOIN m USING (pos) WHERE split = 'test' GROUP BY f.pos)"""


@query("A9_gain", f"""WITH {_LOSS_SQL}, {_FIELDS} SELECT round(avg(base), 6) + 0.0 AS baseline_mse, round(avg(mse), 6) + 0.0 AS mse,
round(avg(base) / avg(mse), 6) + 0.0 AS gain FROM g""")
def gain(spark, sf):
    return rounded(SC.gain(loss_rows(spark, sf), "y", "p"), "baseline_mse", "mse", "gain")


@query("A9_gain_perfect", "SELECT 'inf'::DOUBLE AS gain FROM lineitem LIMIT 1")
def gain_perfect(spark, sf):
    return SC.gain(loss_rows(spark, sf), "y", "y").select("gain")


@query("A10_per_field_gain", f"""WITH {_LOSS_SQL}, {_FIELDS} SELECT pos::INT AS pos, round(base / mse, 6) + 0.0 AS gain_a,
round(base / mse2, 3) + 0.0 AS gain_b, round(base / mse2 - base / mse, 3) + 0.0 AS delta FROM g""")
def per_field_gain(spark, sf):
    rows = loss_rows(spark, sf).withColumn("p2", F.transform("y", lambda v: v * 1.01))
    out = SC.per_field_gain(rows, "y", "p", "p2")
    return rounded(rounded(out, "gain_a"), "gain_b", "delta", digits=3)


@query("T2_top_fields", f"""WITH {_LOSS_SQL}, {_FIELDS} SELECT pos::INT AS pos, round(base / mse2 - base / mse, 3) + 0.0 AS delta
FROM g ORDER BY delta DESC LIMIT 6""")
def top_fields(spark, sf):
    rows = loss_rows(spark, sf).withColumn("p2", F.transform("y", lambda v: v * 1.01))
    out = SC.per_field_gain(rows, "y", "p", "p2").orderBy(F.desc("delta")).limit(6)
    return rounded(out.select("pos", "delta"), "delta", digits=3)


@query("T3_best_of", f"""WITH {RUNS_SQL} SELECT arm, arg_max(seed, value) AS best_seed, round(max(value), 6) + 0.0 AS best
FROM runs GROUP BY arm""")
def best_of(spark, sf):
    return rounded(runs(spark, sf).groupBy("arm").agg(F.max_by("seed", "value").alias("best_seed"), F.max("value").alias("best")),
                   "best")


@query("T4_extreme_arms", f"""WITH {RUNS_SQL}, a AS (SELECT arm, avg(value) AS r FROM runs GROUP BY arm)
SELECT arg_min(arm, r) AS lowest, arg_max(arm, r) AS highest, round(max(r) - min(r), 6) + 0.0 AS spread FROM a""")
def extreme_arms(spark, sf):
    a = runs(spark, sf).groupBy("arm").agg(F.avg("value").alias("r"))
    return a.agg(F.min_by("arm", "r").alias("lowest"), F.max_by("arm", "r").alias("highest"),
                 r6(F.max("r") - F.min("r")).alias("spread"))


# ---------------------------------------------------------------- outcome predictions
_TM = ", ".join(f"('{f}', avg({f}))" for f in K.OUTCOME_FIELDS)
_UNPIVOT = ", ".join(K.OUTCOME_FIELDS)
TRAIN_MEAN_SQL = f"""
longo AS (UNPIVOT (SELECT user_id, probe, {', '.join(f'{f}::DOUBLE AS {f}' for f in K.OUTCOME_FIELDS)} FROM probes)
  ON {_UNPIVOT} INTO NAME field VALUE truth),
tm AS (SELECT probe, field, avg(truth) AS train_mean FROM longo WHERE user_id % 2 = 0 GROUP BY 1, 2)"""


@query("A4_train_mean", f"""WITH {ST.FRAMES_SQL}, {TRAIN_MEAN_SQL}
SELECT probe, field, round(train_mean, 6) + 0.0 AS train_mean FROM tm""")
def train_mean(spark, sf):
    return rounded(SC.train_mean_outcomes(ST.probe_outcomes(spark, sf).where("user_id % 2 = 0")), "train_mean")


def scored_rows(spark, sf, outcomes=None):
    """Odd users with a prediction derived from the truth: some unparsed, some without bounces."""
    o = (outcomes if outcomes is not None else ST.probe_outcomes(spark, sf)).where("user_id % 2 = 1")
    pred = {f: F.col(f) * 1.1 + 0.05 for f in K.OUTCOME_FIELDS}
    pred["n_bounces"] = F.when(F.col("user_id") % 5 != 0, pred["n_bounces"])
    return o.select(
        F.col("user_id").alias("scene_id"), "probe",
        F.when(F.col("user_id") % 7 != 0, F.struct(*[c.alias(f) for f, c in pred.items()])).alias("prediction"),
        F.struct(*K.OUTCOME_FIELDS).alias("truth"))


_SCALE = "CASE field " + " ".join(f"WHEN '{f}' THEN {v}::DOUBLE" for f, v in K.OUTCOME_NORMALIZERS.items()) + " END"


@query("A35_score_predictions", f"""WITH {ST.FRAMES_SQL}, {TRAIN_MEAN_SQL},
e AS (SELECT probe, field, truth, train_mean, user_id, {_SCALE} AS scale,
  CASE WHEN user_id % 7 <> 0 AND NOT (field = 'n_bounces' AND user_id % 5 = 0) THEN truth * 1.1::DOUBLE + 0.05 END AS pred
  FROM longo JOIN tm USING (probe, field) WHERE user_id % 2 = 1),
q AS (SELECT *, pow((coalesce(pred, train_mean) - truth) / scale, 2) AS err, pow((train_mean - truth) / scale, 2) AS base,
  CASE WHEN probe = 'push' AND field = 'toppled' THEN pow(least(1.0, greatest(0.0, coalesce(pred, train_mean))) - truth, 2) END
  AS br FROM e)
SELECT probe, field, count(*) FILTER (field = 'toppled') AS n_rows,
  count(*) FILTER (field = 'toppled' AND user_id % 7 = 0) AS n_parse_failures, count(*) FILTER (pred IS NULL) AS n_imputed_fields,
  round(avg(err), 5) + 0.0 AS mse, round(avg(base), 5) + 0.0 AS baseline_mse, round(avg(br), 5) + 0.0 AS push_toppled_brier,
  round(avg(base) / nullif(avg(err), 0), 5) + 0.0 AS gain_over_mean
FROM q GROUP BY ROLLUP (probe, field)""")
def score_predictions(spark, sf):
    o = ST.probe_outcomes(spark, sf)
    means = SC.train_mean_outcomes(o.where("user_id % 2 = 0"))
    out = SC.score_predictions(scored_rows(spark, sf, o), means)
    return rounded(out, "mse", "baseline_mse", "push_toppled_brier", "gain_over_mean", digits=5)


@query("J11_baseline_lookup", f"""WITH {ST.FRAMES_SQL}, {TRAIN_MEAN_SQL} SELECT user_id, probe, field,
round(train_mean - truth, 5) + 0.0 AS residual FROM longo JOIN tm USING (probe, field)""")
def baseline_lookup(spark, sf):
    o = ST.probe_outcomes(spark, sf)
    means = SC.train_mean_outcomes(o.where("user_id % 2 = 0"))
    long = SC.melt_outcomes(o, ["user_id", "probe"], "truth")
    return long.join(F.broadcast(means), ["probe", "field"]).select(
        "user_id", "probe", "field", r6(F.col("train_mean") - F.col("truth"), 5).alias("residual"))


@query("A44_error_profile", f"""WITH {ST.FRAMES_SQL}, {TRAIN_MEAN_SQL}
SELECT probe, field, round(quantile_cont(truth, 0.5), 6) + 0.0 AS median, round(quantile_cont(truth, 0.99), 6) + 0.0 AS p99,
round(max(truth), 6) + 0.0 AS max, round(avg((truth > 10 * {_SCALE})::INT), 6) + 0.0 AS beyond_10x FROM longo GROUP BY 1, 2""")
def error_profile(spark, sf):
    long = SC.melt_outcomes(ST.probe_outcomes(spark, sf), ["user_id", "probe"], "truth")
    scale = F.create_map(*[F.lit(x) for kv in K.OUTCOME_NORMALIZERS.items() for x in kv])[F.col("field")]
    return rounded(SC.error_profile(long, "truth", "field", scale, ["probe"]), "median", "p99", "max", "beyond_10x")


# ---------------------------------------------------------------- study statistics
@query("A38_retention", """WITH t AS (SELECT c_mktsegment AS channel, avg(c_acctbal / 10000) AS trained,
  stddev_pop(c_acctbal / 10000) AS trained_sd FROM customer WHERE c_nationkey % 2 = 0 GROUP BY 1),
u AS (SELECT c_mktsegment AS channel, avg(c_acctbal / 10000) AS untrained FROM customer WHERE c_nationkey % 2 = 1 GROUP BY 1)
SELECT channel, round(trained, 6) + 0.0 AS trained, round(trained_sd, 6) + 0.0 AS trained_sd, round(untrained, 6) + 0.0 AS untrained,
round(CASE WHEN untrained > 0.1 THEN trained / untrained ELSE 'nan'::DOUBLE END, 6) + 0.0 AS retention FROM t JOIN u USING (channel)""")
def retention(spark, sf):
    c = table(spark, sf, "customer").select(
        F.col("c_mktsegment").alias("channel"), (F.col("c_acctbal") / 10000).alias("r2"), "c_nationkey")
    out = SC.retention(c.where("c_nationkey % 2 = 0"), c.where("c_nationkey % 2 = 1"))
    return rounded(out, "trained", "trained_sd", "untrained", "retention")


_GAINS = """gains AS (SELECT arm, seed, 1 + value AS gain, 1.1::DOUBLE AS shape_gain,
  CASE WHEN arm = 'FURNITURE' THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS ceiling FROM runs)"""


def gains(spark, sf):
    return runs(spark, sf).select("arm", "seed", (1 + F.col("value")).alias("gain"), F.lit(1.1).alias("shape_gain"),
                                  F.when(F.col("arm") == "FURNITURE", 1.0).otherwise(2.0).alias("ceiling"))


@query("A39_extraction_fraction", f"""WITH {RUNS_SQL}, {_GAINS} SELECT arm, seed, round(CASE WHEN ceiling - shape_gain > 0
THEN (gain - shape_gain) / (ceiling - shape_gain) ELSE 'nan'::DOUBLE END, 6) + 0.0 AS fraction FROM gains""")
def extraction_fraction(spark, sf):
    out = SC.extraction_fraction(gains(spark, sf), "gain", "shape_gain", "ceiling")
    return rounded(out.select("arm", "seed", "fraction"), "fraction")


@query("A40_delta", f"""WITH {RUNS_SQL}, {_GAINS} SELECT arm, round(avg(gain - shape_gain), 6) + 0.0 AS delta,
round(coalesce(stddev_samp(gain - shape_gain), 0), 6) + 0.0 AS delta_sd, count(*) FILTER (gain - shape_gain > 0.35) AS seeds_over,
count(*) AS n_seeds FROM gains GROUP BY arm""")
def delta(spark, sf):
    return rounded(SC.delta(gains(spark, sf), "gain", "shape_gain", ["arm"], 0.35), "delta", "delta_sd")


@query("V6_control_rank", f"""WITH {RUNS_SQL}, a AS (SELECT arm, avg(value) AS v FROM runs GROUP BY arm),
r AS (SELECT arm, row_number() OVER (ORDER BY v, arm) AS rank, count(*) OVER () AS n_arms FROM a)
SELECT arm, rank, n_arms, CASE rank WHEN 1 THEN 'PASS' WHEN 2 THEN 'bottom-two' ELSE 'FAIL' END AS status FROM r
WHERE arm = 'BUILDING'""")
def control_rank(spark, sf):
    from probelake.operators.verdicts import control_rank as rank_of

    a = runs(spark, sf).groupBy("arm").agg(F.avg("value").alias("v"))
    return rank_of(a, "arm", "v", "BUILDING")
