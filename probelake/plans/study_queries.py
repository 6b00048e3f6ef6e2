"""Study queries: A37, A42, A43, M1-M15, V1-V5, W8, F8, F9."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from probelake import constants as K
from probelake.functions.hashing import gaussian_sql
from probelake.functions.scalars import ternary_code
from probelake.operators import agreement as AG
from probelake.operators import coherence as CO
from probelake.operators import neighbors as NN
from probelake.operators import regressors as RG
from probelake.operators import reports as RP
from probelake.operators import scoring as SC
from probelake.operators import splits as SP
from probelake.operators import stats as ST_
from probelake.operators import verdicts as VD
from probelake.plans import standins as ST
from probelake.plans.alignment_queries import CKA_SQL, run_latents, run_neighbors
from probelake.plans.registry import query, r6, rounded, table
from probelake.plans.stat_queries import RUNS_SQL, runs
from probelake.session import durable

# ---------------------------------------------------------------- coherence
# given magnitudes: one entity per order, one direction per line
_MAGS = """m AS (SELECT l_partkey AS id, l_quantity AS x, l_extendedprice AS y FROM lineitem)"""
_R = "coalesce(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 0)"


def _mags(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_quantity").alias("render_mag"),
                                               F.col("l_extendedprice").alias("target_mag"))


@query("A42_coherence", f"""WITH {_MAGS}, s AS (SELECT id, {_R} AS r FROM m GROUP BY id)
SELECT round(avg(r), 6) + 0.0 AS coherence, count(*) AS n_samples FROM s""")
def coherence(spark, sf):
    return rounded(CO.coherence(_mags(spark, sf)), "coherence")


@query("A43_alignment_loss", f"WITH {_MAGS} SELECT round(1 - {_R}, 6) + 0.0 AS loss FROM m")
def alignment_loss(spark, sf):
    return rounded(CO.coherence_alignment_loss(_mags(spark, sf)), "loss")


# user functions with a closed form: entries 1-4 squared, entries 3-6 scaled, entries 9-12 scaled
def f_render(z):
    return z[:, :4] ** 2 * np.array([1.0, 2.0, 3.0, 4.0])


def f_target(z):
    return z[:, 2:6] * np.array([4.0, 3.0, 2.0, 1.0])


def f_other(z):
    return z[:, 8:12] * np.array([1.0, 1.0, 2.0, 2.0])


def _magnitudes(spark, sf, target=f_target):
    return CO.response_magnitudes(ST.latents(spark, sf), f_render, target, 32, id_col="vec_id", vec="x")


def _independent(spark, sf):
    return CO.independent_magnitudes(ST.latents(spark, sf), f_render, f_other, 32, 32, id_col="vec_id", render="x", target="y")


_EPS = "0.001::DOUBLE"


def _square_sql(weights, offset=0):
    terms = [f"pow({w}::DOUBLE * (pow(z[{i + 1}] + {_EPS} * g{i + offset}, 2) - pow(z[{i + 1}], 2)), 2)" for i, w in weights]
    return f"sqrt({' + '.join(terms)}) / {_EPS}"


def _linear_sql(weights, offset=0):
    return f"sqrt({' + '.join(f'pow({w}::DOUBLE * g{i + offset}, 2)' for i, w in weights)})"


def _directions_sql(dims):
    draws = ", ".join(f"{gaussian_sql(0, 'direction', 'vec_id', 'd', str(i))} AS g{i}" for i in dims)
    return f"dirs AS (SELECT vec_id AS id, d::INT AS direction, x AS z, {draws} FROM latents, range(48) r(d))"


_RENDER_SQL = _square_sql([(0, 1), (1, 2), (2, 3), (3, 4)])
_TARGET_SQL = _linear_sql([(2, 4), (3, 3), (4, 2), (5, 1)])
_OTHER_SQL = _linear_sql([(8, 1), (9, 1), (10, 2), (11, 2)])
_JOINT_SQL = _linear_sql([(8, 1), (9, 1), (10, 2), (11, 2)], 32)
_SCORE = "SELECT avg(r) AS c FROM (SELECT {r} AS r FROM (SELECT id, {x} AS x, {y} AS y FROM dirs) GROUP BY id)"


@query("M9_response_magnitudes", f"""WITH {ST.LATENTS_SQL}, {_directions_sql(range(6))}
SELECT id, direction, round({_RENDER_SQL}, 5) + 0.0 AS render_mag, round({_TARGET_SQL}, 5) + 0.0 AS target_mag FROM dirs""")
def response_magnitudes(spark, sf):
    return rounded(_magnitudes(spark, sf), "render_mag", "target_mag", digits=5)


@query("M10_independent_coherence", f"""WITH {ST.LATENTS_SQL}, {_directions_sql([*range(4), 40, 41, 42, 43])}
SELECT round(c, 6) + 0.0 AS coherence, (SELECT count(*) FROM latents) AS n_samples FROM ({_SCORE.format(r=_R, x=_RENDER_SQL, y=_JOINT_SQL)})""")
def independent_coherence(spark, sf):
    return rounded(CO.coherence(_independent(spark, sf)), "coherence")


@query("M11_compare", f"""WITH {ST.LATENTS_SQL}, {_directions_sql([*range(6), *range(8, 12), *range(40, 44)])},
s AS (SELECT ({_SCORE.format(r=_R, x=_RENDER_SQL, y=_TARGET_SQL)}) AS b, ({_SCORE.format(r=_R, x=_RENDER_SQL, y=_OTHER_SQL)}) AS o,
  ({_SCORE.format(r=_R, x=_RENDER_SQL, y=_JOINT_SQL)}) AS i), t AS (SELECT 'behavior' AS target, b AS sh, i, o AS a FROM s UNION ALL SELECT 'essence', o, i, o FROM s)
SELECT target, round(sh, 6) + 0.0 AS shared_coherence, round(i, 6) + 0.0 AS independent_coherence, round(sh - i, 6) + 0.0 AS gap,
  round(a, 6) + 0.0 AS architectural_coherence, round(sh - a, 6) + 0.0 AS learned_coherence, (SELECT count(*) FROM latents) AS n_samples FROM t""")
def compare(spark, sf):
    left, right = (lambda f: lambda z: f(z[:, :32])), (lambda f: lambda z: f(z[:, 32:]))
    render, target, other, apart = left(f_render), left(f_target), left(f_other), right(f_other)
    arm = lambda behavior, essence: {"behavior": (render, behavior), "essence": (render, essence)}
    joint = ST.latents(spark, sf).select("vec_id", F.concat("x", "y").alias("z"))
    out = CO.compare_models(joint, {"shared": arm(target, other), "independent": arm(apart, apart), "untrained": arm(other, other)}, 64, id_col="vec_id")
    return rounded(out, "shared_coherence", "independent_coherence", "gap", "architectural_coherence", "learned_coherence")


@query("M12_coherence_experiment", f"""WITH {RUNS_SQL} SELECT arm AS target, round(avg(value) FILTER (kind = 'trained'), 6) + 0.0 AS trained_mean,
round(avg(value) FILTER (kind = 'untrained'), 6) + 0.0 AS untrained_mean,
round(avg(value) FILTER (kind = 'trained') - avg(value) FILTER (kind = 'untrained'), 6) + 0.0 AS learned,
count(*) FILTER (kind = 'trained') AS trained_n, round(avg(value) FILTER (kind = 'trained') - 0.1, 6) + 0.0 AS gap_vs_independent
FROM runs GROUP BY arm""")
def coherence_experiment(spark, sf):
    r = runs(spark, sf).withColumnRenamed("arm", "target")
    control = r.select("target").distinct().withColumn("independent_baseline", F.lit(0.1))
    out = CO.coherence_experiment(r, "value", independent=control)
    return rounded(out.select("target", "trained_mean", "untrained_mean", "learned", "trained_n", "gap_vs_independent"),
                   "trained_mean", "untrained_mean", "learned", "gap_vs_independent")


# ---------------------------------------------------------------- regressors
def oracle_rows(spark, sf):
    """Scenes from ``part``: shape, essence and appearance features, a two-entry target, seeded split."""
    p = table(spark, sf, "part")
    size, price, k = F.col("p_size") / 50.0, F.col("p_retailprice") / 2000.0, F.col("p_partkey")
    rows = p.select(
        k.alias("id"), "p_type", F.array(size, price, F.pmod(k, F.lit(17)) / F.lit(17.0)).alias("essence"),
        F.array(size * 0.8 + F.pmod(k, F.lit(5)) / F.lit(20.0), price * 0.5).alias("appearance"))
    from probelake.operators.targets import assemble_features, one_hot_array

    rows = SP.object_split(one_hot_array(rows, "p_type", "shape"), "id", 0.25, 9)
    s, e = F.col("shape"), F.col("essence")
    y = F.array(s[0] * 0.5 + e[0] * e[1] + e[2] * 0.1, s[1] + e[0] * 2.0 - e[1])
    sets = assemble_features("shape", "essence", "appearance")
    return rows.select("id", "split", "shape", "essence", "appearance", y.alias("y"), sets["shape_appearance"].alias("shape_appearance"),
                       sets["shape_essence"].alias("shape_essence"))


_ORACLE_SQL = """b AS (SELECT p_partkey AS id, p_size / 50.0::DOUBLE AS a, p_retailprice / 2000.0::DOUBLE AS c, p_partkey % 17 / 17.0::DOUBLE AS d,
  row_number() OVER (ORDER BY md5('9|' || p_partkey)) AS k, count(*) OVER () AS n, dense_rank() OVER (ORDER BY p_type) - 1 AS t FROM part),
o AS (SELECT *, k <= round_even(n * 0.25, 0) AS test, (t = 0)::INT * 0.5::DOUBLE + a * c + d * 0.1 AS y0, (t = 1)::INT::DOUBLE + a * 2 - c AS y1 FROM b)"""


@query("M1_ridge_gain")
def ridge_gain(spark, sf):
    pred = RG.ridge(oracle_rows(spark, sf), "shape_essence", "y")
    return rounded(SC.gain(pred, "y", "prediction"), "baseline_mse", "mse", "gain")


@query("M1_ridge_single", """WITH s AS (SELECT avg(l_quantity) AS mx, stddev_pop(l_quantity) AS sx, avg(l_extendedprice) AS my, count(*) AS n,
covar_pop(l_quantity, l_extendedprice) AS cxy FROM lineitem WHERE l_linenumber <= 5)
SELECT l_orderkey, l_linenumber, round(my + (cxy / sx * n) / (n + 0.001::DOUBLE) * (l_quantity - mx) / sx, 3) + 0.0 AS prediction FROM lineitem, s""")
def ridge_single(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.array("l_quantity").alias("x"), F.array("l_extendedprice").alias("y"),
        F.when(F.col("l_linenumber") <= 5, "train").otherwise("test").alias("split"))
    out = RG.ridge(li, "x", "y").select("l_orderkey", "l_linenumber", F.col("prediction")[0].alias("prediction"))
    return rounded(out, "prediction", digits=3)


@query("M2_best_oracle")
def best_oracle(spark, sf):
    return RG.best_oracle(oracle_rows(spark, sf), "shape_essence", "y", 9)


@query("J5_knn_gain", f"""WITH {_ORACLE_SQL}, s AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(c) AS mc, stddev_pop(c) AS sc, avg(d) AS md, stddev_pop(d) AS sd,
  avg(y0) AS m0, avg(y1) AS m1 FROM o WHERE NOT test), z AS (SELECT id, test, y0, y1, [(a - ma) / sa, (c - mc) / sc, (d - md) / sd] AS v FROM o, s),
k AS (SELECT te.id, avg(tr.y0) AS p0, avg(tr.y1) AS p1 FROM (SELECT te.id, tr.id AS nid,
  row_number() OVER (PARTITION BY te.id ORDER BY list_distance(te.v, tr.v), tr.id) AS r FROM z te, z tr WHERE te.test AND NOT tr.test) te
  JOIN z tr ON tr.id = te.nid WHERE r <= 5 GROUP BY te.id)
SELECT round((avg((z.y0 - m0) * (z.y0 - m0)) + avg((z.y1 - m1) * (z.y1 - m1))) / (avg((z.y0 - p0) * (z.y0 - p0)) + avg((z.y1 - p1) * (z.y1 - p1))), 4)
 + 0.0 AS gain FROM z JOIN k USING (id), s""")
def knn_gain(spark, sf):
    pred = RG.knn_regress(durable(oracle_rows(spark, sf)), "essence", "y")
    return rounded(SC.gain(pred, "y", "prediction").select("gain"), "gain", digits=4)


def wide_oracle_rows(spark, sf):
    """The oracle rows with six more target entries, and two feature sets of one column."""
    a, c, d = (F.col("essence")[i] for i in range(3))
    y = F.concat("y", F.array(a * a, c * c, a * d, c * d, d * d, a * c * d))
    return oracle_rows(spark, sf).withColumns({"y": y, "size": F.array(a), "price": F.array(c)})


@query("M3_oracle_report")
def oracle_report(spark, sf):
    arms = {"shape": ("shape", 6), "essence": ("essence", 3), "shape_appearance": ("shape_appearance", 8), "shape_essence": ("shape_essence", 9)}
    return RG.oracle_report(wide_oracle_rows(spark, sf), arms, "y")


@query("M3_field_contributions", f"""WITH {_ORACLE_SQL}, w AS (SELECT id, test, a, c, unnest(range(8)) AS pos, unnest([y0, y1, a * a, c * c, a * d, c * d, d * d, a * c * d]) AS y FROM o),
x AS (SELECT 'size' AS arm, pos, test, a AS x, y FROM w UNION ALL SELECT 'price', pos, test, c, y FROM w),
m AS (SELECT arm, pos, avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, covar_pop(x, y) AS cxy, count(*) AS n FROM x WHERE NOT test GROUP BY ALL),
g AS (SELECT arm, pos, avg(pow(y - my, 2)) / greatest(avg(pow(y - (my + cxy / sx * n / (n + 0.001::DOUBLE) * (x - mx) / sx), 2)), 1e-12) AS gain
  FROM x JOIN m USING (arm, pos) WHERE test GROUP BY ALL),
r AS (SELECT p.pos, s.gain AS base_gain, p.gain, p.gain - s.gain AS delta FROM g p JOIN g s USING (pos) WHERE p.arm = 'price' AND s.arm = 'size')
SELECT 'price' AS arm, row_number() OVER (ORDER BY delta DESC, pos)::INT AS rank, pos::INT AS pos, round(base_gain, 5) + 0.0 AS base_gain, round(gain, 5) + 0.0 AS gain,
round(delta, 5) + 0.0 AS delta FROM r QUALIFY rank <= 6""")
def field_contributions(spark, sf):
    """The six target entries that gain most from the price beyond the size, by linear ridge."""
    fields = RG.arm_fields(wide_oracle_rows(spark, sf), {"size": ("size", 1), "price": ("price", 1)}, "y", regressors=("ridge-linear",))
    return rounded(RG.field_contributions(fields, "size"), "base_gain", "gain", "delta", digits=5)


@query("M2_best_linear", f"""WITH {_ORACLE_SQL}, w AS (SELECT test, a AS x, unnest(range(8)) AS pos, unnest([y0, y1, a * a, c * c, a * d, c * d, d * d, a * c * d]) AS y FROM o),
m AS (SELECT pos, avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, covar_pop(x, y) AS cxy, count(*) AS n FROM w WHERE NOT test GROUP BY ALL),
e AS (SELECT pos, test, avg(pow(y - my, 2)) AS b, avg(pow(y - (my + cxy / sx * n / (n + 0.001::DOUBLE) * (x - mx) / sx), 2)) AS s FROM w JOIN m USING (pos) GROUP BY ALL)
SELECT round(avg(b) FILTER (test) / avg(s) FILTER (test), 6) + 0.0 AS gain, round(avg(b) FILTER (NOT test) / avg(s) FILTER (NOT test), 6) + 0.0 AS train_gain, 'ridge-linear' AS regressor FROM e""")
def best_linear(spark, sf):
    """The best regressor among the linear ones of one feature, in closed form in the twin."""
    best = RG.best_oracle(wide_oracle_rows(spark, sf), "size", "y", 1, regressors=("ridge-linear",))
    return rounded(best, "gain", "train_gain")


_START_SQL = "t AS (SELECT id, a, row_number() OVER (ORDER BY md5('1|' || id)) AS k FROM o WHERE NOT test)"


@query("M4_quantize_rounds", f"""WITH {_ORACLE_SQL}, {_START_SQL}, c0 AS (SELECT k - 1 AS c, a AS m FROM t WHERE k <= 4),
c1 AS (SELECT c, avg(a) AS m FROM (SELECT id, a, arg_min(c, (abs(a - m), c)) AS c FROM t, c0 GROUP BY ALL) GROUP BY c),
c2 AS (SELECT c, avg(a) AS m FROM (SELECT id, a, arg_min(c, (abs(a - m), c)) AS c FROM t, c1 GROUP BY ALL) GROUP BY c)
SELECT c::INT AS cluster, count(*) AS n, round(avg(a), 6) + 0.0 AS mean FROM (SELECT id, a, arg_min(c2.c, (abs(a - m), c2.c)) AS c FROM (SELECT id, a FROM o) s, c2 GROUP BY ALL) GROUP BY c""")
def quantize_rounds(spark, sf):
    """Two Lloyd rounds of four clusters over one feature, spelled out in the twin."""
    rows, _ = RG.quantize(wide_oracle_rows(spark, sf), "size", 4, seed=1, rounds=2)
    return rounded(rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("size")[0]).alias("mean")), "mean")


@query("M4_quantize")
def quantize(spark, sf):
    rows, _ = RG.quantize(oracle_rows(spark, sf), "essence", 9, seed=1)
    return rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("essence")[0]).alias("center_0"))


@query("M5_bit_curve")
def bit_curve(spark, sf):
    return RG.bit_curve(oracle_rows(spark, sf), "shape", "essence", "y", (6, 3), clusters=K.BIT_CURVE_CLUSTERS)


_GAIN_SQL = f"{RUNS_SQL}, c AS (SELECT arm, avg(value) * 3 AS ceiling, avg(value) * 2.5 AS gain FROM runs GROUP BY arm)"


def _ceilings(spark, sf):
    return runs(spark, sf).groupBy("arm").agg((F.avg("value") * 3).alias("ceiling"), (F.avg("value") * 2.5).alias("gain"))


@query("M6_fidelity_gate", f"""WITH {_GAIN_SQL} SELECT arm, CASE WHEN ceiling >= 1.90 THEN 'DECOUPLING' WHEN ceiling <= 1.70 THEN 'LEGIBILITY' ELSE 'BOTH' END
AS verdict FROM c""")
def fidelity_gate(spark, sf):
    return _ceilings(spark, sf).select("arm", VD.fidelity("ceiling").alias("verdict"))


@query("M6_fresh_head_ceiling")
def fresh_head_ceiling(spark, sf):
    """Better of ridge and kNN from a representation to its label-derived target."""
    z = ST.latents(spark, sf).withColumn("y", F.array(F.col("label") / 10.0, F.col("y")[0]))
    z = SP.object_split(z, "vec_id", 0.25, 3).withColumnRenamed("vec_id", "id")
    best = RG.best_oracle(z, "x", "y", 32, quad=False)
    return best.select("gain", "regressor", VD.fidelity("gain").alias("verdict"))


@query("M7_aux_weight_report", f"""WITH {RUNS_SQL} SELECT arm AS weight, count(DISTINCT seed) AS n, round(avg(value), 6) + 0.0 AS behavior_gain_mean,
round(stddev_pop(value), 6) + 0.0 AS behavior_gain_sd, round(avg(value) * 2, 6) + 0.0 AS essence_gain_mean, round(avg(value * value), 6) + 0.0 AS render_mse_mean,
round(avg(1 - value / 3), 6) + 0.0 AS appearance_r2_mean FROM runs GROUP BY arm""")
def aux_weight_report(spark, sf):
    g = runs(spark, sf).select(F.col("arm").alias("weight"), "seed", F.col("value").alias("behavior_gain"), (F.col("value") * 2).alias("essence_gain"),
                               (F.col("value") * F.col("value")).alias("render_mse"), (1 - F.col("value") / 3).alias("appearance_r2"))
    return rounded(RG.aux_weight_report(g), "behavior_gain_mean", "behavior_gain_sd", "essence_gain_mean", "render_mse_mean", "appearance_r2_mean")


@query("M8_headroom_gate", f"""WITH {_GAIN_SQL} SELECT arm, CASE WHEN gain < 1.10 THEN 'UNPREDICTABLE' WHEN gain > 1.331 THEN 'GONE' ELSE 'INTACT' END AS verdict FROM c""")
def headroom_gate(spark, sf):
    return _ceilings(spark, sf).select("arm", VD.headroom("gain").alias("verdict"))


@query("A37_kfold_r2")
def kfold_r2(spark, sf):
    folds = SP.kfold(oracle_rows(spark, sf), "id", 5, 21)
    return rounded(RG.kfold_r2(folds, "shape_essence", "y"), "r2")


@query("A37_kfold_single", f"""WITH {_ORACLE_SQL}, f AS (SELECT id, a * 1.0 AS x, y0, y1, row_number() OVER (ORDER BY md5('21|' || id)) - 1 AS k, n FROM o),
g AS (SELECT *, (CASE WHEN k < (n % 5) * (n // 5 + 1) THEN k // (n // 5 + 1) ELSE (n % 5) + (k - (n % 5) * (n // 5 + 1)) // (n // 5) END)::INT AS fold FROM f),
w AS (SELECT id, fold, x, unnest([0, 1]) AS pos, unnest([y0, y1]) AS y FROM g),
m AS (SELECT t.fold, pos, avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, covar_pop(x, y) AS cxy, count(*) AS n FROM w, range(5) t(fold) WHERE w.fold <> t.fold GROUP BY ALL)
SELECT pos::INT AS pos, round(1 - sum(pow(y - (my + cxy / sx * n / (n + 0.001::DOUBLE) * (x - mx) / sx), 2)) / (var_pop(y) * count(*)), 6) + 0.0 AS r2 FROM w JOIN m USING (fold, pos) GROUP BY pos""")
def kfold_single(spark, sf):
    """Out-of-fold R2 of one feature, in closed form in the twin."""
    folds = SP.kfold(wide_oracle_rows(spark, sf).select("id", "size", F.slice("y", 1, 2).alias("y")), "id", 5, 21)
    return rounded(RG.kfold_r2(folds, "size", "y"), "r2")


@query("F9_present_mask", f"""WITH {RUNS_SQL}, c AS (SELECT arm AS channel, avg(value) FILTER (seed % 2 = 0) AS t, avg(value) FILTER (seed % 2 = 1) AS u FROM runs GROUP BY arm)
SELECT channel, round(CASE WHEN u > 0.45 THEN t / u ELSE 'nan'::DOUBLE END, 6) + 0.0 AS retention FROM c""")
def present_mask(spark, sf):
    r = runs(spark, sf).select(F.col("arm").alias("channel"), "seed", F.col("value").alias("r2"))
    return rounded(SC.retention(r.where("seed % 2 = 0"), r.where("seed % 2 = 1"), present=0.45).select("channel", "retention"), "retention")


# ---------------------------------------------------------------- reports
# eight slice runs: two arms, each with two trained and two untrained runs
_KINDS = [(arm, kind, seed) for arm in ("base", "loud") for kind in ("trained", "untrained") for seed in (0, 1)]
_FLOOR = 6.0  # participation ratio under which a trained 8-wide run is left out
_REPORT_SQL = f"""runs AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{a}', '{k}', {s})" for i, (a, k, s) in enumerate(_KINDS))}) v(run_id, arm, kind, seed)),
slices AS (SELECT i AS run_id, vec_id, list_transform(embedding[i * 8 + 1 : i * 8 + 8], lambda v: v::DOUBLE) AS z FROM embeddings, range(8) r(i)),
pops(population, step) AS (VALUES ('all', 1), ('test', 5)),
nn AS (SELECT * FROM (SELECT population, a.run_id, a.vec_id AS id, b.vec_id AS neighbor,
  row_number() OVER (PARTITION BY population, a.run_id, a.vec_id ORDER BY list_distance(a.z, b.z), b.vec_id) AS rank
  FROM pops JOIN slices a ON a.vec_id % step = 0 JOIN slices b ON b.vec_id % step = 0 AND a.run_id = b.run_id AND a.vec_id <> b.vec_id) WHERE rank <= 5),
hits AS (SELECT population, a.run_id AS run_a, b.run_id AS run_b, count(*) AS h FROM nn a JOIN nn b USING (population, id, neighbor) WHERE a.run_id < b.run_id GROUP BY ALL),
n AS (SELECT population, count(*) AS n FROM pops JOIN embeddings ON vec_id % step = 0 GROUP BY 1),
{CKA_SQL},
ratio AS (SELECT run_id, pow(sum(v), 2) / (sum(v * v) + 1e-12) AS pr FROM (SELECT run_id, dim, var_pop(v) AS v FROM entries GROUP BY ALL) GROUP BY 1),
used AS (SELECT runs.* FROM runs JOIN ratio USING (run_id) WHERE kind = 'untrained' OR pr >= {_FLOOR}),
pairs AS (SELECT CASE WHEN a.arm = b.arm THEN a.arm ELSE a.arm || '|' || b.arm END AS arm, a.kind, a.run_id AS run_a, b.run_id AS run_b FROM used a JOIN used b ON a.kind = b.kind
  AND (a.arm = b.arm AND a.run_id < b.run_id OR a.arm < b.arm AND a.seed <> b.seed)),
knn AS (SELECT n.population, arm, kind, coalesce(h, 0) / (n * 5.0::DOUBLE) AS knn, CASE WHEN n.population = 'all' AND arm NOT LIKE '%|%' THEN cka END AS cka
  FROM n, pairs LEFT JOIN pc USING (run_a, run_b) LEFT JOIN hits ON hits.run_a = pairs.run_a AND hits.run_b = pairs.run_b WHERE hits.population = n.population),
rep AS (SELECT population, arm, avg(knn) FILTER (kind = 'trained') AS t, avg(knn) FILTER (kind = 'untrained') AS u,
  avg(cka) FILTER (kind = 'trained') AS ct, avg(cka) FILTER (kind = 'untrained') AS cu FROM knn GROUP BY ALL),
firsts AS (SELECT arm, min(run_id) AS run_id FROM used WHERE kind = 'trained' GROUP BY 1),
pl AS (SELECT vec_id, row_number() OVER (ORDER BY md5('2026|' || vec_id)) AS p, count(*) OVER () AS m FROM embeddings),
gate AS (SELECT 'all' AS population, arm, max(x.m) AS m, count(*) FILTER (b.id = a.id) AS own, count(*) FILTER (b.id = y.vec_id) AS h FROM firsts JOIN nn a ON a.run_id = firsts.run_id AND a.population = 'all'
  JOIN pl x ON x.vec_id = a.id JOIN pl y ON y.p = (x.p + x.m - 2) % x.m + 1
  JOIN nn b ON b.population = 'all' AND b.run_id = a.run_id AND b.neighbor = a.neighbor AND (b.id = a.id OR b.id = y.vec_id) GROUP BY ALL)"""


@query("M13_alignment_report", f"""WITH {_REPORT_SQL} SELECT rep.population, rep.arm, round(t, 6) + 0.0 AS trained, round(u, 6) + 0.0 AS untrained, round(t - u, 6) + 0.0 AS learned,
round(ct, 6) + 0.0 AS trained_cka, round(cu, 6) + 0.0 AS untrained_cka, (SELECT count(*) FROM runs WHERE runs.arm = rep.arm AND run_id NOT IN (SELECT run_id FROM used)) AS n_dropped,
round(own / (m * 5.0::DOUBLE), 6) + 0.0 AS self_overlap, round(h / (m * 5.0::DOUBLE), 6) + 0.0 AS shuffle, round(5.0::DOUBLE / (m - 1), 6) + 0.0 AS chance
FROM rep LEFT JOIN gate USING (population, arm)""")
def alignment_report(spark, sf):
    """Neighbour and kernel alignment per arm and pair of arms, over all rows and over test rows, with the gates."""
    test = F.col("id") % 5 == 0
    tables = durable(run_neighbors(spark, sf, [("all", F.lit(True)), ("test", test)]).select("population", "run_id", "id", "neighbor"))  # read by every measure
    cells = [F.struct(F.lit(i).cast("bigint").alias("run_id"), F.lit(a).alias("arm"), F.lit(k).alias("kind"), F.lit(s).alias("seed"))
             for i, (a, k, s) in enumerate(_KINDS)]
    registry = tables.select("run_id").distinct().join(
        F.broadcast(spark.range(1).select(F.explode(F.array(*cells)).alias("r")).select("r.*")), "run_id")  # eight rows
    out = RP.alignment_report(tables, registry, 5, latents=run_latents(spark, sf), floor=_FLOOR).fillna(0, ["n_dropped"])
    return rounded(out, "trained", "untrained", "learned", "trained_cka", "untrained_cka", "self_overlap", "shuffle", "chance")


# eight runs of 8-digit codes, and factors of a scene from the part of the same number
_RUN_CODES_SQL = """codes AS (SELECT i AS run_id, vec_id, label, list_transform(embedding[i * 8 + 1 : i * 8 + 8], lambda v: CAST(round_even(tanh(8 * v::DOUBLE), 0) AS INTEGER)) AS code
  FROM embeddings, range(8) r(i))"""
_MEASURED = {"density": "p_retailprice", "friction": "p_size", "roughness": "length(p_name)::DOUBLE"}


def run_codes(spark, sf):
    """(vec_id, run_id, code, label, density, friction, roughness)."""
    h = run_latents(spark, sf).select(F.col("id").alias("vec_id"), "run_id", ternary_code(F.transform("z", lambda v: v * 8)).alias("code"))
    scene = table(spark, sf, "embeddings").select("vec_id", "label")
    part = table(spark, sf, "part").select((F.col("p_partkey") - 1).alias("vec_id"), F.col("p_retailprice").cast("double").alias("density"),
                                           F.col("p_size").cast("double").alias("friction"), F.length("p_name").cast("double").alias("roughness"))
    return h.join(scene.join(part, "vec_id", "left"), "vec_id")


@query("M14_code_report")
def code_report(spark, sf):
    return RP.code_report(durable(run_codes(spark, sf)), "vec_id", "run_id", "code", ["label"], list(_MEASURED), width=8, draws=200)


@query("M14_code_ari", f"""WITH {_RUN_CODES_SQL}, k AS (SELECT a.run_id || '|' || b.run_id AS item, w AS width, a.code[1:w]::VARCHAR AS a, b.code[1:w]::VARCHAR AS b
  FROM codes a JOIN codes b ON a.vec_id = b.vec_id AND a.run_id < b.run_id, (VALUES (1), (2), (4), (8)) v(w)),
j AS (SELECT item, width, a, b, count(*) AS n FROM k GROUP BY ALL), jj AS (SELECT item, width, sum(n * (n - 1) / 2.0::DOUBLE) AS s, sum(n) AS n FROM j GROUP BY ALL),
aa AS (SELECT item, width, sum(n * (n - 1) / 2.0::DOUBLE) AS pa FROM (SELECT item, width, a, sum(n) AS n FROM j GROUP BY ALL) GROUP BY ALL),
bb AS (SELECT item, width, sum(n * (n - 1) / 2.0::DOUBLE) AS pb FROM (SELECT item, width, b, sum(n) AS n FROM j GROUP BY ALL) GROUP BY ALL)
SELECT item, width, round((s - pa * pb / (n * (n - 1) / 2.0)) / ((pa + pb) / 2 - pa * pb / (n * (n - 1) / 2.0)), 6) + 0.0 AS ari, n::BIGINT AS n
FROM jj JOIN aa USING (item, width) JOIN bb USING (item, width)""")
def code_ari(spark, sf):
    cells = RP.code_cells(run_codes(spark, sf), "vec_id", "run_id", "code")
    return rounded(AG.adjusted_rand_by_width(cells, (1, 2, 4, 8), ["item"]), "ari")


_FACTOR_SQL = " UNION ALL ".join(
    f"SELECT vec_id, '{f}' AS factor, ((v > quantile_cont(v, 1.0::DOUBLE / 3) OVER ())::INT + (v > quantile_cont(v, 2.0::DOUBLE / 3) OVER ())::INT)::VARCHAR AS label FROM (SELECT vec_id, {c} AS v FROM scenes) WHERE v IS NOT NULL"
    for f, c in _MEASURED.items())


@query("M14_code_information", f"""WITH {_RUN_CODES_SQL}, scenes AS (SELECT vec_id, part.* FROM embeddings LEFT JOIN part ON p_partkey = vec_id + 1),
labels AS ({_FACTOR_SQL} UNION ALL SELECT vec_id, 'label', label::VARCHAR FROM embeddings),
d AS (SELECT run_id::VARCHAR AS item, vec_id, unnest(range(8))::INT AS entry, unnest(code) AS c FROM codes),
j AS (SELECT item, entry, factor, labels.label AS a, c AS b, count(*)::DOUBLE AS n FROM d JOIN labels USING (vec_id) GROUP BY ALL),
m AS (SELECT *, sum(n) OVER (PARTITION BY item, entry, factor) AS t, sum(n) OVER (PARTITION BY item, entry, factor, a) AS na, sum(n) OVER (PARTITION BY item, entry, factor, b) AS nb FROM j)
SELECT item, entry, factor, round(sum(n / t * ln(n * t / (na * nb))), 6) + 0.0 AS value FROM m GROUP BY ALL""")
def code_information(spark, sf):
    c = durable(run_codes(spark, sf))
    labels = RP.scene_labels(c, "vec_id", ["label"], list(_MEASURED))
    return rounded(RP.code_information(c, "run_id", "code", labels, "vec_id", 8), "value")


@query("M15_arm_report", f"""WITH {RUNS_SQL}, a AS (SELECT arm, avg(value) AS gain_mean, min(value) AS pr_min FROM runs GROUP BY arm),
i AS (SELECT arm, avg(value) AS independent FROM runs WHERE kind = 'untrained' AND arm <> 'FURNITURE' GROUP BY arm)
SELECT a.arm, round(gain_mean - 0.3, 6) + 0.0 AS delta_mean, round(pr_min, 6) + 0.0 AS pr_min,
round(coalesce(i.independent, (SELECT independent FROM i WHERE arm = 'BUILDING')), 6) + 0.0 AS independent, i.independent IS NULL AS inherited
FROM a LEFT JOIN i USING (arm)""")
def arm_report(spark, sf):
    r = runs(spark, sf)
    metrics = r.groupBy("arm").agg((F.avg("value") - 0.3).alias("delta_mean"), F.min("value").alias("pr_min"))
    controls = r.where("kind = 'untrained' AND arm <> 'FURNITURE'").groupBy("arm").agg(F.avg("value").alias("independent"))
    return rounded(RP.arm_report(metrics, controls, "BUILDING"), "delta_mean", "pr_min", "independent")


# ---------------------------------------------------------------- gates and verdicts
_ARMS_SQL = f"""{RUNS_SQL}, arms AS (SELECT arm, avg(value) AS learned, stddev_pop(value) AS sd, count(*) AS n, min(value) * 40 AS pr,
  CASE WHEN arm <> 'FURNITURE' THEN avg(value) / 10 END AS indep FROM runs GROUP BY arm)"""


def _arms(spark, sf):
    return runs(spark, sf).groupBy("arm").agg(
        F.avg("value").alias("learned"), F.stddev_pop("value").alias("sd"), F.count("value").alias("n"), (F.min("value") * 40).alias("pr"),
        F.when(F.col("arm") != "FURNITURE", F.avg("value") / 10).alias("indep"))


@query("V1_gates", f"""WITH {_ARMS_SQL} SELECT arm, concat_ws('; ', CASE WHEN pr < 8 THEN 'rank collapse' END, CASE WHEN indep IS NULL THEN 'control not measured' END,
CASE WHEN abs(indep) >= 0.05 THEN 'control not near zero' END, CASE WHEN learned NOT BETWEEN 0.4 AND 0.5 THEN 'outside validity band' END) AS notes,
pr >= 8 AND indep IS NOT NULL AND abs(coalesce(indep, 0)) < 0.05 AND learned BETWEEN 0.4 AND 0.5 AS passed FROM arms""")
def gates(spark, sf):
    rules = VD.coherence_gates("pr", "indep", "learned", band=(0.4, 0.5))
    out = VD.apply_gates(_arms(spark, sf), rules)
    return out.select("arm", F.concat_ws("; ", "notes").alias("notes"), "passed")


@query("V1_all_pass", f"WITH {_ARMS_SQL} SELECT bool_and(pr >= 8) AS gates_ok FROM arms WHERE arm <> 'BUILDING'")
def gates_all(spark, sf):
    return VD.all_pass(VD.apply_gates(_arms(spark, sf), {"rank collapse": F.col("pr") >= 8.0}), exempt=["BUILDING"])


_DIFF_SQL = f"""{_ARMS_SQL}, d AS (SELECT b.arm, b.learned - a.learned AS diff, CASE WHEN a.n >= 2 AND b.n >= 2 AND sqrt(a.sd * a.sd / a.n + b.sd * b.sd / b.n) > 0
  THEN (b.learned - a.learned) / sqrt(a.sd * a.sd / a.n + b.sd * b.sd / b.n) ELSE 'nan'::DOUBLE END AS t, b.pr >= 8 AS ok
  FROM arms a, arms b WHERE a.arm = 'BUILDING' AND b.arm <> 'BUILDING')"""


def _diffs(spark, sf):
    """Every arm against the reference arm (one row, attached as literals)."""
    from probelake.session import with_scalars

    arms = _arms(spark, sf)
    ref = arms.where("arm = 'BUILDING'").select(F.col("learned").alias("l0"), F.col("sd").alias("s0"), F.col("n").alias("n0"))
    out = with_scalars(arms.where("arm <> 'BUILDING'"), ref)
    return out.select("arm", (F.col("learned") - F.col("l0")).alias("diff"), ST_.welch("learned", "sd", "n", "l0", "s0", "n0").alias("t"),
                      (F.col("pr") >= 8).alias("ok"))


_LADDER = "CASE WHEN diff >= {rise} AND t >= {t} AND NOT isnan(t) THEN '{up}' WHEN abs(diff) < {null} THEN '{flat}' ELSE 'INCONCLUSIVE' END"


@query("V2_decide", f"""WITH {_DIFF_SQL} SELECT arm, round(diff, 6) + 0.0 AS diff, round(t, 6) + 0.0 AS t, CASE WHEN NOT ok THEN 'VOID' ELSE
{_LADDER.format(rise=0.01, t=0.2, up='RISES', null=0.005, flat='NULL')} END AS verdict FROM d""")
def decide(spark, sf):
    out = _diffs(spark, sf).withColumn("verdict", VD.decide("diff", "t", 0.01, 0.2, 0.005, "ok"))
    return rounded(out.select("arm", "diff", "t", "verdict"), "diff", "t")


@query("V2_ladders", f"""WITH {_DIFF_SQL} SELECT arm, {_LADDER.format(rise=0.2, t=2.5, up='NON-MONOTONIC', null=0.15, flat='PLATEAU')} AS peak,
{_LADDER.format(rise=0.2, t=2.5, up='DECLINE', null=0.08, flat='NULL')} AS decline, 'SUPPRESSED' AS stale,
CASE WHEN diff < 0.05 THEN 'CONFIRMED' WHEN diff >= 0.1 THEN 'REFUTED' ELSE 'INCONCLUSIVE' END AS carried,
CASE WHEN abs(diff) < 0.05 THEN 'PASS' WHEN abs(diff) <= 0.1 THEN 'MARGINAL' ELSE 'FAIL' END AS leak,
CASE WHEN abs(diff) >= 0.05 THEN 'SUPPRESSED' WHEN diff > 0.15 THEN 'WORLD LIMIT' WHEN t > 0.15 AND NOT isnan(t) THEN 'WORLD LIMIT (CONTINUOUS ONLY)' ELSE 'ARCHITECTURE LIMIT' END AS world,
CASE WHEN diff >= 0.05 AND t >= 2.5 AND NOT isnan(t) THEN 'RISES' WHEN abs(diff) < 0.05 THEN 'FLAT' ELSE 'MIXED' END AS curve,
CASE WHEN diff >= 0.2 AND t >= 2.5 AND NOT isnan(t) THEN 'x' ELSE 'WITHHELD' END AS withheld, diff >= 0.1 AND t >= 2.5 AND NOT isnan(t) AND diff >= -0.15 AS unified FROM d""")
def ladders(spark, sf):
    d = _diffs(spark, sf)
    leak = VD.control_leak(F.abs(F.col("diff")))
    return d.select(
        "arm", VD.peak("diff", "t").alias("peak"), VD.decline("diff", "t", F.lit(False)).alias("decline"), VD.decline("diff", "t", F.lit(True)).alias("stale"),
        VD.shape_carried("diff").alias("carried"), leak.alias("leak"),
        VD.coupling_limit("diff", F.lit(3), F.when(F.isnan("t"), F.lit(0.0)).otherwise(F.col("t")), leak).alias("world"),
        VD.curve_verdict("diff", "t", F.lit(1.0), F.abs(F.col("diff"))).alias("curve"),
        VD.gated_by_learning("diff", "t", F.lit("x")).alias("withheld"), VD.unified_without_cost("diff", "t", "diff", F.lit(0.0)).alias("unified"))


@query("V3_content_class", f"""WITH {RUNS_SQL}, f AS (SELECT seed, max(value) FILTER (arm = 'BUILDING') AS s, max(value) FILTER (arm <> 'BUILDING') AS m,
arg_max(arm, value) FILTER (arm <> 'BUILDING') AS best FROM runs GROUP BY seed)
SELECT seed, CASE WHEN s > 1.2 * m THEN 'shape-coded' WHEN m > 1.2 * s THEN 'material-coded (' || best || ')' ELSE 'mixed' END AS content FROM f""")
def content_class(spark, sf):
    return VD.content_class(runs(spark, sf), "seed", "arm", "value", shape="BUILDING").select("seed", "content")


@query("V4_agreement_verdict", f"""WITH {RUNS_SQL}, a AS (SELECT arm, bool_and(value > 0.1) AS above, avg(value - 0.25) AS excess FROM runs GROUP BY arm)
SELECT arm, above, round(excess, 6) + 0.0 AS mean_excess, CASE WHEN above AND excess >= 0.15 THEN 'CONVERGENT' WHEN excess < 0.05 THEN 'NOT CONVERGENT' ELSE 'INCONCLUSIVE' END
AS verdict FROM a""")
def agreement_verdict(spark, sf):
    r = runs(spark, sf).withColumn("null_mean", F.lit(0.25)).withColumn("null_p95", F.lit(0.1))
    return rounded(VD.agreement_verdict(r, ["arm"], "value", "null_mean", "null_p95"), "mean_excess")


@query("V5_paired_difference", f"""WITH {RUNS_SQL}, p AS (SELECT a.arm, a.value - b.value - 0.01 AS d FROM runs a JOIN runs b ON a.seed = b.seed AND b.arm = 'MACHINERY'
WHERE a.arm <> 'MACHINERY'), s AS (SELECT arm, avg(d) AS diff, CASE WHEN count(*) >= 2 AND stddev_samp(d) > 0 THEN avg(d) / (stddev_samp(d) / sqrt(count(*)))
ELSE 'nan'::DOUBLE END AS t, count(*) AS n FROM p GROUP BY arm)
SELECT arm, round(diff, 6) + 0.0 AS d, round(t, 6) + 0.0 AS t, n, {_LADDER.format(rise=0.03, t=2.5, up='WORLD-SPECIFIC', null=0.02, flat='NULL')} AS verdict FROM s""")
def paired_difference(spark, sf):
    r = runs(spark, sf)
    cross = r.where("arm = 'MACHINERY'").select("seed", F.col("value").alias("cross"))
    paired = r.where("arm <> 'MACHINERY'").join(cross, "seed")
    return rounded(VD.paired_difference(paired, "value", "cross", F.lit(0.01), ["arm"]), "d", "t")


@query("W8_dose_response", f"""WITH {RUNS_SQL}, s AS (SELECT arm, value - lag(value) OVER (PARTITION BY arm ORDER BY seed) AS d FROM runs)
SELECT arm, count(*) AS n, CASE WHEN count(*) < 4 THEN 'incomplete' WHEN bool_and(d < 0) THEN 'monotone down' WHEN bool_and(d > 0) THEN 'monotone up' ELSE 'mixed' END
AS direction FROM s GROUP BY arm""")
def dose_response(spark, sf):
    return VD.dose_response(runs(spark, sf), "arm", "seed", "value")


@query("F8_fresh_seeds", f"WITH {RUNS_SQL} SELECT arm, count(*) AS n, false AS stale FROM runs WHERE seed >= 8 GROUP BY arm")
def fresh_seeds(spark, sf):
    return VD.fresh_seeds(runs(spark, sf)).groupBy("arm", "stale").agg(F.count(F.lit(1)).alias("n"))
