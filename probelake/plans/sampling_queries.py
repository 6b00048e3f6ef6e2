"""Scalar and sampling queries: C1-C4, C7, C22, C25, Y1-Y8, X9."""

from __future__ import annotations

from pyspark.sql import functions as F

from probelake import constants as K
from probelake.functions import scalars as C
from probelake.functions.hashing import gaussian_sql, uniform_sql
from probelake.operators import sampling as SA
from probelake.operators import verdicts as VD
from probelake.plans.registry import query, r6, rounded, table
from probelake.plans.scene_queries import _MATERIALS_SQL, _pick_sql


@query("C1_lerp_clip", """SELECT p_partkey, round(50 + 7950 * (p_size / 50.0::DOUBLE), 6) + 0.0 AS lerped,
greatest(0.0::DOUBLE, least(1.0::DOUBLE, p_size / 30.0::DOUBLE - 0.2)) AS clipped FROM part""")
def lerp_clip(spark, sf):
    s = F.col("p_size")
    return table(spark, sf, "part").select("p_partkey", r6(C.lerp(50.0, 8000.0, s / 50.0)).alias("lerped"),
                                           C.clip01(s / 30.0 - 0.2).alias("clipped"))


@query("C2_inverse_maps", """SELECT p_partkey, round((ln(p_retailprice) - ln(50)) / (ln(8000) - ln(50)), 6) + 0.0 AS heaviness,
round((p_size / 50.0::DOUBLE - 0.05) / (1.10 - 0.05), 6) + 0.0 AS grip FROM part""")
def inverse_maps(spark, sf):
    return table(spark, sf, "part").select("p_partkey", r6(C.inv_log("p_retailprice", *K.DENSITY_RANGE)).alias("heaviness"),
                                           r6(C.inv_lin(F.col("p_size") / 50.0, *K.FRICTION_RANGE)).alias("grip"))


@query("C3_log_lerp", """SELECT p_partkey, round(exp(ln(50) + (ln(8000) - ln(50)) * (p_size / 50.0::DOUBLE)), 6) + 0.0 AS density FROM part""")
def log_lerp(spark, sf):
    return table(spark, sf, "part").select("p_partkey", r6(C.log_lerp(*K.DENSITY_RANGE, F.col("p_size") / 50.0)).alias("density"))


@query("C4_hsv_to_rgb", """WITH h AS (SELECT p_partkey, p_size / 50.0::DOUBLE AS h, (p_partkey % 11) / 10.0::DOUBLE AS s, (p_partkey % 7) / 6.0::DOUBLE AS v FROM part),
x AS (SELECT *, floor(h * 6) AS i, h * 6 - floor(h * 6) AS f FROM h),
y AS (SELECT *, v * (1 - s) AS p, v * (1 - s * f) AS q, v * (1 - s * (1 - f)) AS t, (i::INT % 6) + 1 AS k FROM x)
SELECT p_partkey, round([v, q, p, p, t, v][k], 6) + 0.0 AS r, round([t, v, v, q, p, p][k], 6) + 0.0 AS g, round([p, p, t, v, v, q][k], 6) + 0.0 AS b FROM y""")
def hsv_to_rgb(spark, sf):
    k = F.col("p_partkey")
    rgb = C.hsv_to_rgb(F.col("p_size") / 50.0, k % 11 / F.lit(10.0), k % 7 / F.lit(6.0))
    return rounded(table(spark, sf, "part").select("p_partkey", rgb.alias("c")).select("p_partkey", "c.*"), "r", "g", "b")


@query("C7_quat_to_up", """WITH q AS (SELECT event_id, (event_id % 7) / 7.0::DOUBLE AS w, (event_id % 5) / 5.0::DOUBLE AS x, (event_id % 3) / 3.0::DOUBLE AS y,
value / 500 AS z FROM events) SELECT event_id, round(2 * (x * z + w * y), 6) + 0.0 AS ux, round(2 * (y * z - w * x), 6) + 0.0 AS uy,
round(1 - 2 * (x * x + y * y), 6) + 0.0 AS uz FROM q""")
def quat_to_up(spark, sf):
    i = F.col("event_id")
    q = F.array(i % 7 / F.lit(7.0), i % 5 / F.lit(5.0), i % 3 / F.lit(3.0), F.col("value") / 500)
    up = table(spark, sf, "events").select("event_id", C.quat_to_up(q).alias("u"))
    return up.select("event_id", *[r6(F.col("u")[j]).alias(f"u{a}") for j, a in enumerate("xyz")])


@query("C22_normalized_essence", """SELECT p_partkey, round(p_retailprice / 8000, 8) + 0.0 AS density, round(p_size / 50.0::DOUBLE / 1.5, 8) + 0.0 AS friction,
round(p_size / 64.0::DOUBLE, 8) + 0.0 AS restitution FROM part""")
def normalized_essence(spark, sf):
    e = C.normalized_essence("p_retailprice", F.col("p_size") / 50.0, F.col("p_size") / 64.0)
    return rounded(table(spark, sf, "part").select("p_partkey", e.alias("e")).select("p_partkey", "e.*"), *K.ESSENCE_FIELDS, digits=8)


@query("C25_bits", "SELECT p_partkey, round(log2(p_size), 6) + 0.0 AS bits, round(log2(3) * p_size, 6) + 0.0 AS code_bits FROM part")
def bits(spark, sf):
    return table(spark, sf, "part").select("p_partkey", r6(C.bits("p_size")).alias("bits"), r6(C.code_bits("p_size")).alias("code_bits"))


# ---------------------------------------------------------------- maps on given draws
def _given(spark, sf):
    """Factors and draws read off ``lineitem`` columns, so that the maps can be checked in SQL."""
    li = table(spark, sf, "lineitem")
    factors = {"heaviness": F.col("l_quantity") / 50.0, "grip": F.col("l_discount") * 10.0, "hardness": F.col("l_tax") * 12.5,
               "clarity": F.col("l_linenumber") / 10.0}
    draws = {"n_metallic": (F.col("l_partkey") % 5 - 2) / F.lit(40.0), "n_roughness": (F.col("l_suppkey") % 5 - 2) / F.lit(40.0),
             "n_transmission": (F.col("l_orderkey") % 5 - 2) / F.lit(40.0), "n_value": (F.col("l_partkey") % 7 - 3) / F.lit(60.0),
             "u_hue": F.col("l_partkey") % 100 / F.lit(100.0), "u_saturation": F.col("l_suppkey") % 10 / F.lit(10.0)}
    return li, factors, draws


_GIVEN = """g AS (SELECT l_orderkey, l_linenumber, l_quantity / 50.0::DOUBLE AS he, l_discount * 10.0::DOUBLE AS gr, l_tax * 12.5::DOUBLE AS ha,
  l_linenumber / 10.0::DOUBLE AS cl, (l_partkey % 5 - 2) / 40.0::DOUBLE AS nm, (l_suppkey % 5 - 2) / 40.0::DOUBLE AS nr,
  (l_orderkey % 5 - 2) / 40.0::DOUBLE AS nt, (l_partkey % 7 - 3) / 60.0::DOUBLE AS nv, l_partkey % 100 / 100.0::DOUBLE AS hue,
  l_suppkey % 10 / 10.0::DOUBLE AS us FROM lineitem)"""


def _clip(x):
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x}))"


def _looks_sql(source, gain):
    """CTEs from a source with he, gr, ha, cl (as seen by the appearance) and draws nm, nr, nt, nv, hue, us."""
    w = 1.0 - 1.0 / gain
    blend = lambda a, b: _clip(f"{1.0 - w}::DOUBLE * {a} + {w}::DOUBLE * ({b})") if w else a
    return f"""t AS (SELECT *, {_clip('cl + 0.5 * nt')} AS tr, {_clip('(1.2 * he - 0.2) * (1 - cl) + nm')} AS m0,
  {_clip('0.90 - 0.55 * ha - 0.70 * cl + 0.25 * gr + nr')} AS r0, {_clip('0.85 - 0.35 * he + nv')} AS v0 FROM {source}),
u AS (SELECT *, {_clip('0.15 + 0.45 * us - 0.3 * tr')} AS s, {blend('m0', 'he')} AS m, {blend('r0', 'gr')} AS ro, {blend('v0', '1 - ha')} AS v FROM t),
x AS (SELECT *, hue * 6 - floor(hue * 6) AS f, (floor(hue * 6)::INT % 6) + 1 AS k FROM u),
y AS (SELECT *, v * (1 - s) AS p, v * (1 - s * f) AS q, v * (1 - s * (1 - f)) AS w FROM x)"""


def _appearance_sql(gain):
    return f"""WITH {_GIVEN}, {_looks_sql('g', gain)}
SELECT l_orderkey, l_linenumber, round(m, 12) + 0.0 AS metallic, round(greatest(0.02, ro), 12) + 0.0 AS roughness, round(tr, 12) + 0.0 AS transmission,
  round(1.3 + 0.2 * cl, 12) + 0.0 AS ior, round([v, q, p, p, w, v][k], 12) + 0.0 AS red FROM y"""


def _appearance(spark, sf, gain):
    li, factors, draws = _given(spark, sf)
    looks = SA.add_appearance(li, factors, draws, gain)
    rows = looks.select("l_orderkey", "l_linenumber", "metallic", "roughness", "transmission", "ior", F.col("base_color")[0].alias("red"))
    return rounded(rows, "metallic", "roughness", "transmission", "ior", "red", digits=12)


@query("Y3_appearance_map", _appearance_sql(1.0))
def appearance_map(spark, sf):
    return _appearance(spark, sf, 1.0)


@query("Y3_appearance_map_gain4", _appearance_sql(4.0))
def appearance_map_gain(spark, sf):
    return _appearance(spark, sf, 4.0)


@query("Y4_physics_map", f"""WITH {_GIVEN} SELECT l_orderkey, l_linenumber, round(exp(ln(50) + (ln(8000) - ln(50)) * he), 5) + 0.0 AS density,
round(0.05 + 1.05 * gr, 6) + 0.0 AS friction, round(0.05 + 0.8 * ha, 6) + 0.0 AS restitution FROM g""")
def physics_map(spark, sf):
    li, factors, _ = _given(spark, sf)
    phys = SA.physics_map(factors)
    return rounded(li.select("l_orderkey", "l_linenumber", r6(phys["density"], 5).alias("density"), phys["friction"].alias("friction"),
                             phys["restitution"].alias("restitution")), "friction", "restitution")


# ---------------------------------------------------------------- seeded sampling
def _draws_sql(seed, key, noise=SA.APPEARANCE_NOISE):
    n = {a: f"{gaussian_sql(seed, 'noise/' + c, key)} * {noise}::DOUBLE"
         for a, c in (("nm", "metallic"), ("nr", "roughness"), ("nt", "transmission"), ("nv", "value"))}
    return ", ".join(f"{e} AS {a}" for a, e in n.items()) + f", {uniform_sql(seed, 'hue', key)} AS hue, {uniform_sql(seed, 'saturation', key)} AS us"


def _factors_sql(seed, key):
    return (f"{uniform_sql(seed, 'heaviness', key)} AS fh, {uniform_sql(seed, 'grip', key)} AS fg, {uniform_sql(seed, 'hardness', key)} AS fa, "
            f"pow({uniform_sql(seed, 'clarity', key)}, 3) AS fc")


def _seen_sql(seed, key, alpha):
    names = (("fh", "he", "heaviness"), ("fg", "gr", "grip"), ("fa", "ha", "hardness"))
    mix = lambda f, n: f if alpha >= 1.0 else f"{f} * {alpha}::DOUBLE + {uniform_sql(seed, 'decoy/' + n, key)} * {1.0 - alpha}::DOUBLE"
    return ", ".join(f"{mix(f, n)} AS {a}" for f, a, n in names) + ", fc AS cl"


_PHYSICS = """exp(ln(50) + (ln(8000) - ln(50)) * fh) AS density, 0.05 + 1.05 * fg AS friction, 0.05 + 0.8 * fa AS restitution"""
_FACTOR_COLUMNS = ("heaviness", "grip", "hardness", "clarity", "density", "friction", "restitution", "metallic", "roughness", "transmission", "ior")
_SAMPLE_SELECT = f"""round(fh, 6) + 0.0 AS heaviness, round(fg, 6) + 0.0 AS grip, round(fa, 6) + 0.0 AS hardness, round(fc, 6) + 0.0 AS clarity,
  round(density, 5) + 0.0 AS density, round(friction, 6) + 0.0 AS friction, round(restitution, 6) + 0.0 AS restitution, round(m, 6) + 0.0 AS metallic,
  round(greatest(0.02, ro), 6) + 0.0 AS roughness, round(tr, 6) + 0.0 AS transmission, round(1.3 + 0.2 * cl, 6) + 0.0 AS ior, round([v, q, p, p, w, v][k], 6) + 0.0 AS red"""


def _sample_sql(seed, table_, key, alpha=1.0, gain=1.0):
    return f"""f0 AS (SELECT {key}, {_factors_sql(seed, key)} FROM {table_}),
g0 AS (SELECT *, {_seen_sql(seed, key, alpha)}, {_PHYSICS}, {_draws_sql(seed, key)} FROM f0), {_looks_sql('g0', gain)}"""


def _sample_columns(df, *keys):
    out = df.select(*keys, *_FACTOR_COLUMNS, F.col("base_color")[0].alias("red"))
    return rounded(out, *[c for c in _FACTOR_COLUMNS if c != "density"], "red").withColumn("density", r6("density", 5))


@query("Y1_sample_material", f"WITH {_sample_sql(1, 'orders', 'o_orderkey')} SELECT o_orderkey, {_SAMPLE_SELECT} FROM y")
def sample_material(spark, sf):
    return _sample_columns(SA.sample_material(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", seed=1), "o_orderkey")


@query("Y1_nearest_anchor", f"""WITH {_sample_sql(1, 'orders', 'o_orderkey')}, {_MATERIALS_SQL},
c AS (SELECT o_orderkey, name, pow(y.density / 8000 - mats.density / 8000, 2) + pow(y.friction / 1.5 - mats.friction / 1.5, 2) + pow(y.restitution - mats.restitution, 2) AS d FROM y, mats)
SELECT o_orderkey, arg_min(name, d) AS nearest_anchor FROM c GROUP BY 1""")
def sampled_anchor(spark, sf):
    return SA.sample_material(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", seed=1).select("o_orderkey", "nearest_anchor")


def _jitter_sql(center, factor):
    return _clip(f"{center} + ({uniform_sql(2, 'jitter/' + factor, 'p_partkey')} * 2 - 1) * 0.15::DOUBLE")


@query("Y2_sample_near", f"""WITH {_MATERIALS_SQL}, n0 AS (SELECT p_partkey, {_pick_sql([m[0] for m in K.MATERIALS], 'p_size')} AS name FROM part),
f0 AS (SELECT p_partkey, {_jitter_sql('(ln(density) - ln(50)) / (ln(8000) - ln(50))', 'heaviness')} AS fh, {_jitter_sql('(friction - 0.05) / (1.10 - 0.05)', 'grip')} AS fg,
  {_jitter_sql('(restitution - 0.05) / (0.85 - 0.05)', 'hardness')} AS fa, {_jitter_sql('transmission', 'clarity')} AS fc FROM n0 JOIN mats USING (name)),
g0 AS (SELECT *, fh AS he, fg AS gr, fa AS ha, fc AS cl, {_PHYSICS}, {_draws_sql(2, 'p_partkey')} FROM f0), {_looks_sql('g0', 1.0)} SELECT p_partkey, {_SAMPLE_SELECT} FROM y""")
def sample_near(spark, sf):
    names = F.array(*[F.lit(m[0]) for m in K.MATERIALS])
    p = table(spark, sf, "part").select("p_partkey", F.element_at(names, (F.col("p_size") % 10 + 1).cast("int")).alias("anchor"))
    return _sample_columns(SA.sample_near(p, "anchor", "p_partkey", seed=2), "p_partkey")


_DIALS = ((0.0, 1.0), (0.5, 1.0), (1.0, 1.0), (1.0, 8.0))


def _dial_sql(alpha, gain):
    return f"""SELECT {alpha}::DOUBLE AS alpha, {gain}::DOUBLE AS gain, round(corr(m, fh), 6) + 0.0 AS r FROM
(WITH {_sample_sql(1, 'orders', 'o_orderkey', alpha, gain)} SELECT m, fh FROM y)"""


@query("Y5_coupling_dial", " UNION ALL ".join(_dial_sql(*d) for d in _DIALS))
def coupling_dial(spark, sf):
    """Measured coupling of metallic and heaviness over the orders at four dial settings."""
    o = table(spark, sf, "orders").select("o_orderkey")
    rows = None
    for alpha, gain in _DIALS:
        one = SA.coupling(SA.sample_material(o, "o_orderkey", seed=1, alpha=alpha, gain=gain), "metallic", "heaviness")
        one = one.select(F.lit(alpha).alias("alpha"), F.lit(gain).alias("gain"), r6("r").alias("r"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query("Y6_matched_arms", "SELECT count(*) AS n_scenes, 0::BIGINT AS n_mismatched FROM orders")
def matched_arms(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey")
    arms = None
    for arm, dials in (("ctrl", {"alpha": 0.0}), ("base", {}), ("loud", {"gain": 8.0})):
        one = SA.sample_material(o, "o_orderkey", seed=1, **dials).withColumn("arm", F.lit(arm))
        arms = one if arms is None else arms.unionByName(one)
    return VD.physics_matched(arms, "arm", ["o_orderkey"], list(K.ESSENCE_FIELDS))


@query("Y7_jittered_actions", f"""WITH r AS (SELECT p_partkey, i::INT AS rep FROM part, range(1, 9) t(i))
SELECT p_partkey, rep, round(1.5 * (1 + {gaussian_sql(3, 'impulse', 'p_partkey', 'rep')} * 0.03), 6) + 0.0 AS impulse,
round({gaussian_sql(3, 'azimuth', 'p_partkey', 'rep')} * 2, 6) + 0.0 AS azimuth_deg FROM r""")
def jittered_actions(spark, sf):
    pushes = table(spark, sf, "part").select("p_partkey", F.lit(K.PUSH_IMPULSE).alias("impulse"), F.lit(K.PUSH_AZIMUTH_DEG).alias("azimuth_deg"))
    return rounded(SA.jittered_actions(pushes, 8, "p_partkey", seed=3), "impulse", "azimuth_deg")


@query("Y8_directions", f"""WITH g AS (SELECT vec_id, {gaussian_sql(4, 'direction', 'vec_id', 'd', 'i')} AS v FROM embeddings, range(48) a(d), range(32) b(i))
SELECT vec_id, round(avg(v), 6) + 0.0 AS mean, round(stddev_pop(v), 6) + 0.0 AS sd, count(*) AS n FROM g GROUP BY vec_id""")
def directions(spark, sf):
    """Moments of 48 Gaussian directions per embedding row."""
    d = SA.gaussian_directions(table(spark, sf, "embeddings"), "vec_id", 32, K.N_DIRECTIONS, 4)
    rows = d.select("vec_id", F.explode("values").alias("v")).groupBy("vec_id").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"),
                                                                            F.count("v").alias("n"))
    return rounded(rows, "mean", "sd")


_SHAPES = [s[0] for s in K.SHAPE_GEOMETRY]


@query("X9_assign_scenes", f"""WITH {_sample_sql(5, 'orders', 'o_orderkey')}, l AS (SELECT o_orderkey, floor({uniform_sql(5, 'shape', 'o_orderkey')} * 6)::INT AS i,
CASE WHEN density / 8000 BETWEEN 0.55 AND 1.01 AND restitution BETWEEN 0.60 AND 0.90 THEN 'test' ELSE 'train' END AS split FROM y)
SELECT o_orderkey, printf('%s_%06d', split, o_orderkey) AS scene_id, split, {_pick_sql(_SHAPES, 'i')} AS shape FROM l""")
def assign_scenes(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey")
    out = SA.assign_scenes(o, "o_orderkey", _SHAPES, K.REGION_PRESETS["extrapolation"], seed=5)
    return out.select("o_orderkey", "scene_id", "split", "shape")
