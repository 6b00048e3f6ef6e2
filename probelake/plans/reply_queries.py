"""Language-model evaluation queries: C16-C21, F11, S18, L1."""

from __future__ import annotations

from pyspark.sql import functions as F

from probelake import constants as K
from probelake.functions.scalars import coerce_outcome, fixed
from probelake.operators import replies as RE
from probelake.operators import scoring as SC
from probelake.operators.records import probe_spec
from probelake.plans import standins as ST
from probelake.plans.registry import query, r6, rounded, table
from probelake.plans.stat_queries import TRAIN_MEAN_SQL, _SCALE

OUT = K.OUTCOME_FIELDS

# reply styles by user_id % 6: fenced full / two inline objects / words and text numbers / no JSON /
# broken last fence after a good one / nested and unbalanced braces
_F = {f: f"printf('%.3f', {f})" for f in OUT}
_FULL_SQL = "'{' || " + " || ', ' || ".join(f"'\"{f}\": ' || {_F[f]}" for f in OUT) + " || '}'"


def replies(spark, sf, outcomes=None):
    o = outcomes if outcomes is not None else ST.probe_outcomes(spark, sf)
    num = {f: fixed(f, 3) for f in OUT}
    pairs = []
    for i, f in enumerate(OUT):
        pairs += [F.lit((", " if i else "{") + f'"{f}": '), num[f]]
    full = F.concat(*pairs, F.lit("}"))
    fence = lambda body: F.concat(F.lit("Reasoning first.\n```json\n"), body, F.lit("\n```\nDone."))
    style = F.col("user_id") % 6
    text = (
        F.when(style == 0, fence(full))
        .when(style == 1, F.concat(F.lit('First {"settle_time": 9} then {"settle_time": '), num["settle_time"], F.lit("} end")))
        .when(style == 2, fence(F.concat(F.lit('{"toppled": "Yes", "n_bounces": "'), num["n_bounces"], F.lit('", "unrelated": 1}'))))
        .when(style == 3, F.lit("I cannot tell."))
        .when(style == 4, F.concat(fence(full), F.lit("```{oops}```")))
        .otherwise(F.concat(F.lit("} set {a {b}} {"), F.lit('"toppled": true, "max_height": '), num["max_height"], F.lit("} {open"))))
    return o.select(F.col("user_id").alias("scene_id"), "probe", F.lit("essence").alias("condition"), text.alias("text"))


_REPLIES_SQL = f"""base AS (SELECT user_id, probe, user_id % 6 AS style, {', '.join(f"TRY_CAST({_F[f]} AS DOUBLE) AS {f}" for f in OUT)},
  {_FULL_SQL} AS full_text, printf('%.3f', settle_time) AS st, printf('%.3f', n_bounces) AS nb, printf('%.3f', max_height) AS mh
  FROM probes),
pred AS (SELECT user_id, probe, style,
  CASE WHEN style IN (0, 4) THEN toppled WHEN style IN (2, 5) THEN 1.0::DOUBLE END AS toppled,
  CASE WHEN style IN (0, 1, 4) THEN settle_time END AS settle_time,
  CASE WHEN style IN (0, 4) THEN slid_distance END AS slid_distance,
  CASE WHEN style IN (0, 2, 4) THEN n_bounces END AS n_bounces,
  CASE WHEN style IN (0, 4, 5) THEN max_height END AS max_height,
  CASE WHEN style IN (0, 4) THEN path_length END AS path_length,
  CASE WHEN style IN (0, 4) THEN final_tilt_deg END AS final_tilt_deg FROM base)"""


@query("C17_candidate_jsons", f"""WITH {ST.FRAMES_SQL}, {_REPLIES_SQL}
SELECT user_id AS scene_id, probe, (CASE style WHEN 3 THEN 0 WHEN 0 THEN 1 WHEN 2 THEN 1 ELSE 2 END)::INT AS n,
 CASE style WHEN 0 THEN full_text WHEN 1 THEN '{{"settle_time": ' || st || '}}'
   WHEN 2 THEN '{{"toppled": "Yes", "n_bounces": "' || nb || '", "unrelated": 1}}' WHEN 4 THEN '{{oops}}'
   WHEN 5 THEN '{{"toppled": true, "max_height": ' || mh || '}}' END AS last FROM base""")
def candidate_jsons(spark, sf):
    c = replies(spark, sf).withColumn("c", RE.candidate_jsons("text"))
    return c.select("scene_id", "probe", F.size("c").alias("n"), F.get("c", F.size("c") - 1).alias("last"))


@query("C18_extract_prediction", f"""WITH {ST.FRAMES_SQL}, {_REPLIES_SQL}
SELECT user_id AS scene_id, probe, {', '.join(OUT)} FROM pred""")
def extract_prediction(spark, sf):
    return RE.parse_replies(replies(spark, sf)).select("scene_id", "probe", *[F.col("prediction")[f].alias(f) for f in OUT])


@query("C16_coerce_field", """SELECT event_id, CASE event_type WHEN 'click' THEN 1.0::DOUBLE WHEN 'view' THEN 0.0::DOUBLE
  WHEN 'purchase' THEN value WHEN 'signup' THEN NULL ELSE 'inf'::DOUBLE END AS toppled,
  CASE event_type WHEN 'purchase' THEN value WHEN 'error' THEN 'inf'::DOUBLE END AS n_bounces FROM events""")
def coerce_field(spark, sf):
    t = F.col("event_type")
    text = (F.when(t == "click", " Yes ").when(t == "view", "FALSE").when(t == "purchase", F.col("value").cast("string"))
            .when(t == "signup", "about 3").when(t == "error", "inf"))
    known = t.isin("click", "view", "purchase", "signup", "error")
    toppled = F.when(F.coalesce(known, F.lit(False)), text).otherwise("inf")  # other types and none reply to this field only
    return table(spark, sf, "events").select(
        "event_id", coerce_outcome("toppled", toppled).alias("toppled"), coerce_outcome("n_bounces", text).alias("n_bounces"))


SHAPES = tuple(s[0] for s in K.SHAPE_GEOMETRY)


def prompt_scenes(spark, sf):
    """Scenes from ``part``: a shape, raw physics and appearance read off its columns, one condition each."""
    s, k = F.col("p_size"), F.col("p_partkey")
    raw = F.struct((F.col("p_retailprice") * 2.5).alias("density"), (s / 50.0).alias("friction"), (s / 64.0).alias("restitution"))
    looks = F.struct(
        F.array(s / 64.0, s / 128.0, s / 256.0, F.lit(1.0)).alias("base_color"), (s / 50.0).alias("roughness"),
        (s / 80.0).alias("metallic"), (s / 100.0).alias("transmission"), (F.lit(1.0) + s / 100.0).alias("ior"))
    return table(spark, sf, "part").select(
        k.alias("scene_id"), F.element_at(F.array(*[F.lit(x) for x in SHAPES]), (k % 6 + 1).cast("int")).alias("shape"),
        F.element_at(F.array(*[F.lit(x) for x in K.CONDITIONS]), (k % 3 + 1).cast("int")).alias("condition"),
        F.element_at(F.array(*[F.lit(x) for x in K.PROBE_ORDER]), (s % 3 + 1).cast("int")).alias("probe"),
        raw.alias("raw"), looks.alias("looks"),
        probe_spec(height=F.when(s % 2 == 0, s / 50.0), angle_deg=F.when(s % 2 == 0, s * 1.0),
                   impulse=F.when(s % 2 == 0, s / 10.0), height_frac=F.when(s % 2 == 0, s / 100.0)).alias("spec"))


def _quote(text):
    return "'" + text.replace("'", "''") + "'"


_SHAPE_SQL = "CASE k % 6 " + " ".join(
    f"WHEN {i} THEN " + _quote(f"a solid rigid {n} (MuJoCo '{g}' geom, size attribute \"{z}\" in meters — half-extents/radii "
                               f"per MuJoCo conventions; half-height {h} m)")
    for i, (n, g, z, h) in enumerate(K.SHAPE_GEOMETRY)) + " END"
_PROMPT_SQL = f"""q AS (SELECT p_partkey AS k, p_size AS s, p_retailprice * 2.5::DOUBLE AS d FROM part),
texts AS (SELECT k, s, 'Object: ' || {_SHAPE_SQL} || ', initially at rest.' || chr(10) || CASE k % 3
  WHEN 0 THEN 'Material (ground truth): density ' || printf('%.1f', d) || ' kg/m^3, sliding friction coefficient '
    || printf('%.3f', s / 50.0::DOUBLE) || ', restitution coefficient ' || printf('%.3f', s / 64.0::DOUBLE) || '.'
  WHEN 1 THEN 'Material: unknown — you only see its rendered appearance: base color RGBA (' || printf('%.2f', s / 64.0::DOUBLE) || ', '
    || printf('%.2f', s / 128.0::DOUBLE) || ', ' || printf('%.2f', s / 256.0::DOUBLE) || ', 1.00), roughness '
    || printf('%.2f', s / 50.0::DOUBLE) || ', metallic ' || printf('%.2f', s / 80.0::DOUBLE) || ', transmission '
    || printf('%.2f', s / 100.0::DOUBLE) || ', ior ' || printf('%.2f', 1.0::DOUBLE + s / 100.0::DOUBLE)
    || '. Infer plausible physical properties from this appearance first.'
  ELSE 'Material: unknown — the 4 attached images are rendered views of this exact object from different camera angles. Infer plausible physical properties (density, friction, restitution) from its visual appearance first.'
  END AS state,
  CASE s % 3 WHEN 0 THEN 'Action (drop): the object is released from rest with its center '
      || CASE WHEN s % 2 = 0 THEN (s / 50.0::DOUBLE)::VARCHAR ELSE '0.6' END || ' m above its resting height, and falls onto the flat ground.'
    WHEN 1 THEN 'Action (tilt): the ground plane is inclined ' || CASE WHEN s % 2 = 0 THEN (s * 1.0::DOUBLE)::VARCHAR ELSE '20.0' END
      || ' degrees; the object is released from rest just above the incline (0.05 m) and may slide, roll, or stay put.'
    ELSE 'Action (push): after the object settles on flat ground for 0.4 s, a horizontal impulse of '
      || CASE WHEN s % 2 = 0 THEN (s / 10.0::DOUBLE)::VARCHAR ELSE '1.5' END || ' N*s is delivered over 0.1 s at '
      || CASE WHEN s % 2 = 0 THEN s::VARCHAR ELSE '80' END
      || '% of the object''s height (above center height, so it also applies a tipping torque).' END AS action FROM q)"""


def prompts(spark, sf):
    return prompt_scenes(spark, sf).withColumn("state", RE.state_text("condition", "shape", "raw", "looks", 4)).withColumn(
        "action", RE.action_text("probe", "spec"))


@query("C19_state_text", f"WITH {_PROMPT_SQL} SELECT k AS scene_id, state FROM texts")
def state_text(spark, sf):
    return prompts(spark, sf).select("scene_id", "state")


@query("C20_action_text", f"WITH {_PROMPT_SQL} SELECT k AS scene_id, action FROM texts")
def action_text(spark, sf):
    return prompts(spark, sf).select("scene_id", "action")


@query("C21_messages", f"""WITH {_PROMPT_SQL} SELECT k AS scene_id, md5({_quote(K.SYSTEM_PROMPT)}) AS system,
state || chr(10) || chr(10) || action || chr(10) || chr(10) || 'Predict the outcome fields.' AS user_text,
(CASE WHEN k % 3 = 2 THEN 4 ELSE 0 END)::INT AS n_images FROM texts""")
def messages(spark, sf):
    pics = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.format_string("view_%03d.png", i))
    m = prompts(spark, sf).withColumn("m", RE.build_messages("condition", "state", "action", pics))
    return m.select("scene_id", F.md5(F.col("m")[0]["text"]).alias("system"), F.col("m")[1]["text"].alias("user_text"),
                    F.size(F.col("m")[1]["images"]).alias("n_images"))


@query("F11_known_probe", f"""WITH {ST.FRAMES_SQL} SELECT user_id, probe FROM probes""")
def known_probe(spark, sf):
    o = ST.outcomes(spark, sf).withColumn("probe", F.coalesce(ST.probe_kind(), F.col("event_type")))
    return RE.known_probes(o).select("user_id", "probe")


@query("S18_pending_requests", """WITH r AS (SELECT o_orderkey AS scene_id, o_orderpriority AS probe, c AS condition FROM orders,
(VALUES ('essence'), ('appearance')) v(c)) SELECT scene_id, probe, condition FROM r
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = scene_id AND l_linenumber = 1 AND condition = 'essence')""")
def pending(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("scene_id"), F.col("o_orderpriority").alias("probe"))
    requests = RE.build_requests(o)
    answered = table(spark, sf, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("scene_id")).withColumn(
        "condition", F.lit("essence"))
    return RE.pending_requests(requests, answered, ["scene_id", "condition"]).select("scene_id", "probe", "condition")


@query("L1_reply_report", f"""WITH {ST.FRAMES_SQL}, {TRAIN_MEAN_SQL}, {_REPLIES_SQL},
pl AS (SELECT user_id, probe, unnest({list(OUT)}) AS field, unnest([{', '.join(OUT)}]) AS pred FROM pred),
e AS (SELECT l.user_id, l.probe, l.field, truth, train_mean, pred, {_SCALE.replace('field', 'l.field')} AS scale
  FROM longo l JOIN tm ON l.probe = tm.probe AND l.field = tm.field
  JOIN pl ON pl.user_id = l.user_id AND pl.probe = l.probe AND pl.field = l.field WHERE l.user_id % 2 = 1),
q AS (SELECT *, pow((coalesce(pred, train_mean) - truth) / scale, 2) AS err, pow((train_mean - truth) / scale, 2) AS base,
  CASE WHEN probe = 'push' AND field = 'toppled' THEN pow(least(1.0, greatest(0.0, coalesce(pred, train_mean))) - truth, 2) END
  AS br FROM e)
SELECT probe, field, count(*) FILTER (field = 'toppled') AS n_rows,
  count(*) FILTER (field = 'toppled' AND user_id % 6 = 3) AS n_parse_failures, count(*) FILTER (pred IS NULL) AS n_imputed_fields,
  round(avg(err), 5) + 0.0 AS mse, round(avg(base), 5) + 0.0 AS baseline_mse, round(avg(br), 5) + 0.0 AS push_toppled_brier
FROM q GROUP BY ROLLUP (probe, field)""")
def reply_report(spark, sf):
    o = ST.probe_outcomes(spark, sf)
    odd = o.where("user_id % 2 = 1")
    truth = odd.select(F.col("user_id").alias("scene_id"), "probe", F.struct(*OUT).alias("truth"))
    out = RE.evaluate_replies(replies(spark, sf, odd), truth, o.where("user_id % 2 = 0"), "essence").drop("gain_over_mean")
    return rounded(out, "mse", "baseline_mse", "push_toppled_brier", digits=5)
