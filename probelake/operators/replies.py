"""Language-model evaluation: request texts, response cache, reply parsing, report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probelake import constants as K
from probelake.functions.scalars import coerce_outcome, col, fixed
from probelake.operators.scoring import score_predictions, train_mean_outcomes


# ---------------------------------------------------------------- request texts
# The sentences of shape_text, state_text, action_text and build_messages must match to the letter.
def shape_text(shape) -> Column:
    """Geometry sentence of a shape; an unknown shape is an error."""
    out = None
    for name, kind, size, half in K.SHAPE_GEOMETRY:
        text = (f"a solid rigid {name} (MuJoCo '{kind}' geom, size attribute \"{size}\" in meters — "
                f"half-extents/radii per MuJoCo conventions; half-height {half} m)")
        out = F.when(col(shape) == name, text) if out is None else out.when(col(shape) == name, text)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown shape "), F.coalesce(col(shape), F.lit("null")))).cast("string"))


def state_text(condition, shape, raw, appearance, n_images=0) -> Column:
    """Object line and what the condition reveals about the material; unknown conditions are an error."""
    r, a = col(raw), col(appearance)
    color = a["base_color"]
    images = F.lit(n_images) if isinstance(n_images, int) else col(n_images)
    essence = F.concat(
        F.lit("Material (ground truth): density "), fixed(r["density"], 1), F.lit(" kg/m^3, sliding friction coefficient "),
        fixed(r["friction"], 3), F.lit(", restitution coefficient "), fixed(r["restitution"], 3), F.lit("."))
    looks = F.concat(
        F.lit("Material: unknown — you only see its rendered appearance: base color RGBA ("),
        F.concat_ws(", ", *[fixed(color[i], 2) for i in range(4)]), F.lit("), roughness "), fixed(a["roughness"], 2),
        F.lit(", metallic "), fixed(a["metallic"], 2), F.lit(", transmission "), fixed(a["transmission"], 2),
        F.lit(", ior "), fixed(a["ior"], 2), F.lit(". Infer plausible physical properties from this appearance first."))
    seen = F.concat(
        F.lit("Material: unknown — the "), images.cast("string"),
        F.lit(" attached images are rendered views of this exact object from different camera angles. Infer plausible "
              "physical properties (density, friction, restitution) from its visual appearance first."))
    c = col(condition)
    material = (F.when(c == "essence", essence).when(c == "appearance", looks).when(c == "vision", seen)
                .otherwise(F.raise_error(F.concat(F.lit("unknown condition "), F.coalesce(c, F.lit("null")))).cast("string")))
    return F.concat(F.lit("Object: "), shape_text(shape), F.lit(", initially at rest.\n"), material)


def action_text(probe, spec) -> Column:
    """C20: one sentence per probe kind; missing spec fields take their defaults; unknown kinds are an error."""
    s, p = col(spec), col(probe)
    value = lambda field, default: F.coalesce(s[field], F.lit(default)).cast("double").cast("string")
    share = F.concat(fixed(F.coalesce(s["height_frac"], F.lit(K.PUSH_HEIGHT_FRAC)) * 100.0, 0), F.lit("%"))
    drop = F.concat(F.lit("Action (drop): the object is released from rest with its center "), value("height", K.DROP_HEIGHT),
                    F.lit(" m above its resting height, and falls onto the flat ground."))
    tilt = F.concat(F.lit("Action (tilt): the ground plane is inclined "), value("angle_deg", K.TILT_ANGLE_DEG),
                    F.lit(" degrees; the object is released from rest just above the incline (0.05 m) and may slide, roll, "
                          "or stay put."))
    push = F.concat(F.lit("Action (push): after the object settles on flat ground for 0.4 s, a horizontal impulse of "),
                    value("impulse", K.PUSH_IMPULSE), F.lit(" N*s is delivered over 0.1 s at "), share,
                    F.lit(" of the object's height (above center height, so it also applies a tipping torque)."))
    return (F.when(p == "drop", drop).when(p == "tilt", tilt).when(p == "push", push)
            .otherwise(F.raise_error(F.concat(F.lit("unknown probe kind "), F.coalesce(p, F.lit("null")))).cast("string")))


def build_messages(condition, state, action, images=None) -> Column:
    """System and user message; the vision condition carries image URLs and needs at least one."""
    text = F.concat(col(state), F.lit("\n\n"), col(action), F.lit("\n\nPredict the outcome fields."))
    none = F.array().cast("array<string>")
    urls = none if images is None else F.coalesce(col(images), none)
    is_vision = col(condition) == "vision"
    attached = F.when(is_vision & (F.size(urls) == 0), F.raise_error(F.lit("vision condition needs images")).cast("array<string>")
                      ).when(is_vision, urls).otherwise(none)
    message = lambda role, body, pics: F.struct(F.lit(role).alias("role"), body.alias("text"), pics.alias("images"))
    return F.array(message("system", F.lit(K.SYSTEM_PROMPT), none), message("user", text, attached))


def image_urls(views: DataFrame, files: DataFrame, k: int, scene: str = "scene_id") -> DataFrame:
    """The first k views of every scene as base64 data URLs, in view order (at most k images per scene).

    ``views`` has (scene, index, path), ``files`` is a ``binaryFile`` scan.
    """
    wanted = views.where(F.col("index") < k)
    url = F.concat(F.lit("data:image/png;base64,"), F.regexp_replace(F.base64("content"), r"\s", ""))
    urls = wanted.join(files.select("path", url.alias("url")), "path")
    return urls.groupBy(scene).agg(F.transform(F.array_sort(F.collect_list(F.struct("index", "url"))), lambda e: e["url"]).alias("images"))


# ---------------------------------------------------------------- response cache
REQUEST_KEY = ("scene_id", "probe", "condition")


def build_requests(scenes: DataFrame, conditions: Sequence[str] = ("essence", "appearance")) -> DataFrame:
    """One request per (scene, probe, condition): two explodes of short arrays, no join."""
    bad = [c for c in conditions if c not in K.CONDITIONS]
    if bad:
        raise ValueError(f"unknown conditions {bad}")
    return scenes.withColumn("condition", F.explode(F.array(*[F.lit(c) for c in conditions])))


def known_probes(df: DataFrame, probe: str = "probe") -> DataFrame:
    """keep the three probe kinds."""
    return df.where(F.col(probe).isin(*K.PROBE_ORDER))


def pending_requests(requests: DataFrame, cache: DataFrame, key: Sequence[str] = REQUEST_KEY) -> DataFrame:
    """Requests without a cached answer."""
    return requests.join(cache.select(*key), list(key), "left_anti")


# ---------------------------------------------------------------- reply parsing
def brace_spans(text) -> Column:
    """Balanced top-level ``{...}`` spans of a text, found by folding over its braces only."""
    t = col(text)
    pieces = F.regexp_extract_all(t, F.lit(r"(?s)[^{}]*[{}]"), F.lit(0))
    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("start"),
                    F.array().cast("array<string>").alias("spans"))

    def step(s, piece):
        at = s["at"] + F.length(piece)
        opens = piece.endswith("{")
        depth = F.when(opens, s["depth"] + 1).otherwise(F.greatest(s["depth"] - 1, F.lit(0)))
        start = F.when(opens & (s["depth"] == 0), at).otherwise(s["start"])
        closes = ~opens & (s["depth"] == 1)
        spans = F.when(closes, F.concat(s["spans"], F.array(F.substring(t, s["start"], at - s["start"] + 1)))).otherwise(s["spans"])
        return F.struct(depth.alias("depth"), at.alias("at"), start.alias("start"), spans.alias("spans"))

    return F.aggregate(pieces, zero, step, lambda s: s["spans"])


def candidate_jsons(text) -> Column:
    """C17: fenced JSON blocks when there are any, else balanced spans; later ones come later."""
    fenced = F.regexp_extract_all(col(text), F.lit(K.FENCE_PATTERN), F.lit(1))
    return F.when(F.size(fenced) > 0, fenced).otherwise(brace_spans(text))


def extract_prediction(text) -> Column:
    """The last candidate that parses to an object with at least one usable outcome field, else null.

    A candidate is parsed as the single element of an array, so trailing text makes it invalid. The bare words NaN
    and Infinity are numbers; of a repeated key the last value counts (``spark.sql.variant.allowDuplicateKeys``, set
    by ``build_session`` and ``parse_replies``).
    """
    def values(v):
        get = lambda f, kind: F.try_variant_get(v, f"$[0].{f}", kind)
        return F.struct(
            F.try_variant_get(v, "$[1]", "variant").isNull().alias("single"),
            *[get(f, "string").alias(f) for f in K.OUTCOME_FIELDS],
            *[(F.schema_of_variant(get(f, "variant")) == "BOOLEAN").alias(f + "_is_bool") for f in K.OUTCOME_FIELDS])

    def fields(r):
        return F.struct(*[F.when(r["single"], coerce_outcome(f, r[f], r[f + "_is_bool"])).alias(f) for f in K.OUTCOME_FIELDS])

    # one transform per stage, so that every candidate is parsed once and every field read once
    inside = lambda c: F.concat(F.lit("["), c, F.lit("]"))
    words = lambda c: F.regexp_replace(c, r"(?<=[:,\[\s])(-?(?:NaN|Infinity))(?=\s*[,}\]])", '"$1"')
    variants = F.transform(F.reverse(candidate_jsons(text)), lambda c: F.coalesce(F.try_parse_json(inside(c)), F.try_parse_json(inside(words(c)))))
    parsed = F.transform(F.transform(variants, values), fields)
    usable = F.filter(parsed, lambda p: F.coalesce(*[p[f] for f in K.OUTCOME_FIELDS]).isNotNull())
    return F.get(usable, F.lit(0))


def parse_replies(replies: DataFrame, text: str = "text") -> DataFrame:
    """C17-C18 over a replies table: adds ``prediction``."""
    replies.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return replies.withColumn("prediction", extract_prediction(text))


def evaluate_replies(replies: DataFrame, truth: DataFrame, train: DataFrame, condition: str | None = None) -> DataFrame:
    """L1: parse the replies, join them to the true outcomes and score them against the train mean.

    ``truth`` has (scene_id, probe, truth STRUCT); requests without a reply count as parse failures.
    """
    parsed = parse_replies(replies if condition is None else replies.where(F.col("condition") == condition))
    rows = truth.join(parsed.select("scene_id", "probe", "prediction"), ["scene_id", "probe"], "left")
    return score_predictions(rows, train_mean_outcomes(train))
