"""Targets and features: the fixed behavior/essence/appearance/factor vectors and feature builders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probelake import constants as K
from probelake.functions.scalars import col


def outcome_vector(outcome=None, normalize: bool = False) -> list[Column]:
    """The seven outcome fields as doubles, optionally divided by their normalizers."""
    get = (lambda f: F.col(f)) if outcome is None else (lambda f: col(outcome)[f])
    scale = lambda f: K.OUTCOME_NORMALIZERS[f] if normalize else 1.0
    return [(get(f).cast("double") / scale(f)).alias(f) for f in K.OUTCOME_FIELDS]


def behavior_field_names(sep: str = ".") -> list[str]:
    """Names of the 21 behavior entries."""
    return [f"{p}{sep}{f}" for p in K.PROBE_ORDER for f in K.OUTCOME_FIELDS]


def behavior_vector(outcomes: DataFrame, keys: Sequence[str], order: str, probe: str = "probe", normalize: bool = True) -> DataFrame:
    """One row per scene with 21 columns ``probe_field``; missing probes are zeros, the last duplicate under ``order`` wins.

    A conditional aggregate: partial sums leave the map side already folded to one row per scene.
    """
    aggs = []
    for p in K.PROBE_ORDER:
        for f in K.OUTCOME_FIELDS:
            hit = F.col(probe) == p
            scale = K.OUTCOME_NORMALIZERS[f] if normalize else 1.0
            value = F.max_by(f, F.when(hit, F.col(order)))
            aggs.append((F.coalesce(value.cast("double"), F.lit(0.0)) / scale).alias(f"{p}_{f}"))
    return outcomes.groupBy(*keys).agg(*aggs)


def behavior_target(probes, normalize: bool = True) -> Column:
    """21-entry behavior array straight from a scene's probe list, without an explode."""
    def block(kind):
        last = F.element_at(F.filter(col(probes), lambda p: p["probe"] == kind), -1)
        found = F.size(F.filter(col(probes), lambda p: p["probe"] == kind)) > 0
        scale = lambda f: K.OUTCOME_NORMALIZERS[f] if normalize else 1.0
        values = [F.coalesce(F.when(found, last["outcome"][f].cast("double") / scale(f)), F.lit(0.0))
                  for f in K.OUTCOME_FIELDS]
        return F.array(*values)
    return F.concat(*[block(k) for k in K.PROBE_ORDER])


def essence_target(normalized) -> Column:
    """Normalized physics as an array, missing channels 0."""
    return F.array(*[F.coalesce(col(normalized)[f], F.lit(0.0)) for f in K.ESSENCE_FIELDS])


def appearance_target(params, shift_ior: bool = True) -> Column:
    """Eight appearance channels; missing color is opaque black; ``shift_ior`` moves ior to about [0, 1]."""
    p = col(params)
    color = F.coalesce(p["base_color"], F.array(*[F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)]))
    ior = F.coalesce(p["ior"], F.lit(1.0))
    rest = [F.coalesce(p[f], F.lit(0.0)) for f in ("roughness", "metallic", "transmission")]
    return F.concat(F.slice(color, 1, 4), F.array(*rest, ior - 1.0 if shift_ior else ior))


def factors_target(factors) -> Column:
    """The four latent factors, null when the scene has none."""
    return F.when(col(factors).isNotNull(), F.array(*[col(factors)[f] for f in K.FACTOR_FIELDS]))


# ---------------------------------------------------------------- features
def one_hot(df: DataFrame, column: str, prefix: str | None = None, max_values: int = 10_000) -> DataFrame:
    """One 0/1 column per distinct value in sorted order (the value list is checked to be small)."""
    values = [r[0] for r in df.select(column).distinct().orderBy(column).limit(max_values + 1).collect()]
    if len(values) > max_values:
        raise ValueError(f"{column} has more than {max_values} values; one-hot needs a category")
    name = prefix or column
    return df.select("*", *[(F.col(column) == v).cast("double").alias(f"{name}_{i}") for i, v in enumerate(values)])


def one_hot_array(df: DataFrame, column: str, out: str, max_values: int = 10_000) -> DataFrame:
    """P18 as one array column."""
    values = [r[0] for r in df.select(column).distinct().orderBy(column).limit(max_values + 1).collect()]
    if len(values) > max_values:
        raise ValueError(f"{column} has more than {max_values} values; one-hot needs a category")
    return df.withColumn(out, F.array(*[(F.col(column) == v).cast("double") for v in values]))


def assemble_features(shape, essence, appearance) -> dict[str, Column]:
    """The four feature sets of an oracle study."""
    s, e, a = col(shape), col(essence), col(appearance)
    return {"shape": s, "essence": e, "shape_appearance": F.concat(s, a), "shape_essence": F.concat(s, e)}


def quadratic_width(d: int) -> int:
    return d * (d + 3) // 2


def quadratic(x, d: int) -> Column:
    """The features and all their pairwise products, squares included; refuses more than 2000 columns."""
    if quadratic_width(d) > K.MAX_QUADRATIC_FEATURES:
        raise ValueError(f"quadratic of {d} columns exceeds {K.MAX_QUADRATIC_FEATURES} features")
    v = col(x)
    products = F.flatten(F.transform(v, lambda a, i: F.transform(F.slice(v, i + 1, F.lit(d)), lambda b: a * b)))
    return F.concat(v, products)


def standardize(df: DataFrame, columns: Sequence[str], fit=None, floor: float = 1e-9) -> DataFrame:
    """P20: (x - mean) / population sd with statistics of the ``fit`` rows; a (near-)constant column divides by 1.

    The statistics are one row; they are read once and folded into the projection as literals.
    """
    rows = df.where(fit) if fit is not None else df
    aggs = [f for c in columns for f in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]
    st = rows.agg(*aggs).first()
    sd = lambda c: st[f"s_{c}"] if st[f"s_{c}"] is not None and st[f"s_{c}"] >= floor else 1.0
    return df.select(*[c for c in df.columns if c not in columns],
                     *[((F.col(c) - st[f"m_{c}"]) / sd(c)).alias(c) for c in columns])


def geometry_features(extents, hull_volume, area, centroid_z, min_z) -> dict[str, Column]:
    """Eight geometry features; extents, hull volume and area on a log10 scale with a 1e-9 floor."""
    e = col(extents)
    s = F.array_sort(e)
    floor = lambda x: F.greatest(x, F.lit(1e-9))
    log = lambda x: F.log10(floor(x))
    return {
        "log_x": log(e[0]), "log_y": log(e[1]), "log_z": log(e[2]),
        "aspect_max": s[2] / floor(s[0]), "aspect_mid": s[1] / floor(s[0]),
        "log_hull_volume": log(col(hull_volume)), "log_area": log(col(area)),
        "centroid_height": (col(centroid_z) - col(min_z)) / floor(e[2]),
    }


def valid_extents(extents) -> Column:
    """Rows with three finite extents, at least one positive; the others are dropped and counted by the caller."""
    finite = F.forall(col(extents), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (F.size(col(extents)) == 3) & finite & (F.array_max(col(extents)) > 0)
