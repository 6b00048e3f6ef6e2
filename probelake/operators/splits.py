"""Leakage-aware train/test splits.

All random choices are md5 orders of (seed, key): the same rows go to test whatever the partitioning.
Cut points of those orders are found with bounded histograms (``ranking.seeded_cuts``), after which the
label is a row-local comparison: no split sorts or shuffles the data it labels.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probelake import constants as K
from probelake.functions.hashing import below, shuffle_key
from probelake.functions.scalars import col, scene_key
from probelake.operators.ranking import seeded_cuts, seeded_rank
from probelake.session import small


def bankers_round(x: float) -> int:
    """Half to even, as the sizes of all splits are defined."""
    return round(x)


# ---------------------------------------------------------------- regions
def in_region(box: Mapping[str, tuple[float, float]], essence: Mapping[str, Column | str],
              shape=None, shapes: Sequence[str] = ()) -> Column:
    """inclusive box on normalized axes and an optional shape list; an unconstrained box holds nothing."""
    axes = {k: v for k, v in box.items() if v is not None}
    if not axes:
        return F.lit(False)
    inside = F.lit(True)
    for axis, (lo, hi) in axes.items():
        inside = inside & col(essence[axis]).between(lo, hi)
    if shapes:
        inside = inside & col(shape).isin(*shapes)
    return inside


def region_label(box, essence, shape=None, shapes=()) -> Column:
    """test inside the box, train outside."""
    return F.when(in_region(box, essence, shape, shapes), "test").otherwise("train")


def region_split(df: DataFrame, preset: str, essence: Mapping[str, Column | str]) -> DataFrame:
    """Label every row by a preset region."""
    return df.withColumn("split", region_label(K.REGION_PRESETS[preset], essence))


# ---------------------------------------------------------------- combination grid
def full_grid(shapes: DataFrame, materials: DataFrame, n_materials: int) -> DataFrame:
    """Every (shape, material) pair, as an equi-join on the material ordinal.

    ``shapes`` and ``materials`` carry 1-based ordinals ``s_rank`` / ``m_rank``.
    """
    spread = shapes.withColumn("m_rank", F.explode(F.expr(f"sequence(1L, {int(n_materials)}L)")))
    return spread.join(small(materials), "m_rank")


def combination_split(df: DataFrame, shape: str, material: str, frac: float = 0.2, seed: int = 0) -> DataFrame:
    """Hold out about ``frac`` of the shape x material grid; every shape and material stays in train.

    A minimum edge cover of the grid (each rank of the longer side paired with its rank modulo the
    shorter side) is protected; the first ``round(grid * frac)`` other pairs in seeded order are held out.
    """
    if not 0.0 <= frac < 1.0:
        raise ValueError("frac must be in [0, 1)")
    shapes = df.select(col(shape).alias("shape")).where("shape is not null").distinct()
    materials = df.select(col(material).alias("material")).where("material is not null").distinct()
    n_s, n_m = shapes.count(), materials.count()
    if not n_s or not n_m:
        raise ValueError("need at least one shape and one material")
    s = seeded_rank(shapes, seed, "shape", out="s_rank")
    m = seeded_rank(materials, seed, "material", out="m_rank")
    grid = full_grid(s, m, n_m)
    i, j = F.col("s_rank") - 1, F.col("m_rank") - 1
    cover = (j % n_s == i) if n_m >= n_s else (i % n_m == j)
    grid = grid.withColumn("protected", cover).withColumn("_h", shuffle_key(seed, "shape", "material"))
    n_hold = min(bankers_round(n_s * n_m * frac), n_s * n_m - max(n_s, n_m))
    free = grid.where(~F.col("protected"))
    cut = seeded_cuts(free, [n_hold], F.col("_h")).get(n_hold) if n_hold > 0 else None
    held = (~F.col("protected") & (F.col("_h") <= cut)) if cut else F.lit(False)
    return grid.select("shape", "material", F.when(held, "test").otherwise("train").alias("split"))


# ---------------------------------------------------------------- objects and categories
def _hold_first(keys: DataFrame, key: str, n_test: int, seed: int) -> Column:
    """True for the first ``n_test`` distinct keys of the seeded order."""
    h = shuffle_key(seed, key)
    if n_test <= 0:
        return F.lit(False)
    return h <= seeded_cuts(keys.select(key), [n_test], h)[n_test]


def object_split(df: DataFrame, object_id: str, frac: float = 0.2, seed: int = 0) -> DataFrame:
    """A seeded share of the distinct ids goes to test, never all of them."""
    return _share_split(df, object_id, frac, seed)


def _share_split(df: DataFrame, key: str, frac: float, seed: int) -> DataFrame:
    keys = df.select(key).distinct()
    total = keys.count()
    if total == 0:
        raise ValueError(f"nothing to split: no {key}")
    held = _hold_first(keys, key, min(bankers_round(total * frac), total - 1), seed)
    return df.withColumn("split", F.when(held, "test").otherwise("train"))


def category_split(df: DataFrame, category: str, held: Sequence[str] | None = None, frac: float = 0.2,
                   seed: int = 0) -> DataFrame:
    """Whole categories go to test: the named ones, or a seeded share; at least one stays in train."""
    if held is None:
        return _share_split(df, category, frac, seed)
    names = df.select(category).distinct()
    listed = F.col(category).isin(*held) if held else F.lit(False)
    counts = names.agg(F.count(F.lit(1)).alias("all"), F.count_if(listed).alias("listed"), F.max(F.when(listed, F.col(category))).alias("last")).first()
    if not counts["all"]:
        raise ValueError(f"nothing to split: no {category}")
    if counts["listed"] == counts["all"]:  # the last name of the list's order stays in train
        listed = listed & (F.col(category) != counts["last"])
    return df.withColumn("split", F.when(listed, "test").otherwise("train"))


def plan_split(df: DataFrame, object_id: str, category: str, holdout_categories: Sequence[str] = (), frac: float = 0.2,
               seed: int = 0, kind: str = "auto") -> DataFrame:
    """By category when categories are named, asked for or told apart by the data; else by object."""
    ways = ("auto", "category", "object")
    if kind not in ways:
        raise ValueError(f"unknown kind of split {kind!r}, one of {', '.join(ways)}")
    named = sorted({c.strip().lower() for c in holdout_categories} - {""})
    if kind != "object" and named:
        return category_split(df, category, named)
    by_category = kind == "category"
    if kind == "auto":
        by_category = df.where(F.col(category) != "unknown").select(category).distinct().limit(2).count() == 2
    return _share_split(df, category if by_category else object_id, frac, seed)


def iid_split(df: DataFrame, key: str, frac: float = 0.8, seed: int = 0) -> DataFrame:
    """A seeded ``frac`` of the given (train) rows is fit, the rest evaluated."""
    n = df.count()
    n_fit = int(frac * n)
    h = shuffle_key(seed, key)
    fit = h <= seeded_cuts(df, [n_fit], h)[n_fit] if n_fit else F.lit(False)
    return df.withColumn("split", F.when(fit, "train").otherwise("test"))


def kfold(df: DataFrame, key: str, k: int, seed: int = 0, fold: str = "fold") -> DataFrame:
    """K nearly equal folds; the first n % k folds hold one row more."""
    n = df.count()
    sizes = [n // k + (1 if f < n % k else 0) for f in range(k)]
    ends, total = [], 0
    for size in sizes[:-1]:
        total += size
        ends.append(total)
    h = shuffle_key(seed, key)
    cuts = seeded_cuts(df, ends, h)
    label = F.lit(k - 1)
    for f in reversed(range(k - 1)):
        if ends[f] in cuts:
            label = F.when(h <= cuts[ends[f]], f).otherwise(label)
    return df.withColumn(fold, label)


# ---------------------------------------------------------------- scene assignments
def assign_scene_materials(slots: DataFrame, slot: str, pairs: DataFrame, seed: int = 0) -> DataFrame:
    """Give every slot (0-based ordinal ``slot``) a train or test pair, in proportion to the pair counts.

    Drawn with replacement: a keyed hash picks a pair ordinal, joined on that ordinal.
    """
    counts = {r["split"]: r["count"] for r in pairs.groupBy("split").count().collect()}
    n_train, n_test = counts.get("train", 0), counts.get("test", 0)
    if not n_train:
        raise ValueError("no pair is left to train on")
    n = slots.count()
    n_test_slots = bankers_round(n * n_test / (n_train + n_test)) if n_test else 0
    n_train_slots = n - n_test_slots
    ranked = seeded_rank(pairs.where("split = 'train'"), 0, "shape", "material", out="_o").unionByName(
        seeded_rank(pairs.where("split = 'test'"), 0, "shape", "material", out="_o"))
    is_train = F.col(slot) < n_train_slots
    drawn = slots.select(
        F.col(slot),
        F.when(is_train, "train").otherwise("test").alias("split"),
        F.when(is_train, F.col(slot)).otherwise(F.col(slot) - n_train_slots).alias("_i"),
    ).withColumn("_o", below(F.when(F.col("split") == "train", F.lit(n_train)).otherwise(F.lit(max(n_test, 1))),
                             seed, "pair", "split", "_i") + 1)
    return drawn.join(small(ranked), ["split", "_o"]).select(
        scene_key("split", "_i").alias("scene_id"), "shape", "material", "split")


def split_summary(df: DataFrame, split: str = "split", **distinct: str) -> DataFrame:
    """Rows per split and distinct counts of the named columns."""
    return df.agg(
        F.count_if(F.col(split) == "train").alias("n_train"), F.count_if(F.col(split) == "test").alias("n_test"),
        *[F.countDistinct(c).alias(f"n_{name}") for name, c in distinct.items()])


def overlap(df: DataFrame, key: Sequence[str], split: str = "split") -> DataFrame:
    """U4: keys present in both train and test (empty when the split is honest)."""
    return df.groupBy(*key).agg(F.count_if(F.col(split) == "train").alias("_a"),
                                F.count_if(F.col(split) == "test").alias("_b")).where("_a > 0 and _b > 0").select(*key)


def batches(df: DataFrame, key: Sequence[str], size: int, seed: int | None = None, drop_last: bool = False,
            out: str = "batch") -> DataFrame:
    """Deterministic batch numbers over the seeded order of the key."""
    if size < 1:
        raise ValueError("batch size must be positive")
    ranked = seeded_rank(df, 0 if seed is None else seed, *key, out="_rank")
    numbered = ranked.withColumn(out, F.floor((F.col("_rank") - 1) / size).cast("bigint")).drop("_rank")
    if drop_last:
        full = df.count() // size
        numbered = numbered.where(F.col(out) < full)
    return numbered
