"""Product listings and object directories: parsing, gates, selection, tallies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probelake import constants as K
from probelake.functions.scalars import col, number_or_null, stripped, weight_to_kg


def parse_listings(listings: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Listings with a model id and a usable weight; category upper-cased, UNKNOWN when absent."""
    label = F.get(F.col("product_type"), F.lit(0))["value"]
    category = F.upper(stripped(F.when(label.isNull() | (label == ""), "UNKNOWN").otherwise(label)))
    parsed = listings.select(
        F.col("3dmodel_id").alias("model_id"), weight_to_kg("item_weight").alias("kg"), category.alias("category"), *keep)
    return parsed.where((F.col("model_id") != "") & F.col("kg").isNotNull())


def first_usable(parsed: DataFrame, order: Sequence[str], key: str = "model_id",
                 values: Sequence[str] = ("kg", "category")) -> DataFrame:
    """A1: the first parsed record of every key, by a map-side combinable aggregate."""
    picked = parsed.groupBy(key).agg(F.min_by(F.struct(*values), F.struct(*order)).alias("_r"))
    return picked.select(key, *[F.col(f"_r.{v}").alias(v) for v in values])


def drop_categories(df: DataFrame, category: str = "category",
                    deny: Sequence[str] = K.DEFORMABLE_CATEGORIES) -> tuple[DataFrame, DataFrame]:
    """rows outside the denied categories, and the rejected rows."""
    hit = F.col(category).isin(*deny)
    return df.where(~hit), df.where(hit)


def density_gate(mass, volume) -> Column:
    """struct (passes, density); an unknown volume passes with no density."""
    density = F.when(col(volume) > 0, F.try_divide(col(mass), col(volume)))
    ok = F.when(density.isNull(), True).otherwise(density.between(K.DENSITY_MIN, K.DENSITY_MAX))
    return F.struct(ok.alias("passes"), density.alias("density"))


def density_lower_bound_gate(mass, hull_volume) -> Column:
    """struct (passes, lower_bound); mass over hull volume only rejects when it is implausibly high."""
    bound = F.when(col(hull_volume) > 0, F.try_divide(col(mass), col(hull_volume)))
    return F.struct((bound.isNull() | (bound <= K.DENSITY_MAX)).alias("passes"), bound.alias("lower_bound"))


def rejection_reason(mass, volume, hull_volume) -> Column:
    """Reason text of the first failed density gate, null when both pass."""
    gate, lower = density_gate(mass, volume), density_lower_bound_gate(mass, hull_volume)
    return (F.when(~gate["passes"], F.concat(F.lit("density_implausible:"), F.format_string("%.1f", gate["density"])))
            .when(col(volume).isNull() & ~lower["passes"],
                  F.concat(F.lit("density_implausible_lb:"), F.format_string("%.1f", lower["lower_bound"]))))


def round_robin_select(df: DataFrame, target: int, cap: int, key: str = "model_id",
                       category: str = "category") -> DataFrame:
    """Rank 0 of every category alphabetically, then rank 1, ... up to ``target`` rows.

    Only ranks up to ``cap`` matter, which Spark turns into a map-side group limit before the shuffle.
    """
    place = F.row_number().over(Window.partitionBy(category).orderBy(key))
    kept = df.withColumn("_place", place).where(F.col("_place") <= min(cap, target))
    return kept.withColumn("rank", F.col("_place") - 1).drop("_place").orderBy("rank", category).limit(target)


def rejection_tally(df: DataFrame, reason: str = "reason", ok_label: str = "prepared") -> DataFrame:
    """Row counts per reason (the text before a colon); accepted rows are counted too."""
    head = F.concat(F.lit("rejected_"), F.substring_index(F.col(reason), ":", 1))
    return df.groupBy(F.coalesce(head, F.lit(ok_label)).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- object directories
def _depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def _ends_with(path: Column, extensions: Sequence[str]) -> Column:
    low = F.lower(path)
    hit = F.lit(False)
    for e in extensions:
        hit = hit | low.endswith(e)
    return hit


def pick_mesh(files: DataFrame) -> DataFrame:
    """The preferred mesh file of every object, else its first file with a mesh extension."""
    p = F.col("rel_path")
    preferred = p == K.PREFERRED_MESH
    rank = F.struct(F.when(preferred, 0).otherwise(1), _depth(p), p)
    usable = preferred | _ends_with(p, K.MESH_EXTENSIONS)
    return files.where(usable).groupBy("object_id").agg(F.min_by("rel_path", rank).alias("mesh_path"))


def pick_texture(files: DataFrame) -> DataFrame:
    """An image whose name hints at a texture, else an image below a texture folder."""
    p = F.col("rel_path")
    name, folder = F.lower(F.substring_index(p, "/", -1)), F.lower(F.regexp_replace(p, "[^/]*$", ""))
    hinted = name.rlike("|".join(K.TEXTURE_HINTS))
    in_folder = folder.contains("texture")
    rank = F.struct(F.when(hinted, 0).otherwise(1), _depth(p), p)
    return files.where(_ends_with(p, K.TEXTURE_EXTENSIONS) & (hinted | in_folder)).groupBy("object_id").agg(
        F.min_by("rel_path", rank).alias("texture_path"))


def _json_mass(content: Column) -> Column:
    out = None
    for key, scale in (("mass_kg", 1.0), ("mass", 1.0), ("mass_grams", 1e-3)):
        text = F.get_json_object(content, f"$.{key}")
        value = number_or_null(text) * scale
        out = F.when(text.isNotNull(), value) if out is None else out.when(text.isNotNull(), value)
    return out


def _by_file(expressions: dict[str, Column]) -> list[Column]:
    """One aggregate per metadata file name: the value its expression gives."""
    return [F.max(F.when(F.col("rel_path") == name, e)).alias(f"_{i}") for i, (name, e) in enumerate(expressions.items())]


def read_mass(files: DataFrame) -> DataFrame:
    """Mass and its source from the first metadata file that yields one; the text stays on its row."""
    c = F.col("content")
    match = lambda pattern: F.regexp_extract(c, pattern, 1).try_cast("double")
    sources = {"model.sdf": match(K.MASS_SDF_PATTERN), **{n: _json_mass(c) for n in K.METADATA_JSON},
               "metadata.pbtxt": match(K.MASS_PBTXT_PATTERN)}
    tags = {"model.sdf": "sdf", **dict.fromkeys(K.METADATA_JSON, "json"), "metadata.pbtxt": "pbtxt"}
    values = [F.col(f"_{i}") for i in range(len(sources))]
    label = F.coalesce(*[F.when(v.isNotNull(), tags[n]) for v, n in zip(values, sources)], F.lit("unknown"))
    return files.groupBy("object_id").agg(*_by_file(sources)).select(
        "object_id", F.coalesce(*values).alias("mass_kg"), label.alias("mass_source"))


def _json_category(content: Column) -> Column:
    out = None
    for key in ("category", "class", "categories"):
        whole, first = F.get_json_object(content, f"$.{key}"), F.get_json_object(content, f"$.{key}[0]")
        value = F.when(whole.startswith("["), first).otherwise(whole)
        out = F.when(whole.isNotNull(), value) if out is None else out.when(whole.isNotNull(), value)
    return F.lower(F.trim(out))


def read_category(files: DataFrame) -> DataFrame:
    """Category text from the first metadata file that names one, else 'unknown'."""
    c = F.col("content")
    sources = {"metadata.pbtxt": F.lower(F.trim(F.nullif(F.regexp_extract(c, K.CATEGORY_PBTXT_PATTERN, 1), F.lit("")))),
               **{n: _json_category(c) for n in K.METADATA_JSON}}
    values = [F.col(f"_{i}") for i in range(len(sources))]
    return files.groupBy("object_id").agg(*_by_file(sources)).select(
        "object_id", F.coalesce(*values, F.lit("unknown")).alias("category"))


def discover_objects(files: DataFrame, max_objects: int | None = None) -> DataFrame:
    """One row per object that has a mesh, with texture, mass and category; optional first-n by id."""
    meta = files.where(F.col("content").isNotNull())
    out = (
        pick_mesh(files)
        .join(pick_texture(files), "object_id", "left")
        .join(read_mass(meta), "object_id", "left")
        .join(read_category(meta), "object_id", "left")
        .withColumn("mass_source", F.coalesce("mass_source", F.lit("unknown")))
        .withColumn("category", F.coalesce("category", F.lit("unknown")))
    )
    return out.orderBy("object_id").limit(max_objects) if max_objects is not None else out
