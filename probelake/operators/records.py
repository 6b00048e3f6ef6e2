"""Record builders: frames, probes, physics blocks, truth blocks, scene records, the material dimension."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from probelake import constants as K
from probelake import schemas as S
from probelake.functions.scalars import col


def doubles(arr) -> Column:
    return F.transform(col(arr), lambda x: x.cast("double"))


def build_frame(index, file, position, look_at) -> Column:
    """Typed camera frame."""
    return F.struct(col(index).cast("int").alias("index"), col(file).alias("file"),
                    doubles(position).alias("position"), doubles(look_at).alias("look_at"))


def _shaped(fields: Mapping[str, Column | None], schema) -> Column:
    """A struct with every field of ``schema``; fields not given are null."""
    return F.struct(*[
        (fields[f.name].cast(f.dataType) if fields.get(f.name) is not None else F.lit(None).cast(f.dataType)).alias(
            f.name)
        for f in schema.fields])


def probe_spec(**fields: Column) -> Column:
    """A probe spec with the union of all kinds' fields, nulls where a kind has none."""
    return _shaped(fields, S.SPEC)


def default_battery() -> Column:
    """P5: the three standard probes of an object, as an array to explode."""
    drop = probe_spec(kind=F.lit("drop"), height=F.lit(K.DROP_HEIGHT))
    tilt = probe_spec(kind=F.lit("tilt"), angle_deg=F.lit(K.TILT_ANGLE_DEG))
    push = probe_spec(kind=F.lit("push"), impulse=F.lit(K.PUSH_IMPULSE), height_frac=F.lit(K.PUSH_HEIGHT_FRAC),
                      azimuth_deg=F.lit(K.PUSH_AZIMUTH_DEG))
    return F.array(drop, tilt, push)


def build_probe_record(spec, outcome, trajectory=None) -> Column:
    """Probe record; an unnamed spec is 'unknown'; the trajectory is kept only on request."""
    keep = col(trajectory) if trajectory is not None else F.lit(None).cast(S.probe(S.D)["trajectory"].dataType)
    return F.struct(F.coalesce(col(spec)["kind"], F.lit("unknown")).alias("probe"), col(spec).alias("spec"),
                    col(outcome).alias("outcome"), keep.alias("trajectory"))


def physics_block(density, friction, restitution, tags=None, mass_kg=None, provenance=None) -> Column:
    """Raw and normalized physics with tags."""
    raw = dict(zip(K.ESSENCE_FIELDS, (col(density), col(friction), col(restitution)), strict=True))
    return F.struct(
        F.struct(*[c.cast("double").alias(n) for n, c in raw.items()]).alias("raw"),
        F.struct(*[(c / K.PHYSICS_NORMALIZERS[n]).alias(n) for n, c in raw.items()]).alias("normalized"),
        (col(tags) if tags is not None else F.array().cast("array<string>")).alias("tags"),
        (col(mass_kg).cast("double") if mass_kg is not None else F.lit(None).cast("double")).alias("mass_kg"),
        (provenance if provenance is not None
         else F.lit(None).cast(S.PHYSICS["provenance"].dataType)).alias("provenance"),
    )


def physics_labels_measured(mass_kg, density=None, friction=None, restitution=None, mass_source="measured") -> Column:
    """Measured mass; unmeasured channels take their prior and say so in ``provenance``."""
    missing = F.lit(None).cast("double")
    d, f, r = (missing if c is None else col(c) for c in (density, friction, restitution))
    source = F.lit(mass_source) if isinstance(mass_source, str) else mass_source
    how = lambda c: F.when(c.isNull(), "assumed").otherwise("measured")
    provenance = F.struct(
        source.alias("mass"), F.when(d.isNull(), "unknown").otherwise("derived").alias("density"),
        how(f).alias("friction"), how(r).alias("restitution"))
    return physics_block(F.coalesce(d, F.lit(0.0)), F.coalesce(f, F.lit(K.ASSUMED_FRICTION)),
                         F.coalesce(r, F.lit(K.ASSUMED_RESTITUTION)), mass_kg=mass_kg, provenance=provenance)


def material_truth(factors, anchor, base_color, roughness, metallic, transmission, ior) -> Column:
    """Hidden factors, nearest anchor and the appearance that was rendered."""
    return F.struct(
        col(factors).alias("factors"), col(anchor).alias("nearest_anchor"),
        F.struct(col(base_color).alias("base_color"), col(roughness).alias("roughness"),
                 col(metallic).alias("metallic"), col(transmission).alias("transmission"),
                 col(ior).alias("ior")).alias("appearance_params"))


def object_truth(object_id, category, mass_kg, mass_source, watertight=None, collision=None) -> Column:
    """P10: analysis-only facts of a catalog object."""
    fields = [col(object_id).alias("object_id"), col(category).alias("category"), col(mass_kg).alias("mass_kg"),
              col(mass_source).alias("mass_source"), F.lit(K.OBJECT_NOTE).alias("note")]
    if watertight is not None:
        fields.append(col(watertight).alias("watertight"))
    if collision is not None:
        fields.append(col(collision).alias("collision"))
    return F.struct(*fields)


# ---------------------------------------------------------------- materials
_MATERIAL_COLUMNS = "name string, base_color array<double>, roughness double, metallic double, density double, " \
                    "friction double, restitution double, transmission double, ior double, tags array<string>"


def materials_dim(spark: SparkSession) -> DataFrame:
    """The ten named materials (fixed size)."""
    rows = [(n, list(c), *rest, list(tags)) for n, c, *rest, tags in K.MATERIALS]
    return spark.createDataFrame(rows, _MATERIAL_COLUMNS).withColumn("specular", F.lit(K.DEFAULT_SPECULAR))


def lookup_material(df: DataFrame, name: str, on_missing: str = "error") -> DataFrame:
    """Attach the named material as struct ``material``; an unknown name is an error listing the known ones."""
    dim = materials_dim(df.sparkSession)
    packed = dim.select(F.col("name").alias(name), F.struct(*dim.columns).alias("material"))
    out = df.join(F.broadcast(packed), name, "left")  # ten rows by definition
    if on_missing == "error":
        known = ", ".join(m[0] for m in K.MATERIALS)
        message = F.concat(F.lit("unknown material "), F.coalesce(F.col(name), F.lit("null")), F.lit(f"; known: {known}"))
        kind = out.schema["material"].dataType
        out = out.withColumn("material", F.when(F.col("material").isNull(), F.raise_error(message).cast(kind)).otherwise(
            F.col("material")))
    return out


def validate_material(df: DataFrame) -> DataFrame:
    """List of violated expectations per row (empty when valid)."""
    unit = [F.when(~F.col(c).between(0.0, 1.0), f"{c} outside [0, 1]")
            for c in ("roughness", "metallic", "specular", "transmission", "restitution")]
    rules = [*unit, F.when(F.col("density") <= 0, "density must be positive"),
             F.when(F.col("friction") < 0, "friction must not be negative"),
             F.when(F.size("base_color") != 4, "base color needs four channels")]
    return df.withColumn("violations", F.filter(F.array(*rules), lambda x: x.isNotNull()))


def nearest_anchor(density, friction, restitution) -> Column:
    """The closest named material in normalized essence space; ties go to the first name.

    The ten anchors are a literal array, so this is one projection and needs no join.
    """
    q = [col(c) / K.PHYSICS_NORMALIZERS[n] for c, n in zip((density, friction, restitution), K.ESSENCE_FIELDS)]
    best = []
    for name, *_, d, f, r, _t, _i, _tags in ((m[0], *m[1:]) for m in K.MATERIALS):
        anchor = [d / K.PHYSICS_NORMALIZERS["density"], f / K.PHYSICS_NORMALIZERS["friction"],
                  r / K.PHYSICS_NORMALIZERS["restitution"]]
        square = sum(((x - a) * (x - a) for x, a in zip(q, anchor)), F.lit(0.0))
        best.append(F.struct(square.alias("d"), F.lit(name).alias("name")))
    return F.array_min(F.array(*best))["name"]


# ---------------------------------------------------------------- scenes
def build_scene_record(df: DataFrame, generator: str, *, physics: str | None = None, material: str | None = None,
                       material_name: str | None = None, material_id: str | None = None, frames: str = "frames",
                       resolution: str = "resolution", probes: str | None = None, truth: str | None = None,
                       trajectory: str | None = None, fps: int = K.DEFAULT_FPS) -> DataFrame:
    """Assemble scene rows from an explicit physics block, a material struct, or a material name."""
    schema = S.scene()
    label = (lambda default: F.coalesce(F.col(material_id), F.lit(default)) if material_id else F.lit(default))
    if physics:
        phys, name = F.col(physics), label("object")
    elif material:
        m = F.col(material)
        phys, name = physics_block(m["density"], m["friction"], m["restitution"], m["tags"]), label("sampled")
    elif material_name:
        df = lookup_material(df, material_name)
        m = F.col("material")
        phys, name = physics_block(m["density"], m["friction"], m["restitution"], m["tags"]), F.col(material_name)
    else:
        raise ValueError("give physics, material or material_name")
    empty = lambda kind: F.array().cast(kind)
    probe_list = F.col(probes) if probes else empty(schema["behavior"].dataType["probes"].dataType)
    path = F.col(trajectory) if trajectory else empty(schema["dynamics"].dataType["trajectory"].dataType)
    return df.select(
        "scene_id", "split", F.lit(K.SCHEMA_VERSION).alias("schema_version"), F.lit(generator).alias("generator"),
        F.struct(F.col("shape"), name.alias("material")).alias("input"),
        F.struct(F.col(resolution).cast("int").alias("resolution"), F.col(frames).alias("frames")).alias("appearance"),
        phys.alias("physics"), F.struct(probe_list.alias("probes")).alias("behavior"),
        F.struct(F.lit(fps).alias("fps"), path.alias("trajectory")).alias("dynamics"),
        *([F.col(truth).alias("material_truth")] if truth else []),
    )


def assemble(assignments: DataFrame, frames: DataFrame, behavior: DataFrame, on_missing: str = "error") -> DataFrame:
    """Join both per-scene products to their assignment; every assignment must have both.

    ``on_missing='error'`` fails on an assignment without one; ``'skip'`` drops it.
    """
    if on_missing == "skip":
        return assignments.join(frames, "scene_id").join(behavior, "scene_id")
    out = assignments.join(frames.withColumn("_frames", F.lit(True)), "scene_id", "left").join(
        behavior.withColumn("_behavior", F.lit(True)), "scene_id", "left")
    lacks = F.when(F.col("_frames").isNull(), "frames").when(F.col("_behavior").isNull(), "behavior")
    message = F.concat(F.lit("no "), lacks, F.lit(" for scene "), F.coalesce(F.col("scene_id").cast("string"), F.lit("null")))
    kind = out.schema["scene_id"].dataType
    return out.withColumn("scene_id", F.when(lacks.isNotNull(), F.raise_error(message).cast(kind)).otherwise(
        F.col("scene_id"))).drop("_frames", "_behavior")


def build_manifest(scenes: DataFrame, generator: str, region: Mapping | None = None,
                   held_pairs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Manifest as (one-row header, scene index).

    The index stays a table of its own: one array holding every scene would put the whole data set into
    a single row.
    """
    index = scenes.select("scene_id", "split", F.col("input.shape").alias("shape"),
                          F.col("input.material").alias("material"))
    header = index.agg(
        F.lit(K.SCHEMA_VERSION).alias("version"), F.lit(generator).alias("generator"),
        F.struct(F.count_if(F.col("split") != "test").alias("n_train"), F.count_if(F.col("split") == "test").alias("n_test"),
                 F.count(F.lit(1)).alias("n_scenes")).alias("split_summary"))
    if region is not None:
        axes = [F.array(*[F.lit(float(v)) for v in region.get(a, ())]).cast("array<double>").alias(a)
                for a in K.ESSENCE_FIELDS]
        header = header.withColumn("holdout_region", F.struct(F.lit(region.get("kind", "region")).alias("kind"), *axes))
    if held_pairs is not None:
        header = header.withColumn("n_held_out", F.lit(held_pairs.count()))
    return header, index
