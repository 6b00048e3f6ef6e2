"""Run folders: checkpoints found by path, metrics files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probelake import schemas as S

# Path patterns of run folders.
SEED_PATTERN = r"_s(\d+)/"
WEIGHT_PATTERN = r"aw([0-9p.]+)_s(\d+)"


def parse_run_paths(paths: DataFrame, path: str = "path") -> DataFrame:
    """Seed (-1 when the path names none), weight (``p`` stands for the decimal point) and tag of a run path."""
    p = F.col(path)
    seed = F.coalesce(F.regexp_extract(p, SEED_PATTERN, 1).try_cast("int"), F.lit(-1))
    weight = F.regexp_replace(F.regexp_extract(p, WEIGHT_PATTERN, 1), "p", ".").try_cast("double")
    tag = F.nullif(F.regexp_extract(p, r"([^/]+?)_s\d+/[^/]*$", 1), F.lit(""))
    return paths.withColumn("seed", seed).withColumn("weight", weight).withColumn("tag", tag)


def scan_runs(spark: SparkSession, glob: str, seeds=None, weights=None) -> DataFrame:
    """Run checkpoints below a glob such as ``<root>/*/model.safetensors``; file content is never read.

    Asked ``seeds`` and ``weights`` take the place of the ``*`` of the run folder, so other folders are not listed.
    """
    if seeds is not None or weights is not None:
        root, folder, name = glob.rsplit("/", 2)
        if folder != "*":
            raise ValueError("seeds and weights prune a glob that ends in /*/<file>")
        weight = "*" if weights is None else "*aw{" + ",".join(f"{w:g}".replace(".", "p") for w in weights) + "}"
        seed = "_s*" if seeds is None else "_s{" + ",".join(str(int(s)) for s in seeds) + "}"
        glob = f"{root}/{weight}{seed}/{name}"
    found = spark.read.format("binaryFile").load(glob).select("path", F.col("modificationTime").alias("modified"))
    return parse_run_paths(found)


def weighted_runs(runs: DataFrame) -> DataFrame:
    """Runs whose path carries a weight; the others are dropped."""
    return runs.where(F.col("weight").isNotNull())


def read_run_metrics(spark: SparkSession, paths) -> DataFrame:
    """Path fields, config columns and one row per history entry; unknown config fields are ignored by the schema.

    ``paths`` are files or globs such as ``<root>/*/metrics.json``.
    """
    doc = spark.read.schema(S.RUN_METRICS).json(paths, multiLine=True).withColumn("path", F.col("_metadata.file_path"))
    placed = parse_run_paths(doc.withColumnRenamed("config", "_config").withColumnRenamed("history", "_history")).withColumnsRenamed({"seed": "path_seed", "weight": "path_weight", "tag": "path_tag"})
    return placed.select("path", "path_seed", "path_weight", "path_tag", "_config.*", F.posexplode_outer("_history").alias("entry", "h")).select("*", "h.*").drop("h")
