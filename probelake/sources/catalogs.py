"""Product listings and object directories as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probelake import constants as K
from probelake import schemas as S
from probelake.operators.catalog import first_usable, parse_listings


def read_listings(spark: SparkSession, folder: str, pattern: str = "listings_*.json.gz") -> DataFrame:
    """The first usable record per model over gzip JSON-lines shards in name order.

    A gzip shard is read by one task, so ids rise with the line number inside it; (shard name, id) is the
    reading order without sorting anything.
    """
    raw = spark.read.schema(S.LISTING).option("pathGlobFilter", pattern).json(folder)
    placed = raw.withColumn("_file", F.col("_metadata.file_name")).withColumn("_line", F.monotonically_increasing_id())
    return first_usable(parse_listings(placed, ["_file", "_line"]), ["_file", "_line"])


def scan_object_files(spark: SparkSession, root: str) -> DataFrame:
    """Files below a root of object directories: (object_id, rel_path, content).

    Two scans: all paths (file content pruned), and the text of the few metadata file names.
    """
    below = F.regexp_replace(F.col("path"), "^(file|hdfs|s3a?|abfss?|gs)?:?/*", "/")
    base = "/" + root.split(":", 1)[-1].strip("/") + "/"
    rel = F.substring_index(below, base, -1)
    split_path = lambda df: df.withColumn("_rel", rel).where(F.col("_rel").contains("/")).select(
        F.substring_index("_rel", "/", 1).alias("object_id"), F.regexp_replace("_rel", "^[^/]*/", "").alias("rel_path"),
        *[c for c in df.columns if c != "path"])
    paths = split_path(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path"))
    metas = ("model.sdf", *K.METADATA_JSON, "metadata.pbtxt")
    texts = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", "{" + ",".join(metas) + "}").load(root)
             .select("path", F.decode("content", "UTF-8").alias("content")))
    return paths.join(split_path(texts), ["object_id", "rel_path"], "left")
