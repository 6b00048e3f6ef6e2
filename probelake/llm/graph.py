"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probelake.session import scratch_path

SALTS = 16


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges (``u`` > ``v``) of each batch as stars around the smallest id they reach inside the batch."""
    for batch in batches:
        u, v = batch.column("u").to_numpy(), batch.column("v").to_numpy()
        if not len(u):
            continue
        ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        a, b = at[:len(u)], at[len(u):]
        root = np.arange(len(ids))
        while True:
            low = np.minimum(root[a], root[b])
            before = root.copy()
            np.minimum.at(root, root[a], low)  # hang roots under the smaller root
            np.minimum.at(root, root[b], low)
            while (root[root] != root).any():
                root = root[root]
            if (root == before).all():
                break
        leaf = np.flatnonzero(root != np.arange(len(ids)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[leaf]), pa.array(ids[root[leaf]])], ["u", "v"])


def with_least(rows: DataFrame, key: str, value: str, salts: int = SALTS) -> DataFrame:
    """``rows`` plus ``least``, the smallest ``value`` of the key. Rows of a hot key stay in ``salts`` slices."""
    sliced = rows.withColumn("_salt", F.pmod(F.xxhash64(value), F.lit(salts)).cast("int")).repartition(key, "_salt")
    parts = sliced.groupBy(key, "_salt").agg(F.min(value).alias("_m"))
    least = parts.select(key, "_salt", F.min("_m").over(Window.partitionBy(key)).alias("least"))
    return sliced.join(least, [key, "_salt"]).drop("_salt")


def components(edges: DataFrame) -> DataFrame:
    """``id``, ``component`` (smallest id that can be reached) for every id of ``edges`` (``a``, ``b``, bigint).

    Each round hangs larger neighbours of a node under its smallest one (large star), then smaller ones (small
    star), and writes the edges; batches are turned into stars beforehand. The edges end as one star for each
    component. Null ends are ignored.
    """
    spark = edges.sparkSession
    base = scratch_path(spark, "components")

    def settle(rows: DataFrame, step: int) -> tuple[DataFrame, tuple]:
        rows.mapInArrow(contract, "u bigint, v bigint").distinct().write.parquet(f"{base}/{step}")
        kept = spark.read.parquet(f"{base}/{step}")
        mark = kept.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        return kept, tuple(mark)

    start = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now, mark = settle(start, 0)
    step = 0
    while mark[0]:
        step += 1
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both, "u", "v").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("least", "u").alias("v"))
        small = with_least(large, "u", "v")
        hung = F.when(F.col("v") != F.col("least"), F.col("v"))
        stars = small.select(F.explode(F.array("u", hung)).alias("u"), F.col("least").alias("v")).where("u IS NOT NULL")
        now, new_mark = settle(stars, step)
        if new_mark == mark:
            break
        mark = new_mark
    return now.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.col("v").alias("component")), F.struct(F.col("v").alias("id"), F.col("v").alias("component")))).alias("r")) \
        .select("r.*").distinct()
