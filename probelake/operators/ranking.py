"""Global ranks and order statistics without a single-partition window.

Seeded (hash) orders use a prefix histogram: md5 is uniform, so 16 bits of prefix split the keys into
65,536 even buckets whatever the skew of the data. Cut points are then found exactly by looking into
one bucket only. Value orders use one range sort, written durably so that partition numbers are stable,
plus per-partition offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probelake.functions.hashing import shuffle_key
from probelake.functions.scalars import col
from probelake.session import durable

PREFIX_LEN = 4  # hex digits: at most 65,536 histogram rows


def seeded_cuts(keys: DataFrame, positions: Sequence[int], order: Column) -> dict[int, str]:
    """The hash text at the given 1-based positions of a seeded order.

    ``keys`` holds distinct keys. One histogram pass and one pass over the few buckets that hold a
    position; only those single values reach the driver.
    """
    wanted = sorted({p for p in positions if p >= 1})
    if not wanted:
        return {}
    hashed = keys.select(order.alias("_h")).withColumn("_b", F.substring("_h", 1, PREFIX_LEN))
    histogram = sorted((r["_b"], r["count"]) for r in hashed.groupBy("_b").count().collect())
    inside: dict[str, list[tuple[int, int]]] = {}
    seen, i = 0, 0
    for bucket, n in histogram:
        while i < len(wanted) and wanted[i] <= seen + n:
            inside.setdefault(bucket, []).append((wanted[i], wanted[i] - seen))
            i += 1
        seen += n
    if i < len(wanted):
        raise ValueError(f"position {wanted[i]} is beyond the {seen} keys")
    ranked = (
        hashed.where(F.col("_b").isin(list(inside)))
        .withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("_h")))
    )
    hit = F.lit(False)
    for bucket, places in inside.items():
        hit = hit | ((F.col("_b") == bucket) & F.col("_r").isin([r for _, r in places]))
    found = {(r["_b"], r["_r"]): r["_h"] for r in ranked.where(hit).collect()}
    return {p: found[(b, r)] for b, places in inside.items() for p, r in places}


def seeded_rank(df: DataFrame, seed: int, *key, out: str = "rank") -> DataFrame:
    """1-based rank of every row in the seeded order of its key (unique keys)."""
    hashed = df.withColumn("_h", shuffle_key(seed, *key)).withColumn("_b", F.substring("_h", 1, PREFIX_LEN))
    offsets = (
        hashed.groupBy("_b").count()
        .withColumn("_before", F.sum("count").over(Window.orderBy("_b")) - F.col("count"))
        .select("_b", "_before")
    )
    within = F.row_number().over(Window.partitionBy("_b").orderBy("_h", *key))
    # at most 16^PREFIX_LEN rows, so the broadcast is bounded by construction
    return (
        hashed.join(F.broadcast(offsets), "_b")
        .withColumn(out, (F.col("_before") + within).cast("bigint"))
        .drop("_h", "_b", "_before")
    )


def sorted_rank(df: DataFrame, order: Sequence, by: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """1-based rank within ``by`` under ``order`` (a total order), safe for groups of any size.

    One range sort spreads even a single huge group over all partitions; the written copy pins the
    partition numbers, and each (group, partition) slice is ranked on its own and shifted by the number
    of rows of the group in earlier slices.
    """
    by = list(by)
    ordered = durable(df.orderBy(*by, *order).withColumn("_p", F.spark_partition_id()))
    slices = ordered.groupBy(*by, "_p").count()
    before = F.sum("count").over(Window.partitionBy(*by).orderBy("_p")) - F.col("count")
    offsets = slices.withColumn("_before", before).drop("count")
    within = F.row_number().over(Window.partitionBy(*by, "_p").orderBy(*order))
    keys = [*by, "_p"]
    return (
        ordered.withColumn("_w", within).join(offsets, keys)
        .withColumn(out, (F.col("_before") + F.col("_w")).cast("bigint"))
        .drop("_p", "_w", "_before")
    )


def exact_percentiles(df: DataFrame, value: str, fractions: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Linear-interpolated percentiles per group: columns ``by``, ``fraction``, ``percentile``.

    Equal values are first folded into one row with a count, so ties never pile up in one slice; the
    folded values are range-sorted and the running count locates the two neighbours of every position.
    """
    by = list(by)
    folded = (
        df.where(col(value).isNotNull()).groupBy(*by, col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    ordered = durable(folded.orderBy(*by, "_v").withColumn("_p", F.spark_partition_id()))
    slices = ordered.groupBy(*by, "_p").agg(F.sum("_c").alias("_n"))
    whole = Window.partitionBy(*by)
    offsets = slices.select(
        *by, "_p",
        (F.sum("_n").over(whole.orderBy("_p")) - F.col("_n")).alias("_before"),
        F.sum("_n").over(whole).alias("_total"),
    )
    running = F.sum("_c").over(Window.partitionBy(*by, "_p").orderBy("_v"))
    spans = (
        ordered.withColumn("_run", running).join(offsets, [*by, "_p"])
        .withColumn("_hi", F.col("_before") + F.col("_run"))       # last 1-based position of the value
        .withColumn("_lo", F.col("_hi") - F.col("_c") + 1)
    )
    fractions_col = F.explode(F.array(*[F.lit(float(f)) for f in fractions]))
    position = F.col("fraction") * (F.col("_total") - 1)           # 0-based, fractional
    floor_at, ceil_at = F.floor(position) + 1, F.ceil(position) + 1
    return (
        spans.withColumn("fraction", fractions_col)
        .where(floor_at.between(F.col("_lo"), F.col("_hi")) | ceil_at.between(F.col("_lo"), F.col("_hi")))
        .groupBy(*by, "fraction")
        .agg(F.min("_v").alias("_a"), F.max("_v").alias("_b"), F.first(position).alias("_pos"))
        .withColumn("percentile", F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_pos") - F.floor("_pos")))
        .select(*by, "fraction", "percentile")
    )


def value_bands(df: DataFrame, order, width: float, out: str = "_band") -> DataFrame:
    """``df`` plus a band number that rises with a numeric order column: one band per ``width`` of its values.

    The same rule at every size: choose ``width`` so that the rows of one key inside one band fit a task. Nulls
    (first in the order) and NaN (last) have bands of their own, so a band is never null.
    """
    v = col(order).cast("double")
    first, last = -(1 << 62), 1 << 62
    number = F.greatest(F.lit(float(first + 1)), F.least(F.lit(float(last - 1)), F.floor(v / F.lit(float(width))).cast("double"))).cast("bigint")
    return df.withColumn(out, F.when(v.isNull(), F.lit(first)).when(F.isnan(v), F.lit(last)).otherwise(number))
