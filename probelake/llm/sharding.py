"""Shards of near equal bytes by a minimax contiguous partition (DataFrame functions only).

Documents with equal texts form one atomic group; groups stand in the order of their smallest ``doc_id``. The
smallest feasible shard capacity is found by binary search with a greedy check, and the cuts are those of the
greedy walk at that capacity. The walk runs over a histogram of the ordered groups, never over the groups: cells
of ``2^k`` keys are refined only where a cut can still fall, until every cut lies between two groups.

Defined results: a null text has no bytes and forms a group of its own kind; ``size`` is the UTF-8 length plus
``OVERHEAD``. Groups that share their smallest ``doc_id`` (repeated ids) are one unit; rows without ``doc_id``
sort first. With fewer groups than shards the last shards stay empty. Slots follow ``doc_id`` inside a shard,
equal rows in any order. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probelake.operators.ranking import sorted_rank
from probelake.session import scratch_path

OVERHEAD = 8
SALTS = 64
FIRST_CELLS_LOG2, STEP_LOG2 = 12, 6  # at most 4096 cells at first, 64 inside each refined one
NO_ID = -(1 << 63)

Cell = tuple[int, int, int, int, bool]  # first key, k, bytes before, bytes, holds one group


def smallest(low: int, high: int, works: Callable[[int], bool]) -> int:
    while low < high:
        mid = (low + high) // 2
        if works(mid):
            high = mid
        else:
            low = mid + 1
    return low


def walk(cells: list[Cell], total: int, capacity: int, n: int, optimistic: bool) -> list[int]:
    """Byte positions after each of ``n`` greedy shards.

    A cell of several groups can be cut anywhere (optimistic) or nowhere (pessimistic): the true position of
    every step lies between the two walks.
    """
    from bisect import bisect_right

    starts = [c[2] for c in cells]
    at, out = 0, []
    for _ in range(n):
        goal = at + capacity
        if goal >= total:
            at = total
        else:
            i = bisect_right(starts, goal) - 1
            if optimistic and not cells[i][4]:
                at = goal
            else:
                at = max(at, starts[i])
        out.append(at)
    return out


def minimax_cuts(units: DataFrame, n_shards: int) -> tuple[int, list[int]]:
    """Smallest capacity and the first keys of shards 1, 2, ... for ``units`` (``key`` bigint, ``bytes`` bigint).

    ``units`` may hold several rows of one key; they stay together.
    """
    whole = units.agg(F.min("key").alias("a"), F.max("key").alias("b"), F.sum("bytes").alias("t")).first()
    if whole["a"] is None:
        return 0, []
    total = whole["t"]
    k = max(0, (whole["b"] - whole["a"]).bit_length() - FIRST_CELLS_LOG2)

    def cells_of(k: int, inside: list[int] | None, parent_k: int) -> list[tuple[int, int, int, bool]]:
        rows = units if inside is None else units.where(F.shiftright("key", parent_k).isin(inside))
        got = rows.groupBy(F.shiftright("key", k).alias("c")).agg(F.sum("bytes").alias("s"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()
        return sorted((r["c"] << k, k, int(r["s"]), r["lo"] == r["hi"]) for r in got)

    known = cells_of(k, None, k)
    while True:
        cells, before = [], 0
        for start, width, size, one in known:
            cells.append((start, width, before, size, one))
            before += size
        reached = lambda c, optimistic: walk(cells, total, c, n_shards, optimistic)[-1] == total
        low = smallest(1, total, lambda c: reached(c, True))
        high = smallest(low, total, lambda c: reached(c, False))
        least, most = walk(cells, total, low, n_shards, False), walk(cells, total, high, n_shards, True)
        if low == high and least == most:
            starts = {c[2]: c[0] for c in cells}
            return low, [starts[p] for p in dict.fromkeys(least) if p < total]
        ranges = list(zip(least, most))
        open_cells = [c for c in cells if not c[4] and any(c[2] <= b and a <= c[2] + c[3] for a, b in ranges)]
        by_width: dict[int, list[int]] = {}
        for start, width, *_ in open_cells:
            by_width.setdefault(width, []).append(start)
        finer: list[tuple[int, int, int, bool]] = []
        for width, starts_ in by_width.items():
            finer += cells_of(max(0, width - STEP_LOG2), [s >> width for s in starts_], width)
        gone = {c[0] for c in open_cells}
        known = sorted([c for c in known if c[0] not in gone] + finer)


def sized_groups(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``first_id`` (smallest id of the equal texts), written to the shared folder."""
    spark = docs.sparkSession
    base = scratch_path(spark, "sharding")
    text = F.coalesce("text", F.lit(""))
    docs.select(
        "doc_id",
        (F.octet_length(text).cast("bigint") + OVERHEAD).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.coalesce(F.sha2("text", 256), F.lit("-")).alias("digest"),
        F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("key"),
    ).write.parquet(f"{base}/slim")
    slim = spark.read.parquet(f"{base}/slim")
    slices = slim.groupBy("digest", "salt").agg(F.min("key").alias("m"))
    firsts = slices.select("digest", "salt", F.min("m").over(Window.partitionBy("digest")).alias("first_id"))
    slim.join(firsts, ["digest", "salt"]).select("doc_id", "key", "size", "text_crc32", "first_id").write.parquet(f"{base}/grouped")
    return spark.read.parquet(f"{base}/grouped")


def shard_by_bytes(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``, ``first_id`` for every row."""
    grouped = sized_groups(docs)
    units = grouped.groupBy(F.col("first_id").alias("key")).agg(F.sum("size").alias("bytes"))
    _, cuts = minimax_cuts(units, n_shards)
    shard = F.lit(0)
    for start in cuts:
        shard = shard + (F.col("first_id") >= F.lit(start)).cast("int")
    placed = grouped.withColumn("shard", shard.cast("int"))
    ranked = sorted_rank(placed, ["key", "text_crc32", "size"], by=["shard"], out="slot")
    return ranked.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("slot") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "first_id")
