"""Alignment of representations: mutual neighbours, kernel alignment, effective rank, pair tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from probelake import constants as K
from probelake.functions.arrow import from_matrix, to_matrix
from probelake.operators.neighbors import knn, neighbor_overlap
from probelake.session import durable, with_scalars


def mutual_knn(df: DataFrame, x: str, y: str, k: int = K.KNN_K, *, id_col: str = "id", **options) -> DataFrame:
    """Mean share of common neighbours over the rows."""
    a, b = (knn(df, k, id_col=id_col, vec=v, **options) for v in (x, y))
    return neighbor_overlap(a, b).agg((F.avg("overlap") / k).alias("alignment"), F.count(F.lit(1)).alias("n"))


def participation_ratio(df: DataFrame, vec: str, by: Sequence[str] = (), epsilon: float = K.PR_EPSILON) -> DataFrame:
    """(sum of variances)^2 / (sum of squared variances + epsilon), population variance per dimension."""
    dims = df.select(*by, F.posexplode(vec).alias("dim", "v"))
    var = dims.groupBy(*by, "dim").agg(F.var_pop(F.col("v").cast("double")).alias("var"), F.count("v").alias("n"))
    return var.groupBy(*by).agg(
        (F.pow(F.sum("var"), F.lit(2.0)) / (F.sum(F.pow("var", F.lit(2.0))) + epsilon)).alias("participation_ratio"),
        F.max("n").alias("n"))


def column_means(df: DataFrame, vec: str) -> np.ndarray:
    """Mean of every entry of an array column over all rows (one small pass; ``d`` numbers)."""
    cells = df.select(F.posexplode(F.col(vec).cast("array<double>")).alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m")).toPandas()
    out = np.zeros(int(cells["i"].max()) + 1 if len(cells) else 0)
    out[cells["i"]] = cells["m"].fillna(0.0)
    return out


def cross_products(df: DataFrame, vec: str, by: Sequence[str] = (), shift: np.ndarray | None = None) -> DataFrame:
    """Sums of products (by, i, j, s) plus (by, i, d, sum) of an array column, less ``shift`` in every row.

    Callers that subtract products of means afterwards shift by the column means first: without it a large offset
    eats all digits.

    Every task multiplies its batches with BLAS and emits one d x d block per group; the blocks are
    summed by key. Nothing grows with the number of rows but the scan.
    """
    by = list(by)
    kinds = ", ".join(f"{b} {df.schema[b].dataType.simpleString()}" for b in by)

    def partial(batches):
        totals: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            z = to_matrix(batch.column(vec))
            z = z if shift is None else z - shift
            z = np.concatenate([z, np.ones((len(z), 1))], axis=1)
            if by:
                groups = batch.select(by).to_pandas().groupby(by, dropna=False).indices
                parts = [(k if isinstance(k, tuple) else (k,), z[rows]) for k, rows in groups.items()]
            else:
                parts = [((), z)]
            for key, part in parts:
                totals[key] = totals.get(key, 0.0) + part.T @ part
        for key, m in totals.items():
            cols = {b: pa.array([v] * len(m), schema_of[b]) for b, v in zip(by, key)}
            cols.update(i=pa.array(np.arange(len(m), dtype=np.int32)), row=from_matrix(m), d=pa.array(np.full(len(m), len(m) - 1, dtype=np.int32)))
            yield pa.RecordBatch.from_pydict(cols)

    schema_of = {b: to_arrow_type(df.schema[b].dataType) for b in by}
    vectors = df.select(*by, F.col(vec).cast("array<double>").alias(vec))
    blocks = vectors.mapInArrow(partial, (kinds + ", " if by else "") + "i int, row array<double>, d int")
    return blocks.select(*by, "i", "d", F.posexplode("row").alias("j", "s")).groupBy(*by, "i", "j", "d").agg(
        F.sum("s").alias("s"))


def covariances(df: DataFrame, vec: str, by: Sequence[str] = ()) -> DataFrame:
    """Centered sums of products (by, i, j, c, n) of an array column."""
    by = list(by)
    s = cross_products(df, vec, by, column_means(df, vec))
    sums = s.where("j = d and i < d").select(*by, F.col("i"), F.col("s").alias("si"))
    n = s.where("i = d and j = d").select(*by, F.col("s").alias("n"))
    body = s.where("i < d and j < d")
    left = body.join(sums, [*by, "i"])
    right = sums.select(*by, F.col("i").alias("j"), F.col("si").alias("sj"))
    both = left.join(right, [*by, "j"])
    both = both.join(n, by) if by else with_scalars(both, n)
    return both.select(*by, "i", "j", "d", (F.col("s") - F.col("si") * F.col("sj") / F.col("n")).alias("c"), "n")


def linear_cka(df: DataFrame, x: str, y: str, d_x: int, by: Sequence[str] = ()) -> DataFrame:
    """Linear kernel alignment through d x d covariances, never an n x n kernel; 0 when a side is constant."""
    both = df.select(*by, F.concat(F.col(x).cast("array<double>"), F.col(y).cast("array<double>")).alias("_xy"))
    c2 = covariances(both, "_xy", by).withColumn("c2", F.col("c") * F.col("c"))
    xi, xj = F.col("i") < d_x, F.col("j") < d_x
    sums = c2.groupBy(*by).agg(
        F.sum(F.when(xi & ~xj, F.col("c2"))).alias("xy"), F.sum(F.when(xi & xj, F.col("c2"))).alias("xx"),
        F.sum(F.when(~xi & ~xj, F.col("c2"))).alias("yy"))
    return sums.select(*by, F.coalesce(F.try_divide(F.col("xy"), F.sqrt("xx") * F.sqrt("yy")), F.lit(0.0)).alias("cka"))


# ---------------------------------------------------------------- kernel alignment of many runs
PANEL_COLUMNS = 2048


def run_means(latents: DataFrame, run: str = "run_id", vec: str = "z") -> dict:
    """Mean vector of every run: partial sums per task, then by key; runs x width numbers reach the driver."""
    kind = latents.schema[run].dataType

    def partial(batches):
        sums: dict = {}
        for batch in batches:
            runs, z = batch.column(0).to_pylist(), batch.column(1)
            places: dict = {}
            for i, r in enumerate(runs):
                places.setdefault(r, []).append(i)
            for r, rows in places.items():
                m = to_matrix(z.take(pa.array(rows)))
                n, total = sums.get(r, (0, 0.0))
                sums[r] = n + len(m), total + m.sum(0)
        for r, (n, total) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([r], to_arrow_type(kind)), pa.array([n]), from_matrix(total[None])], ["run", "n", "z"])

    rows = latents.select(run, F.col(vec).cast("array<double>").alias("z")).mapInArrow(partial, f"run {kind.simpleString()}, n bigint, z array<double>")
    cells = rows.select("run", "n", F.posexplode("z").alias("i", "v")).groupBy("run", "i").agg((F.sum("v") / F.sum("n")).alias("m"))
    out: dict = {}
    for r in cells.orderBy("run", "i").toLocalIterator():
        out.setdefault(r["run"], []).append(r["m"])
    return {r: np.array(m) for r, m in out.items()}


def gram_tiles(latents: DataFrame, run: str = "run_id", id_col: str = "id", vec: str = "z", panel_columns: int = PANEL_COLUMNS) -> DataFrame:
    """Sums of products of every run with every later one and itself: (run_a, run_b, i, j, s), one column of ones at the end.

    The vectors of one scene are laid side by side, so a task multiplies its scenes once for all pairs of runs, and
    pairs are never joined row by row. Tiles are summed by key, cell by cell. A tile counts the scenes that both runs
    have. Beyond ``panel_columns`` columns the runs are cut into panels and a task holds the product of two of them
    at a time. Vectors are taken relative to the mean of their run.
    """
    means = run_means(latents, run, vec)
    runs = sorted(means)
    width = max([len(m) for m in means.values()], default=1)
    per_panel = max(1, panel_columns // (2 * width))
    panel_of = {r: k // per_panel for k, r in enumerate(runs)}
    n_panels = -(-len(runs) // per_panel) if runs else 0
    kind = latents.schema[run].dataType
    wide = latents.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct(F.col(run).alias("r"), F.col(vec).cast("array<double>").alias("z")))).alias("v"))  # one entry per run
    wide = wide.select(F.col("v.r").alias("r"), F.flatten("v.z").alias("z"), F.lit(0).alias("a"), F.lit(0).alias("b"))
    if n_panels > 1:
        both = [F.struct(F.lit(x).alias("a"), F.lit(y).alias("b")) for x in range(n_panels) for y in range(x, n_panels)]
        wide = wide.drop("a", "b").withColumn("p", F.explode(F.array(*both))).select("r", "z", "p.*").repartition("a", "b", F.spark_partition_id()).sortWithinPartitions("a", "b")

    def products(batches):
        sums, now = {}, None
        for batch in batches:
            panels = list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()))
            groups: dict = {}
            for i, row in enumerate(batch.column(0).to_pylist()):
                groups.setdefault((panels[i], tuple(row)), []).append(i)
            for (panel, present), rows in groups.items():
                if panel != now:
                    yield from emitted(sums, now)
                    sums, now = {}, panel
                if len(set(present)) < len(present):
                    raise ValueError("a run lists a scene twice")
                z = to_matrix(batch.column(1).take(pa.array(rows))) - np.concatenate([means[r] for r in present])
                start = np.cumsum([0] + [len(means[r]) for r in present])
                mine = [k for k, r in enumerate(present) if panel_of[r] in panel]
                if not mine:
                    continue
                z = np.concatenate([z[:, start[k]:start[k + 1]] for k in mine] + [np.ones((len(z), 1))], axis=1)
                key = tuple(present[k] for k in mine)
                sums[key] = sums.get(key, 0.0) + z.T @ z
        yield from emitted(sums, now)

    def emitted(sums, panel=None):
        for present, m in sums.items():
            start = np.cumsum([0] + [len(means[r]) for r in present])
            last = [len(m) - 1]
            for x, a in enumerate(present):
                for y, b in enumerate(present[x:], x):
                    if n_panels > 1 and (panel_of[a], panel_of[b]) != panel:
                        continue
                    tile = m[np.ix_([*range(start[x], start[x + 1]), *last], [*range(start[y], start[y + 1]), *last])]
                    n = len(tile)
                    yield pa.RecordBatch.from_arrays([pa.array([a] * n, to_arrow_type(kind)), pa.array([b] * n, to_arrow_type(kind)), pa.array(np.arange(n, dtype=np.int32)), from_matrix(tile)], ["run_a", "run_b", "i", "row"])

    name = kind.simpleString()
    tiles = wide.mapInArrow(products, f"run_a {name}, run_b {name}, i int, row array<double>")
    return tiles.select("run_a", "run_b", "i", F.posexplode("row").alias("j", "s")).groupBy("run_a", "run_b", "i", "j").agg(F.sum("s").alias("s"))


def kernel_products(tiles: DataFrame) -> DataFrame:
    """(run_a, run_b, product, n): squared norm of the centered cross products of two runs, from one tile each."""
    kind = tiles.schema["run_a"].dataType.simpleString()

    def norm(cells):
        m = np.zeros((int(cells["i"].max()) + 1, int(cells["j"].max()) + 1))
        m[cells["i"], cells["j"]] = cells["s"]
        n = m[-1, -1]
        centered = m[:-1, :-1] - np.outer(m[:-1, -1], m[-1, :-1]) / n
        return pd.DataFrame({"run_a": cells["run_a"].iloc[:1], "run_b": cells["run_b"].iloc[:1], "product": [(centered ** 2).sum()], "n": [int(n)]})

    return tiles.groupBy("run_a", "run_b").applyInPandas(norm, f"run_a {kind}, run_b {kind}, product double, n bigint")


def cka_by_pair(latents: DataFrame, pairs: DataFrame, run: str = "run_id", id_col: str = "id", vec: str = "z", **options) -> DataFrame:
    """``pairs`` (run_a, run_b, ...) plus ``cka``, linear kernel alignment over the rows of ``latents`` (run, id, vector).

    One scan answers all pairs. Runs of a pair that do not list the same scenes are an error; a constant run gives 0.
    """
    found = durable(kernel_products(gram_tiles(latents, run, id_col, vec, **options)))  # one row for each pair of runs
    own = found.where("run_a = run_b").select(F.col("run_a").alias("run"), F.col("product").alias("own"), F.col("n").alias("n_own"))
    side = lambda s: own.select(F.col("run").alias(f"run_{s}"), F.col("own").alias(f"own_{s}"), F.col("n_own").alias(f"n_{s}"))
    turned = found.where("run_a <> run_b").select(F.col("run_b").alias("run_a"), F.col("run_a").alias("run_b"), "product", "n")
    met = pairs.join(side("a"), "run_a").join(side("b"), "run_b").join(found.unionByName(turned), ["run_a", "run_b"], "left")
    same = (F.col("n_a") == F.col("n_b")) & (F.coalesce("n", F.lit(0)) == F.col("n_a"))
    value = F.coalesce(F.try_divide(F.col("product"), F.sqrt("own_a") * F.sqrt("own_b")), F.lit(0.0))
    message = F.concat(F.lit("runs list different scenes: "), F.concat_ws(", ", "run_a", "run_b"))
    return met.select(*pairs.columns, F.when(same, value).otherwise(F.raise_error(message).cast("double")).alias("cka"))


# ---------------------------------------------------------------- pairs of runs
def run_pairs(runs: DataFrame, arm: str = "arm", run: str = "run_id") -> DataFrame:
    """Unordered pairs of the runs of an arm (the run registry, a few rows per arm)."""
    a = runs.select(arm, F.col(run).alias("run_a"))
    b = runs.select(arm, F.col(run).alias("run_b"))
    return a.join(b, arm).where("run_a < run_b")


def cross_arm_pairs(runs: DataFrame, arm_a: str, arm_b: str, arm: str = "arm", run: str = "run_id",
                    seed: str = "seed") -> DataFrame:
    """Pairs of runs of two arms with different seeds."""
    pick = lambda name, tag: runs.where(F.col(arm) == name).select(
        F.lit(f"{arm_a}|{arm_b}").alias("arms"), F.col(run).alias(f"run_{tag}"), F.col(seed).alias(f"seed_{tag}"))
    return pick(arm_a, "a").join(pick(arm_b, "b"), "arms").where("seed_a <> seed_b")


def overlap_by_pair(neighbors: DataFrame, pairs: DataFrame, k: int, arm: str | None = "arm", by: Sequence[str] = ()) -> DataFrame:
    """A20 for many run pairs at once: neighbour tables (run_id, id, neighbor) are read once per side.

    ``by`` names columns of the neighbour table, such as ``population``, that are answered each on its own.
    """
    by = list(by)
    keep = [*by, arm] if arm else by
    side = lambda s: neighbors.select(*by, F.col("run_id").alias(f"run_{s}"), "id", "neighbor")
    hits = side("a").join(pairs, "run_a").join(side("b"), [*by, "run_b", "id", "neighbor"])
    n = neighbors.groupBy(*by, "run_id").agg(F.count_distinct("id").alias("n"))
    shared = hits.groupBy(*keep, "run_a", "run_b").agg(F.count(F.lit(1)).alias("hits"))
    base = pairs.join(n, F.col("run_a") == F.col("run_id")).drop("run_id")
    return base.join(shared, [*keep, "run_a", "run_b"], "left").select(
        *keep, "run_a", "run_b", (F.coalesce("hits", F.lit(0)) / (F.col("n") * k)).alias("knn"))


def pair_stats(pairs: DataFrame, value: str, arm: str = "arm", by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Mean over the pairs of every arm, and every run's mean over the pairs it takes part in."""
    per_arm = pairs.groupBy(*by, arm).agg(F.avg(value).alias("pair_mean"), F.count(value).alias("n_pairs"))
    sides = pairs.select(*by, arm, F.explode(F.array("run_a", "run_b")).alias("run_id"), value)
    per_run = sides.groupBy(*by, arm, "run_id").agg(F.avg(value).alias("run_mean"), F.count(value).alias("n_pairs"))
    return per_arm, per_run


def same_rows(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that only one of two tables has (empty when both list the same scenes)."""
    left = a.select(*key).withColumn("_a", F.lit(1)).withColumn("_b", F.lit(0))
    right = b.select(*key).withColumn("_a", F.lit(0)).withColumn("_b", F.lit(1))
    counts = left.unionByName(right).groupBy(*key).agg(F.sum("_a").alias("n_left"), F.sum("_b").alias("n_right"))
    return counts.where("n_left <> n_right")


def collapse_gate(runs: DataFrame, ratio: str = "participation_ratio", floor: float = K.PR_FLOOR) -> DataFrame:
    """flag runs whose effective rank is under the floor."""
    return runs.withColumn("collapsed", F.col(ratio) < floor)
