"""Multi-run reports: alignment per arm, code agreement, one row per arm for the verdicts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probelake import constants as K
from probelake.functions.scalars import col
from probelake.operators.agreement import (adjusted_rand_by_width, code_marginals, code_number, mutual_information, tercile_labels, trit_agreement,
                                           trit_agreement_null)
from probelake.operators.alignment import cka_by_pair, collapse_gate, overlap_by_pair, pair_stats, participation_ratio
from probelake.session import durable, with_scalars


def shuffle_gate(neighbors: DataFrame, run_id, k: int, seed: int = K.NULL_SEED) -> DataFrame:
    """Self overlap, overlap with seeded-shuffled rows, and chance level of one run's neighbour table.

    A shuffled table compares the list of row i with the list of its successor in a seeded order.
    """
    from probelake.operators.ranking import seeded_rank

    own = neighbors.where(F.col("run_id") == run_id).select("id", "neighbor")
    ids = seeded_rank(own.select("id").distinct(), seed, "id", out="place")
    n = ids.count()
    follower = ids.select(F.col("id").alias("other"), (F.col("place") % n + 1).alias("place"))
    moved = own.join(ids.join(follower, "place").select("id", "other"), "id").select("other", "neighbor")
    hits = moved.join(own.withColumnRenamed("id", "other"), ["other", "neighbor"]).agg(F.count(F.lit(1)).alias("h"))
    again = own.join(own.dropDuplicates(), ["id", "neighbor"]).count()
    return hits.select((F.lit(again) / (n * k)).alias("self_overlap"), (F.col("h") / (n * k)).alias("shuffle"), F.lit(k / max(n - 1, 1)).alias("chance"))


def run_pairs_by_arm(registry: DataFrame) -> DataFrame:
    """(arm, kind, run_a, run_b) of the report: pairs inside an arm and kind, and across two arms (arm "x|y").

    Trained runs of one seed start alike, untrained runs of one seed are the same draw: across arms such pairs are left out.
    """
    side = lambda s: registry.select("kind", F.col("arm").alias(f"arm_{s}"), F.col("run_id").alias(f"run_{s}"), F.col("seed").alias(f"seed_{s}"))
    both = side("a").join(side("b"), "kind")  # the registry has one row for each run
    within = both.where("arm_a = arm_b AND run_a < run_b").select(F.col("arm_a").alias("arm"), "kind", "run_a", "run_b")
    across = both.where("arm_a < arm_b AND seed_a <> seed_b").select(F.concat_ws("|", "arm_a", "arm_b").alias("arm"), "kind", "run_a", "run_b")
    return within.unionByName(across)


def alignment_report(neighbors: DataFrame, registry: DataFrame, k: int, seed: int = K.NULL_SEED, latents: DataFrame | None = None,
                     floor: float | None = None) -> DataFrame:
    """One row per population and arm or pair of arms.

    ``trained``, ``untrained`` and ``learned`` neighbour alignment, ``trained_cka`` and ``untrained_cka`` (inside arms, all
    rows), the number of trained runs left out because their participation ratio is under ``floor``, and the gates of the
    arm's first trained run: overlap with itself, with shuffled rows, and the chance level.

    ``neighbors`` is (run_id, id, neighbor), with ``population`` when there are several; the first in name order, "all",
    has the gates and the kernel side. ``registry`` is (run_id, arm, kind, seed), one row per run. ``latents`` is
    (run_id, id, z); without it the kernel side is null and nothing is left out.
    """
    if "population" not in neighbors.columns:
        neighbors = neighbors.withColumn("population", F.lit("all"))
    registry = registry.withColumn("dropped", F.lit(False))
    if latents is not None and floor is not None:
        low = collapse_gate(participation_ratio(latents, "z", ["run_id"]), floor=floor).select("run_id", "collapsed")
        registry = registry.drop("dropped").join(low, "run_id", "left").withColumn(
            "dropped", F.coalesce("collapsed", F.lit(False)) & (F.col("kind") == "trained")).drop("collapsed")
    registry = durable(registry)
    used = registry.where("NOT dropped")
    pairs = durable(run_pairs_by_arm(used))
    overlaps = overlap_by_pair(neighbors, pairs.withColumn("arm_kind", F.struct("arm", "kind")), k, "arm_kind", ["population"])
    mean, _ = pair_stats(overlaps.select("population", F.to_json("arm_kind").alias("arm_kind"), "run_a", "run_b", "knn"), "knn", "arm_kind", ["population"])
    named = mean.select("population", F.from_json("arm_kind", "arm string, kind string").alias("k"), "pair_mean").select("population", "k.*", "pair_mean")
    one = lambda kind, value: F.max(F.when(F.col("kind") == kind, F.col(value)))
    rows = named.groupBy("population", "arm").agg(one("trained", "pair_mean").alias("trained"), one("untrained", "pair_mean").alias("untrained"))
    rows = rows.withColumn("learned", F.col("trained") - F.col("untrained"))
    nothing = F.lit(None).cast("double")
    if latents is None:
        rows = rows.withColumns({"trained_cka": nothing, "untrained_cka": nothing})
    else:
        cka = cka_by_pair(latents, pairs.where(~F.col("arm").contains("|")).select("arm", "kind", "run_a", "run_b"))
        kernel = cka.groupBy("arm", "kind").agg(F.avg("cka").alias("cka")).groupBy("arm").agg(
            one("trained", "cka").alias("trained_cka"), one("untrained", "cka").alias("untrained_cka"))
        rows = rows.join(kernel.withColumn("population", F.lit("all")), ["population", "arm"], "left")
    dropped = registry.groupBy("arm").agg(F.count_if("dropped").alias("n_dropped"))
    rows = rows.join(dropped, "arm", "left")
    first = used.where("kind = 'trained'").groupBy("arm").agg(F.min("run_id").alias("run_id"))
    gates = None
    whole = neighbors.where("population = 'all'")
    for r in first.orderBy("arm").collect():  # arms are few; each gate compares one run with itself
        gate = shuffle_gate(whole, r["run_id"], k, seed).select(F.lit("all").alias("population"), F.lit(r["arm"]).alias("arm"), "*")
        gates = gate if gates is None else gates.unionByName(gate)
    if gates is None:
        return rows.withColumns({c: nothing for c in ("self_overlap", "shuffle", "chance")})
    return rows.join(gates, ["population", "arm"], "left")


def code_cells(codes: DataFrame, key: str, run: str, code: str) -> DataFrame:
    """(item, a, b, n): joint table of the whole codes of every pair of runs ("a|b"), from one pass over the scenes."""
    per_scene = codes.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(run).alias("r"), code_number(code).alias("c")))).alias("v"))  # one entry per run
    later = F.expr("slice(v, p + 2, greatest(size(v) - p - 1, 0))")
    pairs = per_scene.select("v", F.posexplode("v").alias("p", "x")).select("x", F.explode(later).alias("y"))
    return pairs.groupBy(F.concat_ws("|", "x.r", "y.r").alias("item"), F.col("x.c").alias("a"), F.col("y.c").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def digits_of(number, width: int) -> Column:
    """The digits of a code number, -1 to 1."""
    return F.array(*[(F.call_function("div", col(number), F.lit(3 ** i).cast("bigint")) % 3 - 1).cast("int") for i in range(width)])


def code_agreement(cells: DataFrame, width: int, draws: int = K.NULL_DRAWS, seed: int = K.NULL_SEED) -> DataFrame:
    """(item, entry, value, null_mean, null_p95): agreement of every digit of two codes, with its shuffle null."""
    by_entry = cells.select("item", "n", F.posexplode(F.arrays_zip(digits_of("a", width).alias("a"), digits_of("b", width).alias("b"))).alias("entry", "d")) \
        .groupBy("item", "entry", "d.a", "d.b").agg(F.sum("n").alias("n"))
    agree = trit_agreement(by_entry, "a", "b", ["item", "entry"], "n")
    null = trit_agreement_null(by_entry, "a", "b", draws, seed, ["item", "entry"], "n")
    return agree.join(null, ["item", "entry"]).select("item", "entry", F.col("agreement").alias("value"), "null_mean", "null_p95")


def code_information(codes: DataFrame, run: str, code: str, labels: DataFrame, key: str, width: int) -> DataFrame:
    """(item, entry, factor, value): mutual information of every digit of every run's code with every factor.

    ``labels`` is (key, factor, label). One joint table of labels and whole codes serves all digits.
    """
    met = codes.select(key, F.col(run).cast("string").alias("item"), code_number(code).alias("c")).join(labels, key)
    cells = met.groupBy("item", "factor", "label", "c").agg(F.count(F.lit(1)).alias("n"))
    by_entry = cells.select("item", "factor", "label", "n", F.posexplode(digits_of("c", width)).alias("entry", "d"))
    return mutual_information(by_entry, "label", "d", ["item", "factor", "entry"], "n").select("item", "entry", "factor", F.col("mi").alias("value"))


def code_report(codes: DataFrame, key: str, run: str, code: str, factors: Mapping[str, str] | Sequence[str] = (), measured: Sequence[str] = (), *,
                width: int = 1, widths: Sequence[int] = (1, 2, 4, 8), draws: int = K.NULL_DRAWS, seed: int = K.NULL_SEED) -> DataFrame:
    """(item, measure, entry, value, null_mean, null_p95) over the codes of several runs.

    For every pair of runs ("a|b") the agreement of each digit with its shuffle null and the adjusted Rand index of the
    first 1, 2, 4, ... digits (``ari_k``); for every run the mutual information of each digit with each factor
    (``mi_<factor>``) and the shares of the three values of each digit.

    ``codes`` is long, one row per (run, scene), with an array of ``width`` digits, or one digit. ``factors`` names columns of
    ``codes`` that are labels of a scene (or maps names to them), ``measured`` numeric ones that are cut at their terciles;
    both repeat for every run.
    """
    if not isinstance(codes.schema[code].dataType, T.ArrayType):
        codes = codes.withColumn(code, F.array(F.col(code).cast("int")))
    cells = durable(code_cells(codes, key, run, code))
    agree = code_agreement(cells, width, draws, seed).withColumn("measure", F.lit("agreement"))
    ari = adjusted_rand_by_width(cells, [w for w in widths if w <= width], ["item"]).select(
        "item", F.concat(F.lit("ari_"), "width").alias("measure"), F.col("ari").alias("value"))
    rows = agree.unionByName(ari, allowMissingColumns=True)
    labels = scene_labels(codes, key, factors, measured)
    if labels is not None:
        mi = code_information(codes, run, code, labels, key, width)
        rows = rows.unionByName(mi.select("item", F.concat(F.lit("mi_"), "factor").alias("measure"), "entry", "value"), allowMissingColumns=True)
    digits = codes.select(F.col(run).cast("string").alias("item"), F.posexplode(code).alias("entry", "d"))
    counts = code_marginals(digits, "d", ["item", "entry"])
    total = F.col("n_minus") + F.col("n_zero") + F.col("n_plus")
    shares = F.array(*[F.struct(F.lit(f"{v}_share").alias("measure"), (F.col(f"n_{v}") / total).alias("value")) for v in ("minus", "zero", "plus")])
    rows = rows.unionByName(counts.select("item", "entry", F.inline(shares)), allowMissingColumns=True)
    return rows.select("item", "measure", "entry", "value", "null_mean", "null_p95")


def scene_labels(codes: DataFrame, key: str, factors: Mapping[str, str] | Sequence[str], measured: Sequence[str]) -> DataFrame | None:
    """(key, factor, label) of every scene, labels as text; None without factors."""
    named = factors if isinstance(factors, Mapping) else {f: f for f in factors}
    picked = {**named, **{m: m for m in measured}}
    scenes = codes.groupBy(key).agg(*[F.max(c).alias(name) for name, c in picked.items()]) if picked else None
    parts = []
    if named:
        each = F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).cast("string").alias("label")) for f in named])
        parts.append(scenes.select(key, F.inline(each)))
    if measured:
        parts.append(tercile_labels(scenes, key, measured).withColumn("label", F.col("label").cast("string")))
    return reduce(DataFrame.unionByName, parts) if parts else None


def arm_report(metrics: DataFrame, controls: DataFrame, inherit_from: str, arm: str = "arm") -> DataFrame:
    """Arm metrics with their independent control; arms without one inherit that of a named arm, flagged."""
    base = controls.where(F.col(arm) == inherit_from).select(F.col("independent").alias("_base"))
    out = with_scalars(metrics.join(controls.select(arm, "independent"), arm, "left"), base)
    return out.withColumn("inherited", F.col("independent").isNull()).withColumn(
        "independent", F.coalesce("independent", "_base")).drop("_base")
