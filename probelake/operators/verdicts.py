"""Gates and pre-declared verdict rules, as columns over small per-arm tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probelake.functions.scalars import col
from probelake.session import with_scalars


def gate_notes(rules: Mapping[str, Column]) -> Column:
    """V1: texts of the violated rules; ``rules`` maps a note to the condition that must hold (null fails)."""
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), note) for note, ok in rules.items()]),
                    lambda n: n.isNotNull())


def representation_gates(self_overlap, shuffled, chance, n_used, n_needed) -> dict[str, Column]:
    """Self-alignment is exact, a shuffle stays under three times chance, enough seeds were measured."""
    return {"self alignment": col(self_overlap) == 1.0, "shuffle above 3x chance": col(shuffled) < 3 * col(chance),
            "too few seeds": col(n_used) >= col(n_needed)}


def coherence_gates(lowest_pr, independent, learned=None, pr_floor: float = 8.0, control_max: float = 0.05,
                    band: tuple[float, float] | None = None, anchor: tuple[Column, float, float] | None = None) -> dict[str, Column]:
    """No rank collapse, a measured and near-zero control, and optionally a validity band or anchor."""
    rules = {"rank collapse": col(lowest_pr) >= pr_floor, "control not measured": col(independent).isNotNull(),
             "control not near zero": col(independent).isNull() | (F.abs(col(independent)) < control_max)}
    if band is not None and learned is not None:
        rules["outside validity band"] = col(learned).between(*band)
    if anchor is not None:
        value, at, tolerance = anchor
        rules["off the untrained anchor"] = F.abs(col(value) - at) <= tolerance
    return rules


def apply_gates(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """V1: rows with ``notes`` and ``passed``."""
    return df.withColumn("notes", gate_notes(rules)).withColumn("passed", F.size("notes") == 0)


def all_pass(gated: DataFrame, exempt: Sequence[str] = (), arm: str = "arm") -> DataFrame:
    """One row: do all arms pass (exempt arms are reported but do not decide)."""
    counted = gated.where(~F.col(arm).isin(*exempt)) if exempt else gated
    return counted.agg(F.coalesce(F.bool_and("passed"), F.lit(True)).alias("gates_ok"))


def decide(primary, t, rise: float, t_min: float, null_max: float, gates_ok=None, names=("RISES", "NULL", "INCONCLUSIVE"),
           blocked: str = "VOID") -> Column:
    """V2: the three-way rule: a clear rise, a clear null, or neither; withheld when gates fail."""
    p = col(primary)
    verdict = (F.when((p >= rise) & (col(t) >= t_min) & ~F.isnan(col(t)), names[0])
               .when(F.abs(p) < null_max, names[1]).otherwise(names[2]))
    return verdict if gates_ok is None else F.when(~col(gates_ok), blocked).otherwise(verdict)


def curve_verdict(diff, t, rho, spread, rise: float = 0.05, t_min: float = 2.5, rho_min: float = 0.6,
                  flat: float = 0.05) -> Column:
    """RISES needs difference, t and rank correlation; a narrow spread is FLAT; else MIXED."""
    up = (col(diff) >= rise) & (col(t) >= t_min) & ~F.isnan(col(t)) & (col(rho) >= rho_min)
    return F.when(up, "RISES").when(col(spread) < flat, "FLAT").otherwise("MIXED")


def control_leak(abs_delta) -> Column:
    """Control arm: PASS under .05, MARGINAL up to .10, FAIL beyond."""
    return F.when(col(abs_delta) < 0.05, "PASS").when(col(abs_delta) <= 0.10, "MARGINAL").otherwise("FAIL")


def coupling_limit(delta, seeds_over, continuous_delta, control, threshold: float = 0.15) -> Column:
    """World or architecture limit; suppressed unless the control passed."""
    return (F.when(col(control) != "PASS", "SUPPRESSED")
            .when((col(delta) > threshold) & (col(seeds_over) >= 2), "WORLD LIMIT")
            .when(col(continuous_delta) > threshold, "WORLD LIMIT (CONTINUOUS ONLY)").otherwise("ARCHITECTURE LIMIT"))


def decline(diff, t, stale, confirm: float = 0.20, t_min: float = 2.5, null_max: float = 0.08) -> Column:
    """DECLINE / NULL / INCONCLUSIVE on fresh seeds; suppressed when stale seeds were let in."""
    return F.when(col(stale), "SUPPRESSED").otherwise(
        decide(diff, t, confirm, t_min, null_max, names=("DECLINE", "NULL", "INCONCLUSIVE")))


def peak(diff, t, confirm: float = 0.20, t_min: float = 2.5, null_max: float = 0.15) -> Column:
    """NON-MONOTONIC / PLATEAU / INCONCLUSIVE."""
    return decide(diff, t, confirm, t_min, null_max, names=("NON-MONOTONIC", "PLATEAU", "INCONCLUSIVE"))


def unified_without_cost(rise, t, delta, reference_delta, lowest_pr=None, coh_rise: float = 0.10, t_min: float = 2.5,
                         tolerance: float = 0.15, pr_floor: float = 8.0) -> Column:
    """Coherence rises clearly while the gain is kept (and, when given, the rank does not collapse)."""
    ok = (col(rise) >= coh_rise) & (col(t) >= t_min) & ~F.isnan(col(t)) & (col(delta) >= col(reference_delta) - tolerance)
    return ok & (col(lowest_pr) >= pr_floor) if lowest_pr is not None else ok


def shape_carried(coherence, confirm: float = 0.05, refute: float = 0.10) -> Column:
    return F.when(col(coherence) < confirm, "CONFIRMED").when(col(coherence) >= refute, "REFUTED").otherwise("INCONCLUSIVE")


def gated_by_learning(gain_diff, gain_t, verdict, gain_min: float = 0.20, t_min: float = 2.5) -> Column:
    """A verdict that is withheld unless the material was learned at all."""
    learned = (col(gain_diff) >= gain_min) & (col(gain_t) >= t_min) & ~F.isnan(col(gain_t))
    return F.when(learned, col(verdict)).otherwise("WITHHELD")


def headroom(gain) -> Column:
    """M8: below 1.10 the target is unpredictable, above 1.331 the headroom is gone."""
    g = col(gain)
    return F.when(g < 1.10, "UNPREDICTABLE").when(g > 1.331, "GONE").otherwise("INTACT")


def fidelity(ceiling) -> Column:
    """M6: which link limits the render path, from the fresh-head ceiling."""
    c = col(ceiling)
    return F.when(c >= 1.90, "DECOUPLING").when(c <= 1.70, "LEGIBILITY").otherwise("BOTH")


def content_class(df: DataFrame, label: str, factor: str, mi: str, shape: str = "shape", ratio: float = 1.2) -> DataFrame:
    """V3: shape-coded, material-coded (with the strongest factor) or mixed."""
    is_shape = F.col(factor) == shape
    rows = df.groupBy(label).agg(
        F.max(F.when(is_shape, F.col(mi))).alias("mi_shape"), F.max(F.when(~is_shape, F.col(mi))).alias("mi_factor"),
        F.max_by(factor, F.when(~is_shape, F.col(mi))).alias("best_factor"))
    verdict = (F.when(F.col("mi_shape") > ratio * F.col("mi_factor"), "shape-coded")
               .when(F.col("mi_factor") > ratio * F.col("mi_shape"), F.concat(F.lit("material-coded ("), F.col("best_factor"), F.lit(")")))
               .otherwise("mixed"))
    return rows.withColumn("content", verdict)


def agreement_verdict(pairs: DataFrame, by: Sequence[str], agreement: str, null_mean: str, null_p95: str,
                      excess: float = 0.15, none: float = 0.05) -> DataFrame:
    """V4: convergent when every pair beats its null and the mean excess is large; not when it is tiny."""
    rows = pairs.groupBy(*by).agg(
        F.bool_and(F.col(agreement) > F.col(null_p95)).alias("above"), F.avg(F.col(agreement) - F.col(null_mean)).alias("mean_excess"))
    verdict = (F.when(F.col("above") & (F.col("mean_excess") >= excess), "CONVERGENT")
               .when(F.col("mean_excess") < none, "NOT CONVERGENT").otherwise("INCONCLUSIVE"))
    return rows.withColumn("verdict", verdict)


def paired_difference(df: DataFrame, within, cross, untrained_gap, by: Sequence[str] = (), rise: float = 0.03,
                      t_min: float = 2.5, null_max: float = 0.02) -> DataFrame:
    """V5: within minus cross minus the untrained gap per seed, with a one-sample t and a verdict."""
    from probelake.operators.stats import one_sample_t

    d = col(within) - col(cross) - col(untrained_gap)
    rows = df.groupBy(*by).agg(F.avg(d).alias("d"), one_sample_t(d).alias("t"), F.count(d).alias("n"))
    return rows.withColumn("verdict", decide("d", "t", rise, t_min, null_max, names=("WORLD-SPECIFIC", "NULL", "INCONCLUSIVE")))


def control_rank(arms: DataFrame, arm: str, value: str, control: str) -> DataFrame:
    """V6: position of the control among the arms, lowest first: the number of arms below it, plus one."""
    at = arms.where(F.col(arm) == control).select(F.col(value).alias("_c"))
    lower = (F.col(value) < F.col("_c")) | ((F.col(value) == F.col("_c")) & (F.col(arm) < control))
    rows = with_scalars(arms, at).agg(
        F.lit(control).alias(arm), (F.count_if(lower) + 1).alias("rank"), F.count(F.lit(1)).alias("n_arms"))
    return rows.withColumn("status", F.when(F.col("rank") == 1, "PASS").when(F.col("rank") == 2, "bottom-two").otherwise("FAIL"))


def dose_response(series: DataFrame, name: str, step: str, value: str, min_points: int = 4) -> DataFrame:
    """Monotone up, monotone down or mixed over consecutive steps; incomplete with gaps or too few points."""
    w = Window.partitionBy(name).orderBy(step)
    d = F.col(value) - F.lag(value).over(w)
    rows = series.withColumn("_d", d).groupBy(name).agg(
        F.count(F.lit(1)).alias("n"), F.count(value).alias("n_known"), F.bool_and(F.col("_d") < 0).alias("_down"),
        F.bool_and(F.col("_d") > 0).alias("_up"))
    return rows.select(name, "n", F.when((F.col("n_known") < F.col("n")) | (F.col("n") < min_points), "incomplete")
                       .when(F.col("_down"), "monotone down").when(F.col("_up"), "monotone up").otherwise("mixed").alias("direction"))


def fresh_seeds(runs: DataFrame, seed: str = "seed", min_seed: int = 8, allow_stale: bool = False) -> DataFrame:
    """F8: drop the seeds that generated the hypothesis; letting them in marks every row as stale."""
    kept = runs if allow_stale else runs.where(F.col(seed) >= min_seed)
    return kept.withColumn("stale", F.lit(allow_stale))


def apparatus_checks(rows: DataFrame, arm: str, shape: str, x: str, y: str) -> DataFrame:
    """distinct shapes and measured coupling of every arm."""
    from probelake.operators.stats import pearson

    return rows.groupBy(arm).agg(F.count_distinct(shape).alias("n_shapes"), F.min(shape).alias("first_shape"),
                                 pearson(x, y).alias("r"))


def physics_matched(rows: DataFrame, arm: str, key: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """per arm pair-free check that every scene has the same physics in all arms it should appear in.

    A scene is matched when it occurs once per arm and each field has one distinct value: min equals max.
    """
    n_arms = rows.agg(F.count_distinct(arm).alias("n_arms"))
    same = [F.min(f).eqNullSafe(F.max(f)) & (F.count(f).isin(0) | (F.count(f) == F.count(F.lit(1)))) for f in fields]
    scenes = rows.groupBy(*key).agg(F.count_distinct(arm).alias("_arms"), F.least(*[s.cast("int") for s in same], F.lit(1)).alias("_same"))
    checked = with_scalars(scenes, n_arms)
    bad = (F.col("_arms") < F.col("n_arms")) | (F.col("_same") == 0)
    return checked.agg(F.count(F.lit(1)).alias("n_scenes"), F.count_if(bad).alias("n_mismatched"))


def resolution_check(frames: DataFrame, resolution: str, expected: int) -> DataFrame:
    """one row with the scene count, or an error when any scene has another resolution."""
    wrong = F.count_if(~F.col(resolution).eqNullSafe(F.lit(expected)))
    return frames.agg(F.when(wrong > 0, F.raise_error(F.lit(f"resolution differs from {expected}")).cast("bigint"))
                      .otherwise(F.count(F.lit(1))).alias("n_scenes"))
