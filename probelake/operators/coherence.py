"""Coherence: do two heads of a latent respond to the same perturbations?"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probelake import constants as K
from probelake.operators.sampling import direction_block
from probelake.operators.stats import describe, pearson
from probelake.session import widen

Decoder = Callable[[np.ndarray], np.ndarray]  # (rows, latent) -> (rows, outputs)


def _change(f: Decoder, z: np.ndarray, moved: np.ndarray, n_dirs: int, eps: float) -> np.ndarray:
    """Length of the output change of ``f`` per (row, direction), divided by the step."""
    base = np.asarray(f(z), dtype=np.float64)
    diff = np.asarray(f(moved), dtype=np.float64).reshape(len(z), n_dirs, -1) - base[:, None, :]
    return (np.sqrt((diff ** 2).sum(-1)) / eps).ravel()


def response_magnitudes(latents: DataFrame, f_render: Decoder, f_target: Decoder | Mapping[str, Decoder], dim: int, *,
                        id_col: str = "id", vec: str = "z", n_dirs: int = K.N_DIRECTIONS,
                        eps: float = K.FINITE_DIFFERENCE_EPS, seed: int = 0) -> DataFrame:
    """M9: finite-difference output change of user functions per (entity, direction).

    Directions are keyed by the entity, so no direction table is joined and perturbed points are never
    shuffled: a task evaluates its base points once and all their perturbations in one call per function.
    Several named targets share the same perturbations and give one row each (column ``target``).
    """
    kind = latents.schema[id_col].dataType.simpleString()
    rows = widen(latents).select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("z"))
    named = isinstance(f_target, Mapping)
    targets = dict(f_target) if named else {"": f_target}

    def run(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), 64):
                part = pdf.iloc[lo:lo + 64]
                z, ids = np.stack(part["z"].to_numpy()), part["id"].to_numpy()
                moved = (z[:, None, :] + eps * direction_block(ids, dim, n_dirs, seed)).reshape(-1, dim)
                render = _change(f_render, z, moved, n_dirs, eps)
                for name, f in targets.items():
                    out = {"id": np.repeat(ids, n_dirs), "direction": np.tile(np.arange(n_dirs, dtype="int32"), len(z)),
                           "render_mag": render, "target_mag": _change(f, z, moved, n_dirs, eps)}
                    yield pd.DataFrame({**out, "target": name} if named else out)

    return rows.mapInPandas(run, f"id {kind}, direction int, render_mag double, target_mag double" + (", target string" if named else ""))


def coherence(mags: DataFrame, entity: str = "id", by: Sequence[str] = (), x: str = "render_mag",
              y: str = "target_mag") -> DataFrame:
    """Correlation of the two responses over directions, averaged over entities."""
    per = mags.groupBy(*by, entity).agg(pearson(x, y, min_points=1).alias("score"))
    return per.groupBy(*by).agg(F.avg("score").alias("coherence"), F.count("score").alias("n_samples"))


def coherence_alignment_loss(mags: DataFrame, x: str = "render_mag", y: str = "target_mag", by: Sequence[str] = ()) -> DataFrame:
    """One minus the correlation over all (sample, direction) points."""
    return mags.groupBy(*by).agg((F.lit(1.0) - pearson(x, y)).alias("loss"))


def independent_magnitudes(pairs: DataFrame, f_render: Decoder, f_target: Decoder | Mapping[str, Decoder], dim_render: int,
                           dim_target: int, *, id_col: str = "id", render: str = "z_render", target: str = "z_target",
                           **options) -> DataFrame:
    """Joint latent of two separate models; each function reads its own half, so coherence is about 0."""
    joint = pairs.select(id_col, F.concat(F.col(render).cast("array<double>"), F.col(target).cast("array<double>")).alias("z"))
    half = lambda f: lambda z: f(z[:, dim_render:])
    own = {n: half(f) for n, f in f_target.items()} if isinstance(f_target, Mapping) else half(f_target)
    return response_magnitudes(joint, lambda z: f_render(z[:, :dim_render]), own, dim_render + dim_target, id_col=id_col, **options)


def compare(shared: DataFrame, independent: DataFrame, untrained: DataFrame | None = None, by: Sequence[str] = ("target",)) -> DataFrame:
    """Shared, independent and (optional) architectural coherence per target, from magnitude tables."""
    by = list(by)
    out = coherence(shared, by=by).withColumnRenamed("coherence", "shared_coherence")
    out = out.join(coherence(independent, by=by).select(*by, F.col("coherence").alias("independent_coherence")), by)
    out = out.withColumn("gap", F.col("shared_coherence") - F.col("independent_coherence"))
    if untrained is not None:
        arch = coherence(untrained, by=by).select(*by, F.col("coherence").alias("architectural_coherence"))
        out = out.join(arch, by).withColumn("learned_coherence", F.col("shared_coherence") - F.col("architectural_coherence"))
    return out


def compare_models(latents: DataFrame, arms: Mapping[str, Mapping[str, tuple[Decoder, Decoder]]], dim: int, *, id_col: str = "id", vec: str = "z",
                   n_dirs: int = K.N_DIRECTIONS, eps: float = K.FINITE_DIFFERENCE_EPS, seed: int = 0) -> DataFrame:
    """M11 for arms that read one (joint) latent: what :func:`compare` gives, from one pass over the perturbations.

    ``arms`` has ``shared``, ``independent`` and, if wanted, ``untrained``, each with (render, target) functions by target
    name. Entries of a direction are keyed by position, so a function that reads the first entries of a joint latent sees
    the perturbations that it would see alone. Equal functions are evaluated once.
    """
    functions = list(dict.fromkeys(f for pairs in arms.values() for pair in pairs.values() for f in pair))
    mags = [f"mag_{i}" for i in range(len(functions))]
    mag = dict(zip(functions, mags))
    kind = latents.schema[id_col].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), 64):
                part = pdf.iloc[lo:lo + 64]
                z, ids = np.stack(part["z"].to_numpy()), part["id"].to_numpy()
                moved = (z[:, None, :] + eps * direction_block(ids, dim, n_dirs, seed)).reshape(-1, dim)
                changes = {m: _change(f, z, moved, n_dirs, eps) for f, m in zip(functions, mags)}
                yield pd.DataFrame({"id": np.repeat(ids, n_dirs), **changes})

    rows = widen(latents).select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("z"))
    moved = rows.mapInPandas(run, f"id {kind}, " + ", ".join(f"{m} double" for m in mags))
    used = list(dict.fromkeys((mag[x], mag[y]) for pairs in arms.values() for x, y in pairs.values()))
    score = {pair: f"score_{i}" for i, pair in enumerate(used)}
    per = moved.groupBy("id").agg(*[pearson(*pair, min_points=1).alias(name) for pair, name in score.items()])
    means = per.agg(*[F.avg(name).alias(name) for name in score.values()], F.count(F.lit(1)).alias("n"))
    of = lambda arm, target: F.col(score[tuple(mag[f] for f in arms[arm][target])])
    out = []
    for target in arms["shared"]:
        shared, independent = of("shared", target), of("independent", target)
        columns = [F.lit(target).alias("target"), shared.alias("shared_coherence"), F.col("n").alias("n_samples"),
                   independent.alias("independent_coherence"), (shared - independent).alias("gap")]
        if "untrained" in arms:
            untrained = of("untrained", target)
            columns += [untrained.alias("architectural_coherence"), (shared - untrained).alias("learned_coherence")]
        out.append(F.struct(*columns))
    return means.select(F.inline(F.array(*out)))


def coherence_experiment(runs: DataFrame, value: str = "coherence", kind: str = "kind", by: Sequence[str] = ("target",),
                         independent: DataFrame | None = None) -> DataFrame:
    """Trained and untrained spread over seeds, learned coherence, band test, gap to the control.

    ``independent`` holds one control value per ``by`` group (column ``independent_baseline``).
    """
    by = list(by)
    only = lambda k: runs.where(F.col(kind) == k).groupBy(*by)
    t = only("trained").agg(*describe(value, "trained_"))
    a = only("untrained").agg(*describe(value, "untrained_"))
    out = t.join(a, by).withColumn("learned", F.col("trained_mean") - F.col("untrained_mean")).withColumn(
        "clears_band", F.col("learned") > F.col("trained_sd") + F.col("untrained_sd"))
    if independent is not None:
        out = out.join(independent, by, "left").withColumn("gap_vs_independent", F.col("trained_mean") - F.col("independent_baseline"))
    return out
