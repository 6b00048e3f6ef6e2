"""Statistics over runs and arms: correlations, spreads, t statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probelake.functions.scalars import col
from probelake.operators.ranking import sorted_rank

NAN = float("nan")


def pearson(x, y, min_points: int = 2) -> Column:
    """Correlation aggregate, 0.0 when a side is constant. Pairs with a missing side are left out."""
    both = col(x).isNotNull() & col(y).isNotNull()
    a, b = F.when(both, col(x)), F.when(both, col(y))
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return F.when(F.count(a) < min_points, F.raise_error(F.lit("correlation has too few points")).cast("double")).otherwise(
        F.coalesce(r, F.lit(0.0)))


def spearman(df: DataFrame, x: str, y: str, tie: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Pearson of ordinal ranks; ties keep the order of ``tie`` and are not averaged."""
    rx = sorted_rank(df.select(*by, *tie, x, y), [x, *tie], by, out="_rx")
    rxy = sorted_rank(rx, [y, *tie], by, out="_ry")
    return rxy.groupBy(*by).agg(
        pearson(F.col("_rx").cast("double"), F.col("_ry").cast("double")).alias("rho"), F.count(x).alias("n"))


def describe(value, prefix: str = "") -> list[Column]:
    """Mean, population sd (0 for one value), min, max, n."""
    v = col(value)
    return [F.avg(v).alias(prefix + "mean"), F.coalesce(F.stddev_pop(v), F.lit(0.0)).alias(prefix + "sd"),
            F.min(v).alias(prefix + "min"), F.max(v).alias(prefix + "max"), F.count(v).alias(prefix + "n")]


def sample_sd(value) -> Column:
    """Sample sd, 0 for one value."""
    return F.coalesce(F.stddev_samp(col(value)), F.lit(0.0))


def welch(mean_a, sd_a, n_a, mean_b, sd_b, n_b) -> Column:
    """Unequal-variance t from means, sds and counts; NaN when a side has < 2 values or no spread."""
    na, nb = col(n_a).cast("double"), col(n_b).cast("double")
    se = F.sqrt(F.try_divide(col(sd_a) * col(sd_a), na) + F.try_divide(col(sd_b) * col(sd_b), nb))
    return F.when((na >= 2) & (nb >= 2) & (se > 0), (col(mean_a) - col(mean_b)) / se).otherwise(F.lit(NAN))


def welch_between(df: DataFrame, value: str, group: str, a: str, b: str, by: Sequence[str] = (),
                  spread: str = "sample") -> DataFrame:
    """A15 (``sample``) / A16 (``population`` sd, as the reports store it): t of group a against group b."""
    v = {g: F.when(F.col(group) == g, F.col(value)) for g in (a, b)}
    sd = sample_sd if spread == "sample" else (lambda c: F.coalesce(F.stddev_pop(c), F.lit(0.0)))
    rows = df.where(F.col(group).isin(a, b)).groupBy(*by).agg(
        F.avg(v[a]).alias("mean_a"), sd(v[a]).alias("sd_a"), F.count(v[a]).alias("n_a"),
        F.avg(v[b]).alias("mean_b"), sd(v[b]).alias("sd_b"), F.count(v[b]).alias("n_b"))
    return rows.withColumn("diff", F.col("mean_a") - F.col("mean_b")).withColumn(
        "t", welch("mean_a", "sd_a", "n_a", "mean_b", "sd_b", "n_b"))


def one_sample_t(value) -> Column:
    """Mean over its standard error; NaN for < 2 values or no spread."""
    v = col(value)
    n, sd = F.count(v), F.coalesce(F.stddev_samp(v), F.lit(0.0))
    return F.when((n >= 2) & (sd > 0), F.try_divide(F.avg(v), F.try_divide(sd, F.sqrt(n.cast("double"))))).otherwise(
        F.lit(NAN))


def learned(df: DataFrame, value: str, kind: str, by: Sequence[str]) -> DataFrame:
    """Trained mean minus untrained mean per arm, and whether it clears both spreads."""
    t, u = (F.when(F.col(kind) == k, F.col(value)) for k in ("trained", "untrained"))
    pop = lambda c: F.coalesce(F.stddev_pop(c), F.lit(0.0))
    rows = df.groupBy(*by).agg(
        F.avg(t).alias("trained_mean"), pop(t).alias("trained_sd"), F.count(t).alias("n_trained"),
        F.avg(u).alias("untrained_mean"), pop(u).alias("untrained_sd"), F.count(u).alias("n_untrained"))
    return rows.withColumn("learned", F.col("trained_mean") - F.col("untrained_mean")).withColumn(
        "clears_band", F.col("learned") > F.col("trained_sd") + F.col("untrained_sd"))


def learned_per_seed(df: DataFrame, value: str, kind: str, arm: str, seed: str) -> DataFrame:
    """A22 per seed: every trained value minus the untrained mean of its arm."""
    base = df.where(F.col(kind) == "untrained").groupBy(arm).agg(F.avg(value).alias("untrained_mean"))
    return df.where(F.col(kind) == "trained").join(base, arm, "left").select(
        arm, seed, (F.col(value) - F.col("untrained_mean")).alias("learned"))
