"""Losses and scores: mean squared errors, gains over predict-the-mean, imputed prediction scoring."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probelake import constants as K
from probelake.functions.scalars import col, sq_dist


def _checked_sse(pred, target) -> Column:
    same = F.size(col(pred)) == F.size(col(target))
    return F.when(same, sq_dist(pred, target)).otherwise(F.raise_error(F.lit("row length mismatch")).cast("double"))


def mse(pred, target) -> Column:
    """A5: mean over all entries of all rows; ragged or empty input is an error."""
    n = F.sum(F.size(col(target)))
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.raise_error(F.lit("empty batch")).cast("double")).otherwise(
        F.sum(_checked_sse(pred, target)) / n)


def per_field_mse(df: DataFrame, pred: str, target: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean squared error per output dimension (``pos``)."""
    errors = F.zip_with(F.col(pred), F.col(target), lambda p, t: (p - t) * (p - t))
    return df.select(*by, F.posexplode(errors).alias("pos", "e")).groupBy(*by, "pos").agg(F.avg("e").alias("mse"))


def flatten_sample(x, depth: int) -> Column:
    """A nested image array as one flat vector."""
    for _ in range(depth - 1):
        x = F.flatten(col(x))
    return col(x)


def combined_loss(heads: Mapping[str, tuple[str, str]], weights: Mapping[str, float] | None = None) -> list[Column]:
    """Component losses and their weighted total, as aggregates.

    ``heads`` maps behavior / essence / render / appearance to (prediction, target) columns. The
    appearance term takes part only with a weight above zero.
    """
    w = {"behavior": 1.0, "essence": 0.3, "render": 1.0, "appearance": 0.0, **(weights or {})}
    used = {h: mse(*cols) for h, cols in heads.items() if h != "appearance" or w[h] > 0}
    total = sum((w[h] * m for h, m in used.items()), F.lit(0.0))
    return [m.alias(h) for h, m in used.items()] + [total.alias("total")]


def evaluate_split(df: DataFrame, heads: Mapping[str, tuple[str, str]], split: str = "split") -> DataFrame:
    """Head errors per split; batch-size weights cancel, so this is the plain mean over entries."""
    return df.groupBy(split).agg(*[mse(*cols).alias(f"{h}_mse") for h, cols in heads.items()],
                                 F.count(F.lit(1)).alias("n"))


def field_errors(df: DataFrame, target: str, pred: str, split: str = "split", by: Sequence[str] = ()) -> DataFrame:
    """Per field: train mean, baseline error (predict the train mean) and prediction error, in one pass.

    Errors are on test; the ``train_`` pair measures the train rows themselves.

    ``mean((y - m)^2) = var(y) + (mean(y) - m)^2`` lets a single grouped aggregate serve both splits.
    """
    zipped = F.arrays_zip(F.col(target).alias("y"), F.col(pred).alias("p"))
    rows = df.select(*by, split, F.posexplode(zipped).alias("pos", "v")).select(
        *by, split, "pos", F.col("v")["y"].alias("y"), F.col("v")["p"].alias("p"))
    tr, te = F.col(split) == "train", F.col(split) == "test"
    y_tr, y_te, err = F.when(tr, F.col("y")), F.when(te, F.col("y")), F.col("y") - F.col("p")
    stats = rows.groupBy(*by, "pos").agg(
        F.avg(y_tr).alias("train_mean"), F.avg(y_te).alias("_m"), F.var_pop(y_te).alias("_v"),
        F.avg(F.when(te, err * err)).alias("mse"), F.count(y_te).alias("n_test"),
        F.var_pop(y_tr).alias("train_baseline_mse"), F.avg(F.when(tr, err * err)).alias("train_mse"))
    away = F.col("_m") - F.col("train_mean")
    return stats.withColumn("baseline_mse", F.col("_v") + away * away).drop("_m", "_v")


def ratio(base, mse_, zero: str = "inf") -> Column:
    """Gain with the chosen meaning of a zero error: ``inf`` or ``null``."""
    limit = F.lit(float("inf")) if zero == "inf" else F.lit(None).cast("double")
    return F.when(col(mse_) > 0, F.try_divide(col(base), col(mse_))).otherwise(limit)


def gain(df: DataFrame, target: str, pred: str, split: str = "split", by: Sequence[str] = (),
         zero: str = "inf") -> DataFrame:
    """Error of predicting the train mean over the error of the prediction, on test."""
    per = field_errors(df, target, pred, split, by)
    out = per.groupBy(*by).agg(F.avg("baseline_mse").alias("baseline_mse"), F.avg("mse").alias("mse"))
    return out.withColumn("gain", ratio("baseline_mse", "mse", zero))


def per_field_gain(df: DataFrame, target: str, pred_a: str, pred_b: str, split: str = "split") -> DataFrame:
    """A10: gain of two predictions per field (error floor 1e-12) and their difference."""
    floor = lambda c: F.col("baseline_mse") / F.greatest(F.col(c), F.lit(K.GAIN_DENOMINATOR_FLOOR))
    a = field_errors(df, target, pred_a, split).select("pos", "baseline_mse", F.col("mse").alias("mse_a"))
    b = field_errors(df, target, pred_b, split).select("pos", F.col("mse").alias("mse_b"))
    both = a.join(b, "pos").select("pos", floor("mse_a").alias("gain_a"), floor("mse_b").alias("gain_b"))
    return both.withColumn("delta", F.col("gain_b") - F.col("gain_a"))


# ---------------------------------------------------------------- outcome predictions
def melt_outcomes(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """One row per (key, outcome field)."""
    pairs = [F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias(value)) for f in K.OUTCOME_FIELDS]
    return df.select(*keys, F.explode(F.array(*pairs)).alias("_e")).select(*keys, "_e.*")


def train_mean_outcomes(train: DataFrame, probe: str = "probe") -> DataFrame:
    """A4: mean per (probe, field) over train; 0 for probes that never occur. Always 21 rows."""
    wide = train.where(F.col(probe).isin(*K.PROBE_ORDER)).groupBy(F.col(probe).alias("probe")).agg(
        *[F.avg(F.col(f).cast("double")).alias(f) for f in K.OUTCOME_FIELDS])
    names = F.array(*[F.lit(p) for p in K.PROBE_ORDER])
    grid = train.sparkSession.range(1).select(F.explode(names).alias("probe"))
    melted = melt_outcomes(grid.join(wide, "probe", "left"), ["probe"], "train_mean")
    return melted.withColumn("train_mean", F.coalesce("train_mean", F.lit(0.0)))


def score_predictions(rows: DataFrame, train_mean: DataFrame) -> DataFrame:
    """Score (scene_id, probe, prediction STRUCT or null, truth STRUCT) rows.

    Errors are normalized per field; a missing prediction takes the train mean and is counted; a probe or
    field without a train mean is an error. Result: one row overall, per probe, and per (probe, field);
    ``brier`` looks at push.toppled only.
    """
    def entry(f):
        return F.struct(F.lit(f).alias("field"), F.col("prediction")[f].cast("double").alias("pred"),
                        F.col("truth")[f].cast("double").alias("truth"),
                        F.lit(K.OUTCOME_NORMALIZERS[f]).alias("scale"))

    long = rows.select("probe", F.col("prediction").isNull().alias("_failed"),
                       F.explode(F.array(*[entry(f) for f in K.OUTCOME_FIELDS])).alias("_e"))
    entries = long.select("probe", "_failed", "_e.*").join(
        F.broadcast(train_mean.select("probe", "field", "train_mean")), ["probe", "field"], "left")  # J11: 21 rows by construction
    message = F.concat(F.lit("no train mean for "), F.coalesce("probe", F.lit("null")), F.lit("."), "field")
    entries = entries.withColumn("train_mean", F.when(F.col("train_mean").isNull(), F.raise_error(message).cast("double")).otherwise(
        F.col("train_mean")))
    p = F.coalesce("pred", "train_mean")
    square = lambda x: F.pow((x - F.col("truth")) / F.col("scale"), F.lit(2.0))
    is_brier = (F.col("probe") == "push") & (F.col("field") == "toppled")
    clipped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), p)) - F.col("truth")
    first = F.col("field") == K.OUTCOME_FIELDS[0]
    entries = entries.select(
        "probe", "field", square(p).alias("_err"), square(F.col("train_mean")).alias("_base"),
        F.when(is_brier, clipped * clipped).alias("_brier"), F.col("pred").isNull().alias("_imputed"),
        (first & F.col("_failed")).alias("_fail"), first.alias("_row"))
    out = entries.rollup("probe", "field").agg(
        F.count_if("_row").alias("n_rows"), F.count_if("_fail").alias("n_parse_failures"),
        F.count_if("_imputed").alias("n_imputed_fields"), F.avg("_err").alias("mse"),
        F.avg("_base").alias("baseline_mse"), F.avg("_brier").alias("push_toppled_brier"))
    return out.withColumn("gain_over_mean", ratio("baseline_mse", "mse", "null"))


def error_profile(df: DataFrame, value: str, field: str, scale: Column, by: Sequence[str] = ()) -> DataFrame:
    """Median, 99th percentile, maximum, and share beyond ten normalizers, per field."""
    from probelake.operators.ranking import exact_percentiles

    keys = [*by, field]
    cuts = exact_percentiles(df, value, [0.5, 0.99], keys).groupBy(*keys).agg(
        F.min_by("percentile", "fraction").alias("median"), F.max_by("percentile", "fraction").alias("p99"))
    rest = df.groupBy(*keys).agg(F.max(value).alias("max"),
                                 F.avg((F.col(value) > 10.0 * scale).cast("double")).alias("beyond_10x"))
    return cuts.join(rest, keys)


# ---------------------------------------------------------------- study statistics
def retention(trained: DataFrame, untrained: DataFrame, channel: str = "channel", r2: str = "r2",
              present: float = 0.1) -> DataFrame:
    """Trained over untrained R2 per channel; channels the baseline cannot decode are NaN."""
    t = trained.groupBy(channel).agg(F.avg(r2).alias("trained"), F.stddev_pop(r2).alias("trained_sd"))
    u = untrained.groupBy(channel).agg(F.avg(r2).alias("untrained"))
    both = t.join(u, channel)
    return both.withColumn("retention", F.when(F.col("untrained") > present, F.col("trained") / F.col("untrained"))
                           .otherwise(F.lit(float("nan"))))


def extraction_fraction(df: DataFrame, gain_: str, shape_gain: str, ceiling: str) -> DataFrame:
    """Share of the reachable gain that was extracted; NaN when nothing is reachable."""
    reach = F.col(ceiling) - F.col(shape_gain)
    return df.withColumn("fraction", F.when(reach > 0, (F.col(gain_) - F.col(shape_gain)) / reach).otherwise(
        F.lit(float("nan"))))


def delta(df: DataFrame, gain_: str, shape_gain: str, by: Sequence[str], threshold: float = 0.15) -> DataFrame:
    """Gain beyond the shape-only gain: mean, spread, and how many seeds exceed the threshold."""
    d = F.col(gain_) - F.col(shape_gain)
    return df.groupBy(*by).agg(F.avg(d).alias("delta"), F.coalesce(F.stddev_samp(d), F.lit(0.0)).alias("delta_sd"),
                               F.count_if(d > threshold).alias("seeds_over"), F.count(d).alias("n_seeds"))
