"""Agreement of discrete codes: relabeled match rate and its null, mutual information, adjusted Rand."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probelake import constants as K
from probelake.functions.scalars import col
from probelake.operators.ranking import exact_percentiles
from probelake.session import with_scalars

TRITS = (-1, 0, 1)
RELABELINGS = tuple(permutations(TRITS))


def check_code(code) -> Column:
    """the code itself, or an error when an entry is outside {-1, 0, 1}."""
    ok = F.forall(col(code), lambda v: v.isin(*TRITS))
    return F.when(ok, col(code)).otherwise(F.raise_error(F.lit("code values must be -1, 0 or 1")).cast("array<int>"))


def code_marginals(df: DataFrame, code: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts of the three code values."""
    names = {-1: "n_minus", 0: "n_zero", 1: "n_plus"}
    return df.groupBy(*by).agg(*[F.count_if(F.col(code) == v).alias(names[v]) for v in TRITS])


def contingency(df: DataFrame, a: str, b: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Joint counts of two labels: all later statistics read this small table, never the rows again.

    With ``weight`` a row stands for that many rows.
    """
    n = F.sum(weight) if weight else F.count(F.lit(1))
    return df.groupBy(*by, F.col(a).alias("a"), F.col(b).alias("b")).agg(n.alias("n"))


def _count_where(condition: Column, weight: str | None) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col(weight))), F.lit(0).cast("bigint")) if weight else F.count_if(condition)


def trit_agreement(df: DataFrame, a: str, b: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Best match rate over the six relabelings of a's values, and the first relabeling (images of
    -1, 0, 1) that reaches it. One aggregate with six counters; ``weight``: rows that a row stands for."""
    aggs = []
    for i, perm in enumerate(RELABELINGS):
        mapped = F.when(F.col(a) == TRITS[0], perm[0]).when(F.col(a) == TRITS[1], perm[1]).when(
            F.col(a) == TRITS[2], perm[2])
        aggs.append(_count_where(F.col(b) == mapped, weight).alias(f"_h{i}"))
    valid = F.count_if(~(F.col(a).isin(*TRITS) & F.col(b).isin(*TRITS))).alias("_bad")
    counts = df.groupBy(*by).agg(_count_where(F.lit(True), weight).alias("n"), valid, *aggs)
    best = F.array_max(F.array(*[
        F.struct(F.col(f"_h{i}").alias("hits"), F.lit(-i).alias("order"),
                 F.lit(",".join(map(str, perm))).alias("relabeling")) for i, perm in enumerate(RELABELINGS)]))
    rate = F.when(F.col("_bad") > 0, F.raise_error(F.lit("code values must be -1, 0 or 1")).cast("double")).otherwise(
        F.try_divide(best["hits"].cast("double"), F.col("n")))
    return counts.select(*by, rate.alias("agreement"), best["relabeling"].alias("relabeling"), "n")


def trit_agreement_null(df: DataFrame, a: str, b: str, draws: int = K.NULL_DRAWS, seed: int = K.NULL_SEED,
                        by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Mean and 95th percentile of the agreement when b is shuffled.

    Shuffling one side leaves both margins fixed, so the joint table of a shuffle is a draw from the
    multivariate hypergeometric law of the margins. Each draw therefore needs six counts and no rows:
    the cost is draws, whatever the size of the table.
    """
    by = list(by)
    margin = lambda c, name: [_count_where(F.col(c) == v, weight).alias(f"{name}{i}") for i, v in enumerate(TRITS)]
    margins = df.groupBy(*by).agg(*margin(a, "a"), *margin(b, "b"), _count_where(F.lit(True), weight).alias("n"))
    n_draws = margins.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    keyed = n_draws.withColumn("draw_seed", F.xxhash64(F.lit(seed), F.col("draw"), *by))
    kinds = "".join(f"{c} {df.schema[c].dataType.simpleString()}, " for c in by)

    def simulate(batches):
        for pdf in batches:
            rates = np.empty(len(pdf))
            for i, r in enumerate(pdf.itertuples(index=False)):
                rng = np.random.default_rng(r.draw_seed % (2 ** 63))
                left = np.array([r.b0, r.b1, r.b2], dtype=np.int64)
                table = np.zeros((3, 3))
                for row, size in enumerate((r.a0, r.a1, r.a2)):
                    table[row] = _hypergeometric(rng, left, int(size))
                    left = left - table[row].astype(np.int64)
                best = max(sum(table[i, TRITS.index(perm[i])] for i in range(3)) for perm in RELABELINGS)
                rates[i] = best / r.n if r.n else 0.0
            yield pd.DataFrame({**{c: pdf[c] for c in by}, "agreement": rates})

    sims = keyed.mapInPandas(simulate, kinds + "agreement double")
    p95 = exact_percentiles(sims, "agreement", [0.95], by)
    mean = sims.groupBy(*by).agg(F.avg("agreement").alias("null_mean"), F.count(F.lit(1)).alias("draws"))
    if by:
        return mean.join(p95.select(*by, F.col("percentile").alias("null_p95")), by)
    return with_scalars(mean, p95.select(F.col("percentile").alias("null_p95")))


def _hypergeometric(rng, colors, size: int):
    """One multivariate hypergeometric draw, color by color, by inversion at every size of the population."""
    out, left, need = [], int(colors.sum()), size
    for c in colors[:-1]:
        x = inverse_hypergeometric(rng.random(), int(c), left - int(c), need)
        out.append(x)
        left, need = left - int(c), need - x
    return np.array([*out, need])


def inverse_hypergeometric(u: float, good: int, bad: int, draws: int) -> int:
    """The quantile ``u`` of the number of good ones among ``draws``, from the exact ratios of neighbouring
    probabilities within twelve standard deviations of the mode (what lies outside is below 1e-30)."""
    low, high = max(0, draws - bad), min(good, draws)
    if low >= high:
        return low
    n = good + bad
    mode = (draws + 1) * (good + 1) // (n + 2)
    sd = (draws * (good / n) * (bad / n) * ((n - draws) / max(n - 1, 1))) ** 0.5
    reach = int(12 * sd) + 30
    k = np.arange(max(low, mode - reach), min(high, mode + reach), dtype=np.float64)
    steps = np.log((good - k) * (draws - k)) - np.log((k + 1) * (bad - draws + k + 1))
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    total = np.cumsum(np.exp(logs - logs.max()))
    return max(low, mode - reach) + int(np.searchsorted(total, u * total[-1]))


def mutual_information(df: DataFrame, x: str, y: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Plug-in mutual information in nats, from the joint table."""
    by = list(by)
    joint = contingency(df, x, y, by, weight)
    px = joint.groupBy(*by, "a").agg(F.sum("n").alias("na"))
    py = joint.groupBy(*by, "b").agg(F.sum("n").alias("nb"))
    total = joint.groupBy(*by).agg(F.sum("n").alias("total"))
    full = joint.join(px, [*by, "a"]).join(py, [*by, "b"])
    full = full.join(total, by) if by else with_scalars(full, total)
    p = F.col("n") / F.col("total")
    return full.groupBy(*by).agg(
        F.sum(p * F.log(F.col("n") * F.col("total") / (F.col("na") * F.col("nb").cast("double")))).alias("mi"))


def adjusted_rand(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Chance-adjusted agreement of two partitions (labels of any type); degenerate partitions give 1."""
    by = list(by)
    joint = contingency(df.select(*by, F.to_json(F.struct(a)).alias("_a"), F.to_json(F.struct(b)).alias("_b")), "_a", "_b", by)
    pairs = lambda n: F.sum(F.col(n) * (F.col(n) - 1) / F.lit(2.0))
    cells = joint.groupBy(*by).agg(pairs("n").alias("both"), F.sum("n").alias("n"))
    side = lambda c: joint.groupBy(*by, c).agg(F.sum("n").alias("m")).groupBy(*by).agg(pairs("m").alias(f"pairs_{c}"))
    if by:
        t = cells.join(side("a"), by).join(side("b"), by)
    else:
        t = with_scalars(with_scalars(cells, side("a")), side("b"))
    all_pairs = F.col("n") * (F.col("n") - 1) / F.lit(2.0)
    expected = F.try_divide(F.col("pairs_a") * F.col("pairs_b"), all_pairs)
    top = (F.col("pairs_a") + F.col("pairs_b")) / 2.0
    return t.select(*by, F.coalesce(F.try_divide(F.col("both") - expected, top - expected), F.lit(1.0)).alias("ari"), "n")


MAX_CODE_WIDTH = 39  # trits of one code that fit a 64-bit number


def code_number(code) -> Column:
    """A ternary code as one number whose remainder by 3^k is the number of its first k digits."""
    powers = F.array(*[F.lit(3 ** i).cast("bigint") for i in range(MAX_CODE_WIDTH)])
    digits = F.transform(check_code(code), lambda c, i: (c + 1).cast("bigint") * F.get(powers, i))
    wide = F.raise_error(F.lit(f"codes of more than {MAX_CODE_WIDTH} digits")).cast("bigint")
    return F.when(F.size(col(code)) <= MAX_CODE_WIDTH, F.aggregate(digits, F.lit(0).cast("bigint"), lambda s, d: s + d)).otherwise(wide)


def adjusted_rand_by_width(cells: DataFrame, widths: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """A27 for the partitions by the first 1, 2, 4, ... digits of two codes: (by, width, ari, n).

    ``cells`` is the joint table of the whole codes (``a``, ``b`` by :func:`code_number`, count ``n``). A coarser
    partition merges cells of a finer one, so all widths and all margins are rolled up from this one table.
    """
    by = list(by)
    power = F.when(F.lit(False), F.lit(0).cast("bigint"))
    for w in widths:
        power = power.when(F.col("width") == w, F.lit(3 ** w).cast("bigint"))
    rolled = cells.withColumn("width", F.explode(F.array(*map(F.lit, widths)))).select(*by, "width", (F.col("a") % power).alias("a"), (F.col("b") % power).alias("b"), "n")
    keys = [*by, "width"]
    sums = rolled.groupingSets([[*keys, "a", "b"], [*keys, "a"], [*keys, "b"]], *keys, "a", "b").agg(
        F.sum("n").alias("m"), F.grouping("a").alias("_no_a"), F.grouping("b").alias("_no_b"))
    both = (F.col("_no_a") == 0) & (F.col("_no_b") == 0)
    pairs = lambda which: F.sum(F.when(which, F.col("m") * (F.col("m") - 1.0) / F.lit(2.0)))
    t = sums.groupBy(*keys).agg(pairs(both).alias("both"), pairs(F.col("_no_b") == 1).alias("pairs_a"), pairs(F.col("_no_a") == 1).alias("pairs_b"),
                                F.sum(F.when(both, F.col("m"))).alias("n"))
    expected = F.try_divide(F.col("pairs_a") * F.col("pairs_b"), F.col("n") * (F.col("n") - 1.0) / F.lit(2.0))
    top = (F.col("pairs_a") + F.col("pairs_b")) / 2.0
    return t.select(*keys, F.coalesce(F.try_divide(F.col("both") - expected, top - expected), F.lit(1.0)).alias("ari"), "n")


def tercile_labels(df: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """A28 for several numeric columns at once: (key, factor, label), the label being 0, 1 or 2; null values are left out.

    The columns are laid out in rows, so one range sort finds the cuts of all of them.
    """
    long = df.select(key, F.explode(F.array(*[F.struct(F.lit(v).alias("factor"), F.col(v).cast("double").alias("value")) for v in values])).alias("f")).select(key, "f.*").where("value IS NOT NULL")
    cuts = F.broadcast(tercile_cuts(long, "value", ["factor"]))  # one row for each name in ``values``
    label = (F.col("value") > F.col("q1")).cast("int") + (F.col("value") > F.col("q2")).cast("int")
    return long.join(cuts, "factor").select(key, "factor", label.alias("label"))


def tercile_cuts(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """The two linear-interpolated tercile cuts per group: columns ``q1``, ``q2``."""
    cuts = exact_percentiles(df, value, [1.0 / 3.0, 2.0 / 3.0], by)
    return cuts.groupBy(*by).agg(
        F.min_by("percentile", "fraction").alias("q1"), F.max_by("percentile", "fraction").alias("q2"))


def terciles(df: DataFrame, value: str, out: str = "tercile") -> DataFrame:
    """0, 1, 2 by strict comparison with the tercile cuts (one row, read once)."""
    q = tercile_cuts(df, value).first()
    v = F.col(value)
    return df.withColumn(out, (v > q["q1"]).cast("int") + (v > q["q2"]).cast("int"))
