"""Mixing sources to target weights by hierarchical budgeting.

The leaves of a domain / language / source tree hold tokens; a leaf can be read a number of epochs. A token budget
goes down the tree in proportion to the weights of the children. A child whose subtree cannot take its share gets
what it can take, and the shortage goes to its siblings, again by weight; because a subtree's capacity is the sum
of its leaves, what siblings can absorb never leaves their parent, and only the rest reaches the ancestors' other
children. All divisions are whole tokens; the tokens lost by rounding down go one each to the first children that
have room. Each leaf then reads whole epochs and, of its last epoch, the token prefix in a seeded order.

The tree is aggregated before anything else, so a level is one window over the children of a node. A leaf may hold
any share of the rows: its prefix is found in a histogram of the seeded order, and only documents of the one bucket
that holds the cut are put in order.

Defined results: a null domain, language or source is a node of its own named ``NONE``; null or negative token
counts count as 0, and such documents belong to every epoch prefix that reaches their place; a weight that is not
given is 1; rows that repeat a key are taken one after the other. Other columns pass through ``mix`` whatever
their names. An empty table gives an empty result; a budget above all capacity takes everything.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probelake.session import scratch_path, small

NONE = "(none)"
LEVELS = ("domain", "lang", "source")
BUCKET_DIGITS = 3  # hex digits of the seeded order: 4096 buckets a leaf


def seeded_order(seed: int, epoch: Column, key: Column) -> Column:
    """Hex text that orders the documents of an epoch."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), key.cast("string")))


def weight_column(level: str, weights: Mapping[str, int]) -> Column:
    """Whole weight of a node by its name; 1 where none is given."""
    out = F.lit(1)
    for name, w in weights.items():
        out = F.when(F.col(level) == name, F.lit(w)).otherwise(out)
    return out.cast("decimal(38,0)")


def pour(children: DataFrame, parent: Sequence[str], name: str) -> DataFrame:
    """Share ``budget`` (equal for all children of a parent) by ``weight`` under ``capacity``; adds ``share``.

    Children ordered by capacity per weight fill up one after the other: a child is full when, with all smaller
    ones full, the rest of the budget would give it its capacity or more. Budget and weights are decimals.
    """
    whole = Window.partitionBy(*parent)
    order = whole.orderBy(F.col("capacity").cast("double") / F.col("weight").cast("double"), name)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    big = "decimal(38,0)"
    step = children.withColumns({
        "_below": F.coalesce(F.sum("capacity").over(upto).cast(big) - F.col("capacity"), F.lit(0).cast(big)),
        "_rest": (F.sum("weight").over(whole) - F.sum("weight").over(upto) + F.col("weight")).cast(big),
    })
    full = F.col("capacity") * F.col("_rest") <= (F.col("budget") - F.col("_below")) * F.col("weight")
    step = step.withColumn("_full", full)
    step = step.withColumns({
        "_left": (F.col("budget") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("capacity"))).over(whole), F.lit(0))).cast(big),
        "_open": F.sum(F.when(~F.col("_full"), F.col("weight"))).over(whole).cast(big),
    })
    # whole division of decimals: a double quotient is corrected by its remainder
    exact = F.expr("CAST(_left * weight AS DECIMAL(38,0)) div _open")
    step = step.withColumn("_part", F.when(F.col("_full"), F.col("capacity")).otherwise(exact.cast(big)))
    step = step.withColumn("_lost", F.col("_left") - F.coalesce(F.sum(F.when(~F.col("_full"), F.col("_part"))).over(whole), F.lit(0)))
    turn = F.sum(F.when(F.col("_full"), 0).otherwise(1)).over(whole.orderBy(name))
    extra = F.when(~F.col("_full") & (turn <= F.col("_lost")), 1).otherwise(0)
    return step.withColumn("share", (F.col("_part") + extra).cast(big)).drop("_below", "_rest", "_full", "_left", "_open", "_part", "_lost")


def leaf_budgets(leaves: DataFrame, total: int, weights: Mapping[str, Mapping[str, int]], max_epochs: int) -> DataFrame:
    """``leaves`` (the levels and ``tokens``) plus ``budget``: whole tokens each leaf gives."""
    big = "decimal(38,0)"
    base = leaves.withColumn("capacity", (F.col("tokens").cast(big) * F.lit(max_epochs)).cast(big))
    parents, budgets = [], None
    for level in LEVELS:
        path = [*parents, level]
        nodes = base.groupBy(*path).agg(F.sum("capacity").cast(big).alias("capacity")).withColumn("weight", weight_column(level, weights.get(level, {})))
        if budgets is None:
            nodes = nodes.withColumn("budget", F.least(F.lit(total).cast(big), F.sum("capacity").over(Window.partitionBy(F.lit(0))).cast(big)))
        else:
            nodes = nodes.join(budgets, parents)
        budgets = pour(nodes, parents or [F.lit(0)], level).select(*path, F.col("share").alias("budget"))
        parents = path
    return leaves.join(budgets, list(LEVELS))


def choose(keyed: DataFrame, total: int, weights: Mapping[str, Mapping[str, int]], max_epochs: int, seed: int) -> DataFrame:
    """``keyed`` (``doc_id``, ``tokens``, the levels, written to storage) plus ``copies`` and ``tokens_used``.

    ``copies`` counts the epochs that read the document; the document at the cut of the last epoch is read whole,
    ``tokens_used`` counts only its tokens inside the budget.
    """
    spark = keyed.sparkSession
    leaves = keyed.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    plan = leaf_budgets(leaves, total, weights, max_epochs)
    # a leaf without tokens has nothing to cut: its documents are read in no epoch
    epochs = F.when(F.col("leaf_tokens") > 0, F.expr("budget div leaf_tokens").cast("bigint")).otherwise(F.lit(0))
    path = f"{scratch_path(spark, 'mixing')}/leaves"
    plan.select(*LEVELS, F.col("tokens").alias("leaf_tokens"), F.col("budget").cast("bigint").alias("budget")).withColumn("epochs", epochs) \
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("leaf_tokens")).write.parquet(path)
    cuts = spark.read.parquet(path)
    placed = keyed.join(small(cuts), list(LEVELS)).withColumn("_o", seeded_order(seed, F.col("epochs"), F.col("doc_id"))) \
        .withColumn("_b", F.substring("_o", 1, BUCKET_DIGITS))
    buckets = placed.groupBy(*LEVELS, "_b", "rest").agg(F.sum("tokens").alias("_s"))
    before = F.sum("_s").over(Window.partitionBy(*LEVELS).orderBy("_b")) - F.col("_s")
    buckets = buckets.withColumn("_before", before)
    cut = buckets.where((F.col("_before") < F.col("rest")) & (F.col("_before") + F.col("_s") >= F.col("rest"))) \
        .select(*LEVELS, F.col("_b").alias("_cut"), "_before")
    marked = placed.join(small(cut), list(LEVELS), "left")
    whole = marked.where(F.col("_cut").isNull() | (F.col("_b") != F.col("_cut"))) \
        .withColumn("_used", F.when(F.col("_b") < F.col("_cut"), F.col("tokens")).otherwise(F.lit(0))) \
        .withColumn("_in", F.coalesce(F.col("_b") < F.col("_cut"), F.lit(False)))
    inside = Window.partitionBy(*LEVELS).orderBy("_o", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.col("_before") + F.sum("tokens").over(inside) - F.col("tokens")
    at_cut = marked.where(F.col("_b") == F.col("_cut")).withColumn("_start", start) \
        .withColumn("_in", F.col("_start") < F.col("rest")) \
        .withColumn("_used", F.greatest(F.lit(0), F.least(F.col("tokens"), F.col("rest") - F.col("_start")))).drop("_start")
    both = whole.unionByName(at_cut)
    return both.withColumn("copies", F.col("epochs") + F.col("_in").cast("bigint")) \
        .withColumn("tokens_used", F.col("epochs") * F.col("tokens") + F.col("_used")) \
        .select(*keyed.columns, F.col("leaf_tokens"), F.col("budget").alias("leaf_budget"), "copies", "tokens_used")


def mix(docs: DataFrame, domain: Column, tokens: Column, share_percent: int, weights: Mapping[str, Mapping[str, int]],
        max_epochs: int = 1, seed: int = 7) -> DataFrame:
    """``doc_id``, the levels, ``tokens``, ``leaf_tokens``, ``leaf_budget``, ``copies``, ``tokens_used`` per row of ``docs``.

    The budget is ``share_percent`` of all tokens. ``domain`` and ``tokens`` are expressions over ``docs``.
    """
    spark = docs.sparkSession
    name = lambda c: F.coalesce(c.cast("string"), F.lit(NONE))
    path = f"{scratch_path(spark, 'mixing')}/keyed"
    docs.select("doc_id", name(domain).alias("domain"), name(F.col("lang")).alias("lang"), name(F.col("source")).alias("source"),
                F.greatest(F.coalesce(tokens.cast("bigint"), F.lit(0)), F.lit(0)).alias("tokens")).write.parquet(path)
    keyed = spark.read.parquet(path)
    total = keyed.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    return choose(keyed, int(total) * share_percent // 100, weights, max_epochs, seed)


def take(docs: DataFrame, domain: Column, tokens: Column, share_percent: int, weights: Mapping[str, Mapping[str, int]],
         max_epochs: int = 1, seed: int = 7) -> DataFrame:
    """The rows of ``docs`` that the mix reads, once for every epoch that reads them, with all their columns."""
    chosen = mix(docs, domain, tokens, share_percent, weights, max_epochs, seed).where("copies > 0")
    # rows that share a doc_id are told apart by their leaf and tokens
    keys = chosen.groupBy("doc_id", *LEVELS, "tokens").agg(F.max("copies").alias("_copies")) \
        .select(F.col("doc_id").alias("_d"), *[F.col(c).alias(f"_{c}") for c in LEVELS], F.col("tokens").alias("_tokens"), "_copies")
    name = lambda c: F.coalesce(c.cast("string"), F.lit(NONE))
    same = (docs["doc_id"].eqNullSafe(keys["_d"]) & (name(domain) == keys["_domain"]) & (name(docs["lang"]) == keys["_lang"])
            & (name(docs["source"]) == keys["_source"]) & (F.greatest(F.coalesce(tokens.cast("bigint"), F.lit(0)), F.lit(0)) == keys["_tokens"]))
    rows = docs.join(keys, same)
    row = F.struct(*[docs[c] for c in docs.columns]).alias("_row")
    return rows.select(row, F.explode(F.sequence(F.lit(1), keys["_copies"].cast("int"))).alias("_copy")).select("_row.*")
