"""Split queries: X1-X8, F1-F3, J12, U2, U4, A36, W6, W9, C15."""

from __future__ import annotations

from pyspark.sql import functions as F

from probelake import constants as K
from probelake.functions.hashing import shuffle_key, uniform_sql
from probelake.functions.scalars import scene_key
from probelake.operators import splits as SP
from probelake.plans import standins as ST
from probelake.plans.registry import query, table


def _region_sql(preset):
    box = K.REGION_PRESETS[preset]
    return " AND ".join(f"{a} BETWEEN {lo}::DOUBLE AND {hi}::DOUBLE" for a, (lo, hi) in box.items())


def _region_query(preset):
    sql = f"""WITH e AS (SELECT l_orderkey, l_linenumber, {ST.ESSENCE_SQL} FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN {_region_sql(preset)} THEN 'test' ELSE 'train' END AS split FROM e"""

    @query(f"X2_region_split_{preset}", sql)
    def run(spark, sf):
        rows = SP.region_split(ST.essence_rows(spark, sf), preset, {a: a for a in K.ESSENCE_FIELDS})
        return rows.select("l_orderkey", "l_linenumber", "split")


for _preset in K.REGION_PRESETS:
    _region_query(_preset)


@query("F2_in_region", f"""SELECT l_returnflag, count(*) AS n FROM (SELECT l_returnflag, {ST.ESSENCE_SQL} FROM lineitem)
WHERE {_region_sql('extrapolation')} AND l_returnflag IN ('A', 'R') GROUP BY l_returnflag""")
def in_region(spark, sf):
    rows = ST.essence_rows(spark, sf, "l_returnflag")
    hit = SP.in_region(K.REGION_PRESETS["extrapolation"], {a: a for a in K.ESSENCE_FIELDS}, "l_returnflag", ("A", "R"))
    return rows.where(hit).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("F3_empty_region", "SELECT 'train' AS split, count(*) AS n FROM lineitem")
def empty_region(spark, sf):
    label = SP.region_label({}, {})
    return ST.essence_rows(spark, sf).groupBy(label.alias("split")).agg(F.count(F.lit(1)).alias("n"))


_GRID = """
s AS (SELECT shape, row_number() OVER (ORDER BY md5('7|' || shape)) - 1 AS i, count(*) OVER () AS ns
      FROM (SELECT DISTINCT p_type AS shape FROM part)),
m AS (SELECT material, row_number() OVER (ORDER BY md5('7|' || material)) - 1 AS j, count(*) OVER () AS nm
      FROM (SELECT DISTINCT p_brand AS material FROM part)),
g AS (SELECT shape, material, CASE WHEN nm >= ns THEN j % ns = i ELSE i % nm = j END AS protected,
             md5('7|' || shape || '|' || material) AS h, ns, nm FROM s, m),
r AS (SELECT *, CASE WHEN protected THEN NULL ELSE row_number() OVER (PARTITION BY protected ORDER BY h) END AS k FROM g),
x1 AS (SELECT shape, material, CASE WHEN k <= least(round_even(ns * nm * 0.2, 0), ns * nm - greatest(ns, nm))
              THEN 'test' ELSE 'train' END AS split FROM r)"""


def _grid(spark, sf):
    return SP.combination_split(table(spark, sf, "part"), "p_type", "p_brand", 0.2, 7)


@query("X1_combination_split", f"WITH {_GRID} SELECT * FROM x1")
def combination(spark, sf):
    return _grid(spark, sf)


@query("J12_full_grid", f"WITH {_GRID} SELECT shape, material, i + 1 AS s_rank, j + 1 AS m_rank FROM s, m")
def full_grid(spark, sf):
    from probelake.operators.ranking import seeded_rank

    part = table(spark, sf, "part")
    shapes = seeded_rank(part.select(F.col("p_type").alias("shape")).distinct(), 7, "shape", out="s_rank")
    materials = seeded_rank(part.select(F.col("p_brand").alias("material")).distinct(), 7, "material", out="m_rank")
    n = part.select(F.countDistinct("p_brand")).first()[0]
    return SP.full_grid(shapes, materials, n).select("shape", "material", "s_rank", "m_rank")


@query("U2_difference", f"WITH {_GRID} SELECT shape, material FROM x1 WHERE split = 'train'")
def difference(spark, sf):
    grid = _grid(spark, sf)
    held = grid.where("split = 'test'").select("shape", "material")
    return grid.select("shape", "material").join(held, ["shape", "material"], "left_anti")


@query("U4_overlap", f"""WITH {_GRID}, b AS (SELECT p_brand, p_type, split FROM part JOIN x1 ON shape = p_type AND
material = p_brand) SELECT p_brand FROM b WHERE split = 'train' INTERSECT SELECT p_brand FROM b WHERE split = 'test'""")
def overlap(spark, sf):
    grid = _grid(spark, sf).select(F.col("shape").alias("p_type"), F.col("material").alias("p_brand"), "split")
    rows = table(spark, sf, "part").select("p_brand", "p_type").join(SP.small(grid), ["p_type", "p_brand"])
    return SP.overlap(rows, ["p_brand"])


@query("A36_split_summary", f"""WITH {_GRID}
SELECT count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'test') AS n_test,
       count(DISTINCT shape) AS n_shapes, count(DISTINCT material) AS n_materials FROM x1""")
def split_summary(spark, sf):
    return SP.split_summary(_grid(spark, sf), shapes="shape", materials="material")


_CATEGORY = """c AS (SELECT p_brand, row_number() OVER (ORDER BY md5('3|' || p_brand)) AS k, count(*) OVER () AS n
  FROM (SELECT DISTINCT p_brand FROM part)),
x3 AS (SELECT p_partkey, p_brand, CASE WHEN k <= least(n - 1, round_even(n * 0.2, 0)) THEN 'test' ELSE 'train' END AS split
  FROM part JOIN c USING (p_brand))"""


@query("X3_category_split", f"WITH {_CATEGORY} SELECT * FROM x3")
def category_split(spark, sf):
    return SP.category_split(table(spark, sf, "part").select("p_partkey", "p_brand"), "p_brand", seed=3)


@query("X3_category_split_named", """SELECT p_partkey, p_brand,
CASE WHEN p_brand IN ('Brand#1', 'Brand#7') THEN 'test' ELSE 'train' END AS split FROM part""")
def category_named(spark, sf):
    return SP.category_split(table(spark, sf, "part").select("p_partkey", "p_brand"), "p_brand",
                             held=["Brand#1", "Brand#7", "no such brand"])


_OBJECT = """c AS (SELECT p_partkey, row_number() OVER (ORDER BY md5('5|' || p_partkey)) AS k, count(*) OVER () AS n
  FROM part), x4 AS (SELECT p_partkey, CASE WHEN k <= least(n - 1, round_even(n * 0.2, 0)) THEN 'test' ELSE 'train' END
  AS split FROM c)"""


@query("X4_object_split", f"WITH {_OBJECT} SELECT * FROM x4")
def object_split(spark, sf):
    return SP.object_split(table(spark, sf, "part").select("p_partkey"), "p_partkey", seed=5)


@query("X5_plan_split", f"WITH {_CATEGORY} SELECT p_partkey, p_brand, split FROM x3")
def plan_split(spark, sf):
    return SP.plan_split(table(spark, sf, "part").select("p_partkey", "p_brand"), "p_partkey", "p_brand", seed=3)


@query("X6_iid_split", f"""WITH e AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {ST.ESSENCE_SQL}
  FROM lineitem), t AS (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P'),
r AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('11|' || o_orderkey)) AS k, count(*) OVER () AS n FROM t)
SELECT o_orderkey, CASE WHEN k <= floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM r""")
def iid_split(spark, sf):
    train = table(spark, sf, "orders").where("o_orderstatus <> 'P'").select("o_orderkey")
    return SP.iid_split(train, "o_orderkey", 0.8, 11)


@query("X7_kfold", """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('13|' || o_orderkey)) - 1 AS k,
count(*) OVER () AS n FROM orders)
SELECT o_orderkey, (CASE WHEN k < (n % 7) * (n // 7 + 1) THEN k // (n // 7 + 1)
  ELSE (n % 7) + (k - (n % 7) * (n // 7 + 1)) // (n // 7) END)::INT AS fold FROM r""")
def kfold(spark, sf):
    return SP.kfold(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 7, 13)


@query("X8_assign_scenes", f"""WITH {_GRID}, p AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY md5('0|' || shape || '|' || material), shape, material) AS o,
  count(*) OVER (PARTITION BY split) AS c FROM x1), t AS (SELECT count(*) AS n, (SELECT count(*) FILTER (split = 'train') FROM x1) AS tr, (SELECT count(*) FILTER (split = 'test') FROM x1) AS te FROM orders),
q AS (SELECT o_orderkey AS slot, n - round_even(n * te / (tr + te)::DOUBLE, 0)::BIGINT AS cut, tr, te FROM orders, t),
d AS (SELECT CASE WHEN slot < cut THEN 'train' ELSE 'test' END AS split, CASE WHEN slot < cut THEN slot ELSE slot - cut END AS i, tr, te FROM q),
e AS (SELECT split, i, floor({uniform_sql(17, 'pair', 'split', 'i')} * CASE split WHEN 'train' THEN tr ELSE te END)::BIGINT + 1 AS o FROM d)
SELECT printf('%s_%06d', split, i) AS scene_id, shape, material, split FROM e JOIN p USING (split, o)""")
def assign_scenes(spark, sf):
    slots = table(spark, sf, "orders").select("o_orderkey")  # keys 0..n-1 serve as slot ordinals
    return SP.assign_scene_materials(slots, "o_orderkey", _grid(spark, sf), seed=17)


@query("F1_filter_split", f"WITH {_OBJECT} SELECT p_partkey FROM x4 WHERE split = 'test'")
def filter_split(spark, sf):
    return SP.object_split(table(spark, sf, "part").select("p_partkey"), "p_partkey", seed=5).where(
        "split = 'test'").select("p_partkey")


@query("W6_batches", """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('19|' || o_orderkey)) AS k,
count(*) OVER () AS n FROM orders) SELECT o_orderkey, CAST((k - 1) // 64 AS BIGINT) AS batch FROM r
WHERE (k - 1) // 64 < n // 64""")
def batches(spark, sf):
    return SP.batches(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 64, seed=19, drop_last=True)


@query("W9_first_n", """SELECT o_orderkey, o_custkey FROM orders ORDER BY md5('23|' || o_orderkey) LIMIT 128""")
def first_n(spark, sf):
    return table(spark, sf, "orders").orderBy(shuffle_key(23, "o_orderkey")).limit(128).select("o_orderkey", "o_custkey")


@query("C15_scene_ids", "SELECT o_orderkey, printf('%s_%06d', lower(o_orderstatus), o_orderkey) AS scene_id FROM orders")
def scene_ids(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", scene_key(F.lower("o_orderstatus"), "o_orderkey").alias("scene_id"))
