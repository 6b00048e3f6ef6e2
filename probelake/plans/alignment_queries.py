"""Representation queries: P24, J4-J9, A18-A21, A24-A29, F7, F10, F14, U3, W10."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probelake.functions.scalars import ternary_code
from probelake.operators import agreement as AG
from probelake.operators import alignment as AL
from probelake.operators import neighbors as NN
from probelake.plans import standins as ST
from probelake.plans.registry import query, r6, rounded, table
from probelake.plans.stat_queries import RUNS_SQL, runs
from probelake.session import durable


def _knn_sql(v, name, k=10):
    return f"""{name} AS (SELECT * FROM (SELECT a.vec_id AS id, b.vec_id AS neighbor,
  pow(list_distance(a.{v}, b.{v}), 2) AS d2,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.{v}, b.{v}), b.vec_id) AS rank
  FROM latents a JOIN latents b ON a.vec_id <> b.vec_id) WHERE rank <= {k})"""


@query("J4_knn10", f"""WITH {ST.LATENTS_SQL}, {_knn_sql('x', 'kx')}
SELECT id, neighbor, round(d2, 6) + 0.0 AS d2, rank::INT AS rank FROM kx""")
def knn10(spark, sf):
    return rounded(NN.knn(ST.latents(spark, sf), 10, id_col="vec_id", vec="x"), "d2")


@query("W10_chosen_neighbors", f"WITH {ST.LATENTS_SQL}, {_knn_sql('y', 'ky', 3)} SELECT id, neighbor FROM ky")
def chosen_neighbors(spark, sf):
    return NN.knn(ST.latents(spark, sf), 3, id_col="vec_id", vec="y").select("id", "neighbor")


@query("J8_neighbor_overlap", f"""WITH {ST.LATENTS_SQL}, {_knn_sql('x', 'kx')}, {_knn_sql('y', 'ky')}
SELECT kx.id, count(ky.id) AS overlap FROM kx LEFT JOIN ky ON kx.id = ky.id AND kx.neighbor = ky.neighbor GROUP BY kx.id""")
def neighbor_overlap(spark, sf):
    z = ST.latents(spark, sf)
    return NN.neighbor_overlap(*[NN.knn(z, 10, id_col="vec_id", vec=v) for v in ("x", "y")])


@query("U3_intersection", f"""WITH {ST.LATENTS_SQL}, {_knn_sql('x', 'kx')}, {_knn_sql('y', 'ky')}
SELECT id, neighbor FROM kx INTERSECT SELECT id, neighbor FROM ky""")
def intersection(spark, sf):
    z = ST.latents(spark, sf)
    a, b = (NN.knn(z, 10, id_col="vec_id", vec=v).select("id", "neighbor") for v in ("x", "y"))
    return a.join(b, ["id", "neighbor"])


@query("A20_mutual_knn", f"""WITH {ST.LATENTS_SQL}, {_knn_sql('x', 'kx')}, {_knn_sql('y', 'ky')},
h AS (SELECT count(*) AS hits FROM kx JOIN ky USING (id, neighbor)), c AS (SELECT count(*) AS n FROM latents)
SELECT round(hits / (n * 10.0::DOUBLE), 6) + 0.0 AS alignment, n FROM h, c""")
def mutual_knn(spark, sf):
    return rounded(AL.mutual_knn(ST.latents(spark, sf), "x", "y", 10, id_col="vec_id"), "alignment")


@query("J5_knn_predict", f"""WITH {ST.LATENTS_SQL},
tr AS (SELECT * FROM latents WHERE vec_id % 4 <> 0), te AS (SELECT * FROM latents WHERE vec_id % 4 = 0),
k AS (SELECT te.vec_id AS id, tr.vec_id AS neighbor, tr.label, tr.y[1] AS y1,
  row_number() OVER (PARTITION BY te.vec_id ORDER BY list_distance(te.x, tr.x), tr.vec_id) AS rank FROM te, tr)
SELECT id, round(avg(label), 6) + 0.0 AS label, round(avg(y1), 6) + 0.0 AS y1 FROM k WHERE rank <= 5 GROUP BY id""")
def knn_predict(spark, sf):
    z = ST.latents(spark, sf).withColumn("y1", F.col("y")[0])
    out = NN.knn_predict(z.where("vec_id % 4 <> 0"), z.where("vec_id % 4 = 0"), ["label", "y1"], 5, id_col="vec_id", vec="x")
    return rounded(out, "label", "y1")


@query("J9_row_correspondence", """SELECT a.vec_id, i::INT AS entry, round(a.embedding[i + 1]::DOUBLE - b.embedding[i + 33]::DOUBLE, 6) + 0.0 AS diff
FROM embeddings a JOIN embeddings b USING (vec_id), range(32) r(i)""")
def row_correspondence(spark, sf):
    z = ST.latents(spark, sf)
    joined = z.select("vec_id", "x").join(z.select("vec_id", "y"), "vec_id")
    return joined.select("vec_id", F.posexplode(F.zip_with("x", "y", lambda a, b: a - b)).alias("entry", "diff")).select("vec_id", "entry", r6("diff").alias("diff"))


_LONG = "long AS (SELECT vec_id, label, unnest(range(1, 65)) AS dim, unnest(x || y) AS v FROM latents)"


def whole(spark, sf):
    """All 64 entries of the embedding."""
    return ST.latents(spark, sf).select("vec_id", "label", F.concat("x", "y").alias("z"))


@query("A18_participation_ratio", f"""WITH {ST.LATENTS_SQL}, {_LONG},
s AS (SELECT dim, var_pop(v) AS var, count(*) AS n FROM long GROUP BY dim)
SELECT round(pow(sum(var), 2) / (sum(var * var) + 1e-12), 6) + 0.0 AS participation_ratio, max(n) AS n FROM s""")
def participation_ratio(spark, sf):
    return rounded(AL.participation_ratio(whole(spark, sf), "z"), "participation_ratio")


@query("F7_collapse_gate", f"""WITH {ST.LATENTS_SQL}, {_LONG},
s AS (SELECT label, dim, var_pop(v) AS var, count(*) AS n FROM long GROUP BY label, dim),
p AS (SELECT label, pow(sum(var), 2) / (sum(var * var) + 1e-12) AS pr, max(n) AS n FROM s GROUP BY label)
SELECT label, round(pr, 6) + 0.0 AS participation_ratio, n, pr < 30 AS collapsed FROM p""")
def collapse_gate(spark, sf):
    pr = AL.participation_ratio(whole(spark, sf), "z", ["label"])
    return rounded(AL.collapse_gate(pr, floor=30.0), "participation_ratio")


@query("A19_linear_cka", f"""WITH {ST.LATENTS_SQL}, w AS (SELECT vec_id, unnest(range(0, 64)) AS dim, unnest(x || y) AS v FROM latents),
c AS (SELECT a.dim AS i, b.dim AS j, pow(covar_pop(a.v, b.v), 2) AS c2 FROM w a JOIN w b USING (vec_id) GROUP BY 1, 2)
SELECT round(sum(c2) FILTER (i < 32 AND j >= 32) / (sqrt(sum(c2) FILTER (i < 32 AND j < 32)) *
  sqrt(sum(c2) FILTER (i >= 32 AND j >= 32))), 6) + 0.0 AS cka FROM c""")
def linear_cka(spark, sf):
    return rounded(AL.linear_cka(ST.latents(spark, sf), "x", "y", 32), "cka")


# eight runs: 8-wide slices of the embedding, two arms of four seeds
_N_RUNS, _WIDTH, _K = 8, 8, 5
_SLICE_RUNS_SQL = "runs AS (SELECT i AS run_id, CASE WHEN i < 4 THEN 'base' ELSE 'loud' END AS arm, i % 4 AS seed FROM range(8) r(i))"
_SLICES_SQL = """slices AS (SELECT i AS run_id, vec_id, list_transform(embedding[i * 8 + 1 : i * 8 + 8], lambda v: v::DOUBLE) AS z
  FROM embeddings, range(8) r(i))"""
_RUN_KNN_SQL = f"""{_SLICES_SQL},
nn AS (SELECT * FROM (SELECT a.run_id, a.vec_id AS id, b.vec_id AS neighbor,
  row_number() OVER (PARTITION BY a.run_id, a.vec_id ORDER BY list_distance(a.z, b.z), b.vec_id) AS rank
  FROM slices a JOIN slices b ON a.run_id = b.run_id AND a.vec_id <> b.vec_id) WHERE rank <= {_K}),
n AS (SELECT count(*) AS n FROM embeddings)"""
_PAIR_KNN_SQL = """pk AS (SELECT p.arm, p.run_a, p.run_b,
  (SELECT count(*) FROM nn a JOIN nn b ON a.id = b.id AND a.neighbor = b.neighbor
    WHERE a.run_id = p.run_a AND b.run_id = p.run_b) / (n.n * 5.0::DOUBLE) AS knn FROM pairs p, n)"""
_PAIRS_SQL = "pairs AS (SELECT a.arm, a.run_id AS run_a, b.run_id AS run_b FROM runs a JOIN runs b ON a.arm = b.arm AND a.run_id < b.run_id)"
# linear kernel alignment of two runs from the squared covariances of their entries
CKA_SQL = """entries AS (SELECT run_id, vec_id, unnest(range(8)) AS dim, unnest(z) AS v FROM slices),
c2 AS (SELECT run_a, run_b, sum(c * c) AS s FROM (SELECT a.run_id AS run_a, b.run_id AS run_b, a.dim AS i, b.dim AS j, covar_pop(a.v, b.v) AS c
  FROM entries a JOIN entries b ON a.vec_id = b.vec_id AND a.run_id <= b.run_id GROUP BY ALL) GROUP BY ALL),
pc AS (SELECT x.run_a, x.run_b, x.s / (sqrt(y.s) * sqrt(z.s)) AS cka FROM c2 x JOIN c2 y ON y.run_a = x.run_a AND y.run_b = x.run_a
  JOIN c2 z ON z.run_a = x.run_b AND z.run_b = x.run_b)"""


def run_registry(spark, sf):
    """Run table of the slices, read off one embedding's width."""
    wide = table(spark, sf, "embeddings").select(F.size("embedding").alias("w")).limit(1)
    return wide.select(F.explode(F.expr(f"sequence(0L, least({_N_RUNS}, floor(w / {_WIDTH})) - 1)")).alias("run_id")).select(
        "run_id", F.when(F.col("run_id") < 4, "base").otherwise("loud").alias("arm"), (F.col("run_id") % 4).alias("seed"))


def run_latents(spark, sf):
    """(run_id, id, z): every 8-wide slice of every embedding."""
    cut = F.transform(F.sequence(F.lit(0), F.lit(_N_RUNS - 1)), lambda i: F.transform(F.slice("embedding", i * _WIDTH + 1, F.lit(_WIDTH)), lambda v: v.cast("double")))
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.posexplode(cut).alias("run_id", "z")).select(F.col("run_id").cast("bigint").alias("run_id"), "id", "z")


def run_neighbors(spark, sf, populations=()):
    """(run_id, id, neighbor), with a population when rows are flagged by name -> condition."""
    z = run_latents(spark, sf).withColumns(dict(populations))
    tables = [NN.knn(z.where(F.col("run_id") == i), _K, populations=[name for name, _ in populations]).withColumn("run_id", F.lit(i).cast("bigint")) for i in range(_N_RUNS)]
    return reduce(DataFrame.unionByName, tables)


@query("J6_run_pairs", f"""WITH {RUNS_SQL} SELECT a.arm, a.seed AS run_a, b.seed AS run_b FROM runs a JOIN runs b
ON a.arm = b.arm AND a.seed < b.seed""")
def run_pairs(spark, sf):
    return AL.run_pairs(runs(spark, sf), run="seed")


@query("J7_cross_arm_pairs", f"""WITH {RUNS_SQL} SELECT a.seed AS run_a, a.seed AS seed_a, b.seed AS run_b, b.seed AS seed_b,
'BUILDING|MACHINERY' AS arms FROM runs a JOIN runs b ON a.arm = 'BUILDING' AND b.arm = 'MACHINERY' AND a.seed <> b.seed""")
def cross_arm_pairs(spark, sf):
    return AL.cross_arm_pairs(runs(spark, sf), "BUILDING", "MACHINERY", run="seed")


@query("A21_pair_knn", f"""WITH {_SLICE_RUNS_SQL}, {_PAIRS_SQL}, {_RUN_KNN_SQL}, {_PAIR_KNN_SQL}
SELECT arm, run_a, run_b, round(knn, 6) + 0.0 AS knn FROM pk""")
def pair_knn(spark, sf):
    return rounded(AL.overlap_by_pair(durable(run_neighbors(spark, sf)), AL.run_pairs(run_registry(spark, sf)), _K), "knn")


@query("A21_pair_stats", f"""WITH {_SLICE_RUNS_SQL}, {_PAIRS_SQL}, {_RUN_KNN_SQL}, {_PAIR_KNN_SQL},
s AS (SELECT arm, run_a AS run_id, knn FROM pk UNION ALL SELECT arm, run_b, knn FROM pk)
SELECT arm, run_id, round(avg(knn), 6) + 0.0 AS run_mean, count(*) AS n_pairs FROM s GROUP BY 1, 2""")
def pair_stats(spark, sf):
    pairs = AL.overlap_by_pair(durable(run_neighbors(spark, sf)), AL.run_pairs(run_registry(spark, sf)), _K)
    return rounded(AL.pair_stats(pairs, "knn")[1], "run_mean")


@query("A21_pair_cka", f"""WITH {_SLICE_RUNS_SQL}, {_PAIRS_SQL}, {_SLICES_SQL}, {CKA_SQL}
SELECT arm, run_a, run_b, round(cka, 6) + 0.0 AS cka FROM pairs JOIN pc USING (run_a, run_b)""")
def pair_cka(spark, sf):
    return rounded(AL.cka_by_pair(run_latents(spark, sf), AL.run_pairs(run_registry(spark, sf))), "cka")


@query("F14_same_rows", """SELECT o_custkey, n_left, n_right FROM (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS n_left,
count(*) FILTER (o_orderstatus = 'O') AS n_right FROM orders GROUP BY 1) WHERE n_left <> n_right""")
def same_rows(spark, sf):
    o = table(spark, sf, "orders")
    return AL.same_rows(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), ["o_custkey"])


# ---------------------------------------------------------------- discrete codes
_CODES_SQL = """codes AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(round_even(tanh(8 * v::DOUBLE), 0) AS INTEGER)) AS code FROM embeddings)"""
_DIGITS_SQL = f"{_CODES_SQL}, digits AS (SELECT vec_id, label, unnest(range(64))::INT AS entry, unnest(code) AS c FROM codes)"
_HALVES_SQL = f"{_CODES_SQL}, halves AS (SELECT vec_id, unnest(range(32))::INT AS entry, unnest(code[1:32]) AS a, unnest(code[33:64]) AS b FROM codes)"


def codes(spark, sf):
    """Ternary codes of all 64 entries."""
    h = F.transform("embedding", lambda v: v.cast("double") * 8)
    return table(spark, sf, "embeddings").select("vec_id", "label", AG.check_code(ternary_code(h)).alias("code"))


def digits(spark, sf):
    return codes(spark, sf).select("vec_id", "label", F.posexplode("code").alias("entry", "c"))


def halves(spark, sf):
    """Every entry of the first half beside its partner in the second."""
    both = F.arrays_zip(F.slice("code", 1, 32).alias("a"), F.slice("code", 33, 32).alias("b"))
    return codes(spark, sf).select("vec_id", F.posexplode(both).alias("entry", "d")).select("vec_id", "entry", "d.a", "d.b")


@query("P24_ternary_code", f"WITH {_DIGITS_SQL} SELECT vec_id, entry, c FROM digits")
def ternary(spark, sf):
    return digits(spark, sf).select("vec_id", "entry", "c")


@query("F10_code_domain", f"WITH {_CODES_SQL} SELECT count(*) AS n FROM codes WHERE list_min(code) >= -1 AND list_max(code) <= 1")
def code_domain(spark, sf):
    return codes(spark, sf).agg(F.count("code").alias("n"))


@query("A29_code_marginals", f"""WITH {_DIGITS_SQL} SELECT label, entry, count(*) FILTER (c = -1) AS n_minus,
count(*) FILTER (c = 0) AS n_zero, count(*) FILTER (c = 1) AS n_plus FROM digits GROUP BY label, entry""")
def code_marginals(spark, sf):
    return AG.code_marginals(digits(spark, sf), "c", ["label", "entry"])


_PERMS = ", ".join(f"({i}, {p[0]}, {p[1]}, {p[2]})" for i, p in enumerate(AG.RELABELINGS))


@query("A24_trit_agreement", f"""WITH {_HALVES_SQL}, p(o, m, z, q) AS (VALUES {_PERMS}),
r AS (SELECT entry, o, m, z, q, avg((CASE a WHEN -1 THEN m WHEN 0 THEN z ELSE q END = b)::INT) AS rate, count(*) AS n FROM halves, p GROUP BY ALL)
SELECT entry, round(rate, 6) + 0.0 AS agreement, m || ',' || z || ',' || q AS relabeling, n FROM r QUALIFY row_number() OVER (PARTITION BY entry ORDER BY rate DESC, o) = 1""")
def trit_agreement(spark, sf):
    return rounded(AG.trit_agreement(halves(spark, sf), "a", "b", ["entry"]), "agreement")


@query("A25_trit_null")
def trit_null(spark, sf):
    return AG.trit_agreement_null(halves(spark, sf), "a", "b", by=["entry"])


@query("A26_mutual_information", f"""WITH {_DIGITS_SQL}, j AS (SELECT entry, label AS a, c AS b, count(*) AS n FROM digits GROUP BY ALL),
t AS (SELECT entry, sum(n)::DOUBLE AS total FROM j GROUP BY 1), x AS (SELECT entry, a, sum(n)::DOUBLE AS na FROM j GROUP BY ALL),
y AS (SELECT entry, b, sum(n)::DOUBLE AS nb FROM j GROUP BY ALL)
SELECT entry, round(sum(n / total * ln(n * total / (na * nb))), 6) + 0.0 AS mi FROM j JOIN x USING (entry, a) JOIN y USING (entry, b) JOIN t USING (entry) GROUP BY entry""")
def mutual_information(spark, sf):
    return rounded(AG.mutual_information(digits(spark, sf), "label", "c", ["entry"]), "mi")


_PAIRS2 = "n * (n - 1) / 2.0::DOUBLE"


@query("A27_adjusted_rand", f"""WITH {_CODES_SQL}, k AS (SELECT block::INT AS block, code[block * 4 + 1 : block * 4 + 2]::VARCHAR AS a, code[block * 4 + 3 : block * 4 + 4]::VARCHAR AS b
  FROM codes, range(16) r(block)), j AS (SELECT block, a, b, count(*) AS n FROM k GROUP BY ALL),
jj AS (SELECT block, sum({_PAIRS2}) AS joint, sum(n) AS n FROM j GROUP BY 1),
aa AS (SELECT block, sum({_PAIRS2}) AS pa FROM (SELECT block, a, sum(n) AS n FROM j GROUP BY ALL) GROUP BY 1),
bb AS (SELECT block, sum({_PAIRS2}) AS pb FROM (SELECT block, b, sum(n) AS n FROM j GROUP BY ALL) GROUP BY 1)
SELECT block, round((joint - pa * pb / (n * (n - 1) / 2.0)) / ((pa + pb) / 2 - pa * pb / (n * (n - 1) / 2.0)), 6) + 0.0 AS ari,
  n::BIGINT AS n FROM jj JOIN aa USING (block) JOIN bb USING (block)""")
def adjusted_rand(spark, sf):
    cut = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.struct(F.slice("code", i * 4 + 1, F.lit(2)).alias("a"), F.slice("code", i * 4 + 3, F.lit(2)).alias("b")))
    k = codes(spark, sf).select(F.posexplode(cut).alias("block", "s")).select("block", "s.a", "s.b")
    return rounded(AG.adjusted_rand(k, "a", "b", ["block"]), "ari")


@query("A28_terciles", """WITH q AS (SELECT quantile_cont(l_extendedprice, 1.0::DOUBLE / 3) AS q1, quantile_cont(l_extendedprice, 2.0::DOUBLE / 3) AS q2
FROM lineitem) SELECT (l_extendedprice > q1)::INT + (l_extendedprice > q2)::INT AS tercile, count(*) AS n,
round(min(l_extendedprice), 6) + 0.0 AS lowest FROM lineitem, q GROUP BY 1""")
def terciles(spark, sf):
    t = AG.terciles(table(spark, sf, "lineitem").select("l_extendedprice"), "l_extendedprice")
    return rounded(t.groupBy("tercile").agg(F.count(F.lit(1)).alias("n"), F.min("l_extendedprice").alias("lowest")), "lowest")
