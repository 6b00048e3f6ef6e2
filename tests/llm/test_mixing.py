import hashlib
from fractions import Fraction

from pyspark.sql import functions as F

from probelake.llm import mixing


def pour(budget, children):
    """Shares by the definition: fill level found by trying every set of full children; children: name -> (weight, capacity)."""
    budget = min(budget, sum(c for _, c in children.values()))
    order = sorted(children, key=lambda n: (Fraction(children[n][1], children[n][0]), n))
    full, rest = set(), budget
    for n in order:
        open_weight = sum(children[m][0] for m in children if m not in full)
        if children[n][1] * open_weight <= rest * children[n][0]:
            full.add(n)
            rest -= children[n][1]
        else:
            break
    open_ = sorted(set(children) - full)
    weight = sum(children[n][0] for n in open_)
    out = {n: children[n][1] for n in full} | {n: rest * children[n][0] // weight for n in open_}
    for n in open_[:rest - sum(out[n] for n in open_)]:
        out[n] += 1
    return out


WEIGHTS = {"domain": {"d1": 3, "d2": 1}, "lang": {"en": 5}, "source": {"s9": 2}}


def brute(rows, percent, epochs, seed):
    leaves = {}
    for i, d, lang, s, t in rows:
        leaves.setdefault((d, lang, s), []).append((i, t))
    tokens = {k: sum(t for _, t in v) for k, v in leaves.items()}
    total = sum(tokens.values()) * percent // 100

    def down(prefix, budget, level):
        names = {k[level] for k in leaves if k[:level] == prefix}
        kids = {n: (WEIGHTS[mixing.LEVELS[level]].get(n, 1), sum(tokens[k] * epochs for k in leaves if k[:level + 1] == (*prefix, n))) for n in names}
        shares = pour(budget, kids)
        if level == 2:
            return {(*prefix, n): b for n, b in shares.items()}
        return {k: v for n, b in shares.items() for k, v in down((*prefix, n), b, level + 1).items()}

    out = []
    for leaf, budget in down((), total, 0).items():
        e = budget // tokens[leaf] if tokens[leaf] else 0
        rest, at = budget - e * tokens[leaf], 0
        for i, t in sorted(leaves[leaf], key=lambda x: (hashlib.md5(f"{seed}:{e}:{x[0]}".encode()).hexdigest(), x[0], x[1])):
            out.append((i, *leaf, t, tokens[leaf], budget, e + (at < rest), e * t + max(0, min(t, rest - at))))
            at += t
    return sorted(out)


def run(spark, rows, percent, epochs):
    docs = spark.createDataFrame(rows, "doc_id long, dom string, lang string, source string, n long")
    return mixing.mix(docs, F.col("dom"), F.col("n"), percent, WEIGHTS, epochs, 11)


def test_budgets_and_prefixes_are_those_of_the_definition(spark):
    rows = [(i, f"d{i % 3}", ("en", "de", "fr")[i % 7 % 3], f"s{i % 5 + 5}", (i * 37) % 50) for i in range(400)]
    rows += [(1000 + i, "d1", "en", "s9", 30) for i in range(300)] + [(2000, "d7", "en", "s1", 0)]
    for percent, epochs in ((60, 2), (150, 2), (100, 1)):
        got = run(spark, rows, percent, epochs)
        assert sorted(map(tuple, got.collect())) == brute(rows, percent, epochs, 11)
        assert got.agg(F.sum("tokens_used")).first()[0] == sum(r[4] for r in rows) * percent // 100


def test_a_shortage_goes_to_siblings_before_other_domains(spark):
    rows = [(1, "a", "en", "s1", 10), (2, "a", "en", "s2", 1000), (3, "b", "en", "s1", 1000)]
    budget = {(r["domain"], r["source"]): r["leaf_budget"] for r in run(spark, rows, 50, 1).collect()}
    assert budget == {("a", "s1"): 10, ("a", "s2"): 493, ("b", "s1"): 502}  # 1005 in all


def test_nulls_ties_repeated_rows_and_empty_tables(spark, make):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "d1", "en", "s1", 5), (2, "d1", "en", "s1", -3), (3, "d1", "en", "s1", 5)]
    got = run(spark, rows, 100, 1).collect()
    assert len(got) == 5 and sum(r["tokens_used"] for r in got) == 10
    assert {r["domain"] for r in got} == {mixing.NONE, "d1"}
    assert run(spark, [], 50, 2).count() == 0
    docs = make([(i, "w " * i, "en", f"src{i % 4}") for i in range(1, 40)] + [(None, "a b", None, None), (7, "x", "en", "src3")])
    words = F.size(F.split("text", " "))
    all_of_it = mixing.take(docs, F.col("source"), words, 200, {}, 2)
    assert all_of_it.columns == docs.columns and all_of_it.count() == 2 * docs.count()
    assert mixing.take(docs, F.col("source"), words, 100, {}, 1).count() == docs.count()
    assert 0 < mixing.take(docs, F.col("source"), words, 50, {}, 1).count() < docs.count()
