"""Catalog queries: S5-S9, S19, C9, C10, C12, C13, A1, F4-F6, W3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probelake import constants as K
from probelake.functions import scalars as C
from probelake.operators import catalog as CAT
from probelake.plans.registry import query, r6, rounded, table

# product_type of a part: its first name word in upper case, two of them denied
_UNITS = ("pounds", "kilograms", "grams", "milligrams", "ounces", "tons", "furlongs")
_UNIT_SQL = "CASE p_size % 7 " + " ".join(f"WHEN {i} THEN '{u}'" for i, u in enumerate(_UNITS)) + " END"


def listings(spark: SparkSession, sf: str) -> DataFrame:
    """Listing records built from ``part``: seven units (one unknown), some junk values, nested and flat entries."""
    p = table(spark, sf, "part")
    unit = F.element_at(F.array(*[F.lit(u) for u in _UNITS]), F.col("p_size") % 7 + 1)
    value = F.when(F.col("p_size") % 11 == 0, "heavy").otherwise(F.format_string("%.1f", F.col("p_retailprice")))
    inner = F.struct(unit.alias("unit"), value.alias("value"))
    first = F.struct(F.when(F.col("p_size") % 2 == 0, inner).alias("normalized_value"), unit.alias("unit"),
                     value.alias("value"))
    second = F.struct(F.lit(None).cast(inner_type()).alias("normalized_value"), F.lit("ounces").alias("unit"),
                      F.col("p_size").cast("string").alias("value"))
    kind = F.when(F.col("p_size") % 13 == 0, "rug").when(F.col("p_size") % 17 == 0, " Pillow ").otherwise(F.col("p_type"))
    return p.select(
        F.concat(F.lit("M"), (F.col("p_partkey") % 1500).cast("string")).alias("3dmodel_id"),
        F.when(F.col("p_size") % 5 == 0, F.array(first, second)).otherwise(F.array(first)).alias("item_weight"),
        F.when(F.col("p_size") % 19 == 0, F.array().cast("array<struct<value:string>>")).otherwise(
            F.array(F.struct(kind.alias("value")))).alias("product_type"),
        "p_partkey")


def inner_type():
    return "struct<unit:string,value:string>"


_FACTOR = "CASE u " + " ".join(f"WHEN '{u}' THEN {v}::DOUBLE" for u, v in K.WEIGHT_TO_KG.items()) + " END"
LISTINGS_SQL = f"""
raw AS (SELECT p_partkey, p_size, p_type, 'M' || (p_partkey % 1500) AS model_id, {_UNIT_SQL} AS u,
          CASE WHEN p_size % 11 = 0 THEN 'heavy' ELSE printf('%.1f', p_retailprice) END AS v FROM part),
weighed AS (SELECT *, TRY_CAST(v AS DOUBLE) * ({_FACTOR}) AS kg1,
          CASE WHEN p_size % 5 = 0 THEN p_size * 0.028349523::DOUBLE END AS kg2 FROM raw),
parsed AS (SELECT p_partkey, model_id, CASE WHEN kg1 > 0 THEN kg1 WHEN kg2 > 0 THEN kg2 END AS kg,
          CASE WHEN p_size % 19 = 0 THEN 'UNKNOWN' WHEN p_size % 13 = 0 THEN 'RUG' WHEN p_size % 17 = 0 THEN 'PILLOW'
               ELSE upper(trim(p_type)) END AS category FROM weighed),
usable AS (SELECT * FROM parsed WHERE kg IS NOT NULL),
models AS (SELECT model_id, arg_min(kg, p_partkey) AS kg, arg_min(category, p_partkey) AS category FROM usable
          GROUP BY model_id)"""


def models(spark, sf):
    return CAT.first_usable(CAT.parse_listings(listings(spark, sf), ["p_partkey"]), ["p_partkey"])


@query("C9_weight_to_kg", f"WITH {LISTINGS_SQL} SELECT p_partkey, round(kg, 8) + 0.0 AS kg FROM parsed")
def weight_to_kg(spark, sf):
    return listings(spark, sf).select("p_partkey", r6(C.weight_to_kg("item_weight"), 8).alias("kg"))


@query("C10_parse_listing", f"WITH {LISTINGS_SQL} SELECT p_partkey, model_id, round(kg, 8) + 0.0 AS kg, category FROM usable")
def parse_listing(spark, sf):
    return rounded(CAT.parse_listings(listings(spark, sf), ["p_partkey"]), "kg", digits=8)


@query("A1_first_usable", f"WITH {LISTINGS_SQL} SELECT model_id, round(kg, 8) + 0.0 AS kg, category FROM models")
def first_usable(spark, sf):
    return rounded(models(spark, sf), "kg", digits=8)


@query("F4_drop_categories", f"WITH {LISTINGS_SQL} SELECT model_id, category FROM models "
       f"WHERE category NOT IN {K.DEFORMABLE_CATEGORIES}")
def drop_categories(spark, sf):
    return CAT.drop_categories(models(spark, sf))[0].select("model_id", "category")


@query("W3_round_robin", f"""WITH {LISTINGS_SQL},
r AS (SELECT model_id, category, row_number() OVER (PARTITION BY category ORDER BY model_id) - 1 AS rank FROM models
      WHERE category NOT IN {K.DEFORMABLE_CATEGORIES})
SELECT model_id, category, rank::INT AS rank FROM r WHERE rank < 12 ORDER BY rank, category LIMIT 50""")
def round_robin(spark, sf):
    kept, _ = CAT.drop_categories(models(spark, sf).select("model_id", "category"))
    return CAT.round_robin_select(kept, 50, 12)


# mass from p_retailprice, volumes from p_size: some not watertight, some implausible
_GATED = """g AS (SELECT p_partkey, p_retailprice AS mass, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size / 20.0::DOUBLE - 0.1 END
  AS volume, p_size / 10.0::DOUBLE / pow(10, p_size % 4) AS hull FROM part),
d AS (SELECT *, CASE WHEN volume > 0 THEN mass / volume END AS density, CASE WHEN hull > 0 THEN mass / hull END AS lb FROM g),
q AS (SELECT *, coalesce(density BETWEEN 10 AND 20000, true) AS passes, coalesce(lb <= 20000, true) AS lb_passes FROM d),
z AS (SELECT *, CASE WHEN NOT passes THEN 'density_implausible:' || printf('%.1f', density)
  WHEN volume IS NULL AND NOT lb_passes THEN 'density_implausible_lb:' || printf('%.1f', lb) END AS reason FROM q)"""


def _gated(spark, sf):
    s = F.col("p_size")
    return table(spark, sf, "part").select(
        "p_partkey", F.col("p_retailprice").alias("mass"), F.when(s % 3 != 0, s / 20.0 - 0.1).alias("volume"),
        (s / 10.0 / F.pow(F.lit(10.0), (s % 4).cast("double"))).alias("hull"))


@query("F5_density_gate", f"WITH {_GATED} SELECT p_partkey, passes, round(density, 6) + 0.0 AS density FROM q")
def density_gate(spark, sf):
    gate = CAT.density_gate("mass", "volume")
    return _gated(spark, sf).select("p_partkey", gate["passes"].alias("passes"), r6(gate["density"]).alias("density"))


@query("F6_lower_bound_gate", f"""WITH {_GATED} SELECT p_partkey, lb_passes AS passes, round(lb, 6) + 0.0 AS lower_bound
FROM q""")
def lower_bound_gate(spark, sf):
    gate = CAT.density_lower_bound_gate("mass", "hull")
    return _gated(spark, sf).select("p_partkey", gate["passes"].alias("passes"), r6(gate["lower_bound"]).alias("lower_bound"))


@query("S19_rejection_tally", f"""WITH {_GATED}
SELECT coalesce('rejected_' || split_part(reason, ':', 1), 'prepared') AS reason, count(*) AS n FROM z GROUP BY 1""")
def rejection_tally(spark, sf):
    g = _gated(spark, sf).withColumn("reason", CAT.rejection_reason("mass", "volume", "hull"))
    return CAT.rejection_tally(g)


@query("C12_half_extent_density", """SELECT p_partkey, round(greatest(p_size * 0.01::DOUBLE / 2, 1e-3), 9) + 0.0 AS half_height,
round(CASE WHEN p_size % 2 = 0 AND abs(p_size - 25) / 100.0::DOUBLE * pow(0.01, 3) > 1e-9
  THEN p_retailprice / (abs(p_size - 25) / 100.0::DOUBLE * pow(0.01, 3)) END, 3) + 0.0 AS density FROM part""")
def half_extent_density(spark, sf):
    s, scale = F.col("p_size"), F.lit(0.01)
    return table(spark, sf, "part").select(
        "p_partkey", r6(C.half_height(s, scale), 9).alias("half_height"),
        r6(C.derived_density("p_retailprice", (s - 25) / 100.0, scale, s % 2 == 0), 3).alias("density"))


@query("C13_mass_from_density", """SELECT p_partkey,
round(CASE WHEN p_size % 2 = 0 THEN p_retailprice * (p_size / 100.0::DOUBLE) END, 6) + 0.0 AS mass_kg FROM part""")
def mass_from_density(spark, sf):
    s = F.col("p_size")
    return table(spark, sf, "part").select(
        "p_partkey", r6(C.mass_from_density("p_retailprice", s / 100.0, s % 2 == 0)).alias("mass_kg"))


# ---------------------------------------------------------------- object directories
def object_files(spark: SparkSession, sf: str) -> DataFrame:
    """(object_id, rel_path, content) of object directories built from ``part``: every metadata flavour occurs."""
    p = table(spark, sf, "part")
    s, price = F.col("p_size"), F.format_string("%.1f", F.col("p_retailprice"))

    def file(path, content=None, when=None):
        text = content if content is not None else F.lit(None).cast("string")
        f = F.struct(F.lit(path).alias("rel_path"), text.alias("content"))
        return F.when(when, f) if when is not None else f

    entries = F.array(
        file("meshes/model.obj", when=s % 3 == 0),
        file("visual.glb", when=s % 4 != 1),
        file("parts/lid.stl", when=s % 5 == 0),
        file("materials/textures/texture.png", when=s % 2 == 0),
        file("textures/scan.jpg", when=s % 3 == 1),
        file("notes.txt", F.lit("plain")),
        file("model.sdf", F.concat(F.lit("<inertial><mass> "), price, F.lit(" </mass></inertial>")), s % 4 == 0),
        file("model.sdf", F.lit("<inertial><mass>1.2.3</mass></inertial>"), s % 4 == 3),
        file("meta.json", F.concat(F.lit('{"mass_grams": '), price, F.lit(', "category": " Shoe "}')), s % 6 == 1),
        file("metadata.json", F.concat(F.lit('{"mass": "'), price, F.lit('", "categories": ["Mug", "Cup"]}')), s % 6 == 3),
        file("metadata.pbtxt", F.concat(F.lit('mass: '), price, F.lit('\ncategories: "Toy Box"')), s % 7 == 2),
    )
    return p.select(F.format_string("O%06d", "p_partkey").alias("object_id"), F.explode(
        F.filter(entries, lambda e: e.isNotNull())).alias("f")).select("object_id", "f.rel_path", "f.content")


OBJECTS_SQL = """
o AS (SELECT printf('O%06d', p_partkey) AS object_id, p_size AS s, TRY_CAST(printf('%.1f', p_retailprice) AS DOUBLE) AS price
      FROM part),
x AS (SELECT object_id,
  CASE WHEN s % 3 = 0 THEN 'meshes/model.obj' WHEN s % 4 <> 1 THEN 'visual.glb' WHEN s % 5 = 0 THEN 'parts/lid.stl' END
    AS mesh_path,
  CASE WHEN s % 2 = 0 THEN 'materials/textures/texture.png' WHEN s % 3 = 1 THEN 'textures/scan.jpg' END AS texture_path,
  CASE WHEN s % 4 = 0 THEN price WHEN s % 6 = 1 THEN price * 1e-3::DOUBLE WHEN s % 6 = 3 THEN price
       WHEN s % 7 = 2 THEN price END AS mass_kg,
  CASE WHEN s % 4 = 0 THEN 'sdf' WHEN s % 6 IN (1, 3) THEN 'json' WHEN s % 7 = 2 THEN 'pbtxt' ELSE 'unknown' END AS mass_source,
  CASE WHEN s % 7 = 2 THEN 'toy box' WHEN s % 6 = 1 THEN 'shoe' WHEN s % 6 = 3 THEN 'mug' ELSE 'unknown' END AS category
  FROM o)"""


@query("S5_discover_objects", f"""WITH {OBJECTS_SQL} SELECT object_id, mesh_path, texture_path, round(mass_kg, 6) + 0.0 AS
mass_kg, mass_source, category FROM x WHERE mesh_path IS NOT NULL""")
def discover_objects(spark, sf):
    return rounded(CAT.discover_objects(object_files(spark, sf)), "mass_kg")


@query("S6_pick_mesh", f"WITH {OBJECTS_SQL} SELECT object_id, mesh_path FROM x WHERE mesh_path IS NOT NULL")
def pick_mesh(spark, sf):
    return CAT.pick_mesh(object_files(spark, sf))


@query("S7_pick_texture", f"WITH {OBJECTS_SQL} SELECT object_id, texture_path FROM x WHERE texture_path IS NOT NULL")
def pick_texture(spark, sf):
    return CAT.pick_texture(object_files(spark, sf))


@query("S8_read_mass", f"WITH {OBJECTS_SQL} SELECT object_id, round(mass_kg, 6) + 0.0 AS mass_kg, mass_source FROM x")
def read_mass(spark, sf):
    return rounded(CAT.read_mass(object_files(spark, sf)), "mass_kg")


@query("S9_read_category", f"WITH {OBJECTS_SQL} SELECT object_id, category FROM x")
def read_category(spark, sf):
    return CAT.read_category(object_files(spark, sf))
