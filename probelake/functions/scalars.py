"""Scalar column functions (clamps, range maps, geometry, unit and text formatting)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from probelake import constants as K


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip01(x) -> Column:
    """Clamp to [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), col(x)))


def lerp(lo: float, hi: float, t) -> Column:
    """Linear map of t in [0, 1] to [lo, hi]."""
    return F.lit(lo) + F.lit(hi - lo) * col(t)


def log_lerp(lo: float, hi: float, t) -> Column:
    """Geometric map of t in [0, 1] to [lo, hi]."""
    return F.exp(F.log(F.lit(lo)) + (F.log(F.lit(hi)) - F.log(F.lit(lo))) * col(t))


def inv_lin(x, lo: float, hi: float) -> Column:
    """Inverse of :func:`lerp`."""
    return (col(x) - lo) / (hi - lo)


def inv_log(x, lo: float, hi: float) -> Column:
    """Inverse of :func:`log_lerp`."""
    return (F.log(col(x)) - F.log(F.lit(lo))) / (F.log(F.lit(hi)) - F.log(F.lit(lo)))


def hsv_to_rgb(h, s, v) -> Column:
    """C4: HSV to an RGB struct, sector by sector."""
    h, s, v = col(h), col(s), col(v)
    sector = F.floor(h * 6.0)
    f = h * 6.0 - sector
    p, q, t = v * (1.0 - s), v * (1.0 - s * f), v * (1.0 - s * (1.0 - f))
    table = {"r": (v, q, p, p, t, v), "g": (t, v, v, q, p, p), "b": (p, p, t, v, v, q)}

    def channel(values):
        out = F.when(F.pmod(sector, F.lit(6)) == 0, values[0])
        for i in range(1, 6):
            out = out.when(F.pmod(sector, F.lit(6)) == i, values[i])
        return out

    return F.struct(*[channel(vals).alias(name) for name, vals in table.items()])


def angle_from_up(up) -> Column:
    """Degrees between a vector and the vertical; a zero vector counts as unit length."""
    u = col(up)
    norm = F.sqrt(u[0] * u[0] + u[1] * u[1] + u[2] * u[2])
    cosine = u[2] / F.when(norm == 0.0, 1.0).otherwise(norm)
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))


def sq_dist(a, b) -> Column:
    """Squared Euclidean distance of two arrays."""
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def dist(a, b) -> Column:
    """Euclidean distance of two arrays."""
    return F.sqrt(sq_dist(a, b))


def quat_to_up(quat) -> Column:
    """World direction of the local +Z axis for a (w, x, y, z) quaternion."""
    w, x, y, z = (col(quat)[i] for i in range(4))
    return F.array(2.0 * (x * z + w * y), 2.0 * (y * z - w * x), 1.0 - 2.0 * (x * x + y * y))


def ternary_code(h) -> Column:
    """round(tanh(h)) per element, half to even, as integers in {-1, 0, 1}."""
    return F.transform(col(h), lambda x: F.rint(F.tanh(x)).cast("int"))


def scene_key(split, i) -> Column:
    """``{split}_{i:06d}``."""
    return F.format_string("%s_%06d", col(split), col(i).cast("bigint"))


def bits(n_clusters) -> Column:
    """Bits carried by a choice among n clusters."""
    return F.log2(col(n_clusters).cast("double"))


def code_bits(k) -> Column:
    """Bits carried by k ternary digits."""
    return F.log2(F.lit(3.0)) * col(k)


def normalized_essence(density, friction, restitution) -> Column:
    """Physics divided by the fixed normalizers."""
    raw = dict(zip(K.ESSENCE_FIELDS, (density, friction, restitution), strict=True))
    return F.struct(*[(col(c) / K.PHYSICS_NORMALIZERS[n]).alias(n) for n, c in raw.items()])


def weight_to_kg(entries) -> Column:
    """First listed weight with a known unit and a positive numeric value, in kilograms."""

    def kilograms(entry):
        unit = F.when(entry["normalized_value"].isNotNull(), entry["normalized_value"]["unit"]).otherwise(entry["unit"])
        value = F.when(entry["normalized_value"].isNotNull(), entry["normalized_value"]["value"]).otherwise(
            entry["value"])
        factor = reduce(lambda acc, kv: acc.when(unit == kv[0], F.lit(kv[1])), K.WEIGHT_TO_KG.items(),
                        F.when(F.lit(False), F.lit(0.0)))
        return number_or_null(value.cast("string")) * factor

    return F.get(F.filter(F.transform(col(entries), kilograms), lambda kg: (kg > 0) & ~F.isnan(kg)), F.lit(0))


def half_height(extent_z, scale) -> Column:
    """Scaled half extent along z, at least a millimetre."""
    return F.greatest(col(extent_z) * col(scale) / 2.0, F.lit(1e-3))


def derived_density(mass, volume, scale, watertight) -> Column:
    """Mass over scaled volume for watertight meshes with a usable volume."""
    scaled = F.abs(col(volume)) * F.pow(col(scale), F.lit(3.0))
    return F.when(col(watertight) & (scaled > 1e-9), F.try_divide(col(mass), scaled))


def mass_from_density(density, volume, watertight) -> Column:
    """Density times volume, only when the mesh is watertight."""
    return F.when(col(watertight), col(density) * col(volume))


def stripped(text) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(col(text), r"(?U)^\s+|\s+$", "")


_NUMBER = r"(?i)^[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf|infinity|nan)$"


def number_or_null(text) -> Column:
    """A decimal, exponent, inf or nan literal as a double; anything else is null."""
    t = stripped(text)
    return F.when(t.rlike(_NUMBER), t.try_cast("double"))


def coerce_outcome(field: str, text, is_boolean=None) -> Column:
    """A reply value as a number; ``toppled`` also understands yes/no words, real booleans are 1/0."""
    word = F.lower(stripped(text))
    number = number_or_null(text)
    if field == "toppled":
        return F.when(word.isin("true", "yes"), 1.0).when(word.isin("false", "no"), 0.0).otherwise(number)
    if is_boolean is None:
        return number
    return F.when(col(is_boolean), F.when(word == "true", 1.0).otherwise(0.0)).otherwise(number)


def fixed(x, digits: int) -> Column:
    """Fixed-point text, half to even on the exact binary value."""
    return F.call_function("format_number", col(x).cast("double"), F.lit("0." + "0" * digits if digits else "0"))


def toppled_number(text) -> Column:
    """A stored ``toppled`` value (JSON boolean or probability, read as text) as a number."""
    word = F.lower(col(text))
    return F.when(word == "true", 1.0).when(word == "false", 0.0).otherwise(col(text).try_cast("double"))
