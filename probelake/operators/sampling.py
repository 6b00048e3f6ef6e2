"""Synthetic materials and actions: hidden factors, physics and appearance maps, coupling dials."""

from __future__ import annotations

from collections.abc import Mapping
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probelake import constants as K
from probelake.functions import scalars as C
from probelake.functions.hashing import below, gaussian, uniform
from probelake.functions.scalars import col
from probelake.operators.records import lookup_material, nearest_anchor
from probelake.operators.splits import region_label
from probelake.session import widen

APPEARANCE_NOISE = 0.07


def physics_map(factors: Mapping[str, Column]) -> dict[str, Column]:
    """Density (log scale), friction and restitution of the hidden factors."""
    return {
        "density": C.log_lerp(*K.DENSITY_RANGE, factors["heaviness"]),
        "friction": C.lerp(*K.FRICTION_RANGE, factors["grip"]),
        "restitution": C.lerp(*K.RESTITUTION_RANGE, factors["hardness"]),
    }


def add_appearance(df: DataFrame, factors: Mapping[str, Column], draws: Mapping[str, Column], gain: float = 1.0) -> DataFrame:
    """Add base_color, roughness, metallic, transmission and ior of the factors, given the noise draws.

    ``draws`` holds n_metallic, n_roughness, n_transmission, n_value (already scaled noise) and u_hue,
    u_saturation. ``gain`` above 1 blends metallic, roughness and brightness toward one factor each with
    weight 1 - 1/gain. Draws and channels that are used more than once get a projection of their own, so
    that no hash is computed twice.
    """
    if gain < 1.0:
        raise ValueError(f"coupling gain must be >= 1, got {gain}")
    staged = df.select("*", *[factors[f].alias(f"_f_{f}") for f in K.FACTOR_FIELDS], *[c.alias(f"_d_{n}") for n, c in draws.items()])
    heavy, grip, hard, clear = (F.col(f"_f_{f}") for f in K.FACTOR_FIELDS)
    d = {n: F.col(f"_d_{n}") for n in draws}
    looks = {
        "metallic": C.clip01((heavy * 1.2 - 0.2) * (F.lit(1.0) - clear) + d["n_metallic"]),
        "roughness": C.clip01(F.lit(0.90) - hard * 0.55 - clear * 0.70 + grip * 0.25 + d["n_roughness"]),
        "_value": C.clip01(F.lit(0.85) - heavy * 0.35 + d["n_value"]),
    }
    w = 1.0 - 1.0 / gain
    if w > 0.0:
        legible = {"metallic": heavy, "roughness": grip, "_value": F.lit(1.0) - hard}
        looks = {k: C.clip01(v * (1.0 - w) + legible[k] * w) for k, v in looks.items()}
    looks["roughness"] = F.greatest(F.lit(0.02), looks["roughness"])
    staged = staged.select("*", *[c.alias(n) for n, c in looks.items()], C.clip01(clear + d["n_transmission"] * 0.5).alias("transmission"),
                           C.lerp(1.30, 1.50, clear).alias("ior"))
    staged = staged.withColumn("_saturation", C.clip01(F.lit(0.15) + d["u_saturation"] * 0.45 - F.col("transmission") * 0.3))
    staged = staged.withColumn("_rgb", C.hsv_to_rgb(d["u_hue"], F.col("_saturation"), F.col("_value")))
    color = F.array(F.col("_rgb.r"), F.col("_rgb.g"), F.col("_rgb.b"), F.lit(1.0)).alias("base_color")
    return staged.select(*df.columns, color, "roughness", "metallic", "transmission", "ior")


def _draws(seed: int, keys, noise: float) -> dict[str, Column]:
    out = {f"n_{c}": gaussian(seed, f"noise/{c}", *keys) * noise for c in ("metallic", "roughness", "transmission", "value")}
    out["u_hue"] = uniform(seed, "hue", *keys)
    out["u_saturation"] = uniform(seed, "saturation", *keys)
    return out


def decoupled(factors: Mapping[str, Column], alpha: float, seed: int, keys) -> dict[str, Column]:
    """Factors as the appearance sees them: alpha of the truth, the rest an independent decoy.

    Decoys have hash streams of their own, so no dial setting moves the true factors or the physics.
    """
    if not 0.0 <= alpha <= 1.0:
        raise ValueError(f"coupling alpha must be in [0, 1], got {alpha}")
    if alpha >= 1.0:
        return dict(factors)
    seen = dict(factors)
    for f in ("heaviness", "grip", "hardness"):
        seen[f] = factors[f] * alpha + uniform(seed, f"decoy/{f}", *keys) * (1.0 - alpha)
    return seen


def _finish(df: DataFrame, seed: int, keys, noise: float, alpha: float, gain: float) -> DataFrame:
    """Physics, appearance and anchor columns from factor columns; every step is a projection."""
    factors = {f: F.col(f) for f in K.FACTOR_FIELDS}
    out = df.select("*", *[c.alias(n) for n, c in physics_map(factors).items()])
    out = add_appearance(out, decoupled(factors, alpha, seed, keys), _draws(seed, keys, noise), gain)
    return out.withColumn("nearest_anchor", nearest_anchor("density", "friction", "restitution"))


def sample_material(df: DataFrame, *keys: str, seed: int = 0, noise: float = APPEARANCE_NOISE, alpha: float = 1.0,
                    gain: float = 1.0) -> DataFrame:
    """One continuous material per row, a pure function of (seed, key): three U(0,1) factors and U^3 clarity."""
    u = {f: uniform(seed, f, *keys) for f in K.FACTOR_FIELDS}
    u["clarity"] = F.pow(u["clarity"], F.lit(3.0))
    return _finish(df.select("*", *[c.alias(f) for f, c in u.items()]), seed, keys, noise, alpha, gain)


def sample_near(df: DataFrame, anchor: str, *keys: str, jitter: float = 0.15, seed: int = 0,
                noise: float = APPEARANCE_NOISE, alpha: float = 1.0, gain: float = 1.0) -> DataFrame:
    """Y2: uniform jitter around a named anchor (column ``anchor``) in factor space, clipped to [0, 1]."""
    m = F.col("material")
    center = {
        "heaviness": C.inv_log(m["density"], *K.DENSITY_RANGE), "grip": C.inv_lin(m["friction"], *K.FRICTION_RANGE),
        "hardness": C.inv_lin(m["restitution"], *K.RESTITUTION_RANGE), "clarity": m["transmission"],
    }
    moved = {f: C.clip01(c + (uniform(seed, f"jitter/{f}", *keys) * 2.0 - 1.0) * jitter) for f, c in center.items()}
    based = lookup_material(df, anchor).select("*", *[c.alias(f) for f, c in moved.items()]).drop("material")
    return _finish(based, seed, keys, noise, alpha, gain)


def assign_scenes(slots: DataFrame, slot: str, shapes: list[str], box: Mapping[str, tuple[float, float]], seed: int = 0,
                  region_shapes: tuple[str, ...] = (), **dials) -> DataFrame:
    """A shape and a sampled material per slot, labelled by region of normalized physics."""
    pick = below(F.lit(len(shapes)), seed, "shape", slot).cast("int")
    drawn = sample_material(slots.withColumn("shape", F.element_at(F.array(*[F.lit(s) for s in shapes]), pick + 1)),
                            slot, seed=seed, **dials)
    essence = {f: F.col(f) / K.PHYSICS_NORMALIZERS[f] for f in K.ESSENCE_FIELDS}
    split = region_label(box, essence, "shape", region_shapes)
    return drawn.withColumn("split", split).withColumn("scene_id", C.scene_key("split", slot))


def jittered_actions(df: DataFrame, reps: int, *keys: str, seed: int = 0, impulse_rel: float = 0.03,
                     azimuth_deg: float = 2.0) -> DataFrame:
    """``reps`` jittered copies of every push (columns impulse, azimuth_deg)."""
    spread = df.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    return (
        spread.withColumn("impulse", F.col("impulse") * (F.lit(1.0) + gaussian(seed, "impulse", *keys, "rep") * impulse_rel))
        .withColumn("azimuth_deg", F.col("azimuth_deg") + gaussian(seed, "azimuth", *keys, "rep") * azimuth_deg)
    )


def direction_block(ids, dim: int, n: int, seed: int) -> np.ndarray:
    """Gaussian directions (len(ids), n, dim), each entry keyed by (seed, id, direction, position)."""
    ends = [f"{d}|{j}".encode() for d in range(n) for j in range(dim)]

    def digests(i):
        begun = md5(f"{seed}|direction|{i}|".encode())
        for end in ends:
            full = begun.copy()
            full.update(end)
            yield full.digest()

    words = np.frombuffer(b"".join(x for i in ids for x in digests(i)), dtype=">u8").astype(np.uint64).reshape(-1, 2)
    high, low = words[:, 0], words[:, 1]
    u1 = (high >> np.uint64(12)).astype(np.float64) / 2.0 ** 52     # hex digits 1-13
    u2 = (((high & np.uint64(0xFFF)) << np.uint64(40)) | (low >> np.uint64(24))).astype(np.float64) / 2.0 ** 52
    return (np.sqrt(-2.0 * np.log(1.0 - u1)) * np.cos(2.0 * np.pi * u2)).reshape(len(ids), n, dim)


def gaussian_directions(df: DataFrame, key: str, dim: int, n: int, seed: int = 0) -> DataFrame:
    """N Gaussian directions (never unit-normalized) per key: (key, direction, values)."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), 64):
                ids = pdf[key].to_numpy()[lo:lo + 64]
                block = direction_block(ids, dim, n, seed).reshape(-1, dim)
                yield pd.DataFrame({key: np.repeat(ids, n), "direction": np.tile(np.arange(n, dtype="int32"), len(ids)), "values": list(block)})

    return widen(df.select(key)).mapInPandas(run, f"{key} {kind}, direction int, values array<double>")


def coupling(df: DataFrame, x: str, y: str) -> DataFrame:
    """Measured coupling of two columns (used to compare dial settings)."""
    from probelake.operators.stats import pearson

    return df.agg(pearson(col(x), col(y)).alias("r"))
