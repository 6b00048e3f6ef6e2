"""Explicit read schemas: scene records, manifests, listings, run metrics."""

from pyspark.sql import types as T

DOUBLES = T.ArrayType(T.DoubleType())


def _struct(**fields):
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


S, I, D, B = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType()

FRAME = _struct(index=I, file=S, position=DOUBLES, look_at=DOUBLES)
TRAJECTORY_FRAME = _struct(t=D, pos=DOUBLES, up=DOUBLES)
ESSENCE = _struct(density=D, friction=D, restitution=D)
PHYSICS = _struct(
    raw=ESSENCE,
    normalized=ESSENCE,
    tags=T.ArrayType(S),
    mass_kg=D,
    provenance=_struct(mass=S, density=S, friction=S, restitution=S),
)
SPEC = _struct(
    kind=S, height=D, angle_deg=D, impulse=D, height_frac=D, azimuth_deg=D,
    topple_jitter=_struct(reps=I, impulse_rel=D, azimuth_deg=D, n_samples=I),
)


def outcome(toppled: T.DataType):
    return _struct(toppled=toppled, settle_time=D, slid_distance=D, n_bounces=D, max_height=D,
                   path_length=D, final_tilt_deg=D)


def probe(toppled: T.DataType):
    return _struct(probe=S, spec=SPEC, outcome=outcome(toppled), trajectory=T.ArrayType(TRAJECTORY_FRAME))


def scene(toppled: T.DataType = D) -> T.StructType:
    """Scene record; on disk ``toppled`` is a JSON boolean or number, so it is read as text."""
    return _struct(
        scene_id=S, split=S, schema_version=I, generator=S,
        input=_struct(shape=S, material=S),
        appearance=_struct(resolution=I, frames=T.ArrayType(FRAME)),
        physics=PHYSICS,
        behavior=_struct(probes=T.ArrayType(probe(toppled))),
        dynamics=_struct(fps=I, trajectory=T.ArrayType(_struct(frame=I, position=DOUBLES))),
        material_truth=_struct(
            factors=_struct(heaviness=D, grip=D, hardness=D, clarity=D),
            nearest_anchor=S,
            appearance_params=_struct(base_color=DOUBLES, roughness=D, metallic=D, transmission=D, ior=D),
            object_id=S, category=S, mass_kg=D, mass_source=S, note=S, watertight=B,
            collision=_struct(method=S, n_parts=I, concavity_preserved=B, degraded=B, note=S),
        ),
    )


MANIFEST_SCENE = _struct(scene_id=S, split=S, shape=S, material=S)
MANIFEST = _struct(
    version=I, generator=S,
    split_summary=T.MapType(S, T.LongType()),
    held_out_combinations=T.ArrayType(T.ArrayType(S)),
    holdout_region=_struct(kind=S, density=DOUBLES, friction=DOUBLES, restitution=DOUBLES),
    holdout_categories=T.ArrayType(S),
    scenes=T.ArrayType(MANIFEST_SCENE),
)

WEIGHT_ENTRY = _struct(normalized_value=_struct(unit=S, value=S), unit=S, value=S)
LISTING = T.StructType([
    T.StructField("3dmodel_id", S),
    T.StructField("item_weight", T.ArrayType(WEIGHT_ENTRY)),
    T.StructField("product_type", T.ArrayType(_struct(value=S))),
])

RUN_METRICS = _struct(
    config=_struct(latent_dim=I, image_size=I, fsq_k=I, w_behavior=D, w_essence=D, w_render=D, w_appearance=D,
                   seed=I),
    history=T.ArrayType(_struct(step=I, train=D, test=D, latent_pr=D)),
)
