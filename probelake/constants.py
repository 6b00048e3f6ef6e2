"""They are part of the operator semantics and must not drift."""

# Probe outcomes.
TOPPLE_ANGLE_DEG = 50.0
REST_SPEED = 0.03
PROBE_ORDER = ("drop", "tilt", "push")
OUTCOME_FIELDS = (
    "toppled",
    "settle_time",
    "slid_distance",
    "n_bounces",
    "max_height",
    "path_length",
    "final_tilt_deg",
)
OUTCOME_NORMALIZERS = {
    "toppled": 1.0,
    "settle_time": 2.0,
    "slid_distance": 1.0,
    "n_bounces": 5.0,
    "max_height": 1.5,
    "path_length": 3.0,
    "final_tilt_deg": 180.0,
}
DROP_HEIGHT = 0.6
TILT_ANGLE_DEG = 20.0
PUSH_IMPULSE = 1.5
PUSH_HEIGHT_FRAC = 0.8
PUSH_AZIMUTH_DEG = 0.0

# Physics ("essence") channels.
ESSENCE_FIELDS = ("density", "friction", "restitution")
PHYSICS_NORMALIZERS = {"density": 8000.0, "friction": 1.5, "restitution": 1.0}
DENSITY_RANGE = (50.0, 8000.0)
FRICTION_RANGE = (0.05, 1.10)
RESTITUTION_RANGE = (0.05, 0.85)
ASSUMED_FRICTION = 0.5
ASSUMED_RESTITUTION = 0.3

# Appearance channels and latent factors.
FACTOR_FIELDS = ("heaviness", "grip", "hardness", "clarity")
APPEARANCE_FIELDS = (
    "color_r",
    "color_g",
    "color_b",
    "color_a",
    "roughness",
    "metallic",
    "transmission",
    "ior",
)

# The material dimension
# (name, base color, roughness, metallic, density, friction, restitution, transmission, ior, tags).
MATERIALS = (
    ("cardboard", (0.70, 0.56, 0.36, 1.0), 0.92, 0.0, 250.0, 0.52, 0.10, 0.0, 1.45, ("light", "damping")),
    ("ceramic", (0.92, 0.90, 0.85, 1.0), 0.20, 0.0, 2300.0, 0.40, 0.30, 0.0, 1.45, ("brittle", "hard")),
    ("foam", (0.86, 0.84, 0.78, 1.0), 1.0, 0.0, 50.0, 0.60, 0.08, 0.0, 1.45, ("soft", "light", "damping")),
    ("glass", (0.92, 0.96, 0.97, 1.0), 0.02, 0.0, 2500.0, 0.45, 0.40, 1.0, 1.50, ("brittle", "transparent")),
    ("ice", (0.80, 0.90, 0.96, 1.0), 0.10, 0.0, 917.0, 0.05, 0.12, 0.80, 1.31,
     ("slippery", "transparent", "brittle")),
    ("plastic", (0.15, 0.45, 0.80, 1.0), 0.40, 0.0, 1050.0, 0.35, 0.55, 0.0, 1.45, ("synthetic",)),
    ("rubber", (0.08, 0.08, 0.09, 1.0), 0.95, 0.0, 1100.0, 1.05, 0.80, 0.0, 1.45,
     ("soft", "grippy", "bouncy")),
    ("steel", (0.56, 0.57, 0.58, 1.0), 0.22, 1.0, 7850.0, 0.42, 0.55, 0.0, 1.45, ("metal", "hard", "heavy")),
    ("stone", (0.42, 0.41, 0.40, 1.0), 0.85, 0.0, 2700.0, 0.62, 0.25, 0.0, 1.45, ("hard", "heavy", "rough")),
    ("wood", (0.45, 0.30, 0.16, 1.0), 0.70, 0.0, 700.0, 0.50, 0.40, 0.0, 1.45, ("organic",)),
)
DEFAULT_SPECULAR = 0.5

# Shape geometry (shape, geom type, size text, half height).
SHAPE_GEOMETRY = (
    ("box", "box", "0.15 0.15 0.15", 0.15),
    ("cube", "box", "0.15 0.15 0.15", 0.15),
    ("sphere", "sphere", "0.18", 0.18),
    ("cylinder", "cylinder", "0.10 0.25", 0.25),
    ("capsule", "capsule", "0.10 0.20", 0.30),
    ("ellipsoid", "ellipsoid", "0.20 0.15 0.10", 0.10),
)

# Region presets in normalized essence space (inclusive boxes).
REGION_PRESETS = {
    "interpolation": {"friction": (0.55, 0.80), "restitution": (0.55, 0.80)},
    "extrapolation": {"density": (0.55, 1.01), "restitution": (0.60, 0.90)},
}

# Product listings.
WEIGHT_TO_KG = {
    "pounds": 0.45359237,
    "kilograms": 1.0,
    "grams": 1e-3,
    "milligrams": 1e-6,
    "ounces": 0.028349523,
    "tons": 907.18474,
}
DEFORMABLE_CATEGORIES = (
    "RUG", "PILLOW", "CUSHION", "BLANKET", "QUILT", "CURTAIN", "TOWEL",
    "MATTRESS", "BED_LINEN_SET", "SLEEPING_BAG", "TAPESTRY",
    "EXERCISE_MAT", "YOGA_MAT", "MOUSE_PAD",
)
DENSITY_MIN = 10.0
DENSITY_MAX = 20000.0

# Object directories.
MESH_EXTENSIONS = (".obj", ".glb", ".gltf", ".stl", ".ply")
TEXTURE_EXTENSIONS = (".png", ".jpg", ".jpeg")
TEXTURE_HINTS = ("texture", "albedo", "basecolor", "diffuse")
PREFERRED_MESH = "meshes/model.obj"
METADATA_JSON = ("meta.json", "metadata.json", "model.json")
MASS_SDF_PATTERN = r"<mass>\s*([0-9.eE+-]+)\s*</mass>"
MASS_PBTXT_PATTERN = r"mass\s*:\s*([0-9.eE+-]+)"
CATEGORY_PBTXT_PATTERN = r"(?:categor(?:y|ies)|class)\s*:\s*\"?([A-Za-z0-9_ /-]+)\"?"
OBJECT_NOTE = "friction/restitution are assumed (GSO does not measure them)"

# Record defaults.
SCHEMA_VERSION = 2
DEFAULT_FPS = 60

# Representation measurements.
KNN_K = 10
PR_FLOOR = 8.0
PR_EPSILON = 1e-12
NULL_DRAWS = 1000
NULL_SEED = 2026

# Reference regressors.
RIDGE_ALPHA = 1e-3
ORACLE_KNN_K = 5
MAX_QUADRATIC_FEATURES = 2000
KMEANS_ROUNDS = 50
BIT_CURVE_CLUSTERS = (1, 3, 9, 81, 729)
GAIN_DENOMINATOR_FLOOR = 1e-12

# Coherence measurement.
N_DIRECTIONS = 48
FINITE_DIFFERENCE_EPS = 1e-3

# Prompt text.
CONDITIONS = ("essence", "appearance", "vision")
FENCE_PATTERN = r"(?sU)```(?:json)?\s*(\{.*?\})\s*```"
SYSTEM_PROMPT = """You are a rigid-body physics world model: given an environment state and one
action, predict the next-state summary exactly as a physics simulator would measure it.

Simulation context (MuJoCo): timestep 0.002 s, gravity 9.81 m/s^2 downward, episode
length 2.0 s. The ground is a large flat plane whose sliding-friction
coefficient equals the object's. Contact bounciness follows the object's restitution
coefficient. The object is a rigid body, free to translate and rotate.

Report these outcome fields, measured over the 2-second episode
(the object's position means its CENTER; sampling at 60 Hz):
- "toppled": true if the object's up-axis ends more than 50 degrees from vertical.
- "settle_time": seconds until the object's speed last drops below 0.03 m/s; if it is
  still moving when the episode ends, this is simply ~the episode length (2.00).
- "slid_distance": horizontal displacement of the center from start to rest, in meters.
- "n_bounces": integer count of upward reversals of vertical velocity (floor impacts).
- "max_height": peak height of the object's center above the ground, in meters.
- "path_length": total 3D distance traveled by the center, in meters.
- "final_tilt_deg": final angle of the object's up-axis from vertical, in degrees.

Reason step by step first, but keep it compact (a few hundred words): estimate, don't
derive exhaustively, and when a quantity is uncertain or a definition seems ambiguous,
commit to your best numeric estimate and move on. Then output ONE fenced ```json code
block containing exactly the keys toppled, settle_time, slid_distance, n_bounces,
max_height, path_length, final_tilt_deg. ALWAYS end with that JSON block, even if
unsure. The LAST fenced JSON block in your reply is taken as your answer."""
