"""All query modules, imported for their registrations."""

# ruff: noqa: F401
from probelake.plans import (
    alignment_queries,
    catalog_queries,
    reply_queries,
    sampling_queries,
    scene_queries,
    split_queries,
    stat_queries,
    study_queries,
    trajectory_queries,
)
from probelake.plans.registry import QUERIES, SQL
