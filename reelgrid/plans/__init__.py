"""Queries over the driver tables, by family."""

from importlib import import_module, util

FAMILIES = ["catalog", "retrieval", "cues", "discovery", "jobs", "evaluation", "dedup", "frames", "scalars", "metrics", "inout", "streams"]


def load_all() -> None:
    for name in FAMILIES:
        if util.find_spec(f"reelgrid.plans.{name}") is not None:
            import_module(f"reelgrid.plans.{name}")
