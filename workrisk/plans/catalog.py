"""Imports every query module so that the registry is complete."""

from __future__ import annotations

from workrisk.plans.registry import REGISTRY, Query


def all_queries() -> dict[str, Query]:
    from workrisk.plans import q_dash, q_exposure, q_graph, q_profile, q_rollup, q_skills, q_sources  # noqa: F401
    return dict(REGISTRY)
