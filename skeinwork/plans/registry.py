"""All query plans of the library: name to (query, DuckDB twin or None)."""

from __future__ import annotations

from . import curve_plans, derivative_plans, family_plans, field_plans, geometry_plans, graph_plans, invariant_plans, skeleton_plans, stream_plans


def plans() -> dict:
    out: dict = {}
    for m in (field_plans, derivative_plans, graph_plans, family_plans, geometry_plans, curve_plans, skeleton_plans, invariant_plans, stream_plans):
        out |= m.plans()
    return out
