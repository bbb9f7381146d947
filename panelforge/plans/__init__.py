"""End-to-end plans and the registered queries."""

from importlib import import_module

MODULES = ("source_queries", "profile_queries", "panel_queries", "ensemble_queries", "probability_queries", "discovery_queries", "model_queries")


def all_queries() -> None:
    """Import every module that registers queries."""
    for name in MODULES:
        import_module(f"panelforge.plans.{name}")
