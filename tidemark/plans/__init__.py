"""Named queries, grouped by theme."""

from __future__ import annotations

from importlib import import_module

THEMES = (
    "cleaning",
    "aggregation",
    "windowing",
    "anomalies",
    "forecasting",
    "texts",
    "models",
    "files",
    "streams",
)


def load() -> None:
    """Import every theme, which registers its queries."""
    for theme in THEMES:
        import_module(f"tidemark.plans.{theme}")
