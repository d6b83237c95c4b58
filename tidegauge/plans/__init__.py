"""Registered queries, one module per operator group."""

from importlib import import_module

MODULES = [
    "storing",
    "ordering",
    "scoring",
    "injecting",
    "recovering",
    "modelling",
    "streams",
    "suites",
]


def load_all() -> None:
    for name in MODULES:
        import_module(f"tidegauge.plans.{name}")
