"""Imports every operator module, which registers its queries."""

from importlib import import_module

from tidegauge.llm.common import ORACLES, QUERIES

MODULES = [
    "chat_format",
    "decontamination",
    "hard_negatives",
    "line_dedup",
    "lm_scoring",
    "mixing",
    "near_dedup",
    "quality_rules",
    "run_detection",
    "secret_scan",
    "substring_dedup",
    "token_counts",
    "toxicity",
]

for _name in MODULES:
    import_module(f"tidegauge.llm.{_name}")

__all__ = ["ORACLES", "QUERIES"]
