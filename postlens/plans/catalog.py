"""Every registered query and oracle; importing a module registers its queries."""

from __future__ import annotations

import importlib

from postlens.plans.registry import HEADLINE, ORACLES, QUERIES

MODULES = ["q_prep", "q_text", "q_stats", "q_models", "q_prompts", "q_io", "q_extras"]

for _m in MODULES:
    importlib.import_module(f"postlens.plans.{_m}")

__all__ = ["QUERIES", "ORACLES", "HEADLINE"]
