"""All registered queries."""

from __future__ import annotations

import importlib

from .registry import ORACLES, QUERIES

for _name in ("catalog_plans", "merge_plans", "page_plans", "text_plans", "work_plans"):
    importlib.import_module(f"{__name__}.{_name}")

__all__ = ["ORACLES", "QUERIES"]
