"""All queries of the core by name, with their SQL."""

from __future__ import annotations

from tidemark.plans import detection_plans, report_plans, text_plans

MODULES = [text_plans, detection_plans, report_plans]
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
