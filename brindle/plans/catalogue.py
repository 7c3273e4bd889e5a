"""All queries over the driver's tables, with their SQL; importing a module registers its queries."""

from __future__ import annotations

from brindle.plans import captured, documents, jobs, linked, products, runs, streams, values, web
from brindle.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "captured", "documents", "jobs", "linked", "products", "runs", "streams", "values", "web"]
