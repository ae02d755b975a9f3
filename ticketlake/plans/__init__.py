"""Named queries over the benchmark tables and their SQL statements."""

import importlib

from ticketlake.plans.registry import QUERIES, STATEMENTS

for module in ("browsing", "backlog", "search", "decision", "catalogue", "scalars", "documents", "parsing", "classification", "reconciliation", "audits", "streams", "extensions"):
    importlib.import_module(f"ticketlake.plans.{module}")

__all__ = ["QUERIES", "STATEMENTS"]
