"""Registered queries: each operator on the given tables, with SQL that computes the same result independently."""
import importlib

from panelspark.queries.registry import ORACLES, QUERIES

for _module in ("window_queries", "table_queries", "aggregate_queries", "portfolio_queries", "validation_queries", "study_queries", "source_queries"):
    importlib.import_module(f"panelspark.queries.{_module}")
