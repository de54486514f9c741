"""Registered queries over the given tables."""
from textjobs.plans import prep, runs, scores, text  # noqa: F401
from textjobs.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
