"""Queries over the test tables, each with the SQL it must agree with where SQL can say it."""

from millrace.queries import actions, basics, lineage, workloads
from millrace.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "actions", "basics", "lineage", "workloads"]
