"""Registered queries, each with its SQL."""

from nilas.plans import budget, climatology, domains, regrid, skill, stores, tables, transition, trends
from nilas.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "budget", "climatology", "domains", "regrid", "skill", "stores", "tables", "transition", "trends"]
