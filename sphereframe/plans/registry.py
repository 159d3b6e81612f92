"""Every grid query by name, with the SQL that gives the same rows."""

from sphereframe.plans.queries import ORACLES, QUERIES, flagship

__all__ = ["ORACLES", "QUERIES", "flagship"]
