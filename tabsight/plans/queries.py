"""All registered queries with their oracle SQL."""

from . import q_blueprint, q_cleaning, q_facts, q_profile, q_run, q_stats  # noqa: F401 - registers on import
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
