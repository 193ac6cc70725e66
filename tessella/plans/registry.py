"""All queries of the engine."""

from tessella.plans import arms, evaluation, exchange, graphs, language, ledger, lifecycle, linking, maintenance, recall, temporal, textual  # noqa: F401
from tessella.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
