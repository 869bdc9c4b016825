"""All registered queries. Importing the modules fills the registry."""

from tidelex.plans import q_metrics, q_series, q_state, q_stores, q_stream, q_text  # noqa: F401
from tidelex.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
