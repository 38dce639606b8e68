"""All queries of the reference operators, and the SQL that says the same."""

from . import audit_queries, feature_queries, model_queries, utility_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
