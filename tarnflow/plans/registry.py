"""Every query of the library with its SQL."""

from . import certificate_queries, gate_queries, metric_queries, model_queries, occurrence_queries, protocol_queries, readiness_queries, rollup_queries, selection_queries  # noqa: F401
from .occurrence_queries import ORACLE_SQL, QUERIES  # noqa: F401
