"""The registered queries of the engine's operators."""

from lodestone.plans import chunker_queries, diagnostic_queries, evaluation_queries, extension_queries, fuller_queries, governance_queries, index_queries, lifecycle_queries, metric_queries, operations_queries, ranking_queries, retrieval_queries, safety_queries, stream_queries
from lodestone.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "chunker_queries", "diagnostic_queries", "evaluation_queries", "extension_queries", "fuller_queries", "governance_queries", "index_queries", "lifecycle_queries", "metric_queries", "operations_queries", "ranking_queries", "retrieval_queries", "safety_queries", "stream_queries"]
