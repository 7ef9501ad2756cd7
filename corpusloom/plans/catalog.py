"""All registered queries of the retrieval engine and their SQL."""

from . import queries, queries_branches, queries_documents, queries_index, queries_ranking, queries_streams, queries_web
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "queries", "queries_branches", "queries_documents", "queries_index", "queries_ranking", "queries_streams", "queries_web"]
