"""All queries over the driver tables, and their SQL."""

from newsloom.plans import article_queries, graph_queries, ingest_queries, knowledge_queries, reader_queries, record_queries, rule_queries, search_queries, stream_queries, text_queries, vault_queries  # noqa: F401
from newsloom.plans.core import ORACLES, QUERIES  # noqa: F401
