"""All registered queries and their SQL twins."""

from tidekb.catalog import metric_queries, enrich_queries, ingest_queries, dedup_queries, search_queries, log_queries, evaluation_queries, source_queries, report_queries, stream_queries  # noqa: F401
from tidekb.catalog.base import ORACLE, QUERIES  # noqa: F401
