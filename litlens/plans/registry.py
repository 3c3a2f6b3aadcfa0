"""All registered queries of the literature operators, and their SQL."""

from litlens.plans import evaluate_queries, extended_queries, ingest_queries, more_queries, report_queries, search_queries, source_queries, stream_queries, text_queries, vector_queries  # noqa: F401
from litlens.plans.base import ORACLES, QUERIES  # noqa: F401
