"""Everything registered, by importing the query modules."""

from spanloom.plans import (  # noqa: F401
    flow_queries, ingest_queries, privacy_queries, report_queries, sequence_queries, streaming_queries, trace_queries,
)
from spanloom.plans.registry import ORACLES, QUERIES  # noqa: F401
