"""Registered queries against their SQL on the smallest tables.

By default a cross-section; ``ALL_QUERIES=1`` compares every query.
"""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
SHORT = ["trace_summary", "trace_services_first_seen", "trace_filter_attr_same_span", "trace_list_top20", "span_dedupe_echo_rule", "span_last_change",
         "span_cap", "source_health", "span_peer", "sequence_messages", "sequence_participants", "span_depth", "flow_verdicts", "flow_best_trace",
         "verdict_change_feed", "span_inventory", "pseudonym_numbers", "masked_trace_spans", "otlp_round_trip", "ingest_xray", "stream_equals_batch", "store_all_traces", "span_depth_large_traces", "diagram_events_all", "masked_trace_summaries", "ingest_otlp_proto",
         "orphan_span_list", "root_span_list"]
ORACLES = entry.oracle_sql()
NAMES = sorted(ORACLES) if os.environ.get("ALL_QUERIES") else SHORT


def norm(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sql, name):
    df = entry.queries()[name](spark, SF)
    names = sorted(df.columns)
    result = sql.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == names
    want = sorted(repr([norm(r[columns.index(c)]) for c in names]) for r in result.fetchall())
    assert sorted(repr([norm(r[c]) for c in names]) for r in df.collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(ORACLES) <= set(entry.queries())
