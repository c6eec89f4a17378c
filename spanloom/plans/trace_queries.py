"""Queries over traces and the store."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.ids import normalize_id
from spanloom.functions.spans import host_of, path_of, peer
from spanloom.functions.values import attribute, value_matches
from spanloom.operators import runs, store
from spanloom.operators.summaries import (LIST_LIMIT, TraceFilter, newest_first, orphan_spans, root_spans,
                                          trace_summaries)
from spanloom.plans.derived import ARRIVALS_SQL, SPANS_SQL, arrival_log, spans, table
from spanloom.plans.registry import query
from spanloom.session import shared_folder

_WITH = f"with {SPANS_SQL}"
_LOG = f"with {ARRIVALS_SQL}"

# One row per trace, the list columns as text.
_SUMMARY_SQL = f"""{_WITH},
t as (select s.*, s.parent_id is not null and not exists (
        select 1 from spans p where p.trace_id = s.trace_id and p.span_id = s.parent_id) as lost from spans s),
r as (select *, row_number() over (partition by trace_id order by case when parent_id is null then 0 when lost then 1 else 2 end,
        start_ns, span_id) as rn from t),
f as (select trace_id, service, min(lpad(cast(start_ns as varchar), 20, '0') || cast(parent_id is not null as int) || span_id) as k from t group by 1, 2),
sv as (select trace_id, string_agg(service, ' > ' order by k) as services from f group by 1),
su as (select t.trace_id, max(case when rn = 1 then name end) as root, max(case when rn = 1 then service end) as root_service,
         count(*) as spans, count(*) filter (status = 'error') as errors, count(*) filter (lost) as orphans,
         min(start_ns) as start_ns, max(end_ns) as end_ns, (max(end_ns) - min(start_ns)) / 1e6 as duration_ms,
         string_agg(distinct source, ',' order by source) as sources
       from r t group by t.trace_id)
"""
_LISTED = """trace_id, root, root_service, spans, errors, orphans, start_ns, end_ns, duration_ms, sources"""


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumn("services", F.concat_ws(" > ", "services")).withColumn("sources", F.concat_ws(",", "sources"))


@query(_SUMMARY_SQL + f"select {_LISTED} from su")
def trace_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(trace_summaries(spans(spark, sf))).drop("services")


@query(_SUMMARY_SQL + "select trace_id, services from sv")
def trace_services_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(trace_summaries(spans(spark, sf))).select("trace_id", "services")


def _filtered(spark: SparkSession, sf: str, where: TraceFilter) -> DataFrame:
    return _flat(trace_summaries(spans(spark, sf), where)).drop("services")


_SINCE = 12_000_000_000_000


@query(_SUMMARY_SQL + f"select {_LISTED} from su where end_ns >= {_SINCE}")
def trace_filter_since(spark: SparkSession, sf: str) -> DataFrame:
    return _filtered(spark, sf, TraceFilter(since_ns=_SINCE))


@query(_SUMMARY_SQL + f"select {_LISTED} from su where trace_id in (select trace_id from spans where regexp_full_match(service, 's.*-[13]'))")
def trace_filter_service_glob(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(trace_summaries(
        spans(spark, sf), TraceFilter(service="s*-1")).unionByName(
        trace_summaries(spans(spark, sf), TraceFilter(service="s??-3"))).dropDuplicates(["trace_id"])).drop("services")


@query(_SUMMARY_SQL + f"select {_LISTED} from su where trace_id in (select trace_id from spans where name like 'retry%')")
def trace_filter_name_glob(spark: SparkSession, sf: str) -> DataFrame:
    return _filtered(spark, sf, TraceFilter(name="retry*"))


@query(_SUMMARY_SQL + f"select {_LISTED} from su where errors > 0")
def trace_filter_errors(spark: SparkSession, sf: str) -> DataFrame:
    return _filtered(spark, sf, TraceFilter(errors_only=True))


@query(_SUMMARY_SQL + f"""select {_LISTED} from su where trace_id in
  (select trace_id from spans where a_items = 3 and regexp_matches(a_run, '^r-[12]$') and a_card is null)""")
def trace_filter_attr_same_span(spark: SparkSession, sf: str) -> DataFrame:
    return _filtered(spark, sf, TraceFilter(attributes={
        "order.items": "3", "test.run": "re:^r-[12]$", "card.number": "!"}))


@query(_SUMMARY_SQL + f"select {_LISTED} from su order by start_ns desc, trace_id limit 20")
def trace_list_top20(spark: SparkSession, sf: str) -> DataFrame:
    return _filtered(spark, sf, TraceFilter(limit=LIST_LIMIT))


@query(_SUMMARY_SQL + f"select {_LISTED} from su where errors > 0 order by start_ns desc, trace_id limit 300")
def failed_traces_newest(spark: SparkSession, sf: str) -> DataFrame:
    """Which traces failed, where do they start, how long did they take."""
    return newest_first(_filtered(spark, sf, TraceFilter(errors_only=True, limit=300)))


# Ids and references in one pass: what is only ever referred to is missing.
_LOST = f"""{_WITH},
refs as (select trace_id, span_id as id, 1 as here, null as child from spans
  union all select trace_id, parent_id, 0, struct_pack(span_id := span_id, service := service) from spans where parent_id is not null),
lost as (select trace_id, id, list(child) filter (here = 0) as children from refs group by 1, 2 having max(here) = 0),
orphans as (select trace_id, id as parent_id, unnest(children) as child from lost)
"""


@query(_LOST + "select trace_id, child.span_id as span_id, parent_id, child.service as service from orphans")
def orphan_span_list(spark: SparkSession, sf: str) -> DataFrame:
    return orphan_spans(spans(spark, sf).select("trace_id", "span_id", "parent_id", "service"))


@query(_LOST + """select trace_id, child.span_id as span_id, child.service as service from orphans
  union all select trace_id, span_id, service from spans where parent_id is null""")
def root_span_list(spark: SparkSession, sf: str) -> DataFrame:
    return root_spans(spans(spark, sf).select("trace_id", "span_id", "parent_id", "service")).drop("parent_id")


# ------------------------------------------------------------------ store

_COPY = "trace_id, span_id, end_ns, source, mode, arrival_seq"


@query(f"""{_LOG} select {_COPY} from arrivals
  qualify row_number() over (partition by trace_id, span_id order by arrival_seq desc) = 1""")
def span_dedupe_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    return store.last_wins(arrival_log(spark, sf)).select(*_COPY.split(", "))


# The in-order rule, written with windows: the held source before each copy.
_FOLD = f"""{_LOG},
h as (select *, coalesce(
        last_value(case when mode = 'push' then source end ignore nulls) over w,
        first_value(source) over w) as held
      from arrivals window w as (partition by trace_id, span_id order by arrival_seq rows between unbounded preceding and 1 preceding)),
accepted as (select * from h where mode = 'push' or held is null or held = source),
stored as (select * from accepted qualify row_number() over (partition by trace_id, span_id order by arrival_seq desc) = 1),
changes as (select trace_id, span_id, max(arrived_ms) as changed_ms from
      (select *, lag(end_ns || source) over (partition by trace_id, span_id order by arrival_seq) as before from accepted)
      where before is null or before <> end_ns || source group by 1, 2),
updates as (select trace_id, max(changed_ms) as updated_ms from changes group by 1)
"""


@query(_FOLD + f"select {_COPY} from stored")
def span_dedupe_echo_rule(spark: SparkSession, sf: str) -> DataFrame:
    return store.dedupe(arrival_log(spark, sf)).select(*_COPY.split(", "))


@query(_FOLD + "select trace_id, span_id, changed_ms from changes")
def span_last_change(spark: SparkSession, sf: str) -> DataFrame:
    return store.last_changes(arrival_log(spark, sf))


@query(_FOLD + """, firsts as (select trace_id, span_id, min(arrival_seq) as first_seq from arrivals group by 1, 2),
ranked as (select *, row_number() over (partition by trace_id order by first_seq, span_id) as rn from firsts)
select trace_id, span_id from ranked where rn <= 4""")
def span_cap(spark: SparkSession, sf: str) -> DataFrame:
    return store.cap_spans(store.dedupe(arrival_log(spark, sf)), limit=4).select("trace_id", "span_id")


@query(_FOLD + """select trace_id, updated_ms from updates order by updated_ms desc, trace_id desc limit 2000""")
def trace_retention(spark: SparkSession, sf: str) -> DataFrame:
    log = arrival_log(spark, sf)
    return store.retained(store.trace_updates(store.dedupe(log), store.last_changes(log)), 2000)


@query(_FOLD + "select s.trace_id, s.span_id, u.updated_ms from stored s join updates u on u.trace_id = s.trace_id")
def store_all_traces(spark: SparkSession, sf: str) -> DataFrame:
    """Without limits the store keeps every span of every trace."""
    return store.store(arrival_log(spark, sf)).select("trace_id", "span_id", "updated_ms")


@query(_FOLD + """select count(distinct trace_id) as traces, count(*) as spans from stored""")
def store_counters(spark: SparkSession, sf: str) -> DataFrame:
    return store.counters(store.dedupe(arrival_log(spark, sf)))


@query(_FOLD + """select count(distinct s.trace_id) as traces, count(*) as spans, (select count(*) from stored) as spans_added, max(u.updated_ms) as last_update_ms
  from stored s join (select * from updates order by updated_ms desc, trace_id desc limit 500) u on u.trace_id = s.trace_id""")
def store_counters_while_written(spark: SparkSession, sf: str) -> DataFrame:
    """All counters of a store that keeps 500 traces, taken while it is written."""
    counted = store.counted_store(arrival_log(spark, sf), max_traces=500)
    counted.table.write.parquet(f"{shared_folder(spark)}/counted-{uuid.uuid4().hex}")
    return spark.createDataFrame([counted.values()], "traces long, spans long, spans_added long, last_update_ms long")


@query(f"""{_LOG}, first_seen as (select source, service, min(arrival_seq) as k from arrivals group by 1, 2)
select a.source, a.spans, a.traces, f.services from
  (select source, count(*) as spans, count(distinct trace_id) as traces from arrivals group by 1) a
  join (select source, string_agg(service, ',' order by k, service) as services from first_seen group by 1) f using (source)""")
def source_run_report(spark: SparkSession, sf: str) -> DataFrame:
    return runs.run_report(arrival_log(spark, sf), ["source"]).withColumn("services", F.concat_ws(",", "services"))


_HEALTH_SQL = f"""{_LOG},
d as (select *, arrived_ms // 500000 as run, start_ns // 1000000000 % 3 = 0 as bad from arrivals),
r as (select source, run, count(*) as spans, count(distinct trace_id) as traces, max(arrived_ms) as run_ms, run % 3 = 0 as failed from d group by source, run)
select source, count(*) as runs, max(run_ms) as last_run_ms, max(run_ms) filter (not failed) as last_ok_ms,
  coalesce(arg_max(spans, run_ms) filter (not failed), 0) as spans_last, cast(coalesce(sum(spans) filter (not failed), 0) as bigint) as spans_total,
  coalesce(arg_max(traces, run_ms) filter (not failed), 0) as traces_last,
  case when arg_max(failed, run_ms) then 'timeout' end as last_error
from r group by source"""


@query(_HEALTH_SQL)
def source_health(spark: SparkSession, sf: str) -> DataFrame:
    log = arrival_log(spark, sf).withColumn("run", F.floor(F.col("arrived_ms") / 500_000).cast("long"))
    reports = (runs.run_report(log, ["source", "run"], services=False)
               .join(log.groupBy("source", "run").agg(F.max("arrived_ms").alias("run_ms")), ["source", "run"])
               .withColumn("error", F.when(F.col("run") % 3 == 0, "timeout")))
    return runs.source_health(reports)


# ----------------------------------------------------------- span columns

@query(f"""{_WITH} select trace_id, span_id,
  coalesce(a_peer, a_dbsystem || coalesce(':' || a_dbname, '')) as peer from spans""")
def span_peer(spark: SparkSession, sf: str) -> DataFrame:
    return spans(spark, sf).select("trace_id", "span_id", peer().alias("peer"))


@query("""select page_id, nullif(regexp_extract(url, '^[^:]*://([^/?#]*)', 1), '') as host,
  coalesce(nullif(regexp_extract(url, '^[^:]*://[^/?#]*(/[^?#]*)', 1), ''), '/') as path from pages""")
def span_host_of_url(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))


@query(f"""{_WITH} select trace_id, span_id, a_card is null as absent, a_email is not null as present,
  coalesce(regexp_matches(a_email, 'c[0-9]*7@example\\.com$'), false) as pattern, coalesce(a_items = 3, false) as number_as_text,
  coalesce(a_run = 'r-1', false) as equal, false as number_form from spans""")
def span_attr_expectations(spark: SparkSession, sf: str) -> DataFrame:
    def met(key: str, expected) -> F.Column:
        return value_matches(expected, attribute(key))

    return spans(spark, sf).select(
        "trace_id", "span_id", met("card.number", "!").alias("absent"), met("customer.email", "*").alias("present"),
        met("customer.email", r"re:c[0-9]*7@example\.com$").alias("pattern"), met("order.items", "3").alias("number_as_text"),
        met("test.run", "r-1").alias("equal"), met("order.items", 3.0).alias("number_form"))


@query("""select o_orderkey, lpad(lower(to_hex(o_orderkey)), 32, '0') as hex_id, lpad(lower(to_hex(o_orderkey)), 32, '0') as upper_id,
  lpad(lower(to_hex(o_orderkey)), 32, '0') as dashed_id from orders""")
def normalize_hex_ids(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    padded = F.lpad(F.lower(F.hex(key)), 32, "0")
    dashed = F.concat(F.lit("1-"), F.substring(padded, 1, 8), F.lit("-"), F.substring(padded, 9, 24))
    return table(spark, sf, "orders").select(
        "o_orderkey", F.lower(normalize_id(F.lower(F.hex(key)), 32)).alias("hex_id"),
        normalize_id(F.concat(F.lit(" "), F.hex(key), F.lit(" ")), 32).alias("upper_id"),
        normalize_id(dashed, 32).alias("dashed_id"))


@query()
def normalize_hashed_ids(spark: SparkSession, sf: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf, "pages").select("page_id", normalize_id(url, 32).alias("trace_id"), normalize_id(url, 16).alias("span_id"))
