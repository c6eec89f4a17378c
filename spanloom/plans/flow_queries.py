"""Queries over expected flows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import flow as flows
from spanloom.operators.summaries import trace_summaries
from spanloom.plans.derived import SPANS_SQL, spans
from spanloom.plans.registry import query
from spanloom.plans.specs import Flow

NOW_MS = 20_000_000

ORDER_FLOW = Flow.parse(json.dumps({
    "name": "order",
    "match": {"attributes": {"test.run": "re:^r-[0-3]$"}},
    "steps": [
        {"id": "api", "service": "orders-api", "span": "POST /orders/*", "kind": "server", "attributes": {"order.items": "re:^[0-4]$"}},
        {"id": "plan", "service": "*", "span": "call *", "max_ms": 60},
        {"id": "reserve", "service": "*", "span": "reserve *", "attributes": {"card.number": "!"}, "count": {"max": 4}},
        {"id": "again", "service": "svc-*", "span": "reserve *", "attributes": {"peer.service": "*"}, "optional": True},
        {"id": "stock", "service": "*", "span": "SELECT stock", "optional": True},
    ],
    "forbid": [{"span": "retry *"}], "max_ms": 800, "settle_secs": 10}))

ANY_FLOW = Flow.parse(json.dumps({
    "name": "parts", "order": "any",
    "steps": [
        {"id": "api", "service": "orders-api", "span": "POST /orders/?-*"},
        {"id": "returned", "service": "*", "span": "reserve R?", "error": True},
        {"id": "stock", "service": "*", "span": "SELECT stock", "count": {"min": 1, "max": 2}},
    ],
    "settle_secs": 10}))

FLOWS = [ORDER_FLOW, ANY_FLOW]


def stored(spark: SparkSession, sf: str) -> DataFrame:
    """Spans with an update time per trace, as the store keeps them."""
    s = spans(spark, sf)
    return s.withColumn("updated_ms", F.expr("end_ns div 1000000"))


# Fixed flows above, written out as SQL.
_HITS = f"""with {SPANS_SQL},
hits as (
  select 'order' as flow, 0 as step, *, coalesce(regexp_matches(cast(a_items as varchar), '^[0-4]$'), false) as attr_ok from spans
    where service = 'orders-api' and name like 'POST /orders/%' and kind = 'server'
  union all select 'order', 1, *, true from spans where name like 'call %'
  union all select 'order', 2, *, a_card is null from spans where name like 'reserve %'
  union all select 'order', 3, *, a_peer is not null from spans where service like 'svc-%' and name like 'reserve %'
  union all select 'order', 4, *, true from spans where name = 'SELECT stock'
  union all select 'parts', 0, *, true from spans where service = 'orders-api' and name like 'POST /orders/_-%'
  union all select 'parts', 1, *, true from spans where name like 'reserve R_'
  union all select 'parts', 2, *, true from spans where name = 'SELECT stock'),
facts as (select trace_id, min(start_ns) as s, max(end_ns) as e, max(end_ns // 1000000) as updated_ms,
    count(*) filter (status = 'error') as errors, bool_or(coalesce(regexp_matches(a_run, '^r-[0-3]$'), false)) as sel,
    count(*) filter (name like 'retry %') as retries from spans group by 1),
judged as (
  select 'order' as flow, trace_id, s, e, updated_ms, errors, retries as forbidden from facts
    where sel and trace_id in (select trace_id from hits where flow = 'order')
  union all select 'parts', trace_id, s, e, updated_ms, errors, 0 from facts where trace_id in (select trace_id from hits where flow = 'parts')),
h as (select hits.* from hits join judged using (flow, trace_id)),
n as (select flow, trace_id, step, count(*) as matches from h group by 1, 2, 3)
"""


def _pick(number: int, flow: str, sequence: bool) -> str:
    """The choice of one step, given the state the previous step left."""
    before = f"{flow}_{number - 1}"
    late = f"(h.start_ns < {before}.prev)" if sequence else "false"
    return f"""{flow}_{number} as (
  select {before}.trace_id, list_concat({before}.used, case when c.span_id is null then [] else [c.span_id] end) as used,
    {f"case when c.span_id is null or c.late then {before}.prev else c.start_ns end" if sequence else f"{before}.prev"} as prev,
    c.span_id, c.start_ns, c.end_ns, c.status as st, c.attr_ok, coalesce(c.late, false) as late
  from {before} left join (
    select h.*, {late} as late from h join {before} on h.trace_id = {before}.trace_id
    where h.flow = '{flow}' and h.step = {number} and not list_contains({before}.used, h.span_id)
    qualify row_number() over (partition by h.trace_id order by {late}, not h.attr_ok, h.start_ns, h.parent_id is not null, h.span_id) = 1
  ) c on c.trace_id = {before}.trace_id)"""


def _chain(flow: Flow) -> str:
    start = f"{flow.name}_base as (select trace_id, cast([] as varchar[]) as used, cast(0 as bigint) as prev from judged where flow = '{flow.name}')"
    parts = [start] + [_pick(i, flow.name, flow.order == "sequence") for i in range(len(flow.steps))]
    return ", ".join(parts).replace(f"{flow.name}_-1", f"{flow.name}_base")


def _results() -> str:
    rows = []
    for f in FLOWS:
        for i, s in enumerate(f.steps):
            low = s.count.min if s.count and s.count.min is not None else 0
            high = s.count.max if s.count and s.count.max is not None else 1 << 40
            rows.append(f"""select '{f.name}' as flow, r.trace_id, {i} as step, '{s.id}' as step_id, r.span_id, r.late as out_of_order,
  coalesce(n.matches, 0) as matches, (r.end_ns - r.start_ns) / 1e6 as duration_ms, {s.error} as fails, r.st = 'error' as failed,
  case when r.span_id is null then '{"skipped" if s.optional else "missing"}'
    when r.st = 'error' and not {s.error} then 'error'
    when not r.attr_ok or coalesce(n.matches, 0) not between {low} and {high} or ({s.error} and r.st <> 'error') then 'mismatch'
    when (r.end_ns - r.start_ns) / 1e6 > {s.max_ms if s.max_ms is not None else 1e18} then 'slow'
    when r.late then 'out_of_order' else 'ok' end as status
  from {f.name}_{i} r left join n on n.flow = '{f.name}' and n.trace_id = r.trace_id and n.step = {i}""")
    return "res as (" + " union all ".join(rows) + ")"


_RES = _HITS + "," + ", ".join(_chain(f) for f in FLOWS) + "," + _results()
_VERDICT = _RES + f""",
roll as (select flow, trace_id, count(*) as steps, count(*) filter (status in ('ok', 'skipped')) as ok_steps, count(span_id) as matched_steps,
   bool_or(status = 'error') as step_error, count(*) filter (fails and failed) as expected from res group by 1, 2),
v0 as (select j.*, r.* exclude (flow, trace_id), (e - s) / 1e6 as duration_ms, flow = 'order' and (e - s) / 1e6 > 800 as over_budget,
   greatest({NOW_MS} - updated_ms, 0) >= 10000 as settled, errors - expected as unexpected_errors from judged j join roll r using (flow, trace_id)),
v as (select *, case when unexpected_errors > 0 or forbidden > 0 or step_error then 'fail' when ok_steps = steps and not over_budget then 'pass'
   when settled then 'fail' else 'running' end as status from v0)
"""
_V_COLUMNS = "flow, trace_id, status, settled, steps, ok_steps, matched_steps, unexpected_errors, forbidden, duration_ms, over_budget"


@query(_HITS + "select flow, trace_id, step, span_id, attr_ok from hits")
def flow_step_matches(spark: SparkSession, sf: str) -> DataFrame:
    return flows.step_hits(stored(spark, sf), FLOWS).select("flow", "trace_id", "step", "span_id", "attr_ok")


@query(_HITS + "select flow, trace_id, step, count(*) as matches from hits group by all")
def flow_step_counts(spark: SparkSession, sf: str) -> DataFrame:
    return flows.step_counts(flows.step_hits(stored(spark, sf), FLOWS))


@query(_HITS + "select flow, trace_id, errors, forbidden, updated_ms from judged")
def flow_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return flows.candidates(stored(spark, sf), FLOWS).select("flow", "trace_id", "errors", "forbidden", "updated_ms")


_STEP_COLUMNS = "flow, trace_id, step, step_id, status, span_id, duration_ms, matches, out_of_order"


def _steps(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return flows.judge(stored(spark, sf), FLOWS, NOW_MS)


@query(_RES + f"select {_STEP_COLUMNS} from res where flow = 'order'")
def flow_assignment_sequence(spark: SparkSession, sf: str) -> DataFrame:
    return _steps(spark, sf)[1].filter(F.col("flow") == "order").select(*_STEP_COLUMNS.split(", "))


@query(_RES + f"select {_STEP_COLUMNS} from res where flow = 'parts'")
def flow_assignment_any_order(spark: SparkSession, sf: str) -> DataFrame:
    return _steps(spark, sf)[1].filter(F.col("flow") == "parts").select(*_STEP_COLUMNS.split(", "))


@query(_VERDICT + f"select {_V_COLUMNS} from v")
def flow_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return _steps(spark, sf)[0].select(*_V_COLUMNS.split(", "))


@query(_VERDICT + f"select {_V_COLUMNS} from v where flow = 'parts'")
def flow_verdict_any_order(spark: SparkSession, sf: str) -> DataFrame:
    return flows.judge(stored(spark, sf), [ANY_FLOW], NOW_MS)[0].select(*_V_COLUMNS.split(", "))


@query(_VERDICT + f"""select {_V_COLUMNS}, traces_considered from v join (select flow, count(*) as traces_considered from v group by 1) using (flow)
  qualify row_number() over (partition by flow order by ok_steps desc, matched_steps desc, s desc, trace_id desc) = 1""")
def flow_best_trace(spark: SparkSession, sf: str) -> DataFrame:
    return flows.best_verdicts(_steps(spark, sf)[0]).select(*_V_COLUMNS.split(", "), "traces_considered")


@query(_RES + """select j.flow, s.trace_id, s.span_id from judged j join spans s using (trace_id)
  where s.status = 'error' and not exists (select 1 from res r where r.flow = j.flow and r.trace_id = j.trace_id and r.fails and r.span_id = s.span_id)""")
def flow_unexpected_errors(spark: SparkSession, sf: str) -> DataFrame:
    s = stored(spark, sf)
    judged = flows.candidates(s, FLOWS)
    steps = flows.step_results(judged, flows.step_hits(s, FLOWS), FLOWS)
    return flows.unexpected_error_spans(s, judged, steps, FLOWS).select("flow", "trace_id", "span_id")


@query(_HITS + "select 'order' as flow, trace_id, span_id from spans where name like 'retry %' and trace_id in (select trace_id from judged where flow = 'order')")
def flow_forbidden(spark: SparkSession, sf: str) -> DataFrame:
    s = stored(spark, sf)
    return flows.forbidden_spans(s, flows.candidates(s, FLOWS), FLOWS).select("flow", "trace_id", "span_id")


@query(f"with {SPANS_SQL} select trace_id, (max(end_ns) - min(start_ns)) / 1e6 as duration_ms from spans group by 1 having (max(end_ns) - min(start_ns)) / 1e6 > 900")
def flow_budget(spark: SparkSession, sf: str) -> DataFrame:
    return (trace_summaries(spans(spark, sf)).filter(F.col("duration_ms") > 900).select("trace_id", "duration_ms"))


@query(_HITS.replace("where sel and", "where sel and updated_ms >= 5000000 and s >= 4995000000000 and") +
       "select flow, trace_id from judged where flow = 'order'")
def flow_armed_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return flows.candidates(stored(spark, sf), [ORDER_FLOW], {"order": 5_000_000}).select("flow", "trace_id")


# The history of verdicts: each order's outcome, one flow per customer nation.
_HISTORY = """with h as (select 'customer-' || c_nationkey as flow, o_orderkey as at_ms,
    case when o_orderstatus = 'F' then 'fail' when o_orderstatus = 'O' then 'pass' else 'running' end as status,
    't' || (o_custkey % 2) as trace_id, o_orderkey % 3 <> 0 as settled
  from orders join customer on c_custkey = o_custkey)
"""


@query(_HISTORY + """, d as (select *, lag(status || trace_id) over (partition by flow order by at_ms) as before
  from h where status = 'fail' or (status = 'pass' and settled))
select flow, at_ms, status, trace_id, settled from d where before is null or before <> status || trace_id""")
def verdict_change_feed(spark: SparkSession, sf: str) -> DataFrame:
    return flows.change_feed(_history(spark, sf), bucket_ms=1000)


@query(_HISTORY + """, m as (select flow, at_ms, 1 as k, status || trace_id as v, status, trace_id, settled from h where status = 'fail' or (status = 'pass' and settled)
  union all select flow, at_ms, 0, '', null, null, null from h where at_ms % 97 < 5),
d as (select *, lag(v) over (partition by flow order by at_ms, k) as before from m)
select flow, at_ms, status, trace_id, settled from d where k = 1 and (before is null or before <> v)""")
def verdict_change_feed_rearmed(spark: SparkSession, sf: str) -> DataFrame:
    """The feed of flows that are armed again now and then."""
    history = _history(spark, sf)
    return flows.change_feed(history, bucket_ms=1000, armings=history.filter("at_ms % 97 < 5").select("flow", "at_ms"))


def _history(spark: SparkSession, sf: str) -> DataFrame:
    o, c = spark.read.parquet(f"{sf}/orders.parquet"), spark.read.parquet(f"{sf}/customer.parquet")
    status = F.when(F.col("o_orderstatus") == "F", "fail").when(F.col("o_orderstatus") == "O", "pass").otherwise("running")
    return o.join(c, F.col("c_custkey") == F.col("o_custkey")).select(
        F.concat(F.lit("customer-"), F.col("c_nationkey")).alias("flow"), F.col("o_orderkey").alias("at_ms"),
        status.alias("status"), F.concat(F.lit("t"), F.col("o_custkey") % 2).alias("trace_id"),
        (F.col("o_orderkey") % 3 != 0).alias("settled"))


@query("""with h as (select o_custkey % 40 as f, o_orderkey as at_ms, o_orderstatus as definition, o_orderkey % 1000 = 0 as reset from orders),
d as (select *, lag(definition) over (partition by f order by at_ms) as before from h)
select 'f' || f as flow, max(at_ms) filter (reset or before is null or before <> definition) as armed_ms from d group by f""")
def flow_arming_times(spark: SparkSession, sf: str) -> DataFrame:
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return flows.flow_arming(o.select(
        F.concat(F.lit("f"), F.col("o_custkey") % 40).alias("flow"), F.col("o_orderkey").alias("at_ms"),
        F.col("o_orderstatus").alias("definition"), (F.col("o_orderkey") % 1000 == 0).alias("reset")), bucket_ms=1000)
