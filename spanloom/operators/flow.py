"""Verdicts: does a trace do what a flow says it should.

Flows are small objects on the driver, so their globs and expectations become
column expressions: spans meet steps in a projection, not in a join. Everything
a verdict needs is then aggregated per (flow, trace) with partial aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.spans import is_error
from spanloom.functions.values import attribute, glob, let, value_matches
from spanloom.plans.specs import Flow, Step
from spanloom.session import cut

#: Traces that started this long before a flow was armed still count.
ARM_SLACK_MS = 5_000

_CHOICE = "struct<start_ns:bigint,has_parent:boolean,span_id:string,end_ns:bigint,error:boolean,attr_ok:boolean>"
_RESULT = f"struct<step:int,choice:{_CHOICE},out_of_order:boolean,matches:bigint>"


def step_matches(step: Step) -> Column:
    met = glob(step.service, F.col("service")) & glob(step.span, F.col("name"))
    return met & (F.col("kind") == step.kind) if step.kind else met


def attributes_met(expected: dict) -> Column:
    met = F.lit(True)
    for key, value in expected.items():
        met = met & value_matches(value, attribute(key))
    return met


def step_hits(spans: DataFrame, flows: Sequence[Flow]) -> DataFrame:
    """One row per span and step it matches: the (flow, step) candidates."""
    hits = [
        F.when(step_matches(step), F.struct(F.lit(flow.name).alias("flow"), F.lit(i).alias("step"),
                                            attributes_met(step.attributes).alias("attr_ok")))
        for flow in flows for i, step in enumerate(flow.steps)
    ]
    return spans.select(
        "trace_id", "span_id", "start_ns", "end_ns", F.col("parent_id").isNotNull().alias("has_parent"),
        is_error().alias("error"), F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("hit"),
    ).select("hit.flow", "trace_id", "hit.step", "start_ns", "has_parent", "span_id", "end_ns", "error", "hit.attr_ok")


def step_counts(hits: DataFrame) -> DataFrame:
    """How many spans match each step, per trace."""
    return hits.groupBy("flow", "trace_id", "step").agg(F.count("*").alias("matches"))


# ------------------------------------------------------------- candidates

def _root_named(spans: DataFrame, flows: Sequence[Flow]) -> DataFrame | None:
    """``(trace_id, flow)`` of traces with a root the flow's selector names."""
    wanted = [f for f in flows if f.selector and f.selector.root is not None]
    if not wanted:
        return None
    named = F.filter(F.array(*[F.when(glob(f.selector.root, F.col("name")), F.lit(f.name)) for f in wanted]),
                     lambda n: n.isNotNull())
    matching = spans.select("trace_id", "parent_id", named.alias("named")).filter(F.size("named") > 0)
    ids = spans.select("trace_id", F.col("span_id").alias("parent_id"))
    top = matching.filter(F.col("parent_id").isNull()).unionByName(
        matching.filter(F.col("parent_id").isNotNull()).join(ids, ["trace_id", "parent_id"], "left_anti").select(matching.columns))
    return top.select("trace_id", F.explode("named").alias("flow")).distinct()


def candidates(spans: DataFrame, flows: Sequence[Flow], armed_ms: dict[str, int] | None = None) -> DataFrame:
    """The (flow, trace) pairs to judge, with the trace's facts: start, end,
    last update, error spans, forbidden spans. A trace is judged by a flow if
    its selector fits, some span matches some step, and it came after arming."""
    armed_ms = armed_ms or {}
    updated = F.max("updated_ms") if "updated_ms" in spans.columns else F.lit(0).cast("long")
    aggs: list[Column] = [F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"),
                          updated.alias("updated_ms"), F.count_if(is_error()).alias("errors")]
    for i, flow in enumerate(flows):
        relevant = F.lit(False)
        for step in flow.steps:
            relevant = relevant | step_matches(step)
        aggs.append(F.bool_or(relevant).alias(f"relevant_{i}"))
        # Each expectation may be met by a different span.
        for k, (key, expected) in enumerate((flow.selector.attributes if flow.selector else {}).items()):
            aggs.append(F.bool_or(value_matches(expected, attribute(key))).alias(f"met_{i}_{k}"))
        forbidden = F.lit(False)
        for rule in flow.forbid:
            forbidden = forbidden | (glob(rule.service, F.col("service")) & glob(rule.span, F.col("name")))
        aggs.append(F.count_if(forbidden).alias(f"forbidden_{i}"))
    facts = spans.groupBy("trace_id").agg(*aggs)
    judged = []
    for i, flow in enumerate(flows):
        ok = F.col(f"relevant_{i}")
        for k in range(len(flow.selector.attributes) if flow.selector else 0):
            ok = ok & F.col(f"met_{i}_{k}")
        if flow.name in armed_ms:
            armed = armed_ms[flow.name]
            ok = ok & (F.col("updated_ms") >= armed) & (F.col("start_ns") >= max(armed - ARM_SLACK_MS, 0) * 1_000_000)
        judged.append(F.when(ok, F.struct(F.lit(flow.name).alias("flow"), F.col(f"forbidden_{i}").alias("forbidden"))))
    out = facts.select("trace_id", "start_ns", "end_ns", "updated_ms", "errors",
                       F.explode(F.filter(F.array(*judged), lambda j: j.isNotNull())).alias("j")).select(
        "j.flow", "trace_id", "start_ns", "end_ns", "updated_ms", "errors", "j.forbidden")
    named = _root_named(spans, flows)
    if named is not None:
        free = [f.name for f in flows if not (f.selector and f.selector.root is not None)]
        out = out.join(named.withColumn("named", F.lit(True)), ["trace_id", "flow"], "left").filter(
            F.col("named") | F.col("flow").isin(*free) if free else F.col("named")).drop("named")
    return out


# ------------------------------------------------------------- assignment

def _per_flow(flows: Sequence[Flow], value) -> Column:
    """A constant per flow name."""
    return F.try_element_at(F.create_map(*[x for f in flows for x in (F.lit(f.name), value(f))]), F.col("flow"))


#: Candidates of a (flow, trace) that are chosen from as one array; with more, each step's round is written.
ARRAY_HITS = 10_000


def assign_steps(hits: DataFrame, flows: Sequence[Flow], most: int = ARRAY_HITS) -> DataFrame:
    """Which span each step takes, per (flow, trace): ``(flow, trace_id, step,
    choice, out_of_order, matches)``.

    Steps choose in order among spans no earlier step took: with ``sequence``
    order first those that started no earlier than the previous choice; among
    them the first whose attributes are right, else the first.

    The candidates of a (flow, trace) meet once, as an array that all steps
    choose from in turn. Those with more than ``most`` candidates, found by a
    count that is combined before it is shuffled, take a round per step.
    """
    hits = cut(hits)
    large = cut(hits.groupBy("flow", "trace_id").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("flow", "trace_id"))
    if large.isEmpty():
        return _assign_arrays(hits, flows)
    pair = F.col("flow").eqNullSafe(F.col("l_flow")) & F.col("trace_id").eqNullSafe(F.col("l_trace"))
    large = large.select(F.col("flow").alias("l_flow"), F.col("trace_id").alias("l_trace"))
    return _assign_arrays(hits.join(large, pair, "left_anti"), flows).unionByName(
        _assign_rounds(cut(hits.join(large, pair, "left_semi")), flows))


def _assign_arrays(hits: DataFrame, flows: Sequence[Flow]) -> DataFrame:
    """Steps chosen from the array of a pair's candidates, one fold over the steps."""
    choice = ["start_ns", "has_parent", "span_id", "end_ns", "error", "attr_ok"]
    state = f"struct<used:array<string>,prev:bigint,results:array<{_RESULT}>>"
    ordered = F.col("flow").isin(*[f.name for f in flows if f.order == "sequence"])
    # A pair without a trace has no candidates.
    paired = F.col("trace_id").isNotNull()
    first = lambda cs: F.coalesce(F.array_min(F.filter(cs, lambda c: c["attr_ok"])), F.array_min(cs))

    def take(acc: Column, i: Column) -> Column:
        def picked(mine: Column, p: Column) -> Column:
            taken, late = F.coalesce(p["hit"], p["any"]), p["hit"].isNull() & p["any"].isNotNull()
            return F.struct(
                F.when(taken.isNull(), acc["used"]).otherwise(F.array_append(acc["used"], taken["span_id"])).alias("used"),
                F.when(taken.isNull() | late | ~ordered, acc["prev"]).otherwise(taken["start_ns"]).alias("prev"),
                F.array_append(acc["results"], F.struct(i.alias("step"), taken.alias("choice"), late.alias("out_of_order"),
                                                        F.size(mine).cast("long").alias("matches")).cast(_RESULT)).alias("results")).cast(state)

        own = F.transform(F.filter("own", lambda h: (h["step"] == i) & paired), lambda h: h["c"])
        return let(own, lambda mine: let(F.filter(mine, lambda c: ~F.array_contains(acc["used"], c["span_id"])), lambda free: let(
            F.struct(first(F.filter(free, lambda c: ~ordered | (c["start_ns"] >= acc["prev"]))).alias("hit"), first(free).alias("any")),
            lambda p: picked(mine, p))))

    steps = F.sequence(F.lit(0), _per_flow(flows, lambda f: F.lit(len(f.steps) - 1)))
    start = F.expr(f"cast(named_struct('used', array(), 'prev', 0L, 'results', array()) as {state})")
    named = hits.filter(F.col("flow").isin(*[f.name for f in flows if f.steps]))
    return named.groupBy("flow", "trace_id").agg(
        F.collect_list(F.struct("step", F.struct(*choice).alias("c"))).alias("own")).select(
        "flow", "trace_id", F.inline(F.aggregate(steps, start, take, lambda acc: acc["results"])))


def _assign_rounds(hits: DataFrame, flows: Sequence[Flow]) -> DataFrame:
    """One round per step: its candidates meet the small state of their (flow,
    trace), the spans taken and the last start, and leave four minima and a
    count, combined before they are shuffled. So a trace may have any number
    of candidates. Every round's state is written, or the plan would double
    with each step.
    """
    sequence = [f.name for f in flows if f.order == "sequence"]
    state = cut(hits.select("flow", "trace_id").distinct().withColumns({
        "used": F.expr("cast(array() as array<string>)"), "prev": F.lit(0).cast("long")}))
    choice = F.struct("start_ns", "has_parent", "span_id", "end_ns", "error", "attr_ok")
    results = []
    for i in range(max(len(f.steps) for f in flows)):
        named = F.col("flow").isin(*[f.name for f in flows if len(f.steps) > i])
        ordered = F.col("flow").isin(*sequence)
        own = hits.filter((F.col("step") == i) & named).join(state, ["flow", "trace_id"])
        free = ~F.array_contains("used", F.col("span_id"))
        in_order = free & (~ordered | (F.col("start_ns") >= F.col("prev")))
        first = lambda met: F.min(F.when(met, choice))
        picks = own.groupBy("flow", "trace_id").agg(
            F.coalesce(first(in_order & F.col("attr_ok")), first(in_order)).alias("hit"),
            F.coalesce(first(free & F.col("attr_ok")), first(free)).alias("any"), F.count("*").alias("m"))
        chosen = cut(state.filter(named).join(picks, ["flow", "trace_id"], "left").select(
            "flow", "trace_id", "used", "prev", F.coalesce("hit", "any").alias("choice"),
            (F.col("hit").isNull() & F.col("any").isNotNull()).alias("late"), F.coalesce("m", F.lit(0)).alias("matches")))
        results.append(chosen.select("flow", "trace_id", F.lit(i).alias("step"), F.col("choice").cast(_CHOICE).alias("choice"),
                                     F.col("late").alias("out_of_order"), "matches"))
        state = chosen.select(
            "flow", "trace_id", F.when(F.col("choice").isNull(), F.col("used")).otherwise(F.array_append("used", F.col("choice.span_id"))).alias("used"),
            F.when(F.col("choice").isNull() | F.col("late") | ~ordered, F.col("prev")).otherwise(F.col("choice.start_ns")).alias("prev"))
    return reduce(DataFrame.unionByName, results)


# ---------------------------------------------------------------- verdicts

def _step_facts(flows: Sequence[Flow]) -> Column:
    """The declared facts of a row's (flow, step)."""
    def facts(step: Step) -> Column:
        count = step.count
        return F.struct(
            F.lit(step.id).alias("id"), F.lit(step.service).alias("service"), F.lit(step.span).alias("span"),
            F.lit(step.error).alias("fails"), F.lit(step.optional).alias("optional"),
            F.lit(step.max_ms).cast("double").alias("max_ms"),
            F.lit(count.min if count else None).cast("long").alias("at_least"),
            F.lit(count.max if count else None).cast("long").alias("at_most"))

    return F.get(_per_flow(flows, lambda f: F.array(*[facts(s) for s in f.steps])), F.col("step"))


def step_results(judged: DataFrame, hits: DataFrame, flows: Sequence[Flow]) -> DataFrame:
    """One row per (flow, trace, step) of the judged pairs with its status."""
    pairs = judged.select("flow", "trace_id")
    kept = hits.join(pairs, ["flow", "trace_id"], "left_semi")
    rows = assign_steps(kept, flows).withColumn("s", _step_facts(flows))
    c = F.col("choice")
    duration = F.when(c.isNotNull(), F.greatest(c["end_ns"] - c["start_ns"], F.lit(0)).cast("double") / F.lit(1e6))
    miscounted = F.coalesce(F.col("matches") < F.col("s.at_least"), F.lit(False)) | F.coalesce(
        F.col("matches") > F.col("s.at_most"), F.lit(False))
    status = (
        F.when(c.isNull(), F.when(F.col("s.optional"), "skipped").otherwise("missing"))
        .when(c["error"] & ~F.col("s.fails"), "error")
        .when(~c["attr_ok"] | miscounted | (F.col("s.fails") & ~c["error"]), "mismatch")
        .when(F.coalesce(duration > F.col("s.max_ms"), F.lit(False)), "slow")
        .when(F.col("out_of_order"), "out_of_order").otherwise("ok"))
    return rows.select(
        "flow", "trace_id", "step", F.col("s.id").alias("step_id"), F.col("s.service").alias("service"),
        F.col("s.span").alias("span"), status.alias("status"), c["span_id"].alias("span_id"), duration.alias("duration_ms"),
        "matches", "out_of_order", c["error"].alias("failed"), F.col("s.fails").alias("fails"))


def verdicts(judged: DataFrame, steps: DataFrame, flows: Sequence[Flow], now_ms: int) -> DataFrame:
    """One row per judged (flow, trace): status, counts, settled, score."""
    fine = F.col("status").isin("ok", "skipped")
    rolled = steps.groupBy("flow", "trace_id").agg(
        F.count("*").alias("steps"), F.count_if(fine).alias("ok_steps"), F.count("span_id").alias("matched_steps"),
        F.bool_or(F.col("status") == "error").alias("step_error"),
        F.count_if(F.col("fails") & F.col("failed")).alias("expected_errors"))
    v = judged.join(rolled, ["flow", "trace_id"])
    duration = F.greatest(F.col("end_ns") - F.col("start_ns"), F.lit(0)).cast("double") / F.lit(1e6)
    over = F.coalesce(duration > _per_flow(flows, lambda f: F.lit(f.max_ms).cast("double")), F.lit(False))
    quiet = _per_flow(flows, lambda f: F.lit(f.no_errors))
    unexpected = F.when(quiet, F.col("errors") - F.col("expected_errors")).otherwise(0).cast("long")
    settled = F.greatest(F.lit(now_ms) - F.col("updated_ms"), F.lit(0)) >= _per_flow(flows, lambda f: F.lit(f.settle_secs * 1000))
    hard = (F.col("unexpected_errors") > 0) | (F.col("forbidden") > 0) | F.col("step_error")
    status = (F.when(hard, "fail").when((F.col("ok_steps") == F.col("steps")) & ~F.col("over_budget"), "pass")
              .when(F.col("settled"), "fail").otherwise("running"))
    return v.select("*", duration.alias("duration_ms"), over.alias("over_budget"), settled.alias("settled"),
                    unexpected.alias("unexpected_errors")).withColumn("status", status).select(
        "flow", "trace_id", "status", "settled", "steps", "ok_steps", "matched_steps", "unexpected_errors", "forbidden",
        "duration_ms", "over_budget", "start_ns", "updated_ms")


def best_verdicts(per_trace: DataFrame) -> DataFrame:
    """Per flow the trace meeting most steps, then matching most, then the
    newest (then the greatest id); with how many traces were considered."""
    score = F.struct("ok_steps", "matched_steps", "start_ns", "trace_id")
    return per_trace.groupBy("flow").agg(
        F.max_by(F.struct(*[c for c in per_trace.columns if c != "flow"]), score).alias("v"),
        F.count("*").alias("traces_considered")).select("flow", "v.*", "traces_considered")


def judge(spans: DataFrame, flows: Sequence[Flow], now_ms: int, armed_ms: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Verdict rows and step rows of every (flow, trace) pair to consider."""
    # Read by the steps and by the verdicts.
    judged = cut(candidates(spans, flows, armed_ms))
    steps = step_results(judged, step_hits(spans, flows), flows)
    return verdicts(judged, steps, flows, now_ms), steps


def unexpected_error_spans(spans: DataFrame, judged: DataFrame, steps: DataFrame, flows: Sequence[Flow]) -> DataFrame:
    """Error spans of judged traces that no step expected to fail."""
    quiet = [f.name for f in flows if f.no_errors]
    pairs = judged.select("flow", "trace_id").filter(F.col("flow").isin(*quiet))
    expected = steps.filter(F.col("fails") & F.col("span_id").isNotNull()).select("flow", "trace_id", "span_id")
    failed = spans.filter(is_error())
    return failed.join(pairs, "trace_id").join(expected, ["flow", "trace_id", "span_id"], "left_anti")


def forbidden_spans(spans: DataFrame, judged: DataFrame, flows: Sequence[Flow]) -> DataFrame:
    """Spans of judged traces that a flow forbids; once however many rules match."""
    hit = []
    for flow in flows:
        met = F.lit(False)
        for rule in flow.forbid:
            met = met | (glob(rule.service, F.col("service")) & glob(rule.span, F.col("name")))
        hit.append(F.when(met, F.lit(flow.name)))
    rows = spans.withColumn("flow", F.explode(F.filter(F.array(*hit), lambda h: h.isNotNull())))
    return rows.join(judged.select("flow", "trace_id"), ["flow", "trace_id"], "left_semi")


# ------------------------------------------------------------ over time

def _previous(df: DataFrame, value: Column, bucket_ms: int) -> DataFrame:
    """``before``: the value of the flow's previous row by ``at_ms``.

    Each flow's history is cut into time buckets, so a long one is ranked by
    many tasks; a bucket's first row looks up the last row of the bucket before.
    """
    rows = df.withColumn("bucket", F.expr(f"at_ms div {bucket_ms}")).withColumn("value", value)
    last = rows.groupBy("flow", "bucket").agg(F.max_by("value", F.struct("at_ms", "value")).alias("last"))
    carried = last.select("flow", "bucket", F.lag("last").over(Window.partitionBy("flow").orderBy("bucket")).alias("carried"))
    inside = F.lag("value").over(Window.partitionBy("flow", "bucket").orderBy("at_ms", "value"))
    return (rows.withColumn("inside", inside).join(carried, ["flow", "bucket"])
            .withColumn("before", F.coalesce("inside", "carried")).drop("bucket", "inside", "carried"))


def change_feed(history: DataFrame, bucket_ms: int = 3_600_000, armings: DataFrame | None = None) -> DataFrame:
    """Of successive verdicts ``(flow, at_ms, status, trace_id, settled)`` the
    decided ones that differ from the last decided one of their flow.

    ``armings`` (``flow``, ``at_ms``) start anew: what was announced before
    counts no more, so the first decided verdict from then on is announced. An
    arming at the time of a verdict comes before it.
    """
    decided = history.filter((F.col("status") == "fail") | ((F.col("status") == "pass") & F.col("settled")))
    if armings is None:
        seen = _previous(decided, F.struct("status", "trace_id"), bucket_ms)
        return seen.filter(~F.col("value").eqNullSafe(F.col("before"))).select(history.columns)
    # An arming is a row between the verdicts that equals none of them.
    marks = armings.select("flow", "at_ms", F.lit("").alias("status"), F.lit("").alias("trace_id"), F.lit(True).alias("arms"))
    rows = decided.withColumn("arms", F.lit(False)).unionByName(marks, allowMissingColumns=True)
    seen = _previous(rows, F.struct("status", "trace_id"), bucket_ms)
    return seen.filter(~F.col("arms") & ~F.col("value").eqNullSafe(F.col("before"))).select(history.columns)


def flow_arming(history: DataFrame, bucket_ms: int = 3_600_000) -> DataFrame:
    """When each flow is armed from its submissions ``(flow, at_ms,
    definition, reset)``: the last time it changed or was reset."""
    seen = _previous(history, F.col("definition"), bucket_ms)
    changed = F.col("reset") | ~F.col("value").eqNullSafe(F.col("before"))
    return seen.groupBy("flow").agg(F.max(F.when(changed, F.col("at_ms"))).alias("armed_ms"))
