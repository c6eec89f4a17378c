"""The span table: one row per unit of work, whatever system recorded it.

Attribute values are kept as JSON text (``"abc"``, ``3``, ``true``, ``["a"]``):
that keeps the JSON type for masking while staying comparable and groupable.
Times are Unix nanoseconds in LONG; timestamps are derived where needed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ATTRS = T.MapType(T.StringType(), T.StringType())
EVENT = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("time_ns", T.LongType()),
    T.StructField("attributes", ATTRS),
])
LINK = T.StructType([
    T.StructField("trace_id", T.StringType()),
    T.StructField("span_id", T.StringType()),
])
SPAN_SCHEMA = T.StructType([
    T.StructField("trace_id", T.StringType()),
    T.StructField("span_id", T.StringType()),
    T.StructField("parent_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("service", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("start_ns", T.LongType()),
    T.StructField("end_ns", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("status_message", T.StringType()),
    T.StructField("attributes", ATTRS),
    T.StructField("resource", ATTRS),
    T.StructField("events", T.ArrayType(EVENT)),
    T.StructField("links", T.ArrayType(LINK)),
    T.StructField("source", T.StringType()),
])
SPAN_COLUMNS = SPAN_SCHEMA.fieldNames()

ARRIVAL_SCHEMA = T.StructType(SPAN_SCHEMA.fields + [
    T.StructField("arrival_seq", T.LongType()),
    T.StructField("arrived_ms", T.LongType()),
    T.StructField("mode", T.StringType()),
])


def empty_map() -> Column:
    return F.expr("cast(map() as map<string,string>)")


def empty_events() -> Column:
    return F.expr("cast(array() as array<struct<name:string,time_ns:bigint,attributes:map<string,string>>>)")


def empty_links() -> Column:
    return F.expr("cast(array() as array<struct<trace_id:string,span_id:string>>)")


def _q(alias: str | None, name: str) -> Column:
    return F.col(f"{alias}.{name}" if alias else name)


def span_order(alias: str | None = None) -> Column:
    """The order of spans inside a trace, as one sortable struct."""
    return F.struct(
        _q(alias, "start_ns").alias("start_ns"),
        _q(alias, "parent_id").isNotNull().alias("has_parent"),
        _q(alias, "span_id").alias("span_id"),
    )


def span_order_columns() -> list[Column]:
    return [F.col("start_ns"), F.col("parent_id").isNotNull(), F.col("span_id")]


def conform(df):
    """Exactly the span columns, in order, with the contract's types."""
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in SPAN_SCHEMA.fields])
