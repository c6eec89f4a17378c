"""Literal spans and documents for the tests."""

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.values import json_text
from spanloom.schema import SPAN_SCHEMA

T1, T2 = "a" * 32, "b" * 32


def sid(n) -> str:
    return str(n).rjust(16, "0")


def span(span_id, parent, service, name, start, end, trace=T1, kind="internal", status="unset", message=None, source="otlp", **attributes):
    attrs = {k.replace("__", "."): json_text(v) for k, v in attributes.items()}
    return (trace, sid(span_id), None if parent is None else sid(parent), name, service, kind, start, end, status, message,
            attrs, {"service.name": json_text(service)}, [], [], source)


def table(spark: SparkSession, rows, updated_ms=None) -> DataFrame:
    df = spark.createDataFrame(rows, SPAN_SCHEMA)
    return df if updated_ms is None else df.withColumn("updated_ms", F.lit(updated_ms).cast("long"))


def docs(spark: SparkSession, *documents) -> DataFrame:
    return spark.createDataFrame([(json.dumps(d),) for d in documents], "text string").select(F.parse_json("text").alias("doc"))


def value(spark: SparkSession, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


#: A buoy ticks: a sample goes through a queue, is stored in vain, looked up and checked; an archive lost its caller.
TIDE = [
    span(40, None, "buoy", "tick", 2_000_000, 30_000_000, kind="consumer"),
    span(41, 40, "buoy", "read depth", 3_000_000, 4_000_000),
    span(42, 40, "buoy", "push sample", 5_000_000, 25_000_000, kind="producer", messaging__destination__name="samples"),
    span(43, 42, "harbour", "take sample", 9_000_000, 24_000_000, kind="consumer"),
    span(44, 43, "harbour", "INSERT samples", 10_000_000, 14_000_000, kind="client", status="error", message="disk of kim@example.net is full", db__system="sqlite"),
    span(45, 43, "harbour", "GET /moon", 15_000_000, 20_000_000, kind="client", peer__service="almanac"),
    span(46, 43, "alarm", "check level", 21_000_000, 22_000_000, kind="server"),
    span(47, 99, "archive", "sweep", 26_000_000, 27_000_000, status="error"),
]
