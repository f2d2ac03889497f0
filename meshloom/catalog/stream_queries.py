"""Incremental manifest ingest and its monitors (O-95, O-95b, O-95c)."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshloom.catalog.registry import query, r
from meshloom.catalog.sqltext import r as sr
from meshloom.session import scratch_path
from meshloom.sources import derived as d
from meshloom.streaming import manifest_stream as stream

SCHEMA = "event_id bigint, user_id bigint, event_type string, ts timestamp, value double, props string"


def _deliver(spark, sf) -> str:
    """Events as deliveries in a landing folder; the error and view rows arrive twice."""
    path = scratch_path(spark, "incoming")
    events = d.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    events = events.select("event_id", "user_id", "event_type", "ts", "value", "props")
    events.write.mode("append").parquet(path)
    events.where(F.col("event_type").isin("error", "view")).write.mode("append").parquet(path)
    return path


def _deliver_late(spark, sf) -> str:
    """The same deliveries, then rows dated long before all others, then old rows once more, 60 days on."""
    path = scratch_path(spark, "incoming")
    events = d.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    events = events.select("event_id", "user_id", "event_type", "ts", "value", "props")
    late = F.col("event_id") % 50 == 7
    events.where(~late).write.mode("append").parquet(path)
    shifted = F.col("ts") - F.expr("INTERVAL 100 DAYS")
    events.where(late).withColumn("ts", shifted).write.mode("append").parquet(path)
    shifted = F.col("ts") + F.expr("INTERVAL 60 DAYS")
    events.where(F.col("event_type").isin("error", "view")).withColumn("ts", shifted).write.mode("append").parquet(path)
    return path


def _ingested(spark, sf, incoming=None) -> str:
    table = scratch_path(spark, "manifest-table")
    stream.ingest_manifest(
        spark, incoming or _deliver(spark, sf), SCHEMA, table, scratch_path(spark, "ingest-state"), key="event_id",
        files_per_trigger=1,
    )
    return table


@query("manifest_ingest_stream", f"""
SELECT event_id, user_id, event_type, {sr('value', 6, 'value')}, props FROM events""")
def manifest_ingest_stream(spark, sf):
    """Each event once, however late it comes or is delivered again."""
    rows = stream.stored_rows(spark, _ingested(spark, sf, _deliver_late(spark, sf)), SCHEMA)
    return rows.select("event_id", "user_id", "event_type", r("value", 6), "props")


@query("progress_stream", f"""
SELECT strftime(time_bucket(INTERVAL 1 day, ts), '%Y-%m-%d') AS day, count(*) AS done, count(*) FILTER (WHERE event_type <> 'error') AS passed,
       count(*) FILTER (WHERE event_type = 'error') AS rejected, {sr('count(*) / 86400.0::DOUBLE', 9, 'per_second')}
FROM events GROUP BY 1""")
def progress_stream(spark, sf):
    """Running counts per day over the ingested table, last state."""
    totals, state = scratch_path(spark, "progress"), scratch_path(spark, "progress-state")
    rows = stream.stream_rows(spark, _ingested(spark, sf), SCHEMA)
    stream.run_running_totals(
        stream.progress(rows, "ts", "1 day", F.col("event_type") != "error"), totals, state
    )
    last = stream.latest_totals(spark, totals, ["window_start"])
    return last.select(
        F.date_format("window_start", "yyyy-MM-dd").alias("day"), "done", "passed", "rejected",
        r("per_second", 9),
    )


@query("stratum_fill_stream", """
SELECT event_type, count(DISTINCT user_id) AS base_samples, greatest(250 - count(DISTINCT user_id), 0)::BIGINT AS shortfall
FROM events GROUP BY event_type""")
def stratum_fill_stream(spark, sf):
    """Distinct bases per stratum: deduplicated on the base first, then counted."""
    table = _ingested(spark, sf, _deliver_late(spark, sf))
    rows = stream.stream_rows(spark, table, SCHEMA).select(
        "event_type", "ts", F.concat_ws("|", "event_type", "user_id").alias("stratum_base")
    )
    bases, state = scratch_path(spark, "bases"), scratch_path(spark, "bases-state")
    stream.store_new(rows, bases, state, "stratum_base", "ts")
    schema = "event_type string, ts timestamp, stratum_base string"
    totals, fill_state = scratch_path(spark, "fill"), scratch_path(spark, "fill-state")
    stream.run_running_totals(
        stream.stratum_fill(stream.stream_rows(spark, bases, schema), ["event_type"], 250),
        totals, fill_state,
    )
    return stream.latest_totals(spark, totals, ["event_type"]).select("event_type", "base_samples", "shortfall")
