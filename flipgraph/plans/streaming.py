"""Queries of the streaming monitor, run over the events that are there."""

from __future__ import annotations

from pyspark.sql import functions as F

from flipgraph.operators.aggregates import rnd
from flipgraph.plans.catalog import Catalog
from flipgraph.streaming import monitor as M

C = Catalog()
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(s, d):
    return M.read_events(s, d, "events.parquet", EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))


@C.add("ext_stream_rates", "SELECT CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS n, count(*) FILTER (event_type = 'error') AS n_errors, round(avg(value), 6) AS mean_value FROM events GROUP BY 1")
def _(s, d):
    """Daily rates, kept in complete mode, so windows still open are shown too."""
    out = M.run_available(M.window_rates(events(s, d)), "complete")
    return out.select(F.to_date("start").alias("day"), "n", "n_errors", rnd(F.col("mean_value")).alias("mean_value"))


@C.add("ext_stream_dedupe", "SELECT count(DISTINCT event_id) AS n FROM events")
def _(s, d):
    return M.run_available(M.once_within(events(s, d), "event_id").select("event_id", "ts")).agg(F.count("*").alias("n"))
