"""The call log and the events as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomscribe.functions.labels import canon_label
from loomscribe.plans.base import label_sql, query
from loomscribe.streaming.logs import compacted, folded_counts, read_log


@query(f"""SELECT doc_id, source, call_id, retries FROM (SELECT doc_id, {label_sql('source')} AS source, call_id, retries, row_number() OVER (PARTITION BY doc_id, {label_sql('source')} ORDER BY call_id DESC, logged_at DESC) AS r FROM rewrites) WHERE r = 1""")
def stream_compaction(spark, d):
    """SNK3 and SNK4 over the log of rewordings: all that has arrived, last call of each key."""
    s = read_log(spark, f"{d}/rewrites.parquet").select("doc_id", canon_label("source").alias("source"), "call_id", "retries", "logged_at")
    return compacted(s, ["doc_id", "source"], ["call_id", "logged_at"]).select("doc_id", "source", "call_id", "retries")


@query("""SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2""")
def stream_event_hours(spark, d):
    s = read_log(spark, f"{d}/events.parquet")
    return folded_counts(s, [F.col("event_type"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")]).select("event_type", "hour", "n")
