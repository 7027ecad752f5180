"""Streams run to their end over the event table, with the SQL of the same over the whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from foliant.session import shared_dir
from foliant.streaming import events as E

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _ended(spark, sf: str, make, mode: str) -> DataFrame:
    """The rows that a stream over the events has given out by its end, kept in the shared folder."""
    source = E.read_events(spark, f"{sf}/events.parque[t]")  # a stream reads a pattern of files
    at = f"{shared_dir(spark)}/foliant-stream-{uuid.uuid4().hex}"
    out = make(source)
    if mode == "complete":  # each batch gives the whole result anew: it replaces the one before, and the last one stays

        def whole(rows: DataFrame, _: int) -> None:
            rows.write.mode("overwrite").parquet(f"{at}/rows")

        whole(spark.createDataFrame([], out.schema), -1)  # what a stream without a batch gives
        q = out.writeStream.foreachBatch(whole).option("checkpointLocation", f"{at}/state").outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(out.schema).parquet(f"{at}/rows")
    q = out.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/rows")


@query("select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n from events group by all")
def stream_window_counts(spark, sf):
    return _ended(spark, sf, E.windowed_counts, "complete")


@query("select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) - 1 as occurrence from events")
def stream_occurrence_numbers(spark, sf):
    return _ended(spark, sf, E.occurrence_numbers, "append")


@query("""with g as (select *, coalesce(ts >= lag(ts) over w + interval '30 minutes', true)::int as turn from events window w as (partition by user_id order by ts)), s as (select *, sum(turn) over (partition by user_id order by ts rows unbounded preceding) as k from g)
select user_id, min(ts) as start, max(ts) + interval '30 minutes' as "end", count(*) as n from s group by user_id, k""")
def stream_sessions(spark, sf):
    return _ended(spark, sf, lambda e: E.sessions(e, late=None), "complete")
