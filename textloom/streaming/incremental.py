"""Structured Streaming forms of the batch jobs: append of new articles' measures, windowed counts of late events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.sources.sinks import append_new


def append_measures(articles: DataFrame, measure: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, key: str) -> StreamingQuery:
    """Each micro-batch is measured by the batch operator and appended without repeating keys, so retries are safe."""
    def each(batch: DataFrame, _: int) -> None:
        append_new(measure(batch), path, [key])

    return articles.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()


def windowed_counts(events: DataFrame, ts: str, by: list[str], window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def token_counts(articles: DataFrame, ts: str, window: str = "1 day", late: str = "1 day") -> DataFrame:
    tok = articles.select(ts, F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("token"))
    return windowed_counts(tok, ts, ["token"], window, late)
