"""Keyword frequencies over a stream of records: an extension, kept apart from the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapspark.functions.text import normalized_keywords, split_author_keywords


def stream_keyword_frequencies(records: DataFrame, time: str = "ts", keywords: str = "author_keywords", window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """window_start, keyword, frequency of records(ts, author_keywords): records per tumbling window.

    A record lists a keyword once after normalisation, so counting rows counts records. The watermark lets closed windows
    leave the state.
    """
    each = records.withWatermark(time, delay).select(time, F.explode(normalized_keywords(split_author_keywords(F.col(keywords)))).alias("keyword"))
    counted = each.groupBy(F.window(time, window), "keyword").agg(F.count(F.lit(1)).alias("frequency"))
    return counted.select(F.col("window.start").alias("window_start"), "keyword", "frequency")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Everything that is there now, written as Parquet; another call goes on where this one ended."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
