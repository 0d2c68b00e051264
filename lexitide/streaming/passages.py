"""Structured Streaming, beyond the batch workload: new passages are scored as they arrive, events are counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitide.operators import scoring
from lexitide.sources.sinks import append_new


def passages(spark: SparkSession, path: str, schema: str = "_id string, seq long, text string, lang string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def score_stream(stream: DataFrame, norms: DataFrame, columns: list[str], path: str, checkpoint: str, keys=("_id", "seq")):
    """Each micro-batch is scored like a batch and appended without what is there: a batch that is run again adds nothing."""

    def each(batch: DataFrame, _: int) -> None:
        freqs = scoring.word_counts(batch, [*keys, "lang"], letters=True)
        append_new(scoring.weighted_means(freqs, norms, ["lang", "word"], list(keys), columns), path, list(keys))

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts and sums in tumbling windows; on a stream, rows later than the watermark are dropped."""
    out = events.withWatermark("ts", late) if events.isStreaming else events
    return out.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
