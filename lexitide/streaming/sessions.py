"""State on streams: sessions, rows that come twice, running scores of texts. Each also runs on a batch, with the same rows in the end."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitide.runtime import find_package


def sessions(events: DataFrame, keys: list[str], gap: str = "30 minutes", late: str = "10 minutes", ts: str = "ts", value: str = "value") -> DataFrame:
    """(keys, start, end, n, total): events of a key less than gap apart form a session; it ends a gap after its last event.

    On a stream a session is emitted, once, when the watermark has passed its end; events later than the watermark are dropped. Rows without a time belong to none."""
    own = events.where(F.col(ts).isNotNull())
    own = own.withWatermark(ts, late) if events.isStreaming else own
    out = own.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def once(events: DataFrame, keys: list[str], within: str = "1 hour", ts: str = "ts") -> DataFrame:
    """One row for each value of keys: on a stream the first to come, of copies that come within the time of it; state is dropped after that.

    On a batch the earliest row, of equal ones that whose JSON sorts first."""
    if events.isStreaming:
        return events.withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)
    own = F.struct(*events.columns)
    return events.groupBy(*keys).agg(F.min_by(own, F.struct(ts, F.to_json(own))).alias("__row")).select("__row.*")


RUNNING = "_id string, n long, weight double, mean double, upto timestamp"


def running_scores(scored: DataFrame, silent: str = "1 day", late: str = "10 minutes"):
    """(_id, n, weight, mean, upto): the mean score of each text over all its passages so far. scored: _id, ts, score, weight.

    On a stream: a row for each text that a batch brings passages of; use output mode update. A text's state is two sums and a count; it goes when the text has been silent
    for that long. On a batch: one row for each text. Passages without score, weight or time don't count."""
    own = scored.select("_id", "ts", F.col("score").cast("double").alias("score"), F.col("weight").cast("double").alias("weight")).where("_id is not null and ts is not null and score is not null and weight is not null")
    if not scored.isStreaming:
        sums = own.groupBy("_id").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"), F.sum(F.col("score") * F.col("weight")).alias("s"), F.max("ts").alias("upto"))
        return sums.select("_id", "n", "weight", F.try_divide("s", "weight").alias("mean"), "upto")
    find_package(scored.sparkSession)
    wait = int(pd.Timedelta(silent).total_seconds() * 1000)

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, weight, total, upto = state.get if state.exists else (0, 0.0, 0.0, 0)
        for b in batches:
            n, weight, total = n + len(b), weight + float(b["weight"].sum()), total + float((b["score"] * b["weight"]).sum())
            upto = max(upto, int(b["ts"].max().value // 1000))
        state.update((n, weight, total, upto))
        state.setTimeoutTimestamp(max(upto // 1000, state.getCurrentWatermarkMs()) + wait)
        yield pd.DataFrame({"_id": [key[0]], "n": [n], "weight": [weight], "mean": [total / weight if weight else None], "upto": [pd.Timestamp(upto, unit="us")]})

    keyed = own.withWatermark("ts", late).groupBy("_id")
    return keyed.applyInPandasWithState(step, RUNNING, "n long, weight double, total double, upto long", "update", "EventTimeTimeout")
