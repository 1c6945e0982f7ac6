"""New files, inboxes, metrics and their alerts as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from quarrystone.operators import sentinel, standardize
from quarrystone.operators.sentinel import AlertRule


def landed(spark: SparkSession, folder: str, source: str, entity: str) -> DataFrame:
    """New CSV files of a source as canonical rows; each file is read once."""
    schema = StructType([StructField(c, StringType()) for c in standardize.source_schema(source, entity).values()])
    raw = spark.readStream.schema(schema).option("header", True).option("emptyValue", "").option("nullValue", "\x00").option("pathGlobFilter", f"{entity}*.csv").csv(folder)
    return standardize.canonical(raw, source, entity)


def into_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what is there and stop; the next call goes on from there, exactly once."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start(path)


def each_batch(stream: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str, key: str = "id") -> StreamingQuery:
    """act(rows, batch number) on new rows, once for each key."""
    return stream.dropDuplicates([key]).writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, minutes: int = 60, late: str = "2 hours") -> DataFrame:
    """Counts and sums by event type and window; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", f"{minutes} minutes"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


#: Per object and metric: the last value that was judged, and values that are still inside the watermark's delay.
_STATE = "judged boolean, last double, times array<long>, pending array<double>"
_ALERTS = "at long, object string, alert_id string, severity string, metric string, value double"


def change_alerts(history: DataFrame, rules: Sequence[AlertRule] = sentinel.ALERTS, delay: str = "1 hour") -> DataFrame:
    """A stream of metric values (run_at, object, metric, value) as a stream of alerts like `sentinel.history_alerts`.

    The state of an object's metric is the last judged value and the values that came since, at most what `delay`
    holds.  A value is judged once the watermark has passed it, so values may come in any order inside the delay and
    however they are split into batches; equal times are judged in the values' order.  Rows later than the
    watermark are left out by Spark, nulls in run_at, object, metric or value as well.  The state is in the checkpoint, so a
    restarted query goes on where it stopped."""

    def judge(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        judged, last, times, pending = state.get if state.exists else (False, 0.0, [], [])
        waiting = list(zip(times, pending, strict=True))
        for frame in frames:
            waiting += zip(frame["at"].tolist(), frame["value"].tolist(), strict=True)
        passed = state.getCurrentWatermarkMs() * 1000
        waiting.sort()
        out = []
        for at, value in waiting:
            if at > passed:
                break
            for rule in rules:
                if rule.metric == key[1] and rule.fires(value, last if judged else None):
                    out.append((at, key[0], rule.id, rule.severity, rule.metric, round(value - last if rule.compares else value, 6)))
            judged, last = True, value
        waiting = [w for w in waiting if w[0] > passed]
        state.update((judged, float(last), [t for t, _ in waiting], [float(v) for _, v in waiting]))
        if waiting:
            state.setTimeoutTimestamp(max(waiting[0][0] // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["at", "object", "alert_id", "severity", "metric", "value"])

    # Microseconds beside the time itself, as pandas would move that into the session's time zone.
    known = history.select("run_at", "object", "metric", F.col("value").cast("double").alias("value"), F.unix_micros("run_at").alias("at")).dropna()
    found = known.withWatermark("run_at", delay).groupBy("object", "metric").applyInPandasWithState(judge, _ALERTS, _STATE, "append", "EventTimeTimeout")
    return found.select(F.timestamp_micros("at").alias("run_at"), "object", "alert_id", "severity", "metric", "value")
