"""The same operators on streams: detection, running counters, windowed rates, de-duplication, drop alerts."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from detectlab.operators.detect import find_spans, normalise


def detect_stream(stream: DataFrame, keys: Sequence[str], text: str = "text", normalised: bool = False) -> DataFrame:
    """Spans of a text stream. Stateless: batch and stream share the columns."""
    source = stream.withColumn(text, normalise(F.col(text))) if normalised else stream
    return find_spans(source, keys, text)


def running_counters(stream: DataFrame, key: str, caught: str) -> DataFrame:
    """Tested, detected and evaded per key so far; for update mode."""
    return stream.groupBy(key).agg(F.count("*").alias("tested"), F.count_if(F.col(caught)).alias("detected"),
                                   F.count_if(~F.col(caught)).alias("evaded"))


def windowed_rate(stream: DataFrame, ts: str, label: str, caught: str, width: str = "1 day", slide: str | None = None,
                  delay: str = "1 hour") -> DataFrame:
    """Detection counts per label and time window; a window is final once the watermark has passed it."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return stream.withWatermark(ts, delay).groupBy(window.alias("w"), label).agg(
        F.count("*").alias("tested"), F.count_if(F.col(caught)).alias("detected"),
    ).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), label, "tested", "detected")


def split_late(stream: DataFrame, ts: str, label: str, caught: str, path: str, checkpoint: str, width: str = "1 day",
               delay: str = "1 hour") -> None:
    """Counts per window and label of the rows that came in time, and the late rows themselves, in ``path``.

    A row is late if its window had ended before the watermark: the latest time of the batches before less ``delay``. Spark's own
    aggregation drops such rows without a trace; here they go to ``late``, so that ``counts`` and ``late`` together are all rows. Every
    batch overwrites its own folders, so a retried batch leaves no copy; the times of earlier batches are read from their folders.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = [r["batch"] for r in spark.read.schema("latest timestamp, batch int").parquet(f"{path}/times").select("batch").distinct().collect()
                ] if batch_id else []
        earlier = [b for b in seen if b < batch_id]
        times = spark.read.schema("latest timestamp, batch int").parquet(f"{path}/times").where(F.col("batch").isin(earlier)) if earlier else None
        latest = times.agg(F.max("latest")).first()[0] if times is not None else None
        mark = F.lit(latest).cast("timestamp") - F.expr(f"INTERVAL {delay}") if latest is not None else F.lit(None).cast("timestamp")
        rows = batch.withColumn("__w", F.window(ts, width)).withColumn("__late", F.coalesce(F.col("__w.end") <= mark, F.lit(False)))
        rows.where("__late").select(*batch.columns).withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/late/part={batch_id}")
        rows.where("NOT __late").groupBy(F.col("__w.start").alias("window_start"), label).agg(
            F.count("*").alias("tested"), F.count_if(F.col(caught)).alias("detected"),
        ).write.mode("overwrite").parquet(f"{path}/counts/part={batch_id}")
        batch.agg(F.max(ts).cast("timestamp").alias("latest")).withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(
            f"{path}/times/part={batch_id}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def unique_runs(stream: DataFrame, ts: str, key: Sequence[str], delay: str = "1 day") -> DataFrame:
    """Repeated run lines dropped; state is kept for the delay only."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(key))


def drop_alerts(stream: DataFrame, label: str, order: str, rate: str, fall: float) -> DataFrame:
    """Runs whose rate fell by more than ``fall`` points against the label's previous run. State: one number per label.

    Runs are compared in their order within a batch and with the last run of the batches before; a run that arrives after
    a later one was seen is compared with that one.
    """
    def follow(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState):
        # Run rows of one label in one trigger: order and rate alone.
        rows = pd.concat(list(frames)).sort_values(order, ignore_index=True)
        before = rows[rate].shift(1)
        if state.exists:
            before.iloc[0] = state.get[0]
        state.update((float(rows[rate].iloc[-1]),))
        fallen = rows[before - rows[rate] > fall]
        if len(fallen):
            yield pd.DataFrame({"label": key[0], "run_seq": fallen[order], "previous": before[fallen.index], "rate": fallen[rate]})

    return stream.filter(F.col(rate).isNotNull()).select(label, order, rate).groupBy(label).applyInPandasWithState(
        follow, "label string, run_seq long, previous double, rate double", "previous double", "append",
        GroupStateTimeout.NoTimeout)


def to_files(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run what is available and append it to files; exactly once by the sink's own log."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start().awaitTermination()


def latest_to_files(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run what is available in update mode; every batch overwrites its own folder, so a retried batch leaves no copy."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/part={batch_id}")

    stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start().awaitTermination()


def latest_rows(batches: DataFrame, key: str | Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The last update of each key."""
    keys = [key] if isinstance(key, str) else list(key)
    return batches.groupBy(*keys).agg(F.max_by(F.struct(*columns), "batch").alias("row")).select(*keys, "row.*")


