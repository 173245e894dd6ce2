"""Runs of a label compared with the run before them in time, also where they arrive late."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OUT = "label string, run_seq long, previous double, rate double"


class Predecessors(StatefulProcessor):
    """State of a label: the runs that the watermark has not passed, in a map by time and number, and the rate of the last one given out.

    A run waits until the watermark has passed its time, so whatever can still come before it has come; then it is compared
    with its true predecessor and leaves the state. What is held is the runs of one delay, not those of a label.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long, run_seq long", "rate double")
        self.last = handle.getValueState("last", "rate double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for at, seq, rate in zip(frame["at"], frame["run_seq"], frame["rate"], strict=True):
                self.waiting.updateValue((int(at), int(seq)), (float(rate),))
                self.handle.registerTimer(int(at))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = expiredTimerInfo.getExpiryTimeInMs()
        due = sorted((tuple(k), v[0]) for k, v in self.waiting.iterator() if k[0] <= passed)
        before = self.last.get()[0] if self.last.exists() else None
        out = []
        for place, rate in due:
            out.append((key[0], place[1], before, rate))
            before = rate
            self.waiting.removeKey(place)
        if due:
            self.last.update((before,))
            yield pd.DataFrame(out, columns=["label", "run_seq", "previous", "rate"]).astype({"previous": "float64"})

    def close(self) -> None:
        pass


def with_predecessors(stream: DataFrame, label: str, ts: str, order: str, rate: str, delay: str) -> DataFrame:
    """Each run with the rate of its label's run before it, once the watermark (``delay`` behind the latest time) has passed it.

    Runs later than ``delay`` are dropped by the watermark; runs of one time stand in their order. Rows without a label, time or
    rate say nothing and are left out. Needs the RocksDB state store.
    """
    rows = stream.where(F.col(label).isNotNull() & F.col(ts).isNotNull() & F.col(rate).isNotNull()).select(
        F.col(label).alias("label"), F.col(ts).alias("ts"), F.unix_millis(F.col(ts)).alias("at"), F.col(order).cast("long").alias("run_seq"),
        F.col(rate).cast("double").alias("rate"))
    return rows.withWatermark("ts", delay).groupBy("label").transformWithStateInPandas(
        statefulProcessor=Predecessors(), outputStructType=_OUT, outputMode="Append", timeMode="EventTime")
