"""Stability gate: accept a file once it is unchanged for two seconds between sightings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lectern.skew import running
from lectern.streaming import WATERMARK
from lectern.streaming.events import micros

ACCEPTED = "path string, size_bytes long, modified_at_ns long, accepted_at timestamp"


class StabilityGate(StatefulProcessor):
    """Per path: the fingerprint last seen and when it was first seen; any change restarts it.

    A path that is not sighted for ``forget`` seconds of event time is forgotten by a timer, so the state holds
    the files that are in motion and no others; one that turns up again starts anew.
    """

    def __init__(self, seconds: float = 2.0, forget: float = 3600.0):
        self.seconds = seconds
        self.forget = forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "size_bytes long, modified_at_ns long, since timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["ts"], kind="stable")
        state = self.seen.get()
        out = []
        for row in batch.itertuples(index=False):
            mark = (int(row.size_bytes), int(row.modified_at_ns))
            ts = pd.Timestamp(row.ts)
            if state is None or (int(state[0]), int(state[1])) != mark:
                state = (*mark, ts.to_pydatetime())
            elif (ts - pd.Timestamp(state[2])).total_seconds() >= self.seconds:
                out.append((key[0], *mark, ts))
                state = None
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if state is None:
            self.seen.clear()
        else:
            self.seen.update(state)
            self.handle.registerTimer(int((pd.Timestamp(batch["ts"].iloc[-1]).timestamp() + self.forget) * 1000))
        yield pd.DataFrame(out, columns=["path", "size_bytes", "modified_at_ns", "accepted_at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        yield pd.DataFrame([], columns=["path", "size_bytes", "modified_at_ns", "accepted_at"])

    def close(self) -> None:
        pass


def stable_stream(sightings: DataFrame, seconds: float = 2.0, watermark: str = WATERMARK, forget: float = 3600.0) -> DataFrame:
    """Accepted files of a stream ``(path, size_bytes, modified_at_ns, ts)``; needs the RocksDB
    state store.  A path without a sighting for ``forget`` seconds leaves the state."""
    return sightings.withWatermark("ts", watermark).groupBy("path").transformWithStateInPandas(
        statefulProcessor=StabilityGate(seconds, forget), outputStructType=ACCEPTED, outputMode="Append", timeMode="EventTime")


def stable_files(sightings: DataFrame, blocks: list[str], seconds: float = 2.0) -> DataFrame:
    """Batch twin: the first sighting two seconds or more into a run of equal fingerprints."""
    order = ["ts", "event_id"]
    mark = F.struct("size_bytes", "modified_at_ns")
    seen = running(sightings, ["path"], order, blocks, {"_before": ("last", mark)}, inclusive=False)
    opens = F.when(F.col("_before").isNull() | (F.col("_before") != mark), 1).otherwise(0)
    runs = running(seen.withColumn("_opens", opens), ["path"], order, blocks, {"run": ("sum", F.col("_opens")), "since": ("last", F.when(F.col("_opens") == 1, F.col("ts")))})
    ripe = runs.where(micros("ts") - micros("since") >= int(seconds * 1_000_000))
    return ripe.groupBy("path", "run").agg(F.min("ts").alias("accepted_at"), F.first("size_bytes").alias("size_bytes"), F.first("modified_at_ns").alias("modified_at_ns"))
