"""Tumbling windows, flushes and counter rates over streams of samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.aggregates import aggregate
from ..model import finite
from ..session import findable


def tumbling(stream: DataFrame, time: str, interval: str, field: str, agg: str | Callable[[Column], Column] = "mean", late: str = "10 minutes", *keys: str) -> DataFrame:
    """(keys, start, end, value, count) per window; a window closes once the watermark, ``late`` behind, has passed it."""
    w = F.window(time, interval)
    out = stream.withWatermark(time, late).groupBy(*keys, w.alias("w")).agg(aggregate(agg)(finite(F.col(field))).alias("value"), F.count(F.lit(1)).alias("count"))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "value", "count")


class _LastSample(StatefulProcessor):
    """Keeps each series' last sample, so that rates go on across batches."""

    def __init__(self, counter: bool):
        self.counter = counter

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "timestamp double, value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        samples = pd.concat(list(rows)).sort_values("timestamp", kind="stable")
        before = self.last.get() if self.last.exists() else None
        out = []
        for t, v in zip(samples["timestamp"], samples["value"], strict=True):
            if before is not None and t > before[0]:
                rise = v - before[1]
                out.append((*key, t, (v if self.counter and rise < 0 else rise) / (t - before[0])))
            if before is None or t >= before[0]:
                before = (float(t), float(v))
        self.last.update(before)
        yield pd.DataFrame(out, columns=[*self.names, "timestamp", "value"]) if out else pd.DataFrame({c: pd.Series(dtype=d) for c, d in zip([*self.names, "timestamp", "value"], ["object"] * len(self.names) + ["float", "float"], strict=True)})

    def close(self) -> None:
        pass


def rate(stream: DataFrame, key: str, counter: bool = True) -> DataFrame:
    """(key, timestamp, value) of a stream of (key, timestamp, value); samples older than the last one seen are passed over. Keeps its state in RocksDB."""
    findable(stream.sparkSession)
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    p = _LastSample(counter)
    p.names = [key]
    return stream.groupBy(key).transformWithStateInPandas(p, f"{key} string, timestamp double, value double", "Append", "None")


def flush_to(stream: DataFrame, write: Callable[[DataFrame], object], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Hands micro-batches to ``write``: each ``every`` interval, or all there is and then ends."""
    out = stream.writeStream.foreachBatch(lambda df, _: write(df) and None).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()
