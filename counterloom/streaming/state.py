"""Keyed state of the streaming jobs, and idempotent batch output.

State lives in Spark's state store, one entry per series or host; a batch writes the entries it touches. Timers on event time clear
the state of silent series.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.series import PREV

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state needs this store; queries that were started with another one keep it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def write_batch(df: DataFrame, path: str, batch_id: int, fmt: str = "parquet") -> None:
    """Output of one batch in a folder of its own; a repeated batch replaces it."""
    df.write.mode("overwrite").format(fmt).save(f"{path}/batch={batch_id}")


def _ms(at: pd.Timestamp) -> int:
    return -(-at.value // 1_000_000)


class LastSample(StatefulProcessor):
    """Adds the previous sample's time and values to the samples of a series.

    Samples not newer than the last known one are dropped. After more than ``ttl_ms`` without a sample a series starts over; once the
    watermark has passed that time its state is gone.
    """

    def __init__(self, ts: str, cols: Sequence[str], schema: T.StructType, ttl_ms: int | None):
        self.ts, self.cols, self.schema, self.ttl_ms = ts, list(cols), schema, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ts = self.ts
        frame = pd.concat(list(rows), ignore_index=True).sort_values(ts, kind="stable")
        known = self.last.get() if self.last.exists() else None
        before = pd.Timestamp(known[0]) if known else pd.NaT
        if known:
            frame = frame[frame[ts] > before]
        if frame.empty:
            return
        for c, value in zip(self.cols, known[1:] if known else [None] * len(self.cols), strict=True):
            frame[c] = frame[c].astype("Int64")
            frame[PREV + c] = frame[c].shift(1, fill_value=pd.NA if value is None else value)
        frame[PREV + ts] = frame[ts].shift(1)
        frame.iloc[0, frame.columns.get_loc(PREV + ts)] = before
        if self.ttl_ms is not None:
            silent = (frame[ts] - frame[PREV + ts]) > pd.Timedelta(milliseconds=self.ttl_ms)
            frame.loc[silent, [PREV + c for c in (ts, *self.cols)]] = None
            if known:
                self.handle.deleteTimer(_ms(before) + self.ttl_ms)
            self.handle.registerTimer(_ms(frame[ts].iloc[-1]) + self.ttl_ms)
        newest = frame.iloc[-1]
        self.last.update((newest[ts].to_pydatetime(), *(None if pd.isna(newest[c]) else int(newest[c]) for c in self.cols)))
        yield frame

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists() and _ms(pd.Timestamp(self.last.get()[0])) + self.ttl_ms <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
        yield from ()

    def close(self) -> None:
        pass


class Predecessor(StatefulProcessor):
    """Passes a host's closed snapshots on, one row each with its ``rows``, and with the first of a batch the one closed before it, as ``_done``."""

    def __init__(self, ts: str):
        self.ts = ts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at timestamp, rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True).sort_values(self.ts)
        if self.last.exists():
            at, raw = self.last.get()
            before = frame.iloc[:1].copy()
            before[self.ts] = pd.Timestamp(at)
            before["rows"] = [pickle.loads(raw)]
            yield before.assign(_done=True)
        newest = frame.iloc[-1]
        self.last.update((newest[self.ts].to_pydatetime(), pickle.dumps(newest["rows"])))
        yield frame.assign(_done=False)

    def close(self) -> None:
        pass
