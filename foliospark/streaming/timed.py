"""State with timers and with a time to live: the sliding limit and sessions as streams, by ``transformWithStateInPandas``.

Both need the RocksDB state store (``use_state_store``)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from foliospark.operators.jobs import SESSION_DAYS
from foliospark.operators.limits import WINDOW_S

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return spark


class SlidingCounter(StatefulProcessor):
    """Calls of a key wait in list state until the watermark has passed them, so that none that counts can still come; a timer at the
    earliest one says when. What later calls look back to, the last window before the watermark, stays."""

    def __init__(self, seconds: int):
        self.window = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "seq long, micros long")
        self.recent = handle.getListState("recent", "micros long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for batch in rows:
            micros = batch["micros"].astype("int64").tolist()
            self.waiting.appendList(list(zip(batch["seq"].astype("int64").tolist(), micros)))
            first = min(micros) if first is None else min(first, *micros)
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted((int(m), int(s)) for s, m in self.waiting.get())
        ready, later = [r for r in rows if r[0] < passed], [r for r in rows if r[0] >= passed]
        if later:
            self.handle.registerTimer(later[0][0] // 1000 + 1)
            self.waiting.put([(s, m) for m, s in later])
        else:
            self.waiting.clear()
        if not ready:
            return
        recent = [int(m) for (m,) in self.recent.get()]
        times = np.array(sorted(recent + [m for m, _ in ready]), np.int64)
        own = np.array([m for m, _ in ready], np.int64)
        n = np.searchsorted(times, own, "right") - np.searchsorted(times, own - self.window, "left")
        keep = times[times >= passed - self.window].tolist()
        if keep:
            self.recent.put([(m,) for m in keep])
        else:
            self.recent.clear()
        yield pd.DataFrame({"key": [key[0]] * len(ready), "seq": [s for _, s in ready], "in_window": n.astype("int64")})

    def close(self) -> None:
        pass


def sliding_counts(calls: DataFrame, late: str = "10 minutes", seconds: int = WINDOW_S) -> DataFrame:
    """key, seq, in_window over a stream of (key, seq, ts): what ``limits.sliding_counts`` gives for each call, once the watermark (``late``
    behind the newest call) has passed it; calls that come later than that are left out. State holds a key's calls of that time and one
    window more. A key's type stays."""
    rows = calls.select("key", F.col("seq").cast("long").alias("seq"), F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    rows = rows.select("key", "seq", F.unix_micros("ts").alias("micros"), "ts")
    kind = rows.schema["key"].dataType.simpleString()
    return rows.groupBy("key").transformWithStateInPandas(SlidingCounter(seconds), f"key {kind}, seq long, in_window long", "Append", "EventTime")


class Session(StatefulProcessor):
    """A token's login in value state that lives as long as a session does at most; a logout clears it."""

    def __init__(self, days: int):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.login = handle.getValueState("login", "seconds long", ttlDurationMs=self.days * 86_400_000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = []
        events = pd.concat(list(rows)).sort_values(["seconds", "seq"])
        for seq, what, at in zip(events["seq"], events["event"], events["seconds"]):
            if what == "login":
                self.login.update((int(at),))
            elif what == "logout":
                self.login.clear()
            else:
                known = self.login.exists() and int(at) - int(self.login.get()[0]) < self.days * 86_400
                out.append((key[0], int(seq), bool(known)))
        yield pd.DataFrame(out, columns=["token", "seq", "valid"])

    def close(self) -> None:
        pass


def sessions(events: DataFrame, days: int = SESSION_DAYS) -> DataFrame:
    """token, seq, valid for each ``check`` in a stream of (token, seq, event: login, logout or check, ts): whether the token's last login is
    less than ``days`` old by the events' times and wasn't handed back. A token's events of one micro-batch are taken in order of time and
    seq. State is dropped ``days`` after it was written, by the clock, which bounds the store; null tokens are left out."""
    rows = events.filter("token is not null").select("token", F.col("seq").cast("long").alias("seq"), "event", F.unix_timestamp("ts").alias("seconds"))
    kind = rows.schema["token"].dataType.simpleString()
    return rows.groupBy("token").transformWithStateInPandas(Session(days), f"token {kind}, seq long, valid boolean", "Append", "ProcessingTime")
