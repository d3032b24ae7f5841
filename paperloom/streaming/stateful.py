"""Streams that keep state per key: a feed of status changes, and locks that run out.

Both wait for the watermark before they decide, so the order in which rows
arrive does not matter as long as they are not later than the watermark allows;
rows that are later are left out by Spark. State lies in the RocksDB store
(``with_state``), one small value per key and the rows not yet decided.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from paperloom.session import ship

_STORE = "spark.sql.streaming.stateStore.providerClass"


def with_state(spark: SparkSession) -> None:
    """Let this session's streams keep state that ``transformWithState`` can use."""
    ship(spark)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Ordered(StatefulProcessor):
    """Holds rows of a key until the watermark has passed them, then gives them on in order."""

    #: State of a row: its time in microseconds, its number, and what it says.
    ROW = "at long, seq long, text string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.ROW)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        for pdf in rows:
            for at, seq, said in zip(pdf["at"].tolist(), pdf["seq"].tolist(), pdf["text"].tolist(), strict=True):
                self.waiting.appendValue((at, seq, said))
                self.handle.registerTimer(at // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(self.waiting.get(), key=lambda r: (r[0], r[1])) if self.waiting.exists() else []
        ready, rest = [r for r in held if r[0] < now], [r for r in held if r[0] >= now]
        if ready:
            self.waiting.clear()
            if rest:
                self.waiting.put(rest)
        yield from self.decided(key, ready, now)

    def decided(self, key, rows: list[tuple], now: int) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        raise NotImplementedError

    def close(self) -> None:
        pass


class _Changes(_Ordered):
    """Rows that say something else than the one before."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "text string")

    def decided(self, key, rows: list[tuple], now: int) -> Iterator[pd.DataFrame]:  # noqa: ANN001, ARG002
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for _, seq, said in rows:
            if said != last:
                out.append((key[0], seq, said))
                last = said
        if rows:
            self.last.update((last,))
        if out:
            yield pd.DataFrame(out, columns=["job", "seq", "status"])


def status_changes(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The stream of ``changes.status_changes``: ``events`` has ``job, seq, ts, status``, jobs as text, statuses not null."""
    with_state(events.sparkSession)
    rows = events.withWatermark("ts", delay).select("job", "ts", F.unix_micros("ts").alias("at"), "seq", F.col("status").alias("text"))
    return rows.groupBy("job").transformWithStateInPandas(_Changes(), "job string, seq long, status string", "append", "eventtime")


class _Locks(_Ordered):
    """One holder of an entry at a time; a lock runs out unless its holder renews it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.lock = handle.getValueState("lock", "holder string, until long")

    def decided(self, key, rows: list[tuple], now: int) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        holder, until = self.lock.get() if self.lock.exists() else (None, 0)
        out = []

        def run_out(at: int) -> None:
            nonlocal holder
            if holder is not None and until <= at:
                out.append((key[0], holder, "expired", until))
                holder = None

        for at, _, said in rows:
            who, ttl = said.rsplit("\0", 1)
            run_out(at)
            if holder is None or holder == who:
                out.append((key[0], who, "taken" if holder is None else "renewed", at))
                holder, until = who, at + int(ttl) * 1_000_000
                self.handle.registerTimer(until // 1000 + 1)
            else:
                out.append((key[0], who, "refused", at))
        run_out(now)
        if holder is None:
            self.lock.clear()
        else:
            self.lock.update((holder, until))
        if out:
            yield pd.DataFrame(out, columns=["path", "holder", "event", "at"])


def locks(requests: DataFrame, delay: str = "1 minute") -> DataFrame:
    """What becomes of requests ``path, holder, taken, seq, ttl`` (seconds): ``path, holder, event, at``.

    A request of another holder is refused while a lock lasts, one of the same
    holder renews it, and a lock whose time is over is told as expired.
    """
    with_state(requests.sparkSession)
    said = F.concat(F.col("holder"), F.lit("\0"), F.col("ttl").cast("string"))
    rows = requests.withWatermark("taken", delay).select("path", F.col("taken").alias("ts"), F.unix_micros("taken").alias("at"), "seq", said.alias("text"))
    found = rows.groupBy("path").transformWithStateInPandas(_Locks(), "path string, holder string, event string, at long", "append", "eventtime")
    return found.select("path", "holder", "event", F.timestamp_micros("at").alias("at"))
