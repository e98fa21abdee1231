"""Structured Streaming over a growing trace: observers by micro-batch, bests by event-time window, folds with state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from lodestone.operators import folds


def read_trace(spark: SparkSession, folder: str, schema: StructType | str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def observe(stream: DataFrame, observer: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Calls observer(batch, number) for every micro-batch; a batch is announced again only after a failure within it."""
    writer = stream.writeStream.foreachBatch(observer).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_best(stream: DataFrame, time: str, group: str, total: str, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Best total and row count of each group and window; rows later than `late` are dropped with their state."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), group).agg(F.max(total).alias("best_total"), F.count(F.lit(1)).alias("rows"))


class Fold(StatefulProcessor):
    """step(state before or None, *values) over each group's rows as they come; a group that stays idle is closed.

    State is one record a group, kept by the state store, so a query that is
    started again from its checkpoint goes on where it was.
    """

    def __init__(self, order: str, values: list[str], states: str, step: Callable[..., tuple], idle_ms: int | None):
        self.order, self.values, self.states, self.step, self.idle_ms = order, values, states, step, idle_ms
        self.names = [c.split()[0] for c in states.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.states)
        self.seen = handle.getValueState("seen", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(rows)).sort_values(self.order, kind="stable")  # one group's rows of one micro-batch
        state = tuple(self.state.get()) if self.state.exists() else None
        out = []
        for xs in zip(*(part[v].tolist() for v in self.values)):
            state = self.step(state, *xs)
            out.append(state)
        n = (self.seen.get()[0] if self.seen.exists() else 0) + len(out)
        self.state.update(state)
        self.seen.update((n,))
        if self.idle_ms is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield self._rows(key, part[self.order].tolist(), out, [n - len(out) + 1 + i for i in range(len(out))], False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, n = tuple(self.state.get()), self.seen.get()[0]
        self.state.clear()
        self.seen.clear()
        yield self._rows(key, [None], [state], [n], True)

    def _rows(self, key, orders: list, states: list[tuple], seen: list[int], closed: bool) -> pd.DataFrame:
        out = pd.DataFrame(states, columns=self.names)
        out.insert(0, "order", pd.array(orders, dtype="Int64"))
        out.insert(0, "group", [key[0]] * len(states))
        return out.assign(seen=seen, closed=closed)

    def close(self) -> None:
        pass


def _folded(stream: DataFrame, group: str, order: str, values: list[str], states: str, step: Callable[..., tuple], idle_ms: int | None) -> DataFrame:
    kind = dict(stream.dtypes)[group]
    schema = f"group {kind}, order long, {states}, seen long, closed boolean"
    rows = stream.select(F.col(group).alias("group"), F.col(order).cast("long").alias(order), *values)
    mode = "ProcessingTime" if idle_ms is not None else "None"
    return rows.groupBy("group").transformWithStateInPandas(Fold(order, values, states, step, idle_ms), schema, "Append", mode)


def use_state_store(spark: SparkSession) -> None:
    """Folds keep their state in RocksDB: to be set before a query with one is started."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def patience(stream: DataFrame, group: str, order: str, value: str, tolerance: float, limit: int, idle_ms: int | None = None) -> DataFrame:
    """(group, order, PATIENCE, seen, closed) of a growing trace: what folds.patience gives for the rows so far.

    Rows of a micro-batch are taken in the order of `order`; later batches hold
    later rows.  With idle_ms a group without rows for so long is closed: a row
    without order tells its last state, which then goes.
    """
    rows = stream.withColumn(value, F.col(value).cast("double"))
    return _folded(rows, group, order, [value], folds.PATIENCE, folds.patience_step(tolerance, limit), idle_ms)


def adaptive_rate(
    stream: DataFrame, group: str, order: str, diversity: str, improved: str, initial: float, low: float, high: float, step: float, threshold: float, reset: bool = True, idle_ms: int | None = None
) -> DataFrame:
    """(group, order, RATE, seen, closed) of a growing trace: what folds.adaptive_rate gives; idle_ms as in patience()."""
    rows = stream.withColumn(diversity, F.col(diversity).cast("double")).withColumn(improved, F.coalesce(F.col(improved).cast("boolean"), F.lit(False)))
    return _folded(rows, group, order, [diversity, improved], folds.RATE, folds.rate_step(initial, low, high, step, threshold, reset), idle_ms)
