"""A stateful rate limit: only accepted requests count."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, LongType, StructType

from ..operators.fold import fold
from ..operators.running import RANGE, dealt, running

#: The state store that transformWithState needs.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def accept(accepted: tuple[int, ...], now: int, limit: int, window_us: int) -> tuple[tuple[int, ...], bool]:
    """The accepted times after a request at ``now``, and is it allowed? Times are microseconds; at
    most ``limit`` are held."""
    recent = tuple(t for t in accepted if now - t < window_us)
    return ((*recent, now), True) if len(recent) < limit else (recent, False)


def _scoped(events: DataFrame, limit: int | dict[str, int]) -> DataFrame:
    return events if isinstance(limit, dict) else events.withColumn("scope", F.lit(""))


def rate_limit(events: DataFrame, limit: int | dict[str, int], window_s: float) -> DataFrame:
    """``events`` (key, ts, id) with ``allowed``: are fewer than ``limit`` accepted requests of the key
    younger than the window? With a limit per scope events have a ``scope`` too, each limited apart; a
    scope without a limit is open.

    The batch form. Where a request comes a window or more after the one before, nothing accepted
    counts any more: there a key's requests are cut into segments, and each is read by time on its
    own. A key with very many requests is so many tasks' work as it has such pauses.
    """
    window = int(window_s * 1_000_000)
    keys, order = ["key", "scope"], ["us", "id"]
    timed = _scoped(events, limit).select("key", "scope", "ts", "id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    last = running(dealt(timed, keys, order), keys, order, {"last": F.col("us")}, combine=F.max)
    paused = F.coalesce(F.col("us") - F.col("last") >= window, F.lit(True))
    cut = running(last, keys, order, {"segment": paused.cast("int")}, inclusive=True).drop("last", RANGE)
    of = limit if isinstance(limit, dict) else {"": limit}
    most = F.try_element_at(F.create_map(*(F.lit(x) for pair in of.items() for x in pair)), F.coalesce("scope", F.lit("\x00"))).cast("long")

    def step(state: tuple | None, row: tuple) -> tuple[tuple, bool]:
        now, most = row
        return ((), True) if most is None else accept(state or (), now, most, window)

    out = fold(cut.withColumn("most", most), [*keys, "segment"], order, ["us", "most"], step, "allowed", "boolean")
    return out.select("key", *(["scope"] if isinstance(limit, dict) else []), "ts", "id", "allowed")


class Limiter(StatefulProcessor):
    """Holds the accepted times of a key and scope; a timer drops them when event time has passed the
    window. A scope without a limit is open and holds nothing."""

    def __init__(self, limits: dict[str, int], window_us: int) -> None:
        self.limits, self.window = limits, window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.accepted = handle.getValueState("accepted", StructType().add("times", ArrayType(LongType())))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = tuple(self.accepted.get()[0]) if self.accepted.exists() else ()
        table, limit = pd.concat(list(rows)).sort_values(["ts", "id"]), self.limits.get(key[1])
        allowed = []
        for ts in table["ts"]:
            times, ok = accept(times, int(ts.value // 1000), limit, self.window) if limit is not None else ((), True)
            allowed.append(ok)
        if limit is not None:
            self.accepted.update((list(times),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(timerValues.getCurrentWatermarkInMs() + 1, (int(table["ts"].max().value // 1000) + self.window) // 1000))
        yield pd.DataFrame({"key": key[0], "scope": key[1], "ts": table["ts"].to_numpy(), "id": table["id"].to_numpy(), "allowed": allowed})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.accepted.clear()
        return iter(())

    def close(self) -> None:
        pass


def rate_limit_stream(events: DataFrame, limit: int | dict[str, int], window_s: float, lateness: str = "10 minutes") -> DataFrame:
    """The same for a stream of ``events`` (key: string, ts, id: long, and scope: string with a limit per
    scope). The session's state store must be ROCKSDB (spark.sql.streaming.stateStore.providerClass)."""
    limits = limit if isinstance(limit, dict) else {"": limit}
    watched = _scoped(events, limit).withWatermark("ts", lateness).groupBy("key", "scope")
    out = watched.transformWithStateInPandas(Limiter(limits, int(window_s * 1_000_000)), "key string, scope string, ts timestamp, id long, allowed boolean", "append", "EventTime")
    return out if isinstance(limit, dict) else out.drop("scope")
