"""Fixed windows anchored at a key's first request, as a batch operator and as stateful streams; latest evidence by key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LIMIT, WINDOW_S, KEY_CHARS = 60, 60, 128
RESULT = "key string, order long, ts timestamp, allowed boolean, remaining int, retry_after_ms long"


class Limiter:
    """The state of one key: how many requests its window has, and when it ends (microseconds)."""

    def __init__(self, limit: float, window_s: float, count: int = 0, reset_at: int = -(1 << 62)):
        self.limit, self.window = max(1, int(limit)), max(1_000_000, int(window_s * 1_000_000))
        self.count, self.reset_at = count, reset_at

    def request(self, now: int) -> tuple[bool, int, int]:
        """Allowed, remaining, and milliseconds until the window ends where denied."""
        if now >= self.reset_at:
            self.count, self.reset_at = 0, now + self.window
        if self.count >= self.limit:
            return False, 0, -(-(self.reset_at - now) // 1000)
        self.count += 1
        return True, self.limit - self.count, 0


def requests(rows: DataFrame, key: str, ts: str, order: str) -> DataFrame:
    return rows.select(F.substring(F.col(key).cast("string"), 1, KEY_CHARS).alias("key"), F.col(order).cast("long").alias("order"), F.col(ts).cast("timestamp").alias("ts"))


def rate_limited(rows: DataFrame, key: str, ts: str, order: str, limit: float = LIMIT, window_s: float = WINDOW_S) -> DataFrame:
    """The decision on every request, in order of time within its key. A task streams its sorted keys and holds one key's counter, never its rows."""
    sorted_rows = requests(rows, key, ts, order).withColumn("us", F.unix_micros("ts")).repartition("key").sortWithinPartitions("key", "ts", "order")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for batch in batches:
            out = []
            for k, us in zip(batch["key"], batch["us"], strict=True):
                if state is None or k != last:
                    last, state = k, Limiter(limit, window_s)
                out.append(state.request(us))
            decided = pd.DataFrame(out, columns=["allowed", "remaining", "retry_after_ms"], index=batch.index)
            yield pd.concat([batch[["key", "order", "ts"]], decided], axis=1)

    return sorted_rows.mapInPandas(run, RESULT)


def rate_limited_stream(rows: DataFrame, key: str, ts: str, order: str, limit: float = LIMIT, window_s: float = WINDOW_S) -> DataFrame:
    """The same over a stream; each key's counter is kept as state, and is dropped an hour after its window can have ended. A key's requests of one micro-batch are decided in order of time."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        counter = Limiter(limit, window_s, *(state.get if state.exists else ()))
        batch = pd.concat(list(batches)).dropna(subset=["ts"]).sort_values(["ts", "order"])
        out = [counter.request(int(t.value // 1000)) for t in batch["ts"]]
        yield batch[["key", "order", "ts"]].assign(allowed=[x[0] for x in out], remaining=[x[1] for x in out], retry_after_ms=[x[2] for x in out])
        state.update((counter.count, counter.reset_at))
        state.setTimeoutDuration(counter.window // 1000 + 3_600_000)

    grouped = requests(rows, key, ts, order).groupBy("key")
    return grouped.applyInPandasWithState(run, RESULT, "count int, reset_at long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def latest_stream(rows: DataFrame, key: str, ts: str) -> DataFrame:
    """The newest time and count of each key so far, for update mode."""
    return rows.groupBy(key).agg(F.max(ts).alias("latest"), F.count("*").alias("seen"))
