"""Prefix labels of an unbounded stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUTPUT = "user_session string, source_order long, event_time timestamp, last_event_type string, label int"
_STATE = "orders array<long>, times array<long>, types array<string>, closed boolean"


def stream_labels(events: DataFrame, minutes: int = 30, delay: str = "0 seconds") -> DataFrame:
    """Labels of the events before their session's first purchase, each once its window is over.

    `events` is a stream with user_session, source_order, event_time and event_type. A session's
    open samples wait until a purchase labels them or the watermark passes their window; after the
    first purchase the session is closed and its state holds a flag only. The session zone must be
    UTC, as watermarks need timestamps with a zone.
    """
    window = minutes * 60_000_000

    def label(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        orders, times, types, closed = (list(x) if isinstance(x, (list, tuple)) else x for x in (state.get if state.exists else ([], [], [], False)))
        done: list[tuple] = []
        if not state.hasTimedOut:
            rows = pd.concat(list(batches)).sort_values(["event_time", "source_order"])
            at = rows["event_time"].astype("datetime64[us]").astype("int64")
            for order, time, kind in zip(rows["source_order"], at, rows["event_type"]):
                if closed:
                    continue
                if kind == "purchase":
                    closed = True
                    done += [(o, t, k, int(t < time <= t + window)) for o, t, k in zip(orders, times, types) if t < time]
                    orders, times, types = [], [], []
                else:
                    orders.append(int(order)), times.append(int(time)), types.append(kind)
        mark = state.getCurrentWatermarkMs() * 1000
        over = [i for i, t in enumerate(times) if t + window < mark]
        done += [(orders[i], times[i], types[i], 0) for i in over]
        keep = [i for i in range(len(times)) if i not in set(over)]
        orders, times, types = ([x[i] for i in keep] for x in (orders, times, types))
        state.update((orders, times, types, closed))
        if times:
            state.setTimeoutTimestamp(max((min(times) + window) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        out = pd.DataFrame(done, columns=["source_order", "event_time", "last_event_type", "label"])
        out.insert(0, "user_session", key[0])
        out["event_time"] = pd.to_datetime(out["event_time"], unit="us", utc=True)
        yield out

    valid = events.where(F.col("user_session").isNotNull() & F.col("event_time").isNotNull())
    return (
        valid.select("user_session", "source_order", F.col("event_time").cast("timestamp").alias("event_time"), "event_type")
        .withWatermark("event_time", delay)
        .groupBy("user_session")
        .applyInPandasWithState(label, _OUTPUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )
