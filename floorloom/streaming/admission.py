"""Sliding-window admission with feedback: a refused request does not use up the window.

Whether a request is admitted depends on earlier admissions, so no window aggregate can say it.  Each client and category is folded
in time order; the state is at most ``limit`` admission times.  ``admitted`` does a table, ``admit_stream`` a stream with the same rule.
"""

from __future__ import annotations

import heapq
from collections import OrderedDict, deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW_SECONDS, LIMITS = 60, {"read": 120, "post": 30}


def fold(times: list[float], held: deque, window: float, limit: int) -> list[bool]:
    """Decisions for sorted times; ``held`` has the admissions still in the window and is updated."""
    out = []
    for t in times:
        while held and t - held[0] >= window:
            held.popleft()
        ok = len(held) < limit
        if ok:
            held.append(t)
        out.append(ok)
    return out


def admitted(requests: DataFrame, window_seconds: float = WINDOW_SECONDS, limits: dict[str, int] = LIMITS) -> DataFrame:
    """client, category, event_id, ts, allowed.  A partition holds a client's sorted requests; only the window is in memory."""
    from floorloom.operators.network import sorted_fold

    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    rows = requests.select("client", "category", "event_id", "ts", seconds.alias("t"))

    def start():
        return deque()

    def step(state, pdf):
        return fold(pdf["t"].tolist(), state, window_seconds, limits.get(pdf["category"].iloc[0], 0))

    return sorted_fold(rows, ["client", "category"], ["ts", "event_id"], start, step, "allowed boolean").drop("t")


def in_flight(requests: DataFrame, most: int = 16) -> DataFrame:
    """server, event_id, ts, seconds, admitted: a server does ``most`` requests at a time and refuses more, it queues none.

    The state of a server is at most ``most`` ends of requests; its sorted requests are streamed, not held.
    """
    from floorloom.operators.network import sorted_fold

    rows = requests.select("server", "event_id", "ts", "seconds", (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("t"))

    def step(ends: list, pdf):
        out = []
        for t, seconds in zip(pdf["t"], pdf["seconds"]):
            while ends and ends[0] <= t:
                heapq.heappop(ends)
            ok = len(ends) < most
            if ok:
                heapq.heappush(ends, t + seconds)
            out.append(ok)
        return out

    return sorted_fold(rows, ["server"], ["ts", "event_id"], list, step, "admitted boolean").drop("t")


def cached(requests: DataFrame, size: int = 8) -> DataFrame:
    """server, event_id, ts, scene, hit: whether a server has the scene among the ``size`` that it used last.

    One that it has not is loaded once, by the request that asks first, and puts the one used longest ago out.
    """
    from floorloom.operators.network import sorted_fold

    def step(held: OrderedDict, pdf):
        out = []
        for scene in pdf["scene"]:
            out.append(scene in held)
            held[scene] = None
            held.move_to_end(scene)
            if len(held) > size:
                held.popitem(last=False)
        return out

    return sorted_fold(requests.select("server", "event_id", "ts", "scene"), ["server"], ["ts", "event_id"], OrderedDict, step, "hit boolean")


def admit_stream(requests: DataFrame, window_seconds: float = WINDOW_SECONDS, limits: dict[str, int] = LIMITS) -> DataFrame:
    """The same over a stream of (client, category, event_id, ts); late rows are judged in the order they come within a batch."""

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = deque(state.get[0]) if state.exists else deque()
        pdf = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        times = (pdf["ts"].astype("int64") / 1e9).tolist()
        ok = fold(times, held, window_seconds, limits.get(key[1], 0))
        state.update((list(held),))
        yield pdf.assign(allowed=ok)[["client", "category", "event_id", "allowed"]]

    return requests.groupBy("client", "category").applyInPandasWithState(run, "client string, category string, event_id long, allowed boolean", "held array<double>", "append", "NoTimeout")


def access_summary(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Requests and mean duration per window, route and status of a stream or table (ts, route, status, duration_ms)."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", size).alias("w"), "route", "status").agg(F.count(F.lit(1)).alias("n"), F.avg("duration_ms").alias("mean_ms")).select(F.col("w.start").alias("start"), "route", "status", "n", "mean_ms")
