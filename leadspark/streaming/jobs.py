"""Streaming forms of the stateful parts: host schedules, breakers, guards, counters, idempotent queues and run ends."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from leadspark.operators.runs import finished_runs, run_counters


#: After this time without traffic a host's state is dropped; slots and cool-downs are long over by then. None keeps it.
IDLE_MS = 6 * 3_600_000


def _timeout(idle_ms: int | None) -> str:
    return GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout


def token_bucket(arrivals: DataFrame, interval_ms: int = 1500, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """arrivals(host, t_ms, request) to (host, t_ms, request, slot_ms); a host's state is its next free time."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        free = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["t_ms", "request"])
        slots = []
        for t in rows["t_ms"]:
            slot = int(t) if free is None else max(int(t), free)
            slots.append(slot)
            free = slot + interval_ms
        state.update((free,))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"host": key[0], "t_ms": rows["t_ms"].to_numpy(), "request": rows["request"].to_numpy(), "slot_ms": slots})

    return arrivals.groupBy("host").applyInPandasWithState(run, "host string, t_ms bigint, request string, slot_ms bigint", "free bigint", "append", _timeout(idle_ms))


def circuit_breaker(events: DataFrame, threshold: int = 4, cooldown_ms: int = 300_000, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """events(host, seq, t_ms, failed) to (host, seq, rejected, failures); a host's state is two numbers."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        failures, opened = state.get if state.exists else (0, 0)
        rows = pd.concat(list(batches)).sort_values(["t_ms", "seq"])
        out = []
        for seq, t, failed in zip(rows["seq"], rows["t_ms"], rows["failed"], strict=True):
            if opened and t - opened > cooldown_ms:
                failures = opened = 0
            shut = opened != 0
            if not shut:
                failures = failures + 1 if failed else 0
                opened = int(t) if failed and failures >= threshold else 0
            out.append((key[0], seq, shut, failures))
        state.update((failures, opened))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["host", "seq", "rejected", "failures"])

    return events.groupBy("host").applyInPandasWithState(run, "host string, seq bigint, rejected boolean, failures int", "failures int, opened bigint", "append", _timeout(idle_ms))


def rolling_guard(events: DataFrame, every: str = "1 minute", over: str = "5 minutes", late: str = "10 minutes", least: int = 40, ratio: float = 0.25) -> DataFrame:
    """events(ts, tier1): share of rendered pages in sliding event-time windows, with the alarm."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", over, every)).agg(F.count("*").alias("samples"), F.avg(F.col("tier1").cast("double")).alias("ratio"))
    return w.select("window.start", "window.end", "samples", "ratio", ((F.col("samples") >= least) & (F.col("ratio") > ratio)).alias("alarm"))


def queued_once(jobs: DataFrame, late: str = "1 day") -> DataFrame:
    """jobs(run_id, domain, ts): each domain of a run once."""
    return jobs.withWatermark("ts", late).dropDuplicatesWithinWatermark(["run_id", "domain"])


def not_cancelled(jobs: DataFrame, cancelled: DataFrame) -> DataFrame:
    return jobs.join(cancelled.select("run_id"), "run_id", "left_anti")


def counters(finished: DataFrame) -> DataFrame:
    """Running totals by run, for the update or complete mode."""
    return run_counters(finished)


def finalize(read_domains: Callable[[], DataFrame], close: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch step: of the runs that a batch touches, those that are over are closed. Closing twice changes nothing."""

    def step(batch: DataFrame, _: int) -> None:
        touched = batch.select("run_id").distinct()
        close(finished_runs(read_domains().join(touched, "run_id", "left_semi")))

    return step
