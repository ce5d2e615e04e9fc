"""Leased jobs: at-least-once work with a lease that is renewed, retries with exponential back-off, and ends that are kept for a while.

A job (one domain of a run) is a small state machine driven by commands. ``advance`` is its only rule; the batch form folds
it over sorted partitions, the streaming form keeps it as state and ends leases by timers.

| command | taken if | effect |
|---|---|---|
| enqueue | the job is not known | waiting |
| claim | waiting, or delayed and its time has come | active, with a lease |
| beat | active | the lease is renewed |
| done | active | completed |
| error | active | delayed by the back-off, or failed when no attempt is left |
| drain | waiting or delayed | removed |

A lease that ends by itself (``lapse``) puts the job back to waiting, or fails it if that has happened too often. Commands
that are not taken change nothing; so a repeated one, or one of a worker that has lost its lease, does no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from leadspark import constants as C


class Job(NamedTuple):
    """until: end of the lease of an active job, earliest claim of a delayed one."""

    status: str
    attempts: int
    stalls: int
    until: int


class Rules(NamedTuple):
    """Attempts in all, first back-off, lease, and how often a lapsed lease is forgiven."""

    attempts: int = C.JOB_ATTEMPTS
    backoff_ms: int = C.JOB_BACKOFF_MS
    lease_ms: int = C.JOB_LEASE_MS
    stalls: int = C.JOB_STALLS


def lapsed(job: Job | None, t: int, rules: Rules) -> Job | None:
    """The job after its lease has ended by itself at or before t; None if it has not."""
    if job is None or job.status != "active" or t < job.until:
        return None
    stalls = job.stalls + 1
    return Job("failed" if stalls > rules.stalls else "waiting", job.attempts, stalls, job.until)


def advance(job: Job | None, kind: str, t: int, rules: Rules) -> Job | None:
    """The job after a command that is taken, None if it is not taken. Its lease must have been looked at before."""
    status = job.status if job else None
    if kind == "enqueue":
        return Job("waiting", 0, 0, t) if job is None else None
    if kind == "claim" and (status == "waiting" or status == "delayed" and t >= job.until):
        return job._replace(status="active", until=t + rules.lease_ms)
    if status == "active":
        if kind == "beat":
            return job._replace(until=t + rules.lease_ms)
        if kind == "done":
            return job._replace(status="completed", until=t)
        if kind == "error":
            n = job.attempts + 1
            return Job("failed", n, job.stalls, t) if n >= rules.attempts else Job("delayed", n, job.stalls, t + rules.backoff_ms * 2 ** (n - 1))
    if kind == "drain" and status in ("waiting", "delayed"):
        return job._replace(status="removed", until=t)
    return None


def told(job: Job | None, seq: int | None, t: int, kind: str, rules: Rules) -> tuple[Job | None, list[tuple]]:
    """(job, rows) after a command: a row for a lapse that comes before it, and one for itself."""
    rows = []
    if (after := lapsed(job, t, rules)) is not None:
        rows.append((None, after.until, "lapse", True, *after))
        job = after
    after = advance(job, kind, t, rules)
    rows.append((seq, t, kind, after is not None, *(after or job or (None,) * 4)))
    return after or job, rows


OUT = "run_id string, domain string, seq long, t_ms long, kind string, taken boolean, status string, attempts int, stalls int, until_ms long"
_NAMES = [x.split()[0] for x in OUT.split(", ")]


def replay(commands: DataFrame, end_ms: int | None = None, rules: Rules = Rules()) -> DataFrame:
    """commands (run_id, domain, seq, t_ms, kind) to one row for each, and one for each lapse, with the job's state after it.

    A job's commands are folded in the order of t_ms and seq, as they stream through partitions sorted by job; one job's state is
    all that is held. end_ms: leases that end by then, after a job's last command, lapse too. Null kinds and kinds not known
    are not taken; commands of a null run or domain are jobs like others; equal commands are all told.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, job, rows = None, None, []

        def ended() -> None:
            if now is not None and end_ms is not None and (after := lapsed(job, end_ms, rules)) is not None:
                rows.append((*now, None, after.until, "lapse", True, *after))

        def out() -> pd.DataFrame:
            return pd.DataFrame(rows, columns=_NAMES).astype({"seq": "Int64", "attempts": "Int32", "stalls": "Int32", "until_ms": "Int64"})

        for b in batches:
            for key, seq, t, kind in zip(zip(b["run_id"], b["domain"], strict=True), b["seq"], b["t_ms"], b["kind"], strict=True):
                if key != now:
                    ended()
                    now, job = key, None
                job, new = told(job, seq, int(t), kind, rules)
                rows += [(*key, *r) for r in new]
            if rows:
                yield out()
                rows = []
        ended()
        if rows:
            yield out()

    c = commands.select("run_id", "domain", "seq", "t_ms", "kind").repartition("run_id", "domain").sortWithinPartitions("run_id", "domain", "t_ms", "seq")
    return c.mapInPandas(run, OUT)


def outcomes(log: DataFrame) -> DataFrame:
    """(run_id, domain, status, outcome, attempts, stalls, until_ms): each job's state after its last taken command.

    An exhausted job is closed out as failed with the outcome unreachable, as a thrown one is.
    """
    order = F.struct("t_ms", F.col("kind") != "lapse", "seq")
    last = log.filter("taken").groupBy("run_id", "domain").agg(F.max_by(F.struct("status", "attempts", "stalls", "until_ms"), order).alias("j"))
    return last.select("run_id", "domain", "j.status", F.when(F.col("j.status") == "failed", "unreachable").alias("outcome"), "j.attempts", "j.stalls", "j.until_ms")


class Leases(StatefulProcessor):
    """The state machine as a stateful stream operator, keyed by (run_id, domain).

    State: the job while it is open (a value), its attempts (a map from attempt to start and end), the numbers of commands seen
    (a list, so that a command delivered twice is told once), and its end, which is kept as long as ``keep_done_ms`` or
    ``keep_failed_ms`` say and is forgotten then by the state's own time to live. Whilst an end is kept, the job is not enqueued
    again. A timer stands at the end of the lease; when it goes off and no beat has moved it, the lease has lapsed.

    The clock is processing time, so t_ms is to be the time at which a command was given, near to now.
    """

    def __init__(self, rules: Rules = Rules(), keep_done_ms: int = C.KEEP_DONE_MS, keep_failed_ms: int = C.KEEP_FAILED_MS):
        self.rules, self.keep = rules, {"completed": keep_done_ms, "removed": keep_done_ms, "failed": keep_failed_ms}

    def init(self, handle: StatefulProcessorHandle) -> None:
        job = "status string, attempts int, stalls int, until_ms long"
        self.handle = handle
        self.job = handle.getValueState("job", job)
        self.done = handle.getValueState("done", job, self.keep["completed"])
        self.failed = handle.getValueState("failed", job, self.keep["failed"])
        self.seen = handle.getListState("seen", "seq long", self.keep["failed"])
        self.attempts = handle.getMapState("attempts", "attempt int", "start_ms long, end_ms long", self.keep["failed"])

    def _read(self) -> Job | None:
        for state in (self.job, self.failed, self.done):
            if state.exists():
                return Job(*state.get())
        return None

    def _write(self, before: Job | None, job: Job) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        n = job.attempts + job.stalls + 1
        if job.status == "active":
            self.job.update(tuple(job))
            self.handle.registerTimer(job.until)
            if not self.attempts.containsKey((n,)):
                self.attempts.updateValue((n,), (job.until - self.rules.lease_ms, None))
            return
        if before is not None and before.status == "active":
            n = before.attempts + before.stalls + 1
            began = self.attempts.getValue((n,)) if self.attempts.containsKey((n,)) else (None, None)
            self.attempts.updateValue((n,), (began[0], job.until))
        if job.status in self.keep:
            self.job.clear()
            (self.failed if job.status == "failed" else self.done).update(tuple(job))
        else:
            self.job.update(tuple(job))

    def _rows(self, key: Any, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame([(*key, *r) for r in rows], columns=_NAMES)
        return out.astype({"seq": "Int64", "attempts": "Int32", "stalls": "Int32", "until_ms": "Int64"})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        commands = pd.concat(list(rows)).sort_values(["t_ms", "seq"])
        job, known, out = self._read(), {s for (s,) in self.seen.get()} if self.seen.exists() else set(), []
        for seq, t, kind in zip(commands["seq"], commands["t_ms"], commands["kind"], strict=True):
            if int(seq) in known:
                continue
            known.add(int(seq))
            self.seen.appendValue((int(seq),))
            for r in (news := told(job, int(seq), int(t), kind, self.rules))[1]:
                if r[3]:
                    after = Job(*r[4:])
                    self._write(job, after)
                    job = after
                out.append(r)
            job = news[0]
        if out:
            yield self._rows(key, out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        job = self._read()
        if (after := lapsed(job, int(expiredTimerInfo.getExpiryTimeInMs()), self.rules)) is not None:
            self._write(job, after)
            yield self._rows(key, [(None, after.until, "lapse", True, *after)])

    def close(self) -> None:
        pass


def leased(commands: DataFrame, rules: Rules = Rules(), keep_done_ms: int = C.KEEP_DONE_MS, keep_failed_ms: int = C.KEEP_FAILED_MS) -> DataFrame:
    """The stream of commands (run_id, domain, seq, t_ms, kind) to the rows that ``replay`` tells, in the append mode.

    Needs the state store of RocksDB (spark.sql.streaming.stateStore.providerClass).
    """
    c = commands.select("run_id", "domain", "seq", "t_ms", "kind")
    return c.groupBy("run_id", "domain").transformWithStateInPandas(Leases(rules, keep_done_ms, keep_failed_ms), OUT, "append", "processingTime")
