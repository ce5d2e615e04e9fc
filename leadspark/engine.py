"""The engine's own interface: begin, approve and cancel runs, and read them. Errors are values: (result, error)."""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark.components import stored
from leadspark.config import EngineConfig
from leadspark.operators import discover, run_ends, runs
from leadspark.sources import llm, search

#: Type of the log of run changes; its first columns are what ``runs.fold_run_status`` takes.
RUN_LOG = "run_id string, seq int, ts timestamp, status string, error string, query string, plan string, domains_total int, approved_at timestamp, finished_at timestamp"
#: Type of the log of events.
_EVENTS = "run_id string, level string, stage string, message string"
#: Bytes of a request's text, at most.
MOST_TEXT = 16 * 1024


@dataclass(frozen=True)
class Run:
    id: str
    query: str
    status: str
    plan: dict | None = None
    error: str | None = None
    version: int = 0
    domains_total: int = 0
    approved_at: datetime | None = None
    finished_at: datetime | None = None


@dataclass
class Engine:
    """Runs live in a table with versions: a change holds only if the version it read is still there.

    The driver holds the runs it works on; with a ``log`` folder each change is also appended there as an event, from which
    ``resume`` makes the runs again after the driver is lost, and ``runs.fold_run_status`` their states.
    """

    spark: SparkSession
    planner: llm.Client
    providers: list[search.JsonProvider] = field(default_factory=list)
    config: EngineConfig = field(default_factory=EngineConfig)
    enqueue: Callable[[DataFrame], None] | None = None
    log: str | None = None

    def __post_init__(self):
        self.runs: dict[str, Run] = self.resume() if self.log else {}
        self.events: list[tuple[str, str, str, str]] = []
        self._lock = threading.Lock()

    def _change(self, old: Run, **new) -> Run | None:
        """Compare and set; None if another change came first."""
        with self._lock:
            if self.runs.get(old.id) is not old:
                return None
            if new.get("status", old.status) in ("completed", "failed", "cancelled") and old.finished_at is None:
                new["finished_at"] = datetime.now(timezone.utc)
            if new.get("status") == "discovering" and old.approved_at is None:
                new["approved_at"] = datetime.now(timezone.utc)
            made = replace(old, version=old.version + 1, **new)
            self._append(made)  # first the log: what can't be written down doesn't hold
            self.runs[old.id] = made
            return made

    def _append(self, run: Run) -> None:
        """One more event of the run in the log, numbered by its version."""
        if self.log:
            row = (run.id, run.version, datetime.now(timezone.utc), run.status, run.error, run.query, json.dumps(run.plan), run.domains_total, run.approved_at, run.finished_at)
            self.spark.createDataFrame([row], RUN_LOG).coalesce(1).write.mode("append").parquet(self.log)

    def resume(self) -> dict[str, Run]:
        """The runs as the log's latest events leave them; none if there is no log yet."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.log)
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return {}
        events = self.spark.read.schema(RUN_LOG).parquet(self.log)
        last = events.groupBy("run_id").agg(F.max_by(F.struct(*events.columns), "seq").alias("e")).select("e.*")
        return {r.run_id: Run(r.run_id, r.query, r.status, json.loads(r.plan) if r.plan else None, r.error, r.seq, r.domains_total, r.approved_at, r.finished_at) for r in last.collect()}  # the runs in work, low hundreds

    def _log(self, run_id: str, stage: str, message: str, level: str = "info") -> None:
        self.events.append((run_id, level, stage, message))
        if self.log:
            self._keep(self.spark.createDataFrame([self.events[-1]], _EVENTS))

    def _keep(self, events: DataFrame) -> None:
        events.withColumn("created_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.log}-events")

    def event_table(self) -> DataFrame:
        """(run_id, level, stage, message): what has been told of all runs, from the log if there is one."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.log}-events")
        if self.log and at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.read.schema(_EVENTS).parquet(f"{self.log}-events")
        return self.spark.createDataFrame(self.events, _EVENTS)

    def run_table(self, counters: DataFrame) -> DataFrame:
        """The runs in work as rows of the run table, with the figures of counters."""
        rows = self.spark.createDataFrame([(r.id, r.status, r.finished_at) for r in self.runs.values()], "id string, status string, finished_at timestamp")
        names = [c for c in counters.columns if c != "run_id"]
        return rows.join(counters.withColumnRenamed("run_id", "id"), "id", "left").na.fill(0, names)

    def begin_run(self, text: str) -> tuple[Run | None, str | None]:
        """A run with its plan to be approved. The run is there before planning, so that a failure can be looked at."""
        query = text.strip()
        if not query:
            return None, "query is required"
        if len(query.encode()) > MOST_TEXT:
            return None, "body too large"
        ident = str(uuid.uuid4())
        run = self.runs[ident] = Run(ident, query, "planning")
        self._append(run)
        got = llm.plan_run(query, self.config.current_year, self.planner)
        if got["outcome"] != "ok":
            self._log(ident, "plan", got["error"], "error")
            return self._change(run, status="failed", error=got["error"]), got["error"]
        return self._change(run, status="awaiting_approval", plan=got["plan"]), None

    def approve_run(self, ident: str) -> tuple[int | None, str | None]:
        """Opens the gate once, searches, and queues the domains found; gives their number."""
        run = self.runs.get(ident)
        if run is None:
            return None, "run not found"
        if run.status != "awaiting_approval" or not run.plan:
            return None, f"run is {run.status}, not awaiting approval"
        run = self._change(run, status="discovering")  # the gate closes before anything is spent
        if run is None:
            return None, "run was changed meanwhile"
        queries = self.spark.createDataFrame([(ident, i, q) for i, q in enumerate(run.plan["search_queries"])], "run_id string, query_idx int, query string")
        target = int(run.plan.get("target_domains") or 0)
        found, errors = None, 0
        if self.providers and target > 0:
            hits, failed = search.search(queries, self.providers)
            found = stored(discover.discover(hits, target))
            errors = failed.count()
        total = found.count() if found is not None else 0
        if not total:
            why = "every search failed" if errors else "no results"
            self._log(ident, "discover", why, "error")
            self._change(run, status="failed", error=why)
            return None, why
        if self.enqueue is not None:
            self.enqueue(found.select("run_id", "domain", "seed_url", "source"))
        if self._change(run, status="scraping", domains_total=total) is None:
            return None, "run was changed meanwhile"
        self._log(ident, "start", f"queued {total} domains")
        return total, None

    def cancel_run(self, ident: str) -> tuple[bool, str | None]:
        run = self.runs.get(ident)
        if run is None:
            return False, "run not found"
        if not runs.may_move(run.status, "cancelled"):
            return False, f"run is {run.status}"
        if self._change(run, status="cancelled") is None:
            return False, "run was changed meanwhile"
        self._log(ident, "cancel", "cancelled")
        return True, None

    def finalize(self, domains: DataFrame) -> list[str]:
        """Completes the runs in work whose domains are all done; cancelled ones stay so."""
        over = {r.run_id for r in runs.finished_runs(domains.filter(F.col("run_id").isin([k for k, v in self.runs.items() if v.status in ("scraping", "discovering")]))).collect()}
        return [i for i in sorted(over) if self._change(self.runs[i], status="completed")]

    def cancel(self, ident: str, domains: DataFrame, counters: DataFrame) -> tuple[run_ends.Ended | None, str | None]:
        """``cancel_run`` with its tables: queued domains skipped, counters flushed for the time being, and told."""
        table = self.run_table(counters)
        done, error = self.cancel_run(ident)
        if not done:
            return None, error
        ended = run_ends.cancel(table, domains, self.spark.createDataFrame([(ident,)], "run_id string"), counters)
        self._tell(ended)
        return ended, None

    def finish(self, domains: DataFrame, leads: DataFrame, counters: DataFrame) -> run_ends.Ended:
        """``finalize`` with its tables: duplicates merged, counters flushed, runs closed, and told, once for each run."""
        ended = run_ends.finish(self.run_table(counters), domains, leads, counters, self.event_table())
        for r in ended.closed.collect():  # of the runs in work, low hundreds
            if self.runs[r.run_id].status != "cancelled":
                self._change(self.runs[r.run_id], status="completed")
        self._tell(ended)
        return ended

    def _tell(self, ended: run_ends.Ended) -> None:
        told = stored(ended.events)
        self.events += [tuple(r) for r in told.collect()]  # a few for each run that ends
        if self.log:
            self._keep(told)

    def close(self) -> None:
        for q in self.spark.streams.active:
            q.stop()
