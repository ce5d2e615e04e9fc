"""How runs end: cancelling and finishing them, each as one step from tables to tables that may be taken again.

Tables have the columns of ``schemas``; a step returns new versions of those that it changes and the new events. counters has
a row for each run with what its finished domains have added up (``runs.run_counters``).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspark.components import stored
from leadspark.constants import RUN_TERMINAL

from . import dedupe, runs

#: The last event of a run that is over.
FINISHED = "run finished"
#: Why a queued domain of a cancelled run is skipped.
SKIPPED = "run cancelled before start"
#: States that a run can be finished from; a cancelled one is settled and stays cancelled.
OPEN = ["scraping", "discovering", "cancelled"]

_EVENT = ["run_id", "level", "stage", "message"]


class Ended(NamedTuple):
    """closed has the run_id of each run that the step has ended; counters those that are still to be flushed."""

    runs: DataFrame
    domains: DataFrame
    leads: DataFrame | None
    counters: DataFrame
    events: DataFrame
    closed: DataFrame


def _ended(table: DataFrame, hit: DataFrame, status: Column, now: Column) -> DataFrame:
    """The runs with a new status for those hit, and the time of the first end that they came to."""
    d = table.join(hit.select(F.col("run_id").alias("id"), F.lit(True).alias("_hit")), "id", "left")
    time = F.when(F.col("_hit"), F.coalesce("finished_at", now)).otherwise(F.col("finished_at"))
    return d.select(*(F.when(F.col("_hit"), status).otherwise(F.col(c)).alias(c) if c == "status" else time.alias(c) if c == "finished_at" else F.col(c) for c in table.columns))


def _event(rows: DataFrame, stage: str, message: Column, level: str = "info") -> DataFrame:
    return rows.select("run_id", F.lit(level).alias("level"), F.lit(stage).alias("stage"), message.alias("message"))


def cancel(run_table: DataFrame, domains: DataFrame, asked: DataFrame, counters: DataFrame, now: Column | None = None) -> Ended:
    """Cancels the runs asked(run_id) for that are not over yet.

    In this order, as far as order can be seen: the runs are marked (``closed``, which ``enrich.live`` and the job queue's drain
    take), their queued domains are skipped, counters are flushed for the time being, the status is set, and the event
    tells how many domains were dropped. Domains at work come to their own ends, and ``finish`` settles the run then. Runs that are over
    or not there, and ids asked for twice, change nothing.
    """
    now = F.current_timestamp() if now is None else now
    may = run_table.filter(~F.col("status").isin(RUN_TERMINAL)).select(F.col("id").alias("run_id"))
    closed = stored(asked.select("run_id").distinct().join(may, "run_id", "left_semi"))
    d = domains.join(closed.withColumn("_hit", F.lit(True)), "run_id", "left")
    skip = F.coalesce(F.col("_hit") & (F.col("status") == "queued"), F.lit(False))
    new = {"status": F.lit("skipped"), "note": F.lit(SKIPPED), "finished_at": now}
    after = d.select(*(F.when(skip, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in domains.columns))
    dropped = domains.filter("status = 'queued'").groupBy("run_id").agg(F.count("*").alias("n"))
    told = closed.join(dropped, "run_id", "left")
    events = _event(told, "cancel", F.concat(F.lit("cancelled; "), F.coalesce("n", F.lit(0)).cast("string"), F.lit(" queued domains dropped")), "warn")
    flushed = runs.flush_counters(run_table, counters.join(closed, "run_id", "left_semi"))
    return Ended(_ended(flushed, closed, F.lit("cancelled"), now), after, None, counters, events, closed)


def finish(run_table: DataFrame, domains: DataFrame, leads: DataFrame, counters: DataFrame, events: DataFrame | None = None, now: Column | None = None) -> Ended:
    """Finishes the runs all of whose domains, at least one, have come to an end.

    Of each such run that is discovering, scraping or cancelled: duplicate leads among those that none has absorbed are merged,
    then counters are flushed, then the status becomes completed (cancelled stays), then the counters are cleared, and the log
    says what was merged and that the run is finished. events: the log so far; a run that it calls finished is left alone, so a sweep and a
    batch of a stream may both call this. Runs with a domain at work, without domains, and of other states stay as they are,
    and so do leads and counters of other runs; a run without counters keeps the figures that it has.
    """
    now = F.current_timestamp() if now is None else now
    over = runs.finished_runs(domains).join(run_table.filter(F.col("status").isin(OPEN)).select(F.col("id").alias("run_id")), "run_id", "left_semi")
    if events is not None:
        over = over.join(events.filter((F.col("stage") == "run") & (F.col("message") == FINISHED)).select("run_id"), "run_id", "left_anti")
    closed = stored(over)

    due, rest = leads.join(closed, "run_id", "left_semi"), leads.join(closed, "run_id", "left_anti")
    before = due.filter("merged_into is null").select("run_id", "id", "domain")
    merged = stored(dedupe.dedupe_runs(due)[0])
    gone = merged.filter("merged_into is not null").select("run_id", "id", "domain", "merged_into").join(before.select("run_id", "id"), ["run_id", "id"], "left_semi")
    groups = gone.groupBy("run_id", F.col("merged_into").alias("id")).agg(F.count("*").alias("n")).join(merged.filter("merged_into is null").select("run_id", "id", "domain", "merged_domains"), ["run_id", "id"])
    newly = F.slice("merged_domains", F.size("merged_domains") - F.col("n").cast("int") + 1, F.col("n").cast("int"))
    absorbed = _event(groups, "dedupe", F.concat("domain", F.lit(" absorbed "), F.array_join(newly, ", ")))
    counted = _event(gone.groupBy("run_id").agg(F.count("*").alias("n")), "dedupe", F.concat(F.lit("merged "), F.col("n").cast("string"), F.lit(" duplicate lead(s)")))
    told = absorbed.unionByName(counted).unionByName(_event(closed, "run", F.lit(FINISHED)))

    flushed = runs.flush_counters(run_table, counters.join(closed, "run_id", "left_semi"))
    status = F.when(F.col("status") == "cancelled", "cancelled").otherwise("completed")
    after = _ended(flushed, closed, status, now)
    return Ended(after, domains, rest.unionByName(merged.select(rest.columns)), counters.join(closed, "run_id", "left_anti"), told.select(_EVENT), closed)
