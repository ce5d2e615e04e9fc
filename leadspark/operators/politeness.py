"""Per-host schedules and guards over event tables; the streaming forms are in ``leadspark.streaming``.

All are folds in time order within a host. Where a closed form exists it is a window; the breaker streams through sorted partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def token_bucket(arrivals: DataFrame, interval_ms: int = 1500, host: str = "host", t: str = "t_ms", order: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``slot_ms``, when each request may go: slot = max(arrival, slot before + interval).

    ``floor_ms``, if there is such a column, is a time that a Retry-After has put off the host's next slot to.
    """
    w = Window.partitionBy(host).orderBy(t, *order)
    at = F.greatest(t, "floor_ms") if "floor_ms" in arrivals.columns else F.col(t)
    d = arrivals.withColumn("_n", F.row_number().over(w) * F.lit(interval_ms).cast("long")).withColumn("_d", at - F.col("_n"))
    return d.withColumn("slot_ms", F.col("_n") + F.max("_d").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_n", "_d")


def retry_after_ms(now_ms: Column, value: Column) -> Column:
    """The time that a Retry-After puts a host off to: seconds, at most 120, or a date; null for neither."""
    seconds = value.try_cast("double")
    date = F.try_to_timestamp(F.regexp_replace(value, r"^\w{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    return F.when(seconds.isNotNull(), now_ms + F.least(seconds * 1000, F.lit(120_000.0)).cast("long")).otherwise(F.unix_millis(date))


def rolling_ratio(events: DataFrame, window_ms: int = 300_000, least: int = 40, ratio: float = 0.25, t: str = "t_ms", hit: str = "tier1", by: tuple[str, ...] = ()) -> DataFrame:
    """Adds samples, ratio and alarm over the trailing window, its edge included. by: keys of separate guards.

    Time is cut into spans of the window's length; an event also stands in the span after its own, at the time when it leaves
    the window. So a task holds two spans of a guard's events, not all of them, and a window's counts are those of the span
    before and of the events come so far, less those gone: running sums, whose work does not grow with the window.
    """
    come = F.col("_gone") == 0
    d = events.withColumn("_gone", F.explode(F.when(F.col(t).isNull(), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))))
    d = d.withColumn("_span", F.floor(F.col(t) / window_ms) + F.col("_gone")).withColumn("_at", F.col(t) + F.col("_gone") * window_ms)
    span = Window.partitionBy(*by, "_span")
    # those that leave at a time still count for the events of that time
    so_far = span.orderBy("_at", "_gone").rangeBetween(Window.unboundedPreceding, Window.currentRow)

    def within(n: Column) -> Column:
        return F.sum(F.when(come, 0).otherwise(n)).over(span) + F.sum(F.when(come, n).otherwise(-n)).over(so_far)

    known, hits = F.col(hit).isNotNull().cast("long"), F.coalesce(F.col(hit).cast("long"), F.lit(0))
    d = d.withColumns({"samples": within(F.lit(1).cast("long")), "_known": within(known), "_hits": within(hits)})
    d = d.filter(come).withColumn("ratio", F.when(F.col("_known") > 0, F.col("_hits") / F.col("_known")))
    return d.drop("_gone", "_span", "_at", "_known", "_hits").withColumn("alarm", (F.col("samples") >= least) & (F.col("ratio") > ratio))


def circuit_breaker(events: DataFrame, threshold: int = 4, cooldown_ms: int = 300_000, host: str = "host", t: str = "t_ms", failed: str = "failed", order: str = "seq") -> DataFrame:
    """Rows (host, seq, t, rejected, failures): requests while the breaker is open are rejected and change nothing.

    The threshold of failures in a row opens it; after the cool-down it starts anew. Hosts are dealt over partitions and
    stream through in time order with two numbers of state, so a host's traffic may be of any length.
    """
    kind = events.select(F.col(host)).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, failures, opened = None, 0, 0
        for b in batches:
            shut, counts = [], []
            for h, at, bad in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if h != now:
                    now, failures, opened = h, 0, 0
                if opened and at - opened > cooldown_ms:
                    failures = opened = 0
                shut.append(opened != 0)
                if not shut[-1]:
                    failures = failures + 1 if bad else 0
                    opened = at if bad and failures >= threshold else 0
                counts.append(failures)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(shut, pa.bool_()), pa.array(counts, pa.int32())], names=["h", "seq", "t", "rejected", "failures"])

    rows = events.filter(F.col(host).isNotNull()).select(F.col(host).alias("h"), F.col(order).cast("bigint").alias("seq"), F.col(t).cast("bigint").alias("t"), F.coalesce(F.col(failed), F.lit(False)).alias("failed"))
    done = rows.repartition("h").sortWithinPartitions("h", "t", "seq").mapInArrow(run, f"h {kind}, seq bigint, t bigint, rejected boolean, failures int")
    return done.withColumnRenamed("h", host)


def breaker_report(tier0_ok: Column, challenge: Column, tier1: Column, tier1_ok: Column, kept: Column) -> Column:
    """What a fetch tells the breaker: failure, success or nothing (a rescue by the managed service tells nothing)."""
    return F.when(~tier0_ok | challenge | (tier1 & ~tier1_ok), "failure").when(kept | (tier1 & tier1_ok), "success")
