"""Session windows, over streams and over tables, and calendars without gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadspark.components import stored


def sessions(events: DataFrame, keys: list[str], gap: str, *measures: Column, late: str = "10 minutes") -> DataFrame:
    """(keys, start, end, measures): runs of a key's events, each within ``gap`` of the one before; end is the last time and the gap.

    events: a stream or a table with ts. Streams keep the sessions that the watermark has not closed and drop later rows.
    Events exactly a gap apart are in one session. Null times are in none; a null key is one.
    """
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), *keys)
    return grouped.agg(*measures).select(*keys, "session_window.start", "session_window.end", *[m for m in _names(events, keys, measures)])


def _names(events: DataFrame, keys: list[str], measures: tuple[Column, ...]) -> list[str]:
    return events.groupBy(*keys).agg(*measures).columns[len(keys) :]


def session_islands(events: DataFrame, keys: list[str], gap: str, *measures: Column) -> DataFrame:
    """The sessions of a table by gaps and islands, for keys of any size.

    Rows are dealt to ranges of (keys, ts), so a hot key is spread; a row begins an island if the row before it in its range, or
    the last one of the ranges before, is more than a gap away; islands are numbered within ranges and over them.
    """
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(events.filter("ts is not null").repartitionByRange(parts, *keys, "ts").withColumn("_part", F.spark_partition_id()))
    k = [F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)]
    same = F.lit(True)
    for i, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))

    def over(*by: str):
        return Window.partitionBy(*by)

    ends = dealt.groupBy(*keys, "_part").agg(F.max("ts").alias("_last")).select(*k, F.col("_part").alias("_p"), F.max("_last").over(over(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    own = over(*keys, "_part").orderBy("ts")
    rows = dealt.withColumn("_prev", F.lag("ts").over(own)).join(stored(ends), same & (F.col("_part") == F.col("_p")), "left").drop("_p", *[f"_k{i}" for i in range(len(keys))])
    starts = F.coalesce(F.coalesce("_prev", "_before") + F.expr(f"INTERVAL {gap}") < F.col("ts"), F.lit(True)).cast("long")
    rows = stored(rows.withColumn("_start", starts))
    counts = rows.groupBy(*keys, "_part").agg(F.sum("_start").alias("_n")).select(*k, F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(over(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    within = F.sum("_start").over(own.rowsBetween(Window.unboundedPreceding, 0))
    islands = rows.withColumn("_in", within).join(stored(counts), same & (F.col("_part") == F.col("_p"))).withColumn("_island", F.col("_in") + F.col("_base"))
    out = islands.groupBy(*keys, "_island").agg(F.min("ts").alias("start"), F.max("ts").alias("_end"), *measures)
    return out.withColumn("end", F.col("_end") + F.expr(f"INTERVAL {gap}")).select(*keys, "start", "end", *_names(events, keys, measures))


def calendar(counts: DataFrame, keys: list[str], day: str, values: list[str], carried: list[str]) -> DataFrame:
    """counts with a row for each day from a key's first to its last: values are 0 on days without a row, carried ones those of the day before.

    counts has one row for each key and date. Days come from a sequence, so a key has as many rows as its span has days. A
    null carried value is carried over too; null dates are left out.
    """
    c = counts.filter(F.col(day).isNotNull())
    span = c.groupBy(*keys).agg(F.min(day).alias("_a"), F.max(day).alias("_b"))
    days = span.select(*[F.col(x).alias(f"_k{i}") for i, x in enumerate(keys)], F.explode(F.sequence("_a", "_b")).alias("_day"))
    same = F.col(day) == F.col("_day")
    for i, x in enumerate(keys):
        same = same & F.col(x).eqNullSafe(F.col(f"_k{i}"))
    full = days.join(c, same, "left")
    past = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))]).orderBy("_day").rowsBetween(Window.unboundedPreceding, 0)
    return full.select(
        *[F.col(f"_k{i}").alias(x) for i, x in enumerate(keys)], F.col("_day").alias(day),
        *[F.coalesce(v, F.lit(0)).alias(v) for v in values], *[F.last(v, ignorenulls=True).over(past).alias(v) for v in carried],
    )
