"""Totals over several groupings at once, sketches that merge upwards, and differences of snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# --- groupings ---------------------------------------------------------------------------------------------------------


def totals(rows: DataFrame, dims: list[str], sets: list[list[str]] | str, *measures: Column) -> DataFrame:
    """(dims, level, measures): the measures of each grouping set, in one pass (expand, then aggregate) in place of a union of scans.

    sets: lists of dims, or cube or rollup for all their subsets or prefixes. A dim that a set leaves out is null there, as is a null of
    the data; level tells them apart: it has a bit for each dim, the first one highest, that is 1 where the dim is left out.
    An empty table has no rows, not even a grand total.
    """
    level = F.grouping_id().alias("level")
    columns = [F.col(d) for d in dims]
    if sets == "cube":
        return rows.cube(*columns).agg(level, *measures)
    if sets == "rollup":
        return rows.rollup(*columns).agg(level, *measures)
    return rows.groupingSets([[F.col(d) for d in s] for s in sets], *columns).agg(level, *measures)


def pivoted(rows: DataFrame, by: list[str], column: str, values: list[str], *measures: Column) -> DataFrame:
    """(by, one column for each value and measure): the values are given, so no pass is needed to find them; rows of other values count in none."""
    return rows.groupBy(*by).pivot(column, values).agg(*measures)


# --- sketches ----------------------------------------------------------------------------------------------------------


def sketches(rows: DataFrame, by: list[str], member: str, number: str, log_k: int = 14, kll_k: int = 400) -> DataFrame:
    """(by, rows, hll, theta, kll): states of different members (twice: HLL to count, theta for sets too) and of a number's distribution.

    A state is a few KB whatever it has seen, and states merge without loss (``merged``), so days are kept and read again
    instead of rows. log_k: 2 ** log_k entries, a relative error of about 1.04 / 2 ** (log_k / 2) and 1 / 2 ** (log_k / 2). kll_k:
    a rank error of about 1 %. Nulls are in no sketch.
    """
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), F.hll_sketch_agg(member, log_k).alias("hll"), F.theta_sketch_agg(member, log_k).alias("theta"), F.kll_sketch_agg_double(F.col(number).cast("double"), kll_k).alias("kll"))


def merged(states: DataFrame, by: list[str], log_k: int = 14) -> DataFrame:
    """States of finer groups as states of coarser ones."""
    return states.groupBy(*by).agg(F.sum("rows").alias("rows"), F.hll_union_agg("hll").alias("hll"), F.theta_union_agg("theta", log_k).alias("theta"), F.kll_merge_agg_double("kll").alias("kll"))


def estimates(states: DataFrame, by: list[str], ranks: list[float]) -> DataFrame:
    """(by, rows, members, members_theta, quantiles) of states."""
    quantiles = F.kll_sketch_get_quantile_double("kll", F.array(*map(F.lit, ranks)))
    return states.select(*by, "rows", F.hll_sketch_estimate("hll").alias("members"), F.theta_sketch_estimate("theta").alias("members_theta"), quantiles.alias("quantiles"))


def gone(states: DataFrame, order: str) -> DataFrame:
    """(order, gone, fresh): estimates of the members that the state before had and this one has not, and the other way round."""
    before = F.lag("theta").over(Window.orderBy(order))  # one row for each state: runs or days, not members
    rows = states.withColumn("_before", before)
    none = F.col("_before").isNull()

    def left(a: str, b: str) -> Column:
        return F.theta_sketch_estimate(F.theta_difference(a, b))

    return rows.select(order, F.when(~none, left("_before", "theta")).alias("gone"), F.when(none, F.theta_sketch_estimate("theta")).otherwise(left("theta", "_before")).alias("fresh"))


# --- snapshots ---------------------------------------------------------------------------------------------------------


def changes(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """(op, key, row, copies): what makes the bag of old rows that of the new ones: delete, insert, or the two halves update_before and update_after.

    Rows are bags: a row that is there three times before and once after is deleted twice. Rows equal on both sides cancel by their
    counts, on a hash of the row before the shuffle and on the row itself after it. Of what is left, a key with rows on both
    sides is an update. Columns are taken by name and must be the same on both sides. Null keys are a key; maps aren't allowed.
    """
    names = old.columns

    def side(df: DataFrame, sign: int) -> DataFrame:
        return df.select(F.struct(*names).alias("row"), F.lit(sign).cast("long").alias("n"))

    both = side(old, -1).unionByName(side(new, 1)).withColumn("hash", F.xxhash64("row"))
    left = both.groupBy("hash", "row").agg(F.sum("n").alias("n")).filter("n <> 0")
    left = left.select(*[F.col(f"row.{k}").alias(k) for k in key], "row", "n")
    whole = Window.partitionBy(*key)
    changed = (F.min("n").over(whole) < 0) & (F.max("n").over(whole) > 0)
    op = F.when(changed, F.when(F.col("n") < 0, "update_before").otherwise("update_after")).otherwise(F.when(F.col("n") < 0, "delete").otherwise("insert"))
    return left.select(op.alias("op"), *key, "row", F.abs("n").alias("copies"))


def patched(old: DataFrame, patch: DataFrame) -> DataFrame:
    """The old rows with the changes applied: deleted copies leave (exceptAll), inserted ones come (unionAll)."""
    copies = patch.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    out = copies.filter(F.col("op").isin("delete", "update_before")).select("row.*")
    into = copies.filter(F.col("op").isin("insert", "update_after")).select("row.*")
    return old.exceptAll(out.select(old.columns)).unionByName(into)
