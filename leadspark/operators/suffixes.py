"""Joins by the longest suffix of a host: block and allow tables of any size, as tables and not as branches of a plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Suffixes of so few labels may be those of very many hosts (com, co.uk, github.io); these and their rules are dealt to SALTS parts.
SHORT = 3
SALTS = 16


def suffixes(host: Column) -> Column:
    """All suffixes of a host in whole labels, the host first: a.b.c gives a.b.c, b.c and c. None for an empty or null host.

    Letters are lower-cased, one dot at the end is left out.
    """
    labels = F.split(F.regexp_replace(F.lower(host), r"\.$", ""), r"\.")
    return F.when(F.length(host) > 0, F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))).otherwise(F.array().cast("array<string>"))


def _labels(suffix: Column) -> Column:
    return F.length(suffix) - F.length(F.replace(suffix, F.lit("."))) + 1


def longest_suffix(rows: DataFrame, rules: DataFrame, host: str, suffix: str = "suffix") -> DataFrame:
    """The rows with the rule whose suffix is the longest that their host ends with, in whole labels; nulls if there is none.

    Columns: those of rows, then those of rules. No other name may stand on both sides. A host meets its own suffixes in an equi-join, so the
    plan has one size for any number of rules, and Spark broadcasts them only if they are below its threshold. Each different
    host is looked up once; suffixes of up to SHORT labels, which many hosts share, are dealt to SALTS parts.

    Rules of equal suffix (in lower case, without a dot at the end) count once, the least of them by their other columns; rules
    without a suffix never fit. Null and empty hosts have no rule. Repeated rows stay.
    """
    spark_salt = F.when(_labels(F.col("_s")) <= SHORT, F.pmod(F.xxhash64("_host"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    hosts = rows.select(F.col(host).alias("_host")).filter(F.length("_host") > 0).distinct()
    probes = hosts.withColumn("_s", F.explode(suffixes(F.col("_host")))).withColumn("_salt", spark_salt)

    key = F.regexp_replace(F.lower(F.col(suffix)), r"\.$", "")
    names = [F.col(c) for c in rules.columns]
    one = rules.withColumn("_s", key).filter(F.length("_s") > 0).groupBy("_s").agg(F.min(F.struct(*names)).alias("_rule"))
    copies = F.when(_labels(F.col("_s")) <= SHORT, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = one.withColumn("_salt", F.explode(copies))

    found = probes.join(dealt, ["_s", "_salt"]).groupBy("_host").agg(F.max_by("_rule", F.length("_s")).alias("_rule"))
    out = rows.join(found, F.col(host) == F.col("_host"), "left")
    return out.select(*[F.col(c) for c in rows.columns], *[F.col(f"_rule.{c}").alias(c) for c in rules.columns])


def unlisted(rows: DataFrame, rules: DataFrame, host: str, suffix: str = "suffix") -> DataFrame:
    """The rows whose host has no rule: no suffix of it is in the table. Null and empty hosts stay."""
    marked = longest_suffix(rows, rules.select(F.col(suffix).alias("_listed")), host, "_listed")
    return marked.filter("_listed is null").drop("_listed")
