"""Discovery: search hits to ranked company domains.

Order is data: the first hit by (query, provider, place) names a domain's source, title and snippet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadspark.functions import urls

_SEQ = ("query_idx", "provider_idx", "hit_idx")


def usable_hits(hits: DataFrame) -> DataFrame:
    """Hits of crawlable company domains, with ``canonical`` and ``domain``; each address is taken apart once."""
    def with_domain(c: Column) -> Column:
        return F.when(c.isNotNull(), F.struct(c.alias("canonical"), urls.domain_of(c).alias("domain")))

    # exploding a list of one keeps filters and later steps from copying the expression
    found = urls.bound(urls.canonical_url(F.col("url")), with_domain)
    d = hits.select("*", F.explode(F.array(found)).alias("_found")).select(*hits.columns, "_found.canonical", "_found.domain")
    return d.filter(F.col("domain").isNotNull() & ~urls.is_blocked(F.col("domain")) & ~urls.is_non_company(F.col("domain")))


def collapse(usable: DataFrame, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """One row a domain: its hits, what its first hit says, and the shallowest address, the earliest of equals."""
    seq = F.struct(*_SEQ)
    return usable.groupBy(*keys, "domain").agg(
        F.min_by("canonical", F.struct(urls.depth(F.col("canonical")), seq)).alias("seed_url"),
        F.count("*").alias("hits"),
        F.min_by(F.struct(F.col("provider").alias("source"), "title", "snippet"), seq).alias("first"),
    ).select(*keys, "domain", "seed_url", "hits", "first.*")


def issued_queries(usable: DataFrame, target: int | Column, all_queries: DataFrame, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """(keys, last_query): the last query that is run. Before each, the search stops once the domains found reach the target.

    all_queries: (keys, query_idx). A target of 0 runs none, and then has no row.
    """
    goal = F.lit(target) if isinstance(target, int) else target
    first = usable.groupBy(*keys, "domain").agg(F.min("query_idx").alias("query_idx"))
    found = first.groupBy(*keys, "query_idx").agg(F.count("*").alias("found"))
    w = Window.partitionBy(*keys).orderBy("query_idx").rowsBetween(Window.unboundedPreceding, -1)
    run = all_queries.select(*keys, "query_idx").distinct().join(found, [*keys, "query_idx"], "left").withColumn("before", F.coalesce(F.sum(F.coalesce("found", F.lit(0))).over(w), F.lit(0)))
    return run.filter(F.col("before") < goal).groupBy(*keys).agg(F.max("query_idx").alias("last_query"))


def discover(hits: DataFrame, target: int, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """The target's number of domains per run, most hits first, names breaking ties, from the queries that are run."""
    usable = usable_hits(hits)
    cut = issued_queries(usable, target, hits, keys)
    kept = usable.join(cut, list(keys)).filter("query_idx <= last_query")
    return top_domains(collapse(kept, keys), target, keys)


def top_domains(domains: DataFrame, target: int, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    if not keys:
        return domains.orderBy(F.desc("hits"), "domain").limit(target)
    w = Window.partitionBy(*keys).orderBy(F.desc("hits"), "domain")
    return domains.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= target)


def totals(hits: DataFrame, errors: DataFrame | None = None, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """(keys, hits_seen, queries_run, errors) of the hits that were returned."""
    out = hits.groupBy(*keys).agg(F.count("*").alias("hits_seen"), F.count_distinct("query_idx").alias("queries_run"))
    if errors is None:
        return out
    told = errors.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("query_idx", "provider", "query", "message"))).alias("errors"))
    return out.join(told, list(keys), "left")


def union_hits(*by_provider: DataFrame) -> DataFrame:
    """Hits of all providers; ``provider_idx`` keeps their order of preference."""
    out = None
    for i, d in enumerate(by_provider):
        d = d.withColumn("provider_idx", F.lit(i))
        out = d if out is None else out.unionByName(d)
    return out
