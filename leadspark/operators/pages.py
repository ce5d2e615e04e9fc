"""Which pages of a domain are fetched, what is packed for the model, and what a domain's pages add up to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadspark.constants import DOMAIN_TOKENS, PACK_ORDER, PAGE_TOKENS
from leadspark.functions import text as T


def select_pages(links: DataFrame, budget: int, key: str = "domain_id") -> DataFrame:
    """links(key, pos, url, kind, priority): the best of each kind, then the best within the budget; urls are unique in a domain."""
    best = Window.partitionBy(key, "kind").orderBy(F.desc("priority"), "pos")
    rank = Window.partitionBy(key).orderBy(F.desc("priority"), "pos")
    one = links.filter("kind <> 'other'").withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")
    return one.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= budget)


def ranked_pages(pages: DataFrame, key: str = "domain_id") -> DataFrame:
    """Pages with text, their packed form, its cost and the running cost in packing order."""
    order = F.array_position(F.lit(PACK_ORDER), F.col("kind"))
    body = T.clamp_to_tokens(T.collapse(F.col("text")), PAGE_TOKENS)
    d = pages.filter(T.strip(F.col("text")) != "").withColumn("chunk", F.concat(F.lit("\n=== "), F.upper("kind"), F.lit(" — "), F.col("url"), F.lit(" ===\n"), body))
    d = d.withColumn("cost", T.estimate_tokens(F.col("chunk"))).withColumn("order", order)
    w = Window.partitionBy(key).orderBy("order", "pos")
    return d.withColumn("rank", F.row_number().over(w)).withColumn("used", F.sum("cost").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def pack(pages: DataFrame, budget: int = DOMAIN_TOKENS, key: str = "domain_id") -> DataFrame:
    """pages(key, pos, url, kind, text) to one text a domain. Costs are positive, so the pages that fit are a prefix; the first always stays."""
    d = ranked_pages(pages, key).withColumn("fits", (F.col("rank") == 1) | (F.col("used") <= budget))
    chunks = F.array_sort(F.collect_list(F.when(F.col("fits"), F.struct("rank", "chunk"))))
    return d.groupBy(key).agg(
        T.strip(F.array_join(F.transform(chunks, lambda c: c["chunk"]), "\n")).alias("text"),
        F.count_if("fits").alias("pages_included"),
        F.count_if(~F.col("fits")).alias("pages_dropped"),
        F.sum(F.when(F.col("fits"), F.col("cost"))).alias("estimated_tokens"),
    )


def rollup(pages: DataFrame, key: str = "domain_id") -> DataFrame:
    return pages.groupBy(key).agg(F.count("*").alias("pages"), F.max("tier").alias("max_tier"), F.count_if(F.col("tier") == 1).alias("tier1_pages"), F.count_if(F.col("tier") == 2).alias("tier2_pages"))
