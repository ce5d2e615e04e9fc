"""From discovered domains to scored leads: fetch, extract, choose pages, pack, ask the model, merge, validate, score.

Each step is a DataFrame step over all domains at once; the fetcher and the model are handed in. Cancelled runs are left
out before each costly step, the model call last of all.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadspark.components import stored
from leadspark.config import EngineConfig
from leadspark.functions import html
from leadspark.operators import merge, pages, runs, score, validate
from leadspark.sources import llm

#: requests(url, domain, kind, page_idx) -> pages as ``sources.fetch.fetch_pages`` gives them.
Fetcher = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Enriched:
    """Written tables of one pass: fetched pages, leads, and what each domain came to."""

    pages: DataFrame
    leads: DataFrame
    outcomes: DataFrame


def live(domains: DataFrame, cancelled: DataFrame | None) -> DataFrame:
    return domains if cancelled is None else domains.join(cancelled.select("run_id"), "run_id", "left_anti")


def facts_of(fetched: DataFrame, config: EngineConfig) -> DataFrame:
    """Extracted facts of pages that were got; each different body and address is parsed once."""
    got = fetched.filter("outcome = 'ok' and html is not null").select("domain_id", "page_idx", "kind", "final_url", "html")
    distinct = got.select("html", "final_url", "kind").dropDuplicates(["html", "final_url", "kind"])
    parsed = distinct.withColumn("f", html.extract_udf(config.current_year, config.allow_personal_emails)("html", "final_url", "kind"))
    rows = got.join(parsed, ["html", "final_url", "kind"])
    return rows.select("domain_id", "page_idx", F.col("final_url").alias("source_url"), "kind", "f.*")


def process_domains(domains: DataFrame, requirements: DataFrame, fetch: Fetcher, client: llm.Client, config: EngineConfig, cancelled: DataFrame | None = None) -> Enriched:
    """domains(run_id, domain_id, domain, seed_url), requirements(run_id, requirements)."""
    names = domains.select("domain_id", "domain", "run_id", "seed_url")
    keys = names.select("domain_id", "domain")

    def visit(requests: DataFrame) -> DataFrame:
        return stored(fetch(requests.select("url", "domain", "kind", "page_idx")).join(keys, "domain"))

    home = visit(live(names, cancelled).select(F.col("seed_url").alias("url"), "domain", F.lit("home").alias("kind"), F.lit(0).alias("page_idx")))
    home_facts = stored(facts_of(home, config))
    links = home_facts.select("domain_id", F.posexplode("links").alias("pos", "link")).select("domain_id", "pos", "link.*")
    chosen = pages.select_pages(links, config.max_pages_per_domain - 1).join(live(names, cancelled).select("domain_id", "domain"), "domain_id")
    more = visit(chosen.select("url", "domain", "kind", F.col("rank").alias("page_idx")))
    fetched = home.unionByName(more)
    facts = home_facts.unionByName(stored(facts_of(more, config)))
    reached = home.filter("outcome = 'ok'").select("domain_id", F.col("final_url").alias("home_url"))
    texts = pages.pack(facts.select("domain_id", F.col("page_idx").alias("pos"), F.col("source_url").alias("url"), "kind", F.col("clean_text").alias("text")))
    first_name = facts.filter("company_name is not null").groupBy("domain_id").agg(F.min_by("company_name", "page_idx").alias("name"))
    asked = reached.join(live(names, cancelled), "domain_id").join(texts, "domain_id", "left").join(first_name, "domain_id", "left").join(requirements, "run_id").withColumn("text", F.coalesce("text", F.lit("")))
    said = stored(llm.extract_with_llm(asked.select("domain_id", "domain", "name", "text", "requirements"), client))
    merged = merge.merge_extraction(facts, said, asked.select("domain_id", "domain", "home_url"))
    judged = merged.withColumn("outcome", merge.outcome_of(F.col("emails"), F.col("phones"), F.col("any_form_only"))).drop("any_form_only")
    checked = stored(validate.validate(judged, config.current_year).join(names.select("domain_id", "run_id", "seed_url"), "domain_id").join(requirements, "run_id"))
    scored = score.score(checked)
    leads = runs.lead_rows(scored.drop("requirements", "matches_requirements", "llm_confidence", "outcome"))
    gone = live(names, cancelled).select("domain_id", F.lit(False).alias("gone"))
    rollup = pages.rollup(fetched)
    outcomes = names.select("run_id", "domain_id").join(gone, "domain_id", "left").join(home.select("domain_id", F.col("outcome").alias("fetch")), "domain_id", "left").join(checked.select("domain_id", "outcome"), "domain_id", "left").join(rollup, "domain_id", "left").join(said.select("domain_id", "input_tokens", "output_tokens", "cached_tokens"), "domain_id", "left")
    was_cancelled = F.col("gone").isNull()
    outcome = F.coalesce("outcome", merge.outcome_of_fetch(F.col("fetch")))
    outcomes = outcomes.select(
        "run_id", "domain_id", was_cancelled.alias("cancelled"), outcome.alias("outcome"), merge.domain_status(was_cancelled, outcome).alias("outcome_status"), "pages", "max_tier", "tier1_pages", "tier2_pages",
        F.col("input_tokens").alias("llm_input_tokens"), F.col("output_tokens").alias("llm_output_tokens"), F.col("cached_tokens").alias("llm_cached_tokens"),
    )
    return Enriched(runs.page_rows(fetched), leads, outcomes)


def expired(table: DataFrame, ended: str, now: F.Column, keep_seconds: int, most: int | None = None) -> DataFrame:
    """Rows past retention: older than the time, or beyond the number of newest ones to keep."""
    old = table.filter(F.col(ended) < now - F.make_dt_interval(secs=F.lit(keep_seconds)))
    if most is None:
        return old
    newest = table.orderBy(F.desc(ended)).limit(most)
    return old.unionByName(table.exceptAll(newest)).distinct()
