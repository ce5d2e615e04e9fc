"""Run, domain, page and lead tables: keyed writes and folds over status events, and the run's state machine.

Tables change by whole new versions of a keyed DataFrame, so a change of many rows is one write. Folds go by an explicit
sequence column and never by row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadspark.constants import DOMAIN_TERMINAL, RUN_TERMINAL

_COUNTERS = ["domains_done", "domains_failed", "pages_fetched", "tier1_pages", "tier2_pages", "llm_input_tokens", "llm_output_tokens", "llm_cached_tokens"]
#: Lead columns that a second write of the same domain replaces; all others keep their first value.
UPSERTED = ["company_name", "description", "emails", "phones", "socials", "people", "provenance", "score", "score_breakdown", "match_reason"]
#: Moves between run states.
MOVES = {
    "planning": {"awaiting_approval", "failed", "cancelled"},
    "awaiting_approval": {"discovering", "cancelled", "failed"},
    "discovering": {"scraping", "failed", "cancelled", "completed"},
    "scraping": {"completed", "failed", "cancelled"},
    "completed": set(),
    "failed": set(),
    "cancelled": set(),
}


def row_id(*parts: Column) -> Column:
    """A key made from what a row is about, so that a retried task makes the same one."""
    return F.sha2(F.concat_ws("|", *parts).cast("binary"), 256)


def _latest(value: str, seq: str = "seq") -> Column:
    return F.max_by(F.when(F.col(value).isNotNull(), F.col(value)), F.when(F.col(value).isNotNull(), F.col(seq)))


def fold_run_status(events: DataFrame) -> DataFrame:
    """events(run_id, seq, ts, status, error) to each run's state: the last status and error, first approval, last end."""
    return events.groupBy("run_id").agg(
        F.max_by("status", "seq").alias("status"),
        _latest("error").alias("error"),
        F.min(F.when(F.col("status") == "discovering", F.col("ts"))).alias("approved_at"),
        F.max(F.when(F.col("status").isin(RUN_TERMINAL), F.col("ts"))).alias("finished_at"),
    )


def fold_domain_status(events: DataFrame) -> DataFrame:
    """events(domain_id, seq, ts, status, outcome, note, pages, max_tier): what is null in an event keeps the value before."""
    return events.groupBy("domain_id").agg(
        F.max_by("status", "seq").alias("status"),
        *(_latest(c).alias(c) for c in ("outcome", "note", "pages")),
        F.coalesce(F.max("max_tier"), F.lit(0)).alias("max_tier"),
        F.min(F.when(F.col("status") == "fetching", F.col("ts"))).alias("started_at"),
        F.max(F.when(F.col("status").isin(DOMAIN_TERMINAL), F.col("ts"))).alias("finished_at"),
    )


def insert_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Only the rows whose key is in neither the table nor an earlier new row (by ``seq`` if there is one)."""
    order = "seq" if "seq" in new.columns else keys[0]
    first = new.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("_n = 1").drop("_n")
    return first.join(old.select(*keys), keys, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], replaced: list[str] = UPSERTED) -> DataFrame:
    """New keys are added; rows of known ones take the replaced columns from the new row and keep the rest."""
    other = [c for c in old.columns if c not in keys]
    both = old.withColumn("_o", F.lit(True)).alias("o").join(new.withColumn("_n", F.lit(True)).alias("n"), keys, "full_outer")
    picked = [
        (F.when(F.col("n._n"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if c in replaced else F.when(F.col("o._o"), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))).alias(c) if c in new.columns else F.col(f"o.{c}").alias(c)
        for c in other
    ]
    return both.select(*keys, *picked).select(old.columns)


def updated(table: DataFrame, where: Column, **values: Column) -> DataFrame:
    return table.select(*(F.when(where, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns))


def skip_queued(domains: DataFrame, run_id: str) -> DataFrame:
    return updated(domains, (F.col("run_id") == run_id) & (F.col("status") == "queued"), status=F.lit("skipped"))


def page_rows(fetches: DataFrame) -> DataFrame:
    """Fetch records as page rows; a page is blocked if it took the last tier or has an error."""
    return fetches.withColumn("blocked", (F.col("tier") == 2) | F.col("error").isNotNull())


def run_counters(finished: DataFrame) -> DataFrame:
    """finished(run_id, outcome_status, cancelled, pages, tier1_pages, tier2_pages, token counts) summed by run.

    A cancelled domain adds pages and tokens, but is neither done nor failed.
    """
    live = ~F.coalesce("cancelled", F.lit(False))
    status = F.col("outcome_status")
    return finished.groupBy("run_id").agg(
        F.count_if(live & (status == "done")).alias("domains_done"),
        F.count_if(live & (status == "failed")).alias("domains_failed"),
        F.sum(F.coalesce("pages", F.lit(0))).alias("pages_fetched"),
        *(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in _COUNTERS[3:]),
    )


def flush_counters(runs: DataFrame, counters: DataFrame) -> DataFrame:
    """Runs with the given counters in place of their own; runs without stay."""
    c = counters.select(F.col("run_id").alias("id"), *(F.col(x).alias(f"_{x}") for x in _COUNTERS))
    d = runs.join(c, "id", "left")
    return d.select(*(F.coalesce(f"_{x}", x).cast(runs.schema[x].dataType).alias(x) if x in _COUNTERS else F.col(x) for x in runs.columns))


def finished_runs(domains: DataFrame) -> DataFrame:
    """Runs all of whose domains, at least one, have come to an end."""
    return domains.groupBy("run_id").agg(F.bool_and(F.col("status").isin(DOMAIN_TERMINAL)).alias("over"), F.count("*").alias("n")).filter("over and n > 0").select("run_id")


def log_event(run_id: Column, stage: Column, message: Column, level: str = "info", data: Column | None = None) -> list[Column]:
    text = F.lit(None).cast("string") if data is None else F.when(~F.coalesce(data.cast("string"), F.lit("")).isin("", "0", "false"), data.cast("string"))
    return [run_id.alias("run_id"), F.lit(level).alias("level"), stage.alias("stage"), message.alias("message"), text.alias("data"), F.current_timestamp().alias("created_at")]


def lead_rows(scored: DataFrame) -> DataFrame:
    """Scored records as rows of the lead table; the website is the address that the crawl began at."""
    return scored.select(row_id(F.col("run_id"), F.col("domain")).alias("id"), "run_id", "domain_id", "domain", F.col("seed_url").alias("website"), *(c for c in scored.columns if c not in ("run_id", "domain_id", "domain", "seed_url", "id")))


def start_run(domains: DataFrame, found: DataFrame, run_id: str) -> tuple[DataFrame, DataFrame]:
    """(table with the newly found domains, the new rows); their number is the run's total, they are what is queued."""
    rows = found.select(row_id(F.lit(run_id), F.col("domain")).alias("id"), F.lit(run_id).alias("run_id"), "domain", "seed_url", "source", F.lit("queued").alias("status"))
    new = insert_new(domains, rows, ["run_id", "domain"])
    return domains.unionByName(new, allowMissingColumns=True), new


def may_move(before: str, after: str) -> bool:
    return after in MOVES.get(before, set())


def next_status(status: Column, event: Column) -> Column:
    """The state after an event: planned, plan_failed, approved, found, found_nothing, all_done, cancel; others change nothing."""
    return (
        F.when((status == "planning") & (event == "planned"), "awaiting_approval")
        .when((status == "planning") & (event == "plan_failed"), "failed")
        .when((status == "awaiting_approval") & (event == "approved"), "discovering")
        .when((status == "discovering") & (event == "found"), "scraping")
        .when((status == "discovering") & (event == "found_nothing"), "failed")
        .when(status.isin("scraping", "discovering") & (event == "all_done"), "completed")
        .when(~status.isin(RUN_TERMINAL) & (event == "cancel"), "cancelled")
        .otherwise(status)
    )
