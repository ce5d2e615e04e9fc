"""What readers ask for: lists, filters, ranks and the projections of lead, run and plan pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspark.constants import RUN_ACTIVE
from leadspark.functions import presentation as P
from leadspark.functions import text as T


def get_run(runs: DataFrame, run_id: str) -> DataFrame:
    return runs.filter(F.col("id") == run_id)


def list_runs(runs: DataFrame, limit: int = 50) -> DataFrame:
    return runs.orderBy(F.desc("created_at")).limit(limit)


def list_domains(domains: DataFrame, run_id: str) -> DataFrame:
    return domains.filter(F.col("run_id") == run_id).orderBy(F.asc_nulls_last("created_at"))


def list_leads(leads: DataFrame, run_id: str) -> DataFrame:
    return leads.filter(F.col("run_id") == run_id).orderBy(F.desc("score"), F.asc_nulls_last("company_name"))


def list_shippable_leads(leads: DataFrame, run_id: str) -> DataFrame:
    return list_leads(leads.filter("merged_into is null"), run_id)


def list_events(events: DataFrame, run_id: str, limit: int = 200) -> DataFrame:
    return events.filter(F.col("run_id") == run_id).orderBy(F.desc("id")).limit(limit)


def default_run(runs: DataFrame, wanted: str | None = None) -> DataFrame:
    """The wanted run, else the newest completed of the 50 newest, else the newest."""
    recent = list_runs(runs)
    return recent.filter(F.col("id") == wanted) if wanted else recent.orderBy(F.desc(F.col("status") == "completed"), F.desc("created_at")).limit(1)


def matches(needle: str) -> Column:
    """Does a lead hold the words in one of the searched fields?"""
    n = needle.strip().lower()
    if not n:
        return F.lit(True)
    fields = F.concat(F.array("company_name", "domain", "industry", "city", "country", "description"), F.col("emails"), F.col("technologies"))
    return F.exists(fields, lambda x: F.coalesce(F.contains(F.lower(x), F.lit(n)), F.lit(False)))


def filter_leads(leads: DataFrame, query: str = "", least: float | None = None) -> DataFrame:
    """A least score counts only if it is finite and above 0."""
    use = least is not None and least == least and abs(least) != float("inf") and least > 0
    return leads.filter(matches(query) & (F.col("score") >= least if use else F.lit(True)))


def rank_leads(leads: DataFrame, key: str, descending: bool | None = None) -> DataFrame:
    """Sorted by a column, nulls last either way; numbers begin descending, texts ascending and by the Unicode collation."""
    kind = leads.schema[key].dataType.simpleString()
    textual = kind.startswith("string")
    down = (not textual) if descending is None else descending
    c = F.collate(F.col(key), "UNICODE") if textual else F.col(key)
    return leads.orderBy(c.desc_nulls_last() if down else c.asc_nulls_last())


def lead_lines(leads: DataFrame) -> DataFrame:
    c = F.col
    return leads.select(
        "id", F.coalesce("company_name", "domain").alias("name"), P.website_of(c("website"), c("domain")).alias("link"),
        P.contact_of(c("emails"), c("phones"), c("contact_form_url")).alias("contact"), P.size_of(c("employee_count"), c("employee_range")).alias("size"),
        F.array_join(T.without_blanks(F.array("city", "country")), ", ").alias("location"), P.dotted(c("funding_stage"), c("funding_amount"), c("funding_year")).alias("funding"),
        "score", P.score_class(c("score")).alias("score_class"),
    )


def breakdown_lines(leads: DataFrame) -> DataFrame:
    parts = ["industry", "geography", "size", "funding", "contactability", "evidence", "penalties", "total"]
    pairs = F.array(*(F.struct(F.lit(p).alias("term"), F.col(f"score_breakdown.{p}").alias("points")) for p in parts))
    return leads.select("id", F.explode(pairs).alias("p")).select("id", "p.term", F.format_number("p.points", 2).alias("points"))


def provenance_lines(leads: DataFrame) -> DataFrame:
    return leads.select("id", F.explode("provenance").alias("field", "entry")).select("id", "field", "entry.source_url", "entry.method", F.format_number("entry.confidence", 2).alias("confidence"))


def run_lines(runs: DataFrame) -> DataFrame:
    c = F.col
    return runs.select(
        "id", P.run_label(c("status")).alias("label"), P.run_tone(c("status")).alias("tone"), c("status").isin(RUN_ACTIVE).alias("active"),
        P.percent(c("domains_done") + c("domains_failed"), c("domains_total")).alias("progress"), (c("tier1_pages") + c("tier2_pages")).alias("browser_pages"),
        P.format_duration(c("approved_at"), c("finished_at")).alias("took"),
    )


def plan_facets(runs: DataFrame) -> DataFrame:
    r = "plan.requirements."
    shown = lambda x: F.coalesce(T.non_empty(x), F.lit("Any"))
    return runs.select(
        "id", shown(F.col(r + "industry")).alias("industry"), shown(F.array_join(F.col(r + "countries"), ", ")).alias("countries"),
        P.employee_facet(F.col(r + "employee_min"), F.col(r + "employee_max")).alias("employees"), shown(F.col(r + "funding_since_year").cast("string")).alias("funded_since"),
        F.size("plan.search_queries").alias("queries"), F.col("plan.target_domains").alias("target_domains"),
    )


def run_page(runs: DataFrame, domains: DataFrame, leads: DataFrame, events: DataFrame, run_id: str) -> dict[str, DataFrame]:
    return {"run": get_run(runs, run_id), "domains": list_domains(domains, run_id), "leads": list_shippable_leads(leads, run_id), "events": list_events(events, run_id)}
