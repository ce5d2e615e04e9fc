"""Scoring a lead against requirements: six weighted terms and penalties, as one projection.

A requirement that nothing is known about earns partial credit, between a match and a mismatch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspark.constants import UNKNOWN, WEIGHTS
from leadspark.functions import text as T


def _c(name: str) -> Column:
    return F.col(name)


def industry_term(req: str = "requirements") -> Column:
    wanted, keywords = _c(f"{req}.industry"), _c(f"{req}.keywords")
    wants = F.coalesce(T.strip(wanted) != "", F.lit(False))
    about = T.joined(_c("industry"), _c("description"), _c("technologies"))
    haystack = F.lower(T.joined(_c("company_name"), _c("description"), _c("industry"), _c("technologies")))
    fit = F.greatest(F.when(wants, T.token_overlap(wanted, about)).otherwise(0.0), F.when(F.size(keywords) > 0, T.keyword_hits(haystack, keywords) / F.size(keywords)).otherwise(0.0))
    return (
        F.when(~wants & (F.size(keywords) == 0), 1.0)
        .when(_c("matches_requirements"), F.when(_c("llm_confidence") >= 0.6, 1.0).otherwise(0.8))
        .when(fit > 0, T.clamp(F.lit(0.45) + fit * F.lit(0.45), 0, 0.9))
        .when(_c("industry").isNull() & _c("description").isNull(), UNKNOWN)
        .otherwise(0.0)
    )


def geography_term(req: str = "requirements") -> Column:
    countries, cities = _c(f"{req}.countries"), _c(f"{req}.cities")
    wants_country, wants_city = F.size(countries) > 0, F.size(cities) > 0
    return (
        F.when(~wants_country & ~wants_city, 1.0)
        .when(wants_city & T.matches_any(_c("city"), cities), 1.0)
        .when(wants_country & T.matches_country(_c("country"), countries), F.when(wants_city, 0.75).otherwise(1.0))
        .when(T.matches_any(_c("address"), F.concat(countries, cities)), 0.85)
        .when(_c("country").isNull() & _c("city").isNull() & _c("address").isNull(), UNKNOWN)
        .otherwise(0.0)
    )


def size_term(req: str = "requirements") -> Column:
    low, high = _c(f"{req}.employee_min"), _c(f"{req}.employee_max")
    bounds = T.employee_bounds(_c("employee_count"), _c("employee_range"))
    below = F.coalesce(bounds["high"] < low, F.lit(False))
    above = F.coalesce(bounds["low"] > high, F.lit(False))
    target, actual = F.when(below, low).otherwise(high).cast("double"), F.when(below, bounds["high"]).otherwise(bounds["low"])
    ratio = F.when(target == 0, 0.0).otherwise(F.try_divide(F.least(target, actual), F.greatest(target, actual)))
    return F.when(low.isNull() & high.isNull(), 1.0).when(bounds.isNull(), UNKNOWN).when(~below & ~above, 1.0).otherwise(T.clamp(ratio - F.lit(0.3), 0, 0.5))


def funding_term(req: str = "requirements") -> Column:
    since, year = _c(f"{req}.funding_since_year"), _c("funding_year")
    signal = _c("funding_stage").isNotNull() | _c("funding_amount").isNotNull() | year.isNotNull()
    return (
        F.when(~F.coalesce(_c(f"{req}.funding_required"), F.lit(False)), 1.0)
        .when(~signal, UNKNOWN)
        .when(since.isNull(), 1.0)
        .when(year.isNull(), 0.6)
        .when(year >= since, 1.0)
        .otherwise(T.clamp(F.lit(0.5) - (since - year) * F.lit(0.15), 0, 0.5))
    )


def contactability_term() -> Column:
    mail = F.size("emails") > 0
    form = F.when(_c("contact_form_url").isNull(), 0.0).when(mail, 0.05).otherwise(0.25)
    linkedin = F.coalesce(F.try_element_at("socials", F.lit("linkedin")) != "", F.lit(False))
    return T.clamp(F.when(mail, 0.6).otherwise(0.0) + F.when(F.size("phones") > 0, 0.2).otherwise(0.0) + form + F.when(linkedin, 0.15).otherwise(0.0), 0, 1)


def evidence_term() -> Column:
    entries = F.map_values("provenance")
    n = F.size(entries)
    sure = F.size(F.filter(entries, lambda e: ~e["method"].isin("llm", "search")))
    return F.when(n <= 0, 0.0).otherwise(T.clamp(F.lit(0.55) * (sure / n) + F.lit(0.3) * T.clamp(n / F.lit(12.0), 0, 1) + F.lit(0.15) * _c("llm_confidence"), 0, 1))


def penalties(req: str = "requirements") -> Column:
    haystack = F.lower(T.joined(_c("company_name"), _c("description"), _c("industry"), _c("technologies")))
    hits = T.keyword_hits(haystack, _c(f"{req}.exclusions"))
    excluded = F.when(hits > 0, F.least(F.lit(45), 25 + (hits - 1) * 10)).otherwise(0)
    early = F.when(_c("founded_year") < _c(f"{req}.founded_after"), 12).otherwise(0)
    shaky = F.when(F.size("issues") > 2, F.least(F.lit(6), F.size("issues"))).otherwise(0)
    return -(excluded + early + shaky + F.when(_c("company_name").isNull(), 5).otherwise(0)).cast("double")


def score(leads: DataFrame, req: str = "requirements") -> DataFrame:
    """Validated leads with a ``requirements`` struct; adds ``score`` and ``score_breakdown``."""
    terms = {"industry": industry_term(req), "geography": geography_term(req), "size": size_term(req), "funding": funding_term(req), "contactability": contactability_term(), "evidence": evidence_term()}
    d = leads.withColumns({f"_{k}": F.lit(WEIGHTS[k]) * v for k, v in terms.items()} | {"_penalties": penalties(req)})
    parts = [*terms, "penalties"]
    total = F.col("_industry")
    for k in parts[1:]:
        total = total + F.col(f"_{k}")
    d = d.withColumn("score", T.round2(T.clamp(total, 0, 100)))
    return d.withColumn("score_breakdown", F.struct(*(T.round2(F.col(f"_{k}")).alias(k) for k in parts), F.col("score").alias("total"))).drop(*(f"_{k}" for k in parts))


def score_for_runs(leads: DataFrame, runs: DataFrame) -> DataFrame:
    """Leads joined with their run's requirements (runs: run_id, requirements), then scored."""
    return score(leads.join(runs.select("run_id", "requirements"), "run_id"))
