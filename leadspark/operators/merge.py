"""Merging what pages and the model say of one company, with the source of each field.

Pages come in order; the first non-empty value of a field wins, pages before the model. Contacts never come from the model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspark.schemas import PROVENANCE

_PLATFORMS = ["linkedin", "twitter", "github", "facebook"]
_ENTRY = "struct<source_url:string,method:string,confidence:double>"


def _entry(url: Column, method: Column, confidence: float) -> Column:
    return F.struct(url.alias("source_url"), method.alias("method"), F.lit(confidence).alias("confidence"))


def ordered_union(a: Column, b: Column) -> Column:
    """a as it is, then what b adds, each once."""
    return F.concat(a, F.array_except(b, a))


def filled_map(a: Column, b: Column) -> Column:
    """a's entries, b's where a's value is null or empty; b's empty values add nothing."""
    return F.map_zip_with(a, F.map_filter(b, lambda k, v: v.isNotNull() & (v != "")), lambda k, x, y: F.coalesce(F.nullif(x, F.lit("")), y))


def left_biased(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, y))


def dedupe_people(people: Column) -> Column:
    """The first of each name, compared trimmed and lower-cased; nameless ones go."""
    keys = F.transform(people, lambda p: F.lower(F.trim(p["name"])))
    return F.filter(people, lambda p, i: (F.trim(p["name"]) != "") & (F.array_position(keys, F.lower(F.trim(p["name"]))) == i + 1))


def added_people(a: Column, b: Column) -> Column:
    names = F.transform(a, lambda p: F.lower(F.trim(p["name"])))
    new = F.filter(b, lambda p: ~F.coalesce(F.array_contains(names, F.lower(F.trim(p["name"]))), F.lit(False)))
    return F.concat(a, dedupe_people(new))


def lower_headers(headers: Column) -> Column:
    """Header names in lower case, several values with commas; headers: map<string, array<string>>."""
    pairs = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), F.array_join(e["value"], ", ").alias("value")))
    names = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    return F.map_from_entries(F.transform(names, lambda n: F.struct(n, F.element_at(F.filter(pairs, lambda p: p["key"] == n), -1)["value"])))


def merge_extraction(extracted: DataFrame, llm: DataFrame, domains: DataFrame) -> DataFrame:
    """extracted(domain_id, page_idx, source_url, facts...), llm(domain_id, company struct or null), domains(domain_id, domain, home_url)."""
    facts = [c for c in extracted.columns if c not in ("domain_id", "kind", "clean_text", "links")]
    pages = extracted.groupBy("domain_id").agg(F.array_sort(F.collect_list(F.struct("page_idx", *(c for c in facts if c != "page_idx" and c != "socials"), F.map_entries("socials").alias("socials")))).alias("pages"))
    d = domains.join(pages, "domain_id", "left").join(llm.select("domain_id", "company"), "domain_id", "left")
    p, home = F.coalesce(F.col("pages"), F.array().cast(pages.schema["pages"].dataType)), F.col("home_url")

    def first_page(field: str, empty: bool = True) -> Column:
        return F.get(F.filter(p, lambda x: x[field].isNotNull() & (x[field] != "") if empty else x[field].isNotNull()), F.lit(0))

    def said(field: str) -> Column:
        v = F.col(f"company.{field}")
        return F.nullif(v, F.lit("")) if field not in ("employee_count", "founded_year", "funding_year") else v

    values, sources = {}, []
    for field, method in (("company_name", "jsonld"), ("description", "meta"), ("country", "jsonld"), ("city", "jsonld"), ("address", "regex"), ("founded_year", "jsonld"), ("contact_form_url", "regex")):
        page = first_page(field, field != "founded_year")
        model = F.lit(None) if field == "contact_form_url" else said(field)
        values[field] = F.coalesce(page[field], model)
        entry = F.when(page.isNotNull(), _entry(page["source_url"], F.lit(method), 0.95))
        sources.append((F.lit(field), entry if field == "contact_form_url" else F.coalesce(entry, F.when(model.isNotNull(), _entry(home, F.lit("llm"), 0.7)))))
    for field in ("industry", "employee_count", "employee_range", "funding_stage", "funding_amount", "funding_year"):
        values[field] = said(field)
        sources.append((F.lit(field), F.when(said(field).isNotNull(), _entry(home, F.lit("llm"), 0.7))))
    contacts = {}

    def found(field: str) -> Column:
        return F.flatten(F.transform(p, lambda x: x[field]))

    def sourced(field: str, name: str, confidence: float) -> Column:
        def entry(v: Column) -> Column:
            e = F.get(F.filter(found(field), lambda x: x["value"] == v), F.lit(0))
            return F.struct(F.concat(F.lit(name + ":"), v).alias("key"), _entry(e["source_url"], e["method"], confidence).alias("value"))

        return F.transform(values[field], entry)

    for field, name, confidence in (("emails", "email", 0.98), ("phones", "phone", 0.9)):
        values[field] = F.array_distinct(F.transform(found(field), lambda e: e["value"]))
        contacts[name] = sourced(field, name, confidence)
    sources.append((F.lit("emails"), F.get(contacts["email"], F.lit(0))["value"]))
    social_values = []

    def social_page(name: str) -> tuple[Column, Column]:
        page = F.get(F.filter(p, lambda x: F.exists(x["socials"], lambda e: (e["key"] == name) & (e["value"] != ""))), F.lit(0))
        return page, F.get(F.filter(page["socials"], lambda e: e["key"] == name), F.lit(0))["value"]

    for name in _PLATFORMS:
        page, on_page = social_page(name)
        model = F.nullif(F.try_element_at(F.col("company.socials"), F.lit(name)), F.lit(""))
        social_values += [F.lit(name), F.coalesce(on_page, model)]
        sources.append((F.lit(f"social:{name}"), F.when(on_page.isNotNull(), _entry(page["source_url"], F.lit("regex"), 0.95)).when(model.isNotNull(), _entry(home, F.lit("llm"), 0.7))))
    entries = F.filter(F.array(*(F.struct(k.alias("key"), v.cast(_ENTRY).alias("value")) for k, v in sources)), lambda e: e["value"].isNotNull())
    d = d.withColumn("_emails", contacts["email"]).withColumn("_phones", contacts["phone"])
    provenance = F.map_from_entries(F.concat(entries, F.col("_emails").cast(f"array<struct<key:string,value:{_ENTRY}>>"), F.col("_phones").cast(f"array<struct<key:string,value:{_ENTRY}>>")))
    return d.select(
        "domain_id", "domain", *(v.alias(k) for k, v in values.items()), F.create_map(*social_values).alias("socials"),
        F.coalesce(dedupe_people(F.col("company.people")), F.expr("cast(array() as array<struct<name:string,role:string,email:string,linkedin:string>>)")).alias("people"),
        F.coalesce("company.technologies", F.expr("cast(array() as array<string>)")).alias("technologies"),
        F.coalesce("company.matches_requirements", F.lit(False)).alias("matches_requirements"),
        F.coalesce("company.match_reason", F.lit("no LLM extraction available for this domain")).alias("match_reason"),
        F.coalesce("company.confidence", F.lit(0.0)).alias("llm_confidence"),
        provenance.cast(PROVENANCE).alias("provenance"),
        F.exists(p, lambda x: x["form_only_contact"]).alias("any_form_only"),
    )


def outcome_of(emails: Column, phones: Column, any_form_only: Column) -> Column:
    """What a scraped domain came to, by the contacts found before validation."""
    return F.when((F.size(emails) > 0) | (F.size(phones) > 0), "ok").when(F.coalesce(any_form_only, F.lit(False)), "form_only").otherwise("no_contact")


def outcome_of_fetch(fetch: Column) -> Column:
    return F.when(fetch.isin("blocked", "robots_disallowed"), fetch).otherwise("unreachable")


def domain_status(cancelled: Column, outcome: Column) -> Column:
    return F.when(cancelled, "skipped").when(outcome.isin("unreachable", "blocked"), "failed").otherwise("done")
