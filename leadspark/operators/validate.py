"""Validation: bad values are dropped, never repaired, and each drop is told in ``issues``, in the order of the fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspark.functions import contacts, text, urls


def _issue(field: Column, value: Column, reason: Column) -> Column:
    return F.struct(field.alias("field"), value.cast("string").alias("value"), reason.alias("reason"))


def _if(bad: Column, field: str, value: Column, reason: str) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), F.array(_issue(F.lit(field), value, F.lit(reason)))).otherwise(F.expr("cast(array() as array<struct<field:string,value:string,reason:string>>)"))


def validate(leads: DataFrame, current_year: int, most_employees: int = 500_000, earliest: int = 1800) -> DataFrame:
    c = F.col
    bad_count = ~c("employee_count").between(1, most_employees)
    bad_founded = ~c("founded_year").between(earliest, current_year)
    founded = F.when(bad_founded, None).otherwise(c("founded_year"))
    bad_funding = (c("funding_year") > current_year) | F.coalesce(c("funding_year") < founded, F.lit(False))
    bad_social = F.map_filter("socials", lambda k, v: (v != "") & ~urls.is_plausible_social(k, v))
    social_issues = F.transform(F.map_entries(bad_social), lambda e: _issue(F.concat(F.lit("socials."), e["key"]), e["value"], F.lit("url does not point at the platform's own host")))
    email_issues = F.filter(F.transform("emails", lambda e: _issue(F.lit("emails"), e, contacts.email_problem(e, c("domain")))), lambda i: i["reason"].isNotNull())
    phone_issues = F.transform(F.filter("phones", lambda p: contacts.phone_e164(p).isNull()), lambda p: _issue(F.lit("phones"), p, F.lit("not a dialable international number")))
    people_issues = F.transform(F.filter("people", lambda p: ~contacts.is_plausible_person_name(p["name"])), lambda p: _issue(F.lit("people"), p["name"], F.lit("does not look like a person's name")))
    issues = F.concat(
        email_issues, phone_issues, social_issues,
        _if(bad_count, "employee_count", c("employee_count"), "outside plausible range for a company"),
        _if(bad_founded, "founded_year", c("founded_year"), "not a plausible founding year"),
        _if(bad_funding, "funding_year", c("funding_year"), "outside company lifetime"),
        people_issues,
    )
    new = {
        "emails": F.filter("emails", lambda e: contacts.email_problem(e, c("domain")).isNull()),
        "phones": F.filter(F.transform("phones", contacts.phone_e164), lambda p: p.isNotNull()),
        "socials": F.transform_values("socials", lambda k, v: F.when(F.coalesce((v != "") & ~urls.is_plausible_social(k, v), F.lit(False)), None).otherwise(v)),
        "employee_count": F.when(bad_count, None).otherwise(c("employee_count")),
        "founded_year": founded,
        "funding_year": F.when(bad_funding, None).otherwise(c("funding_year")),
        "people": F.filter("people", lambda p: contacts.is_plausible_person_name(p["name"])),
        "company_name": text.clean_company_name(c("company_name")),
        "description": text.trim_to(c("description"), 600),
        "issues": issues,
    }
    return leads.select(*(c(k) for k in leads.columns if k not in new), *(v.alias(k) for k, v in new.items()))
