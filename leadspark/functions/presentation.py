"""Labels, tones and small projections that readers see, native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadspark.constants import DOMAIN_TONES, RUN_STATES


def format_duration(start: Column, end: Column) -> Column:
    s = F.round((F.unix_micros(end) - F.unix_micros(start)) / 1e6).cast("long")
    m = F.floor(s / 60)
    text = F.when(s < 60, F.concat(s, F.lit("s"))).when(m < 60, F.concat(m, F.lit("m "), s % 60, F.lit("s"))).otherwise(F.concat(F.floor(m / 60), F.lit("h "), m % 60, F.lit("m")))
    return F.when(s >= 0, text).otherwise(F.lit("—"))


def format_date(t: Column) -> Column:
    return F.coalesce(F.date_format(t, "MMM d, hh:mm a"), F.lit("—"))


def percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.least(F.lit(100), F.floor(done * 100.0 / total + 0.5).cast("int"))).otherwise(0)


def _looked_up(c: Column, table: dict[str, str], default: Column) -> Column:
    out = default
    for k, v in table.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def run_label(status: Column) -> Column:
    return _looked_up(status, {k: v[0] for k, v in RUN_STATES.items()}, status)


def run_tone(status: Column) -> Column:
    return _looked_up(status, {k: v[1] for k, v in RUN_STATES.items()}, F.lit("idle"))


def domain_tone(status: Column) -> Column:
    return _looked_up(status, DOMAIN_TONES, F.lit("idle"))


def score_class(score: Column) -> Column:
    return F.when(score >= 70, "green").when(score >= 40, "ink").otherwise("muted")


def contact_of(emails: Column, phones: Column, form: Column) -> Column:
    return F.coalesce(F.get(emails, F.lit(0)), F.get(phones, F.lit(0)), form)


def website_of(website: Column, domain: Column) -> Column:
    return F.coalesce(website, F.concat(F.lit("https://"), domain))


def size_of(count: Column, given: Column) -> Column:
    return F.coalesce(count.cast("string"), given)


def dotted(*parts: Column) -> Column:
    """Parts that say something, with middle dots."""
    return F.array_join(F.filter(F.array(*(p.cast("string") for p in parts)), lambda x: x.isNotNull() & (x != "")), " · ")


def employee_facet(low: Column, high: Column) -> Column:
    shown = F.concat(F.coalesce(low.cast("string"), F.lit("any")), F.lit("–"), F.coalesce(high.cast("string"), F.lit("any")))
    return F.when((F.coalesce(low, F.lit(0)) != 0) | (F.coalesce(high, F.lit(0)) != 0), shown).otherwise("Any")
