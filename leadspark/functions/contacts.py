"""E-mail, phone, name and address expressions, native."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from leadspark.constants import ADDRESS_LINE, EMAIL_JUNK, EMAIL_PLACEHOLDER, EMAIL_SCAN, EMAIL_SHAPE, FOUNDED, HEADING_WORDS, LEGAL_FORMS, NAME_PARTICLES, NON_COMPANY_DOMAINS, PHONE_SCAN, ROLE_LOCAL_PARTS

from .text import EDGE, collapse, strip
from .urls import registrable_domain


def decode_cf_email(hexed: Column) -> Column:
    """The address hidden as hex bytes, each xor-ed with the first; null if it is none."""
    key = F.conv(F.substring(hexed, 1, 2), 16, 10).try_cast("int")
    places = F.when(F.length(hexed) >= 4, F.sequence(F.lit(3), F.length(hexed) - 1, F.lit(2)))
    out = F.array_join(F.transform(places, lambda i: F.char(F.conv(F.substring(hexed, i, F.lit(2)), 16, 10).try_cast("int").bitwiseXOR(key))), "")
    good = hexed.rlike("^[0-9a-fA-F]+$") & (F.length(hexed) % 2 == 0)
    return F.when(good & out.rlike(EMAIL_SHAPE), out)


def is_role_email(email: Column) -> Column:
    local = F.lower(F.substring_index(email, "@", 1))
    return local.isin(ROLE_LOCAL_PARTS) | F.regexp_extract(local, r"^([^+._-]*)", 1).isin(ROLE_LOCAL_PARTS)


def normalize_email(raw: Column) -> Column:
    return F.substring_index(F.regexp_replace(F.lower(strip(raw)), "^mailto:", ""), "?", 1)


def is_usable_email(email: Column, allow_personal: bool = False) -> Column:
    """May a found address be kept? Shape, no file or placeholder, no free mail, and a role unless persons are allowed."""
    ok = email.rlike(EMAIL_SHAPE) & ~email.rlike(EMAIL_JUNK) & ~email.rlike(EMAIL_PLACEHOLDER) & ~F.substring_index(F.substring_index(email, "@", 2), "@", -1).isin(NON_COMPANY_DOMAINS)
    return F.coalesce(ok if allow_personal else ok & is_role_email(email), F.lit(False))


def scan_emails(text: Column, allow_personal: bool = False) -> Column:
    """Usable addresses of a text, in order, each once."""
    found = F.transform(F.regexp_extract_all(text, F.lit(EMAIL_SCAN), F.lit(0)), normalize_email)
    return F.array_distinct(F.filter(found, lambda e: is_usable_email(e, allow_personal)))


def normalize_phone(raw: Column) -> Column:
    """A number as it is written, white space collapsed; null if it has under 7 or over 15 digits or is a year."""
    t = strip(raw)
    digits, marked = F.regexp_replace(t, r"[^0-9]", ""), F.regexp_replace(t, r"[^0-9+]", "")
    return F.when(F.length(digits).between(7, 15) & ~marked.rlike(r"^\+?(19|20)[0-9]{2}$"), F.substring(collapse(t), 1, 32))


def scan_phones(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(PHONE_SCAN), F.lit(0)), normalize_phone)
    return F.array_distinct(F.filter(found, lambda p: p.isNotNull()))


def phone_e164(raw: Column) -> Column:
    """``+digits`` of an international number; null for all else."""
    t = F.regexp_replace(strip(raw), r"\(\s*0\s*\)", "")
    digits = F.regexp_replace(F.regexp_replace(t, "^00", ""), "[^0-9]", "")
    ok = (t.startswith("+") | t.startswith("00")) & F.length(digits).between(8, 15) & ~digits.rlike(r"^([0-9])\1+$")
    return F.when(ok, F.concat(F.lit("+"), digits))


def email_problem(email: Column, domain: Column) -> Column:
    """Why an address can't be used for a company's domain; null if it can."""
    local, host = F.substring_index(email, "@", 1), F.substring_index(F.substring_index(email, "@", 2), "@", -1)
    theirs, ours = registrable_domain(host), registrable_domain(domain)
    return (
        F.when(~email.rlike(r"(?i)^[^\s@]+@[^\s@]+\.[a-z]{2,24}$"), F.lit("malformed"))
        .when((F.length(local) > 64) | (F.length(email) > 254), F.lit("exceeds RFC length limits"))
        .when(local.startswith(".") | local.endswith(".") | F.contains(local, F.lit("..")), F.lit("malformed local part"))
        .when(theirs != ours, F.concat(F.lit("belongs to "), theirs, F.lit(", not "), ours))
    )


def is_plausible_person_name(name: Column) -> Column:
    t = strip(name)
    words = F.split(t, r"(?U)[\s\x{FEFF}]+")
    ok = F.length(t).between(3, 80) & ~t.rlike(r"[0-9@/<>]") & ~t.rlike(f"(?iu){EDGE}(?:{HEADING_WORDS}){EDGE}") & F.size(words).between(2, 5)
    return F.coalesce(ok & F.forall(words, lambda w: w.rlike(r"^[\p{Lu}\p{Lo}]") | w.rlike(f"(?i)^(?:{NAME_PARTICLES})$")), F.lit(False))


def founded_year(text: Column, current_year: int) -> Column:
    y = F.regexp_extract(text, "(?iu)" + EDGE + FOUNDED + EDGE, 1).try_cast("int")
    return F.when(y.between(1800, current_year), y)


def address_line(text: Column) -> Column:
    """The surroundings of the first thing in a text that looks like a street or a postal code with a town."""
    at = F.regexp_instr(text, F.lit(ADDRESS_LINE.replace(r"\b", EDGE)))
    return F.when(at > 0, collapse(F.substring(text, F.greatest(F.lit(1), at - 60), F.least(at - 1, F.lit(60)) + 80)))


def without_marks(names: Column) -> Column:
    """Compatibility-decomposed, diacritics dropped, as an Arrow UDF: Catalyst has no function for it."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(_plain, na_action="ignore")

    return run(names)


def _plain(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c) and c not in "^`¨¯´·¸")


def normalized_company_name(name: Column) -> Column:
    """The form that names are compared in; null under four characters."""
    t = without_marks(F.lower(name))
    t = F.regexp_replace(F.regexp_replace(t, "&", " and "), r"(?U)[^\p{L}\p{N}\s]", " ")
    t = collapse(F.regexp_replace(t, f"{EDGE}(?:{LEGAL_FORMS}){EDGE}", " "))
    # runs of single letters are written together: "a i" as "ai"
    t = F.regexp_replace(t, r"(?<=(?:^| )\p{L}) (?=\p{L}(?: |$))", "")
    return F.when(F.length(t) >= 4, t)
