"""Structured data of pages on VARIANT: blocks, their objects level by level, and the facts of organizations. No Python runs.

A walk over nested values is a chain of explodes, one for each level, in one pass over the pages; an object's place in the
walk is a list of numbers, so "the first one wins" is a least place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspark import constants as C
from leadspark.components import stored
from leadspark.functions import contacts, urls

#: Arrays and objects stand at most so deep below a block; what is deeper is left out.
DEPTH = 6
#: Lists in lists that a scalar is looked for in.
NESTED = 2

_BLOCK = r"(?is)<script\b[^>]*\btype\s*=\s*[\"']?application/ld\+json[\"']?[^>]*>(.*?)</script"


def blocks(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, block, v): each JSON-LD script of a page as a VARIANT, in order. Broken ones, and those of scalars, say nothing."""
    raw = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(_BLOCK), F.lit(1))
    found = pages.filter(F.contains(F.col(html), F.lit("ld+json"))).select(key, F.posexplode(raw).alias("block", "raw"))
    return found.select(key, "block", F.try_parse_json("raw").alias("v")).filter(_is("v", "OBJECT") | _is("v", "ARRAY"))


def _is(v: str | Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def objects(found: DataFrame, key: str) -> DataFrame:
    """(key, block, place, v): each object in the blocks, outer before inner, DEPTH levels down (an array is a level).

    The array of an object's ``@graph`` is walked before the object, and again among its values. Places are to be compared as
    arrays. An object's values are walked in the order of their names, as VARIANT keeps them.
    """
    entry = "array<struct<place: array<int>, v: variant>>"

    def told(place: Column, v: Column) -> Column:
        return F.struct(place.alias("place"), v.alias("v"))

    none = F.array().cast(entry)
    rows = found.select(key, "block", F.array().cast("array<int>").alias("place"), "v", F.lit(True).alias("open"))
    for _ in range(DEPTH):
        items = F.transform(F.try_variant_get("v", "$", "array<variant>"), lambda x, i: told(F.array_append("place", i), x))
        values = F.transform(F.map_entries(F.try_variant_get("v", "$", "map<string,variant>")), lambda e, i: told(F.concat("place", F.array(F.lit(2), i)), e["value"]))
        graph = F.filter(F.array(told(F.array_append("place", F.lit(0)), F.try_variant_get("v", "$['@graph']", "variant"))), lambda x: _is(x["v"], "ARRAY"))
        inner = F.when(_is("v", "ARRAY"), items).when(_is("v", "OBJECT"), F.concat(graph, values)).otherwise(none)
        inner = F.filter(F.when(F.col("open"), inner).otherwise(none), lambda x: _is(x["v"], "OBJECT") | _is(x["v"], "ARRAY"))
        # a row goes on as it is, closed, beside what is in it
        each = F.concat(F.array(F.struct("place", "v", F.lit(False).alias("open"))), F.transform(inner, lambda x: F.struct(x["place"].alias("place"), x["v"].alias("v"), F.lit(True).alias("open"))))
        rows = rows.select(key, "block", F.explode(each).alias("e")).select(key, "block", "e.place", "e.v", "e.open")
    return rows.filter(_is("v", "OBJECT")).select(key, "block", F.array_append("place", F.lit(1)).alias("place"), "v")


def scalar(v: Column, name: str) -> Column:
    """The value of that name, if it is text: trimmed, or that of a list's first entry; null for all else and for nothing."""

    def text(path: str) -> Column:
        return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))

    return F.nullif(F.trim(F.coalesce(*[text(f"$['{name}']" + "[0]" * k) for k in range(NESTED + 1)])), F.lit(""))


def _get(v: str, name: str) -> Column:
    return F.try_variant_get(v, f"$['{name}']", "variant")


def _strings(v: Column) -> Column:
    """A list's entries as text, or one value as a list of it."""
    return F.when(_is(v, "ARRAY"), F.try_variant_get(v, "$", "array<string>")).when(v.isNotNull(), F.array(F.try_variant_get(v, "$", "string")))


def organizations(nodes: DataFrame, key: str) -> DataFrame:
    """(key, block, place, name, description, founded, address, city, country, same_as, emails, phones) of the objects that are organizations.

    An object is one by any of its types. Contact points follow the object's own e-mail and telephone.
    """
    types = F.coalesce(_strings(_get("v", "@type")), F.array().cast("array<string>"))
    org = nodes.filter(F.exists(types, lambda t: F.coalesce(F.rlike(t, F.lit(C.ORG_TYPES)), F.lit(False))))
    a = _get("v", "address")
    parts = [scalar(a, p) for p in ("streetAddress", "postalCode", "addressLocality", "addressCountry")]
    spelt = F.when(_is(a, "OBJECT"), F.nullif(F.concat_ws(", ", *parts), F.lit(""))).when(F.schema_of_variant(a) == "STRING", F.try_variant_get(a, "$", "string"))
    points = _get("v", "contactPoint")
    several = F.when(_is(points, "ARRAY"), F.try_variant_get(points, "$", "array<variant>")).when(_is(points, "OBJECT"), F.array(points)).otherwise(F.array().cast("array<variant>"))

    def all_of(name: str) -> Column:
        return F.array_compact(F.concat(F.array(scalar(F.col("v"), name)), F.transform(several, lambda p: scalar(p, name))))

    inside = _is(a, "OBJECT")
    return org.select(
        key, "block", "place", F.coalesce(scalar(F.col("v"), "name"), scalar(F.col("v"), "legalName")).alias("name"), scalar(F.col("v"), "description").alias("description"),
        F.regexp_extract(F.substring(scalar(F.col("v"), "foundingDate"), 1, 4), r"^\s*([0-9]+)", 1).try_cast("int").alias("founded"),
        spelt.alias("address"), F.when(inside, parts[2]).alias("city"), F.when(inside, parts[3]).alias("country"),
        F.coalesce(_strings(_get("v", "sameAs")), F.array().cast("array<string>")).alias("same_as"), all_of("email").alias("emails"), all_of("telephone").alias("phones"),
    )


def facts(pages: DataFrame, key: str, year: int, html: str = "html", allow_personal: bool = False) -> DataFrame:
    """(key, company_name, description, founded_year, address, city, country, emails, phones, socials): what the organizations of a page say.

    Of each field the first value in the walk counts; e-mails and phones are there once, in order, as far as they may be kept, and
    of each platform the first address. Pages without an organization have no row. key is to be a page's own.
    """
    found = stored(organizations(objects(blocks(pages, key, html), key), key))  # a few rows, read four times
    at = F.struct("block", "place")
    year_ok = F.when(F.col("founded").between(1800, year), F.col("founded"))

    def first(value: Column) -> Column:
        return F.min_by(value, F.when(value.isNotNull(), at))

    one = found.groupBy(key).agg(
        first(F.col("name")).alias("company_name"), first(F.col("description")).alias("description"), first(year_ok).alias("founded_year"),
        first(F.col("address")).alias("address"), first(F.col("city")).alias("city"), first(F.col("country")).alias("country"),
    )

    def listed(column: str, value: Column, name: str) -> DataFrame:
        each = found.select(key, "block", "place", F.posexplode(column).alias("pos", "raw")).select(key, F.struct("block", "place", "pos").alias("at"), value.alias("value")).filter("value is not null")
        least = each.groupBy(key, "value").agg(F.min("at").alias("at"))
        ordered = F.sort_array(F.collect_list(F.struct("at", "value")))  # a page's own, each once
        return least.groupBy(key).agg(F.transform(ordered, lambda e: e["value"]).alias(name))

    email = contacts.normalize_email(F.col("raw"))
    emails = listed("emails", F.when(contacts.is_usable_email(email, allow_personal), email), "emails")
    phones = listed("phones", contacts.normalize_phone(F.col("raw")), "phones")
    links = found.select(key, "block", "place", F.posexplode("same_as").alias("pos", "url")).withColumn("platform", urls.social_platform(F.col("url"))).filter("platform is not null")
    links = links.groupBy(key, "platform").agg(F.min_by("url", F.struct("block", "place", "pos")).alias("url"))
    socials = links.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("platform", "url")))).alias("socials"))
    out = one.join(emails, key, "left").join(phones, key, "left").join(socials, key, "left")
    none = F.array().cast("array<string>")
    return out.withColumns({"emails": F.coalesce("emails", none), "phones": F.coalesce("phones", none), "socials": F.coalesce("socials", F.create_map().cast("map<string,string>"))})
