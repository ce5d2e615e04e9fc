"""Bot challenges, consent walls and the choice of the next fetch tier, native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadspark.constants import BLOCKED_RESOURCE_URLS, BLOCKED_RESOURCES, CHALLENGE_BODIES, CHALLENGE_HEADERS, CHALLENGE_STATUS, CONSENT_VENDORS, CONSENT_WORDS, CONTACT_PATH

from .text import SPACE


def detect_challenge(status: Column, headers: Column, html: Column) -> Column:
    """struct(vendor, evidence) of the first signature met: headers, then the body's head, then the status; null if none."""
    head = F.substring(html, 1, 20_000)
    found = []
    for vendor, name, pattern in CHALLENGE_HEADERS:
        v = F.try_element_at(headers, F.lit(name))
        found.append(F.when((v != "") & v.rlike(pattern), F.struct(F.lit(vendor).alias("vendor"), F.concat(F.lit(f"header {name}: "), v).alias("evidence"))))
    for vendor, pattern in CHALLENGE_BODIES:
        found.append(F.when(head.rlike("(?i)" + pattern), F.struct(F.lit(vendor).alias("vendor"), F.substring(F.regexp_extract(head, "(?i)" + pattern, 0), 1, 120).alias("evidence"))))
    server = F.coalesce(F.try_element_at(headers, F.lit("server")), F.lit(""))
    at_status = F.concat(F.lit("status "), status.cast("string"))
    found.append(F.when(status.isin(CHALLENGE_STATUS) & server.rlike("(?i)cloudflare"), F.struct(F.lit("cloudflare").alias("vendor"), F.concat(at_status, F.lit(" from cloudflare")).alias("evidence"))))
    found.append(F.when(status.isin(403, 429), F.struct(F.lit("generic").alias("vendor"), at_status.alias("evidence"))))
    return F.coalesce(*found)


def looks_like_consent_wall(html: Column, visible: Column) -> Column:
    vendor = F.substring(html, 1, 40_000).rlike(CONSENT_VENDORS)
    return vendor & (F.size(F.split(visible, SPACE)) < 400) & (F.regexp_count(visible, F.lit(CONSENT_WORDS)) >= 4)


def is_contact_path(path: Column) -> Column:
    return F.coalesce(path.rlike(CONTACT_PATH), F.lit(False))


def decide_escalation(status: Column, content_type: Column, challenge: Column, consent_wall: Column, org_jsonld: Column, empty_root: Column, text_length: Column, script_ratio: Column, contact_path: Column, contact_affordance: Column) -> Column:
    """struct(action, reason, vendor): keep the page, render it (tier1) or fetch it by a managed service (tier2)."""
    mime = F.lower(F.trim(F.coalesce(F.substring_index(content_type, ";", 1), F.lit(""))))

    def go(action: str, reason: Column, vendor: Column | None = None) -> Column:
        return F.struct(F.lit(action).alias("action"), reason.alias("reason"), (F.lit(None).cast("string") if vendor is None else vendor).alias("vendor"))

    return (
        F.when(challenge.isNotNull(), go("tier2", F.concat(F.lit("bot challenge detected ("), challenge["evidence"], F.lit(")")), challenge["vendor"]))
        .when(status != 200, go("keep", F.concat(F.lit("non-200 status "), status.cast("string"))))
        .when(~mime.isin("text/html", "application/xhtml+xml"), go("keep", F.concat(F.lit("non-html content-type "), F.when(mime == "", "none").otherwise(mime))))
        .when(consent_wall, go("tier1", F.lit("consent wall obscures content")))
        .when(org_jsonld & ~empty_root, go("keep", F.lit("Organization JSON-LD present in markup")))
        .when(text_length < 500, go("tier1", F.concat(F.lit("visible text "), text_length.cast("string"), F.lit(" < 500 chars"))))
        .when(empty_root, go("tier1", F.lit("empty SPA root mount")))
        .when(script_ratio > 0.7, go("tier1", F.concat(F.lit("script bytes "), F.floor(script_ratio * 100).cast("string"), F.lit("% of document"))))
        .when(contact_path & ~contact_affordance, go("tier1", F.lit("contact-like page with no mailto/tel/form")))
        .otherwise(go("keep", F.lit("server-rendered content sufficient")))
    )


def resource_is_blocked(kind: Column, url: Column) -> Column:
    """Would a rendering browser leave this resource out? Heavy kinds, trackers and files by name."""
    return kind.isin(BLOCKED_RESOURCES) | F.coalesce(url.rlike(BLOCKED_RESOURCE_URLS), F.lit(False))
