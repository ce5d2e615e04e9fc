"""Page fetching behind transports: the gates, the tier ladder, robots bodies and host addresses as tables.

The ladder's decisions are columns; only the transports run Python, one row a request, on partitions by domain.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadspark.components import stored
from leadspark.functions import challenge, html, robots, urls
from leadspark.operators import politeness

#: Redirects that are followed, and bytes of a body that are read.
MOST_REDIRECTS, MOST_BYTES = 5, 5 * 1024 * 1024

_RESPONSE = pa.schema([("url", pa.string()), ("domain", pa.string()), ("kind", pa.string()), ("page_idx", pa.int32()), ("status", pa.int32()), ("final_url", pa.string()), ("content_type", pa.string()), ("retry_after", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("html", pa.string()), ("error", pa.string())])
_RESPONSE_DDL = "url string, domain string, kind string, page_idx int, status int, final_url string, content_type string, retry_after string, headers map<string,string>, html string, error string"


@dataclass(frozen=True)
class Response:
    status: int
    headers: dict[str, str]
    body: str
    location: str | None = None


#: (url) -> Response; the address check of a hop happens before each call.
Transport = Callable[[str], Response]


def follow(url: str, get: Transport, refused: Callable[[str], str | None]) -> tuple[str, Response | None, str | None]:
    """(final url, response, error): each hop, the first included, is refused or fetched; at most five redirects."""
    for _ in range(MOST_REDIRECTS + 1):
        if why := refused(url):
            return url, None, why
        r = get(url)
        if r.location is None or not 300 <= r.status < 400:
            return url, r, None
        target = urls.canonicalize(r.location, url)
        if target is None:
            return url, None, "redirect to no address"
        url = target
    return url, None, "too many redirects"


def address_guard(lookup: Callable[[str], str]) -> Callable[[str], str | None]:
    """A check of each hop, redirects included: why a URL must not be fetched, or None. lookup: host to address."""

    def refused(url: str) -> str | None:
        u = urlsplit(url)
        host = (u.hostname or "").rstrip(".")
        if u.scheme not in ("http", "https"):
            return f"refused scheme: {u.scheme}:"
        if not host:
            return f"invalid url: {url}"
        if host == "localhost" or host.endswith((".localhost", ".internal")):
            return f"refused host: {host}"
        try:
            address = lookup(host)
            public = ipaddress.ip_address(address).is_global
        except (OSError, ValueError):
            address, public = None, False
        return None if public else f"refused private address {address} for {host}"

    return refused


def fetch_tier0(requests: DataFrame, get: Transport, refused: Callable[[str], str | None], wait: Callable[[int], None] | None = None) -> DataFrame:
    """requests(url, domain, kind, page_idx[, slot_ms]) to responses; a domain's requests share a partition, in the order of their slots.

    refused is asked before each hop. wait, if given, is called with a request's slot before it goes out.
    """
    slot = F.col("slot_ms") if "slot_ms" in requests.columns else F.lit(None).cast("bigint").alias("slot_ms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                slot_ms = r.pop("slot_ms")
                try:
                    if wait is not None and slot_ms is not None:
                        wait(slot_ms)
                    final, got, error = follow(r["url"], get, refused)
                except Exception as e:  # a failed request is data
                    final, got, error = r["url"], None, str(e)
                headers = {k.lower(): v for k, v in (got.headers if got else {}).items()}
                rows.append(r | {"status": got.status if got else None, "final_url": final, "content_type": headers.get("content-type"), "retry_after": headers.get("retry-after") if got and got.status in (429, 503) else None, "headers": list(headers.items()), "html": got.body[:MOST_BYTES] if got else None, "error": error})
            yield from pa.Table.from_pylist(rows, schema=_RESPONSE).to_batches()

    asked = requests.select("url", "domain", "kind", F.col("page_idx").cast("int").alias("page_idx"), slot)
    return asked.repartition("domain").sortWithinPartitions("slot_ms", "domain", "page_idx").mapInArrow(run, _RESPONSE_DDL)


def decide(responses: DataFrame) -> DataFrame:
    """Adds ``tier0_outcome`` (ok, refused, unreachable), ``tier0_error`` and ``decision`` (action, reason, vendor)."""
    c = F.col
    body = F.coalesce("html", F.lit(""))
    d = responses.withColumn("signals", html.page_signals(body)).withColumn("challenge", challenge.detect_challenge(c("status"), c("headers"), body))
    wall = challenge.looks_like_consent_wall(body, c("signals.visible_text"))
    decision = challenge.decide_escalation(c("status"), c("content_type"), c("challenge"), wall, c("signals.has_organization_jsonld"), c("signals.empty_root_mount"), c("signals.text_length"), c("signals.script_byte_ratio"), challenge.is_contact_path(urls.path_of(c("final_url"))), c("signals.has_contact_affordance"))
    wrong_kind = (c("status") < 400) & ~urls.is_allowed_content_type(c("content_type"))
    dead = (c("status") >= 400) & c("challenge").isNull()
    outcome = F.when(c("error").isNotNull(), "unreachable").when(wrong_kind, "refused").when(dead, "unreachable").otherwise("ok")
    error = F.coalesce(c("error"), F.when(wrong_kind, F.concat(F.lit("content-type "), F.coalesce("content_type", F.lit("none")))).when(dead, F.concat(F.lit("http "), c("status").cast("string"))))
    return d.withColumn("tier0_outcome", outcome).withColumn("tier0_error", error).withColumn("decision", F.when(outcome == "ok", decision))


def fetch_pages(
    requests: DataFrame, get: Transport, robots_bodies: DataFrame, addresses: DataFrame, agent: str, open_circuits: DataFrame | None = None, render: Transport | None = None, managed: Transport | None = None, *,
    refused: Callable[[str], str | None], now_ms: int = 0, interval_ms: int = 1500, put_off: DataFrame | None = None, wait: Callable[[int], None] | None = None,
) -> DataFrame:
    """The whole ladder for requests(url, domain, kind, page_idx): final_url, tier, outcome, status, html, error, reason, report, put_off_ms, content_hash.

    Each request has a slot of its host, interval_ms after the one before and not before what put_off(domain, floor_ms) says;
    ``put_off_ms`` tells, for the next pass, until when a Retry-After has put its host off. refused is asked before each hop
    of all tiers (``address_guard``), so a redirect can't lead to a private address.

    Gates run before any request: canonical address, open circuit, refused host, robots. A page that needs rendering goes
    to the renderer and keeps its first form if that fails; a challenge goes to the managed service or stays blocked.
    ``report`` is what the host's circuit breaker learns: failure, success or nothing.
    """
    c = F.col
    d = requests.withColumn("asked", urls.canonical_url(c("url"))).withColumn("host", urls.hostname(c("asked"))).withColumn("path", urls.path_and_query(c("asked")))
    d = d.join(addresses.select("host", "address"), "host", "left").withColumn("refused", urls.refusal(c("asked"), c("address")))
    d = d.join((open_circuits if open_circuits is not None else robots_bodies.limit(0)).select("domain", F.lit(True).alias("open")).distinct(), "domain", "left")
    d = stored(robots.allowed_pages(d, robots_bodies, agent))  # bodies and addresses may come from live look-ups
    gate = F.when(c("asked").isNull(), "refused").when(c("open"), "circuit_open").when(c("refused").isNotNull(), "refused").when(~c("allowed"), "robots_disallowed")
    why = F.when(c("asked").isNull(), "uncanonicalizable url").when(c("open"), "host circuit breaker open").when(c("refused").isNotNull(), c("refused")).otherwise("disallowed by robots.txt")
    none = F.lit(None).cast("string")
    d = d.withColumn("outcome", gate)
    shut = d.filter("outcome is not null").withColumns({"final_url": c("url"), "tier": F.lit(0), "status": F.lit(None).cast("int"), "html": none, "error": why, "reason": none, "report": none, "put_off_ms": F.lit(None).cast("bigint")})
    due = d.filter("outcome is null").select(c("asked").alias("url"), "domain", "kind", "page_idx").withColumn("t_ms", F.lit(now_ms).cast("bigint"))
    if put_off is not None:
        due = due.join(put_off.groupBy("domain").agg(F.max("floor_ms").alias("floor_ms")), "domain", "left")
    due = politeness.token_bucket(due, interval_ms, host="domain", order=("page_idx", "url"))
    got = stored(decide(fetch_tier0(due, get, refused, wait)))
    got = got.withColumn("tier", F.lit(0)).withColumn("reason", c("decision.reason")).withColumn("put_off_ms", politeness.retry_after_ms(F.lit(now_ms).cast("bigint"), c("retry_after")))
    failed = got.filter("tier0_outcome <> 'ok'").withColumns({"outcome": c("tier0_outcome"), "html": none, "error": c("tier0_error"), "report": F.lit("failure")})
    kept = got.filter("decision.action = 'keep'").withColumns({"outcome": F.lit("ok"), "report": F.lit("success")})
    out = [x.select(_COLUMNS) for x in (shut, failed, kept)]
    for action, tier, transport in (("tier1", 1, render), ("tier2", 2, managed)):
        more = got.filter(c("decision.action") == action)
        again = fetch_tier0((more if transport else more.limit(0)).select("url", "domain", "kind", "page_idx"), transport or get, refused)
        again = stored(again) if transport else again  # its calls are paid for, so they are made once, however often the pages are read
        still = challenge.detect_challenge(c("status"), F.expr("cast(map() as map<string,string>)"), F.coalesce("html", F.lit("")))
        good = again.filter(c("error").isNull() & (F.lit(tier == 1) | still.isNull())).select("url", F.struct("final_url", "status", "html").alias("new"))
        d2 = more.join(good.dropDuplicates(["url"]), "url", "left").withColumn("mended", c("new").isNotNull())
        if tier == 1:
            note, lost_outcome, lost_html, report = "; tier 1 failed, kept tier 0", "ok", c("html"), F.when(c("mended"), "success").otherwise("failure")
        else:
            note, lost_outcome, lost_html, report = "" if transport else "; tier 2 not configured", "blocked", none, F.lit("failure")
        d2 = d2.select(
            "url", "domain", "kind", "page_idx", F.coalesce("new.final_url", "final_url").alias("final_url"), F.when(c("mended"), tier).otherwise(0).alias("tier"), F.when(c("mended"), "ok").otherwise(lost_outcome).alias("outcome"),
            F.coalesce("new.status", "status").alias("status"), F.when(c("mended"), c("new.html")).otherwise(lost_html).alias("html"), none.alias("error"), F.when(c("mended"), c("reason")).otherwise(F.concat("reason", F.lit(note))).alias("reason"), report.alias("report"), "put_off_ms",
        )
        out.append(d2.select(_COLUMNS))
    result = out[0]
    for x in out[1:]:
        result = result.unionByName(x)
    return result.withColumn("content_hash", F.sha2("html", 256))


_COLUMNS = ["url", "domain", "kind", "page_idx", "final_url", "tier", "outcome", "status", "html", "error", "reason", "report", "put_off_ms"]


def robots_bodies(origins: DataFrame, get: Transport) -> DataFrame:
    """(domain, body) of origins(domain, origin); anything but a 200 leaves no body, which allows everything."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                try:
                    got = get(r["origin"] + "/robots.txt")
                    body = got.body[: robots.MOST_BYTES] if got.status == 200 else None
                except Exception:  # an unreachable file states nothing
                    body = None
                rows.append({"domain": r["domain"], "body": body})
            yield from pa.Table.from_pylist(rows, schema=pa.schema([("domain", pa.string()), ("body", pa.string())])).to_batches()

    return origins.select("domain", "origin").dropDuplicates(["domain"]).mapInArrow(run, "domain string, body string")


def resolve_hosts(hosts: DataFrame, lookup: Callable[[str], str], known: DataFrame | None = None, now_ms: int = 0, ttl_ms: int = 300_000, most: int = 5_000) -> DataFrame:
    """(host, address, resolved_ms), each host looked up once; a failed lookup has a null address, which is refused.

    known: an earlier result. Of it the newest ``most`` answers that are not older than ttl_ms are used again, and only other
    hosts are looked up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for h in b.column(0).to_pylist():
                try:
                    rows.append({"host": h, "address": lookup(h), "resolved_ms": now_ms})
                except OSError:
                    rows.append({"host": h, "address": None, "resolved_ms": now_ms})
            yield from pa.Table.from_pylist(rows, schema=pa.schema([("host", pa.string()), ("address", pa.string()), ("resolved_ms", pa.int64())])).to_batches()

    asked, ddl = hosts.select("host").distinct(), "host string, address string, resolved_ms bigint"
    if known is None:
        return asked.mapInArrow(run, ddl)
    fresh = stored(known.filter(F.col("address").isNotNull() & (F.col("resolved_ms") > now_ms - ttl_ms)).orderBy(F.desc("resolved_ms"), "host").limit(most))
    return asked.join(fresh, "host").select("host", "address", "resolved_ms").union(asked.join(fresh, "host", "left_anti").mapInArrow(run, ddl))


def managed_payload(service: F.Column, payload: F.Column) -> F.Column:
    """The page in a managed service's answer: raw from one kind, in a JSON field from the other."""
    wrapped = F.from_json(payload, "struct<success:boolean,data:struct<html:string,rawHtml:string>>")
    return F.when(service == "raw", payload).otherwise(F.coalesce(wrapped["data"]["rawHtml"], wrapped["data"]["html"]))
