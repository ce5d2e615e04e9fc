"""URL and host expressions.

The native forms take absolute http(s) URLs of plain characters; ``canonical_url_full`` (an Arrow UDF) also resolves relative
ones, dot segments and international hosts.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from urllib.parse import parse_qsl, quote, urlencode, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from leadspark.constants import BLOCKED_DOMAINS, CONTENT_TYPES, LINK_KINDS, MULTI_PART_SUFFIXES, NON_COMPANY_DOMAINS, SOCIAL_HOSTS, SOCIAL_HOSTS_VALID, TRACKING_PREFIXES

from .text import ascii_edges, collapse

_URL = r"^\s*([A-Za-z][A-Za-z0-9+.-]*):\/\/(?:([^\/?#@]*)@)?([^\/?#:@]*)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, _URL, n)


def scheme_of(url: Column) -> Column:
    return F.lower(_part(url, 1))


def hostname(url: Column) -> Column:
    """The lower-cased host of an absolute URL; null if there is none."""
    return bound(F.lower(_part(F.trim(url), 3)), lambda h: F.when((h != "") & ~h.rlike(r"[\s%<>^|\\]"), h))


def path_of(url: Column) -> Column:
    p = _part(F.trim(url), 5)
    return F.when(p == "", F.lit("/")).otherwise(p)


def registrable_domain(host: Column) -> Column:
    """The last two labels, or three under a suffix of two; one leading ``www.`` and one trailing dot go."""
    def of(h: Column) -> Column:
        labels = F.split(h, r"\.")
        last_two = F.substring_index(h, ".", -2)
        return F.when(F.size(labels) <= 2, h).when(last_two.isin(MULTI_PART_SUFFIXES), F.substring_index(h, ".", -3)).otherwise(last_two)

    return bound(F.regexp_replace(F.regexp_replace(F.lower(host), r"^www\.", ""), r"\.$", ""), of)


def domain_of(url: Column) -> Column:
    return registrable_domain(hostname(url))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it: projections that Spark merges don't copy it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def path_and_query(url: Column) -> Column:
    """What a server is asked for: the path, and the query if there is one."""
    q = _part(F.trim(url), 6)
    return F.concat(path_of(url), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))


def canonical_url(url: Column) -> Column:
    """Key form of an absolute http(s) URL: no tracking, sorted parameters, no fragment, default port or trailing slash; else null."""
    u = F.trim(url)
    parts = F.struct(F.lower(_part(u, 1)).alias("scheme"), _part(u, 2).alias("user"), _part(u, 4).alias("port"), path_of(u).alias("path"), _part(u, 6).alias("query"), F.regexp_replace(hostname(u), r"\.$", "").alias("host"))
    return bound(parts, _canonical)


def _canonical(u: Column) -> Column:
    scheme, user, port, path, query, host = (u[c] for c in ("scheme", "user", "port", "path", "query", "host"))
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p, i: F.struct(_form(F.substring_index(p, "=", 1)).alias("k"), i.alias("i"), _form(F.when(F.contains(p, F.lit("=")), F.substring(p, F.instr(p, "=") + 1, F.length(p))).otherwise("")).alias("v")))
    kept = F.array_sort(F.filter(pairs, lambda p: ~p["k"].rlike(TRACKING_PREFIXES)))
    text = F.array_join(F.transform(kept, lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")
    slim = F.when((F.length(path) > 1) & path.endswith("/"), F.substring(path, F.lit(1), F.length(path) - 1)).otherwise(path)
    said = F.when(text != "", F.concat(F.lit("?"), text)).otherwise("")
    out = F.concat(scheme, F.lit("://"), F.when(user != "", F.concat(user, F.lit("@"))).otherwise(""), host, F.when(default, "").otherwise(F.concat(F.lit(":"), port)), slim, said)
    return F.when(scheme.isin("http", "https") & host.isNotNull(), out)


def _form(c: Column) -> Column:
    """Form encoding of a parameter's decoded part; one that can't be decoded stays."""
    return F.coalesce(F.url_encode(F.try_url_decode(c)), c)


def canonicalize(url: str | None, base: str | None = None) -> str | None:
    """The same in Python for any input, relative to a base if given."""
    if url is None:
        return None
    try:
        u = urlsplit(urljoin(base, url.strip()) if base else url.strip())
        port = u.port
    except ValueError:
        return None
    if u.scheme.lower() not in ("http", "https") or not u.hostname:
        return None
    try:
        host = u.hostname.encode("idna").decode() if not u.hostname.isascii() else u.hostname.lower()
    except UnicodeError:
        return None
    if re.search(r"[\s%<>^|\\]", host):
        return None
    host = host.removesuffix(".")
    pairs = sorted(((k, v) for k, v in parse_qsl(u.query, keep_blank_values=True) if not re.match(TRACKING_PREFIXES.replace("^", "", 1), k)), key=lambda p: p[0])
    path = urlsplit(urljoin(f"http://{host}/", quote(u.path, safe="/%:@!$&'()*+,;=~-._[]"))).path if u.path else "/"
    path = path[:-1] if len(path) > 1 and path.endswith("/") else path
    net = host if port is None or (u.scheme, port) in (("http", 80), ("https", 443)) else f"{host}:{port}"
    user = u.netloc.rpartition("@")[0]
    return urlunsplit((u.scheme, f"{user}@{net}" if user else net, path or "/", urlencode(pairs), ""))


def canonical_url_full(url: Column, base: Column | None = None) -> Column:
    """``canonicalize`` as an Arrow UDF."""

    @F.pandas_udf("string")
    def run(u: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([canonicalize(x, y) for x, y in zip(u, b, strict=True)], dtype=object)

    return run(url, F.lit(None).cast("string") if base is None else base)


def same_registrable_domain(a: Column, b: Column) -> Column:
    return F.coalesce(domain_of(a) == domain_of(b), F.lit(False))


def is_blocked(domain: Column) -> Column:
    return domain.isin(BLOCKED_DOMAINS)


def is_non_company(domain: Column) -> Column:
    return domain.isin(NON_COMPANY_DOMAINS)


def depth(url: Column) -> Column:
    """Non-empty path segments; the largest exact integer for what is no URL."""
    return F.when(hostname(url).isNotNull(), F.size(F.filter(F.split(path_of(url), "/"), lambda p: p != "")).cast("long")).otherwise(F.lit(9007199254740991))


def _on(host: Column, names: list[str]) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | (host == n) | host.endswith("." + n)
    return out


def social_platform(url: Column) -> Column:
    h = hostname(url)
    out = F.lit(None).cast("string")
    for name, hosts in reversed(SOCIAL_HOSTS.items()):
        out = F.when(_on(h, hosts), F.lit(name)).otherwise(out)
    return out


def is_plausible_social(platform: Column, url: Column) -> Column:
    h = hostname(url)
    fits = F.lit(True)
    for name, hosts in SOCIAL_HOSTS_VALID.items():
        fits = F.when(platform == name, F.coalesce(_on(h, hosts), F.lit(False)) & (F.length(F.regexp_replace(path_of(url), "/+$", "")) > 1)).otherwise(fits)
    return fits


def is_private_address(address: Column) -> Column:
    """Not a public address; what is no address is private."""
    v4 = r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"
    a = F.lower(F.substring_index(address, "%", 1))
    embedded = F.regexp_extract(a, r"^::ffff:(\d+\.\d+\.\d+\.\d+)$", 1)
    ip = F.when(embedded != "", embedded).otherwise(a)
    o = [F.regexp_extract(ip, v4, i).try_cast("int") for i in range(1, 5)]
    bad4 = (o[0] > 255) | (o[1] > 255) | (o[2] > 255) | (o[3] > 255)
    private4 = o[0].isin(0, 10, 127) | ((o[0] == 169) & (o[1] == 254)) | ((o[0] == 172) & o[1].between(16, 31)) | ((o[0] == 192) & o[1].isin(168, 0)) | ((o[0] == 100) & o[1].between(64, 127)) | (o[0] >= 224)
    shape6 = a.rlike(r"^[0-9a-f:]*:[0-9a-f:.]*$") & ~a.rlike(":::")
    private6 = a.isin("::", "::1") | a.startswith("fe80") | a.rlike("^f[cdf]")
    return F.coalesce(F.when(ip.rlike(v4), bad4 | private4).when(shape6, private6).otherwise(True), F.lit(True))


def refusal(url: Column, address: Column) -> Column:
    """Why a URL must not be fetched, given the address that its host resolves to; null if it may be."""
    h = F.regexp_replace(hostname(url), r"^\[|\]$", "")
    return (
        F.when(hostname(url).isNull(), F.concat(F.lit("invalid url: "), F.coalesce(url, F.lit("null"))))
        .when(~scheme_of(F.trim(url)).isin("http", "https"), F.concat(F.lit("refused scheme: "), scheme_of(F.trim(url)), F.lit(":")))
        .when((h == "localhost") | h.endswith(".localhost") | h.endswith(".internal"), F.concat(F.lit("refused host: "), h))
        .when(is_private_address(address), F.concat(F.lit("refused private address "), F.coalesce(address, F.lit("null")), F.lit(" for "), h))
    )


def is_allowed_content_type(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(F.substring_index(c, ";", 1))).isin(CONTENT_TYPES), F.lit(False))


def classify_link(href: Column, text: Column) -> Column:
    """struct(kind, priority) of a link: the first rule that its path or its text meets; both is best, the text alone worse."""
    path = F.when(hostname(href).isNotNull(), path_of(href)).otherwise(href)
    label = F.substring(collapse(text), 1, 80)
    out = F.struct(F.lit("other").alias("kind"), F.lit(0).alias("priority"))
    for kind, priority, of_href, of_text in reversed(LINK_KINDS):
        h = F.coalesce(path.rlike("(?iu)" + ascii_edges(of_href)), F.lit(False))
        t = F.coalesce(label.rlike("(?iu)" + ascii_edges(of_text)), F.lit(False))
        worth = F.when(h & t, priority + 5).when(h, priority).otherwise(priority - 10)
        out = F.when(h | t, F.struct(F.lit(kind).alias("kind"), worth.alias("priority"))).otherwise(out)
    return out
