"""HTML into records: one tolerant tree, one Arrow UDF for facts and one for rendering signals.

Trees come from the standard parser with these rules: void elements close at once; ``p``, ``li``, ``dt``, ``dd``, ``tr``,
``td``, ``th`` and ``option`` close an open one of their kind; an end tag closes up to its match and is ignored without
one; text outside ``html`` and ``body`` counts as body text, that of ``head`` elements does not.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from leadspark import constants as C
from leadspark.functions.urls import canonicalize
from leadspark.schemas import EXTRACTED_FIELDS

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_DEEP = 300


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]

    def find(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n.tag in tags]

    def text(self, gap: str = "", skip: frozenset[str] = frozenset(), roles: frozenset[str] = frozenset()) -> str:
        out: list[str] = []

        def go(n: Node) -> None:
            for c in n.children:
                if isinstance(c, str):
                    out.append(c)
                    if gap:
                        out.append(gap)
                elif c.tag not in skip and c.attrs.get("role", "") not in roles:
                    go(c)
                    if gap:
                        out.append(gap)

        go(self)
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#document", {}, None)
        self.deep = 0

    def handle_starttag(self, tag, attrs):
        closes = _CLOSES.get(tag)
        if closes and self.at.tag in closes:
            self.at = self.at.parent
        n = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)
        self.at.children.append(n)
        if tag not in _VOID and self.deep < _DEEP:
            self.at, self.deep = n, self.deep + 1

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at))

    def handle_endtag(self, tag):
        n, up = self.at, 0
        while n.parent is not None:
            up += 1
            if n.tag == tag:
                self.at, self.deep = n.parent, max(0, self.deep - up)
                return
            n = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


def body_of(root: Node) -> Node:
    bodies = root.find("body")
    if bodies:
        return bodies[0]
    shell = Node("body", {}, None)
    for n in root.walk():
        if n.tag in ("#document", "html"):
            shell.children += [c for c in n.children if isinstance(c, str) or c.tag not in ("html", "head", "title", "meta", "link")]
    return shell


def collapse(s: str) -> str:
    return re.sub(r"[\s\ufeff]+", " ", s).strip()


_BOILERPLATE = frozenset("script style noscript svg iframe template nav header footer".split())
_ROLES = frozenset(["navigation", "banner", "contentinfo"])


def clean_text(root: Node) -> str:
    """Body text with element borders as spaces, less scripts and boilerplate."""
    return collapse(body_of(root).text(" ", _BOILERPLATE))


def visible_text(root: Node) -> str:
    """Body text, neighbours run together, less scripts, boilerplate and landmarks by role."""
    return collapse(body_of(root).text("", _BOILERPLATE, _ROLES))


def scalar(v: object) -> str | None:
    """A trimmed string, or that of a list's first element."""
    while isinstance(v, list) and v:
        v = v[0]
    return (v.strip() or None) if isinstance(v, str) else None


def flatten_jsonld(v: object, deep: int = 0) -> Iterator[dict]:
    """Objects of a JSON-LD value, outer before inner; an ``@graph`` is gone through first and again as a value."""
    if deep > 6 or not isinstance(v, (dict, list)):
        return
    if isinstance(v, list):
        for x in v:
            yield from flatten_jsonld(x, deep + 1)
        return
    if isinstance(v.get("@graph"), list):
        yield from flatten_jsonld(v["@graph"], deep + 1)
    yield v
    for x in v.values():
        yield from flatten_jsonld(x, deep + 1)


def collect_jsonld(root: Node) -> list[dict]:
    out: list[dict] = []
    for s in root.find("script"):
        if s.attrs.get("type") == "application/ld+json":
            try:
                out += flatten_jsonld(json.loads(s.text()))
            except (ValueError, RecursionError):
                continue  # broken blocks are common, and say nothing
    return out


def decode_cf(hexed: str) -> str | None:
    if not re.fullmatch(r"[0-9a-fA-F]{4,}", hexed) or len(hexed) % 2:
        return None
    b = bytes.fromhex(hexed)
    out = "".join(chr(x ^ b[0]) for x in b[1:])
    return out if re.match(C.EMAIL_SHAPE, out) else None


def host_of(url: str) -> str | None:
    m = re.match(r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@\s]+)", url)
    return m[1].lower() if m else None


def registrable(host: str | None) -> str | None:
    if host is None:
        return None
    h = re.sub(r"^www\.", "", host.lower())
    labels = h.removesuffix(".").split(".")
    n = 3 if ".".join(labels[-2:]) in C.MULTI_PART_SUFFIXES else 2
    return ".".join(labels[-n:])


def platform_of(url: str) -> str | None:
    h = host_of(url) or ""
    return next((p for p, names in C.SOCIAL_HOSTS.items() if any(h == n or h.endswith("." + n) for n in names)), None)


def link_kind(url: str, text: str) -> tuple[str, int]:
    m = re.match(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", url)
    path, label = (m[1] or "/") if m else url, collapse(text)[:80]
    for kind, priority, of_href, of_text in C.LINK_KINDS:
        h, t = (re.search(p.replace(r"\b", r"(?a:\b)"), s, re.I) for p, s in ((of_href, path), (of_text, label)))
        if h or t:
            return kind, priority + 5 if h and t else priority if h else priority - 10
    return "other", 0


class Facts:
    """What one page says of its company; the first source of a field keeps it."""

    def __init__(self, url: str, kind: str, year: int, personal: bool):
        self.url, self.kind, self.year, self.personal = url, kind, year, personal
        self.one: dict = dict.fromkeys(("company_name", "description", "address", "country", "city", "founded_year"))
        self.emails: dict[str, str] = {}
        self.phones: dict[str, str] = {}
        self.socials: dict[str, str] = {}

    def put(self, field: str, value) -> None:
        if self.one[field] is None and value is not None:
            self.one[field] = value

    def email(self, raw: str, method: str) -> None:
        e = re.sub(r"^mailto:", "", raw.strip().lower()).split("?")[0]
        ok = re.match(C.EMAIL_SHAPE, e) and not re.search(C.EMAIL_JUNK, e) and not re.search(C.EMAIL_PLACEHOLDER, e) and e.split("@")[1] not in C.NON_COMPANY_DOMAINS
        local = e.split("@")[0]
        if ok and (self.personal or local in C.ROLE_LOCAL_PARTS or re.split(r"[+._-]", local)[0] in C.ROLE_LOCAL_PARTS):
            self.emails.setdefault(e, method)

    def phone(self, raw: str, method: str) -> None:
        t = raw.strip()
        digits = re.sub(r"[^0-9]", "", t)
        if 7 <= len(digits) <= 15:
            self.phones.setdefault(collapse(t)[:32], method)

    def social(self, url: str) -> None:
        if p := platform_of(url):
            self.socials.setdefault(p, url)

    def structured(self, node: dict) -> None:
        kinds = node.get("@type")
        if not any(re.search(C.ORG_TYPES, str(k)) for k in (kinds if isinstance(kinds, list) else [kinds or ""])):
            return
        self.put("company_name", scalar(node.get("name")) or scalar(node.get("legalName")))
        self.put("description", scalar(node.get("description")))
        if m := re.match(r"\s*(\d+)", (scalar(node.get("foundingDate")) or "")[:4]):
            if 1800 <= int(m[1]) <= self.year:
                self.put("founded_year", int(m[1]))
        a = node.get("address")
        if isinstance(a, dict):
            parts = [scalar(a.get(k)) for k in ("streetAddress", "postalCode", "addressLocality", "addressCountry")]
            self.put("address", ", ".join(p for p in parts if p) or None)
            self.put("city", parts[2])
            self.put("country", parts[3])
        elif isinstance(a, str):
            self.put("address", a)
        same = node.get("sameAs")
        for u in same if isinstance(same, list) else [same] if same else []:
            self.social(str(u))
        points = node.get("contactPoint")
        for p in [node, *(points if isinstance(points, list) else [points])]:
            if isinstance(p, dict):
                if e := scalar(p.get("email")):
                    self.email(e, "jsonld")
                if t := scalar(p.get("telephone")):
                    self.phone(t, "jsonld")

    def microdata(self, root: Node) -> None:
        scopes = [n for n in root.walk() if re.search(r"schema\.org/(Organization|LocalBusiness)", n.attrs.get("itemtype", ""))]

        def prop(name: str) -> str | None:
            for s in scopes:
                for n in s.walk():
                    if n is not s and n.attrs.get("itemprop") == name:
                        return (n.attrs["content"] if "content" in n.attrs else n.text()).strip() or None
            return None

        if scopes:
            self.put("company_name", prop("name"))
            if e := prop("email"):
                self.email(e, "microdata")
            if t := prop("telephone"):
                self.phone(t, "microdata")
            self.put("city", prop("addressLocality"))
            self.put("country", prop("addressCountry"))
            if street := prop("streetAddress"):
                self.put("address", ", ".join(p for p in (street, prop("postalCode"), self.one["city"], self.one["country"]) if p))


def clean_title(t: str | None) -> str | None:
    if not t:
        return None
    first = re.split(r"\s+[|–—·-]\s+", t)[0].strip()
    return first if 1 < len(first) < 100 else t.strip()[:100] or None


def extract(html: str | None, url: str, kind: str, year: int, personal: bool = False) -> dict:
    """The facts of one page, from the surest source to the loosest."""
    root = parse(html or "")
    f = Facts(url, kind, year, personal)
    for node in collect_jsonld(root):
        f.structured(node)
    f.microdata(root)
    metas = root.find("meta")

    def meta(attr: str, name: str) -> str | None:
        return next((m.attrs["content"].strip() for m in metas if m.attrs.get(attr) == name and "content" in m.attrs), None)

    titles = root.find("title")
    og_title = meta("property", "og:title")
    f.put("company_name", meta("property", "og:site_name") or clean_title(og_title if og_title is not None else titles[0].text() if titles else None))
    og = meta("property", "og:description")
    f.put("description", og if og is not None else meta("name", "description"))
    anchors = [a for a in root.find("a") if a.attrs.get("href")]
    for a in anchors:
        if a.attrs["href"].startswith("mailto:"):
            f.email(unquote(a.attrs["href"][7:]), "mailto")
    for a in anchors:
        if a.attrs["href"].startswith("tel:"):
            f.phone(unquote(a.attrs["href"][4:]), "tel")
    hidden = [n.attrs["data-cfemail"] for n in root.walk() if n.attrs.get("data-cfemail")]
    hidden += [a.attrs["href"].split("#")[1] for a in anchors if "/cdn-cgi/l/email-protection#" in a.attrs["href"]]
    for h in hidden:
        if e := decode_cf(h):
            f.email(e, "cfemail")
    links, own = {}, registrable(host_of(url))
    for a in anchors:
        absolute = canonicalize(a.attrs["href"], url)
        if absolute is None:
            continue
        f.social(absolute)
        label = a.text()
        k, priority = link_kind(absolute, label)
        if k != "other" and not a.attrs["href"].startswith("#") and registrable(host_of(absolute)) == own:
            links.setdefault(absolute, {"url": absolute, "kind": k, "priority": priority, "label": label.strip()[:80]})
    text = collapse(body_of(root).text(" "))
    if kind in ("contact", "imprint", "about"):
        for e in re.findall(C.EMAIL_SCAN, text):
            f.email(e, "regex")
        for p in re.findall(C.PHONE_SCAN, text, re.A):
            f.phone(p, "regex")
        f.put("address", page_address(root, text))
    if m := re.search(r"(?a:\b)" + C.FOUNDED + r"(?a:\b)", text, re.I):
        if 1800 <= int(m[1]) <= year:
            f.put("founded_year", int(m[1]))
    form = any(re.search(C.FORM_WORDS, source_of(n)) for n in root.find("form"))
    contacts = {k: [{"value": v, "method": m, "source_url": url} for v, m in got.items()] for k, got in (("emails", f.emails), ("phones", f.phones))}
    return f.one | contacts | {"socials": f.socials, "links": list(links.values()), "contact_form_url": url if form else None, "form_only_contact": form and not f.emails, "clean_text": clean_text(root)}


def source_of(n: Node) -> str:
    """Markup inside an element, enough to look for words in."""
    out: list[str] = []
    for c in n.children:
        out.append(c if isinstance(c, str) else f"<{c.tag} {' '.join(f'{k}="{v}"' for k, v in c.attrs.items())}>{source_of(c)}</{c.tag}>")
    return "".join(out)


def page_address(root: Node, text: str) -> str | None:
    for a in root.find("address")[:1]:
        t = collapse(a.text())
        if 10 < len(t) < 300:
            return t
    m = re.search(C.ADDRESS_LINE.replace(r"\b", r"(?a:\b)"), text)
    return collapse(text[max(0, m.start() - 60) : m.start() + 80]) if m else None


def extract_udf(current_year: int, allow_personal_emails: bool = False):
    """An Arrow UDF (html, url, kind) -> struct of the page's facts."""

    @F.pandas_udf(f"struct<{EXTRACTED_FIELDS}>")
    def run(html: pd.Series, url: pd.Series, kind: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([extract(h, u, k, current_year, allow_personal_emails) for h, u, k in zip(html, url, kind, strict=True)], columns=[x.split(":")[0] for x in _FIELDS])

    return run


_FIELDS = ["company_name", "description", "emails", "phones", "address", "country", "city", "founded_year", "socials", "links", "contact_form_url", "form_only_contact", "clean_text"]


def has_empty_root(root: Node) -> bool:
    def matches(n: Node, sel: str) -> bool:
        return n.attrs.get("id") == sel[1:] if sel[0] == "#" else sel[1:-1] in n.attrs

    nodes = list(root.walk())
    for sel in C.ROOT_MOUNTS:
        n = next((n for n in nodes if matches(n, sel)), None)
        if n is not None and sum(isinstance(c, Node) and c.tag != "script" for c in n.children) < 5 and len(n.text().strip()) < 200:
            return True
    return False


_SIGNALS = "struct<text_length:int,script_byte_ratio:double,empty_root_mount:boolean,has_contact_affordance:boolean,has_organization_jsonld:boolean,visible_text:string>"


def signals_of(source: str | None) -> tuple:
    root = parse(source or "")
    scripts = root.find("script")
    text = visible_text(root)
    affordance = any((n.tag == "a" and n.attrs.get("href", "").startswith(("mailto:", "tel:"))) or "data-cfemail" in n.attrs or n.tag == "form" for n in root.walk())
    org = any(s.attrs.get("type") == "application/ld+json" and re.search(C.ORG_JSONLD, s.text()) is not None for s in scripts)
    return len(text), sum(len(s.text()) for s in scripts) / len(source) if source else 0.0, has_empty_root(root), affordance, org, text


def page_signals(source: Column) -> Column:
    """What rendering decisions need to know of a page's markup, as an Arrow UDF."""

    @F.pandas_udf(_SIGNALS)
    def run(html: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([signals_of(h) for h in html], columns=["text_length", "script_byte_ratio", "empty_root_mount", "has_contact_affordance", "has_organization_jsonld", "visible_text"])

    return run(source)
