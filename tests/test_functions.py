"""Scalar functions, one value at a time, with the traps of regular expressions, rounding and nulls."""

import pytest
from pyspark.sql import functions as F

from leadspark.functions import challenge, contacts, robots, text, urls
from leadspark.functions import presentation as P


def values(spark, expr, rows, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, v {kind}")
    return [r.x for r in df.select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


def test_registrable_domain(spark):
    hosts = ["blog.acme.co.uk", "www.acme.de", "acme.com.", "co.uk", "1.2.3.4", "A.B.Example.COM", "localhost", None]
    assert values(spark, urls.registrable_domain, hosts) == ["acme.co.uk", "acme.de", "acme.com", "co.uk", "3.4", "example.com", "localhost", None]


URLS = {
    "https://Acme.DE/Path/?utm_source=x&b=2&a=1#frag": "https://acme.de/Path?a=1&b=2",
    "http://acme.de:80": "http://acme.de/",
    "https://acme.de:8443/x/": "https://acme.de:8443/x",
    "https://acme.de/?referrer=1&source_id=2": "https://acme.de/",
    "https://acme.de/?q=a%20b&q=": "https://acme.de/?q=a+b&q=",
    "ftp://acme.de/": None,
    "mailto:x@y.de": None,
    "": None,
    "https://user@acme.de./a//": "https://user@acme.de/a/",
}


def test_canonical_url(spark):
    assert values(spark, urls.canonical_url, list(URLS)) == list(URLS.values())
    assert {u: urls.canonicalize(u) for u in URLS} == URLS
    assert values(spark, urls.canonical_url, [None]) == [None]


def test_canonicalize_relative_and_international():
    assert urls.canonicalize("../b?x=1", "https://acme.de/a/c/") == "https://acme.de/a/b?x=1"
    assert urls.canonicalize("https://bücher.de/ä") == "https://xn--bcher-kva.de/%C3%A4"
    assert urls.canonicalize("#top", "https://acme.de/a") == "https://acme.de/a"
    assert urls.canonicalize("http://[::bad/") is None


def test_domain_depth_and_lists(spark):
    assert values(spark, urls.domain_of, ["https://x.acme.co.jp/a", "nonsense", None]) == ["acme.co.jp", None, None]
    assert values(spark, urls.depth, ["https://a.de/x//y/", "https://a.de", "bad"]) == [2, 0, 9007199254740991]
    assert values(spark, urls.is_blocked, ["google.com", "acme.de"]) == [True, False]
    assert values(spark, urls.is_non_company, ["gmail.com", "sites.google.com", "acme.de"]) == [True, True, False]
    assert values(spark, lambda c: urls.same_registrable_domain(c, F.lit("https://b.acme.de/")), ["https://a.acme.de", "bad", None]) == [True, False, False]


def test_social(spark):
    seen = ["https://de.linkedin.com/company/a", "https://x.com/a", "https://facebook.com/", "https://notx.com/a", "https://fb.com/a", None]
    assert values(spark, urls.social_platform, seen) == ["linkedin", "twitter", "facebook", None, None, None]
    assert values(spark, lambda c: urls.is_plausible_social(F.lit("facebook"), c), seen[2:5]) == [False, False, True]
    assert values(spark, lambda c: urls.is_plausible_social(F.lit("other"), c), ["nonsense"]) == [True]


def test_private_addresses(spark):
    private = ["0.1.1.1", "10.0.0.1", "127.0.0.1", "169.254.169.254", "172.16.0.1", "172.31.9.9", "192.168.1.1", "192.0.5.5", "100.64.0.1", "224.0.0.1", "::1", "::", "fe80::1", "fd00::1", "ff02::1", "::ffff:10.0.0.1", "256.1.1.1", "host", "", None]
    public = ["8.8.8.8", "172.32.0.1", "192.1.0.1", "100.128.0.1", "2001:db8::1", "::ffff:8.8.8.8"]
    assert values(spark, urls.is_private_address, private) == [True] * len(private)
    assert values(spark, urls.is_private_address, public) == [False] * len(public)


def test_refusal(spark):
    asked = ["https://acme.de/", "ftp://acme.de/", "http://localhost/", "http://a.internal/x", "bad"]
    assert values(spark, lambda c: urls.refusal(c, F.lit("8.8.8.8")), asked) == [None, "refused scheme: ftp:", "refused host: localhost", "refused host: a.internal", "invalid url: bad"]
    assert values(spark, lambda c: urls.refusal(c, F.lit("10.0.0.1")), asked[:1]) == ["refused private address 10.0.0.1 for acme.de"]


def test_content_type(spark):
    assert values(spark, urls.is_allowed_content_type, ["text/HTML; charset=x", "application/pdf", "", None]) == [True, False, False, False]


def test_links(spark):
    def kind(href, label):
        return tuple(spark.range(1).select(urls.classify_link(F.lit(href), F.lit(label)).alias("k")).first().k)

    assert kind("https://a.de/impressum", "Impressum") == ("imprint", 105)
    assert kind("https://a.de/kontakt", "x") == ("contact", 90)
    assert kind("https://a.de/x", "Our  story") == ("about", 70)
    assert kind("/team", "Team") == ("team", 75)
    assert kind("https://a.de/contactless", "x") == ("other", 0)
    assert kind("https://a.de/x", "über uns") == ("other", 0)  # an ASCII edge before a letter outside ASCII needs a word character
    assert kind("https://a.de/contact", "Impressum") == ("imprint", 90)  # the first rule met decides


def test_cf_email(spark):
    coded = "2a" + "".join(f"{ord(c) ^ 0x2A:02x}" for c in "info@acme.de")
    assert values(spark, contacts.decode_cf_email, [coded, coded.upper(), coded[:-1], "zz", "2a", "", None]) == ["info@acme.de", "info@acme.de", None, None, None, None, None]


def test_emails(spark):
    t = "Mail Info@Acme.de, jane.doe@acme.de, info@acme.de; logo@2x.png test@acme.de sales.eu@acme.de x@gmail.com"
    assert values(spark, contacts.scan_emails, [t]) == [["info@acme.de", "sales.eu@acme.de"]]
    assert values(spark, lambda c: contacts.scan_emails(c, True), [t]) == [["info@acme.de", "jane.doe@acme.de", "sales.eu@acme.de"]]
    assert values(spark, contacts.is_role_email, ["info@a.de", "sales-eu@a.de", "jane@a.de"]) == [True, True, False]
    assert values(spark, contacts.normalize_email, [" MAILTO:Info@a.de?subject=x "]) == ["info@a.de"]


def test_phones(spark):
    raw = ["+49 (0)30 1234567", "0049 30 1234567", "030 1234567", "+1111111111", "+49 30", "2024", None]
    assert values(spark, contacts.phone_e164, raw) == ["+49301234567", "+49301234567", None, None, None, None, None]
    assert values(spark, contacts.normalize_phone, [" 030  123 4567 ", "123", "1" * 16]) == ["030 123 4567", None, None]
    assert values(spark, contacts.scan_phones, ["call +49 30 1234567 or +49 30 1234567"]) == [["+49 30 1234567"]]


def test_email_problem(spark):
    emails = ["info@acme.de", "info@sub.acme.de", "info@agency.com", "bad", "a..b@acme.de", "x" * 65 + "@acme.de"]
    assert values(spark, lambda c: contacts.email_problem(c, F.lit("www.acme.de")), emails) == [None, None, "belongs to agency.com, not acme.de", "malformed", "malformed local part", "exceeds RFC length limits"]


def test_person_names(spark):
    names = ["Ada Lovelace", "Ludwig van Beethoven", "Our Leadership", "Join Us", "Ada", "ada lovelace", "R2 D2", "A B C D E F", "李 明", None]
    assert values(spark, contacts.is_plausible_person_name, names) == [True, True, False, False, False, False, False, False, True, False]


def test_company_keys(spark):
    names = ["Acme GmbH", "ACME Inc.", "A.I. Systems", "AI Systems", "Müller & Söhne KG", "AI", "SAS Institute", None]
    assert values(spark, contacts.normalized_company_name, names) == ["acme", "acme", "ai systems", "ai systems", "muller and sohne", None, "institute", None]


def test_titles_and_names(spark):
    assert values(spark, text.clean_title, ["Acme GmbH | AI", "A - B", "Acme-Werk", "", None, "x | y"]) == ["Acme GmbH", "A - B", "Acme-Werk", None, None, "x | y"]
    assert values(spark, text.clean_company_name, ["  Acme – Home ", "| Acme |", "A", "Acme  GmbH", None]) == ["Acme", "Acme", None, "Acme GmbH", None]
    assert values(spark, lambda c: text.trim_to(c, 5), ["abc", "abcdef", "ab  cdef", "  ", None]) == ["abc", "abcd…", "ab c…", None, None]


def test_founded_and_address(spark):
    assert values(spark, lambda c: contacts.founded_year(c, 2026), ["Founded in 1999", "gegründet 2030", "seit 2001.", "since 123"]) == [1999, None, 2001, None]
    assert values(spark, contacts.address_line, ["Hier: Beispielstraße 12, 10115 Berlin", "nothing"]) == ["Hier: Beispielstraße 12, 10115 Berlin", None]


def test_words_and_matches(spark):
    assert values(spark, text.meaningful_words, ["The AI-Platform for AI companies"]) == [["ai"]]
    assert values(spark, lambda c: text.token_overlap(F.lit("AI startups robots"), c), ["an ai firm", None]) == [0.5, 0.0]
    assert values(spark, lambda c: text.matches_country(c, F.array(F.lit("Germany"))), ["DE", "Deutschland", "France", "", None]) == [True, True, False, False, False]
    assert values(spark, lambda c: text.matches_any(c, F.array(F.lit(" Berlin "))), ["berlin mitte", "", None]) == [True, False, False]
    assert values(spark, lambda c: text.keyword_hits(c, F.array(F.lit("AI"), F.lit(" "), F.lit("x"))), ["an ai box"]) == [2]


def test_numbers(spark):
    ranges = ["50-100", "500+", "over 1,000", "12", "many", None]
    got = values(spark, lambda c: text.employee_bounds(F.lit(None).cast("int"), c), ranges)
    assert [r and tuple(r) for r in got] == [(50, 100), (500, float("inf")), (1000, float("inf")), (12, 12), None, None]
    assert values(spark, text.round2, [1.005, 2.675, -1.005, 0.125], "double") == [1.0, 2.68, -1.0, 0.13]
    assert values(spark, text.estimate_tokens, ["", "abcd", "a" * 36]) == [0, 2, 10]


def test_clamp_to_tokens(spark):
    long = "a" * 32 + ". " + "b" * 10
    assert values(spark, lambda c: text.clamp_to_tokens(c, 10), ["short", long, "c" * 50]) == ["short", "a" * 32 + ".", "c" * 36]


def test_challenges(spark):
    def found(status, headers, body):
        h = F.create_map(*[F.lit(x) for kv in headers.items() for x in kv]) if headers else F.expr("cast(map() as map<string,string>)")
        r = spark.range(1).select(challenge.detect_challenge(F.lit(status), h, F.lit(body)).alias("c")).first().c
        return r and tuple(r)

    assert found(200, {"cf-mitigated": "challenge"}, "") == ("cloudflare", "header cf-mitigated: challenge")
    assert found(200, {}, "<h1>Just a moment...</h1>") == ("cloudflare", "Just a moment...")
    assert found(403, {"server": "cloudflare"}, "x") == ("cloudflare", "status 403 from cloudflare")
    assert found(429, {}, "x") == ("generic", "status 429")
    assert found(503, {}, "x") is None
    assert found(200, {}, "hello") is None


@pytest.mark.parametrize(
    ("changed", "expected"),
    [
        ({}, ("keep", "server-rendered content sufficient")),
        ({"status": 404}, ("keep", "non-200 status 404")),
        ({"mime": "application/pdf"}, ("keep", "non-html content-type application/pdf")),
        ({"wall": True}, ("tier1", "consent wall obscures content")),
        ({"org": True, "length": 10}, ("keep", "Organization JSON-LD present in markup")),
        ({"org": True, "empty": True}, ("tier1", "empty SPA root mount")),
        ({"length": 499}, ("tier1", "visible text 499 < 500 chars")),
        ({"ratio": 0.75}, ("tier1", "script bytes 75% of document")),
        ({"contact": True}, ("tier1", "contact-like page with no mailto/tel/form")),
        ({"contact": True, "affordance": True}, ("keep", "server-rendered content sufficient")),
    ],
)
def test_escalation(spark, changed, expected):
    a = {"status": 200, "mime": "text/html; charset=utf-8", "wall": False, "org": False, "empty": False, "length": 1000, "ratio": 0.1, "contact": False, "affordance": False} | changed
    no = F.lit(None).cast("struct<vendor:string,evidence:string>")
    d = challenge.decide_escalation(F.lit(a["status"]), F.lit(a["mime"]), no, F.lit(a["wall"]), F.lit(a["org"]), F.lit(a["empty"]), F.lit(a["length"]), F.lit(a["ratio"]), F.lit(a["contact"]), F.lit(a["affordance"]))
    r = spark.range(1).select(d.alias("d")).first().d
    assert (r.action, r.reason) == expected


def test_consent_wall(spark):
    wall = "cookie consent privacy accept all cookies"
    assert spark.range(1).select(challenge.looks_like_consent_wall(F.lit("<script src=onetrust>"), F.lit(wall)), challenge.looks_like_consent_wall(F.lit("<p>"), F.lit(wall)), challenge.looks_like_consent_wall(F.lit("klaro"), F.lit(wall + " word" * 400))).first()[:] == (True, False, False)


ROBOTS = "User-agent: other\nDisallow: /\n\nUser-agent: LeadSpark\nUser-agent: x\nDisallow: /private # no\nAllow: /private/open\nDisallow: /*.pdf$\nCrawl-delay: 99\nDisallow:\nno colon\n"


def test_robots(spark):
    r = values(spark, lambda c: robots.parse_robots(c, "leadspark/1.0"), [ROBOTS, "", None])
    assert (r[0].disallow, r[0].allow, r[0].crawl_delay_ms) == (["/private", "/*.pdf$"], ["/private/open"], 30000)
    assert (r[1].disallow, r[1].allow, r[1].crawl_delay_ms) == ([], [], None) and r[2].disallow == []
    rules = robots.parse_robots(F.lit(ROBOTS), "leadspark")
    paths = ["/", "/private/x", "/private/open/x", "/a.pdf", "/a.pdf$"]
    assert values(spark, lambda c: robots.is_allowed(c, rules), paths) == [True, False, True, True, False]
    assert values(spark, lambda c: robots.is_allowed(c, rules, end_anchor=True), paths) == [True, False, True, False, True]


def test_presentation(spark):
    r = spark.range(1).select(P.percent(F.lit(1), F.lit(3)), P.percent(F.lit(5), F.lit(0)), P.percent(F.lit(9), F.lit(3)), P.run_label(F.lit("awaiting_approval")), P.run_tone(F.lit("odd")), P.domain_tone(F.lit("blocked")), P.score_class(F.lit(70)), P.dotted(F.lit("seed"), F.lit(""), F.lit(2020)), P.employee_facet(F.lit(20), F.lit(None).cast("int")), P.employee_facet(F.lit(0), F.lit(None).cast("int"))).first()
    assert r[:] == (33, 0, 100, "Awaiting approval", "idle", "danger", "green", "seed · 2020", "20–any", "Any")
    took = [F.timestamp_seconds(F.lit(s)) for s in (0, 59, 61, 7260)]
    assert spark.range(1).select(*(P.format_duration(took[0], t) for t in took[1:]), P.format_duration(took[1], took[0])).first()[:] == ("59s", "1m 1s", "2h 1m", "—")


def test_blocked_resources(spark):
    seen = ["https://www.googletagmanager.com/x.js", "https://a.de/logo.PNG?x=1", "https://a.de/app.js", None]
    assert values(spark, lambda c: challenge.resource_is_blocked(F.lit("script"), c), seen) == [True, True, False, False]
    assert values(spark, lambda c: challenge.resource_is_blocked(F.lit("font"), c), seen[2:3]) == [True]
