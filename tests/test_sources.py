"""Pages into facts, adapters with recorded transports, streaming twins and the engine's gate."""

import json

import pytest
from pyspark.sql import functions as F

from leadspark import components
from leadspark.config import EngineConfig
from leadspark.engine import Engine
from leadspark.functions import html
from leadspark.operators import politeness
from leadspark.sources import fetch, llm, search, store
from leadspark.streaming import jobs

IMPRINT = """<html><head><title>Muster GmbH | Start</title><meta property="og:site_name" content="Muster GmbH"><meta name="description" content="Maschinen"></head>
<body><nav><a href="/kontakt">Kontakt</a><a href="/team/?utm_source=x">Team</a><a href="https://other.com/impressum">Impressum</a><a href="#x">About</a></nav>
<address>Beispielweg 3, 10115 Berlin</address><a href="mailto:info@muster.de?subject=x">Mail</a><a href="tel:+49%2030%201234567">Tel</a><a href="https://www.linkedin.com/company/muster">in</a>
<p>gegründet 1998<p>info@muster.de</p><span>Impressum</span><script>var a = "</p>";</script></body></html>"""


def test_imprint_page():
    r = html.extract(IMPRINT, "https://muster.de/impressum", "imprint", 2026)
    assert (r["company_name"], r["description"], r["address"], r["founded_year"]) == ("Muster GmbH", "Maschinen", "Beispielweg 3, 10115 Berlin", 1998)
    assert [(e["value"], e["method"]) for e in r["emails"]] == [("info@muster.de", "mailto")] and [(p["value"], p["method"]) for p in r["phones"]] == [("+49 30 1234567", "tel")]
    assert r["socials"] == {"linkedin": "https://www.linkedin.com/company/muster"}
    assert [(x["url"], x["kind"], x["priority"]) for x in r["links"]] == [("https://muster.de/kontakt", "contact", 95), ("https://muster.de/team", "team", 75)]
    assert "Kontakt" not in r["clean_text"] and "var a" not in r["clean_text"] and "1998 info@muster.de Impressum" in r["clean_text"]


def test_structured_data():
    block = {"@graph": [{"@type": "WebSite", "name": "no"}, {"@type": ["Thing", "Organization"], "legalName": "Json AG", "foundingDate": "2010-01-01", "email": "kontakt@json.de", "telephone": "+41 44 1234567", "address": {"streetAddress": "S 1", "addressLocality": "Zürich", "addressCountry": "CH"}, "sameAs": "https://x.com/json", "contactPoint": [{"email": "sales@json.de"}]}]}
    page = f'<script type="application/ld+json">{{bad</script><script type="application/ld+json">{json.dumps(block)}</script><title>T</title>'
    r = html.extract(page, "https://json.de/", "home", 2026)
    assert (r["company_name"], r["founded_year"], r["city"], r["country"], r["address"]) == ("Json AG", 2010, "Zürich", "CH", "S 1, Zürich, CH")
    assert [e["value"] for e in r["emails"]] == ["kontakt@json.de", "sales@json.de"] and r["phones"][0]["value"] == "+41 44 1234567" and r["socials"] == {"twitter": "https://x.com/json"}
    assert [n.get("name") for n in html.flatten_jsonld({"name": "p", "@graph": [{"name": "c"}]})] == ["c", "p", "c"]
    micro = '<div itemscope itemtype="https://schema.org/LocalBusiness"><span itemprop="name">Micro</span><meta itemprop="email" content="info@micro.de"><b itemprop="streetAddress">W 2</b><i itemprop="addressLocality">Graz</i></div>'
    m = html.extract(micro, "https://micro.de/", "home", 2026)
    assert (m["company_name"], m["address"], m["city"], m["emails"][0]["method"]) == ("Micro", "W 2, Graz", "Graz", "microdata")


def test_hidden_mail_forms_and_empty_pages():
    coded = "10" + "".join(f"{ord(c) ^ 0x10:02x}" for c in "info@hid.de")
    r = html.extract(f'<a href="/cdn-cgi/l/email-protection#{coded}">x</a><form><input name=email></form>', "https://hid.de/", "home", 2026)
    assert r["emails"][0]["method"] == "cfemail" and r["contact_form_url"] == "https://hid.de/" and r["form_only_contact"] is False
    assert html.extract("<form>Nachricht</form>", "https://a.de/", "home", 2026)["form_only_contact"] is True
    for empty in ("", None, "<", "<p><b><p>", "\x00"):
        assert html.extract(empty, "https://a.de/", "home", 2026)["emails"] == []
    assert html.extract("<div>" * 5000 + "deep", "https://a.de/", "home", 2026)["clean_text"] == "deep"


def test_signals(spark):
    shell = '<html><body><div id="root"></div><script>' + "x" * 100 + "</script></body></html>"
    plain = "<html><body><nav>menu</nav><p>" + "word " * 200 + "</p><a href='mailto:a@b.de'>m</a></body></html>"
    a, b = [r.s for r in spark.createDataFrame([(0, shell), (1, plain)], "i int, h string").select("i", html.page_signals(F.col("h")).alias("s")).orderBy("i").collect()]
    assert a.empty_root_mount and a.text_length == 0 and a.script_byte_ratio > 0.5 and not a.has_contact_affordance
    assert not b.empty_root_mount and b.text_length > 900 and b.has_contact_affordance and "menu" not in b.visible_text


def test_extract_udf(spark):
    df = spark.createDataFrame([(IMPRINT, "https://muster.de/", "home"), (None, "https://a.de", "home")], "h string, u string, k string")
    rows = df.select(html.extract_udf(2026)("h", "u", "k").alias("f")).collect()
    assert rows[0].f.company_name == "Muster GmbH" and rows[0].f.socials["linkedin"].endswith("muster") and rows[1].f.emails == []


def payload(*urls_):
    return json.dumps({"results": [{"url": u, "title": None, "content": "c"} for u in urls_]})


def test_search(spark):
    good = search.tavily(lambda q, n: (200, payload(f"https://{q}.de", "")))
    bad = search.exa(lambda q, n: (500, "x" * 300))
    queries = spark.createDataFrame([("r", 0, "a"), ("r", 1, "b")], "run_id string, query_idx int, query string")
    hits, errors = search.search(queries, [good, bad])
    assert sorted((r.url, r.title, r.snippet, r.provider_idx, r.hit_idx) for r in hits.collect()) == [("https://a.de", "", "c", 0, 0), ("https://b.de", "", "c", 0, 0)]
    assert [e.message for e in errors.collect()] == ["exa answered 500: " + "x" * 200] * 2
    assert [p.name for p in search.configured({"exa": len, "tavily": len})] == ["tavily", "exa"]


def test_recorded_source(spark, tmp_path):
    f = tmp_path / "a.jsonl"
    f.write_text(json.dumps({"run_id": "r", "query_idx": 0, "provider_idx": 0, "query": "q", "provider": "p", "results": [{"url": None}, {"url": "https://a.de", "text": "t"}]}) + "\n")
    search.register(spark)
    r = spark.read.format("recorded_search").option("path", str(f)).load().collect()
    assert [(x.url, x.snippet, x.hit_idx) for x in r] == [("https://a.de", "t", 0)]


def test_fetch_ladder(spark):
    text = "<p>" + "word " * 200 + "</p>"

    def get(url):
        if url.endswith("/moved"):
            return fetch.Response(302, {}, "", "/home")
        if "blocked" in url:
            return fetch.Response(403, {"Server": "cloudflare"}, "no")
        if "pdf" in url:
            return fetch.Response(200, {"Content-Type": "application/pdf"}, "x")
        if "gone" in url:
            raise OSError("no route")
        if "lost" in url:
            return fetch.Response(404, {"Content-Type": "text/html"}, "x")
        if "shell" in url:
            return fetch.Response(200, {"Content-Type": "text/html"}, "<div id=root></div>")
        return fetch.Response(200, {"Content-Type": "text/html"}, text)

    asked = ["https://a.de/moved", "https://b.de/blocked", "https://c.de/pdf", "https://d.de/gone", "https://e.de/private", "https://f.de/", "https://g.de/", "https://h.de/lost", "https://i.de/shell"]
    req = spark.createDataFrame([(u, u.split("/")[2], "home", 0) for u in asked], "url string, domain string, kind string, page_idx int")
    robots = spark.createDataFrame([("e.de", "User-agent: *\nDisallow: /private")], "domain string, body string")
    hosts = fetch.resolve_hosts(req.select(F.col("domain").alias("host")), lambda h: "10.0.0.1" if h == "f.de" else "8.8.8.8")
    shut = spark.createDataFrame([("g.de",)], "domain string")
    free = fetch.address_guard(lambda h: "8.8.8.8")
    rows = {r.domain: r for r in fetch.fetch_pages(req, get, robots, hosts, "leadspark", shut, refused=free).collect()}
    assert (rows["a.de"].outcome, rows["a.de"].tier, rows["a.de"].final_url, rows["a.de"].report) == ("ok", 0, "https://a.de/home", "success")
    assert (rows["b.de"].outcome, rows["b.de"].html, rows["b.de"].reason) == ("blocked", None, "bot challenge detected (status 403 from cloudflare); tier 2 not configured")
    told = {d: (r.outcome, r.error) for d, r in rows.items()}
    assert told["c.de"] == ("refused", "content-type application/pdf") and told["d.de"] == ("unreachable", "no route") and told["e.de"] == ("robots_disallowed", "disallowed by robots.txt")
    assert told["f.de"] == ("refused", "refused private address 10.0.0.1 for f.de") and told["g.de"] == ("circuit_open", "host circuit breaker open") and told["h.de"] == ("unreachable", "http 404")
    assert (rows["i.de"].outcome, rows["i.de"].tier, rows["i.de"].report) == ("ok", 0, "failure") and rows["i.de"].reason.endswith("; tier 1 failed, kept tier 0")
    page = fetch.Response(200, {"content-type": "text/html"}, text)
    full = {r.domain: (r.outcome, r.tier, r.report) for r in fetch.fetch_pages(req, get, robots, hosts, "leadspark", shut, refused=free, render=lambda u: page, managed=lambda u: page).collect()}
    assert full["b.de"] == ("ok", 2, "failure") and full["i.de"] == ("ok", 1, "success") and len(full) == len(asked)
    assert fetch.follow("https://a.de/", lambda u: fetch.Response(301, {}, "", u), lambda u: None)[2] == "too many redirects"
    bodies = fetch.robots_bodies(spark.createDataFrame([("a.de", "https://a.de"), ("b.de", "https://blocked.de")], "domain string, origin string"), get)
    assert {r.domain: r.body is not None for r in bodies.collect()} == {"a.de": True, "b.de": False}


def test_redirects_are_refused_too(spark):
    def get(url):
        return fetch.Response(302, {}, "", "http://169.254.169.254/latest/meta-data") if "trap" in url else fetch.Response(200, {"Content-Type": "text/html"}, "secret")

    lookup = {"trap.de": "8.8.8.8", "good.de": "1.1.1.1"}
    guard = fetch.address_guard(lambda h: h if h[0].isdigit() else lookup[h])
    req = spark.createDataFrame([("https://trap.de/", "trap.de", "home", 0)], "url string, domain string, kind string, page_idx int")
    none = spark.createDataFrame([], "domain string, body string")
    hosts = spark.createDataFrame([("trap.de", "8.8.8.8")], "host string, address string")
    (r,) = fetch.fetch_pages(req, get, none, hosts, "leadspark", refused=guard).collect()
    assert (r.outcome, r.html, r.error) == ("unreachable", None, "refused private address 169.254.169.254 for 169.254.169.254")
    assert [guard(u) for u in ("https://good.de/x", "ftp://good.de/", "http://a.localhost/", "http://10.0.0.1/")] == [None, "refused scheme: ftp:", "refused host: a.localhost", "refused private address 10.0.0.1 for 10.0.0.1"]


def test_slots_and_retry_after(spark, tmp_path):
    log = tmp_path / "slots"

    def get(url):
        return fetch.Response(429, {"Retry-After": "5"}, "x") if url.endswith("/2") else fetch.Response(200, {"Content-Type": "text/html"}, "<p>" + "word " * 200)

    def wait(slot):
        with open(log, "a") as f:
            f.write(f"{slot}\n")

    req = spark.createDataFrame([(f"https://a.de/{i}?q={i}", "a.de", "other", i) for i in range(2)] + [("https://a.de/2", "a.de", "other", 2), ("https://b.de/", "b.de", "home", 0)], "url string, domain string, kind string, page_idx int")
    robots = spark.createDataFrame([("a.de", "User-agent: *\nDisallow: /1?q=")], "domain string, body string")
    hosts = spark.createDataFrame([("a.de", "8.8.8.8"), ("b.de", "8.8.8.8")], "host string, address string")
    put_off = spark.createDataFrame([("a.de", 7000)], "domain string, floor_ms long")
    rows = {r.url: r for r in fetch.fetch_pages(req, get, robots, hosts, "leadspark", refused=lambda u: None, now_ms=1000, put_off=put_off, wait=wait).collect()}
    assert sorted(map(int, log.read_text().split())) == [1000, 7000, 8500]  # a page that robots.txt shuts, by its query, takes no slot
    assert rows["https://a.de/1?q=1"].outcome == "robots_disallowed" and rows["https://a.de/2"].put_off_ms == 6000 and rows["https://b.de/"].put_off_ms is None


def test_known_addresses(spark):
    hosts = spark.createDataFrame([("a.de",), ("b.de",), ("c.de",), ("a.de",)], "host string")
    known = spark.createDataFrame([("a.de", "1.1.1.1", 900), ("b.de", "2.2.2.2", 100), ("z.de", "3.3.3.3", 950)], "host string, address string, resolved_ms long")
    got = fetch.resolve_hosts(hosts, lambda h: "9.9.9.9", known, now_ms=1000, ttl_ms=500)
    assert sorted(map(tuple, got.collect())) == [("a.de", "1.1.1.1", 900), ("b.de", "9.9.9.9", 1000), ("c.de", "9.9.9.9", 1000)]
    assert {r.address for r in fetch.resolve_hosts(hosts, lambda h: "9.9.9.9", known, now_ms=1000, ttl_ms=500, most=1).collect()} == {"9.9.9.9"}


def test_each_query_is_paid_once(spark, tmp_path):
    calls = tmp_path / "calls"

    def counted(q, n):
        with open(calls, "a") as f:
            f.write(".")
        return 200, payload(f"https://{q}.de")

    queries = spark.createDataFrame([("r", 0, "a")], "run_id string, query_idx int, query string")
    hits, errors = search.search(queries, [search.tavily(counted), search.exa(counted)])
    assert hits.count() == 2 and errors.count() == 0 and hits.collect() and calls.read_text() == ".."


def test_runs_outlive_the_driver(spark, tmp_path):
    e = Engine(spark, planner, [search.tavily(lambda q, n: (200, payload(f"https://{q}.de")))], log=f"file://{tmp_path}/log")
    run, _ = e.begin_run("robots")
    again = Engine(spark, planner, e.providers, log=e.log)
    assert again.runs[run.id].status == "awaiting_approval" and again.runs[run.id].plan == run.plan
    assert again.approve_run(run.id) == (2, None) and Engine(spark, planner, log=e.log).runs[run.id].domains_total == 2


def test_shared_folder_is_needed_off_local():
    class Conf(dict):
        def set(self, k, v):
            self[k] = v

    class Session:
        conf = Conf({"spark.master": "spark://m:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        components.shared_dir(Session)
    Session.conf["spark.master"] = "local-cluster[2,1,1024]"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        components.shared_dir(Session)
    Session.conf["spark.master"] = "local[2]"
    assert components.shared_dir(Session) == Session.conf["spark.checkpoint.dir"]


def test_scratch_tables_go(spark):
    with components.scratch(spark):
        gone, kept = components.stored(spark.range(3)), components.stored(spark.range(4), keep=True)
        assert gone.count() == 3
    assert kept.count() == 4
    with pytest.raises(Exception, match="(?i)not.*exist|FAILED_READ|NotFound"):
        spark.read.parquet(*gone.inputFiles()).count()


def test_store(spark, tmp_path):
    df = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "html string")
    assert store.distinct_bodies(df).count() == 2
    h = df.select(store.content_hash(F.col("html")).alias("content_hash")).first().content_hash
    assert spark.range(1).select(store.content_path(F.lit(h))).first()[0] == f"pages/{h[:2]}/{h[2:4]}/{h}.html"
    store.write_bodies(df, str(tmp_path / "b"))
    assert store.load_bodies(spark, str(tmp_path / "b"), spark.createDataFrame([(h,)], "content_hash string")).count() == 1


def test_llm(spark):
    answer = json.dumps({"company_name": "Acme", "employee_count": 5, "confidence": 0.5})
    packed = spark.createDataFrame([("1", "a.de", "Acme", "x" * 300, ("ai",)), ("2", "b.de", None, "thin", ("ai",)), ("3", "c.de", None, "bad " * 100, ("ai",)), ("4", "d.de", None, "none " * 100, ("ai",))], "domain_id string, domain string, name string, text string, requirements struct<industry:string>")

    def client(system, user):
        if "bad" in user:
            raise RuntimeError("boom")
        return ("" if "none" in user else answer), (10, None, 2)

    r = {x.domain_id: x for x in llm.extract_with_llm(packed, client).collect()}
    assert (r["1"].outcome, r["1"].company.company_name, r["1"].input_tokens, r["1"].output_tokens) == ("ok", "Acme", 10, 0)
    assert (r["2"].outcome, r["3"].outcome, r["3"].error, r["4"].outcome) == ("no_input", "error", "boom", "no_output")
    assert len({p.system for p in llm.prompts(packed).collect()}) == 1
    assert llm.resolve_spec("plan", "p:m").key == "p:m:0.4" and llm.resolve_spec("extract", "m").max_output_tokens == 4096


def planner(system, user):
    if user == "fail":
        raise RuntimeError("no model")
    return json.dumps({"interpretation": user, "search_queries": ["one", "two"], "target_domains": 2, "requirements": {}}), (1, 1, 0)


def test_engine(spark):
    sent = []
    e = Engine(spark, planner, [search.tavily(lambda q, n: (200, payload(f"https://{q}.de", "https://google.com")))], enqueue=lambda d: sent.append(sorted(r.domain for r in d.collect())))
    assert e.begin_run("  ") == (None, "query is required") and e.begin_run("x" * 20_000)[1] == "body too large"
    failed, why = e.begin_run("fail")
    assert (failed.status, why) == ("failed", "no model")
    run, none = e.begin_run(" robots ")
    assert (run.status, run.query, none) == ("awaiting_approval", "robots", None)
    assert e.approve_run(run.id) == (2, None) and sent == [["one.de", "two.de"]] and e.runs[run.id].status == "scraping"
    assert e.approve_run(run.id)[1] == "run is scraping, not awaiting approval" and e.approve_run("x")[1] == "run not found"
    domains = spark.createDataFrame([(run.id, "done"), (run.id, "skipped")], "run_id string, status string")
    assert e.finalize(domains) == [run.id] and e.finalize(domains) == [] and e.cancel_run(run.id) == (False, "run is completed")
    dead = Engine(spark, planner, [search.exa(lambda q, n: (500, "down"))])
    r, _ = dead.begin_run("x")
    assert dead.approve_run(r.id) == (None, "every search failed") and dead.runs[r.id].status == "failed"
    nothing = Engine(spark, planner)
    r, _ = nothing.begin_run("x")
    assert nothing.approve_run(r.id) == (None, "no results") and nothing.cancel_run("y") == (False, "run not found")


def test_config():
    c = EngineConfig.from_env({"WORKER_CONCURRENCY": "x", "PER_HOST_DELAY_MS": "10", "ALLOW_PERSONAL_EMAILS": "1", "TIER1_ALARM_RATIO": "0.5"})
    assert (c.worker_concurrency, c.per_host_delay_ms, c.allow_personal_emails, c.tier1_alarm_ratio) == (4, 10, True, 0.5)
    from leadspark.config import choice

    with pytest.raises(ValueError, match="none of"):
        choice("x", ("a", "b"), "a")


def streamed(spark, tmp_path, batches, schema, step, name, mode="append"):
    src = tmp_path / name
    src.mkdir()
    q = step(spark.readStream.schema(schema).json(str(src))).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-ck")).start()
    try:
        for i, rows in enumerate(batches):
            (src / f"{i}.json").write_text("\n".join(json.dumps(r) for r in rows))
            q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


def test_streaming_twins(spark, tmp_path):
    arrivals = [{"host": "h", "t_ms": t, "request": f"r{i}"} for i, t in enumerate([0, 100, 200, 9000, 9100])]
    got = streamed(spark, tmp_path, [arrivals[:2], arrivals[2:]], "host string, t_ms long, request string", lambda d: jobs.token_bucket(d, idle_ms=None), "bucket")
    batch = politeness.token_bucket(spark.createDataFrame([(a["host"], a["t_ms"], a["request"]) for a in arrivals], "host string, t_ms long, request string"), order=("request",))
    assert sorted(map(tuple, got.select("request", "slot_ms").collect())) == sorted(map(tuple, batch.select("request", "slot_ms").collect()))
    events = [{"host": "h", "seq": i, "t_ms": i * 10, "failed": i < 6} for i in range(8)]
    shut = streamed(spark, tmp_path, [events[:3], events[3:]], "host string, seq long, t_ms long, failed boolean", lambda d: jobs.circuit_breaker(d, idle_ms=None), "breaker")
    fold = politeness.circuit_breaker(spark.createDataFrame([(e["host"], e["seq"], e["t_ms"], e["failed"]) for e in events], "host string, seq long, t_ms long, failed boolean"), t="t_ms")
    assert sorted(map(tuple, shut.select("seq", "rejected", "failures").collect())) == sorted(map(tuple, fold.select("seq", "rejected", "failures").collect()))
    queue = [{"run_id": "r", "domain": d, "ts": "2026-01-01T00:00:00Z"} for d in ("a", "b", "a")]
    assert streamed(spark, tmp_path, [queue[:2], queue[2:]], "run_id string, domain string, ts timestamp", jobs.queued_once, "queue").count() == 2
    guard = [{"ts": f"2026-01-01T00:00:{i:02}Z", "tier1": i % 2 == 0} for i in range(50)] + [{"ts": "2026-01-01T02:00:00Z", "tier1": False}]
    windows = streamed(spark, tmp_path, [guard, [{"ts": "2026-01-01T03:00:00Z", "tier1": False}]], "ts timestamp, tier1 boolean", jobs.rolling_guard, "guard")
    assert windows.filter("alarm").count() == 5


def test_finalize_step(spark):
    closed = []
    domains = spark.createDataFrame([("r", "done"), ("q", "queued")], "run_id string, status string")
    step = jobs.finalize(lambda: domains, lambda d: closed.append([r.run_id for r in d.collect()]))
    step(spark.createDataFrame([("r",), ("q",)], "run_id string"), 0)
    assert closed == [["r"]]
