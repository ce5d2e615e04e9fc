"""Runs that are cancelled and finished, and answers that are paid for once."""

import json

import pytest
from pyspark.sql import functions as F

from leadspark.engine import Engine
from leadspark.operators import run_ends, runs
from leadspark.schemas import DOMAINS, LEADS, RUNS
from leadspark.sources import fetch, llm

COUNTERS = "run_id string, domains_done long, domains_failed long, pages_fetched long, tier1_pages long, tier2_pages long, llm_input_tokens long, llm_output_tokens long, llm_cached_tokens long"


def noon():
    return F.lit("2024-05-01 12:00:00").cast("timestamp")


def rows(spark, schema, *given):
    """Rows of a table from what is given of each; the rest is null."""
    empty = spark.createDataFrame([], schema)
    names = empty.columns
    return spark.createDataFrame([tuple(g.get(c) for c in names) for g in given], schema)


@pytest.fixture(scope="module")
def tables(spark):
    run = rows(spark, RUNS, *({"id": i, "status": s, "domains_done": 7} for i, s in [("over", "scraping"), ("early", "discovering"), ("busy", "scraping"), ("none", "scraping"), ("old", "completed"), ("bad", "failed"), ("plan", "planning"), ("gone", "cancelled")]))
    states = {"over": ["done", "failed", "blocked", "skipped"], "early": ["done"], "busy": ["done", "queued", "fetching"], "old": ["done"], "bad": ["done"], "plan": ["queued"], "gone": ["done", "done"]}
    domains = rows(spark, DOMAINS, *({"id": f"{r}{i}", "run_id": r, "domain": f"{r}{i}.com", "status": s} for r, ss in states.items() for i, s in enumerate(ss)))
    empty = {"emails": [], "phones": [], "technologies": [], "people": [], "socials": {}, "provenance": {}, "merged_domains": []}
    leads = rows(
        spark, LEADS.replace("decimal(5,2)", "double"),
        *(empty | {"id": i, "run_id": r, "domain": f"{i}.com", "company_name": n, "score": s, "merged_into": m} for i, r, n, s, m in [
            ("a", "over", "Acme GmbH", 5.0, None), ("b", "over", "Acme", 4.0, None), ("c", "over", "Other", 3.0, None), ("z", "over", "Acme", 1.0, "x"), ("d", "busy", "Same", 2.0, None), ("e", "busy", "Same", 1.0, None), ("f", "gone", "Solo Works", 1.0, None), ("g", "gone", "Solo Works", 2.0, None)
        ]),
    )
    counters = spark.createDataFrame([(r, 1, 2, 3, 0, 0, 10, 11, 12) for r in ("over", "busy", "gone")], COUNTERS)
    return run, domains, leads, counters


def state(df):
    return {r.id: (r.status, r.finished_at is not None, r.domains_done) for r in df.collect()}


def told(df):
    return sorted((r.run_id, r.level, r.stage, r.message) for r in df.collect())


def test_finish(spark, tables):
    run, domains, leads, counters = tables
    e = run_ends.finish(run, domains, leads, counters, now=noon())
    assert state(e.runs) == {"over": ("completed", True, 1), "early": ("completed", True, 7), "busy": ("scraping", False, 7), "none": ("scraping", False, 7), "old": ("completed", False, 7), "bad": ("failed", False, 7), "plan": ("planning", False, 7), "gone": ("cancelled", True, 1)}
    assert {r.id: r.merged_into for r in e.leads.collect()} == {"a": None, "b": "a", "c": None, "z": "x", "d": None, "e": None, "f": "g", "g": None}
    assert [r.run_id for r in e.counters.collect()] == ["busy"]
    assert told(e.events) == [
        ("early", "info", "run", "run finished"), ("gone", "info", "dedupe", "g.com absorbed f.com"), ("gone", "info", "dedupe", "merged 1 duplicate lead(s)"), ("gone", "info", "run", "run finished"),
        ("over", "info", "dedupe", "a.com absorbed b.com"), ("over", "info", "dedupe", "merged 1 duplicate lead(s)"), ("over", "info", "run", "run finished"),
    ]
    again = run_ends.finish(e.runs, e.domains, e.leads, e.counters, e.events, now=noon())
    assert state(again.runs) == state(e.runs) and again.events.count() == 0 and again.closed.count() == 0
    assert sorted(map(str, again.leads.collect())) == sorted(map(str, e.leads.collect()))


def test_cancel_then_finish(spark, tables):
    run, domains, leads, counters = tables
    asked = spark.createDataFrame([("busy",), ("busy",), ("old",), ("nowhere",), ("plan",)], "run_id string")
    e = run_ends.cancel(run, domains, asked, counters, now=noon())
    assert {r.run_id for r in e.closed.collect()} == {"busy", "plan"}
    assert {r.id: (r.status, r.note) for r in e.domains.filter("run_id = 'busy'").collect()} == {"busy0": ("done", None), "busy1": ("skipped", "run cancelled before start"), "busy2": ("fetching", None)}
    assert state(e.runs)["busy"] == ("cancelled", True, 1) and state(e.runs)["plan"][0] == "cancelled" and state(e.runs)["old"] == ("completed", False, 7)
    assert told(e.events) == [("busy", "warn", "cancel", "cancelled; 1 queued domains dropped"), ("plan", "warn", "cancel", "cancelled; 1 queued domains dropped")]
    # the domain at work ends, and adds to the counters after the cancel
    later = runs.updated(e.domains, F.col("status") == "fetching", status=F.lit("done"))
    more = counters.withColumn("domains_done", F.when(F.col("run_id") == "busy", 5).otherwise(F.col("domains_done")).cast("long"))
    assert "busy" not in {r.run_id for r in run_ends.finish(e.runs, e.domains, leads, more, e.events, now=noon()).closed.collect()}
    f = run_ends.finish(e.runs, later, leads, more, e.events, now=noon())
    assert state(f.runs)["busy"] == ("cancelled", True, 5) and ("busy", "info", "run", "run finished") in told(f.events)
    assert {r.id: r.merged_into for r in f.leads.filter("run_id = 'busy'").collect()} == {"d": None, "e": "d"}
    twice = run_ends.cancel(f.runs, f.domains, asked, f.counters, now=noon())
    assert twice.closed.count() == 0 and twice.events.count() == 0 and state(twice.runs) == state(f.runs)


def test_empty_tables(spark, tables):
    run, domains, leads, counters = (t.limit(0) for t in tables)
    e = run_ends.finish(run, domains, leads, counters)
    assert e.runs.count() == e.leads.count() == e.events.count() == 0
    c = run_ends.cancel(run, domains, spark.createDataFrame([], "run_id string"), counters)
    assert c.runs.count() == c.domains.count() == c.events.count() == 0


def test_engine_ends_runs_and_keeps_their_events(spark, tmp_path, tables):
    def planner(system, user):
        return json.dumps({"interpretation": user, "search_queries": ["one"], "target_domains": 1, "requirements": {}}), (1, 1, 0)

    e = Engine(spark, planner, log=f"file://{tmp_path}/log")
    one, two = e.begin_run("one")[0], e.begin_run("two")[0]
    e._change(e.runs[one.id], status="scraping")
    domains = rows(spark, DOMAINS, {"id": "1", "run_id": one.id, "domain": "a.com", "status": "done"}, {"id": "2", "run_id": two.id, "domain": "b.com", "status": "queued"})
    counters = spark.createDataFrame([(one.id, 1, 0, 3, 0, 0, 10, 11, 12)], COUNTERS)
    leads = tables[2].limit(0)
    ended, error = e.cancel(two.id, domains, counters)
    assert error is None and e.runs[two.id].status == "cancelled" and e.cancel("nowhere", domains, counters) == (None, "run not found")
    done = e.finish(ended.domains, leads, counters)
    assert e.runs[one.id].status == "completed" and e.runs[two.id].status == "cancelled" and {r.run_id for r in done.closed.collect()} == {one.id, two.id}
    assert e.finish(ended.domains, leads, counters).closed.count() == 0
    again = Engine(spark, planner, log=e.log)
    messages = [(r.run_id, r.message) for r in again.event_table().collect()]
    assert messages.count((one.id, "run finished")) == messages.count((two.id, "run finished")) == 1 and (two.id, "cancelled; 1 queued domains dropped") in messages


# --- answers that are paid for -----------------------------------------------------------------------------------------


def test_rendered_and_managed_pages_are_paid_for_once(spark, tmp_path):
    calls, text = tmp_path / "calls", "<p>" + "word " * 200

    def counted(name):
        def get(url):
            with open(calls, "a") as f:
                f.write(name)
            return fetch.Response(200, {"content-type": "text/html"}, text)

        return get

    def get(url):
        return fetch.Response(403, {"Server": "cloudflare"}, "no") if "blocked" in url else fetch.Response(200, {"Content-Type": "text/html"}, "<div id=root></div>")

    req = spark.createDataFrame([("https://a.de/blocked", "a.de", "home", 0), ("https://b.de/shell", "b.de", "home", 0)], "url string, domain string, kind string, page_idx int")
    hosts = spark.createDataFrame([("a.de", "8.8.8.8"), ("b.de", "8.8.8.8")], "host string, address string")
    pages = fetch.fetch_pages(req, get, spark.createDataFrame([], "domain string, body string"), hosts, "leadspark", refused=lambda u: None, render=counted("r"), managed=counted("m"))
    assert {(r.domain, r.tier) for r in pages.collect()} == {("a.de", 2), ("b.de", 1)} and pages.count() == 2 and pages.filter("html is not null").count() == 2
    assert sorted(calls.read_text()) == ["m", "r"]


def test_the_model_is_asked_once(spark, tmp_path):
    calls = tmp_path / "calls"

    def client(system, user):
        with open(calls, "a") as f:
            f.write(".")
        return json.dumps({"company_name": "Acme"}), (10, 1, 2)

    packed = spark.createDataFrame([("1", "a.de", "Acme", "x" * 300, ("ai",)), ("2", "b.de", None, "thin", ("ai",))], "domain_id string, domain string, name string, text string, requirements struct<industry:string>")
    said = llm.extract_with_llm(packed, client)
    assert said.count() == 2 and {r.outcome for r in said.collect()} == {"ok", "no_input"} and said.filter("outcome = 'ok'").count() == 1
    assert calls.read_text() == "."
