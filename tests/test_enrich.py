"""The whole way from domains to leads with recorded pages and a stub model; SQL functions; retention."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from leadspark import schemas
from leadspark.config import EngineConfig
from leadspark.functions import registry
from leadspark.operators import runs
from leadspark.plans import enrich
from leadspark.schemas import create_tables

HOME = '<title>Acme GmbH | Home</title><nav><a href="/impressum">Impressum</a><a href="/team">Team</a></nav><p>' + "We build robots. " * 40 + '</p><a href="mailto:info@acme.de">m</a>'
SITES = {"https://acme.de/": HOME, "https://acme.de/impressum": "<p>Acme GmbH, founded 2015, +49 30 1234567</p>", "https://acme.de/team": "<p>Ada Lovelace</p>", "https://form.de/": "<form>message</form>" + "<p>text</p>" * 90}


def fetch(requests):
    sites = requests.sparkSession.createDataFrame(list(SITES.items()), "url string, html string")
    return requests.join(sites, "url", "left").select("url", "domain", "kind", "page_idx", F.col("url").alias("final_url"), F.lit(0).alias("tier"), F.when(F.col("html").isNotNull(), "ok").otherwise("blocked").alias("outcome"), F.lit(200).alias("status"), "html", F.lit(None).cast("string").alias("error"))


def client(system, user):
    return json.dumps({"industry": "robotics", "employee_count": 40, "matches_requirements": True, "match_reason": "builds robots", "confidence": 0.9, "people": [{"name": "Ada Lovelace", "role": "CEO"}], "technologies": []}), (100, 10, 0)


def test_process_domains(spark):
    domains = spark.createDataFrame([("r", "1", "acme.de", "https://acme.de/"), ("r", "2", "form.de", "https://form.de/"), ("r", "3", "shut.de", "https://shut.de/"), ("q", "4", "off.de", "https://off.de/")], "run_id string, domain_id string, domain string, seed_url string")
    req = spark.createDataFrame([(r, ("robotics", ["Germany"], [], 10, 100, None, False, None, [], [])) for r in "rq"], f"run_id string, requirements {schemas.REQUIREMENTS}")
    got = enrich.process_domains(domains, req, fetch, client, EngineConfig(current_year=2026), spark.createDataFrame([("q",)], "run_id string"))
    leads = {r.domain: r for r in got.leads.collect()}
    acme = leads["acme.de"]
    assert (acme.company_name, acme.emails, acme.phones, acme.founded_year, acme.employee_count, acme.website, acme.match_reason) == ("Acme GmbH", ["info@acme.de"], ["+49301234567"], 2015, 40, "https://acme.de/", "builds robots")
    assert acme.provenance["founded_year"].source_url == "https://acme.de/impressum" and acme.score > 60 and len(acme.id) == 64
    assert [p.name for p in acme.people] == ["Ada Lovelace"] and set(leads) == {"acme.de", "form.de"}
    out = {r.domain_id: r for r in got.outcomes.collect()}
    assert [(out[k].outcome, out[k].outcome_status, out[k].cancelled) for k in "123"] == [("ok", "done", False), ("form_only", "done", False), ("blocked", "failed", False)]
    assert out["4"].cancelled and out["4"].outcome_status == "skipped" and out["1"].pages == 3
    c = {r.run_id: r for r in runs.run_counters(got.outcomes).collect()}
    assert (c["r"].domains_done, c["r"].domains_failed, c["r"].pages_fetched, c["r"].llm_input_tokens) == (2, 1, 5, 200)
    assert got.pages.filter("blocked").count() == 0


def test_sql_functions(spark):
    registry.register(spark)
    page = '<script type="application/ld+json">[{"@type":"A"},{"b":{"c":1}}]</script>'
    assert [r.node for r in spark.sql(f"SELECT * FROM explode_jsonld('{page}')").orderBy("pos").collect()] == ['{"@type": "A"}', '{"b": {"c": 1}}', '{"c": 1}']
    assert [tuple(r) for r in spark.sql("SELECT field, value FROM robots_lines('User-Agent: *\\nDisallow: /x # y\\nzzz')").collect()] == [("user-agent", "*"), ("disallow", "/x")]
    assert spark.sql("SELECT canonical_url('../b', 'https://a.de/x/y'), link_kind('https://a.de/team', '')").first()[:] == ("https://a.de/b", "team")


def test_tables_and_retention(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS lead_test LOCATION '{tmp_path}/db'")
    create_tables(spark, "lead_test")
    create_tables(spark, "lead_test")
    assert {r.tableName for r in spark.sql("SHOW TABLES IN lead_test").filter("not isTemporary").collect()} == set(schemas.TABLES)
    spark.sql("DROP DATABASE lead_test CASCADE")
    jobs = spark.createDataFrame([(i, datetime(2026, 1, 1 + i)) for i in range(5)], "id int, ended timestamp")
    now = F.lit(datetime(2026, 1, 5))
    assert sorted(r.id for r in enrich.expired(jobs, "ended", now, 2 * 86400).collect()) == [0, 1]
    assert sorted(r.id for r in enrich.expired(jobs, "ended", now, 10 * 86400, 3).collect()) == [0, 1]
