"""Operators on constructed records: discovery, packing, merging, validation, scoring, deduplication, state and exports."""

import random
import re
from datetime import date

from pyspark.sql import functions as F

from leadspark import schemas
from leadspark.components import placed
from leadspark.operators import dedupe, discover, merge, pages, politeness, read_models, runs, score, validate
from leadspark.sinks import export

HIT = "run_id string, query_idx int, provider_idx int, hit_idx int, url string, title string, snippet string, provider string"


def hits(spark, rows):
    return spark.createDataFrame([("r", q, p, h, u, t, "s", f"p{p}") for q, p, h, u, t in rows], HIT)


def test_discovery_collapses_and_ranks(spark):
    d = hits(spark, [(0, 0, 0, "https://acme.de/blog/post", "Blog"), (0, 0, 1, "https://www.acme.de/", "Home"), (0, 1, 0, "https://linkedin.com/in/x", "L"), (1, 0, 0, "https://acme.de/about", "About"), (1, 0, 1, "https://zeta.com", "Z"), (1, 1, 0, "https://beta.com/x", "B"), (1, 1, 1, "not a url", "N")])
    found = discover.collapse(discover.usable_hits(d)).orderBy("domain").collect()
    assert [(r.domain, r.seed_url, r.hits, r.title, r.source) for r in found] == [("acme.de", "https://www.acme.de/", 3, "Blog", "p0"), ("beta.com", "https://beta.com/x", 1, "B", "p1"), ("zeta.com", "https://zeta.com/", 1, "Z", "p0")]
    assert [r.domain for r in discover.discover(d, 2).orderBy("rank").collect()] == ["acme.de", "beta.com"]
    assert [r.domain for r in discover.discover(d, 1).collect()] == ["acme.de"]  # the second query is never run
    assert discover.discover(d, 0).count() == 0
    t = discover.totals(d).first()
    assert (t.hits_seen, t.queries_run) == (7, 2)


def test_early_stop_is_the_loop(spark):
    rng = random.Random(5)
    rows = [(q, 0, h, f"https://d{rng.randint(0, 15)}.com/", "t") for q in range(6) for h in range(4)]
    d = hits(spark, rows)
    for target in (1, 3, 7, 12, 50):
        seen, last = set(), None
        for q in range(6):
            if len(seen) >= target:
                break
            last = q
            seen |= {u for k, _, _, u, _ in rows if k == q}
        assert discover.issued_queries(discover.usable_hits(d), target, d).first().last_query == last


def test_select_pages(spark):
    links = spark.createDataFrame([("d", 0, "u0", "contact", 90), ("d", 1, "u1", "imprint", 100), ("d", 2, "u2", "contact", 95), ("d", 3, "u3", "other", 0), ("d", 4, "u4", "team", 95)], "domain_id string, pos int, url string, kind string, priority int")
    assert [r.url for r in pages.select_pages(links, 2).orderBy("rank").collect()] == ["u1", "u2"]
    assert pages.select_pages(links, 0).count() == 0


def test_pack(spark):
    rows = [("d", 0, "u0", "home", "Home  text"), ("d", 1, "u1", "imprint", "I" * 300), ("d", 2, "u2", "contact", " \n "), ("d", 3, "u3", "team", "T" * 100)]
    df = spark.createDataFrame(rows, "domain_id string, pos int, url string, kind string, text string")
    r = pages.pack(df, 100).first()
    assert (r.pages_included, r.pages_dropped) == (1, 2) or (r.pages_included, r.pages_dropped) == (2, 1)
    assert r.text.startswith("=== IMPRINT — u1 ===\nIII")
    assert pages.pack(df, 1).first().pages_included == 1  # the first page always stays
    assert pages.pack(df, 10_000).first().text.index("IMPRINT") < pages.pack(df, 10_000).first().text.index("HOME")


FACT = f"domain_id string, page_idx int, source_url string, kind string, company_name string, description string, emails array<{schemas.CONTACT}>, phones array<{schemas.CONTACT}>, address string, country string, city string, founded_year int, socials map<string,string>, links array<{schemas.LINK}>, contact_form_url string, form_only_contact boolean, clean_text string"


def test_merge(spark):
    home = ("d", 0, "https://a.de/", "home", None, "", [("info@a.de", "mailto", "https://a.de/")], [], None, "DE", None, None, {"linkedin": "L1"}, [], None, False, "")
    about = ("d", 1, "https://a.de/about", "about", "Acme", "Desc", [("info@a.de", "regex", "https://a.de/about"), ("sales@a.de", "regex", "https://a.de/about")], [("+49 1", "tel", "https://a.de/about")], None, "AT", "Wien", 1999, {"linkedin": "L2", "github": "G"}, [], "https://a.de/about", True, "")
    company = ("Llm Name", None, "ai", "CH", "Bern", "Addr", 10, None, 2001, None, None, None, [], [], [("Ada L", None, None, None), (" ada l ", "x", None, None), ("", None, None, None)], ["py"], {"twitter": "T", "github": "no"}, True, "fits", 0.8)
    det = spark.createDataFrame([about, home], FACT)
    llm = spark.createDataFrame([("d", company), ("e", None)], f"domain_id string, company {schemas.COMPANY}")
    domains = spark.createDataFrame([("d", "a.de", "https://a.de/"), ("e", "e.de", "https://e.de/")], "domain_id string, domain string, home_url string")
    rows = {r.domain_id: r for r in merge.merge_extraction(det, llm, domains).collect()}
    d = rows["d"]
    assert (d.company_name, d.description, d.country, d.city, d.address, d.founded_year, d.industry, d.employee_count) == ("Acme", "Desc", "DE", "Wien", "Addr", 1999, "ai", 10)
    assert d.emails == ["info@a.de", "sales@a.de"] and d.phones == ["+49 1"] and [p.name for p in d.people] == ["Ada L"]
    assert d.socials == {"linkedin": "L1", "twitter": "T", "github": "G", "facebook": None}
    p = {k: (v.source_url, v.method, v.confidence) for k, v in d.provenance.items()}
    assert p["company_name"] == ("https://a.de/about", "jsonld", 0.95) and p["address"] == ("https://a.de/", "llm", 0.7) and p["description"][1] == "meta"
    assert p["emails"] == p["email:info@a.de"] == ("https://a.de/", "mailto", 0.98) and p["phone:+49 1"][2] == 0.9 and p["social:twitter"][1] == "llm" and "social:facebook" not in p
    e = rows["e"]
    assert (e.matches_requirements, e.match_reason, e.llm_confidence, e.emails, e.company_name) == (False, "no LLM extraction available for this domain", 0.0, [], None)
    o = merge.outcome_of(F.col("emails"), F.col("phones"), F.col("any_form_only"))
    assert {r.domain_id: r.o for r in merge.merge_extraction(det, llm, domains).select("domain_id", o.alias("o")).collect()} == {"d": "ok", "e": "no_contact"}


def test_array_and_map_helpers(spark):
    r = spark.range(1).select(
        merge.ordered_union(F.array(F.lit("b"), F.lit("a")), F.array(F.lit("a"), F.lit("c"))),
        merge.filled_map(F.create_map(F.lit("x"), F.lit(""), F.lit("y"), F.lit("1")), F.create_map(F.lit("x"), F.lit("2"), F.lit("y"), F.lit("3"), F.lit("z"), F.lit(""))),
        merge.left_biased(F.create_map(F.lit("x"), F.lit("1")), F.create_map(F.lit("x"), F.lit("2"), F.lit("y"), F.lit("3"))),
        merge.lower_headers(F.create_map(F.lit("A"), F.array(F.lit("1"), F.lit("2")), F.lit("b"), F.array(F.lit("3")))),
    ).first()
    assert r[:] == (["b", "a", "c"], {"x": "2", "y": "1"}, {"x": "1", "y": "3"}, {"a": "1, 2", "b": "3"})


REQ = ("ai", ["Germany"], ["Berlin"], 20, 100, None, True, 2020, ["ai"], ["consulting"])


def lead(**changed):
    base = {
        "domain": "acme.de", "company_name": "Acme GmbH", "description": "An AI platform", "industry": "ai", "country": "Germany", "city": "Berlin", "address": "Str. 1, Berlin", "employee_count": 50, "employee_range": None,
        "founded_year": 2015, "funding_stage": "seed", "funding_amount": None, "funding_year": 2022, "emails": ["info@acme.de"], "phones": ["+4930123456"], "socials": {"linkedin": "https://linkedin.com/company/acme"}, "people": [("Ada Lovelace", None, None, None)],
        "technologies": ["python"], "contact_form_url": "https://acme.de/contact", "matches_requirements": True, "match_reason": "fits", "llm_confidence": 0.8,
        "provenance": {k: ("u", m, 0.9) for k, m in [("company_name", "jsonld"), ("emails", "mailto"), ("industry", "llm"), ("phones", "tel")]},
    }
    return tuple((base | changed).values())


def scored(spark, *leads_, req=REQ):
    df = spark.createDataFrame(list(leads_), schemas.MERGED)
    v = validate.validate(df, 2026).withColumn("requirements", F.lit(None).cast(schemas.REQUIREMENTS))
    q = spark.createDataFrame([(req,)], f"requirements {schemas.REQUIREMENTS}")
    return score.score(v.drop("requirements").join(F.broadcast(q), F.lit(True), "left")).collect()


def test_score_terms(spark):
    full, unknown, mismatch, excluded = scored(spark, lead(), lead(country=None, city=None, address=None), lead(country="France", city="Paris", address=None), lead(description="consulting"))
    b = full.score_breakdown
    assert (b.industry, b.geography, b.size, b.funding, b.contactability) == (22, 18, 15, 15, 20) and full.score == b.total
    # 0.55 * 3/4 + 0.3 * 4/12 + 0.15 * 0.8
    assert b.evidence == 6.33 and full.score == 96.33
    assert unknown.score_breakdown.geography == 8.1 and mismatch.score_breakdown.geography == 0
    assert excluded.score_breakdown.penalties == -25
    near, far, open_range = scored(spark, lead(employee_count=110), lead(employee_count=5000), lead(employee_count=None, employee_range="500+"))
    assert near.score_breakdown.size == 7.5 and far.score_breakdown.size == 0 and open_range.score_breakdown.size == 0
    old, undated = scored(spark, lead(funding_year=2018), lead(funding_year=None))
    assert old.score_breakdown.funding == 3.0 and undated.score_breakdown.funding == 9.0
    weak = scored(spark, lead(matches_requirements=False, industry=None, description=None, technologies=[]))[0]
    assert weak.score_breakdown.industry == 9.9
    free = scored(spark, lead(), req=(None, [], [], None, None, None, False, None, [], []))[0]
    assert (free.score_breakdown.industry, free.score_breakdown.geography, free.score_breakdown.size, free.score_breakdown.funding) == (22, 18, 15, 15)


def test_validation(spark):
    bad = lead(company_name=" Acme – Home", emails=["info@agency.com", "bad", "info@acme.de"], phones=["030 1", "+49 30 1234567", "0049 30 1234567"], socials={"linkedin": "https://evil.com/x", "github": None}, employee_count=0, founded_year=1500, funding_year=2100, people=[("Our Team", None, None, None), ("Ada Lovelace", None, None, None)])
    r = validate.validate(spark.createDataFrame([bad], schemas.MERGED), 2026).first()
    assert r.emails == ["info@acme.de"] and r.phones == ["+49301234567", "+49301234567"] and r.socials == {"linkedin": None, "github": None}
    assert (r.employee_count, r.founded_year, r.funding_year, r.company_name) == (None, None, None, "Acme") and [p.name for p in r.people] == ["Ada Lovelace"]
    assert [i.field for i in r.issues] == ["emails", "emails", "phones", "socials.linkedin", "employee_count", "founded_year", "funding_year", "people"]
    early = validate.validate(spark.createDataFrame([lead(founded_year=2010, funding_year=2005)], schemas.MERGED), 2026).first()
    assert early.funding_year is None and early.founded_year == 2010


def _greedy(rows):
    """The fold over all leads at once."""
    return sorted(dedupe.fold(rows))


def test_dedupe_plans_equal_the_global_fold(spark):
    rng = random.Random(3)
    rows = [(f"l{i:02}", float(rng.randint(0, 9)), f"d{i:02}.com", [f"e{rng.randint(0, 12)}@x.com" for _ in range(rng.randint(0, 2))], rng.choice([None, "Acme GmbH", "Beta Inc", "Gamma", "Delta Systems"])) for i in range(40)]
    df = spark.createDataFrame([("r", i, d, s, e, n) for i, s, d, e, n in rows], "run_id string, id string, domain string, score double, emails array<string>, company_name string")
    keys = {"Acme GmbH": "acme", "Beta Inc": "beta", "Gamma": "gamma", "Delta Systems": "delta systems", None: None}
    got = sorted((r.id, r.survivor_id, r.place) for r in dedupe.plan_dedupe(df).collect())
    assert got == _greedy([(i, s, d, e, keys[n]) for i, s, d, e, n in rows])


def lead_rows(spark, rows):
    full = [("r", i, d, s, n, web, e, [], [], {"linkedin": li}, [], {}, None, []) for i, d, s, n, web, e, li in rows]
    return spark.createDataFrame(full, f"run_id string, id string, domain string, score double, company_name string, website string, emails array<string>, phones array<string>, technologies array<string>, socials map<string,string>, people array<{schemas.PERSON}>, provenance {schemas.PROVENANCE}, merged_into string, merged_domains array<string>")


def test_dedupe_absorbs(spark):
    df = lead_rows(spark, [("a", "a.de", 50.0, "Acme", None, ["info@acme.de"], None), ("b", "b.de", 40.0, "Other", "https://b.de", ["INFO@acme.de", "x@b.de"], "L"), ("c", "c.de", 30.0, "Zeta Corp", None, [], None)])
    done, events = dedupe.dedupe_runs(df)
    rows = {r.id: r for r in done.collect()}
    assert (rows["a"].website, rows["a"].emails, rows["a"].socials, rows["a"].merged_domains, rows["a"].merged_into) == ("https://b.de", ["info@acme.de", "INFO@acme.de", "x@b.de"], {"linkedin": "L"}, ["b.de"], None)
    assert rows["b"].merged_into == "a" and rows["c"].merged_into is None and rows["a"].score == 50.0
    assert [e.message for e in events.collect()] == ["merged 1 into a"]


def absorbed_plainly(rows):
    """The contract of merging, one lead after another; rows by id as dicts."""
    out = {i: dict(r, socials=dict(r["socials"]), provenance=dict(r["provenance"]), merged_into=None, merged_domains=[]) for i, r in rows.items()}
    for i, top, place in sorted(dedupe.fold([(r["id"], r["score"], r["domain"], [e.lower() for e in r["emails"]], r["company_name"]) for r in rows.values()]), key=lambda x: x[2]):
        if not place:
            continue
        a, b = out[top], rows[i]
        out[i]["merged_into"] = top
        a["merged_domains"] = [*a["merged_domains"], b["domain"]]
        for c in ("emails", "phones", "technologies"):
            a[c] = a[c] + [v for v in dict.fromkeys(b[c]) if v not in a[c]]
        a["socials"] = {k: (a["socials"].get(k) or None) or b["socials"].get(k) or None for k in [*a["socials"], *(k for k, v in b["socials"].items() if v and k not in a["socials"])]}
        for p in b["people"]:
            if p[0].strip() and p[0].strip().lower() not in [q[0].strip().lower() for q in a["people"]]:
                a["people"] = [*a["people"], p]
        a["provenance"] = {k: a["provenance"].get(k) or b["provenance"].get(k) for k in [*a["provenance"], *(k for k in b["provenance"] if k not in a["provenance"])]}
        for c in ("company_name", "website"):
            a[c] = b[c] if a[c] is None else a[c]
    return out


def test_dedupe_of_hot_keys_and_chains(spark):
    rng = random.Random(5)
    columns = ["run_id", "id", "domain", "score", "company_name", "website", "emails", "phones", "technologies", "socials", "people", "provenance", "merged_into", "merged_domains"]
    rows = []
    for i in range(240):
        # a third on one address, a chain of addresses each shared by two neighbours, and some of their own
        emails = ["hot@x.com"] * (i % 3 == 0) + ([f"c{i}@x.com", f"c{i + 3}@x.com"] if i % 3 == 1 else []) + [f"E{rng.randint(0, 400)}@x.com"] * (i % 5 == 0)
        rows.append(("r", f"l{i:03}", f"d{i % 50}.com", float(300 - i if i % 3 == 1 else rng.randint(0, 400)), rng.choice([None, None, "gamma", "delta systems", f"name{i}"]), rng.choice([None, f"w{i}"]), rng.sample(emails, len(emails)),
                     [str(rng.randint(0, 9)) for _ in range(rng.randint(0, 3))], [rng.choice("abc")], {k: rng.choice([None, "", f"{k}{i}"]) for k in rng.sample(["linkedin", "github", "twitter"], rng.randint(0, 3))},
                     [(rng.choice(["Ada", " ada ", "Bob", " ", f"P{i}"]), str(i), None, None) for _ in range(rng.randint(0, 2))], {k: rng.choice([None, (f"u{i}", "m", 0.5)]) for k in rng.sample("xyz", rng.randint(0, 2))}, None, []))
    df = lead_rows(spark, []).unionByName(spark.createDataFrame(rows, lead_rows(spark, []).schema))
    want = absorbed_plainly({r[1]: dict(zip(columns, r, strict=True)) for r in rows})
    done, _ = dedupe.dedupe_runs(df)
    got = {r.id: r for r in done.collect()}
    assert len(got) == len(rows) and max(len(w["merged_domains"]) for w in want.values()) > 70
    for i, w in want.items():
        g = got[i].asDict(recursive=False)
        g["people"] = [tuple(p) for p in g["people"]]
        g["provenance"] = {k: v and tuple(v) for k, v in g["provenance"].items()}
        if not w["merged_domains"]:
            w = dict(w, socials=g["socials"]) if {k: v or None for k, v in w["socials"].items()} == {k: v or None for k, v in g["socials"].items()} else w
        assert g == w, i
    # no group of leads is one task's or one row's work
    plan = dedupe.plan_dedupe(df)._jdf.queryExecution().toString()
    assert "FlatMapGroups" not in plan and "Python" not in plan
    assert not re.search(r"collect_list\(struct\(place, place#\d+, id,", done._jdf.queryExecution().toString())


def test_dedupe_takes_no_nulls_for_keys(spark):
    df = spark.createDataFrame([("r", "a", "a.de", 2.0, [None], None), ("r", "b", "b.de", 1.0, [None], None), ("r", "c", "c.de", None, None, "Gamma"), ("r", "d", "d.de", 1.0, ["x@d.de"], "Gamma")], "run_id string, id string, domain string, score double, emails array<string>, company_name string")
    assert sorted((r.id, r.survivor_id, r.place) for r in dedupe.plan_dedupe(df).collect()) == [("a", "a", 0), ("b", "b", 0), ("c", "d", 1), ("d", "d", 0)]


def test_places_are_counted_over_ranges(spark):
    rng = random.Random(7)
    rows = [("hot" if i % 10 else f"k{i}", rng.random(), i) for i in range(500)]
    want = {i: sorted(r[1] for r in rows if r[0] == k).index(x) for k, x, i in rows}
    ranked = placed(spark.createDataFrame(rows, "k string, x double, i int").repartition(3), ["k"], F.col("x"))
    assert {r.i: r.place for r in ranked.collect()} == want and ranked.columns.count("k") == 1


def test_run_tables(spark):
    ev = spark.createDataFrame([("r", 1, 10, "discovering", None), ("r", 2, 20, "scraping", "e"), ("r", 3, 30, "completed", None), ("q", 1, 5, "planning", None)], "run_id string, seq int, t int, status string, error string").withColumn("ts", F.timestamp_seconds("t"))
    r = {x.run_id: x for x in runs.fold_run_status(ev).collect()}
    assert (r["r"].status, r["r"].error, r["r"].approved_at.second, r["r"].finished_at.second) == ("completed", "e", 10, 30) and r["q"].approved_at is None
    old = spark.createDataFrame([("1", "a", "x")], "id string, company_name string, industry string")
    new = spark.createDataFrame([("1", "b", "y"), ("2", "c", "z")], "id string, company_name string, industry string")
    assert sorted(map(tuple, runs.upsert(old, new, ["id"]).collect())) == [("1", "b", "x"), ("2", "c", "z")]
    doms = spark.createDataFrame([("r", "a.de", "queued"), ("r", "b.de", "done"), ("q", "c.de", "failed")], "run_id string, domain string, status string")
    assert sorted(x.status for x in runs.skip_queued(doms, "r").collect()) == ["done", "failed", "skipped"]
    assert [x.run_id for x in runs.finished_runs(doms).collect()] == ["q"]
    assert runs.finished_runs(doms.limit(0)).count() == 0
    table, fresh = runs.start_run(spark.createDataFrame([("i", "r", "a.de", "u", "p", "queued")], "id string, run_id string, domain string, seed_url string, source string, status string"), spark.createDataFrame([("a.de", "u", "p"), ("n.de", "u", "p"), ("n.de", "u", "p")], "domain string, seed_url string, source string"), "r")
    assert (table.count(), [x.domain for x in fresh.collect()]) == (2, ["n.de"])
    c = spark.createDataFrame([("r", "done", False, 3, 1, 0, 5, 6, 7), ("r", "failed", False, 1, 0, 1, 0, 0, 0), ("r", "done", True, 2, 2, 0, 0, 0, 0)], "run_id string, outcome_status string, cancelled boolean, pages int, tier1_pages int, tier2_pages int, llm_input_tokens int, llm_output_tokens int, llm_cached_tokens int")
    t = runs.run_counters(c).first()
    assert (t.domains_done, t.domains_failed, t.pages_fetched, t.tier1_pages, t.llm_input_tokens) == (1, 1, 6, 3, 5)
    flushed = runs.flush_counters(spark.createDataFrame([("r", 0, 0, 0, 0, 0, 0, 0, 0), ("z", 9, 9, 9, 9, 9, 9, 9, 9)], "id string, domains_done int, domains_failed int, pages_fetched int, tier1_pages int, tier2_pages int, llm_input_tokens bigint, llm_output_tokens bigint, llm_cached_tokens bigint"), runs.run_counters(c))
    assert {x.id: x.pages_fetched for x in flushed.collect()} == {"r": 6, "z": 9}


def test_state_machine(spark):
    steps = [("planning", "planned"), ("awaiting_approval", "approved"), ("discovering", "found"), ("scraping", "all_done"), ("completed", "cancel"), ("scraping", "cancel"), ("discovering", "found_nothing"), ("planning", "approved")]
    df = spark.createDataFrame([(i, *s) for i, s in enumerate(steps)], "i int, s string, e string")
    assert [r.n for r in df.select("i", runs.next_status(F.col("s"), F.col("e")).alias("n")).orderBy("i").collect()] == ["awaiting_approval", "discovering", "scraping", "completed", "completed", "cancelled", "failed", "planning"]
    assert runs.may_move("scraping", "cancelled") and not runs.may_move("completed", "failed")


def test_token_bucket_and_retry_after(spark):
    df = spark.createDataFrame([("h", 0, 0), ("h", 100, 1), ("h", 5000, 2), ("g", 7, 3)], "host string, t_ms long, seq int")
    assert [r.slot_ms for r in politeness.token_bucket(df, 1500, order=("seq",)).orderBy("seq").collect()] == [0, 1500, 5000, 7]
    late = df.withColumn("floor_ms", F.when(F.col("seq") == 1, 9000))
    assert [r.slot_ms for r in politeness.token_bucket(late, 1500, order=("seq",)).orderBy("seq").collect()] == [0, 9000, 10500, 7]
    r = spark.range(1).select(*(politeness.retry_after_ms(F.lit(1000), F.lit(v)) for v in ("5", "900", "Thu, 01 Jan 1970 00:01:00 GMT", "soon"))).first()
    assert r[:] == (6000, 121000, 60000, None)


def test_guard_and_breaker(spark):
    df = spark.createDataFrame([(i * 1000, i % 3 == 0) for i in range(60)], "t_ms long, tier1 boolean")
    rows = politeness.rolling_ratio(df).orderBy("t_ms").collect()
    assert not rows[38].alarm and rows[39].alarm and rows[39].samples == 40
    flags = [True, True, True, True, True, False, True, False]
    times = [0, 1, 2, 3, 4, 5, 300_004, 300_005]
    ev = spark.createDataFrame([("h", i, t, f) for i, (t, f) in enumerate(zip(times, flags, strict=True))], "host string, seq long, t_ms long, failed boolean")
    got = politeness.circuit_breaker(ev, t="t_ms").orderBy("seq").collect()
    assert [r.rejected for r in got] == [False] * 4 + [True, True] + [False, False] and [r.failures for r in got] == [1, 2, 3, 4, 4, 4, 1, 0]


def test_guard_sums_run_on(spark):
    """Counts of the window are running sums: no frame slides, which would be counted anew for each event. Times may be null and tie."""
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "a", None]), rng.choice([None, rng.randrange(-50, 200), rng.randrange(20) * 10]), rng.choice([True, False, None])) for i in range(400)]
    got = politeness.rolling_ratio(spark.createDataFrame(rows, "id long, guard string, t_ms long, tier1 boolean"), 30, 5, by=("guard",))
    frames = got._jdf.queryExecution().optimizedPlan().toString()
    assert "RangeFrame, unboundedpreceding$()" in frames and "RangeFrame, -" not in frames
    want = {}
    for i, guard, t, _ in rows:
        seen = [h for _, g, u, h in rows if g == guard and (u is None if t is None else u is not None and t - 30 <= u <= t)]
        known = [h for h in seen if h is not None]
        ratio = sum(known) / len(known) if known else None
        want[i] = (len(seen), ratio, None if ratio is None and len(seen) >= 5 else len(seen) >= 5 and ratio > 0.25)
    assert {r.id: (r.samples, r.ratio, r.alarm) for r in got.collect()} == want


def test_read_models(spark):
    df = spark.createDataFrame([("a", "r", "Zeta", "z.de", "ai", None, None, None, ["x@z.de"], [], 80.0), ("b", "r", None, "acme.de", None, "Berlin", None, None, [], ["Spark"], 80.0), ("c", "r", "Beta", "b.de", None, None, None, None, [], [], 10.0)], "id string, run_id string, company_name string, domain string, industry string, city string, country string, description string, emails array<string>, technologies array<string>, score double").withColumn("merged_into", F.when(F.col("id") == "c", "a"))
    assert [r.id for r in read_models.list_leads(df, "r").collect()] == ["a", "b", "c"]  # a null name is last
    assert [r.id for r in read_models.list_shippable_leads(df, "r").collect()] == ["a", "b"]
    assert [r.id for r in read_models.filter_leads(df, " SPARK ").collect()] == ["b"]
    assert read_models.filter_leads(df, "", float("nan")).count() == 3 and read_models.filter_leads(df, "", 50).count() == 2
    assert [r.id for r in read_models.rank_leads(df, "company_name").collect()] == ["c", "a", "b"]
    assert [r.id for r in read_models.rank_leads(df, "company_name", True).collect()] == ["a", "c", "b"]
    recent = spark.createDataFrame([("1", "completed", 1), ("2", "scraping", 2)], "id string, status string, created_at int")
    assert read_models.default_run(recent).first().id == "1" and read_models.default_run(recent, "2").first().id == "2"


def test_csv_export(spark, tmp_path):
    cells = spark.createDataFrame([("=1+1",), ('say "hi"',), (None,), ("",), ("+49",)], "v string")
    assert [r.c for r in cells.select(export.csv_cell(F.col("v")).alias("c")).collect()] == ['"\t=1+1"', '"say ""hi"""', "", '""', '"\t+49"']
    row = ("l", "r", "Acme", "acme.de", None, 96.5, ["a@x", "b@x"], {"linkedin": "L"}, None)
    df = spark.createDataFrame([row], "id string, run_id string, company_name string, domain string, website string, score double, emails array<string>, socials map<string,string>, merged_into string")
    for c in export.EXPORT_COLUMNS:
        if c not in df.columns and c != "linkedin":
            df = df.withColumn(c, F.lit(None).cast("array<string>" if c in ("phones", "technologies", "merged_domains") else "string"))
    export.write_csv(df, "r", str(tmp_path / "csv"))
    data = next((tmp_path / "csv").glob("part-*")).read_bytes().decode("utf-8-sig")
    head, line = data.rstrip("\r\n").split("\r\n")
    assert head.split(",") == export.EXPORT_COLUMNS and line.startswith('"Acme","acme.de",,"96.5",') and '"a@x; b@x"' in line and '"L"' in line
    doc = export.json_document(spark.createDataFrame([("r", "q", None)], "id string, query string, finished_at timestamp"), df, "r").first().document
    assert doc.startswith('{"run":{"id":"r","query":"q"') and '"company_name":"Acme"' in doc
    assert export.json_document(spark.createDataFrame([("r", "q", None)], "id string, query string, finished_at timestamp"), df, "none").count() == 0
    assert export.file_name("0123456789", "xml", date(2026, 1, 2)) == "leads-01234567-2026-01-02.json"
