"""More registered queries: read models, record merging, deduplication, adapters with recorded answers, scanners."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark import constants as C
from leadspark.functions import challenge, contacts, presentation, robots, text, urls
from leadspark.operators import dedupe, merge, read_models, runs
from leadspark.sinks import export
from leadspark.sources import fetch, llm, search

from .catalog import _HOST, _PATH, _TERMS, _in, _scored, query
from .inputs import LEADS_SQL, table


def _k() -> F.Column:
    """The supplier's key behind a derived lead's id."""
    return F.substring("id", 2, 20).cast("long")


# --- runs and their read models ----------------------------------------------------------------------------------------

_RUNS = """SELECT o_orderkey AS k, 'o' || o_orderkey AS id, o_orderpriority AS query, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'discovering' ELSE 'failed' END AS status, o_orderkey % 40 AS domains_total,
  o_orderkey % 23 AS done, o_orderkey % 5 AS failed, o_orderkey * 37 % 9000 AS s, o_orderdate FROM orders"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    start = F.col("o_orderdate").cast("timestamp")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("o"), k).alias("id"), F.col("o_orderpriority").alias("query"), F.when(s == "F", "completed").when(s == "O", "discovering").otherwise("failed").alias("status"), (k % 40).cast("int").alias("domains_total"), (k % 23).cast("int").alias("domains_done"),
        (k % 5).cast("int").alias("domains_failed"), (k % 7).cast("int").alias("tier1_pages"), (k % 3).cast("int").alias("tier2_pages"), start.alias("approved_at"), (start + F.make_dt_interval(secs=k * 37 % 9000)).alias("finished_at"), F.struct("o_orderdate", (-k).alias("k")).alias("created_at"), k.alias("k"),
    )


@query(f"SELECT id, status, CAST(domains_total AS INTEGER) AS domains_total FROM ({_RUNS}) WHERE id = 'o100'")
def get_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_models.get_run(_runs(spark, sf_dir), "o100").select("id", "status", "domains_total")


@query(f"SELECT id, status FROM (SELECT * FROM ({_RUNS}) ORDER BY o_orderdate DESC, k LIMIT 50) ORDER BY status = 'completed' DESC, o_orderdate DESC, k LIMIT 1")
def default_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_models.default_run(_runs(spark, sf_dir)).select("id", "status")


@query(
    f"""SELECT id, CASE status WHEN 'completed' THEN 'Completed' WHEN 'discovering' THEN 'Discovering' ELSE 'Failed' END AS label, CASE status WHEN 'completed' THEN 'ok' WHEN 'discovering' THEN 'info' ELSE 'danger' END AS tone, status = 'discovering' AS active,
    CASE WHEN domains_total > 0 THEN CAST(least(100, floor((done + failed) * 100.0 / domains_total + 0.5)) AS INTEGER) ELSE 0 END AS progress, CAST(k % 7 + k % 3 AS INTEGER) AS browser_pages,
    CASE WHEN s < 60 THEN s || 's' WHEN s // 60 < 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE (s // 3600) || 'h ' || (s // 60 % 60) || 'm' END AS took FROM ({_RUNS})"""
)
def run_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_models.run_lines(_runs(spark, sf_dir))


@query("SELECT event_id AS id, event_type FROM events WHERE user_id = 7")
def list_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("run_id"), "event_type", F.col("ts").alias("created_at"))
    return read_models.list_domains(d, "7").select("id", "event_type")


@query(
    f"""SELECT id, CASE WHEN k % 3 = 0 THEN 'Any' ELSE query END AS industry, CASE WHEN k % 4 = 0 THEN 'Any' ELSE status || ', x' END AS countries,
    CASE WHEN k % 5 = 0 THEN 'Any' WHEN k % 5 = 1 THEN (k % 90 + 1) || '–any' ELSE (k % 90 + 1) || '–500' END AS employees, CASE WHEN k % 6 = 0 THEN 'Any' ELSE CAST(2000 + k % 20 AS VARCHAR) END AS funded_since,
    CAST(k % 4 + 1 AS INTEGER) AS queries, CAST(domains_total AS INTEGER) AS target_domains FROM ({_RUNS})"""
)
def plan_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, none = F.col("k"), F.lit(None)
    req = F.struct(
        F.when(k % 3 != 0, F.col("query")).alias("industry"), F.when(k % 4 == 0, F.array().cast("array<string>")).otherwise(F.array("status", F.lit("x"))).alias("countries"), F.when(k % 5 != 0, (k % 90 + 1).cast("int")).alias("employee_min"),
        F.when(k % 5 > 1, F.lit(500)).otherwise(none.cast("int")).alias("employee_max"), F.when(k % 6 != 0, (F.lit(2000) + k % 20).cast("int")).alias("funding_since_year"),
    )
    plan = F.struct(req.alias("requirements"), F.transform(F.sequence(F.lit(0), (k % 4).cast("int")), lambda i: i.cast("string")).alias("search_queries"), F.col("domains_total").alias("target_domains"))
    return read_models.plan_facets(_runs(spark, sf_dir).withColumn("plan", plan))


@query(
    f"""SELECT id, CASE WHEN status = 'completed' THEN 'completed' WHEN k % 3 = 0 THEN 'cancelled' WHEN status = 'discovering' AND k % 3 = 1 THEN 'scraping' WHEN status = 'discovering' THEN 'completed' ELSE 'failed' END AS after
    FROM ({_RUNS}) WHERE status <> 'failed' OR k % 3 <> 0 UNION ALL SELECT id, 'failed' FROM ({_RUNS}) WHERE status = 'failed' AND k % 3 = 0"""
)
def run_next_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k") % 3
    return _runs(spark, sf_dir).select("id", runs.next_status(F.col("status"), F.when(k == 0, "cancel").when(k == 1, "found").otherwise("all_done")).alias("after"))


@query(
    """WITH c AS (SELECT user_id, count(*) FILTER (WHERE event_type <> 'error') AS done, count(*) FILTER (WHERE event_type = 'error') AS failed FROM events GROUP BY user_id)
    SELECT 'u' || c_custkey AS id, coalesce(done, 7) AS domains_done, coalesce(failed, 7) AS domains_failed FROM customer LEFT JOIN c ON user_id = c_custkey"""
)
def counters_flushed(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = [F.lit(0).cast("long").alias(c) for c in ("pages", "tier1_pages", "tier2_pages", "llm_input_tokens", "llm_output_tokens", "llm_cached_tokens")]
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), "user_id").alias("run_id"), F.when(F.col("event_type") == "error", "failed").otherwise("done").alias("outcome_status"), F.lit(False).alias("cancelled"), *zero)
    r = table(spark, sf_dir, "customer").select(F.concat(F.lit("u"), "c_custkey").alias("id"), *(F.lit(7).cast("long").alias(c) for c in ("domains_done", "domains_failed", "pages_fetched", "tier1_pages", "tier2_pages", "llm_input_tokens", "llm_output_tokens", "llm_cached_tokens")))
    return runs.flush_counters(r, runs.run_counters(e)).select("id", "domains_done", "domains_failed")


@query(f"SELECT domain, status, count(*) AS n FROM (SELECT DISTINCT {_HOST.format(u='url')} AS domain, 'queued' AS status FROM pages) GROUP BY ALL")
def start_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Found domains as queued rows, twice: the second start adds none."""
    found = table(spark, sf_dir, "pages").groupBy(urls.hostname(F.col("url")).alias("domain")).agg(F.min("url").alias("seed_url"), F.first(F.lit("p")).alias("source"))
    none = found.select(F.lit("").alias("id"), F.lit("r").alias("run_id"), "domain", "seed_url", "source", F.lit("").alias("status")).filter("domain is null")
    once, _ = runs.start_run(none, found, "r")
    twice, _ = runs.start_run(once, found, "r")
    return twice.groupBy("domain", "status").agg(F.count("*").alias("n"))


@query("SELECT page_id, page_id % 3 = 2 OR length(html) % 5 = 0 AS blocked FROM pages")
def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 3).alias("tier"), F.when(F.length("html") % 5 == 0, "late").alias("error"))
    return runs.page_rows(p).select("page_id", "blocked")


# --- leads -------------------------------------------------------------------------------------------------------------


@query(_TERMS + "SELECT id, score FROM scored")
def list_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_models.list_leads(_scored(spark, sf_dir), "r").select("id", "score")


@query(_TERMS + "SELECT id, score FROM scored WHERE k % 7 <> 0")
def list_shippable_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _scored(spark, sf_dir).withColumn("merged_into", F.when(_k() % 7 == 0, F.lit("l1")))
    return read_models.list_shippable_leads(d, "r").select("id", "score")


@query(_TERMS + "SELECT id, company_name FROM scored ORDER BY company_name NULLS LAST LIMIT 40")
def lead_rank_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_models.rank_leads(_scored(spark, sf_dir), "company_name").limit(40).select("id", "company_name")


_PARTS = {"industry": "22 * t_industry", "geography": "18 * t_geo", "size": "15 * t_size", "funding": "15 * t_funding", "contactability": "20 * t_contact", "evidence": "10 * t_evidence", "penalties": "t_penalty"}


@query(_TERMS + " UNION ALL ".join(f"SELECT id, '{n}' AS term, format('{{:.2f}}', floor(({x}) * 100 + 0.5) / 100 + 0.0) AS points FROM scored" for n, x in _PARTS.items()) + " UNION ALL SELECT id, 'total', format('{:.2f}', score) FROM scored")
def lead_breakdown_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_models.breakdown_lines(_scored(spark, sf_dir))


@query(LEADS_SQL + "SELECT id, 'company_name' AS field, 'u' AS source_url, CASE WHEN k % 3 = 0 THEN 'llm' ELSE 'jsonld' END AS method, '0.90' AS confidence FROM valid UNION ALL SELECT id, 'industry', 'u', 'llm', '0.70' FROM valid")
def lead_provenance_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_models.provenance_lines(_scored(spark, sf_dir))


@query(_TERMS + """SELECT '{"run":{"id":"r","query":"robots"},"leads":[' || string_agg('{"id":"' || id || '","run_id":"r","domain":"' || domain || '","company_name":"' || company_name || '","score":' || score || '}', ',' ORDER BY score DESC, company_name) || ']}' AS document FROM scored WHERE company_name IS NOT NULL""")
def lead_export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _scored(spark, sf_dir).filter("company_name is not null").select("id", "run_id", "domain", "company_name", "score", "merged_into")
    run = spark.sql("SELECT 'r' AS id, 'robots' AS query, cast(null AS timestamp) AS finished_at")
    return export.json_document(run, d, "r")


@query(_TERMS + "SELECT id, 'https://seed/' || domain AS website, sha256('r|' || domain) AS row_id FROM scored")
def lead_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _scored(spark, sf_dir).withColumn("seed_url", F.concat(F.lit("https://seed/"), "domain")).withColumn("domain_id", F.col("id")).drop("website")
    return runs.lead_rows(d).select(F.col("domain_id").alias("id"), "website", F.col("id").alias("row_id"))


_SHARED = (
    _TERMS
    + """, named AS (SELECT id, domain, score, k, CASE WHEN k % 13 = 0 THEN 'Acme ' || (k % 5) || ' GmbH' ELSE company_name END AS company_name, {mail} AS mail FROM scored),
    placed AS (SELECT *, row_number() OVER (ORDER BY score DESC NULLS LAST, domain, id) AS spot, CASE WHEN k % 13 = 0 THEN 'n' || (k % 5) END AS name FROM named),
    keys AS (SELECT id, spot, 0 AS pos, mail AS key FROM placed WHERE mail IS NOT NULL UNION ALL SELECT id, spot, 1, name FROM placed WHERE name IS NOT NULL),
    firsts AS (SELECT key, min(spot) AS first FROM keys GROUP BY key),
    parents AS (SELECT id, arg_min(first, pos) AS up FROM keys JOIN firsts USING (key) WHERE first < spot GROUP BY id),
    chain(id, spot, root) AS (SELECT placed.id, spot, spot FROM placed WHERE id NOT IN (SELECT id FROM parents) UNION ALL SELECT p.id, q.spot, chain.root FROM parents p JOIN placed q ON q.id = p.id JOIN chain ON chain.spot = p.up),
    plans AS (SELECT chain.id, s.id AS survivor_id, CAST(row_number() OVER (PARTITION BY root ORDER BY chain.spot) - 1 AS INTEGER) AS place FROM chain JOIN placed s ON s.spot = chain.root)
    """
).replace("WITH base", "WITH RECURSIVE base", 1)


def _shared_leads(spark: SparkSession, sf_dir: str, every: int) -> DataFrame:
    """Leads of which each so many share addresses of 40, and some a name in two spellings."""
    k = _k()
    mail = F.array(F.concat(F.when(k % 2 == 0, "info@g").otherwise("INFO@g"), k * 37 % 40, F.lit(".com")))
    d = _scored(spark, sf_dir).withColumn("emails", F.when(k % every == 0, mail).otherwise(F.array().cast("array<string>")))
    name = F.when(k % 13 == 0, F.concat(F.when(k % 2 == 0, "Acme ").otherwise("ACME, "), k % 5, F.lit(" GmbH"))).otherwise(F.col("company_name"))
    return d.withColumn("company_name", name)


@query(_SHARED.replace("{mail}", "CASE WHEN k % 3 = 0 THEN 'm' || (k * 37 % 40) END") + "SELECT 'r' AS run_id, id, survivor_id, place FROM plans")
def dedupe_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.plan_dedupe(_shared_leads(spark, sf_dir, 3))


@query(
    _SHARED.replace("{mail}", "'m' || (k * 37 % 40)")
    + """SELECT p.id, domain, lower(CASE WHEN place = 0 THEN coalesce(company_name, lent) ELSE company_name END) AS company_name, CASE WHEN place > 0 THEN p.survivor_id END AS merged_into, CAST(CASE WHEN place = 0 THEN coalesce(n, 0) ELSE 0 END AS INTEGER) AS n_merged, score
    FROM plans p JOIN named USING (id) LEFT JOIN (SELECT survivor_id, count(*) AS n, arg_min(company_name, place) FILTER (WHERE company_name IS NOT NULL) AS lent FROM plans JOIN named USING (id) WHERE place > 0 GROUP BY survivor_id) a ON a.survivor_id = p.id AND place = 0"""
)
def dedupe_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, _ = dedupe.dedupe_runs(_shared_leads(spark, sf_dir, 1).drop("issues", "requirements", "matches_requirements", "llm_confidence"))
    return done.select("id", "domain", F.lower(F.regexp_replace("company_name", ",", "")).alias("company_name"), "merged_into", F.size("merged_domains").alias("n_merged"), "score")


@query(
    """WITH p AS (SELECT CAST(conv_id AS VARCHAR) AS id, turn AS t, 'https://d' || conv_id || '/' || turn AS u FROM conversations),
    mails AS (SELECT id, 'e' || (t % 3) || '@a.de' AS e, min(t) AS first FROM p WHERE t % 2 = 1 GROUP BY ALL), all_mails AS (SELECT id, string_agg(e, '; ' ORDER BY first) AS emails, 'https://d' || id || '/' || min(first) AS email_url FROM mails GROUP BY id)
    SELECT id AS domain_id, coalesce(arg_min('n' || t, t) FILTER (WHERE t % 3 = 1), CASE WHEN CAST(id AS INTEGER) % 2 = 0 THEN 'Model' END) AS company_name, coalesce(arg_min(u, t) FILTER (WHERE t % 3 = 1), CASE WHEN CAST(id AS INTEGER) % 2 = 0 THEN 'https://d' || id || '/home' END) AS name_url,
      coalesce(arg_min('d' || t, t) FILTER (WHERE t % 4 = 3), CASE WHEN CAST(id AS INTEGER) % 2 = 0 THEN 'said' END) AS description, CASE WHEN bool_or(t % 4 = 3) THEN 'meta' WHEN CAST(id AS INTEGER) % 2 = 0 THEN 'llm' END AS description_method,
      CASE WHEN bool_or(t = 0) THEN 'Berlin' END AS city, CAST(min(1990 + t) FILTER (WHERE t % 5 = 4) AS INTEGER) AS founded_year, CASE WHEN CAST(id AS INTEGER) % 2 = 0 THEN 'steel' END AS industry, coalesce(any_value(emails), '') AS emails, any_value(email_url) AS email_url, bool_or(t = 0) AS any_form_only,
      CASE WHEN CAST(id AS INTEGER) % 2 = 0 THEN 'Ada Bo; Cy Do' ELSE '' END AS people, CASE WHEN bool_or(t % 2 = 1) THEN 'ok' WHEN bool_or(t = 0) THEN 'form_only' ELSE 'no_contact' END AS outcome
    FROM p LEFT JOIN all_mails USING (id) GROUP BY id"""
)
def merge_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, t, ident = table(spark, sf_dir, "conversations"), F.col("turn"), F.col("conv_id").cast("string")
    none, url = F.lit(None).cast("string"), F.concat(F.lit("https://d"), "conv_id", F.lit("/"), "turn")
    found = "array<struct<value:string,method:string,source_url:string>>"
    pages = c.select(
        ident.alias("domain_id"), t.cast("int").alias("page_idx"), url.alias("source_url"), F.lit("other").alias("kind"), F.when(t % 3 == 1, F.concat(F.lit("n"), t)).alias("company_name"), F.when(t % 4 == 2, "").when(t % 4 == 3, F.concat(F.lit("d"), t)).alias("description"),
        F.when(t % 2 == 1, F.array(F.struct(F.concat(F.lit("e"), t % 3, F.lit("@a.de")), F.lit("regex"), url))).otherwise(F.array()).cast(found).alias("emails"), F.array().cast(found).alias("phones"), none.alias("address"), none.alias("country"), F.when(t == 0, "Berlin").alias("city"),
        F.when(t % 5 == 4, (t + 1990).cast("int")).alias("founded_year"), F.create_map(F.lit("linkedin"), none).alias("socials"), none.alias("contact_form_url"), (t == 0).alias("form_only_contact"),
    )
    ids = c.select("conv_id").distinct()
    person = "struct<name:string,role:string,email:string,linkedin:string>"
    company = F.struct(
        F.lit("Model").alias("company_name"), F.lit("said").alias("description"), F.lit("steel").alias("industry"), *(none.alias(x) for x in ("country", "city", "address")), F.lit(None).cast("int").alias("employee_count"), none.alias("employee_range"), F.lit(None).cast("int").alias("founded_year"), none.alias("funding_stage"), none.alias("funding_amount"),
        F.lit(None).cast("int").alias("funding_year"), F.array(*(F.struct(F.lit(n), none, none, none).cast(person) for n in ("Ada Bo", " ada bo ", "", "Cy Do"))).alias("people"), F.array().cast("array<string>").alias("technologies"), F.create_map(F.lit("linkedin"), none).alias("socials"), F.lit(True).alias("matches_requirements"), F.lit("m").alias("match_reason"), F.lit(0.5).alias("confidence"),
    )
    said = ids.select(F.col("conv_id").cast("string").alias("domain_id"), F.when(F.col("conv_id") % 2 == 0, company).alias("company"))
    domains = ids.select(F.col("conv_id").cast("string").alias("domain_id"), F.concat(F.lit("d"), "conv_id").alias("domain"), F.concat(F.lit("https://d"), "conv_id", F.lit("/home")).alias("home_url"))
    m, p = merge.merge_extraction(pages, said, domains), F.col("provenance")
    return m.select(
        "domain_id", "company_name", F.try_element_at(p, F.lit("company_name"))["source_url"].alias("name_url"), "description", F.try_element_at(p, F.lit("description"))["method"].alias("description_method"), "city", "founded_year", "industry", F.array_join("emails", "; ").alias("emails"),
        F.try_element_at(p, F.lit("emails"))["source_url"].alias("email_url"), "any_form_only", F.array_join(F.transform("people", lambda x: x["name"]), "; ").alias("people"), merge.outcome_of(F.col("emails"), F.col("phones"), F.col("any_form_only")).alias("outcome"),
    )


@query(
    """WITH a AS (SELECT l_orderkey, list(l_returnflag ORDER BY l_linenumber, l_returnflag) AS a, list(l_linestatus ORDER BY l_linenumber, l_linestatus) AS b FROM lineitem GROUP BY l_orderkey)
    SELECT l_orderkey, array_to_string(a || list_filter(b, lambda x, i: NOT list_contains(a, x) AND list_position(b, x) = i), '') AS flags FROM a"""
)
def list_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    def listed(c: str) -> F.Column:
        return F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", c))), lambda x: x[c])

    d = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(listed("l_returnflag").alias("a"), listed("l_linestatus").alias("b"))
    return d.select("l_orderkey", F.array_join(merge.ordered_union(F.col("a"), F.col("b")), "").alias("flags"))


# --- scanners over real texts ------------------------------------------------------------------------------------------

_SCANNED = r"list_transform(regexp_extract_all(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,24}'), lambda e: lower(e))"
_USABLE_MAIL = r"regexp_matches(e, '^[^\s@]+@[^\s@]+\.[a-z]{2,}$') AND NOT regexp_matches(e, '" + C.EMAIL_JUNK + "') AND NOT regexp_matches(e, '" + C.EMAIL_PLACEHOLDER + "') AND split_part(e, '@', 2) NOT IN (" + _in(C.NON_COMPANY_DOMAINS) + ")"
_ROLE = "(split_part(e, '@', 1) IN ({r}) OR regexp_extract(split_part(e, '@', 1), '^([^+._-]*)', 1) IN ({r}))".format(r=_in(C.ROLE_LOCAL_PARTS))


def _mails(more: str = "") -> str:
    return f"SELECT doc_id, coalesce(array_to_string(list_filter(l, lambda e, i: list_position(l, e) = i AND {_USABLE_MAIL}{more}), '; '), '') AS emails FROM (SELECT doc_id, {_SCANNED} AS l FROM documents)"


@query(_mails())
def email_usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(contacts.scan_emails(F.col("text"), allow_personal=True), "; ").alias("emails"))


@query(_mails(f" AND {_ROLE}"))
def email_of_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(contacts.scan_emails(F.col("text")), "; ").alias("emails"))


@query(
    r"""WITH f AS (SELECT doc_id, list_transform(regexp_extract_all(text, '(?:\+|00)[\d][\d\s().\-]{7,20}\d'), lambda p: trim(p)) AS l FROM documents),
    g AS (SELECT doc_id, list_transform(list_filter(l, lambda p: length(regexp_replace(p, '[^0-9]', '', 'g')) BETWEEN 7 AND 15 AND NOT regexp_matches(regexp_replace(p, '[^0-9+]', '', 'g'), '^\+?(19|20)[0-9]{2}$')), lambda p: left(regexp_replace(p, '\s+', ' ', 'g'), 32)) AS l FROM f)
    SELECT doc_id, coalesce(array_to_string(list_filter(l, lambda p, i: list_position(l, p) = i), '; '), '') AS phones FROM g"""
)
def phone_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(contacts.scan_phones(F.col("text")), "; ").alias("phones"))


@query(
    r"""SELECT doc_id, CASE WHEN y BETWEEN 1800 AND 2026 THEN y END AS year FROM (SELECT doc_id, TRY_CAST(regexp_extract('Made here, seit ' || (1880 + doc_id % 170) || '. ' || text, '(?i)\b(?:founded|established|gegr[üu]ndet|seit|since|est\.)\s*(?:in\s*)?(19\d{2}|20[0-2]\d)\b', 1) AS INTEGER) AS y FROM documents)"""
)
def founded_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit("Made here, seit "), F.lit(1880) + F.col("doc_id") % 170, F.lit(". "), "text")
    return table(spark, sf_dir, "documents").select("doc_id", contacts.founded_year(t, 2026).alias("year"))


def _kind_sql() -> str:
    out = "struct_pack(kind := 'other', priority := 0)"
    for kind, priority, of_href, of_text in reversed(C.LINK_KINDS):
        h, t = (f"regexp_matches({x}, '(?i){p.replace(chr(39), chr(39) * 2)}')" for x, p in (("path", of_href), ("label", of_text)))
        out = f"CASE WHEN {h} OR {t} THEN struct_pack(kind := '{kind}', priority := CASE WHEN {h} AND {t} THEN {priority + 5} WHEN {h} THEN {priority} ELSE {priority - 10} END) ELSE {out} END"
    return out


@query(
    rf"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS href FROM pages), b AS (SELECT page_id, href, substr(trim(replace(href, '/', ' ')), 1, 80) AS label FROM a UNION ALL SELECT page_id, url || '/kontakt', left(html, 0) FROM pages UNION ALL SELECT page_id, href || '/team', 'Our team' FROM a)
    SELECT page_id, k.kind AS kind, CAST(k.priority AS INTEGER) AS priority, count(*) AS n FROM (SELECT page_id, {_kind_sql()} AS k FROM (SELECT page_id, label, CASE WHEN href LIKE 'http%' THEN {_PATH.format(u="href")} ELSE href END AS path FROM b)) GROUP BY ALL"""
)
def link_kinds_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All links of the pages' markup, each as it is and with a telling end."""
    p = table(spark, sf_dir, "pages")
    a = p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)">'), F.lit(1))).alias("href"))
    b = a.select("page_id", "href", F.translate("href", "/", " ").alias("label")).union(p.select("page_id", F.concat("url", F.lit("/kontakt")), F.lit(""))).union(a.select("page_id", F.concat("href", F.lit("/team")), F.lit("Our team")))
    k = urls.classify_link(F.col("href"), F.col("label"))
    return b.select("page_id", k.alias("k")).groupBy("page_id", "k.kind", "k.priority").agg(F.count("*").alias("n"))


@query(
    """SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'cloudflare' WHEN 1 THEN 'akamai' WHEN 2 THEN 'perimeterx' WHEN 3 THEN 'datadome' WHEN 4 THEN 'imperva' WHEN 5 THEN 'sucuri' WHEN 6 THEN 'generic' END AS vendor FROM pages"""
)
def challenge_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pages with a challenge's mark in their markup; those of the last rest have none."""
    marks = ["<title>Just a moment...</title>", "<script>var _abck='x'</script>", "<div id=px-captcha></div>", "<script src=//geo.captcha-delivery.com/c.js></script>", "<p>Incapsula incident ID: 7</p>", "<b>Sucuri Website Firewall</b>", "<p>Are you a robot?</p>", ""]
    body = F.concat(F.substring("html", 1, 600), F.get(F.lit(marks), (F.col("page_id") % 8).cast("int")), F.substring("html", 601, 1_000_000))
    found = challenge.detect_challenge(F.lit(200), F.create_map(F.lit("server"), F.lit("nginx")), body)
    return table(spark, sf_dir, "pages").select("page_id", found["vendor"].alias("vendor"))


_PATH_QUERY = "CASE WHEN " + _PATH.format(u="url") + " = '' THEN '/' ELSE " + _PATH.format(u="url") + " END || coalesce('?' || nullif(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), ''), '')"


@query(
    f"""SELECT page_id, CASE length(host) % 3 WHEN 0 THEN NOT regexp_matches(p, '^/[^?]*\\?page=') WHEN 1 THEN regexp_matches(p, '^/(en|fr)/') ELSE true END AS allowed FROM (SELECT page_id, {_HOST.format(u='url')} AS host, {_PATH_QUERY} AS p FROM pages)"""
)
def robots_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three bodies: one shuts a query parameter, one all but two folders, one speaks to another agent only."""
    bodies = ["User-agent: *\nDisallow: /*?page=", "User-agent: leadspark\nDisallow: /\nAllow: /en/\nAllow: /fr/", "User-agent: other\nDisallow: /"]
    p = table(spark, sf_dir, "pages").select("page_id", urls.hostname(F.col("url")).alias("domain"), urls.path_and_query(F.col("url")).alias("path"))
    rules = p.select("domain").distinct().withColumn("body", F.get(F.lit(bodies), F.length("domain") % 3))
    return robots.allowed_pages(p, rules, "leadspark").select("page_id", "allowed")


@query("SELECT page_id, page_id % 2 = 0 AND length(html) % 3 <> 0 AS wall FROM pages")
def consent_walls(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('<div id="onetrust-banner">'), "html")).otherwise(F.col("html"))
    visible = F.when(F.length("html") % 3 == 0, F.repeat(F.lit("cookie word "), 300)).otherwise("cookie consent privacy, accept all of it")
    return table(spark, sf_dir, "pages").select("page_id", challenge.looks_like_consent_wall(marked, visible).alias("wall"))


# --- adapters, with recorded answers -----------------------------------------------------------------------------------


@query(
    """WITH q AS (SELECT n_nationkey AS k, n_name FROM nation), h AS (SELECT k, n_name, i FROM q, (SELECT unnest(range(3)) AS i))
    SELECT CAST(k AS INTEGER) AS query_idx, CAST(0 AS INTEGER) AS provider_idx, CAST(i AS INTEGER) AS hit_idx, 'https://' || lower(replace(n_name, ' ', '-')) || i || '.com' AS url, 'c' || i AS snippet FROM h WHERE k % 4 <> 0
    UNION ALL SELECT CAST(k AS INTEGER), 1, CAST(i AS INTEGER), 'https://' || lower(replace(n_name, ' ', '-')) || i || '.com', 't' || i FROM h"""
)
def search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two providers over all nations' names; the first has failures, which are told apart and lose no other hits."""

    def answer(q: str, _: int) -> tuple[int, str]:
        return 200, json.dumps({"results": [{"url": f"https://{q.lower().replace(' ', '-')}{i}.com", "content": f"c{i}", "text": f"t{i}"} for i in range(3)] + [{"url": ""}]})

    failing = {r.n_name for r in table(spark, sf_dir, "nation").filter("n_nationkey % 4 = 0").select("n_name").collect()}  # a fixed table of 25 rows
    queries = table(spark, sf_dir, "nation").select(F.lit("r").alias("run_id"), F.col("n_nationkey").alias("query_idx"), F.col("n_name").alias("query"))
    hits, _ = search.search(queries, [search.tavily(lambda q, n: (500, "down") if q in failing else answer(q, n)), search.exa(answer)])
    return hits.select("query_idx", "provider_idx", "hit_idx", "url", "snippet")


@query(
    f"""SELECT page_id, CASE WHEN {_PATH.format(u='url')} LIKE '/fr/%' THEN 'robots_disallowed' WHEN {_PATH.format(u='url')} LIKE '/de/%' THEN 'unreachable' WHEN {_PATH.format(u='url')} LIKE '/es/%' THEN 'blocked' ELSE 'ok' END AS outcome,
    CAST(CASE WHEN {_PATH.format(u='url')} LIKE '/de/%' THEN 404 WHEN {_PATH.format(u='url')} LIKE '/es/%' THEN 403 WHEN {_PATH.format(u='url')} LIKE '/fr/%' THEN NULL ELSE 200 END AS INTEGER) AS status FROM pages"""
)
def fetch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fetch ladder over all pages' addresses, with a server that answers by folder."""

    def get(url: str) -> fetch.Response:
        if "/de/" in url:
            return fetch.Response(404, {"Content-Type": "text/html"}, "gone")
        if "/es/" in url:
            return fetch.Response(403, {}, "no")
        return fetch.Response(200, {"Content-Type": "text/html"}, "<p>" + "word " * 200 + "</p><a href='mailto:a@b.de'>m</a>")

    p = table(spark, sf_dir, "pages").select("page_id", "url", urls.hostname(F.col("url")).alias("domain"))
    asked = p.select("url", "domain", F.lit("other").alias("kind"), F.col("page_id").cast("int").alias("page_idx"))
    hosts = p.select("domain").distinct()
    robots_bodies = hosts.withColumn("body", F.lit("User-agent: *\nDisallow: /fr/"))
    got = fetch.fetch_pages(asked, get, robots_bodies, fetch.resolve_hosts(hosts.withColumnRenamed("domain", "host"), lambda h: "8.8.8.8"), "leadspark", refused=lambda u: None)
    return got.select(F.col("page_idx").cast("long").alias("page_id"), "outcome", "status")


@query(
    """SELECT CAST(c_custkey AS VARCHAR) AS domain_id, CASE WHEN c_custkey % 3 = 0 THEN 'no_input' WHEN c_custkey % 7 = 0 THEN 'error' ELSE 'ok' END AS outcome, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 7 <> 0 THEN c_name END AS company_name,
    CAST(CASE WHEN c_custkey % 3 = 0 OR c_custkey % 7 = 0 THEN 0 ELSE 5 END AS BIGINT) AS input_tokens FROM customer"""
)
def llm_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    def client(system: str, user: str) -> tuple[str, tuple[int, int, int]]:
        name = user.split("Name in markup: ")[1].split("\n")[0]
        if int("".join(c for c in name if c.isdigit())) % 7 == 0:
            raise RuntimeError("down")
        return json.dumps({"company_name": name}), (5, 1, 0)

    k = F.col("c_custkey")
    packed = table(spark, sf_dir, "customer").select(k.cast("string").alias("domain_id"), F.lit("d").alias("domain"), F.concat_ws(" ", F.col("c_name"), k.cast("string")).alias("given"), "c_name", F.when(k % 3 == 0, "thin").otherwise(F.repeat("c_name", 30)).alias("text"), F.struct(F.lit("x").alias("industry")).alias("requirements"))
    got = llm.extract_with_llm(packed.withColumn("name", F.col("domain_id")), client)
    names = packed.select("domain_id", "c_name")
    return got.join(names, "domain_id").select("domain_id", "outcome", F.when(F.col("company.company_name") == F.col("domain_id"), F.col("c_name")).alias("company_name"), "input_tokens")


@query("SELECT c_custkey, CASE WHEN c_acctbal >= 7000 THEN 'green' WHEN c_acctbal >= 4000 THEN 'ink' ELSE 'muted' END AS class, coalesce(nullif(concat_ws(' · ', c_mktsegment, nullif(CAST(c_nationkey AS VARCHAR), '0')), ''), '') AS dotted FROM customer")
def presentation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", presentation.score_class(F.col("c_acctbal") / 100).alias("class"), presentation.dotted(F.col("c_mktsegment"), F.when(F.col("c_nationkey") != 0, F.col("c_nationkey"))).alias("dotted"))


@query(r"SELECT doc_id, CAST(ceil(length(text) / 3.6::DOUBLE) AS BIGINT) AS tokens, left(trim(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g')), 40) AS head FROM documents")
def text_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.estimate_tokens(F.col("text")).cast("long").alias("tokens"), F.substring(text.collapse(F.col("text")), 1, 40).alias("head"))
