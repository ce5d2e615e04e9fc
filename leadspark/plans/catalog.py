"""Registered queries over the driver's tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark import constants as C
from leadspark.components import placed
from leadspark.functions import challenge, contacts, html, presentation, robots, text, urls
from leadspark.operators import discover, merge, pages, politeness, read_models, runs, score, validate
from leadspark.sinks import export
from leadspark.sources import store

from .inputs import LEADS_SQL, company_url, leads, search_hits, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

YEAR = 2026


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    from . import more, timed  # noqa: F401  (they register their queries)

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: _SQL[k] for k in queries() if k in _SQL}


def _in(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _domain(host: str) -> str:
    """SQL of a host's registrable domain."""
    h = f"regexp_replace(regexp_replace(lower({host}), '^www\\.', ''), '\\.$', '')"
    p = f"string_split({h}, '.')"
    two = f"array_to_string({p}[-2:], '.')"
    return f"CASE WHEN len({p}) <= 2 THEN {h} WHEN {two} IN ({_in(C.MULTI_PART_SUFFIXES)}) THEN array_to_string({p}[-3:], '.') ELSE {two} END"


_HOST = "lower(regexp_extract({u}, '^[a-z]+://([^/?#]*)', 1))"
_PATH = "regexp_extract({u}, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
_CANON = (
    "regexp_extract({u}, '^[a-z]+://', 0) || " + _HOST + " || CASE WHEN " + _PATH + " IN ('', '/') THEN '/' ELSE regexp_replace(" + _PATH + ", '/$', '') END || "
    "coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract({u}, '\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_|fbclid|gclid|ref|source)'))), '&'), ''), '')"
)
_HITS = "SELECT page_id AS hit_idx, page_id % 8 AS query_idx, page_id % 2 AS provider_idx, replace(url, '.example.', '.') AS u FROM pages"
_USABLE = f"SELECT *, {_CANON.format(u='u')} AS canonical, {_domain(_HOST.format(u='u'))} AS domain FROM ({_HITS})"
_USABLE = f"SELECT *, len(list_filter(string_split({_PATH.format(u='canonical')}, '/'), lambda x: x <> '')) AS depth FROM ({_USABLE}) WHERE domain NOT IN ({_in(C.BLOCKED_DOMAINS + C.NON_COMPANY_DOMAINS)})"
_COLLAPSED = """SELECT domain, arg_min(canonical, depth * 100000000000000 + query_idx * 10000000000000 + provider_idx * 1000000000000 + hit_idx) AS seed_url, count(*) AS hits,
  arg_min('p' || (hit_idx % 2), query_idx * 10000000000000 + provider_idx * 1000000000000 + hit_idx) AS source, arg_min('t' || hit_idx, query_idx * 10000000000000 + provider_idx * 1000000000000 + hit_idx) AS title"""


# --- addresses ---------------------------------------------------------------------------------------------------------


@query(f"SELECT page_id, {_HOST.format(u='url')} AS host, {_domain(_HOST.format(u='url'))} AS domain, {_domain(_HOST.format(u='''replace(url, '.example.', '.')'''))} AS company FROM pages")
def url_registrable_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", urls.hostname(F.col("url")).alias("host"), urls.domain_of(F.col("url")).alias("domain"), urls.domain_of(company_url(F.col("url"))).alias("company"))


@query(f"SELECT page_id, {_CANON.format(u='url')} AS canonical FROM pages")
def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("canonical"))


@query(f"SELECT page_id, {_CANON.format(u='url')} AS canonical FROM pages")
def url_canonical_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.canonical_url_full(F.col("url")).alias("canonical"))


@query(f"SELECT page_id, CAST(len(list_filter(string_split({_PATH.format(u='url')}, '/'), lambda x: x <> '')) AS BIGINT) AS depth FROM pages")
def url_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.depth(F.col("url")).alias("depth"))


@query(f"SELECT n, count(*) AS pages, bool_or(a = b) AS same FROM (SELECT page_id % 7 AS n, {_domain(_HOST.format(u='url'))} AS a, 'example.com' AS b FROM pages) GROUP BY n")
def url_same_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "pages").select((F.col("page_id") % 7).alias("n"), urls.same_registrable_domain(F.col("url"), F.lit("https://www.example.com/x")).alias("same"))
    return d.groupBy("n").agg(F.count("*").alias("pages"), F.bool_or("same").alias("same"))


@query(
    f"""SELECT d, d IN ({_in(C.BLOCKED_DOMAINS)}) AS blocked, d IN ({_in(C.NON_COMPANY_DOMAINS)}) AS non_company, count(*) AS pages
    FROM (SELECT CASE page_id % 4 WHEN 0 THEN 'linkedin.com' WHEN 1 THEN 'gmail.com' WHEN 2 THEN 'sites.google.com' ELSE {_domain(_HOST.format(u='url'))} END AS d FROM pages) GROUP BY d"""
)
def url_blocklists(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id") % 4
    d = table(spark, sf_dir, "pages").select(F.when(n == 0, "linkedin.com").when(n == 1, "gmail.com").when(n == 2, "sites.google.com").otherwise(urls.domain_of(F.col("url"))).alias("d"))
    return d.groupBy("d").agg(F.count("*").alias("pages")).select("d", urls.is_blocked(F.col("d")).alias("blocked"), urls.is_non_company(F.col("d")).alias("non_company"), "pages")


@query(
    """SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'linkedin' WHEN 1 THEN 'twitter' WHEN 2 THEN 'facebook' WHEN 3 THEN NULL ELSE 'github' END AS platform, page_id % 5 IN (0, 1, 4) AS plausible FROM pages"""
)
def url_social(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id") % 5
    d = table(spark, sf_dir, "pages").select("page_id", F.when(n == 0, "https://de.linkedin.com/company/a").when(n == 1, "https://X.com/a/").when(n == 2, "https://facebook.com/").when(n == 3, "https://notx.com/a").otherwise("http://github.com/a").alias("u"))
    p = urls.social_platform(F.col("u"))
    return d.select("page_id", p.alias("platform"), (p.isNotNull() & urls.is_plausible_social(p, F.col("u"))).alias("plausible"))


@query(
    """SELECT a, a = 0 OR a = 10 OR a = 127 OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b IN (0, 168)) OR (a = 100 AND b BETWEEN 64 AND 127) OR a >= 224 AS private, count(*) AS n
    FROM (SELECT CAST(event_id % 256 AS INTEGER) AS a, CAST(user_id % 256 AS INTEGER) AS b FROM events) GROUP BY 1, 2"""
)
def address_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").select((F.col("event_id") % 256).cast("int").alias("a"), (F.col("user_id") % 256).cast("int").alias("b"))
    d = d.withColumn("private", urls.is_private_address(F.concat_ws(".", "a", "b", F.lit("3"), F.lit("4"))))
    return d.groupBy("a", "private").agg(F.count("*").alias("n"))


@query("SELECT page_id, page_id % 3 <> 2 AS allowed FROM pages")
def content_type_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id") % 3
    return table(spark, sf_dir, "pages").select("page_id", urls.is_allowed_content_type(F.when(n == 0, "Text/HTML; charset=utf-8").when(n == 1, "text/plain").otherwise("application/pdf")).alias("allowed"))


@query(
    """SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'imprint' WHEN 1 THEN 'contact' WHEN 2 THEN 'about' WHEN 3 THEN 'team' WHEN 4 THEN 'careers' ELSE 'other' END AS kind,
    CAST(CASE page_id % 6 WHEN 0 THEN 105 WHEN 1 THEN 90 WHEN 2 THEN 70 WHEN 3 THEN 70 WHEN 4 THEN 30 ELSE 0 END AS INTEGER) AS priority FROM pages"""
)
def link_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id") % 6
    href = F.when(n == 0, "https://a.de/impressum").when(n == 1, "https://a.de/kontakt/").when(n == 3, "/team").otherwise("https://a.de/x")
    label = F.when(n == 0, " Impressum ").when(n == 2, "Our\n story").when(n == 4, "Join us").otherwise("more")
    k = urls.classify_link(href, label)
    return table(spark, sf_dir, "pages").select("page_id", k["kind"].alias("kind"), k["priority"].alias("priority"))


# --- discovery ---------------------------------------------------------------------------------------------------------


@query(f"{_COLLAPSED} FROM ({_USABLE}) GROUP BY domain")
def discover_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover.collapse(discover.usable_hits(search_hits(spark, sf_dir))).select("domain", "seed_url", "hits", "source", "title")


@query(f"SELECT domain, seed_url, hits FROM ({_COLLAPSED} FROM ({_USABLE}) GROUP BY domain) ORDER BY hits DESC, domain LIMIT 20")
def discover_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = discover.collapse(discover.usable_hits(search_hits(spark, sf_dir)))
    return discover.top_domains(found, 20, ()).select("domain", "seed_url", "hits")


@query(
    f"""WITH usable AS ({_USABLE}), firsts AS (SELECT domain, min(query_idx) AS q FROM usable GROUP BY domain),
    runs AS (SELECT query_idx, (SELECT count(*) FROM firsts WHERE q < query_idx) AS before FROM (SELECT DISTINCT page_id % 8 AS query_idx FROM pages)),
    kept AS (SELECT * FROM usable WHERE query_idx <= (SELECT max(query_idx) FROM runs WHERE before < 40))
    SELECT domain, hits FROM (SELECT domain, count(*) AS hits FROM kept GROUP BY domain) ORDER BY hits DESC, domain LIMIT 40"""
)
def discover_early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover.discover(search_hits(spark, sf_dir), 40).select("domain", "hits")


@query("SELECT count(*) AS hits_seen, count(DISTINCT page_id % 8) AS queries_run FROM pages")
def discover_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover.totals(search_hits(spark, sf_dir)).select("hits_seen", "queries_run")


# --- pages -------------------------------------------------------------------------------------------------------------


@query("SELECT page_id, lower(sha256(html)) AS content_hash, length(html) AS n FROM pages")
def page_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", store.content_hash(F.col("html")).alias("content_hash"), F.length("html").cast("long").alias("n"))


@query("SELECT count(*) AS bodies, min(lower(sha256(html))) AS first_hash FROM (SELECT DISTINCT html FROM pages)")
def page_distinct_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.distinct_bodies(table(spark, sf_dir, "pages")).agg(F.count("*").alias("bodies"), F.min("content_hash").alias("first_hash"))


@query(
    r"""SELECT page_id, CASE WHEN length(first) BETWEEN 2 AND 99 THEN first ELSE nullif(left(trim(t), 100), '') END AS title FROM
    (SELECT page_id, t, trim(regexp_split_to_array(t, '\s+[|–—·-]\s+')[1]) AS first FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) || CASE WHEN page_id % 2 = 0 THEN ' | Site' ELSE '' END AS t FROM pages))"""
)
def page_title_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.when(F.col("page_id") % 2 == 0, " | Site").otherwise(""))
    return table(spark, sf_dir, "pages").select("page_id", text.clean_title(t).alias("title"))


@query()
def page_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = html.extract_udf(YEAR)(F.col("html"), F.col("url"), F.lit("about"))
    return table(spark, sf_dir, "pages").select("page_id", f.alias("f")).select("page_id", "f.company_name", F.size("f.links").alias("n_links"), F.size("f.emails").alias("n_emails"), F.length("f.clean_text").alias("n_text"))


@query()
def page_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", html.page_signals(F.col("html")).alias("s")).select("page_id", "s.text_length", "s.script_byte_ratio", "s.empty_root_mount", "s.has_contact_affordance", "s.has_organization_jsonld")


@query(
    """SELECT page_id, CASE WHEN page_id % 5 = 1 THEN 'tier2' WHEN page_id % 5 = 2 THEN 'keep' WHEN page_id % 5 = 3 THEN 'tier1' ELSE CASE WHEN length(html) < 2000 THEN 'tier1' ELSE 'keep' END END AS action,
    CASE WHEN page_id % 5 = 1 THEN CASE WHEN page_id % 2 = 0 THEN 'cloudflare' ELSE 'generic' END END AS vendor FROM pages"""
)
def challenge_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, c = F.col("page_id") % 5, F.col
    status = F.when(n == 1, 403).when(n == 2, 404).otherwise(200)
    headers = F.create_map(F.lit("server"), F.when(c("page_id") % 2 == 0, "Cloudflare").otherwise("nginx"))
    found = challenge.detect_challenge(status, headers, F.lit("plain page"))
    length = F.when(n == 3, 10).when(F.length("html") < 2000, 499).otherwise(F.length("html"))
    no = F.lit(False)
    d = challenge.decide_escalation(status, F.lit("text/html"), found, no, no, no, length, F.lit(0.1), no, no)
    return table(spark, sf_dir, "pages").select("page_id", d["action"].alias("action"), d["vendor"].alias("vendor"))


@query(
    """WITH links AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'contact' WHEN 1 THEN 'about' WHEN 2 THEN 'other' ELSE 'team' END AS kind, 10 * (turn % 4) + conv_id % 3 AS priority FROM conversations),
    best AS (SELECT *, row_number() OVER (PARTITION BY conv_id, kind ORDER BY priority DESC, turn) AS n FROM links WHERE kind <> 'other')
    SELECT conv_id, kind, turn, "rank" FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY priority DESC, turn) AS "rank" FROM best WHERE n = 1) WHERE "rank" <= 2"""
)
def page_links_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("turn") % 4
    links = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("domain_id"), F.col("turn").alias("pos"), F.when(n == 0, "contact").when(n == 1, "about").when(n == 2, "other").otherwise("team").alias("kind"), (10 * n + F.col("conv_id") % 3).alias("priority"))
    return pages.select_pages(links, 2).select(F.col("domain_id").alias("conv_id"), "kind", F.col("pos").alias("turn"), F.col("rank").cast("long").alias("rank"))


@query(
    r"""WITH p AS (SELECT conv_id, turn, ['imprint', 'about', 'home', 'team', 'careers', 'contact', 'other'][turn % 7 + 1] AS kind, turn % 7 AS o,
      trim(regexp_replace(text, '\s+', ' ', 'g')) AS body FROM conversations WHERE trim(regexp_replace(text, '\s+', ' ', 'g')) <> ''),
    c AS (SELECT *, CAST(ceil(length(chr(10) || '=== ' || upper(kind) || ' — u' || turn || ' ===' || chr(10) || body) / 3.6::DOUBLE) AS BIGINT) AS cost FROM p),
    u AS (SELECT *, row_number() OVER w AS rn, sum(cost) OVER w AS used FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY o, turn ROWS UNBOUNDED PRECEDING))
    SELECT conv_id, count(*) FILTER (WHERE rn = 1 OR used <= 120) AS pages_included, count(*) FILTER (WHERE NOT (rn = 1 OR used <= 120)) AS pages_dropped,
      CAST(sum(cost) FILTER (WHERE rn = 1 OR used <= 120) AS BIGINT) AS estimated_tokens FROM u GROUP BY conv_id"""
)
def pack_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.lit(["imprint", "about", "home", "team", "careers", "contact", "other"]), (F.col("turn") % 7 + 1).cast("int"))
    p = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("domain_id"), F.col("turn").alias("pos"), F.concat(F.lit("u"), "turn").alias("url"), kind.alias("kind"), "text")
    return pages.pack(p, 120).select(F.col("domain_id").alias("conv_id"), "pages_included", "pages_dropped", "estimated_tokens")


@query("SELECT conv_id, count(*) AS pages, max(turn % 3) AS max_tier, count(*) FILTER (WHERE turn % 3 = 1) AS tier1_pages, count(*) FILTER (WHERE turn % 3 = 2) AS tier2_pages FROM conversations GROUP BY conv_id")
def page_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.rollup(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("domain_id"), (F.col("turn") % 3).alias("tier"))).withColumnRenamed("domain_id", "conv_id")


@query(
    """SELECT page_id, CASE WHEN path LIKE '/en/1%' THEN true WHEN path LIKE '/en/%' THEN false WHEN path LIKE '/fr%' THEN false ELSE true END AS allowed FROM (SELECT page_id, """
    + _PATH.format(u="url")
    + " AS path FROM pages)"
)
def robots_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = "User-agent: other\nDisallow: /\n\nUser-agent: leadspark\nUser-agent: *\nDisallow: /en/ # not these\nAllow: /en/1\nDisallow: /f*\nAllow:\nCrawl-delay: 99"
    p = table(spark, sf_dir, "pages").select("page_id", urls.domain_of(F.col("url")).alias("domain"), urls.path_of(F.col("url")).alias("path"))
    rules = p.select("domain").distinct().withColumn("body", F.lit(body))
    return robots.allowed_pages(p, rules, "leadspark").select("page_id", "allowed")


# --- contacts in text --------------------------------------------------------------------------------------------------


@query(
    r"""SELECT doc_id, len(found) AS n_found, CASE WHEN len(found) > 0 THEN lower(found[1]) END AS first_found FROM
    (SELECT doc_id, regexp_extract_all(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,24}') AS found FROM documents)"""
)
def email_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all("text", F.lit(C.EMAIL_SCAN), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(found).cast("long").alias("n_found"), F.lower(F.get(found, F.lit(0))).alias("first_found"))


@query(
    r"""WITH f AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?:\+|00)[\d][\d\s().\-]{7,20}\d')) AS raw FROM documents),
    t AS (SELECT doc_id, raw, regexp_replace(regexp_replace(trim(raw), '\(\s*0\s*\)', '', 'g'), '^00', '') AS s FROM f),
    d AS (SELECT doc_id, raw, regexp_replace(s, '[^0-9]', '', 'g') AS digits FROM t)
    SELECT doc_id, raw, CASE WHEN length(digits) BETWEEN 8 AND 15 AND replace(digits, left(digits, 1), '') <> '' THEN '+' || digits END AS phone, count(*) AS n FROM d GROUP BY ALL"""
)
def phone_e164(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(C.PHONE_SCAN), F.lit(0))).alias("raw"))
    return d.groupBy("doc_id", "raw").agg(F.count("*").alias("n")).select("doc_id", "raw", contacts.phone_e164(F.col("raw")).alias("phone"), "n")


@query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'info@acme.de' ELSE NULL END AS decoded FROM supplier")
def cf_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    key = k % 256
    coded = F.lower(F.concat(F.lpad(F.hex(key), 2, "0"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.lpad(F.hex(F.ascii(F.substring(F.lit("info@acme.de"), i, F.lit(1))).bitwiseXOR(key.cast("int"))), 2, "0")), "")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", contacts.decode_cf_email(F.when(k % 4 == 0, coded).when(k % 4 == 1, "abc").when(k % 4 == 2, "zz00").otherwise("0061626364")).alias("decoded"))


@query("SELECT s_suppkey, s_suppkey % 3 = 0 AS plausible FROM supplier")
def person_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey") % 3
    return table(spark, sf_dir, "supplier").select("s_suppkey", contacts.is_plausible_person_name(F.when(k == 0, " Ada van Dyk ").when(k == 1, "Our Leadership").otherwise("Jo")).alias("plausible"))


@query("SELECT s_suppkey, 'supplier ' || regexp_extract(s_name, '[0-9]+', 0) AS name_key FROM supplier")
def company_name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey") % 3
    name = F.concat(F.when(k == 0, "Süpplier ").when(k == 1, "SUPPLIER GmbH & Co. KG ").otherwise("Supplier, Inc. "), F.regexp_extract("s_name", "[0-9]+", 0))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.regexp_replace(contacts.normalized_company_name(name), "^supplier and ", "supplier ").alias("name_key"))


# --- leads -------------------------------------------------------------------------------------------------------------

_REQ = "named_struct('industry','steel parts','countries',array('Germany','France'),'cities',cast(array() as array<string>),'employee_min',20,'employee_max',200,'founded_after',1900,'funding_required',true,'funding_since_year',2020,'keywords',array('brass','copper'),'exclusions',array('anodized'))"


def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.validate(leads(spark, sf_dir), YEAR)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.score(_validated(spark, sf_dir).withColumn("requirements", F.expr(_REQ)))


@query(
    LEADS_SQL
    + """SELECT id, company_name, description, CAST(employees AS INTEGER) AS employee_count, founded AS founded_year, funding AS funding_year, CAST(CASE WHEN mail THEN 1 ELSE 0 END AS INTEGER) AS n_emails,
    CASE WHEN phone THEN '+4930' || lpad(CAST(k AS VARCHAR), 6, '7') ELSE '' END AS phones, linkedin, CAST(CASE WHEN bad_person THEN 0 ELSE 1 END AS INTEGER) AS n_people, CAST(n_issues AS INTEGER) AS n_issues FROM valid"""
)
def lead_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _validated(spark, sf_dir)
    return v.select("id", "company_name", "description", F.col("employee_count").cast("int").alias("employee_count"), "founded_year", "funding_year", F.size("emails").alias("n_emails"), F.array_join("phones", "; ").alias("phones"), F.element_at("socials", "linkedin").isNotNull().alias("linkedin"), F.size("people").alias("n_people"), F.size("issues").alias("n_issues"))


@query(
    LEADS_SQL
    + """SELECT field, reason, count(*) AS n FROM (
      SELECT 'emails' AS field, 'belongs to agency.com, not ' || domain AS reason FROM valid WHERE foreign_mail UNION ALL SELECT 'phones', 'not a dialable international number' FROM valid WHERE phone
      UNION ALL SELECT 'socials.linkedin', 'url does not point at the platform''s own host' FROM valid WHERE bad_linkedin UNION ALL SELECT 'employee_count', 'outside plausible range for a company' FROM valid WHERE raw_count IS NOT NULL AND employees IS NULL
      UNION ALL SELECT 'founded_year', 'not a plausible founding year' FROM valid WHERE founded IS NULL UNION ALL SELECT 'funding_year', 'outside company lifetime' FROM valid WHERE raw_funding IS NOT NULL AND funding IS NULL
      UNION ALL SELECT 'people', 'does not look like a person''s name' FROM valid WHERE bad_person) GROUP BY ALL"""
)
def lead_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _validated(spark, sf_dir).select(F.explode("issues").alias("i")).groupBy("i.field", "i.reason").agg(F.count("*").alias("n"))


_TERMS = (
    LEADS_SQL
    + """, words AS (SELECT *, coalesce(industry, '') || ' ' || coalesce(description, '') || ' ' || brand AS about, lower(concat_ws(' ', company_name, description, industry, brand)) AS hay FROM valid),
fits AS (SELECT *, (CAST(list_contains(regexp_split_to_array(lower(about), '[^a-z0-9]+'), 'steel') AS INT) + CAST(list_contains(regexp_split_to_array(lower(about), '[^a-z0-9]+'), 'parts') AS INT)) / 2.0::DOUBLE AS overlap,
  (CAST(contains(hay, 'brass') AS INT) + CAST(contains(hay, 'copper') AS INT)) / 2.0::DOUBLE AS keys FROM words),
terms AS (SELECT *,
  CASE WHEN matches THEN CASE WHEN confidence >= 0.6 THEN 1.0 ELSE 0.8 END WHEN greatest(overlap, keys) > 0 THEN least(0.9::DOUBLE, 0.45::DOUBLE + greatest(overlap, keys) * 0.45::DOUBLE) WHEN industry IS NULL AND description IS NULL THEN 0.45 ELSE 0 END::DOUBLE AS t_industry,
  CASE WHEN lower(country) IN ('germany', 'france') THEN 1.0 WHEN contains(lower(address), 'germany') OR contains(lower(address), 'france') THEN 0.85 WHEN country IS NULL AND address IS NULL THEN 0.45 ELSE 0 END::DOUBLE AS t_geo,
  coalesce(employees, CASE WHEN k % 2 = 1 THEN least(low, high) END) AS lo, coalesce(employees, CASE WHEN k % 2 = 1 THEN greatest(low, high) END) AS hi FROM fits),
sized AS (SELECT *, CASE WHEN lo IS NULL THEN 0.45 WHEN hi >= 20 AND lo <= 200 THEN 1.0 WHEN hi < 20 THEN greatest(0, least(0.5::DOUBLE, least(20, hi)::DOUBLE / greatest(20, hi) - 0.3::DOUBLE)) ELSE greatest(0, least(0.5::DOUBLE, least(200, lo)::DOUBLE / greatest(200, lo) - 0.3::DOUBLE)) END::DOUBLE AS t_size,
  CASE WHEN funding_stage IS NULL AND funding IS NULL THEN 0.45 WHEN funding IS NULL THEN 0.6 WHEN funding >= 2020 THEN 1.0 ELSE greatest(0, least(0.5::DOUBLE, 0.5::DOUBLE - (2020 - funding) * 0.15::DOUBLE)) END::DOUBLE AS t_funding,
  least(1.0::DOUBLE, CASE WHEN mail THEN 0.6::DOUBLE ELSE 0 END + CASE WHEN phone THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN form THEN CASE WHEN mail THEN 0.05::DOUBLE ELSE 0.25::DOUBLE END ELSE 0 END + CASE WHEN linkedin THEN 0.15::DOUBLE ELSE 0 END) AS t_contact,
  0.55::DOUBLE * (CASE WHEN k % 3 = 0 THEN 0 ELSE 1 END / 2.0::DOUBLE) + 0.3::DOUBLE * (2 / 12.0::DOUBLE) + 0.15::DOUBLE * confidence AS t_evidence,
  -(CASE WHEN contains(hay, 'anodized') THEN 25 ELSE 0 END + CASE WHEN founded < 1900 THEN 12 ELSE 0 END + CASE WHEN n_issues > 2 THEN least(6, n_issues) ELSE 0 END + CASE WHEN company_name IS NULL THEN 5 ELSE 0 END)::DOUBLE AS t_penalty FROM terms),
scored AS (SELECT *, floor(least(100.0::DOUBLE, greatest(0.0::DOUBLE, 22 * t_industry + 18 * t_geo + 15 * t_size + 15 * t_funding + 20 * t_contact + 10 * t_evidence + t_penalty)) * 100 + 0.5) / 100 AS score FROM sized)
"""
)


@query(_TERMS + "SELECT id, score FROM scored")
def lead_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("id", "score")


def _r2(x: str) -> str:
    return f"floor(({x}) * 100 + 0.5) / 100"


@query(_TERMS + f"SELECT id, {_r2('22 * t_industry')} AS industry, {_r2('18 * t_geo')} AS geography, {_r2('15 * t_size')} AS size, {_r2('15 * t_funding')} AS funding, {_r2('20 * t_contact')} AS contactability, {_r2('10 * t_evidence')} AS evidence, {_r2('t_penalty')} AS penalties, score AS total FROM scored")
def lead_score_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("id", "score_breakdown.*")


@query(_TERMS + "SELECT id, score, row_number() OVER (ORDER BY score DESC NULLS LAST, company_name ASC NULLS LAST, id) AS place FROM scored")
def lead_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _scored(spark, sf_dir).select("run_id", "id", "score", F.coalesce("company_name", F.lit("\uffff")).alias("name"))
    return placed(d, ["run_id"], -F.col("score"), F.col("name"), F.col("id")).select("id", "score", (F.col("place") + 1).cast("long").alias("place"))


@query(_TERMS + "SELECT id, score FROM scored ORDER BY score DESC, company_name NULLS LAST, id LIMIT 25")
def lead_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).orderBy(F.desc("score"), F.asc_nulls_last("company_name"), "id").limit(25).select("id", "score")


@query(_TERMS + "SELECT id, score FROM scored WHERE score >= 20 AND (contains(lower(coalesce(company_name, '')), 'econ') OR contains(domain, 'econ') OR contains(coalesce(industry, ''), 'econ') OR contains(lower(coalesce(description, '')), 'econ'))")
def lead_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_models.filter_leads(_scored(spark, sf_dir), " ECON ", 20).select("id", "score")


@query(
    _TERMS
    + """SELECT id, coalesce('"' || company_name || '"', '') || ',"' || domain || '","https://' || domain || '",' || coalesce('"' || CASE WHEN founded IS NOT NULL THEN CAST(founded AS VARCHAR) END || '"', '') || ',' || '"' || CASE WHEN phone THEN chr(9) || '+4930' || lpad(CAST(k AS VARCHAR), 6, '7') ELSE '' END || '"' AS line FROM scored"""
)
def lead_export_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _scored(spark, sf_dir)
    cells = ["company_name", "domain", "website", "founded_year", "phones"]
    return d.select("id", F.concat_ws(",", *(export.csv_cell(export._text(d, c)) for c in cells)).alias("line"))


@query()
def lead_export_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.csv_lines(_scored(spark, sf_dir))


@query(LEADS_SQL + "SELECT id, coalesce(company_name, domain) AS name, 'https://' || domain AS link, CASE WHEN mail THEN 'info@' || domain WHEN phone THEN '+4930' || lpad(CAST(k AS VARCHAR), 6, '7') WHEN form THEN 'https://' || domain || '/contact' END AS contact, coalesce(country, '') AS location, concat_ws(' · ', funding_stage, CAST(funding AS VARCHAR)) AS funding FROM valid")
def lead_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_models.lead_lines(_scored(spark, sf_dir)).select("id", "name", "link", "contact", "location", "funding")


@query(LEADS_SQL + "SELECT id, lower(country) IN ('germany', 'united kingdom') AS hit FROM valid WHERE country IS NOT NULL")
def country_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = leads(spark, sf_dir).filter("country is not null")
    return d.select("id", text.matches_country(F.col("country"), F.array(F.lit(" DE "), F.lit("gb"))).alias("hit"))


@query("SELECT source, arg_min(text, doc_id) FILTER (WHERE lang = 'en') AS first_en, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY source")
def merge_first_non_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("lang") == "en", F.col("text"))
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.min_by(value, F.when(value.isNotNull(), F.col("doc_id"))).alias("first_en"), F.min("doc_id").alias("first_id"), F.count("*").alias("n"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'a' WHEN n_nationkey % 3 = 1 THEN 'b' END AS x, 'c' AS y FROM nation")
def map_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey") % 3
    a = F.create_map(F.lit("x"), F.when(k == 0, "a").when(k == 1, "").otherwise(F.lit(None)), F.lit("y"), F.lit("c"))
    b = F.create_map(F.lit("x"), F.when(k == 2, "").otherwise("b"), F.lit("y"), F.lit("d"))
    m = merge.filled_map(a, b)
    return table(spark, sf_dir, "nation").select("n_nationkey", F.nullif(F.element_at(m, "x"), F.lit("")).alias("x"), F.element_at(m, "y").alias("y"))


# --- runs and their tables ---------------------------------------------------------------------------------------------


@query(
    """SELECT user_id AS run_id, count(*) FILTER (WHERE event_type <> 'error' AND event_id % 10 <> 0) AS domains_done, count(*) FILTER (WHERE event_type = 'error' AND event_id % 10 <> 0) AS domains_failed,
    CAST(sum(event_id % 7) AS BIGINT) AS pages_fetched, CAST(sum(event_id % 2) AS BIGINT) AS tier1_pages FROM events GROUP BY user_id"""
)
def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    d = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.when(F.col("event_type") == "error", "failed").otherwise("done").alias("outcome_status"), (e % 10 == 0).alias("cancelled"), (e % 7).alias("pages"), (e % 2).alias("tier1_pages"), *(F.lit(0).cast("long").alias(c) for c in ("tier2_pages", "llm_input_tokens", "llm_output_tokens", "llm_cached_tokens")))
    return runs.run_counters(d).select("run_id", "domains_done", "domains_failed", "pages_fetched", "tier1_pages")


_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'discovering' ELSE 'scraping' END"


@query(
    f"""SELECT o_custkey AS run_id, arg_max({_STATUS}, o_orderkey) AS status, arg_max(CASE WHEN o_orderkey % 3 = 0 THEN 'e' || o_orderkey END, o_orderkey) FILTER (WHERE o_orderkey % 3 = 0) AS error,
    coalesce(epoch_us(min(o_orderdate) FILTER (WHERE {_STATUS} = 'discovering')), -1) AS approved_us, coalesce(epoch_us(max(o_orderdate) FILTER (WHERE {_STATUS} = 'completed')), -1) AS finished_us FROM orders GROUP BY o_custkey"""
)
def run_status_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    d = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.when(s == "F", "completed").when(s == "O", "discovering").otherwise("scraping").alias("status"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("e"), "o_orderkey")).alias("error"))
    return runs.fold_run_status(d).select("run_id", "status", "error", F.coalesce(F.unix_micros("approved_at"), F.lit(-1)).alias("approved_us"), F.coalesce(F.unix_micros("finished_at"), F.lit(-1)).alias("finished_us"))


@query(
    """SELECT o_custkey AS domain_id, arg_max(CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'fetching' ELSE 'extracting' END, o_orderkey) AS status, arg_max(o_orderpriority, o_orderkey) FILTER (WHERE o_orderkey % 2 = 0) AS outcome,
    CAST(max(o_orderkey % 3) AS BIGINT) AS max_tier, coalesce(epoch_us(min(o_orderdate) FILTER (WHERE o_orderstatus = 'O')), -1) AS started_us FROM orders GROUP BY o_custkey"""
)
def domain_status_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = F.col("o_orderstatus"), F.col("o_orderkey")
    d = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("domain_id"), k.alias("seq"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.when(s == "F", "done").when(s == "O", "fetching").otherwise("extracting").alias("status"), F.when(k % 2 == 0, F.col("o_orderpriority")).alias("outcome"), F.lit(None).cast("string").alias("note"), F.lit(None).cast("int").alias("pages"), (k % 3).alias("max_tier"))
    return runs.fold_domain_status(d).select("domain_id", "status", "outcome", "max_tier", F.coalesce(F.unix_micros("started_at"), F.lit(-1)).alias("started_us"))


@query("SELECT c_custkey, count(*) AS n, min(c_name) AS c_name FROM (SELECT c_custkey, c_name FROM customer WHERE c_custkey % 5 = 0 AND c_custkey % 2 <> 0) GROUP BY c_custkey")
def insert_new_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    old, new = c.filter("c_custkey % 2 = 0"), c.filter("c_custkey % 5 = 0").withColumn("seq", F.lit(0))
    twice = new.unionByName(new.withColumn("seq", F.lit(1)))
    return runs.insert_new(old, twice, ["c_custkey"]).groupBy("c_custkey").agg(F.count("*").alias("n"), F.min("c_name").alias("c_name"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_name END AS company_name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'fresh' END AS industry FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def upsert_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    old = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("company_name"), F.col("c_mktsegment").alias("industry"))
    new = c.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.lit("new").alias("company_name"), F.lit("fresh").alias("industry"))
    return runs.upsert(old, new, ["id"])


@query("SELECT o_custkey AS run_id FROM orders GROUP BY o_custkey HAVING bool_and(o_orderstatus = 'F')")
def finished_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("queued").alias("status"))
    return runs.finished_runs(d)


@query("SELECT CASE WHEN o_orderstatus = 'O' AND o_custkey % 2 = 0 THEN 'skipped' WHEN o_orderstatus = 'O' THEN 'queued' ELSE 'done' END AS status, count(*) AS n FROM orders GROUP BY 1")
def skip_queued(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 2).cast("string").alias("run_id"), F.when(F.col("o_orderstatus") == "O", "queued").otherwise("done").alias("status"))
    return runs.skip_queued(d, "0").groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS id, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def list_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice", F.struct("o_orderdate", (-F.col("o_orderkey")).alias("k")).alias("created_at")).transform(read_models.list_runs).select("id", "o_totalprice")


@query("SELECT event_id AS id, event_type FROM events WHERE user_id = 7 ORDER BY event_id DESC LIMIT 200")
def list_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("run_id"), "event_type")
    return read_models.list_events(e, "7").select("id", "event_type")


@query(
    """SELECT o_orderkey AS id, CAST(least(100, floor((o_orderkey % 50) * 100.0 / 40 + 0.5)) AS INTEGER) AS progress,
    CASE WHEN s < 60 THEN s || 's' WHEN s // 60 < 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE (s // 3600) || 'h ' || (s // 60 % 60) || 'm' END AS took FROM (SELECT o_orderkey, o_orderkey * 37 % 9000 AS s FROM orders)"""
)
def run_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    start = F.timestamp_seconds(F.lit(0))
    return table(spark, sf_dir, "orders").select(k.alias("id"), presentation.percent(k % 50, F.lit(40)).alias("progress"), presentation.format_duration(start, F.timestamp_seconds(k * 37 % 9000)).alias("took"))


# --- schedules and guards ----------------------------------------------------------------------------------------------


@query(
    """WITH a AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS rn FROM events)
    SELECT event_id, rn * 600000 + max(t - rn * 600000) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS slot_ms FROM a"""
)
def token_bucket_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("host"), F.unix_millis(F.col("ts").cast("timestamp")).alias("t_ms"))
    return politeness.token_bucket(e, 600_000, order=("event_id",)).select("event_id", "slot_ms")


@query(
    """SELECT event_id, samples, ratio, samples >= 40 AND ratio > 0.25 AS alarm FROM (SELECT event_id, count(*) OVER w AS samples, avg(CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) OVER w AS ratio
    FROM (SELECT *, epoch_us(ts) // 1000 AS t FROM events) WINDOW w AS (PARTITION BY user_id % 4 ORDER BY t RANGE BETWEEN 36000000 PRECEDING AND CURRENT ROW))"""
)
def rolling_ratio_alarm(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 4).alias("guard"), (F.col("event_type") == "error").alias("tier1"), F.unix_millis(F.col("ts").cast("timestamp")).alias("t_ms"))
    return politeness.rolling_ratio(e, 36_000_000, by=("guard",)).select("event_id", "samples", "ratio", "alarm")


@query(
    """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS t, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events),
    f AS (SELECT user_id, n, event_id, t, false AS rejected, CAST(bad AS INTEGER) AS failures, CAST(CASE WHEN bad AND 2 <= 1 THEN t ELSE 0 END AS BIGINT) AS opened FROM e WHERE n = 1
      UNION ALL SELECT e.user_id, e.n, e.event_id, e.t, f.opened <> 0 AND e.t - f.opened <= 36000000,
        CASE WHEN f.opened <> 0 AND e.t - f.opened <= 36000000 THEN f.failures WHEN NOT e.bad THEN 0 WHEN f.opened <> 0 THEN 1 ELSE f.failures + 1 END,
        CASE WHEN f.opened <> 0 AND e.t - f.opened <= 36000000 THEN f.opened WHEN e.bad AND (CASE WHEN f.opened <> 0 THEN 1 ELSE f.failures + 1 END) >= 2 THEN e.t ELSE 0 END
      FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
    SELECT event_id, rejected, failures FROM f"""
)
def circuit_breaker_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("host"), F.col("event_id").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("t_ms"), (F.col("event_type") == "error").alias("failed"))
    return politeness.circuit_breaker(e, 2, 36_000_000, t="t_ms").select(F.col("seq").alias("event_id"), "rejected", "failures")
