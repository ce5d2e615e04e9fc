"""Types of all tables and of the records between stages, as DDL."""

REQUIREMENTS = "struct<industry:string,countries:array<string>,cities:array<string>,employee_min:int,employee_max:int,founded_after:int,funding_required:boolean,funding_since_year:int,keywords:array<string>,exclusions:array<string>>"
PLAN = f"struct<interpretation:string,requirements:{REQUIREMENTS},search_queries:array<string>,target_domains:int,notes:string>"
PERSON = "struct<name:string,role:string,email:string,linkedin:string>"
PROVENANCE = "map<string,struct<source_url:string,method:string,confidence:double>>"
SCORES = "struct<industry:double,geography:double,size:double,funding:double,contactability:double,evidence:double,penalties:double,total:double>"
CONTACT = "struct<value:string,method:string,source_url:string>"
LINK = "struct<url:string,kind:string,priority:int,label:string>"
COMPANY = f"struct<company_name:string,description:string,industry:string,country:string,city:string,address:string,employee_count:int,employee_range:string,founded_year:int,funding_stage:string,funding_amount:string,funding_year:int,emails:array<string>,phones:array<string>,people:array<{PERSON}>,technologies:array<string>,socials:map<string,string>,matches_requirements:boolean,match_reason:string,confidence:double>"

RUNS = f"id string, query string, status string, plan {PLAN}, requirements {REQUIREMENTS}, error string, domains_total int, domains_done int, domains_failed int, pages_fetched int, tier1_pages int, tier2_pages int, llm_input_tokens bigint, llm_output_tokens bigint, llm_cached_tokens bigint, created_at timestamp, approved_at timestamp, finished_at timestamp"
SEARCH_HITS = "run_id string, query_idx int, provider_idx int, hit_idx int, query string, url string, title string, snippet string, provider string"
DOMAINS = "id string, run_id string, domain string, seed_url string, source string, status string, outcome string, note string, pages int, max_tier smallint, started_at timestamp, finished_at timestamp, created_at timestamp"
PAGES = "id string, domain_id string, url string, final_url string, kind string, tier smallint, status_code int, content_hash string, text_length int, blocked boolean, error string, fetched_at timestamp"
EXTRACTED_FIELDS = f"company_name:string,description:string,emails:array<{CONTACT}>,phones:array<{CONTACT}>,address:string,country:string,city:string,founded_year:int,socials:map<string,string>,links:array<{LINK}>,contact_form_url:string,form_only_contact:boolean,clean_text:string"
LEADS = f"id string, run_id string, domain_id string, domain string, company_name string, website string, description string, industry string, country string, city string, address string, employee_count int, employee_range string, founded_year int, funding_stage string, funding_amount string, funding_year int, emails array<string>, phones array<string>, socials map<string,string>, people array<{PERSON}>, technologies array<string>, contact_form_url string, provenance {PROVENANCE}, score decimal(5,2), score_breakdown {SCORES}, match_reason string, merged_into string, merged_domains array<string>, created_at timestamp"
RUN_EVENTS = "id bigint, run_id string, level string, stage string, message string, data string, created_at timestamp"
MERGED = f"domain string, company_name string, description string, industry string, country string, city string, address string, employee_count int, employee_range string, founded_year int, funding_stage string, funding_amount string, funding_year int, emails array<string>, phones array<string>, socials map<string,string>, people array<{PERSON}>, technologies array<string>, contact_form_url string, matches_requirements boolean, match_reason string, llm_confidence double, provenance {PROVENANCE}"

TABLES = {"runs": RUNS, "domains": DOMAINS, "pages": PAGES, "leads": LEADS, "run_events": RUN_EVENTS}


def create_tables(spark, database: str | None = None) -> None:
    """Makes missing tables; those that exist stay as they are."""
    for name, ddl in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database + '.' if database else ''}{name} ({ddl}) USING parquet")
