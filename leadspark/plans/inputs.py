"""Operator inputs derived from the driver's tables, by fixed rules that SQL can follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def company_url(url: Column) -> Column:
    """Hosts under example.* become company-like domains."""
    return F.regexp_replace(url, r"\.example\.", ".")


def search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select(
        F.lit("r").alias("run_id"),
        F.pmod("page_id", F.lit(8)).cast("int").alias("query_idx"),
        F.pmod("page_id", F.lit(2)).cast("int").alias("provider_idx"),
        F.col("page_id").alias("hit_idx"),
        company_url(F.col("url")).alias("url"),
        F.concat(F.lit("t"), "page_id").alias("title"),
        F.lit("").alias("snippet"),
        F.concat(F.lit("p"), F.pmod("page_id", F.lit(2))).alias("provider"),
    )


def leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A merged lead for each supplier; its key and account decide which fields are there."""
    s = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    s = s.join(table(spark, sf_dir, "part"), F.col("s_suppkey") == F.col("p_partkey"), "left")
    k, acct = F.col("s_suppkey"), F.col("s_acctbal").cast("int")
    domain = F.concat(F.lit("s"), k, F.when(k % 3 == 0, ".co.uk").otherwise(".com"))
    people = F.array(F.struct(F.when(k % 4 == 0, "Our Team").otherwise("Ada van Dyk").alias("name"), F.lit("CEO").alias("role"), F.lit(None).cast("string").alias("email"), F.lit(None).cast("string").alias("linkedin")))
    entry = "struct<source_url:string,method:string,confidence:double>"
    return s.select(
        F.lit("r").alias("run_id"), F.concat(F.lit("l"), k).alias("id"), domain.alias("domain"),
        F.when(k % 11 != 0, F.concat(F.col("s_name"), F.when(k % 5 == 0, " - Home").otherwise(""))).alias("company_name"),
        F.concat(F.lit("https://"), domain).alias("website"),
        F.when(k % 6 != 0, F.concat(F.lit("Makes "), F.lower("p_type"))).alias("description"),
        F.when(k % 7 != 0, F.lower("p_type")).alias("industry"),
        F.when(k % 8 != 0, F.col("n_name")).alias("country"), F.lit(None).cast("string").alias("city"),
        F.when(k % 9 == 0, F.concat(F.lit("1 Main St, "), F.col("n_name"))).alias("address"),
        F.when(k % 2 == 0, F.abs(acct) % 600).alias("employee_count"), F.when(k % 2 == 1, F.concat(F.abs(acct) % 50, F.lit("-"), F.abs(acct) % 50 + 40)).alias("employee_range"),
        (F.lit(1780) + k % 260).cast("int").alias("founded_year"), F.when(k % 3 == 1, F.lit("seed")).alias("funding_stage"), F.lit(None).cast("string").alias("funding_amount"),
        F.when(k % 5 == 2, (F.lit(2010) + k % 20).cast("int")).alias("funding_year"),
        F.when(k % 4 == 1, F.array(F.concat(F.lit("info@"), domain), F.lit("info@agency.com"))).when(k % 4 == 2, F.array(F.concat(F.lit("info@"), domain))).otherwise(F.array().cast("array<string>")).alias("emails"),
        F.when(k % 3 == 0, F.array(F.concat(F.lit("+49 (0)30 "), F.lpad(k.cast("string"), 6, "7")), F.lit("030 123456"))).otherwise(F.array().cast("array<string>")).alias("phones"),
        F.create_map(F.lit("linkedin"), F.when(k % 2 == 0, F.concat(F.lit("https://www.linkedin.com/company/s"), k)).when(k % 5 == 0, F.lit("https://linkedin.com/"))).alias("socials"),
        people.alias("people"), F.array(F.coalesce("p_brand", F.lit("none"))).alias("technologies"),
        F.when(k % 10 == 0, F.concat(F.lit("https://"), domain, F.lit("/contact"))).alias("contact_form_url"),
        (k % 4 == 0).alias("matches_requirements"), F.lit("derived").alias("match_reason"), ((k % 10) / F.lit(10.0)).alias("llm_confidence"),
        F.create_map(F.lit("company_name"), F.struct(F.lit("u").alias("source_url"), F.when(k % 3 == 0, "llm").otherwise("jsonld").alias("method"), F.lit(0.9).alias("confidence")), F.lit("industry"), F.struct(F.lit("u").alias("source_url"), F.lit("llm").alias("method"), F.lit(0.7).alias("confidence"))).cast(f"map<string,{entry}>").alias("provenance"),
        F.lit(None).cast("string").alias("merged_into"), F.array().cast("array<string>").alias("merged_domains"),
    )


#: The derived leads as SQL, for the twins of the lead queries.
LEADS_SQL = """
WITH base AS (
  SELECT s_suppkey AS k, CAST(trunc(s_acctbal) AS INTEGER) AS acct, s_name, n_name, p_type, p_brand,
         's' || s_suppkey || CASE WHEN s_suppkey % 3 = 0 THEN '.co.uk' ELSE '.com' END AS domain
  FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN part ON s_suppkey = p_partkey
), lead AS (
  SELECT k, domain, 'l' || k AS id,
    CASE WHEN k % 11 <> 0 THEN s_name END AS company_name,
    CASE WHEN k % 6 <> 0 THEN 'Makes ' || lower(p_type) END AS description,
    CASE WHEN k % 7 <> 0 THEN lower(p_type) END AS industry,
    CASE WHEN k % 8 <> 0 THEN n_name END AS country,
    CASE WHEN k % 9 = 0 THEN '1 Main St, ' || n_name END AS address,
    CASE WHEN k % 2 = 0 THEN abs(acct) % 600 END AS raw_count,
    abs(acct) % 50 AS low, CASE WHEN k % 2 = 1 THEN abs(acct) % 50 + 40 END AS high,
    CAST(1780 + k % 260 AS INTEGER) AS raw_founded,
    CASE WHEN k % 3 = 1 THEN 'seed' END AS funding_stage,
    CASE WHEN k % 5 = 2 THEN CAST(2010 + k % 20 AS INTEGER) END AS raw_funding,
    k % 4 IN (1, 2) AS mail, k % 4 = 1 AS foreign_mail, k % 3 = 0 AS phone, k % 2 = 0 AS linkedin, k % 2 = 1 AND k % 5 = 0 AS bad_linkedin,
    k % 4 = 0 AS bad_person, k % 10 = 0 AS form, k % 4 = 0 AS matches, (k % 10) / 10.0::DOUBLE AS confidence, coalesce(p_brand, 'none') AS brand
  FROM base
), checked AS (
  SELECT *, CASE WHEN raw_count BETWEEN 1 AND 500000 THEN raw_count END AS employees,
    CASE WHEN raw_founded BETWEEN 1800 AND 2026 THEN raw_founded END AS founded
  FROM lead
), valid AS (
  SELECT *, CASE WHEN raw_funding > 2026 OR (founded IS NOT NULL AND raw_funding < founded) THEN NULL ELSE raw_funding END AS funding,
    CAST(foreign_mail AS INT) + CAST(phone AS INT) + CAST(bad_linkedin AS INT) + CAST(raw_count IS NOT NULL AND employees IS NULL AS INT) + CAST(founded IS NULL AS INT)
      + CAST(raw_funding IS NOT NULL AND (raw_funding > 2026 OR (founded IS NOT NULL AND raw_funding < founded)) AS INT) + CAST(bad_person AS INT) AS n_issues
  FROM checked
)
"""
