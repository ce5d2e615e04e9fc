"""robots.txt, native: the rules that hold for an agent, and whether a path may be fetched.

``$`` at the end of a rule is taken literally, as in the behaviour that results must equal; ``end_anchor=True`` honours it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_BYTES = 256 * 1024


def parse_robots(body: Column, agent: str) -> Column:
    """struct(disallow, allow, crawl_delay_ms) of the groups for all agents or for this one, by one fold over the lines."""
    state = "struct<inside:boolean,directive:boolean,disallow:array<string>,allow:array<string>,crawl_delay_ms:int>"
    start = F.from_json(F.lit('{"inside":false,"directive":false,"disallow":[],"allow":[],"crawl_delay_ms":null}'), state)

    def made(inside: Column, directive: Column, disallow: Column, allow: Column, delay: Column) -> Column:
        return F.struct(inside.alias("inside"), directive.alias("directive"), disallow.alias("disallow"), allow.alias("allow"), delay.alias("crawl_delay_ms")).cast(state)

    def step(s: Column, raw: Column) -> Column:
        line = F.trim(F.substring_index(raw, "#", 1))
        field, value = F.lower(F.trim(F.substring_index(line, ":", 1))), F.trim(F.substring(line, F.instr(line, ":") + 1, F.length(line)))
        seconds = value.try_cast("double")
        named = (value == "*") | F.contains(F.lit(agent.lower()), F.lower(value))
        on_agent = made((s["inside"] & ~s["directive"]) | named, F.lit(False), s["disallow"], s["allow"], s["crawl_delay_ms"])
        on_rule = made(
            s["inside"],
            F.lit(True),
            F.when(s["inside"] & (field == "disallow") & (value != ""), F.concat(s["disallow"], F.array(value))).otherwise(s["disallow"]),
            F.when(s["inside"] & (field == "allow") & (value != ""), F.concat(s["allow"], F.array(value))).otherwise(s["allow"]),
            F.when(s["inside"] & (field == "crawl-delay") & (seconds > 0) & (seconds < float("inf")), F.least(seconds * 1000, F.lit(30_000.0)).cast("int")).otherwise(s["crawl_delay_ms"]),
        )
        return F.when((line == "") | ~F.contains(line, F.lit(":")), s).when(field == "user-agent", on_agent).otherwise(on_rule)

    lines = F.split(F.substring(F.coalesce(body, F.lit("")), 1, MOST_BYTES), r"\r?\n")
    return F.aggregate(lines, start, step, lambda s: F.struct(s["disallow"].alias("disallow"), s["allow"].alias("allow"), s["crawl_delay_ms"].alias("crawl_delay_ms")))


def rule_pattern(rule: Column, end_anchor: bool = False) -> Column:
    escaped = F.regexp_replace(rule, r"([.+?^${}()|\[\]\\])", r"\\$1")
    pattern = F.concat(F.lit("^"), F.replace(escaped, F.lit("*"), F.lit(".*")))
    return F.regexp_replace(pattern, r"\\\$$", r"\$") if end_anchor else pattern


def is_allowed(path: Column, rules: Column, end_anchor: bool = False) -> Column:
    """The longest rule that the path meets decides, an allowing one before others of its length; none allows."""

    def met(kind: str, allow: bool) -> Column:
        hit = F.filter(rules[kind], lambda r: F.regexp_like(path, rule_pattern(r, end_anchor)))
        return F.transform(hit, lambda r: F.struct(F.length(r).alias("size"), F.lit(allow).alias("allow")))

    best = F.array_max(F.concat(met("disallow", False), met("allow", True)))
    return F.coalesce(best["allow"], F.lit(True))


def allowed_pages(pages: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """pages(domain, path, ...) with ``allowed``; domains without a robots body allow everything. Each body is parsed once."""
    parsed = robots.select("domain", parse_robots(F.col("body"), agent).alias("rules"))
    return pages.join(parsed, "domain", "left").withColumn("allowed", F.coalesce(is_allowed(F.col("path"), F.col("rules")), F.lit(True))).drop("rules")
