"""Deduplication across domains: leads that share an e-mail address or a normalised name become one.

The contract is a sequential fold over leads by falling score: a lead joins the plan of its first known e-mail key, else of
its name, and then registers its own keys that are new; two plans are never merged (``fold``). A key is known from its first
holder on and always names that holder's plan. So each lead has one parent, the first holder of the first of its keys that
is held before it, and its plan is the root above it: keys' first holders, a join, and pointer jumping give the same plans
with no group in one task. Merged fields come from the first value of each field, list item or map key, gathered before
they are moved; only what a survivor ends up with, its merged domains included, stands in one row.

Defined cases: null e-mails, lists and names are no keys and add nothing; null scores come last. Ids are unique in a run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspark.components import placed, stored
from leadspark.functions.contacts import normalized_company_name

from .merge import added_people, filled_map, left_biased, ordered_union

_SCALARS = ["company_name", "website", "description", "industry", "country", "city", "address", "employee_count", "employee_range", "founded_year", "funding_stage", "funding_amount", "funding_year", "contact_form_url"]
_LISTS = ["emails", "phones", "technologies"]


def fold(rows: list[tuple[str, float, str, list[str], str | None]]) -> list[tuple[str, str, int]]:
    """The contract in plain words: (id, survivor id, place in the plan) for rows (id, score, domain, e-mail keys, name key)."""
    plans: dict[str, int] = {}
    by_email: dict[str, str] = {}
    by_name: dict[str, str] = {}
    out = []
    for ident, _, _, emails, name in sorted(rows, key=lambda r: (-r[1], r[2], r[0])):
        plan = next((by_email[e] for e in emails if e in by_email), None) or (by_name.get(name) if name is not None else None) or ident
        plans[plan] = plans.get(plan, -1) + 1
        out.append((ident, plan, plans[plan]))
        for e in emails:
            by_email.setdefault(e, plan)
        if name is not None:
            by_name.setdefault(name, plan)
    return out


def _roots(edges: DataFrame) -> DataFrame:
    """(run_id, id, parent) with the root above each id as its parent; edges must have no rings."""
    while True:
        up = edges.select("run_id", F.col("id").alias("parent"), F.col("parent").alias("top"))
        new = stored(edges.select("run_id", "id", "parent").join(up, ["run_id", "parent"], "left").select("run_id", "id", F.coalesce("top", "parent").alias("parent"), F.col("top").isNotNull().alias("moved")))
        if not new.filter("moved").limit(1).count():
            return new.select("run_id", "id", "parent")
        edges = new


def plan_dedupe(leads: DataFrame) -> DataFrame:
    """leads(run_id, id, domain, score, emails, company_name) to (run_id, id, survivor_id, place); a survivor's place is 0."""
    score = F.col("score").cast("double")
    keyed = leads.select(
        "run_id", "id", F.struct(score.isNull().alias("unscored"), (-score).alias("fall"), "domain", "id").alias("at"),
        F.transform(F.array_compact(F.coalesce("emails", F.array().cast("array<string>"))), lambda e: F.concat(F.lit("e:"), F.lower(e))).alias("emails"),
        F.concat(F.lit("n:"), normalized_company_name(F.col("company_name"))).alias("name"),
    )
    keyed = stored(keyed.select("run_id", "id", "at", F.concat("emails", F.array_compact(F.array("name"))).alias("keys")))
    pairs = stored(keyed.select("run_id", "id", "at", F.posexplode("keys").alias("pos", "key")))
    # written, so that the join's sides are plain exchanges and Spark splits the partition of a hot key by itself
    firsts = stored(pairs.groupBy("run_id", "key").agg(F.min("at").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    parents = pairs.join(firsts, ["run_id", "key"]).filter("first < at").groupBy("run_id", "id").agg(F.min_by("first.id", "pos").alias("parent"))
    roots = _roots(stored(parents))
    whole = stored(roots.select("run_id", "id", F.col("parent").alias("survivor_id")).union(roots.select("run_id", F.col("parent").alias("id"), F.col("parent").alias("survivor_id")).distinct()))
    d = keyed.select("run_id", "id", "at").join(whole, ["run_id", "id"], "left")
    alone = d.filter("survivor_id is null").select("run_id", "id", F.col("id").alias("survivor_id"), F.lit(0).alias("place"))
    together = placed(d.filter("survivor_id is not null"), ["run_id", "survivor_id"], F.col("at"))
    return alone.union(together.select("run_id", "id", "survivor_id", F.col("place").cast("int").alias("place")))


def _gathered(absorbed: DataFrame) -> DataFrame:
    """What the absorbed leads of each plan say for list and map fields, by place, each once: one row for each plan."""
    person, entry = (absorbed.schema[c].dataType for c in ("people", "provenance"))
    person, entry = person.elementType, entry.valueType

    def item(field: str, key: Column, i: Column, **said: Column) -> Column:
        values = (said.get(k, F.lit(None).cast(t)).alias(k) for k, t in (("text", "string"), ("person", person), ("entry", entry)))
        return F.struct(F.lit(field).alias("field"), key.alias("key"), F.struct(F.col("place").alias("place"), i.alias("idx")).alias("at"), *values)

    def listed(c: str) -> Column:
        return F.transform(c, lambda v, i: item(c, v, i))

    socials = F.transform(F.filter(F.map_entries("socials"), lambda e: e["value"] != ""), lambda e, i: item("socials", e["key"], i, text=e["value"]))
    people = F.transform(F.filter("people", lambda p: F.trim(p["name"]) != ""), lambda p, i: item("people", F.lower(F.trim(p["name"])), i, person=p))
    provenance = F.transform(F.map_entries("provenance"), lambda e, i: item("provenance", e["key"], i, entry=e["value"]))
    items = absorbed.select("run_id", "survivor_id", F.explode(F.flatten(F.array_compact(F.array(*(listed(c) for c in _LISTS), socials, people, provenance)))).alias("x")).select("run_id", "survivor_id", "x.*")
    given = (F.min_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c) for c in ("text", "person", "entry"))
    once = items.groupBy("run_id", "survivor_id", "field", "key").agg(F.min("at").alias("first"), *given)

    def sorted_of(field: str, *values: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("field") == field, F.struct("first", *values))))

    return once.groupBy("run_id", "survivor_id").agg(
        *(F.transform(sorted_of(c, "key"), lambda x: x["key"]).alias(f"_{c}") for c in _LISTS),
        F.map_from_entries(F.transform(sorted_of("socials", "key", "text"), lambda x: F.struct(x["key"], x["text"]))).alias("_socials"),
        F.transform(sorted_of("people", "person"), lambda x: x["person"]).alias("_people"),
        F.map_from_entries(F.transform(sorted_of("provenance", "key", "entry"), lambda x: F.struct(x["key"], x["entry"]))).alias("_provenance"),
    )


def apply_plans(leads: DataFrame, plans: DataFrame) -> DataFrame:
    """All leads; survivors of plans with others take what they lack, the others point to them. Scores stay as they are."""
    names = leads.columns
    d = stored(leads.drop("merged_into", "merged_domains").join(plans, ["run_id", "id"]))
    body = [c for c in names if c not in ("run_id", "merged_into", "merged_domains")]
    rest = d.filter("place > 0")
    scalars = [c for c in _SCALARS if c in names]
    lacked = rest.groupBy("run_id", "survivor_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "domain"))), lambda x: x["domain"]).alias("_domains"), *(F.min_by(c, F.when(F.col(c).isNotNull(), F.col("place"))).alias(f"_{c}") for c in scalars)
    )
    s = d.filter("place = 0").join(lacked, ["run_id", "survivor_id"], "left").join(_gathered(rest), ["run_id", "survivor_id"], "left")

    def both(c: str, f: Callable[[Column, Column], Column]) -> Column:
        kind = d.schema[c].dataType
        none = (F.create_map() if kind.typeName() == "map" else F.array()).cast(kind)
        return F.when(F.col("_domains").isNotNull(), f(F.coalesce(c, none), F.coalesce(f"_{c}", none))).otherwise(F.col(c))

    new = {c: F.coalesce(c, f"_{c}") for c in scalars} | {c: both(c, ordered_union) for c in _LISTS}
    new |= {"socials": both("socials", filled_map), "people": both("people", added_people), "provenance": both("provenance", left_biased)}
    nowhere = F.array().cast("array<string>")
    survivors = s.select("run_id", *(new.get(c, F.col(c)).alias(c) for c in body), F.lit(None).cast("string").alias("merged_into"), F.coalesce("_domains", nowhere).alias("merged_domains"))
    absorbed = rest.select("run_id", *body, F.col("survivor_id").alias("merged_into"), nowhere.alias("merged_domains"))
    return survivors.unionByName(absorbed).select(names)


def dedupe_runs(leads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(leads after deduplication, one event for each plan that absorbed any). Only leads not yet merged take part."""
    plans = stored(plan_dedupe(leads.filter("merged_into is null")))
    done = apply_plans(leads.filter("merged_into is null"), plans).unionByName(leads.filter("merged_into is not null"))
    told = plans.filter("place > 0").groupBy("run_id", "survivor_id").agg(F.count("*").alias("absorbed"))
    events = told.select("run_id", F.lit("info").alias("level"), F.lit("dedupe").alias("stage"), F.concat(F.lit("merged "), F.col("absorbed"), F.lit(" into "), F.col("survivor_id")).alias("message"))
    return done, events
