"""Language-model calls behind a client that is handed in: planning on the driver, extraction one call a domain."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspark.components import stored
from leadspark.schemas import COMPANY, PLAN

#: (system, user) -> (JSON text, (input, output, cached) tokens).
Client = Callable[[str, str], tuple[str, tuple[int | None, int | None, int | None]]]

#: Characters of packed text under which no call is made.
LEAST_INPUT = 200


@dataclass(frozen=True)
class ModelSpec:
    """Settings of a role."""

    provider: str
    model: str
    temperature: float
    max_output_tokens: int

    @property
    def key(self) -> str:
        return f"{self.provider}:{self.model}:{self.temperature:g}"


#: Settings of the two roles, over the model that is configured.
ROLES = {"plan": (0.4, 8192), "extract": (0.0, 4096)}


def resolve_spec(role: str, configured: str, default_provider: str = "stub") -> ModelSpec:
    provider, _, model = configured.rpartition(":")
    temperature, most = ROLES[role]
    return ModelSpec(provider or default_provider, model, temperature, most)


def usage(tokens: Column) -> list[Column]:
    """Three token counts, missing ones 0."""
    return [F.coalesce(tokens[i], F.lit(0)).alias(n) for i, n in enumerate(("input_tokens", "output_tokens", "cached_tokens"))]


PLAN_INSTRUCTIONS = "Turn the description of an ideal customer into requirements and web searches. A requirement that is not stated stays null. The year is {year}."
EXTRACT_INSTRUCTIONS = "Extract one company's record from the page texts. What the pages do not state stays null.\nRequirements:\n"


def plan_run(query: str, year: int, client: Client) -> dict:
    """{outcome: ok | no_output | error, plan, error, usage}; never raises."""
    try:
        text, used = client(PLAN_INSTRUCTIONS.format(year=year), query)
    except Exception as e:  # a failed call is told, the run stays open to inspection
        return {"outcome": "error", "plan": None, "error": str(e), "usage": (0, 0, 0)}
    try:
        plan = json.loads(text) if text else None
    except ValueError:
        plan = None
    used = tuple(u or 0 for u in used)
    if not isinstance(plan, dict) or not plan.get("search_queries"):
        return {"outcome": "no_output", "plan": None, "error": "the model gave no plan", "usage": used}
    return {"outcome": "ok", "plan": plan, "error": None, "usage": used}


def parsed_plan(text: Column) -> Column:
    return F.from_json(text, PLAN)


def prompts(packed: DataFrame) -> DataFrame:
    """packed(domain_id, domain, name, text, requirements struct) with ``system``, equal for all domains of a run, and ``user``."""
    system = F.concat(F.lit(EXTRACT_INSTRUCTIONS), F.to_json("requirements", {"pretty": "true", "ignoreNullFields": "false"}))
    user = F.concat(F.lit("Domain: "), F.col("domain"), F.coalesce(F.concat(F.lit("\nName in markup: "), F.col("name")), F.lit("")), F.lit("\n\n"), F.col("text"))
    return packed.withColumn("system", system).withColumn("user", user)


def extract_with_llm(packed: DataFrame, client: Client) -> DataFrame:
    """(domain_id, outcome, company, error, input_tokens, output_tokens, cached_tokens), one call a domain; thin texts make none.

    Calls are paid for, so the answers are stored: the model is asked once a domain, however often the rows are read.
    """
    asked = prompts(packed).withColumn("enough", F.length("text") >= LEAST_INPUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                try:
                    text, used = client(r["system"], r["user"])
                    rows.append({"domain_id": r["domain_id"], "text": text or None, "error": None, "tokens": list(used)})
                except Exception as e:  # a failed call is told as data
                    rows.append({"domain_id": r["domain_id"], "text": None, "error": str(e), "tokens": [None, None, None]})
            yield from pa.Table.from_pylist(rows, schema=pa.schema([("domain_id", pa.string()), ("text", pa.string()), ("error", pa.string()), ("tokens", pa.list_(pa.int64()))])).to_batches()

    answers = stored(asked.filter("enough").select("domain_id", "system", "user").mapInArrow(run, "domain_id string, text string, error string, tokens array<bigint>"))
    company = F.from_json("text", COMPANY)
    done = answers.select("domain_id", F.when(F.col("error").isNotNull(), "error").when(company.isNull() | F.col("text").isNull(), "no_output").otherwise("ok").alias("outcome"), company.alias("company"), "error", *usage(F.col("tokens")))
    none = asked.filter(~F.coalesce("enough", F.lit(False))).select("domain_id", F.lit("no_input").alias("outcome"), F.lit(None).cast(COMPANY).alias("company"), F.lit(None).cast("string").alias("error"), *(F.lit(0).cast("bigint").alias(n) for n in ("input_tokens", "output_tokens", "cached_tokens")))
    return done.unionByName(none)
