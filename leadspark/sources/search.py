"""Search providers: payloads into hits, providers in order of preference, and a Spark data source for recorded payloads.

No operator calls a network by itself: a transport (query, limit) -> JSON text is handed in.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from leadspark.components import stored
from leadspark.schemas import SEARCH_HITS

_RESULTS = "struct<results:array<struct<url:string,title:string,content:string,text:string>>>"


class SearchProvider(Protocol):
    """What discovery asks of a provider."""

    name: str
    most: int

    def payload(self, query: str, limit: int) -> str: ...


@dataclass(frozen=True)
class JsonProvider:
    """A provider behind a transport. snippet: the result's field that holds the text; most: results it gives at once."""

    name: str
    most: int
    snippet: str
    transport: Callable[[str, int], tuple[int, str]]

    def payload(self, query: str, limit: int) -> str:
        status, body = self.transport(query, min(limit, self.most))
        if status >= 400:
            raise RuntimeError(f"{self.name} answered {status}: {body[:200]}")
        return body


def tavily(transport: Callable[[str, int], tuple[int, str]]) -> JsonProvider:
    return JsonProvider("tavily", 20, "content", transport)


def exa(transport: Callable[[str, int], tuple[int, str]]) -> JsonProvider:
    return JsonProvider("exa", 25, "text", transport)


def configured(transports: dict[str, Callable]) -> list[JsonProvider]:
    """The providers that have a transport, in order of preference."""
    makers = {"tavily": tavily, "exa": exa}
    return [make(transports[name]) for name, make in makers.items() if transports.get(name)]


def decode_hits(payload: Column, snippet: str) -> Column:
    """array of (url, title, snippet) of a payload; results without an address are left out, missing texts are empty."""
    results = F.from_json(payload, _RESULTS)["results"]
    kept = F.filter(results, lambda r: F.coalesce(r["url"] != "", F.lit(False)))
    return F.transform(kept, lambda r: F.struct(r["url"].alias("url"), F.coalesce(r["title"], F.lit("")).alias("title"), F.coalesce(r[snippet], F.lit("")).alias("snippet")))


def hits_of(payloads: DataFrame, snippet: str) -> DataFrame:
    """payloads(run_id, query_idx, provider_idx, query, provider, payload) to search hits."""
    return payloads.select("run_id", "query_idx", "provider_idx", "query", "provider", F.posexplode(decode_hits(F.col("payload"), snippet)).alias("hit_idx", "hit")).select("run_id", "query_idx", "provider_idx", "hit_idx", "query", "hit.url", "hit.title", "hit.snippet", "provider")


def search(queries: DataFrame, providers: list[JsonProvider], per_query: int = 10) -> tuple[DataFrame, DataFrame]:
    """(hits, errors) of queries(run_id, query_idx, query) at all providers; one that fails doesn't stop the others.

    Calls are paid for, so the answers are stored: each provider is asked once a query, however often hits and errors are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                for i, p in enumerate(providers):
                    try:
                        rows.append(r | {"provider_idx": i, "provider": p.name, "payload": p.payload(r["query"], per_query), "message": None})
                    except Exception as e:  # any failure of a provider is told as data
                        rows.append(r | {"provider_idx": i, "provider": p.name, "payload": None, "message": str(e)})
            yield from pa.Table.from_pylist(rows, schema=_ANSWER).to_batches()

    answers = stored(queries.select("run_id", F.col("query_idx").cast("int").alias("query_idx"), "query").mapInArrow(run, "run_id string, query_idx int, query string, provider_idx int, provider string, payload string, message string"))
    hits = None
    for p in providers:
        part = hits_of(answers.filter((F.col("provider") == p.name) & F.col("payload").isNotNull()), p.snippet)
        hits = part if hits is None else hits.unionByName(part)
    return hits, answers.filter("message is not null").select("run_id", "query_idx", "provider", "query", "message")


_ANSWER = pa.schema([("run_id", pa.string()), ("query_idx", pa.int32()), ("query", pa.string()), ("provider_idx", pa.int32()), ("provider", pa.string()), ("payload", pa.string()), ("message", pa.string())])


class RecordedSearch(DataSource):
    """``spark.read.format("recorded_search").option("path", file)``: recorded answers, one JSON line each.

    A line holds run_id, query_idx, provider_idx, query, provider and the results; a file is one partition.
    """

    @classmethod
    def name(cls) -> str:
        return "recorded_search"

    def schema(self) -> str:
        return SEARCH_HITS

    def reader(self, schema) -> DataSourceReader:
        return _RecordedReader(self.options.get("path", "").split(","))


class _RecordedReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition):
        with open(partition.value, encoding="utf-8") as f:
            for line in f:
                r = json.loads(line)
                kept = [x for x in r["results"] if x.get("url")]
                for i, x in enumerate(kept):
                    yield (r["run_id"], r["query_idx"], r["provider_idx"], i, r["query"], x["url"], x.get("title") or "", x.get("content") or x.get("text") or "", r["provider"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordedSearch)
