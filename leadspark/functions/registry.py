"""Functions for SQL: registered once a session, then usable in any query text."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import html, urls


def register(spark: SparkSession) -> None:
    """``canonical_url(u, base)``, ``link_kind(u, text)``, ``decode_cf_email(hex)`` and the table functions ``explode_jsonld(html)``, ``robots_lines(body)``."""
    class ExplodeJsonLd:
        def eval(self, source: str) -> Iterator[tuple[int, str]]:
            for i, n in enumerate(html.collect_jsonld(html.parse(source or ""))):
                yield i, json.dumps(n, ensure_ascii=False)

    class RobotsLines:
        def eval(self, body: str) -> Iterator[tuple[int, str, str]]:
            for i, line in enumerate((body or "").splitlines()):
                field, colon, value = line.split("#")[0].partition(":")
                if colon and field.strip():
                    yield i, field.strip().lower(), value.strip()

    spark.udf.register("canonical_url", urls.canonicalize, "string")
    spark.udf.register("link_kind", lambda u, t: html.link_kind(u or "", t or "")[0], "string")
    spark.udf.register("decode_cf_email", lambda h: html.decode_cf(h or ""), "string")
    spark.udtf.register("explode_jsonld", F.udtf(ExplodeJsonLd, returnType="pos int, node string"))
    spark.udtf.register("robots_lines", F.udtf(RobotsLines, returnType="pos int, field string, value string"))
