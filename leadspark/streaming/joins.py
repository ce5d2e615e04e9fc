"""Joins of two streams within a bound of time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def answered(requests: DataFrame, responses: DataFrame, keys: list[str], within: str, late: str = "10 minutes", unanswered: bool = True) -> DataFrame:
    """requests (keys, ts, ...) and responses (keys, ts, ...) to one row for each response that comes at its request's time or up to
    ``within`` after it, and, with unanswered, one with nulls for each request that gets none.

    Columns: keys, requested_at, responded_at, then the others of both sides as request_x and response_x. Both sides have a
    watermark, so the state that a stream keeps is bounded: a request is given up, and told as unanswered, once the responses'
    watermark has passed its time; rows later than ``late`` are dropped. A request may have several responses, and a response
    several requests. Null keys and times match nothing; such requests are unanswered, in a batch at once.

    On batch tables the same call gives the same rows, without the drop of late ones; there ``intervals.within`` spreads a hot key.
    """

    def side(df: DataFrame, name: str, at: str) -> DataFrame:
        columns = [F.col(k).alias(f"_{name}_{k}") for k in keys] + [F.col("ts").alias(at)] + [F.col(c).alias(f"{name}_{c}") for c in df.columns if c not in (*keys, "ts")]
        return df.select(columns).withWatermark(at, late)

    a, b = side(requests, "request", "requested_at"), side(responses, "response", "responded_at")
    on = (F.col("responded_at") >= F.col("requested_at")) & (F.col("responded_at") <= F.col("requested_at") + F.expr(f"INTERVAL {within}"))
    for k in keys:
        on = on & (F.col(f"_request_{k}") == F.col(f"_response_{k}"))
    both = a.join(b, on, "left_outer" if unanswered else "inner")
    rest = [c for c in both.columns if c not in ("requested_at", "responded_at") and not any(c in (f"_request_{k}", f"_response_{k}") for k in keys)]
    return both.select(*(F.col(f"_request_{k}").alias(k) for k in keys), "requested_at", "responded_at", *rest)
