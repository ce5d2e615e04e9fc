"""Quality selection by importance resampling.

Two generative models over hashed n-grams (words and marks, and pairs of them) are counted: one of target texts, the
labelled good ones, one of all raw texts. A text's log importance is the sum over its n-grams of the log ratio of the
two models; adding Gumbel noise and keeping the k largest draws k texts without replacement in proportion to their
importance. The k-th value is found by narrowing a histogram of the keys, so no task and no driver sees the keys of all
texts.

The target model is counted over a bounded sample of labelled rows (``FIT_ROWS``, by hash of the id); the raw model over
all texts, with one row of counts for each hash bucket and task.

Defined cases: null and empty texts have no n-grams and importance 0; without good labelled rows all importances are 0;
noise depends on the id alone, so a repeated row gets the same key, and equal keys go by id, those of equal id together
in or out; a null id draws its noise as one id; other columns are left out.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, mix, spread, tune, written

#: Labelled rows that the target model may be counted over; hash buckets; share of the texts to keep; smoothing count.
FIT_ROWS, BUCKETS, SHARE, SMOOTH = 20_000, 10_000, 0.85, 1.0

_TOKEN = re.compile(rb"[a-z0-9\x80-\xff]+|[^a-z0-9\x80-\xff\s]+")


def grams(text: str | None, hashes: WordHashes, buckets: int) -> np.ndarray:
    """Buckets of a text's words and marks and of the pairs of neighbours."""
    if not text:
        return np.zeros(0, np.int64)
    h = hashes.of(_TOKEN.findall(text.encode().lower()))
    pairs = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    return (np.concatenate((h, pairs)) % np.uint64(buckets)).astype(np.int64)


def counts(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(bucket, target, raw) over all texts."""
    good = labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).withColumn("good", F.lit(True))
    marked = spread(docs.select("doc_id", "text")).join(F.broadcast(good), "doc_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))  # fit_rows ids

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, raw, target = WordHashes(), np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n = np.bincount(grams(t, hashes, buckets), minlength=buckets)
                raw += n
                if y:
                    target += n
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(target[some]), pa.array(raw[some])], names=["bucket", "target", "raw"])

    return marked.mapInArrow(count, "bucket long, target long, raw long").groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw"))


def log_ratios(found: DataFrame, buckets: int = BUCKETS, smooth: float = SMOOTH) -> np.ndarray:
    """The log ratio of the two models in each bucket; one row a bucket comes to the driver."""
    target, raw = np.zeros(buckets), np.zeros(buckets)
    for r in found.collect():
        target[r.bucket], raw[r.bucket] = r.target, r.raw
    if not target.sum():
        return np.zeros(buckets)
    return np.log((target + smooth) / (target.sum() + smooth * buckets)) - np.log((raw + smooth) / (raw.sum() + smooth * buckets))


def _narrowed(rows: DataFrame, by: Column, k: int, bins: int, few: int) -> tuple[DataFrame, int]:
    """The rows around the k-th largest of a double, few or inseparable, and its place among these."""
    lo, hi, n = rows.agg(F.min(by), F.max(by), F.count("*")).first()
    while n > few and lo + (hi - lo) / bins > lo:
        bin_of = F.least(F.lit(bins - 1), F.floor((by - lo) / ((hi - lo) / bins))).cast("int")
        held = {r.b: (r.n, r.lo, r.hi) for r in rows.groupBy(bin_of.alias("b")).agg(F.count("*").alias("n"), F.min(by).alias("lo"), F.max(by).alias("hi")).collect()}
        for b in sorted(held, reverse=True):
            if held[b][0] >= k:
                break
            k -= held[b][0]
        n, lo, hi = held[b]
        rows = rows.filter((by >= lo) & (by <= hi))
    return rows, k


def _kth_value(rows: DataFrame, value: Column, k: int) -> tuple[object, int]:
    """The k-th largest of a value that has few different ones, and its place among its equals."""
    for r in rows.groupBy(value.alias("v")).agg(F.count("*").alias("n")).orderBy(F.desc("v")).collect():
        if r.n >= k:
            return r.v, k
        k -= r.n
    raise ValueError("fewer rows than k")


def kth_largest(keys: DataFrame, k: int, bins: int = 1000, few: int = 5000) -> tuple[float, int] | None:
    """(key, id) of the k-th row by (key descending, id ascending), from columns key and id; None if all rows are within."""
    if keys.count() <= k:
        return None
    rows, k = _narrowed(keys, F.col("key"), k, bins, few)
    key, k = _kth_value(rows, F.col("key"), k)
    rows, k = _narrowed(keys.filter(F.col("key") == key), -F.col("id").cast("double"), k, bins, few)
    first = rows.agg(F.min("id")).first()[0]
    # as doubles large ids may be equal; less the first of them they are exact
    rows, k = _narrowed(rows, -(F.col("id") - first).cast("double"), k, bins, few)
    return float(key), -_kth_value(rows, -F.col("id"), k)[0]


def select(docs: DataFrame, labels: DataFrame, share: float = SHARE, seed: int = 1, buckets: int = BUCKETS, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, n_grams, log_weight, gumbel_key, selected): a share of the texts, drawn by importance."""
    tune(docs.sparkSession)
    ratios = log_ratios(counts(docs, labels, buckets, fit_rows), buckets)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            found = [grams(t, hashes, buckets) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(g) for g in found], pa.int64()), pa.array([float(ratios[g].sum()) for g in found], pa.float64())], names=["doc_id", "n_grams", "log_weight"])

    weighed = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(weigh, "doc_id long, n_grams long, log_weight double")
    uniform = ((F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11)).cast("double") + 0.5) / float(1 << 53)
    weighed = written(weighed.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform))))
    n = weighed.count()
    last = kth_largest(weighed.select(F.col("gumbel_key").alias("key"), F.coalesce("doc_id", F.lit(-(1 << 62))).alias("id")), math.ceil(share * n)) if n else None
    if last is None:
        return weighed.withColumn("selected", F.lit(True))
    key, ident = last
    return weighed.withColumn("selected", (F.col("gumbel_key") > key) | ((F.col("gumbel_key") == key) & (F.coalesce("doc_id", F.lit(-(1 << 62))) <= ident)))
