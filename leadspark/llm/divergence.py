"""Audit of how far the sources of a language differ in their words: counts, dense tables, joins and ranks, and no more.

Every sum is pre-aggregated before it is shuffled. The cross of a language's groups with its kept terms is a join by
language and a salt that terms hash to, so a language with most of the terms is spread over all tasks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import spread, tune, written

#: Every byte that is no letter of ASCII, once A-Z are lower-cased, and not of a longer code point separates terms.
_TERMS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
#: A probability of 1, as a whole number.
SCALE = 1_000_000_000
#: Parts that the terms of a language, or its groups, are dealt to.
SALTS = 64
#: Counts that a task adds up before it hands them on.
HELD = 400_000


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and rows of docs that the term is in. Nulls are ''.

    Terms are the matches of ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased. They are found and counted in Arrow batches, up to
    HELD counts at a time, so what is exploded for the shuffle are sums.
    """
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}
        size = 0

        def told() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, d) in held.items():
                whole = pa.table({"lang": pa.array([lang] * len(n)), "source": pa.array([source] * len(n)), "term": pa.array(list(n), pa.binary()).cast(pa.string()), "n": pa.array(list(n.values()), pa.int64()), "docs": pa.array([d[t] for t in n], pa.int64())})
                yield from whole.to_batches(max_chunksize=50_000)
            held.clear()

        for b in batches:
            for lang, source, text in zip(b["lang"].to_pylist(), b["source"].to_pylist(), b["text"].to_pylist(), strict=True):
                terms = text.encode().lower().translate(_TERMS).split()
                n, d = held.setdefault((lang, source), (Counter(), Counter()))
                before = len(n)
                n.update(terms)
                d.update(set(terms))
                size += len(n) - before + 1
                if size >= HELD:
                    yield from told()
                    size = 0
        yield from told()

    base = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    each = spread(base).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _met(left: DataFrame, right: DataFrame, by: Column) -> DataFrame:
    """Rows of one lang: each of left with each of right. by, a column of left, deals left's rows; right is told to each part."""
    left = left.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    return left.join(right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["lang", "_salt"]).drop("_salt")


def _p(n: Column, total: Column, size: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * size)), exactly."""
    top = F.lit(SCALE).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", top, (total + 2 * size).cast("decimal(20,0)"))


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, least_docs: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): for each (lang, source) group, its distance to each other source of the lang (part
    pair) and the terms it has more of than the lang (part term, top ranks).

    A lang keeps the terms that at least least_docs rows of it have. Ranks go by value, then item in order of UTF-8. Null text,
    lang and source are '', a row with an id used before is a further document, a group without terms has the smoothed
    probabilities alone, a lang without kept terms has pairs of value 0, and an empty table gives no rows. Other columns are
    not read.
    """
    groups = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    counts = written(counted(docs))
    kept = written(counts.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs).select("lang", "term", "n"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_n"))
    counts = counts.join(kept.select("lang", "term"), ["lang", "term"]).select("lang", "source", "term", "n")
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    heads = written(groups.join(sizes, "lang", "left").join(totals, ["lang", "source"], "left").na.fill(0, ["v", "lang_n", "group_n"]))

    zeros = _met(kept.withColumnRenamed("n", "term_n"), heads, F.col("term"))
    dense = zeros.join(counts, ["lang", "source", "term"], "left").na.fill(0, ["n"])
    dense = written(dense.select("lang", "source", "term", "n", _p(F.col("n"), F.col("group_n"), F.col("v")).alias("p"), _p(F.col("term_n"), F.col("lang_n"), F.col("v")).alias("q")))

    a, b = dense.select("lang", "term", "source", "p"), dense.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"))
    half = a.join(b, ["lang", "term"]).filter("source < item").groupBy("lang", "source", "item").agg(F.sum(_f(F.col("p"), F.col("q"))).alias("value"))
    others = _met(heads.select("lang", "source"), heads.select("lang", F.col("source").alias("item")), F.col("source")).filter("source < item")
    half = others.join(half, ["lang", "source", "item"], "left").na.fill(0, ["value"])
    pairs = half.unionByName(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    terms = dense.filter("n > 0 and p > q").select("lang", "source", F.col("term").alias("item"), _f(F.col("p"), F.col("q")).alias("value"))

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumns({"part": F.lit("pair"), "rank": rank}).select(columns).unionByName(terms.withColumns({"part": F.lit("term"), "rank": rank}).filter(F.col("rank") <= top).select(columns))
