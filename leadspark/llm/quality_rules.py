"""Quality rules by distribution divergence, in DataFrame operations only.

Per text two histograms are taken: over character classes and over common words of the known languages. Each language's
reference is the sum of the histograms of all its texts. A text is dropped if a Jensen-Shannon distance (square root of
the divergence in bits, 0 to 1) between its histogram and its language's reference is too large; short texts are judged
by neither, since their histograms are mostly chance. The plain rules of the contract come beside it.

All counting is inside the row: arrays and higher-order functions, no exploded rows, no shuffle but that of the
references, which has one row a language.

Defined cases: a null text has no words, and fails for having too few; a text whose language is null or has no other
text is its own reference (distance 0); repeated rows each count; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread, written

SPACE = r"[\x20\x09-\x0D]+"
#: Words from which a text's histograms are judged, and the largest distances that pass.
LEAST_WORDS, MOST_CLASS_DISTANCE, MOST_WORD_DISTANCE = 50, 0.2, 0.27

# Common words of the languages.
COMMON = sorted(set("the of and to a in is that it for was on der die und den von zu das mit ist des auf ein le la les et des en un du une que est de el los que se del las y por".split()))
#: Bins of the class histogram.
CLASSES = 5
_MARKS = "".join(chr(0x41 + i) for i in range(len(COMMON)))


def _size_without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, "")).cast("long")


def js_distance(p: Column, q: Column, total_p: Column | None = None, total_q: Column | None = None) -> Column:
    """Between two arrays of counts; 0 if one of them is empty. Sums that are at hand as columns are not taken anew for each bin."""
    ps, qs = (_sum(p) if total_p is None else total_p), (_sum(q) if total_q is None else total_q)

    def term(x: Column, y: Column) -> Column:
        m = (x + y) / 2
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0) / 2 + F.when(y > 0, y * F.log2(y / m)).otherwise(0.0) / 2

    total = F.aggregate(F.zip_with(p, q, lambda x, y: term(x / ps, y / qs)), F.lit(0.0), lambda a, x: a + x)
    return F.when((ps > 0) & (qs > 0), F.sqrt(F.greatest(F.lit(0.0), total))).otherwise(0.0)


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def measured(docs: DataFrame) -> DataFrame:
    """Counts and histograms of each text."""
    d = docs.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("w", F.filter(F.split("text", SPACE), lambda x: x != ""))
    d = d.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).withColumn("joined", F.array_join("w", ""))
    # hashes of five words, from those of one, two and four
    d = d.withColumn("n", F.size("w")).withColumn("one", F.transform("w", lambda x: F.xxhash64(x)))
    for name, parts, other, step in (("two", "one", "one", 1), ("four", "two", "two", 2), ("five", "four", "one", 4)):
        tail = F.slice(other, F.lit(step + 1), F.greatest(F.col("n") - step, F.lit(0)))
        d = d.withColumn(name, F.zip_with(parts, tail, lambda a, b: F.xxhash64(a, b)))
    d = d.withColumn("keys", F.slice("five", F.lit(1), F.greatest(F.col("n") - 4, F.lit(0))))
    # positions of windows that stand twice or more: looked for only where there are any
    d = d.withColumn("sorted", F.when(F.size(F.array_distinct("keys")) < F.size("keys"), F.sort_array(F.transform("keys", lambda k, i: F.struct(k.alias("k"), i.alias("i"))))))
    d = d.withColumn("at", F.sort_array(F.filter(F.transform("sorted", lambda x, j: F.when((x["k"] == F.get("sorted", j - 1)["k"]) | (x["k"] == F.get("sorted", j + 1)["k"]), x["i"])), lambda i: i.isNotNull())))
    covered = F.aggregate(F.transform("at", lambda i, j: F.least(F.lit(5), F.coalesce(F.get("at", j + 1) - i, F.lit(5)))), F.lit(0), lambda a, x: a + x)
    d = d.withColumn("codes", F.array_join(F.transform(F.filter("w", lambda x: x.isin(COMMON)), lambda x: F.substr(F.lit(_MARKS), F.array_position(F.lit(COMMON), x).cast("int"), F.lit(1))), ""))
    d = d.select(
        "doc_id", "lang", F.col("n").cast("long").alias("n_words"), F.length("joined").cast("long").alias("word_chars"),
        (F.length("text") - _size_without(F.col("text"), r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        (F.length("joined") - _size_without(F.col("joined"), "[A-Z]+")).alias("upper"), (F.length("joined") - _size_without(F.col("joined"), "[0-9]+")).alias("digits"),
        (F.octet_length("joined") - F.length("joined")).cast("long").alias("beyond"), "codes",
    )
    # capitals, digits, bytes beyond ASCII, symbols, and all the rest
    counted = [F.col(c) for c in ("upper", "digits", "beyond", "n_symbols")]
    d = d.withColumn("classes", F.transform(F.array(*counted, F.greatest(F.lit(0), F.col("word_chars") - sum(counted[1:], counted[0]))), lambda x: x.cast("double")))
    d = d.withColumn("common", F.array(*((F.length("codes") - F.length(F.replace("codes", F.lit(c), F.lit("")))).cast("double") for c in _MARKS), F.greatest(F.lit(0), F.col("n_words") - F.length("codes")).cast("double")))
    return d.drop("upper", "digits", "beyond", "codes")


def references(found: DataFrame) -> DataFrame:
    """Sums of the histograms by language."""
    sums = {c: F.array(*(F.sum(F.get(c, F.lit(i))) for i in range(n))) for c, n in (("classes", CLASSES), ("common", len(COMMON) + 1))}
    return found.filter("lang is not null").groupBy("lang").agg(*(v.alias(f"ref_{c}") for c, v in sums.items()))


def judge(docs: DataFrame, least_words: int = LEAST_WORDS, most_class: float = MOST_CLASS_DISTANCE, most_word: float = MOST_WORD_DISTANCE) -> DataFrame:
    found = written(measured(spread(docs)))
    d = found.join(references(found), "lang", "left")
    for c in ("classes", "common", "ref_classes", "ref_common"):
        d = d.withColumn(f"{c}_sum", _sum(F.col(c)))
    for c, name in (("classes", "class_distance"), ("common", "word_distance")):
        d = d.withColumn(name, F.coalesce(js_distance(F.col(c), F.col(f"ref_{c}"), F.col(f"{c}_sum"), F.col(f"ref_{c}_sum")), F.lit(0.0)))
    d = d.withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words"))
    far = (F.col("n_words") >= least_words) & ((F.col("class_distance") > most_class) | (F.col("word_distance") > most_word))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~far).alias("kept"), "class_distance", "word_distance")
