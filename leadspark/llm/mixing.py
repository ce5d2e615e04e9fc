"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are shuffled, laid end to end and cut into blocks of equally many words. The mix is a row of slots:
the golden-ratio point of a slot falls into one source's part of the cumulative targets, so at every length each source has
had close to its share, and a slot takes the next block of its source. All sums are prefix sums over chunks (a slot's
number, a hash's first digits), so no source, however large, is one task's work, and nothing is broadcast by hand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadspark.components import placed

from .common import written

#: Points and shares are whole numbers below 2 ** BITS; GOLDEN is the odd number next to 2 ** BITS divided by the golden ratio.
BITS = 31
GOLDEN = 1_327_217_885
#: Parts of the line of points that slots and sources meet in.
CELLS = 4096
#: Slots of one chunk.
CHUNK = 1 << 16
#: Words of a block. A source's share is met to a few blocks.
BLOCK_WORDS = 32

WORD = r"[^\x20\x09-\x0D]+"


def _before(rows: DataFrame, keys: list[str], chunk: str, order: list[Column], amount: Column, name: str) -> DataFrame:
    """The rows with the sum of amount over the rows before them of the same keys: in the chunks before, and in their own."""
    whole = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    chunks = rows.groupBy(*keys, chunk).agg(F.sum(amount).alias("_own")).select(*keys, chunk, F.coalesce(F.sum("_own").over(whole), F.lit(0)).alias("_before"))
    return rows.withColumn(name, F.coalesce(F.sum(amount).over(own), F.lit(0))).join(chunks, [*keys, chunk]).withColumn(name, F.col(name) + F.col("_before")).drop("_before")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """(place, source, source_size, weight, target, share) of sizes (source, source_size): what each source is to give.

    Sources by code point, a null source last, have the weights in turn. Targets share the sum of all sizes; none is above most
    times its source's size, and what that leaves is shared again by weight, until none is above. share: the target in
    2 ** BITS parts of the sum. Without any words all targets are 0.
    """
    numbered = placed(sizes, [], F.col("source").isNull(), F.col("source"), name="place")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long")
    rows = written(numbered.withColumn("weight", weight))
    cap = F.col("source_size") * most
    total, weighed = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(1))).first()
    left, by, capped = total, weighed, -1
    while True:
        above = cap < F.lit(left) * F.col("weight") / F.lit(by)
        n, full, taken = rows.filter(above).agg(F.count("*"), F.coalesce(F.sum(cap), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if n == capped or weighed == taken:
            break
        left, by, capped = total - full, weighed - taken, n
    target = F.when(above, cap.cast("double")).otherwise(F.lit(left) * F.col("weight") / F.lit(by))
    share = F.floor(F.col("target") / F.lit(float(max(total, 1))) * (1 << BITS)).cast("long")
    return rows.withColumn("target", target).withColumn("share", share)


def schedule(sources: DataFrame, slots: int) -> DataFrame:
    """(slot, place, rank): the source of each slot, and how many slots that source has had before.

    sources: (place, share). The points of the slots 0 to slots - 1 are spread over the sum of shares.
    """
    spark = sources.sparkSession
    shared = sources.filter("share > 0").select("place", "share", F.floor(F.col("place") / CHUNK).alias("_chunk"))
    line = _before(shared, [], "_chunk", [F.col("place")], F.col("share"), "low").select("place", "low", (F.col("low") + F.col("share")).alias("high"))
    total = sources.agg(F.coalesce(F.sum("share"), F.lit(0))).first()[0]
    wide = max(1, -(-total // CELLS))
    met = line.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / wide), F.floor((F.col("high") - 1) / wide))))
    point = F.shiftright((F.col("id") % (1 << BITS)) * GOLDEN % (1 << BITS) * total, BITS)
    points = spark.range(slots if total else 0).select(F.col("id").alias("slot"), point.alias("point"), F.floor(F.col("id") / CHUNK).alias("_chunk")).withColumn("cell", F.floor(F.col("point") / wide))
    dealt = points.join(met, "cell").filter("point >= low and point < high").select("slot", "place", "_chunk")
    return _before(dealt, ["place"], "_chunk", [F.col("slot")], F.lit(1), "rank").select("slot", "place", "rank")


def laid(docs: DataFrame, seed: int = 0) -> DataFrame:
    """(doc_id, source, size, at): each row's words, and where they begin among those of its source in shuffled order.

    The order goes by SHA-256 of seed, id and the text's MD5, with nulls as empty.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(text)), 256)
    rows = docs.select("doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), key.alias("_key")).withColumn("_chunk", F.substring("_key", 1, 3))
    # sources are told apart by a key without null, for the joins
    rows = written(rows.withColumns({"_none": F.col("source").isNull(), "_source": F.coalesce("source", F.lit(""))}))
    return _before(rows, ["_none", "_source"], "_chunk", [F.col("_key")], F.col("size"), "at").select("doc_id", "source", "size", "at")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, block_words: int = BLOCK_WORDS, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(plan, mixed): (doc_id, size, place, at, source_size, target) of each row, and (slot, place, at, doc_id, from_word, to_word) of each piece.

    The pieces of a slot, in the order of their places in the source, are its block; a document's words from from_word to before to_word.
    A source that gives more than it has begins again, in the same order, up to most times; its last block then is shorter.

    Null texts have no words, a null source is one of its own, null ids take part, repeated rows count each. Rows without words
    have no pieces. An empty table gives an empty mix. Other columns are not read. Block by block a source's share is met to two
    or three blocks, so block_words is to be small beside the smallest target.
    """
    rows = written(laid(docs, seed))
    sources = written(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most))
    words = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    slots = written(schedule(sources, -(-words // block_words)))
    sources = sources.join(slots.groupBy("place").agg(F.count("*").alias("slots")), "place", "left")
    rows = rows.join(sources, rows["source"].eqNullSafe(sources["source"]))
    plan = written(rows.select("doc_id", "size", "place", "at", "source_size", "target", F.coalesce("slots", F.lit(0).cast("long")).alias("slots")))

    begin = F.col("at") + F.col("pass") * F.col("source_size")
    runs = plan.filter("size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).withColumn("begin", begin).withColumn("end", F.col("begin") + F.col("size"))
    runs = runs.filter(F.col("begin") < F.col("slots") * block_words)
    pieces = runs.withColumn("block", F.explode(F.sequence(F.floor(F.col("begin") / block_words), F.floor((F.col("end") - 1) / block_words))))
    low, high = F.greatest("begin", F.col("block") * block_words), F.least("end", (F.col("block") + 1) * block_words)
    pieces = pieces.select("place", "block", "at", "doc_id", (low - F.col("begin")).alias("from_word"), (high - F.col("begin")).alias("to_word"))
    mixed = slots.withColumnRenamed("rank", "block").join(pieces, ["place", "block"]).select("slot", "place", "at", "doc_id", "from_word", "to_word")
    return plan, mixed


def taken(plan: DataFrame, mixed: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken): the words that the mix takes of each row, repeats counted."""
    sums = mixed.groupBy("place", F.col("at").alias("_at")).agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    # a row without words begins where the next one begins
    both = plan.withColumn("_at", F.when(F.col("size") > 0, F.col("at"))).join(sums, ["place", "_at"], "left")
    return both.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))
