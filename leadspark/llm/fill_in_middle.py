"""Fill-in-middle transformation over an index of distinct texts.

Identical texts have one row in the index: they meet at their address (SHA-256 and length), their whole texts are compared
there, and the places where a text may be cut are listed once, as an Elias-Fano list. Documents come back to the index by
address alone, so texts are moved once, and each document's seeded cut is two selections from the list.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, tune, unpacked, written

#: Marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Every so many entries of a list the place of its bit is noted, from where a selection goes on.
SAMPLE = 256
#: A group of copies goes to one task as long as it has no more rows than this, or no more than a share of 1 / SHARES.
GROUP_ROWS = 512
SHARES = 10_000


# --- Elias-Fano lists --------------------------------------------------------------------------------------------------


def boundaries(text: bytes, unit: str = "char") -> np.ndarray:
    """Byte offsets at which a text's units start, and its end: n + 1 rising numbers for n units.

    unit: char (code points), word (a word of non-blanks with the blanks before it) or line (with its line feed).
    """
    b = np.frombuffer(text, np.uint8)
    if unit == "char":
        inner = np.flatnonzero((b & 0xC0) != 0x80)[1:]
    elif unit == "word":
        blank = (b == 0x20) | ((b >= 9) & (b <= 13))
        inner = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
        if len(inner) and blank[inner[-1] :].all():  # blanks at the end go with the last word
            inner = inner[:-1]
    elif unit == "line":
        inner = np.flatnonzero(b[:-1] == 0x0A) + 1
    else:
        raise ValueError(f"unknown unit: {unit}")
    return np.concatenate(([0], inner, [len(b)] if len(b) else [])).astype(np.int64)


def listed(values: np.ndarray) -> bytes:
    """Rising numbers as an Elias-Fano list: low bits one by one, high bits in unary, and the bit of each SAMPLE-th number."""
    n = len(values)
    width = max(0, (int(values[-1]) // n).bit_length() - 1)
    low = ((values[:, None] >> np.arange(width)) & 1).astype(np.uint8)
    ones = (values >> width) + np.arange(n)
    high = np.zeros(int(ones[-1]) + 1, np.uint8)
    high[ones] = 1
    return packed(np.array([n, width], np.int64), np.packbits(low.ravel(), bitorder="little"), np.packbits(high, bitorder="little"), ones[::SAMPLE].astype(np.int64))


def opened(data: bytes) -> tuple[np.ndarray, ...]:
    return tuple(unpacked(data, "int64", "uint8", "uint8", "int64"))


def selected(opened_list: tuple[np.ndarray, ...], i: int) -> int:
    """The i-th number: from the sample before it on, through the high bits, then its low bits."""
    (_, width), low, high, samples = opened_list
    at, left = int(samples[i // SAMPLE]), i % SAMPLE
    byte = at // 8
    bits = np.flatnonzero(np.unpackbits(high[byte : byte + SAMPLE // 4], bitorder="little")[at % 8 :]) + at
    while len(bits) <= left:
        left, byte = left - len(bits), byte + SAMPLE // 4
        bits = np.flatnonzero(np.unpackbits(high[byte : byte + SAMPLE // 4], bitorder="little")) + 8 * byte
    upper, first = int(bits[left]) - i, i * int(width)
    lower = int.from_bytes(low[first // 8 : (first + int(width) + 7) // 8].tobytes(), "little") >> (first % 8)
    return (upper << int(width)) | (lower & ((1 << int(width)) - 1))


# --- columns -----------------------------------------------------------------------------------------------------------


def _indexed(unit: str):
    """A group's one text with its number of units and its list. As an aggregate it leaves the rows where their addresses have brought them."""

    def of(texts: pa.Array) -> dict:
        (text,) = texts.to_pylist()
        cuts = boundaries(text.encode(), unit)
        return {"text": text, "n": len(cuts) - 1, "list": listed(cuts)}

    return F.arrow_udf(of, "struct<text: string, n: bigint, list: binary>", F.ArrowUDFType.GROUPED_AGG)


def _arranged():
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()

    @F.arrow_udf("string")
    def of(texts: pa.Array, lists: pa.Array, forms: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
        out = []
        for text, data, form, a, b in zip(texts.cast(pa.binary()).to_pylist(), lists.to_pylist(), forms.to_pylist(), first.to_pylist(), second.to_pylist(), strict=True):
            if form != "plain":
                at = opened(data)
                i, j = selected(at, a), selected(at, b)
                prefix, middle, suffix = text[:i], text[i:j], text[j:]
                text = p + prefix + s + suffix + m + middle if form == "psm" else s + suffix + p + prefix + m + middle
            out.append(text)
        return pa.array(out, pa.binary()).cast(pa.string())

    return of


def restored(output: Column, form: Column) -> Column:
    """The text behind an output: its parts without the marks, in their old order.

    No text with a mark is cut, and no mark's end is a mark's beginning, so the first mark of each kind is the one set.
    """
    head, middle = F.substring_index(output, MIDDLE, 1), F.substr(output, F.locate(MIDDLE, output) + len(MIDDLE))
    first = F.substr(head, F.lit(len(PREFIX) + 1))  # behind the mark at the beginning

    def both(mark: str) -> tuple[Column, Column]:
        return F.substring_index(first, mark, 1), F.substr(first, F.locate(mark, first) + len(mark))

    (prefix, suffix), (s, p) = both(SUFFIX), both(PREFIX)
    return F.when(form == "plain", output).when(form == "psm", F.concat(prefix, middle, suffix)).otherwise(F.concat(p, middle, s))


def seeds(doc_id: Column, seed: int) -> list[Column]:
    """Four 32-bit numbers of an id: the first groups of eight digits in the SHA-256 of seed, colon and id (null: empty)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, seed: int = 1, cut_share: int = 90, suffix_first_share: int = 20, unit: str = "char", group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): a row for each row of docs, with its text cut in three and rearranged.

    n: units of the text. form: plain (the text as it is), psm (prefix, suffix, middle) or spm (suffix, prefix, middle); plain
    has null for prefix_chars and middle_chars, which count units. cut_share, suffix_first_share: per cent of the texts that
    are cut, and of these in form spm. unit: see ``boundaries``.

    Null texts count as empty, and empty texts and texts with a mark in them stay plain. A null id is seeded as an empty
    one; repeated rows give repeated rows, ids of several texts a row for each. An empty table gives none. Other columns
    are not read. A text is one value in one task, whatever its length.

    Groups of more than group_rows copies, and more than 1 / SHARES of the table, are dealt to several tasks; there are fewer
    than SHARES of these, which bounds what is broadcast.
    """
    spark = docs.sparkSession
    tune(spark)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("address", F.coalesce(F.unhex(F.sha2("text", 256)), F.lit(b""))).withColumn("n_bytes", F.octet_length("text"))
    narrow = rows.drop("text")
    key = ["address", "n_bytes"]

    most = F.greatest(F.lit(group_rows), (F.lit(docs.count()) / SHARES).cast("long"))
    hot = F.broadcast(written(rows.groupBy(*key).agg(F.count("*").alias("copies")).filter(F.col("copies") > most).select(*key, F.ceil(F.col("copies") / most).cast("int").alias("parts"))))

    def index(of: DataFrame) -> DataFrame:
        texts = of.groupBy(*key).agg(F.collect_set("text").alias("texts"))
        same = F.when(F.size("texts") == 1, F.col("texts")[0]).otherwise(F.raise_error(F.lit("different texts have one address")))
        return texts.select(*key, same.alias("text")).groupBy(*key).agg(_indexed(unit)("text").alias("entry"))

    cold = narrow.join(hot, key, "left_anti").join(index(rows.join(hot, key, "left_anti")), key)
    # a text of a hot group is listed once too, then sent to each of the group's parts
    part = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.col("parts")).cast("int")
    parts = index(rows.join(hot, key, "left_semi")).join(hot, key).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    dealt = narrow.join(hot, key).withColumn("part", part).drop("parts").join(parts, [*key, "part"]).drop("part")

    h1, h2, h3, h4 = seeds(F.col("doc_id"), seed)
    n, text = F.col("entry.n"), F.col("entry.text")
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | text.contains(mark)
    form = F.when((F.col("n_bytes") == 0) | marked | (h3 % 100 >= cut_share), "plain").when(h4 % 100 < suffix_first_share, "spm").otherwise("psm")
    told = cold.unionByName(dealt).withColumns({"form": form, "a": F.least(h1 % (n + 1), h2 % (n + 1)), "b": F.greatest(h1 % (n + 1), h2 % (n + 1))})
    is_cut = F.col("form") != "plain"
    return told.select("doc_id", n.alias("n"), "form", F.when(is_cut, F.col("a")).alias("prefix_chars"), F.when(is_cut, F.col("b") - F.col("a")).alias("middle_chars"), _arranged()("entry.text", "entry.list", "form", "a", "b").alias("output"))


def digest(cut: DataFrame) -> DataFrame:
    """The rows with hashes of the output and of the text rebuilt from it."""
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
