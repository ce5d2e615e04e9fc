"""Page bodies by content: each distinct body is kept and parsed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_hash(body: Column) -> Column:
    return F.sha2(body.cast("binary"), 256)


def content_path(digest: Column) -> Column:
    return F.concat(F.lit("pages/"), F.substring(digest, 1, 2), F.lit("/"), F.substring(digest, 3, 2), F.lit("/"), digest, F.lit(".html"))


def distinct_bodies(pages: DataFrame, body: str = "html") -> DataFrame:
    """(content_hash, body): one row for each different body."""
    return pages.filter(F.col(body).isNotNull()).select(content_hash(F.col(body)).alias("content_hash"), body).dropDuplicates(["content_hash"])


def write_bodies(pages: DataFrame, path: str, body: str = "html") -> None:
    """Bodies in folders by the first two digits of their hash."""
    distinct_bodies(pages, body).withColumn("fan", F.substring("content_hash", 1, 2)).write.mode("append").partitionBy("fan").parquet(path)


def load_bodies(spark, path: str, hashes: DataFrame) -> DataFrame:
    return spark.read.parquet(path).dropDuplicates(["content_hash"]).join(hashes.select("content_hash").distinct(), "content_hash", "left_semi")
