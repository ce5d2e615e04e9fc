"""Tables written to the checkpoint folder, so that plans stay short and lost executors cost a step, and ranks over them."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where it names none, a local master (one process for all) gets a folder of this process that goes with it; on a
    cluster that is an error, since executors would each write to a disk of their own.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.conf.get("spark.master", "")
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that the driver and all executors share (master: {master or 'not known'})")
        own = tempfile.mkdtemp(prefix="leadspark-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        where = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


_SCOPES: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that were ``stored`` inside, but those to be kept, once the block has ended without an error."""
    _SCOPES.append([])
    try:
        yield
    except BaseException:
        _SCOPES.pop()
        raise
    for path in _SCOPES.pop():
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, keep: bool = False) -> DataFrame:
    """The rows as a Parquet table in the shared folder: executed once, cut from their lineage, safe when executors are lost."""
    path = f"{shared_dir(df.sparkSession)}/leadspark/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _SCOPES and not keep:
        _SCOPES[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def placed(rows: DataFrame, keys: list[str], *order: Column, name: str = "place") -> DataFrame:
    """The rows with their place (from 0) among those of their keys. The order must leave no ties.

    Rows are dealt by ranges of keys and order, counted within each range, and moved up by what the ranges before hold; so
    a key with most of the rows is spread over all tasks too.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(rows.withColumn("_at", F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)))).repartitionByRange(parts, *keys, "_at").withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy("_at")) - 1
    # written, so that the join's sides are plain exchanges
    sizes = stored(sizes.select(*keys, "_part", before.alias("_before")))
    return dealt.withColumn(name, within).join(sizes, [*keys, "_part"]).withColumn(name, F.col(name) + F.col("_before")).drop("_at", "_part", "_before")
