"""Exports of a run's leads: CSV for spreadsheets and JSON."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspark.constants import EXPORT_COLUMNS
from leadspark.operators.read_models import list_shippable_leads


def csv_cell(c: Column) -> Column:
    """Quoted, quotes doubled; what a spreadsheet would run as a formula gets a tab in front; null is empty and unquoted."""
    safe = F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("\t"), c)).otherwise(c)
    return F.coalesce(F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"')), F.lit(""))


def _text(leads: DataFrame, name: str) -> Column:
    if name == "linkedin":
        return F.coalesce(F.try_element_at("socials", F.lit("linkedin")), F.lit(""))
    kind = leads.schema[name].dataType.simpleString()
    if kind.startswith("array"):
        return F.array_join(name, "; ", "")
    if kind.startswith(("decimal", "double")):  # numbers as they are written shortest
        return F.regexp_replace(F.regexp_replace(F.format_string("%.2f", F.col(name).cast("double")), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.col(name).cast("string")


def csv_lines(leads: DataFrame) -> DataFrame:
    """One line a lead, in the lead's own order of columns."""
    return leads.select("id", F.concat_ws(",", *(csv_cell(_text(leads, c)) for c in EXPORT_COLUMNS)).alias("line"))


def write_csv(leads: DataFrame, run_id: str, path: str) -> None:
    """One file with a byte-order mark, CRLF between lines and none at the end; one partition holds a run's leads, low hundreds."""
    order = [F.desc("score"), F.asc_nulls_last("company_name")]
    rows = list_shippable_leads(leads, run_id)
    lines = csv_lines(rows).join(rows.select("id", "score", "company_name"), "id").select("line", F.lit(1).alias("part"), "score", "company_name")
    head = leads.sparkSession.createDataFrame([("\ufeff" + ",".join(EXPORT_COLUMNS),)], "line string").select("line", F.lit(0).alias("part"), F.lit(None).cast(rows.schema["score"].dataType).alias("score"), F.lit(None).cast("string").alias("company_name"))
    head.unionByName(lines).repartition(1).sortWithinPartitions("part", *order).select("line").write.mode("overwrite").option("lineSep", "\r\n").text(path)


def json_document(runs: DataFrame, leads: DataFrame, run_id: str) -> DataFrame:
    """One row with the document; none if there is no such run."""
    rows = list_shippable_leads(leads, run_id)
    row = F.struct((-F.col("score").cast("double")).alias("o"), F.coalesce("company_name", F.lit("\uffff")).alias("n"), F.struct(*rows.columns).alias("lead"))
    less = lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).when(a["n"] < b["n"], -1).when(a["n"] > b["n"], 1).otherwise(0)
    body = rows.agg(F.array_sort(F.collect_list(row), less).alias("rows"))
    run = runs.filter(F.col("id") == run_id).select(F.struct("id", "query", "finished_at").alias("run"))
    return run.join(body, F.lit(True), "left").select(F.to_json(F.struct("run", F.transform("rows", lambda r: r["lead"]).alias("leads"))).alias("document"))


def file_name(run_id: str, kind: str, day: date) -> str:
    return f"leads-{run_id[:8]}-{day.isoformat()}.{'csv' if kind == 'csv' else 'json'}"
