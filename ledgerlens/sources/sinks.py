"""Sinks: JSON records (S11) and the transaction CSV export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.formatting import iso_date

# Fixed value: the export's header line.
EXPORT_HEADER = "Date,Merchant,Description,Amount,Category"


def to_records(df: DataFrame, include_category: bool = False) -> DataFrame:
    """Lower-case names, ISO date text, amount as a number."""
    cols = [
        iso_date("date").alias("date"),
        F.col("merchant"),
        F.col("description"),
        F.col("amount").cast("double").alias("amount"),
    ]
    if include_category:
        cols.append(F.col("category"))
    return df.select(*cols)


def write_records(df: DataFrame, path: str, include_category: bool = False) -> None:
    to_records(df, include_category).write.mode("overwrite").json(path)


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def export_line(df: DataFrame) -> Column:
    """One export line; merchant and description always quoted with
    doubled inner quotes, amount with two decimals, category unquoted."""
    return F.concat_ws(
        ",",
        F.coalesce(iso_date("date"), F.lit("")),
        _quoted(F.col("merchant")),
        _quoted(F.col("description")),
        F.col("amount").cast("decimal(38,2)").cast("string"),
        F.coalesce(F.col("category"), F.lit("")) if "category" in df.columns else F.lit(""),
    )


def export_lines(df: DataFrame) -> DataFrame:
    return df.select(F.col("txn_id"), export_line(df).alias("line"))


def export_csv(df: DataFrame, path: str) -> None:
    """Write the export as text parts. A one-row header frame is unioned in
    front of the lines: a union keeps its inputs' partition order, so
    part-00000 holds the header and the parts, concatenated in name order,
    form the export. No global sort, no single-task write."""
    header = df.sparkSession.createDataFrame([(EXPORT_HEADER,)], "value string").coalesce(1)
    lines = df.select(export_line(df).alias("value"))
    header.unionByName(lines).write.mode("overwrite").text(path)
