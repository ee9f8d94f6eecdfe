"""Queries of the lines that fail to parse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.rejects import cell_errors, parse_cells, split_rejects
from gridloom.sources.tables import table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of the lines that give no record."""
    return cell_errors(parse_cells(table(spark, folder, "raw_annotations"))).select(F.col("_row").alias("line_id"))


def p3_records(spark: SparkSession, folder: str) -> DataFrame:
    """The loadable lines as typed records."""
    return split_rejects(table(spark, folder, "raw_annotations"))[0]


def p3_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Every rejected line with its reasons."""
    return split_rejects(table(spark, folder, "raw_annotations"))[1].select("line_id", F.array_join("reasons", " ").alias("reasons"))


QUERIES = {"p3_found": p3_found, "p3_records": p3_records, "p3_reasons": p3_reasons}
SQL: dict[str, str] = {}
