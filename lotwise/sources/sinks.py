"""Writers of the results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EMPTY = '""'
MISSING = ""


def sink_csv(df: DataFrame, path: str) -> None:
    """CSV with header; an empty string is written quoted and NULL as nothing, so they stay distinct."""
    df.write.mode("overwrite").option("header", True).option("emptyValue", EMPTY).option("nullValue", MISSING).csv(path)


def read_back_csv(spark, path: str, schema: str) -> DataFrame:
    return (
        spark.read.schema(schema).option("header", True)
        .option("emptyValue", "").option("nullValue", None).csv(path)
    )


def sink_report_json(report: DataFrame, path: str) -> None:
    """Nested report, one JSON document per row."""
    report.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def report_text(report: DataFrame) -> DataFrame:
    return report.select(F.to_json(F.struct(*report.columns), {"ignoreNullFields": "false"}).alias("report"))
