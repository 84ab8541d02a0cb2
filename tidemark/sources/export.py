"""Writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def export_points(points: DataFrame, date_format: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """The exported columns: analysis_id, date, observed, counterfactual."""
    return points.select("analysis_id", F.date_format("ts", date_format).alias("date"), "observed", "counterfactual")


def write_points(points: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One folder per analysis, so that one analysis can be read back without the others."""
    out = export_points(points)
    writer = out.write.mode("overwrite").partitionBy("analysis_id")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)
