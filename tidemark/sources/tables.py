"""Reading tables: Parquet as it is, CSV as text to be typed by the cleaning steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder.  Timestamps are read as wall-clock UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header.  Without a schema every column is text: no second pass to infer types."""
    reader = spark.read.option("header", True).option("encoding", "UTF-8")
    return (reader.schema(schema) if schema else reader).csv(path)


def check_input(df: DataFrame) -> DataFrame:
    """The gate every input passes: at least two columns and one row."""
    if len(df.columns) < 2:
        raise ValueError("a date and a metric take at least 2 columns")
    if df.isEmpty():
        raise ValueError("the input has no data rows")
    return df
