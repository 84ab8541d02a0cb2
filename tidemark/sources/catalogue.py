"""A catalogue of named analyses, as rows."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import scan_csv


class Dataset(NamedTuple):
    name: str
    date_col: str
    metric_col: str
    intervention_date: str
    frequency: str


# The bundled analyses, by the name of their file.
CATALOGUE = (
    Dataset("delhi_aqi", "date", "pm25", "2020-03-25", "daily"),
    Dataset("gst_revenue", "month", "revenue_cr", "2017-07-01", "monthly"),
    Dataset("hospital_admissions", "date", "admissions", "2021-01-01", "weekly"),
    Dataset("electricity_demand", "datetime", "demand_mwh", "2023-06-01", "hourly"),
    Dataset("crime_rates", "date", "incidents", "2020-01-01", "monthly"),
    Dataset("student_scores", "year", "score", "2019-01-01", "yearly"),
    Dataset("traffic_accidents", "date", "accidents", "2021-06-01", "daily"),
    Dataset("website_sessions", "date", "sessions", "2023-03-01", "daily"),
    Dataset("mask_mandates", "date", "admissions", "2020-04-01", "monthly"),
    Dataset("interest_rates", "date", "applications", "2022-03-01", "monthly"),
    Dataset("carbon_tax", "date", "emissions_kt", "2019-01-01", "quarterly"),
)


def spec_table(spark: SparkSession, entries: Sequence[Dataset] = CATALOGUE) -> DataFrame:
    """(name, date_col, ..., intervention_ts): one row per named analysis."""
    rows = spark.createDataFrame([tuple(e) for e in entries], ", ".join(f"{c} string" for c in Dataset._fields))
    return rows.withColumn("intervention_ts", F.col("intervention_date").cast("timestamp"))


def load_dataset(spark: SparkSession, folder: str, name: str, entries: Sequence[Dataset] = CATALOGUE) -> DataFrame:
    """The named CSV of ``folder`` as text columns; an unknown name or a missing file is an error."""
    known = [e.name for e in entries]
    if name not in known:
        raise ValueError(f"Unknown dataset: {name}. Available: {known}")
    return scan_csv(spark, f"{folder}/{name}.csv")
