"""Which column holds dates, which hold numbers: one aggregate over the table decides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Recognised date spellings (pattern, Spark format; None = ISO cast), and the share of
# values that must parse.
DATE_FORMATS = (
    (r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?)?Z?$", None),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-yyyy"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^(19|20)\d{2}(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])$", "yyyyMMdd"),
    (r"^(19|20)\d{2}-(0[1-9]|1[0-2])$", "yyyy-MM"),
    (r"^(19|20)\d{2}$", "yyyy"),
)
MAJORITY = 0.5
NOT_NUMERIC = r"[^\d.\-]"


def parse_timestamp(text: Column, day_first: bool = False) -> Column:
    """A timestamp from any of the recognised spellings, else null.

    A cheap pattern picks the one format to try, as failing parses are slow.  ``day_first``: 1/2/2021 is in February.
    """
    text = F.trim(text)
    parsed = None
    for pattern, fmt in DATE_FORMATS:
        if fmt is None:
            value = text.try_cast("timestamp")
        else:
            value = F.try_to_timestamp(text, F.lit(fmt))
            if fmt == "M/d/yyyy":
                other = F.try_to_timestamp(text, F.lit("d/M/yyyy"))
                value = F.coalesce(other, value) if day_first else F.coalesce(value, other)
        branch = text.rlike(pattern)
        parsed = F.when(branch, value) if parsed is None else parsed.when(branch, value)
    return parsed


def day_comes_first(df: DataFrame, column: str) -> bool:
    """Whether the dates with slashes in a text column must be d/M: more have a first number over 12 than a second one."""
    first, second = (F.regexp_extract(F.trim(F.col(f"`{column}`")), DATE_FORMATS[1][0].replace(r"\d{1,2}", r"(\d{1,2})"), i).try_cast("int") for i in (1, 2))
    row = df.agg(F.count(F.when((first > 12) & (second <= 12), 1)).alias("d"), F.count(F.when((second > 12) & (first <= 12), 1)).alias("m")).first()
    return row.d > row.m


def parse_number(text: Column) -> Column:
    """A double after stripping everything but digits, points and minus signs, else null."""
    return F.regexp_replace(text, NOT_NUMERIC, "").try_cast("double")


def is_time(kind: T.DataType) -> bool:
    return isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_number(kind: T.DataType) -> bool:
    return isinstance(kind, (T.NumericType, T.BooleanType))


def column_profile(df: DataFrame, strict_numbers: bool = False) -> DataFrame:
    """One row per column: ordinal, column_name, date_rate, number_rate.

    A typed column has rate 1 for its own kind; text is parsed.  All rates come from one aggregate.
    ``strict_numbers`` parses numbers without stripping currency signs and the like.
    """
    rates = []
    for field in df.schema.fields:
        name = F.col(f"`{field.name}`")
        text = name.cast("string")
        number = text.try_cast("double") if strict_numbers else parse_number(text)
        known_time, known_number = is_time(field.dataType), is_number(field.dataType)
        rates.append((
            F.lit(1.0) if known_time else F.avg(parse_timestamp(text).isNotNull().cast("double")),
            F.lit(1.0) if known_number else F.lit(0.0) if known_time else F.avg(number.isNotNull().cast("double")),
            known_time,
        ))
    one_row = df.agg(F.array(*[
        F.struct(
            F.lit(i).cast("long").alias("ordinal"),
            F.lit(field.name).alias("column_name"),
            F.lit(known_time).alias("is_datetime"),
            F.coalesce(date_rate, F.lit(0.0)).alias("date_rate"),
            F.coalesce(number_rate, F.lit(0.0)).alias("number_rate"),
        )
        for i, (field, (date_rate, number_rate, known_time)) in enumerate(zip(df.schema.fields, rates, strict=True))
    ]).alias("columns"))
    return one_row.select(F.inline("columns"))


def choose_date_column(profile: DataFrame) -> DataFrame:
    """The first typed date column, else the first whose values mostly parse; at most one row."""
    return (
        profile.where(F.col("is_datetime") | (F.col("date_rate") > MAJORITY))
        .orderBy(F.col("is_datetime").desc(), "ordinal")
        .limit(1)
        .select("ordinal", "column_name", "date_rate")
    )


def choose_numeric_columns(profile: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Columns that are numeric or mostly parse as numbers, in table order."""
    chosen = profile.where(F.col("number_rate") > MAJORITY)
    if exclude:
        chosen = chosen.where(~F.col("column_name").isin(list(exclude)))
    return chosen.select("ordinal", "column_name", "number_rate")


def detect_date_column(df: DataFrame) -> str | None:
    row = choose_date_column(column_profile(df)).first()
    return row["column_name"] if row else None


def detect_numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [r["column_name"] for r in choose_numeric_columns(column_profile(df), exclude).orderBy("ordinal").collect()]


def validate_table(df: DataFrame) -> tuple[str, str]:
    """(date column, metric column) of a table, or an error naming what is missing."""
    if len(df.columns) < 2:
        raise ValueError("a date and a metric take at least 2 columns")
    if df.isEmpty():
        raise ValueError("the table is empty")
    profile = sorted(column_profile(df, strict_numbers=True).collect(), key=lambda r: r["ordinal"])
    date = next((r["column_name"] for r in profile if r["is_datetime"] or r["date_rate"] > MAJORITY), None)
    if date is None:
        raise ValueError("No date column: in none do most values read as dates")
    metric = next((r["column_name"] for r in profile if r["column_name"] != date and r["number_rate"] > MAJORITY), None)
    if metric is None:
        raise ValueError("No numeric metric: in no other column do most values read as numbers")
    return date, metric
