"""The registered queries: every operator on the test tables, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.stats import chi2_upper_p
from tidemark.operators import clean, detect, did, inference, placebo, report, series, subgroup, synth, whatif
from tidemark.operators.arima import ArimaPlan, candidate_orders, difference
from tidemark.operators.arima import seasonal_period as period_for
from tidemark.operators.structural import LocalLevelPlan
from tidemark.plans.effects import Analysis, causal_effects, causal_points
from tidemark.session import checkpointed, shared_folder
from tidemark.sources.export import write_points
from tidemark.sources.tables import read_table, scan_csv

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

EVENTS_AT = "2024-01-16 00:00:00"
ORDERS_AT = "1998-01-01 00:00:00"
ONE = [("mid", EVENTS_AT)]
KEY = ["event_type"]
BY = ["analysis_id", *KEY]


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def shown(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, timestamps as text: what a report prints.

    Means of a few prices often end in an exact 5; the small addend keeps rounding off such ties.
    """
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DoubleType):
            out.append(F.round(F.col(f.name) + 1e-8, digits).alias(f.name))
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            out.append(F.date_format(f.name, "yyyy-MM-dd HH:mm:ss").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def events(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "events")


def hourly(spark: SparkSession, d: str) -> DataFrame:
    rows = series.to_series(events(spark, d), KEY, "ts", "value", "hour")
    return series.index_series(rows, KEY, "hour")


def prepared_hourly(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Hourly series by event type in blocks, and their analyses."""
    blocked = series.prepare(hourly(spark, d), KEY)
    return blocked, located(series.own_rows(blocked))


def located(indexed: DataFrame, **kwargs) -> DataFrame:
    return series.locate_interventions(indexed, KEY, ONE, **kwargs)


def daily_orders(spark: SparkSession, d: str) -> DataFrame:
    rows = series.to_series(read_table(spark, d, "orders"), ["o_orderpriority"], "o_orderdate", "o_totalprice", "day")
    return series.index_series(rows, ["o_orderpriority"], "day")


def segment_rows(spark: SparkSession, d: str) -> DataFrame:
    """(unit, ts, y, month): orders with the market segment of their customer."""
    orders = read_table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    customers = read_table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_nationkey")
    return orders.join(customers, "o_custkey").select(
        F.col("c_mktsegment").alias("unit"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("y"),
        F.date_trunc("month", "o_orderdate").alias("month"), "c_nationkey",
    )


SEGMENTS = [("building", "BUILDING", ORDERS_AT), ("machinery", "MACHINERY", "1999-06-01 00:00:00")]


def segment_moments(spark: SparkSession, d: str) -> DataFrame:
    return checkpointed(did.panel_moments(segment_rows(spark, d), "unit", "ts", "y"))


def status_panel(spark: SparkSession, d: str) -> DataFrame:
    """Monthly mean order value by order status: one treated unit and two donors."""
    rows = read_table(spark, d, "orders").withColumn("month", F.date_trunc("month", "o_orderdate"))
    return checkpointed(synth.sc_panel(rows, "o_orderstatus", "month", "o_totalprice"))


STATUS = [("p", "P", ORDERS_AT)]


def mean_points(spark: SparkSession, d: str) -> DataFrame:
    """Points whose counterfactual is the pre-period mean, to check everything downstream of a model."""
    indexed = hourly(spark, d)
    rows = series.pre_post_split(indexed, located(indexed), KEY)
    pre = rows.where("not is_post").groupBy(*BY).agg(F.avg("y").alias("m"), F.stddev_samp("y").alias("s"))
    return rows.join(pre, BY).select(
        *BY, "t", "ts", "is_post", F.col("y").alias("observed"), F.col("m").alias("counterfactual"),
        (F.col("m") - 1.96 * F.col("s")).alias("cf_lower"), (F.col("m") + 1.96 * F.col("s")).alias("cf_upper"),
    )


def dirty(spark: SparkSession, d: str) -> DataFrame:
    """Events as an untidy text table: mixed date spellings, currency signs, gaps, an empty column, copies."""
    e = events(spark, d)
    i = F.col("event_id")
    stamp = (
        F.when(i % 23 == 0, "not-a-date")
        .when(i % 5 == 0, F.date_format("ts", "M/d/yyyy"))
        .when(i % 7 == 0, F.date_format("ts", "d MMM yyyy"))
        .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    )
    price = F.when(i % 11 == 0, "n/a").when(i % 17 == 0, None).otherwise(F.concat(F.lit("$"), F.col("value").cast("string")))
    return e.select(
        F.concat(F.lit("id "), i).alias(" Event ID "),
        stamp.alias("Event-Time"),
        price.alias("Price ($)"),
        F.when(i % 13 != 0, F.col("event_type")).alias("Event Type"),
        F.lit(None).cast("string").alias("Empty"),
        F.explode(F.when(i % 19 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")


# Sources and sinks


@query
def scan_csv_series(spark, d):
    path = shared_folder(spark, "csv")
    rows = series.to_series(events(spark, d), KEY, "ts", "value", "hour")
    rows.select("event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "y").write.option("header", True).csv(path)
    typed = clean.parse_numeric(clean.parse_dates(scan_csv(spark, path), "ts"), "y")
    return shown(typed.groupBy("event_type").agg(
        F.count("y").alias("n"), F.avg("y").alias("mean"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    ))


@query
def analysis_specs(spark, d):
    specs = spark.createDataFrame(
        [("clicks", "click", "2024-01-10 00:00:00"), ("views", "view", "2024-01-16 00:00:00"),
         ("late clicks", "click", "2024-01-20 00:00:00")],
        "analysis_id string, event_type string, at string",
    ).select("analysis_id", "event_type", F.col("at").cast("timestamp").alias("intervention_ts"))
    rows = series.attach_specs(events(spark, d).select("event_type", "ts", "value"), specs)
    post = F.col("ts").cast("timestamp") >= F.col("intervention_ts")
    return shown(rows.groupBy("analysis_id", "event_type").agg(
        F.count(F.when(~post, 1)).alias("n_before"), F.count(F.when(post, 1)).alias("n_after"),
        F.avg(F.when(~post, F.col("value"))).alias("mean_before"), F.avg(F.when(post, F.col("value"))).alias("mean_after"),
    ))


@query
def export_points(spark, d):
    path = shared_folder(spark, "points")
    write_points(mean_points(spark, d).withColumn("analysis_id", F.concat_ws("-", "analysis_id", "event_type")), path)
    return shown(spark.read.parquet(path).select(F.col("analysis_id").cast("string"), "date", "observed", "counterfactual"))


@query
def detect_date_column(spark, d):
    return shown(detect.choose_date_column(detect.column_profile(dirty(spark, d))))


@query
def detect_numeric_columns(spark, d):
    return shown(detect.choose_numeric_columns(detect.column_profile(dirty(spark, d)), ["Event-Time"]))


@query
def validate_table(spark, d):
    e = events(spark, d).select(F.col("event_type"), F.col("ts").cast("string").alias("ts"), F.col("value").cast("string").alias("value"))
    date, metric = detect.validate_table(e)
    return shown(e.select(F.lit(date).alias("date_col"), F.lit(metric).alias("metric_col"), F.col(metric).try_cast("double").alias("v"))
                 .groupBy("date_col", "metric_col").agg(F.count("v").alias("n"), F.avg("v").alias("mean")))


# Cleaning


@query
def clean_names(spark, d):
    return clean.clean_column_names(dirty(spark, d))


@query
def drop_empty_cols(spark, d):
    return clean.clean_column_names(clean.drop_empty_columns(dirty(spark, d)))


@query
def drop_empty_rows(spark, d):
    gone = F.col("event_id") % 13 == 0
    e = events(spark, d)
    return clean.drop_empty_rows(e.select(*[F.when(~gone, F.col(c)).alias(c) for c in ("event_id", "event_type", "value")]))


@query
def drop_duplicates(spark, d):
    return clean.drop_duplicates(events(spark, d).select("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")))


@query
def parse_dates(spark, d):
    table = clean.clean_column_names(dirty(spark, d)).select("event_id", "event_time")
    return shown(clean.parse_dates(table, "event_time"))


@query
def date_from_year_month(spark, d):
    o = read_table(spark, d, "orders").select(
        F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), F.col("o_totalprice").alias("value")
    )
    dated = clean.date_from_year_month(o, *clean.year_month_columns(o))
    return shown(dated.groupBy(F.col(clean.CONSTRUCTED).alias("date")).agg(F.count("value").alias("n"), F.avg("value").alias("mean")))


@query
def parse_numeric(spark, d):
    return clean.parse_numeric(clean.clean_column_names(dirty(spark, d)).select("event_id", "price"), "price")


def gappy(spark, d):
    indexed = hourly(spark, d)
    return indexed.select("event_type", "ts", "t", F.when(F.col("t") % 17 >= 3, F.col("y")).alias("y"))


@query
def missing_drop(spark, d):
    return shown(clean.missing_drop(gappy(spark, d)))


@query
def missing_ffill(spark, d):
    return shown(clean.forward_fill(gappy(spark, d), KEY, "ts", ["y"], "minute"))


@query
def missing_mean(spark, d):
    return shown(clean.fill_mean(gappy(spark, d), KEY, ["y"]))


@query
def outliers_iqr(spark, d):
    return clean.outliers_iqr(events(spark, d).select("event_id", "event_type", "value"), "value", KEY)


@query
def outliers_zscore(spark, d):
    return clean.outliers_zscore(events(spark, d).select("event_id", "event_type", "value"), "value", KEY)


def prepared(spark, d):
    return clean.preprocess(dirty(spark, d), metric_col="price", missing="drop", outliers="iqr")


@query
def preprocess_pipeline(spark, d):
    return shown(prepared(spark, d).df)


@query
def preprocess_report(spark, d):
    return prepared(spark, d).steps()


# Series


@query
def dedupe_dates_mean(spark, d):
    return shown(series.to_series(read_table(spark, d, "orders"), ["o_orderpriority"], "o_orderdate", "o_totalprice"))


@query
def series_index(spark, d):
    rows = series.index_series(series.to_series(events(spark, d), KEY, "ts", "value"), KEY)
    return rows.select("event_type", F.unix_micros("ts").alias("micros"), "t")


@query
def intervention_index(spark, d):
    specs = [("mid", EVENTS_AT), ("tie", "2024-01-10 06:30:00"), ("before", "2023-01-01"), ("after", "2025-01-01")]
    found = series.locate_interventions(hourly(spark, d), KEY, specs)
    return found.select(*BY, "idx", "n", "status")


@query
def intervention_index_specs(spark, d):
    """A spec table as large as the data: every event is an analysis of its user's hourly series."""
    rows = series.to_series(events(spark, d), ["user_id"], "ts", "value", "hour")
    specs = events(spark, d).select(F.col("event_id").alias("analysis_id"), "user_id", (F.col("ts") + F.expr("INTERVAL 7 HOURS")).alias("intervention_ts"))
    found = series.locate_interventions(series.index_series(rows, ["user_id"], "hour"), ["user_id"], specs, min_length=None)
    return found.select("analysis_id", "user_id", "idx", "n", "status")


@query
def series_rejects(spark, d):
    rows = clean.clean_column_names(dirty(spark, d)).withColumn("price", F.ltrim(F.col("price"), F.lit("$")))
    return series.rejected_rows(rows, KEY, "event_time", "price")


@query
def validate_windows(spark, d):
    rows = series.to_series(events(spark, d), ["user_id"], "ts", "value", "day")
    specs = [("early", "2024-01-02"), ("mid", "2024-01-16"), ("late", "2024-01-30")]
    found = series.locate_interventions(series.index_series(rows, ["user_id"], "day"), ["user_id"], specs, min_length=None)
    return found.select("analysis_id", "user_id", "idx", "n", "status")


@query
def validate_length(spark, d):
    rows = series.to_series(events(spark, d), ["user_id"], "ts", "value", "hour")
    found = series.locate_interventions(series.index_series(rows, ["user_id"], "hour"), ["user_id"], ONE)
    return found.select("user_id", "n", "status")


@query
def pre_post_split(spark, d):
    indexed = hourly(spark, d)
    split = series.pre_post_split(indexed, located(indexed), KEY)
    return shown(split.groupBy(*BY, "is_post").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), F.min("t").alias("first_t")))


# Interrupted time series


@query
def arima_candidates(spark, d):
    h = hourly(spark, d)
    o = daily_orders(spark, d)
    specs = [("orders", ORDERS_AT)]
    daily = series.locate_interventions(o, ["o_orderpriority"], specs).withColumnRenamed("o_orderpriority", "series_key")
    return candidate_orders(daily.unionByName(located(h).withColumnRenamed("event_type", "series_key"))).select(
        "analysis_id", "series_key", F.col("p").cast("long"), F.col("d").cast("long"), F.col("q").cast("long")
    )


@query
def difference_series(spark, d):
    h = hourly(spark, d)
    both = difference(h, KEY, 1).withColumn("kind", F.lit("d1")).unionByName(
        difference(h, KEY, 1, 1, 12).withColumn("kind", F.lit("d1_D1_s12"))
    )
    return shown(both.select("kind", "event_type", "t", "z"))


def fixed_order(p, dd, q):
    return F.array(F.lit(p), F.lit(dd), F.lit(q))


def ar1_plan(spark, d, dd=0):
    blocked, found = prepared_hourly(spark, d)
    return ArimaPlan(blocked, found.withColumn("order", fixed_order(1, dd, 0)), KEY)


@query
def arima_fit(spark, d):
    level = ar1_plan(spark, d).models()
    walk = ar1_plan(spark, d, 1).models()
    fits = level.withColumn("d", F.lit(0).cast("long")).unionByName(walk.withColumn("d", F.lit(1).cast("long")))
    # with d = 1 the recursion is y(t) = (1 + phi) y(t-1) - phi y(t-2)
    phi = F.when(F.col("d") == 0, F.get("model.ar", F.lit(0))).otherwise(-F.get("model.ar", F.lit(1)))
    const = F.when(F.col("d") == 0, F.col("model.const") + F.col("pivot") * (1 - phi)).otherwise(F.col("model.const"))
    return shown(fits.select(*BY, "d", const.alias("const"), phi.alias("phi"), F.col("model.sigma2").alias("sigma2"), F.col("model.aic").alias("aic")))


@query
def arima_order_aic(spark, d):
    tried = ArimaPlan(*prepared_hourly(spark, d), KEY).candidates()
    return shown(tried.select(*BY, F.inline("candidates")))


@query
def seasonal_period(spark, d):
    n_events = events(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    n_orders = read_table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    sizes = n_events.select(F.concat(F.lit("user "), "user_id").alias("series_key"), "n").unionByName(
        n_orders.select(F.col("o_orderpriority").alias("series_key"), "n")
    )
    return sizes.select("series_key", "n", period_for(F.col("n")).cast("long").alias("period"))


@query
def arima_forecast(spark, d):
    plan = ar1_plan(spark, d)
    return shown(plan.forecasts(plan.models()))


@query
def its_points_ar1(spark, d):
    plan = ar1_plan(spark, d)
    return shown(plan.points(plan.models()).drop("fit_t"))


@query
def its_effects_ar1(spark, d):
    plan = ar1_plan(spark, d)
    models = plan.models()
    return shown(plan.effects(models, plan.points(models)).select(
        *BY, "effect", "effect_pct", "cf_ci_lower", "cf_ci_upper", "effect_ci_lower", "effect_ci_upper", "p_value",
        "significant", "direction", "n_pre", "n_post", "ljung_box_pvalue", "residuals_ok",
    ))


@query
def its_points(spark, d):
    plan = ArimaPlan(*prepared_hourly(spark, d), KEY)
    return shown(plan.points(plan.models()).drop("fit_t"))


@query
def its_effects(spark, d):
    plan = ArimaPlan(*prepared_hourly(spark, d), KEY)
    models = plan.models()
    return shown(plan.effects(models, plan.points(models)))


@query
def sarimax_fit(spark, d):
    models = ArimaPlan(*prepared_hourly(spark, d), KEY, seasonal=True).models()
    return shown(models.select(*BY, "arima_order", "seasonal_order", "model.aic", "model.sigma2"))


@query
def sarimax_effects(spark, d):
    blocked = series.prepare(daily_orders(spark, d), ["o_orderpriority"])
    found = series.locate_interventions(series.own_rows(blocked), ["o_orderpriority"], [("orders", ORDERS_AT)])
    plan = ArimaPlan(blocked, found, ["o_orderpriority"], seasonal=True)
    models = plan.models()
    return shown(plan.effects(models, plan.points(models)))


@query
def sarimax_hourly(spark, d):
    """A season of a day on hourly series, at a fixed order: y on the hour and the day before."""
    blocked, found = prepared_hourly(spark, d)
    orders = {"order": fixed_order(1, 0, 0), "seasonal_order": F.array(*map(F.lit, (1, 0, 0, 24)))}
    plan = ArimaPlan(blocked, found.withColumns(orders), KEY, seasonal=True, period=24)
    models = plan.models()
    hour, day = F.get("model.ar", F.lit(0)), F.get("model.ar", F.lit(23))
    fits = models.select(
        *BY, "fit_status", (F.col("model.const") + F.col("pivot") * (1 - hour - day)).alias("const"), hour.alias("phi_hour"), day.alias("phi_day"),
        F.col("model.sigma2").alias("sigma2"),
    )
    effects = plan.effects(models, plan.points(models)).select(*BY, "aic", "effect", "effect_pct", "n_pre", "n_post")
    return shown(fits.join(effects, BY, "left"))


@query
def fit_failures(spark, d):
    """Daily series with so few days before the date that nothing can be fitted, and dates out of reach."""
    analyses = [Analysis("four days", "2024-01-05"), Analysis("one day", "2024-01-02"), Analysis("four days, level", "2024-01-05", "bsts"), Analysis("last day", "2024-01-30")]
    rows = causal_effects(events(spark, d).select("event_type", "ts", "value"), "event_type", "ts", "value", analyses, "day")
    return rows.select("analysis_id", "series_key", "method", "status", F.col("effect").isNotNull().alias("has_effect"), "n_pre", "n_post")


@query
def effect_summary(spark, d):
    return shown(inference.effect_summary(mean_points(spark, d), BY))


@query
def ljung_box(spark, d):
    residuals = mean_points(spark, d).where("not is_post").select(*BY, "t", (F.col("observed") - F.col("counterfactual")).alias("residual"))
    return shown(inference.ljung_box(residuals, BY).withColumn("n_lags", F.col("n_lags").cast("long")))


# Structural series


@query
def local_level_effects(spark, d):
    plan = LocalLevelPlan(*prepared_hourly(spark, d), KEY)
    models = plan.models()
    return shown(plan.effects(models, plan.points(models)))


@query
def pointwise_ci(spark, d):
    return shown(inference.pointwise_ci(mean_points(spark, d), BY))


# Difference-in-differences


@query
def did_spec_check(spark, d):
    specs = [*SEGMENTS, ("unknown", "NO SUCH UNIT", ORDERS_AT), ("early", "BUILDING", "1990-01-01"), ("late", "BUILDING", "2010-01-01")]
    return did.spec_check(segment_moments(spark, d), specs)


@query
def did_design(spark, d):
    rows = did.design(segment_rows(spark, d), SEGMENTS)
    return shown(rows.groupBy("analysis_id", "unit", "treated", "post", "treated_x_post").agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean")
    ))


@query
def did_cell_means(spark, d):
    return shown(did.cell_means(segment_moments(spark, d), SEGMENTS).drop("sse"))


@query
def did_effect(spark, d):
    return shown(did.did_effects(segment_moments(spark, d), SEGMENTS).select("analysis_id", "effect", "effect_pct", "direction"))


@query
def did_inference(spark, d):
    return shown(did.did_effects(segment_moments(spark, d), SEGMENTS).select(
        "analysis_id", "effect", "effect_se", "effect_ci_lower", "effect_ci_upper", "p_value", "significant", "n_treated", "n_control", "df_resid"
    ))


@query
def did_points(spark, d):
    moments = checkpointed(did.panel_moments(segment_rows(spark, d), "unit", "month", "y"))
    return shown(did.did_points(moments, SEGMENTS))


@query
def did_parallel_trends(spark, d):
    return shown(did.parallel_trends(segment_moments(spark, d), SEGMENTS))


# Synthetic control


@query
def sc_spec_check(spark, d):
    specs = [*STATUS, ("unknown", "X", ORDERS_AT), ("late", "P", "2010-01-01")]
    return did.spec_check(status_panel(spark, d), specs)


@query
def sc_panel(spark, d):
    return shown(synth.sc_panel(segment_rows(spark, d), "unit", "month", "y"))


@query
def sc_gram(spark, d):
    panel = checkpointed(synth.sc_panel(segment_rows(spark, d), "unit", "month", "y"))
    return shown(synth.donor_products(panel, SEGMENTS), 1)


@query
def sc_weights(spark, d):
    panel = status_panel(spark, d)
    return shown(synth.sc_weights(panel, STATUS))


@query
def sc_weights_nations(spark, d):
    panel = checkpointed(synth.sc_panel(segment_rows(spark, d), "c_nationkey", "month", "y"))
    return shown(synth.sc_weights(panel, [(f"nation {i}", str(i), ORDERS_AT) for i in range(3)]))


def status_points(spark, d):
    panel = status_panel(spark, d)
    return synth.sc_points(panel, synth.sc_weights(panel, STATUS), STATUS)


@query
def sc_points(spark, d):
    return shown(status_points(spark, d))


@query
def sc_rmspe(spark, d):
    return shown(synth.sc_effects(status_points(spark, d)).select("analysis_id", "pre_rmspe", "post_rmspe", "rmspe_ratio"))


@query
def sc_effect(spark, d):
    return shown(synth.sc_effects(status_points(spark, d)).drop("pre_rmspe", "post_rmspe", "rmspe_ratio"))


# Robustness


@query
def placebo_indices(spark, d):
    h = hourly(spark, d)
    return placebo.placebo_indices(located(h), KEY, None).select(*BY, "placebo_idx")


@query
def placebo_draw(spark, d):
    """Fifty dates of every hourly series and of every daily one, whose ranges are much wider."""
    daily = series.locate_interventions(daily_orders(spark, d), ["o_orderpriority"], [("orders", ORDERS_AT)])
    both = located(hourly(spark, d)).withColumnRenamed("event_type", "series_key").unionByName(daily.withColumnRenamed("o_orderpriority", "series_key"))
    return placebo.placebo_indices(both, ["series_key"]).select("analysis_id", "series_key", "placebo_idx")


def ar1_placebos(spark, d):
    blocked, found = prepared_hourly(spark, d)
    return placebo.placebo_effects(blocked, found.withColumn("order", fixed_order(1, 0, 0)), KEY, None)


@query
def placebo_effects_ar1(spark, d):
    return shown(ar1_placebos(spark, d))


@query
def placebo_effects(spark, d):
    return shown(placebo.placebo_effects(*prepared_hourly(spark, d), KEY))


@query
def placebo_summary(spark, d):
    return shown(placebo.placebo_summary(ar1_placebos(spark, d), KEY))


@query
def placebo_histogram(spark, d):
    return placebo.placebo_histogram(ar1_placebos(spark, d), KEY)


@query
def segment_calendar(spark, d):
    e = events(spark, d)
    o = read_table(spark, d, "orders")
    parts = [
        subgroup.segment_calendar(e, "ts", "weekday").select("segment", F.col("value").alias("v")),
        subgroup.segment_calendar(o, "o_orderdate", "quarter").select("segment", F.col("o_totalprice").alias("v")),
        subgroup.segment_calendar(o, "o_orderdate", "month").select("segment", F.col("o_totalprice").alias("v")),
    ]
    return shown(parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("segment").agg(F.count("v").alias("n"), F.avg("v").alias("mean")))


@query
def segment_value_bin(spark, d):
    binned = subgroup.segment_value_bin(events(spark, d).select("event_id", "event_type", "value"), "value", KEY)
    tied = subgroup.segment_value_bin(
        read_table(spark, d, "lineitem").select(F.col("l_returnflag").alias("event_type"),
                                                F.when(F.col("l_quantity") < 30, 1.0).otherwise(F.col("l_quantity")).alias("value")),
        "value", KEY)
    both = binned.select("event_type", "segment", "value").unionByName(tied.select("event_type", "segment", "value"))
    return shown(both.groupBy("event_type", "segment").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("lowest"), F.max("value").alias("highest")))


@query
def segment_sizes(spark, d):
    o = subgroup.segment_calendar(read_table(spark, d, "orders").select("o_orderpriority", "o_orderdate"), "o_orderdate", "month")
    return subgroup.segment_sizes(o, ["o_orderpriority"])


@query
def subgroup_effects(spark, d):
    return shown(subgroup.subgroup_effects(
        events(spark, d).select("event_type", "ts", "value"), KEY, "ts", "value", ONE, "weekday", grain="hour"))


@query
def subgroup_level_effects(spark, d):
    """Segments under the local-level model."""
    return shown(subgroup.subgroup_effects(
        events(spark, d).select("event_type", "ts", "value"), KEY, "ts", "value", ONE, "weekday", "bsts", grain="hour"))


SCENARIOS = [
    whatif.Scenario("as is"), whatif.Scenario("steeper", slope_pct=20), whatif.Scenario("higher", level_pct=-40, ci_level=99),
    whatif.Scenario("both", slope_pct=-50, level_pct=100, ci_level=90),
]


@query
def whatif_points(spark, d):
    return shown(whatif.whatif_points(mean_points(spark, d), BY, SCENARIOS).select(*BY, "scenario", "t", "is_post", "observed", "adjusted"))


@query
def whatif_effects(spark, d):
    scenarios = whatif.whatif_effects(whatif.whatif_points(mean_points(spark, d), BY, SCENARIOS), BY)
    return shown(scenarios.select(*BY, "scenario", "effect", "effect_pct", "ci_lower", "ci_upper", "p_value", "significant", "note"))


# Reports


def summary(spark, d):
    return inference.effect_summary(mean_points(spark, d), BY)


@query
def formatted_effects(spark, d):
    return report.formatted_effects(summary(spark, d), BY)


@query
def effect_summary_text(spark, d):
    did_rows = did.did_effects(segment_moments(spark, d), SEGMENTS)
    panel = report.effect_summary_text(did_rows, ["analysis_id"], "order value", "effect_ci_lower", "effect_ci_upper")
    return panel.unionByName(report.effect_summary_text(summary(spark, d).select("*").drop("analysis_id").withColumnRenamed("event_type", "analysis_id"), ["analysis_id"], "event value"))


@query
def effect_narrative(spark, d):
    checks = inference.ljung_box(
        mean_points(spark, d).where("not is_post").select(*BY, "t", (F.col("observed") - F.col("counterfactual")).alias("residual")), BY
    ).select(*BY, "residuals_ok")
    dates = mean_points(spark, d).where("is_post").groupBy(*BY).agg(F.date_format(F.min("ts"), "yyyy-MM-dd").alias("intervention_date"))
    return report.effect_narrative(summary(spark, d).join(checks, BY).join(dates, BY), BY, "value")


@query
def chart_points(spark, d):
    return shown(report.chart_points(mean_points(spark, d), BY))


@query
def pointwise_effect(spark, d):
    return shown(report.pointwise_effect(mean_points(spark, d), BY))


@query
def chi_square_tails(spark, d):
    """Upper tails at odd, even and larger degrees of freedom: are events spread evenly over hours, weekdays and days?"""
    at = {"hour": F.hour("ts"), "weekday": F.weekday("ts"), "day": F.dayofyear("ts")}
    parts = F.explode(F.map_from_arrays(F.array(*map(F.lit, at)), F.array(*at.values())))
    counts = events(spark, d).where("ts IS NOT NULL").select(*KEY, parts.alias("part", "value")).groupBy(*KEY, "part", "value").agg(F.count(F.lit(1)).alias("c"))
    sums = counts.groupBy(*KEY, "part").agg(
        (F.count(F.lit(1)) - 1).alias("df"), (F.sum(F.col("c") * F.col("c")) * F.count(F.lit(1)) / F.sum("c") - F.sum("c")).alias("statistic"))
    return shown(sums.withColumn("p_value", chi2_upper_p(F.col("statistic"), F.col("df"))))


@query
def series_profile(spark, d):
    return shown(report.series_profile(events(spark, d), KEY, "ts", "value"))


@query
def describe_table(spark, d):
    return shown(report.describe_table(read_table(spark, d, "lineitem")))


@query
def table_fingerprint(spark, d):
    return report.table_fingerprint(events(spark, d))


# Everything at once


@query
def causal_effects_all(spark, d):
    rows = segment_rows(spark, d).select("unit", "ts", "month", "y")
    analyses = [
        Analysis("arima", ORDERS_AT), Analysis("sarimax", ORDERS_AT, "sarimax"), Analysis("bsts", ORDERS_AT, "bsts"),
        Analysis("did", ORDERS_AT, "did", "BUILDING"), Analysis("synth", ORDERS_AT, "synthetic_control", "BUILDING"),
        Analysis("nobody", ORDERS_AT, "did", "NO SUCH UNIT"),
    ]
    effects = causal_effects(rows, "unit", "month", "y", analyses, "month")
    weights = F.to_json(F.transform_values("unit_weights", lambda _, w: F.round(w, 4)))
    return shown(effects.withColumn("unit_weights", weights))


def nation_specs(spark, d):
    """A difference-in-differences for every nation and month, and a few analyses that cannot be made."""
    months = read_table(spark, d, "orders").select(F.date_format(F.date_trunc("month", "o_orderdate"), "yyyy-MM-dd").alias("intervention_ts")).distinct()
    every = months.withColumn("c_nationkey", F.explode(F.sequence(F.lit(0), F.lit(24))))
    name = F.concat_ws("|", F.col("c_nationkey").cast("string"), "intervention_ts")
    odd = spark.createDataFrame(
        [("no such nation", 99, "1998-01-01", "did"), ("no date", 1, None, "did"), ("no method", 1, "1998-01-01", "magic"), ("no unit", None, "1998-01-01", "did")],
        "analysis_id string, c_nationkey int, intervention_ts string, method string")
    return every.select(name.alias("analysis_id"), "c_nationkey", "intervention_ts", F.lit("did").alias("method")).unionByName(odd)


@query
def causal_effects_specs(spark, d):
    rows = segment_rows(spark, d).select("c_nationkey", "month", "y")
    effects = causal_effects(rows, "c_nationkey", "month", "y", nation_specs(spark, d), "month", details=True)
    sizes = [F.coalesce(n, F.lit(0)).alias(n) for n in ("n_pre", "n_post")]
    return shown(effects.select("analysis_id", "series_key", "method", "status", "effect", "effect_pct", "direction", *sizes, "treated_pre_mean", "control_post_mean"))


@query
def causal_points_did(spark, d):
    rows = segment_rows(spark, d).select("unit", "month", "y")
    analyses = [Analysis(name, at, "did", unit) for name, unit, at in [*SEGMENTS, ("unknown", "NO SUCH UNIT", ORDERS_AT)]]
    return shown(causal_points(rows, "unit", "month", "y", analyses, "month").drop("cf_lower", "cf_upper"))


@query
def sc_gaps(spark, d):
    """Monthly panel of customers' nations with holes in the pre period: donors that lack a date are left out and counted."""
    panel = checkpointed(synth.sc_panel(segment_rows(spark, d).where("c_nationkey % 5 < 3 OR month >= '1996-06-01'"), "c_nationkey", "month", "y"))
    return synth.sc_donors(panel, [(f"nation {i}", str(i), ORDERS_AT) for i in range(25)])
