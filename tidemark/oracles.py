"""For the registered queries, the same answer in SQL over the same tables (DuckDB dialect).

Shown doubles are rounded after adding 1e-8 on both sides: means of a few prices often end in an exact
5 at the fifth decimal, which engines round differently.
"""

from __future__ import annotations

from tidemark.operators.structural import RATIOS

EVENTS_AT = "TIMESTAMP '2024-01-16 00:00:00'"
ORDERS_AT = "TIMESTAMP '1998-01-01 00:00:00'"
STAMP = "'%Y-%m-%d %H:%M:%S'"
Z = 1.959963984540054

SERIES = """series AS (
  SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS t
  FROM (SELECT event_type, date_trunc('hour', ts) AS ts, avg(value) AS y FROM events GROUP BY 1, 2))"""

LOCATED = f"""{SERIES}, located AS (
  SELECT event_type, t AS idx, n FROM (
    SELECT *, count(*) OVER (PARTITION BY event_type) AS n,
      row_number() OVER (PARTITION BY event_type ORDER BY abs(epoch_us(ts) - epoch_us({EVENTS_AT})), ts DESC) AS near
    FROM series) WHERE near = 1)"""

POINTS = f"""{LOCATED}, pre AS (
  SELECT event_type, avg(y) AS m, stddev_samp(y) AS s FROM series JOIN located USING (event_type) WHERE t < idx GROUP BY 1),
points AS (
  SELECT event_type, t, ts, t >= idx AS is_post, y AS observed, m AS counterfactual,
    m - 1.96 * s AS cf_lower, m + 1.96 * s AS cf_upper
  FROM series JOIN located USING (event_type) JOIN pre USING (event_type))"""


def t_p(t: str, df: str) -> str:
    """Two-sided Student-t tail for an integer df (Abramowitz & Stegun 26.7.3-4)."""
    cos2 = f"(({df}) / (({df}) + ({t}) * ({t})))"
    odd = f"(({df}) % 2)"
    terms = f"((({df}) - 2 - {odd}) // 2)"
    horner = (
        f"list_reduce(list_reverse(range(1, {terms} + 1)::DOUBLE[]), "
        f"lambda acc, k: 1 + acc * {cos2} * (2 * k - 1 + {odd}) / (2 * k + {odd}), 1.0)"
    )
    theta = f"atan(abs({t}) / sqrt({df}))"
    return (
        f"greatest(0.0, 1 - CASE WHEN {df} = 1 THEN {theta} * 2 / pi() "
        f"WHEN {odd} = 1 THEN ({theta} + sqrt((1 - {cos2}) * {cos2}) * {horner}) * 2 / pi() "
        f"ELSE sqrt(1 - {cos2}) * {horner} END)"
    )


def chi2_p_10(x: str) -> str:
    """Upper chi-square tail for 10 degrees of freedom."""
    h = f"(({x}) / 2)"
    return f"exp(-{h}) * (1 + {h} + {h}^2 / 2 + {h}^3 / 6 + {h}^4 / 24)"


def chi2_p_any(x: str, df: str) -> str:
    """Upper chi-square tail by the power series of the lower incomplete gamma function."""
    a, h = f"(({df}) / 2.0)::DOUBLE", f"(({x}) / 2.0)"
    return (
        f"CASE WHEN {df} < 1 THEN 1.0 WHEN {x} <= 0 THEN 1.0 ELSE greatest(0.0, 1 - list_sum(list_transform(range(0, 2000), "
        f"lambda k: exp(({a} + k) * ln({h}) - {h} - lgamma({a} + k + 1))))) END"
    )


def summary(points: str, keys: str) -> str:
    """Effect summary over a points relation, as CTEs named ``sums`` and ``effects``."""
    return f"""sums AS (
  SELECT {keys},
    avg(CASE WHEN is_post THEN observed - counterfactual END) AS effect,
    avg(CASE WHEN is_post AND abs(counterfactual) > 1e-6 THEN (observed - counterfactual) / abs(counterfactual) END) * 100 AS effect_pct,
    avg(CASE WHEN is_post THEN cf_lower END) AS cf_ci_lower, avg(CASE WHEN is_post THEN cf_upper END) AS cf_ci_upper,
    count(CASE WHEN NOT is_post THEN 1 END) AS n_pre, count(CASE WHEN is_post THEN 1 END) AS n_post
  FROM {points} GROUP BY {keys}),
scored AS (SELECT *, (cf_ci_upper - cf_ci_lower) / (2 * {Z}) AS se FROM sums),
effects AS (
  SELECT *, effect - {Z} * se AS effect_ci_lower, effect + {Z} * se AS effect_ci_upper,
    {t_p('effect / se', '(n_post - 1)')} AS p_value,
    CASE WHEN effect > 0 THEN 'increase' ELSE 'decrease' END AS direction
  FROM scored)"""


def ljung_box(residuals: str) -> str:
    """Ljung-Box at 10 lags over (event_type, t, residual), as a CTE named ``checks``."""
    return f"""centred AS (
  SELECT event_type, t, residual - avg(residual) OVER (PARTITION BY event_type) AS r,
    count(*) OVER (PARTITION BY event_type) AS n FROM {residuals}),
squares AS (SELECT event_type, any_value(n) AS n, sum(r * r) AS v FROM centred GROUP BY 1),
autocov AS (
  SELECT a.event_type, k.lag, sum(a.r * b.r) AS c
  FROM centred a CROSS JOIN range(1, 11) k(lag) JOIN centred b ON b.event_type = a.event_type AND b.t = a.t - k.lag
  GROUP BY 1, 2),
tested AS (
  SELECT event_type, any_value(n) AS n, any_value(n) * (any_value(n) + 2) * sum((c / v) ^ 2 / (n - lag)) AS q
  FROM autocov JOIN squares USING (event_type) GROUP BY 1),
checks AS (SELECT event_type, n, q, {chi2_p_10('q')} AS p FROM tested)"""


DIRTY = """base AS (
  SELECT event_id AS id, 'id ' || event_id AS event_id,
    CASE WHEN id % 23 = 0 THEN 'not-a-date' WHEN id % 5 = 0 THEN strftime(ts, '%-m/%-d/%Y')
      WHEN id % 7 = 0 THEN strftime(ts, '%-d %b %Y') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS event_time,
    CASE WHEN id % 23 = 0 THEN NULL WHEN id % 5 = 0 OR id % 7 = 0 THEN date_trunc('day', ts)
      ELSE date_trunc('second', ts) END AS parsed,
    CASE WHEN id % 11 = 0 THEN 'n/a' WHEN id % 17 = 0 THEN NULL ELSE '$' || value END AS price,
    CASE WHEN id % 11 = 0 OR id % 17 = 0 THEN NULL ELSE value END AS number,
    CASE WHEN id % 13 <> 0 THEN event_type END AS event_type
  FROM events),
dirty AS (SELECT * FROM base UNION ALL SELECT * FROM base WHERE id % 19 = 0)"""

ISO = r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?)?Z?$"
US = r"^\d{1,2}/\d{1,2}/\d{4}$"
DAY_MONTH = r"^\d{1,2} [A-Za-z]{3} \d{4}$"
OTHER_DATES = r"^(\d{4}/\d{1,2}/\d{1,2}|\d{1,2}-[A-Za-z]{3}-\d{4}|[A-Za-z]{3} \d{1,2}, \d{4}|(19|20)\d{2}(-?(0[1-9]|1[0-2]))?)$"


def is_date(x: str) -> str:
    return (
        f"CASE WHEN regexp_matches({x}, '{ISO}') THEN try_cast({x} AS TIMESTAMP) IS NOT NULL "
        f"WHEN regexp_matches({x}, '{US}') THEN coalesce(try_strptime({x}, '%m/%d/%Y'), try_strptime({x}, '%d/%m/%Y')) IS NOT NULL "
        f"WHEN regexp_matches({x}, '{DAY_MONTH}') THEN try_strptime({x}, '%d %b %Y') IS NOT NULL "
        f"ELSE regexp_matches({x}, '{OTHER_DATES}') END"
    )


def is_number(x: str) -> str:
    return f"try_cast(regexp_replace({x}, '[^0-9.\\-]', '', 'g') AS DOUBLE) IS NOT NULL"


_COLUMNS = [(" Event ID ", "event_id"), ("Event-Time", "event_time"), ("Price ($)", "price"), ("Event Type", "event_type")]


def profile(test) -> str:
    return " UNION ALL ".join(
        f"SELECT CAST({i} AS BIGINT) AS ordinal, '{name}' AS column_name, avg(CASE WHEN {test(col)} THEN 1.0 ELSE 0.0 END) AS rate FROM dirty"
        for i, (name, col) in enumerate(_COLUMNS)
    )


AR1 = """ar AS (
  SELECT event_type, t, y, lag(y) OVER (PARTITION BY event_type ORDER BY t) AS y1,
    lag(y, 2) OVER (PARTITION BY event_type ORDER BY t) AS y2 FROM series),
cuts AS (SELECT event_type, idx, n, idx AS real_idx FROM located)"""
AR1_FIT = """sized AS (
  SELECT *, 4 + least(greatest(6, round(10 * log10(idx - 1))), (idx - 1) // 4, 24)::BIGINT AS first_t FROM cuts),
fits AS (
  SELECT event_type, idx, n, real_idx, count(*) AS m, regr_slope(y, y1) AS phi, regr_intercept(y, y1) AS const,
    (regr_syy(y, y1) - regr_slope(y, y1) * regr_sxy(y, y1)) / count(*) AS sigma2
  FROM sized JOIN ar USING (event_type) WHERE t >= first_t AND t < idx GROUP BY 1, 2, 3, 4)"""
AR1_POINTS = f"""{LOCATED}, {AR1}, {AR1_FIT}, pre_mean AS (
  SELECT event_type, avg(y) AS pre_mean FROM series JOIN located USING (event_type) WHERE t < idx GROUP BY 1),
last AS (SELECT event_type, y AS last_y FROM series JOIN located USING (event_type) WHERE t = idx - 1),
walked AS (
  SELECT event_type, s.t, s.ts, s.t >= idx AS is_post, s.y AS observed, s.t - idx + 1 AS h, phi, const, sigma2,
    const / (1 - phi) AS mu, last_y, coalesce(a.y1, pre_mean) AS before
  FROM series s JOIN fits USING (event_type) JOIN pre_mean USING (event_type) JOIN last USING (event_type)
    JOIN ar a USING (event_type, t)),
modelled AS (
  SELECT event_type, t, ts, is_post, observed,
    CASE WHEN is_post THEN mu + phi ^ h * (last_y - mu) ELSE const + phi * before END AS counterfactual,
    CASE WHEN is_post THEN sqrt(sigma2 * (1 - phi ^ (2 * h)) / (1 - phi ^ 2)) END AS se
  FROM walked),
points AS (
  SELECT *, counterfactual - {Z} * se AS cf_lower, counterfactual + {Z} * se AS cf_upper FROM modelled)"""

PLACEBO = f"""{LOCATED}, ar AS (
  SELECT event_type, t, y, lag(y) OVER (PARTITION BY event_type ORDER BY t) AS y1 FROM series),
cuts AS (
  SELECT event_type, unnest(range(greatest(10, n // 5), least(n - 10, n - n // 5))) AS idx, n, idx AS real_idx, false AS is_real FROM located
  UNION ALL SELECT event_type, idx, n, idx, true FROM located),
sized AS (
  SELECT *, 4 + least(greatest(6, round(10 * log10(idx - 1))), (idx - 1) // 4, 24)::BIGINT AS first_t FROM cuts),
fits AS (
  SELECT event_type, idx, n, is_real, regr_slope(y, y1) AS phi, regr_intercept(y, y1) AS const
  FROM sized JOIN ar USING (event_type) WHERE t >= first_t AND t < idx GROUP BY 1, 2, 3, 4),
post AS (
  SELECT event_type, idx, is_real, avg(y) AS post_mean FROM cuts JOIN series USING (event_type) WHERE t >= idx GROUP BY 1, 2, 3),
placebo AS (
  SELECT f.event_type, f.idx, f.is_real,
    post_mean - (const / (1 - phi) + (s.y - const / (1 - phi)) * phi * (1 - phi ^ (n - f.idx)) / (1 - phi) / (n - f.idx)) AS effect
  FROM fits f JOIN post p ON p.event_type = f.event_type AND p.idx = f.idx AND p.is_real = f.is_real
    JOIN series s ON s.event_type = f.event_type AND s.t = f.idx - 1)"""

SEGMENT_ROWS = """rows AS (
  SELECT c_mktsegment AS unit, o_orderdate AS ts, o_totalprice AS y, date_trunc('month', o_orderdate) AS month
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
SPECS = f"""specs AS (
  SELECT * FROM (VALUES ('building', 'BUILDING', {ORDERS_AT}), ('machinery', 'MACHINERY', TIMESTAMP '1999-06-01'))
  v(analysis_id, treatment_unit, since))"""
DESIGN = f"""{SEGMENT_ROWS}, {SPECS}, design AS (
  SELECT analysis_id, unit, ts, month, y, CAST(unit = treatment_unit AS BIGINT) AS treated, CAST(ts >= since AS BIGINT) AS post
  FROM rows CROSS JOIN specs)"""
CELLS = f"""{DESIGN}, cells AS (
  SELECT analysis_id,
    avg(y) FILTER (treated = 1 AND post = 0) AS treated_pre_mean, avg(y) FILTER (treated = 1 AND post = 1) AS treated_post_mean,
    avg(y) FILTER (treated = 0 AND post = 0) AS control_pre_mean, avg(y) FILTER (treated = 0 AND post = 1) AS control_post_mean,
    count(*) FILTER (treated = 1 AND post = 0) AS n_treated_pre, count(*) FILTER (treated = 1 AND post = 1) AS n_treated_post,
    count(*) FILTER (treated = 0 AND post = 0) AS n_control_pre, count(*) FILTER (treated = 0 AND post = 1) AS n_control_post
  FROM design GROUP BY 1),
did AS (SELECT *, (treated_post_mean - treated_pre_mean) - (control_post_mean - control_pre_mean) AS effect FROM cells)"""
DID = f"""WITH RECURSIVE {CELLS}, spread AS (
  SELECT analysis_id, sum(v) AS sse FROM (
    SELECT analysis_id, treated, post, var_pop(y) * count(*) AS v FROM design GROUP BY 1, 2, 3) GROUP BY 1),
fitted AS (
  SELECT *, n_treated_pre + n_treated_post + n_control_pre + n_control_post - 4 AS df_resid,
    sqrt(sse / (n_treated_pre + n_treated_post + n_control_pre + n_control_post - 4)
      * (1 / n_treated_pre + 1 / n_treated_post + 1 / n_control_pre + 1 / n_control_post)) AS effect_se
  FROM did JOIN spread USING (analysis_id)),
halved(analysis_id, step, lo, hi, df) AS (
  SELECT analysis_id, 0, 0.0::DOUBLE, 16.0::DOUBLE, df_resid FROM fitted
  UNION ALL
  SELECT analysis_id, step + 1, CASE WHEN p > 0.05 THEN mid ELSE lo END, CASE WHEN p > 0.05 THEN hi ELSE mid END, df
  FROM (SELECT *, {t_p('mid', 'df')} AS p FROM (SELECT *, (lo + hi) / 2 AS mid FROM halved WHERE step < 50))),
result AS (
  SELECT f.*, lo AS t_quantile, {t_p('effect / effect_se', 'df_resid')} AS p_value,
    CASE WHEN effect > 0 THEN 'increase' ELSE 'decrease' END AS direction,
    effect / (abs(treated_pre_mean) + 1e-10) * 100 AS effect_pct,
    effect - lo * effect_se AS effect_ci_lower, effect + lo * effect_se AS effect_ci_upper
  FROM fitted f JOIN halved h ON h.analysis_id = f.analysis_id AND step = 50)"""

STATUS_PANEL = """panel AS (
  SELECT o_orderstatus AS unit, date_trunc('month', o_orderdate) AS ts, avg(o_totalprice) AS y FROM orders GROUP BY 1, 2)"""
STATUS_POINTS = f"""{STATUS_PANEL}, wide AS (
  SELECT ts, max(y) FILTER (unit = 'P') AS p, max(y) FILTER (unit = 'F') AS f, max(y) FILTER (unit = 'O') AS o FROM panel GROUP BY 1),
share AS (
  SELECT greatest(0.0, least(1.0, sum((p - o) * (f - o)) / sum((f - o) ^ 2))) AS w
  FROM wide WHERE p IS NOT NULL AND f IS NOT NULL AND o IS NOT NULL AND ts < {ORDERS_AT}),
points AS (
  SELECT ts, ts >= {ORDERS_AT} AS is_post, p AS observed, w * f + (1 - w) * o AS counterfactual FROM wide CROSS JOIN share WHERE p IS NOT NULL)"""
SC = f"""{STATUS_POINTS}, gaps AS (SELECT *, observed - counterfactual AS gap FROM points),
sums AS (
  SELECT avg(gap) FILTER (is_post) AS effect, stddev_samp(gap) FILTER (is_post) AS sd,
    avg(observed) FILTER (NOT is_post AND gap IS NOT NULL) AS pre_mean,
    sqrt(avg(gap ^ 2) FILTER (NOT is_post)) AS pre_rmspe, sqrt(avg(gap ^ 2) FILTER (is_post)) AS post_rmspe,
    count(gap) FILTER (NOT is_post) AS n_pre, count(gap) FILTER (is_post) AS n_post FROM gaps),
scored AS (SELECT *, sd / sqrt(n_post) AS effect_se FROM sums)"""

SCENARIOS = """scenarios AS (
  SELECT * FROM (VALUES ('as is', 0, 0, 95, 1.96), ('steeper', 20, 0, 95, 1.96), ('higher', 0, -40, 99, 2.576), ('both', -50, 100, 90, 1.645))
  v(scenario, slope, level, ci, mult))"""
WHATIF = f"""{POINTS}, {SCENARIOS}, facts AS (
  SELECT event_type, avg(observed) FILTER (NOT is_post) AS pre_mean, min(t) FILTER (is_post) AS idx, count(*) FILTER (is_post) AS n_post
  FROM points GROUP BY 1),
adjusted AS (
  SELECT p.*, scenario, slope, level, ci, mult, CASE WHEN is_post THEN counterfactual
      + slope / 100.0 * pre_mean * 0.5 * (t - idx) / (n_post - 1) + level / 100.0 * pre_mean ELSE counterfactual END AS adjusted
  FROM points p JOIN facts USING (event_type) CROSS JOIN scenarios)"""


def rounded(*columns: str, digits: int = 4) -> str:
    return ", ".join(f"round({c} + 1e-8, {digits}) AS {c}" for c in columns)


def describe(*columns: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count({c}) AS count, round(avg({c}::DOUBLE) + 1e-8, 4) AS mean, round(stddev_samp({c}::DOUBLE) + 1e-8, 4) AS std, "
        f"round(min({c}::DOUBLE) + 1e-8, 4) AS min, round(quantile_cont({c}::DOUBLE, 0.25) + 1e-8, 4) AS p25, round(quantile_cont({c}::DOUBLE, 0.5) + 1e-8, 4) AS p50, "
        f"round(quantile_cont({c}::DOUBLE, 0.75) + 1e-8, 4) AS p75, round(max({c}::DOUBLE) + 1e-8, 4) AS max FROM lineitem" for c in columns
    )


GAPPY = f"{SERIES}, gappy AS (SELECT event_type, ts, t, CASE WHEN t % 17 >= 3 THEN y END AS y FROM series)"
SPEC_STATUS = """SELECT analysis_id, CASE WHEN nt = 0 THEN 'unknown_unit' WHEN nc = 0 THEN 'no_control'
    WHEN nb = 0 THEN 'no_pre_rows' WHEN na = 0 THEN 'no_post_rows' ELSE 'ok' END AS status
  FROM (SELECT analysis_id, count(*) FILTER (unit = u) AS nt, count(*) FILTER (unit <> u) AS nc,
      count(*) FILTER (unit = u AND ts < since) AS nb, count(*) FILTER (unit = u AND ts >= since) AS na
    FROM checked CROSS JOIN listed GROUP BY 1)"""
LOWEST = """CASE WHEN idx < greatest(3, n // 20) THEN 'too_early' WHEN n - idx - 1 < greatest(3, n // 20) THEN 'too_late'"""
NARRATIVE_VERDICT = "CASE WHEN p_value < 0.05 THEN '(significant)' ELSE '(not significant)' END"

#: A row of the events as text: the length of each value, and the value.
FINGERPRINT_ROW = " || ".join(f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("event_id", "ts", "user_id", "event_type", "value", "props"))

ORACLES: dict[str, str] = {
    "scan_csv_series": f"""WITH {SERIES} SELECT event_type, count(*) AS n, round(avg(y) + 1e-8, 4) AS mean,
        strftime(min(ts), {STAMP}) AS first_ts, strftime(max(ts), {STAMP}) AS last_ts FROM series GROUP BY 1""",
    "analysis_specs": f"""WITH specs AS (SELECT * FROM (VALUES ('clicks', 'click', TIMESTAMP '2024-01-10'),
        ('views', 'view', TIMESTAMP '2024-01-16'), ('late clicks', 'click', TIMESTAMP '2024-01-20')) v(analysis_id, event_type, since))
        SELECT analysis_id, event_type, count(*) FILTER (ts < since) AS n_before, count(*) FILTER (ts >= since) AS n_after,
        round(avg(value) FILTER (ts < since) + 1e-8, 4) AS mean_before, round(avg(value) FILTER (ts >= since) + 1e-8, 4) AS mean_after
        FROM specs JOIN events USING (event_type) GROUP BY 1, 2""",
    "export_points": f"""WITH {POINTS} SELECT 'mid-' || event_type AS analysis_id, strftime(ts, {STAMP}) AS date,
        {rounded('observed', 'counterfactual')} FROM points""",
    "detect_date_column": f"""WITH {DIRTY} SELECT ordinal, column_name, round(rate + 1e-8, 4) AS date_rate
        FROM ({profile(is_date)}) WHERE rate > 0.5 ORDER BY ordinal LIMIT 1""",
    "detect_numeric_columns": f"""WITH {DIRTY} SELECT ordinal, column_name, round(rate + 1e-8, 4) AS number_rate
        FROM ({profile(is_number)}) WHERE rate > 0.5 AND column_name <> 'Event-Time'""",
    "validate_table": "SELECT 'ts' AS date_col, 'value' AS metric_col, count(value) AS n, round(avg(value) + 1e-8, 4) AS mean FROM events",
    "clean_names": f"WITH {DIRTY} SELECT event_id, event_time, price, event_type, NULL::VARCHAR AS empty FROM dirty",
    "drop_empty_cols": f"WITH {DIRTY} SELECT event_id, event_time, price, event_type FROM dirty",
    "drop_empty_rows": "SELECT event_id, event_type, value FROM events WHERE event_id % 13 <> 0",
    "drop_duplicates": "SELECT DISTINCT user_id, event_type, strftime(ts, '%Y-%m-%d') AS day FROM events",
    "parse_dates": f"WITH {DIRTY} SELECT event_id, strftime(parsed, {STAMP}) AS event_time FROM dirty WHERE parsed IS NOT NULL",
    "date_from_year_month": f"""SELECT strftime(date_trunc('month', o_orderdate), {STAMP}) AS date, count(*) AS n,
        round(avg(o_totalprice) + 1e-8, 4) AS mean FROM orders GROUP BY 1""",
    "parse_numeric": f"WITH {DIRTY} SELECT event_id, number AS price FROM dirty",
    "missing_drop": f"WITH {GAPPY} SELECT event_type, strftime(ts, {STAMP}) AS ts, t, round(y + 1e-8, 4) AS y FROM gappy WHERE y IS NOT NULL",
    "missing_ffill": f"""WITH {GAPPY} SELECT event_type, strftime(ts, {STAMP}) AS ts, t, round(coalesce(
        last_value(y IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING),
        first_value(y IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) + 1e-8, 4) AS y FROM gappy""",
    "missing_mean": f"""WITH {GAPPY} SELECT event_type, strftime(ts, {STAMP}) AS ts, t,
        round(coalesce(y, avg(y) OVER (PARTITION BY event_type)) + 1e-8, 4) AS y FROM gappy""",
    "outliers_iqr": """SELECT event_id, event_type, value FROM events JOIN (SELECT event_type, quantile_cont(value, 0.25) AS a,
        quantile_cont(value, 0.75) AS b FROM events GROUP BY 1) USING (event_type) WHERE value BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)""",
    "outliers_zscore": """SELECT event_id, event_type, value FROM events JOIN (SELECT event_type, avg(value) AS m,
        stddev_samp(value) AS s FROM events GROUP BY 1) USING (event_type) WHERE abs((value - m) / s) <= 3""",
    "preprocess_pipeline": f"""WITH {DIRTY}, kept AS (SELECT event_id, parsed, number, event_type FROM base
        WHERE parsed IS NOT NULL AND number IS NOT NULL AND event_type IS NOT NULL),
        fences AS (SELECT quantile_cont(number, 0.25) AS a, quantile_cont(number, 0.75) AS b FROM kept)
        SELECT event_id, strftime(parsed, {STAMP}) AS event_time, round(number + 1e-8, 4) AS price, event_type FROM kept CROSS JOIN fences
        WHERE number BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)""",
    "preprocess_report": f"""WITH {DIRTY}, dated AS (SELECT * FROM base WHERE parsed IS NOT NULL),
        kept AS (SELECT * FROM dated WHERE number IS NOT NULL AND event_type IS NOT NULL),
        fences AS (SELECT quantile_cont(number, 0.25) AS a, quantile_cont(number, 0.75) AS b FROM kept),
        steps AS (
          SELECT 0 AS step_no, 'read' AS step, (SELECT count(*) FROM dirty) AS n_rows
          UNION ALL SELECT 1, 'clean_names', (SELECT count(*) FROM dirty) UNION ALL SELECT 2, 'drop_empty_columns', (SELECT count(*) FROM dirty)
          UNION ALL SELECT 3, 'drop_empty_rows', (SELECT count(*) FROM dirty) UNION ALL SELECT 4, 'drop_duplicates', (SELECT count(*) FROM base)
          UNION ALL SELECT 5, 'parse_dates', (SELECT count(*) FROM dated) UNION ALL SELECT 6, 'parse_numeric', (SELECT count(*) FROM dated)
          UNION ALL SELECT 7, 'missing_drop', (SELECT count(*) FROM kept)
          UNION ALL SELECT 8, 'outliers_iqr', (SELECT count(*) FROM kept CROSS JOIN fences WHERE number BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)))
        SELECT step_no::BIGINT AS step_no, step, n_rows, coalesce(lag(n_rows) OVER (ORDER BY step_no) - n_rows, 0) AS n_affected FROM steps""",
    "dedupe_dates_mean": f"SELECT o_orderpriority, strftime(o_orderdate, {STAMP}) AS ts, round(avg(o_totalprice) + 1e-8, 4) AS y FROM orders GROUP BY 1, o_orderdate",
    "series_index": """SELECT event_type, epoch_us(ts) AS micros, row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS t
        FROM (SELECT DISTINCT event_type, ts FROM events)""",
    "intervention_index": f"""WITH {SERIES}, specs AS (SELECT * FROM (VALUES ('mid', {EVENTS_AT}), ('tie', TIMESTAMP '2024-01-10 06:30:00'),
        ('before', TIMESTAMP '2023-01-01'), ('after', TIMESTAMP '2025-01-01')) v(analysis_id, since)),
        found AS (SELECT analysis_id, event_type, t AS idx, count(*) OVER (PARTITION BY analysis_id, event_type) AS n,
          row_number() OVER (PARTITION BY analysis_id, event_type ORDER BY abs(epoch_us(ts) - epoch_us(since)), ts DESC) AS near FROM series CROSS JOIN specs)
        SELECT analysis_id, event_type, idx, n, {LOWEST} WHEN n < 30 THEN 'too_short' ELSE 'ok' END AS status FROM found WHERE near = 1""",
    "intervention_index_specs": f"""WITH series AS (
          SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS t, count(*) OVER (PARTITION BY user_id) AS n
          FROM (SELECT DISTINCT user_id, date_trunc('hour', ts) AS ts FROM events)),
        found AS (SELECT e.event_id AS analysis_id, e.user_id, t AS idx, n, row_number() OVER (PARTITION BY e.event_id
            ORDER BY abs(epoch_us(s.ts) - epoch_us(e.ts + INTERVAL 7 HOURS)), s.ts DESC) AS near FROM events e JOIN series s USING (user_id))
        SELECT analysis_id, user_id, idx, n, {LOWEST} ELSE 'ok' END AS status FROM found WHERE near = 1""",
    "series_rejects": """WITH judged AS (SELECT CASE WHEN event_id % 13 = 0 THEN 'no_key' WHEN event_id % 23 = 0 THEN 'bad_date'
          WHEN event_id % 11 = 0 THEN 'bad_value' WHEN event_id % 17 = 0 THEN 'no_value' END AS reason, CASE WHEN event_id % 19 = 0 THEN 2 ELSE 1 END AS copies FROM events)
        SELECT reason, coalesce(sum(copies), 0)::BIGINT AS n_rows
        FROM (SELECT unnest(['no_key', 'no_date', 'bad_date', 'no_value', 'bad_value']) AS reason) LEFT JOIN judged USING (reason) GROUP BY 1""",
    "causal_effects_specs": f"""WITH rows AS (SELECT c_nationkey AS unit, date_trunc('month', o_orderdate) AS ts, o_totalprice AS y FROM orders JOIN customer ON o_custkey = c_custkey),
        cells AS (SELECT unit, ts, count(*) AS n, sum(y) AS s FROM rows GROUP BY 1, 2), months AS (SELECT DISTINCT date_trunc('month', o_orderdate) AS since FROM orders),
        specs AS (SELECT u || '|' || strftime(since, '%Y-%m-%d') AS analysis_id, u, since FROM months, range(25) x(u) UNION ALL SELECT 'no such nation', 99, {ORDERS_AT}),
        summed AS (SELECT analysis_id, u, coalesce(sum(n) FILTER (unit = u AND ts < since), 0)::BIGINT AS tpn, sum(s) FILTER (unit = u AND ts < since) AS tps,
            coalesce(sum(n) FILTER (unit = u AND ts >= since), 0)::BIGINT AS tqn, sum(s) FILTER (unit = u AND ts >= since) AS tqs, sum(n) FILTER (unit <> u AND ts < since) AS cpn,
            sum(s) FILTER (unit <> u AND ts < since) AS cps, sum(n) FILTER (unit <> u AND ts >= since) AS cqn, sum(s) FILTER (unit <> u AND ts >= since) AS cqs
          FROM specs, cells GROUP BY 1, 2),
        judged AS (SELECT *, CASE WHEN tpn + tqn = 0 THEN 'unknown_unit' WHEN tpn = 0 THEN 'no_pre_rows' WHEN tqn = 0 THEN 'no_post_rows' ELSE 'ok' END AS status,
          (tqs / tqn - tps / tpn) - (cqs / cqn - cps / cpn) AS gap FROM summed)
        SELECT analysis_id, u::VARCHAR AS series_key, 'did' AS method, status, CASE WHEN status = 'ok' THEN round(gap + 1e-8, 4) END AS effect,
          CASE WHEN status = 'ok' THEN round(gap / (abs(tps / tpn) + 1e-10) * 100 + 1e-8, 4) END AS effect_pct,
          CASE WHEN status = 'ok' THEN CASE WHEN gap > 0 THEN 'increase' WHEN gap <= 0 THEN 'decrease' END END AS direction, CASE WHEN status = 'ok' THEN tpn ELSE 0 END AS n_pre,
          CASE WHEN status = 'ok' THEN tqn ELSE 0 END AS n_post, CASE WHEN status = 'ok' THEN round(tps / tpn + 1e-8, 4) END AS treated_pre_mean,
          CASE WHEN status = 'ok' THEN round(cqs / cqn + 1e-8, 4) END AS control_post_mean FROM judged
        UNION ALL SELECT a, s, m, st, NULL, NULL, NULL, 0, 0, NULL, NULL
          FROM (VALUES ('no date', '1', 'did', 'no_date'), ('no method', '1', 'magic', 'unknown_method'), ('no unit', NULL, 'did', 'no_unit')) v(a, s, m, st)""",
    "causal_points_did": f"""WITH {SEGMENT_ROWS}, {SPECS}, design AS (
          SELECT analysis_id, treatment_unit, month AS ts, y, unit = treatment_unit AS treated, month >= since AS is_post FROM rows CROSS JOIN specs),
        shifts AS (SELECT analysis_id, avg(y) FILTER (treated AND NOT is_post) - avg(y) FILTER (NOT treated AND NOT is_post) AS shift FROM design GROUP BY 1),
        dated AS (SELECT analysis_id, treatment_unit, ts, is_post, avg(y) FILTER (treated) AS observed, avg(y) FILTER (NOT treated) AS control FROM design GROUP BY 1, 2, 3, 4),
        drawn AS (SELECT *, CASE WHEN is_post THEN control + shift ELSE coalesce(observed, control) END AS counterfactual FROM dated JOIN shifts USING (analysis_id))
        SELECT analysis_id, treatment_unit AS series_key, 'did' AS method, strftime(ts, {STAMP}) AS ts, is_post, {rounded('observed', 'counterfactual')},
          round(observed - counterfactual + 1e-8, 4) AS effect FROM drawn""",
    "sc_gaps": f"""WITH panel AS (SELECT DISTINCT c_nationkey AS unit, date_trunc('month', o_orderdate) AS ts FROM orders JOIN customer ON o_custkey = c_custkey
          WHERE c_nationkey % 5 < 3 OR date_trunc('month', o_orderdate) >= TIMESTAMP '1996-06-01'),
        pre AS (SELECT * FROM panel WHERE ts < {ORDERS_AT}), sizes AS (SELECT unit, count(*) AS n_dates FROM pre GROUP BY 1),
        shared AS (SELECT a.unit AS treated, b.unit AS donor, count(*) AS n FROM pre a JOIN pre b ON a.ts = b.ts AND a.unit <> b.unit GROUP BY 1, 2)
        SELECT 'nation ' || unit AS analysis_id, n_dates, (SELECT count(*) FROM shared WHERE treated = unit AND n = n_dates) AS n_donors,
          (SELECT count(DISTINCT unit) FROM panel) - 1 - (SELECT count(*) FROM shared WHERE treated = unit AND n = n_dates) AS n_donors_dropped FROM sizes""",
    "validate_windows": f"""WITH series AS (SELECT DISTINCT user_id, date_trunc('day', ts) AS ts FROM events),
        specs AS (SELECT * FROM (VALUES ('early', TIMESTAMP '2024-01-02'), ('mid', TIMESTAMP '2024-01-16'), ('late', TIMESTAMP '2024-01-30')) v(analysis_id, since)),
        found AS (SELECT analysis_id, user_id, row_number() OVER (PARTITION BY analysis_id, user_id ORDER BY ts) - 1 AS idx,
          count(*) OVER (PARTITION BY analysis_id, user_id) AS n,
          row_number() OVER (PARTITION BY analysis_id, user_id ORDER BY abs(epoch_us(ts) - epoch_us(since)), ts DESC) AS near FROM series CROSS JOIN specs)
        SELECT analysis_id, user_id, idx, n, {LOWEST} ELSE 'ok' END AS status FROM found WHERE near = 1""",
    "validate_length": f"""WITH series AS (SELECT DISTINCT user_id, date_trunc('hour', ts) AS ts FROM events),
        found AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS idx, count(*) OVER (PARTITION BY user_id) AS n,
          row_number() OVER (PARTITION BY user_id ORDER BY abs(epoch_us(ts) - epoch_us({EVENTS_AT})), ts DESC) AS near FROM series)
        SELECT user_id, n, {LOWEST} WHEN n < 30 THEN 'too_short' ELSE 'ok' END AS status FROM found WHERE near = 1""",
    "pre_post_split": f"""WITH {LOCATED} SELECT 'mid' AS analysis_id, event_type, t >= idx AS is_post, count(*) AS n, round(avg(y) + 1e-8, 4) AS mean,
        min(t) AS first_t FROM series JOIN located USING (event_type) GROUP BY 1, 2, 3""",
    "arima_candidates": f"""WITH {LOCATED}, daily AS (
          SELECT o_orderpriority, o_orderdate AS ts, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate) - 1 AS t,
            count(*) OVER (PARTITION BY o_orderpriority) AS n FROM (SELECT DISTINCT o_orderpriority, o_orderdate FROM orders)),
        sized AS (SELECT 'mid' AS analysis_id, event_type AS series_key, n, idx FROM located
          UNION ALL SELECT 'orders', o_orderpriority, any_value(n), arg_min(t, abs(epoch_us(ts) - epoch_us({ORDERS_AT}))) FROM daily GROUP BY 2),
        tiers AS (SELECT *, CASE WHEN n > 5000 THEN 2 WHEN idx > 1000 THEN 1 ELSE 3 END AS most FROM sized)
        SELECT analysis_id, series_key, p, d, q FROM tiers, range(4) a(p), range(2) b(d), range(4) c(q) WHERE p + q > 0 AND p <= most AND q <= most""",
    "difference_series": f"""WITH {SERIES}, lagged AS (SELECT event_type, t, y, lag(y) OVER w AS y1, lag(y, 12) OVER w AS y12, lag(y, 13) OVER w AS y13
        FROM series WINDOW w AS (PARTITION BY event_type ORDER BY t))
        SELECT 'd1' AS kind, event_type, t, round(y - y1 + 1e-8, 4) AS z FROM lagged
        UNION ALL SELECT 'd1_D1_s12', event_type, t, round(y - y1 - y12 + y13 + 1e-8, 4) AS z FROM lagged""",
    "arima_fit": f"""WITH {LOCATED}, {AR1}, {AR1_FIT}, walk AS (
          SELECT event_type, count(*) AS m, sum((y - y1) * (y1 - y2)) / sum((y1 - y2) ^ 2) AS phi,
            (sum((y - y1) ^ 2) - sum((y - y1) * (y1 - y2)) ^ 2 / sum((y1 - y2) ^ 2)) / count(*) AS sigma2
          FROM sized JOIN ar USING (event_type) WHERE t >= first_t AND t < idx GROUP BY 1),
        both_fits AS (SELECT event_type, 0 AS d, const, phi, sigma2, m, 3 AS k FROM fits UNION ALL SELECT event_type, 1, 0.0, phi, sigma2, m, 2 FROM walk)
        SELECT 'mid' AS analysis_id, event_type, d::BIGINT AS d, {rounded('const', 'phi', 'sigma2')},
          round(m * (ln(2 * pi() * sigma2) + 1) + 2 * k + 1e-8, 4) AS aic FROM both_fits""",
    "sarimax_hourly": f"""WITH RECURSIVE {LOCATED}, sized AS (
          SELECT event_type, idx, n, least(greatest(6, round(10 * log10(idx - 49))), (idx - 49) // 4, 24)::BIGINT + 49 AS first_t FROM located),
        lagged AS (SELECT event_type, t, y, lag(y) OVER w AS y1, lag(y, 24) OVER w AS y24 FROM series WINDOW w AS (PARTITION BY event_type ORDER BY t)),
        sums AS (SELECT event_type, count(*) AS m, avg(y) AS my, avg(y1) AS m1, avg(y24) AS m24, covar_pop(y, y1) AS c1, covar_pop(y, y24) AS c24,
            covar_pop(y1, y24) AS c, var_pop(y1) AS v1, var_pop(y24) AS v24, var_pop(y) AS v
          FROM lagged JOIN sized USING (event_type) WHERE t >= first_t AND t < idx GROUP BY 1),
        slopes AS (SELECT *, (c1 * v24 - c24 * c) / (v1 * v24 - c * c) AS a, (c24 * v1 - c1 * c) / (v1 * v24 - c * c) AS b FROM sums),
        fits AS (SELECT *, my - a * m1 - b * m24 AS const, v - a * c1 - b * c24 AS sigma2 FROM slopes),
        ahead(event_type, t, n, past) AS (
          SELECT event_type, idx - 1, n, (SELECT list(y ORDER BY t DESC) FROM series s WHERE s.event_type = l.event_type AND t < idx AND t >= idx - 24) FROM located l
          UNION ALL
          SELECT event_type, t + 1, n, list_prepend(const + a * past[1] + b * past[24], past[1:23]) FROM ahead JOIN fits USING (event_type) WHERE t + 1 < n),
        gaps AS (SELECT event_type, avg(y - past[1]) AS effect, avg((y - past[1]) / abs(past[1])) * 100 AS effect_pct FROM ahead JOIN series USING (event_type, t)
          JOIN located USING (event_type) WHERE t >= idx GROUP BY 1)
        SELECT 'mid' AS analysis_id, event_type, 'ok' AS fit_status, {rounded('const', 'sigma2', 'effect', 'effect_pct')}, round(a + 1e-8, 4) AS phi_hour, round(b + 1e-8, 4) AS phi_day,
          round(m * (ln(2 * pi() * sigma2) + 1) + 8 + 1e-8, 4) AS aic, idx AS n_pre, n - idx AS n_post FROM fits JOIN gaps USING (event_type) JOIN located USING (event_type)""",
    "fit_failures": """WITH days AS (SELECT DISTINCT event_type, date_trunc('day', ts) AS ts FROM events),
        numbered AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS t, count(*) OVER (PARTITION BY event_type) AS n FROM days),
        specs AS (SELECT * FROM (VALUES ('four days', 'arima', TIMESTAMP '2024-01-05'), ('one day', 'arima', TIMESTAMP '2024-01-02'),
          ('four days, level', 'bsts', TIMESTAMP '2024-01-05'), ('last day', 'arima', TIMESTAMP '2024-01-30')) v(analysis_id, method, since)),
        found AS (SELECT *, row_number() OVER (PARTITION BY analysis_id, event_type ORDER BY abs(epoch_us(ts) - epoch_us(since)), ts DESC) AS near FROM numbered CROSS JOIN specs),
        judged AS (SELECT *, CASE WHEN t < greatest(3, floor(n * 0.05)) THEN 'too_early' WHEN n - t - 1 < greatest(3, floor(n * 0.05)) THEN 'too_late'
          WHEN n < 30 THEN 'too_short' WHEN method = 'arima' THEN 'fit_failed' ELSE 'ok' END AS status FROM found WHERE near = 1)
        SELECT analysis_id, event_type AS series_key, method, status, status = 'ok' AS has_effect, t AS n_pre, n - t AS n_post FROM judged""",
    "seasonal_period": """SELECT series_key, n, CASE WHEN n > 10000 THEN 0 WHEN n > 3000 THEN 7 WHEN n > 200 THEN 12 WHEN n > 50 THEN 4 ELSE 0 END::BIGINT AS period
        FROM (SELECT 'user ' || user_id AS series_key, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT o_orderpriority, count(*) FROM orders GROUP BY 1)""",
    "arima_forecast": f"WITH {AR1_POINTS} SELECT 'mid' AS analysis_id, event_type, t, round(counterfactual + 1e-8, 4) AS mean, round(se + 1e-8, 4) AS se FROM points WHERE is_post",
    "its_points_ar1": f"""WITH {AR1_POINTS} SELECT 'mid' AS analysis_id, event_type, t, strftime(ts, {STAMP}) AS ts, is_post,
        {rounded('observed', 'counterfactual', 'cf_lower', 'cf_upper')}, round(counterfactual + 1e-8, 4) AS fitted, round(observed - counterfactual + 1e-8, 4) AS effect FROM points""",
    "its_effects_ar1": f"""WITH {AR1_POINTS}, {summary('points', 'event_type')},
        residuals AS (SELECT event_type, t, observed - counterfactual AS residual FROM points JOIN sized USING (event_type) WHERE t >= first_t AND t < idx),
        {ljung_box('residuals')}
        SELECT 'mid' AS analysis_id, event_type, {rounded('effect', 'effect_pct', 'cf_ci_lower', 'cf_ci_upper', 'effect_ci_lower', 'effect_ci_upper', 'p_value')},
        p_value < 0.05 AS significant, direction, n_pre, n_post, round(p + 1e-8, 4) AS ljung_box_pvalue, p > 0.05 AS residuals_ok
        FROM effects JOIN checks USING (event_type)""",
    "effect_summary": f"""WITH {POINTS}, {summary('points', 'event_type')} SELECT 'mid' AS analysis_id, event_type,
        {rounded('effect', 'effect_pct', 'cf_ci_lower', 'cf_ci_upper', 'effect_ci_lower', 'effect_ci_upper', 'p_value')},
        p_value < 0.05 AS significant, direction, n_pre, n_post FROM effects""",
    "ljung_box": f"""WITH {POINTS}, residuals AS (SELECT event_type, t, observed - counterfactual AS residual FROM points WHERE NOT is_post),
        {ljung_box('residuals')} SELECT 'mid' AS analysis_id, event_type, n, 10::BIGINT AS n_lags, round(q + 1e-8, 4) AS q_stat, round(p + 1e-8, 4) AS ljung_box_pvalue,
        p > 0.05 AS residuals_ok FROM checks""",
    "local_level_effects": f"""WITH RECURSIVE {LOCATED}, grid(q) AS (SELECT unnest([{', '.join(f'{q!r}::DOUBLE' for q in RATIOS)}])),
        filtered(event_type, q, t, level, p, sse, logs) AS (
          SELECT event_type, q, t, y, 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM series CROSS JOIN grid WHERE t = 0
          UNION ALL
          SELECT f.event_type, f.q, s.t, level + (p + f.q) / (p + f.q + 1) * (s.y - level), (p + f.q) / (p + f.q + 1),
            sse + (s.y - level) ^ 2 / (p + f.q + 1), logs + ln(p + f.q + 1)
          FROM filtered f JOIN series s ON s.event_type = f.event_type AND s.t = f.t + 1 JOIN located l ON l.event_type = f.event_type WHERE s.t < l.idx),
        ended AS (SELECT f.*, idx, sse / (idx - 1) AS sigma2, -0.5 * ((idx - 1) * (ln(2 * pi() * sse / (idx - 1)) + 1) + logs) AS loglik
          FROM filtered f JOIN located l ON l.event_type = f.event_type WHERE f.t = l.idx - 1),
        best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY loglik DESC, q) AS place FROM ended) WHERE place = 1),
        points AS (SELECT s.event_type, s.t >= idx AS is_post, y AS observed, level AS counterfactual,
            level - {Z} * sqrt(sigma2 * (p + (s.t - idx + 1) * q + 1)) AS cf_lower, level + {Z} * sqrt(sigma2 * (p + (s.t - idx + 1) * q + 1)) AS cf_upper
          FROM series s JOIN best USING (event_type)), {summary('points', 'event_type')}
        SELECT 'mid' AS analysis_id, event_type, {rounded('effect', 'effect_pct', 'cf_ci_lower', 'cf_ci_upper', 'effect_ci_lower', 'effect_ci_upper', 'p_value')},
        p_value < 0.05 AS significant, direction, n_pre, n_post, round(q + 1e-8, 4) AS signal_ratio, round(level + 1e-8, 4) AS last_level FROM effects JOIN best USING (event_type)""",
    "pointwise_ci": f"""WITH {POINTS}, gaps AS (SELECT event_type, avg(observed - counterfactual) AS effect,
          stddev_pop(observed - counterfactual) / sqrt(count(*)) AS effect_se, count(*) AS n_post FROM points WHERE is_post GROUP BY 1)
        SELECT 'mid' AS analysis_id, event_type, n_post, {rounded('effect', 'effect_se')}, round(effect - 1.96 * effect_se + 1e-8, 4) AS effect_ci_lower,
        round(effect + 1.96 * effect_se + 1e-8, 4) AS effect_ci_upper, round({t_p('effect / effect_se', '(n_post - 1)')} + 1e-8, 4) AS p_value FROM gaps""",
    "did_spec_check": f"""WITH {SEGMENT_ROWS}, checked AS (SELECT DISTINCT unit, ts FROM rows), listed AS (SELECT * FROM (VALUES
        ('building', 'BUILDING', {ORDERS_AT}), ('machinery', 'MACHINERY', TIMESTAMP '1999-06-01'), ('unknown', 'NO SUCH UNIT', {ORDERS_AT}),
        ('early', 'BUILDING', TIMESTAMP '1990-01-01'), ('late', 'BUILDING', TIMESTAMP '2010-01-01')) v(analysis_id, u, since)) {SPEC_STATUS}""",
    "did_design": f"""WITH {DESIGN} SELECT analysis_id, unit, treated, post, treated * post AS treated_x_post, count(*) AS n, round(avg(y) + 1e-8, 4) AS mean
        FROM design GROUP BY ALL""",
    "did_cell_means": f"""WITH {CELLS} SELECT analysis_id, {rounded('treated_pre_mean', 'treated_post_mean', 'control_pre_mean', 'control_post_mean')},
        n_treated_pre, n_treated_post, n_control_pre, n_control_post FROM cells""",
    "did_effect": f"""WITH {CELLS} SELECT analysis_id, round(effect + 1e-8, 4) AS effect, round(effect / (abs(treated_pre_mean) + 1e-10) * 100 + 1e-8, 4) AS effect_pct,
        CASE WHEN effect > 0 THEN 'increase' ELSE 'decrease' END AS direction FROM did""",
    "did_inference": f"""{DID} SELECT analysis_id, {rounded('effect', 'effect_se', 'effect_ci_lower', 'effect_ci_upper', 'p_value')},
        p_value < 0.05 AS significant, n_treated_pre + n_treated_post AS n_treated, n_control_pre + n_control_post AS n_control, df_resid FROM result""",
    "did_points": f"""WITH {SEGMENT_ROWS}, {SPECS}, design AS (
          SELECT analysis_id, month AS ts, y, unit = treatment_unit AS treated, month >= since AS is_post FROM rows CROSS JOIN specs),
        shifts AS (SELECT analysis_id, avg(y) FILTER (treated AND NOT is_post) - avg(y) FILTER (NOT treated AND NOT is_post) AS shift FROM design GROUP BY 1),
        dated AS (SELECT analysis_id, ts, is_post, avg(y) FILTER (treated) AS observed, avg(y) FILTER (NOT treated) AS control FROM design GROUP BY 1, 2, 3),
        drawn AS (SELECT analysis_id, ts, is_post, observed, CASE WHEN is_post THEN control + shift ELSE coalesce(observed, control) END AS counterfactual
          FROM dated JOIN shifts USING (analysis_id))
        SELECT analysis_id, strftime(ts, {STAMP}) AS ts, is_post, {rounded('observed', 'counterfactual')}, round(observed - counterfactual + 1e-8, 4) AS effect FROM drawn""",
    "did_parallel_trends": f"""WITH {DESIGN}, days AS (SELECT analysis_id, treated, y, epoch_us(ts) / 86400000000.0 AS x FROM design WHERE post = 0),
        groups AS (SELECT analysis_id, treated, count(*) AS n, regr_slope(y, x) AS slope, regr_sxx(y, x) AS sxx,
          regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x) AS sse FROM days GROUP BY 1, 2),
        merged AS (SELECT analysis_id, sum(n)::BIGINT AS n_pre_rows, max(slope) FILTER (treated = 1) - max(slope) FILTER (treated = 0) AS slope_difference,
          sqrt(sum(sse) / (sum(n) - 4) * sum(1 / sxx)) AS slope_se FROM groups GROUP BY 1)
        SELECT analysis_id, n_pre_rows, {rounded('slope_difference', 'slope_se')},
        round({t_p('slope_difference / slope_se', '(n_pre_rows - 4)')} + 1e-8, 4) AS parallel_trends_p FROM merged""",
    "sc_spec_check": f"""WITH {STATUS_PANEL}, checked AS (SELECT * FROM panel), listed AS (SELECT * FROM (VALUES ('p', 'P', {ORDERS_AT}), ('unknown', 'X', {ORDERS_AT}),
        ('late', 'P', TIMESTAMP '2010-01-01')) v(analysis_id, u, since)) {SPEC_STATUS}""",
    "sc_panel": f"WITH {SEGMENT_ROWS} SELECT unit, strftime(month, {STAMP}) AS ts, round(avg(y) + 1e-8, 4) AS y FROM rows GROUP BY 1, month",
    "sc_gram": f"""WITH {SEGMENT_ROWS}, {SPECS}, panel AS (SELECT unit, month AS ts, avg(y) AS y FROM rows GROUP BY 1, 2),
        complete AS (SELECT ts FROM panel GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT unit) FROM panel)),
        pre AS (SELECT * FROM panel JOIN complete USING (ts) CROSS JOIN specs WHERE ts < since)
        SELECT a.analysis_id, a.unit, count(*) AS n_dates, round(sum(a.y * b.y), 1) AS cross, round(sum(a.y * a.y), 1) AS donor_square,
        round(sum(b.y * b.y), 1) AS treated_square FROM pre a JOIN pre b ON a.analysis_id = b.analysis_id AND a.ts = b.ts
        WHERE a.unit <> a.treatment_unit AND b.unit = b.treatment_unit GROUP BY 1, 2""",
    "sc_weights": f"""WITH {STATUS_POINTS} SELECT 'p' AS analysis_id, unit, round(weight + 1e-8, 4) AS weight
        FROM (SELECT 'F' AS unit, w AS weight FROM share UNION ALL SELECT 'O', 1 - w FROM share) WHERE weight > 0""",
    "sc_points": f"""WITH {STATUS_POINTS} SELECT 'p' AS analysis_id, strftime(ts, {STAMP}) AS ts, is_post, {rounded('observed', 'counterfactual')},
        round(observed - counterfactual + 1e-8, 4) AS effect FROM points""",
    "sc_rmspe": f"WITH {SC} SELECT 'p' AS analysis_id, {rounded('pre_rmspe', 'post_rmspe')}, round(post_rmspe / pre_rmspe + 1e-8, 4) AS rmspe_ratio FROM scored",
    "sc_effect": f"""WITH {SC} SELECT 'p' AS analysis_id, {rounded('effect', 'pre_mean', 'effect_se')}, n_pre, n_post,
        round(effect / (abs(pre_mean) + 1e-10) * 100 + 1e-8, 4) AS effect_pct, round(effect - 1.96 * effect_se + 1e-8, 4) AS effect_ci_lower,
        round(effect + 1.96 * effect_se + 1e-8, 4) AS effect_ci_upper, round({t_p('effect / effect_se', '(n_post - 1)')} + 1e-8, 4) AS p_value,
        {t_p('effect / effect_se', '(n_post - 1)')} < 0.05 AS significant, CASE WHEN effect > 0 THEN 'increase' ELSE 'decrease' END AS direction FROM scored""",
    "placebo_indices": f"""WITH {LOCATED} SELECT 'mid' AS analysis_id, event_type, unnest(range(greatest(10, n // 5), least(n - 10, n - n // 5))) AS placebo_idx FROM located""",
    "placebo_draw": f"""WITH RECURSIVE {SERIES}, sized AS (
          SELECT 'mid' AS analysis_id, event_type AS series_key, count(*) AS n FROM series GROUP BY 2
          UNION ALL SELECT 'orders', o_orderpriority, count(DISTINCT o_orderdate) FROM orders GROUP BY 2),
        ranged AS (SELECT *, greatest(10, n // 5) AS lo, least(n - 10, n - n // 5) - greatest(10, n // 5) AS width FROM sized),
        sides AS (SELECT *, ceil(width / ceil(sqrt(width)))::BIGINT AS across, ceil(sqrt(width))::BIGINT AS down FROM ranged WHERE width > 0),
        walk(analysis_id, series_key, lo, width, across, down, i, k, a, b) AS (
          SELECT analysis_id, series_key, lo, width, across, down, i, 0, i // across, i % across
          FROM (SELECT *, unnest(range(least(50, width))) AS i FROM sides)
          UNION ALL
          SELECT analysis_id, series_key, lo, width, across, down, i, k + 1,
            CASE WHEN k % 4 IN (0, 2) THEN (a + ('0x' || substr(md5('42|' || series_key || '|' || (k % 4 + 1) || '|' || b), 1, 12))::BIGINT) % down ELSE a END,
            CASE WHEN k % 4 IN (0, 2) THEN b ELSE (b + ('0x' || substr(md5('42|' || series_key || '|' || (k % 4 + 1) || '|' || a), 1, 12))::BIGINT) % across END
          FROM walk WHERE k = 0 OR k % 4 <> 0 OR a * across + b >= width)
        SELECT analysis_id, series_key, lo + a * across + b AS placebo_idx FROM walk WHERE k > 0 AND k % 4 = 0 AND a * across + b < width""",
    "placebo_effects_ar1": f"WITH {PLACEBO} SELECT 'mid' AS analysis_id, event_type, idx, is_real, round(effect + 1e-8, 4) AS effect FROM placebo",
    "placebo_summary": f"""WITH {PLACEBO}, actual AS (SELECT event_type, effect AS real_effect FROM placebo WHERE is_real),
        counted AS (SELECT event_type, any_value(real_effect) AS real_effect, count(*) AS n_placebos, count(*) FILTER (abs(effect) >= abs(real_effect)) AS n_extreme,
          quantile_cont(abs(effect), 0.95) AS placebo_p95 FROM placebo JOIN actual USING (event_type) WHERE NOT is_real GROUP BY 1)
        SELECT 'mid' AS analysis_id, event_type, {rounded('real_effect', 'placebo_p95')}, n_placebos, n_extreme,
        round((n_extreme + 1) / (n_placebos + 1) + 1e-8, 4) AS p_value, abs(real_effect) > placebo_p95 AS is_real_effect_extreme FROM counted""",
    "placebo_histogram": f"""WITH {PLACEBO}, ends AS (SELECT event_type, min(effect) AS lo, max(effect) AS hi FROM placebo WHERE NOT is_real GROUP BY 1)
        SELECT 'mid' AS analysis_id, event_type, least(20, floor((effect - lo) / (hi - lo) * 20) + 1)::BIGINT AS bin, count(*) AS n
        FROM placebo JOIN ends USING (event_type) WHERE NOT is_real GROUP BY 1, 2, 3""",
    "segment_calendar": """SELECT segment, count(*) AS n, round(avg(v) + 1e-8, 4) AS mean FROM (SELECT dayname(ts) AS segment, value AS v FROM events
        UNION ALL SELECT year(o_orderdate) || 'Q' || quarter(o_orderdate), o_totalprice FROM orders
        UNION ALL SELECT strftime(o_orderdate, '%Y-%m'), o_totalprice FROM orders) GROUP BY 1""",
    "segment_value_bin": """WITH rows AS (SELECT event_type, value FROM events UNION ALL
          SELECT l_returnflag, CASE WHEN l_quantity < 30 THEN 1.0 ELSE l_quantity END FROM lineitem),
        edges AS (SELECT event_type, quantile_cont(value, [0, 0.25, 0.5, 0.75, 1]) AS e FROM rows GROUP BY 1),
        binned AS (SELECT event_type, value, CASE WHEN len(list_distinct(e)) = 5 THEN CASE WHEN value <= e[2] THEN 'Q1 (Low)' WHEN value <= e[3] THEN 'Q2'
            WHEN value <= e[4] THEN 'Q3' ELSE 'Q4 (High)' END ELSE CASE WHEN value <= e[1] + (e[5] - e[1]) / 4 THEN 'Q1' WHEN value <= e[1] + 2 * (e[5] - e[1]) / 4 THEN 'Q2'
            WHEN value <= e[1] + 3 * (e[5] - e[1]) / 4 THEN 'Q3' ELSE 'Q4' END END AS segment FROM rows JOIN edges USING (event_type))
        SELECT event_type, segment, count(*) AS n, round(min(value) + 1e-8, 4) AS lowest, round(max(value) + 1e-8, 4) AS highest FROM binned GROUP BY 1, 2""",
    "segment_sizes": """SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m') AS segment, count(*) AS n_points,
        CASE WHEN count(*) < 30 THEN 'too_small' ELSE 'ok' END AS status FROM orders GROUP BY 1, 2""",
    "whatif_points": f"""WITH {WHATIF} SELECT 'mid' AS analysis_id, event_type, scenario, t, is_post, {rounded('observed', 'adjusted')} FROM adjusted""",
    "whatif_effects": f"""WITH {WHATIF}, sums AS (SELECT event_type, scenario, any_value(slope) AS slope, any_value(level) AS level, any_value(ci) AS ci, any_value(mult) AS mult,
          avg(observed - adjusted) AS effect, avg(CASE WHEN abs(adjusted) > 1e-6 THEN (observed - adjusted) / abs(adjusted) END) * 100 AS effect_pct,
          avg(observed - counterfactual) AS original, (avg(cf_upper) - avg(cf_lower)) / (2 * 1.96) AS se, count(*) AS n_post
          FROM adjusted WHERE is_post GROUP BY 1, 2),
        scored AS (SELECT *, {t_p('effect / se', '(n_post - 1)')} AS p_value, {t_p(f'original / (se * 1.96 / {Z})', '(n_post - 1)')} AS original_p FROM sums)
        SELECT 'mid' AS analysis_id, event_type, scenario, {rounded('effect', 'effect_pct', 'p_value')}, round(effect - mult * se + 1e-8, 4) AS ci_lower,
        round(effect + mult * se + 1e-8, 4) AS ci_upper, p_value < 0.05 AS significant,
        CASE WHEN (slope = 0 AND level = 0 AND ci = 95) OR (p_value < 0.05) = (original_p < 0.05) THEN ''
          WHEN p_value < 0.05 THEN 'The adjusted counterfactual makes the effect statistically significant.'
          ELSE 'The adjusted counterfactual makes the effect NOT statistically significant.' END AS note FROM scored""",
    "formatted_effects": f"""WITH {POINTS}, {summary('points', 'event_type')} SELECT 'mid' AS analysis_id, event_type, printf('%+.2f', effect) AS effect_text,
        printf('%+.1f%%', effect_pct) AS effect_pct_text, printf('%.4f', p_value) AS p_value_text, printf('[%.2f, %.2f]', cf_ci_lower, cf_ci_upper) AS ci_text,
        printf('%d / %d', n_pre, n_post) AS sample_text,
        printf('Effect: %+.2f (%+.1f%%), 95%% CI [%.2f, %.2f], p=%.4f', effect, effect_pct, cf_ci_lower, cf_ci_upper, p_value) AS summary FROM effects""",
    "effect_summary_text": f"""{DID}, {POINTS}, {summary('points', 'event_type')}, told AS (
          SELECT analysis_id AS analysis_id, effect_pct, direction, effect_ci_lower AS lo, effect_ci_upper AS hi, p_value, 'order value' AS metric FROM result
          UNION ALL SELECT event_type, effect_pct, direction, cf_ci_lower, cf_ci_upper, p_value, 'event value' FROM effects)
        SELECT analysis_id, CASE WHEN p_value < 0.05 THEN printf('The intervention caused a **%+.1f%% %s** in %s (95%% CI [%.2f, %.2f], p=%.4f). This effect is **statistically significant**.',
          abs(effect_pct), direction, metric, lo, hi, p_value)
        ELSE printf('The intervention did not produce a statistically significant effect on %s (p=%.4f). The observed change (%s) may be due to random variation.',
          metric, p_value, direction) END AS text FROM told""",
    "effect_narrative": f"""WITH {POINTS}, {summary('points', 'event_type')}, residuals AS (SELECT event_type, t, observed - counterfactual AS residual FROM points WHERE NOT is_post),
        {ljung_box('residuals')}, dates AS (SELECT event_type, strftime(min(ts), '%Y-%m-%d') AS day FROM points WHERE is_post GROUP BY 1)
        SELECT 'mid' AS analysis_id, event_type, '**On ' || day || '**, an intervention was applied.' || chr(10) || chr(10) ||
        CASE WHEN p_value < 0.05 THEN printf('The value **%s by %.1f%%** compared to what would have happened without the intervention.', direction || 'd', abs(effect_pct))
          ELSE printf('The observed change in value (%s of %.2f) **was not statistically significant** (p=%.4f).', direction, abs(effect), p_value) END
        || chr(10) || chr(10) || '**Statistical details:**' || chr(10) || printf('- Effect size: %+.4f (%+.1f%%)', effect, effect_pct) || chr(10)
        || printf('- 95%% confidence interval: [%.4f, %.4f]', cf_ci_lower, cf_ci_upper) || chr(10) || printf('- p-value: %.4f ', p_value) || {NARRATIVE_VERDICT} || chr(10)
        || printf('- Sample: %d pre-intervention, %d post-intervention points', n_pre, n_post)
        || CASE WHEN p > 0.05 THEN '' ELSE chr(10) || chr(10) ||
          '**Note:** Residual diagnostics suggest the model fit may not be ideal. Consider trying a different method or intervention date.' END AS narrative
        FROM effects JOIN checks USING (event_type) JOIN dates USING (event_type)""",
    "chart_points": f"""WITH {POINTS}, marks AS (SELECT event_type, min(ts) AS mark FROM points WHERE is_post GROUP BY 1)
        SELECT 'mid' AS analysis_id, event_type, strftime(ts, {STAMP}) AS ts, round(observed + 1e-8, 4) AS observed, CASE WHEN NOT is_post THEN round(counterfactual + 1e-8, 4) END AS fitted_pre,
        CASE WHEN is_post THEN round(counterfactual + 1e-8, 4) END AS counterfactual_post, CASE WHEN is_post THEN round(cf_lower + 1e-8, 4) END AS band_lower,
        CASE WHEN is_post THEN round(cf_upper + 1e-8, 4) END AS band_upper, ts = mark AS is_intervention FROM points JOIN marks USING (event_type)""",
    "pointwise_effect": f"""WITH {POINTS} SELECT 'mid' AS analysis_id, event_type, strftime(ts, {STAMP}) AS ts, round(observed - counterfactual + 1e-8, 4) AS effect,
        observed - counterfactual >= 0 AS is_positive FROM points""",
    "chi_square_tails": f"""WITH parts AS (SELECT event_type, 'hour' AS part, hour(ts) AS value FROM events UNION ALL SELECT event_type, 'weekday', isodow(ts) FROM events
          UNION ALL SELECT event_type, 'day', dayofyear(ts) FROM events),
        counts AS (SELECT event_type, part, value, count(*) AS c FROM parts WHERE value IS NOT NULL GROUP BY 1, 2, 3),
        sums AS (SELECT event_type, part, count(*) - 1 AS df, sum(c * c)::DOUBLE * count(*) / sum(c) - sum(c) AS x FROM counts GROUP BY 1, 2)
        SELECT event_type, part, df, round(x + 1e-8, 4) AS statistic, round({chi2_p_any('x', 'df')} + 1e-8, 4) AS p_value FROM sums""",
    "series_profile": f"""SELECT event_type, count(*) AS n_rows, strftime(min(ts), {STAMP}) AS first_ts, strftime(max(ts), {STAMP}) AS last_ts,
        round(avg(value) + 1e-8, 4) AS mean, round(stddev_samp(value) + 1e-8, 4) AS sd FROM events GROUP BY 1""",
    "describe_table": describe("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"),
    "table_fingerprint": f"""SELECT count(*) AS n_rows, CAST(coalesce(sum(('0x' || substr(md5({FINGERPRINT_ROW}), 1, 15))::BIGINT::HUGEINT), 0) AS VARCHAR) AS fingerprint FROM events""",
}

# Segments are series of their own: the same SQL with the segment as a part of the name.
_SEGMENTED = "SELECT event_type || '|' || strftime(ts, '%A') AS event_type, ts, value FROM events"
_LEVEL, _LEVEL_END = ORACLES["local_level_effects"].replace("FROM events", f"FROM ({_SEGMENTED})").rsplit("SELECT 'mid' AS analysis_id", 1)
ORACLES["subgroup_level_effects"] = f"""{_LEVEL},
  sizes AS (SELECT event_type, count(*) AS n_points FROM ({_SEGMENTED}) GROUP BY 1),
  states AS (SELECT event_type, n_points, CASE WHEN n_points < 30 THEN 'too_small' WHEN idx < greatest(3, n // 20) THEN 'too_early'
      WHEN n - idx - 1 < greatest(3, n // 20) THEN 'too_late' WHEN n < 30 THEN 'too_short' ELSE 'ok' END AS status
    FROM sizes JOIN located USING (event_type))
  SELECT 'mid' AS analysis_id, split_part(event_type, '|', 1) AS event_type, split_part(event_type, '|', 2) AS segment, n_points, status,
    {', '.join(f"CASE WHEN status = 'ok' THEN round({c} + 1e-8, 4) END AS {c}" for c in ('effect', 'effect_pct', 'cf_ci_lower', 'cf_ci_upper', 'effect_ci_lower', 'effect_ci_upper', 'p_value'))},
    CASE WHEN status = 'ok' THEN p_value < 0.05 END AS significant
  FROM states LEFT JOIN effects USING (event_type)"""
