"""Windows, statistics, detectors, change points and validation on daily series, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegraph.operators import changepoint, detectors, validation
from tidegraph.operators import series as S
from tidegraph.queries.base import SERIES, USER_EDGES, canonical, query, rounded
from tidegraph.sources import documents
from tidegraph.sources.edges import daily_series

#: Three periods that share their boundary dates.
PERIODS = [(0, "1995-01-01", "1997-06-30"), (1, "1997-06-30", "1999-12-31"), (2, "1999-12-31", "2002-12-31")]
_W = "PARTITION BY series_id ORDER BY date"
_periods = "p AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, DATE '{a}', DATE '{b}')" for i, a, b in PERIODS) + ') v(period_index, "start", "end"))'
IN_PERIODS = f'{SERIES}, {_periods}, sp AS (SELECT s.series_id, s.date, s.value, p.period_index FROM series s JOIN p ON s.date >= p."start" AND s.date <= p."end")'


def periods(spark):
    p = spark.createDataFrame(PERIODS, "period_index int, start string, end string")
    return p.select("period_index", F.to_date("start").alias("start"), F.to_date("end").alias("end"))


def in_periods(spark, sf_dir):
    return S.in_periods(daily_series(spark, sf_dir), periods(spark)).select("series_id", "date", "value", "period_index")


@query("w02_w04_temporal", f"""WITH {SERIES}, d AS (SELECT *, round(value - lag(value) OVER ({_W}), 6) AS change FROM series)
SELECT series_id, date, change, round(CASE WHEN count(value) OVER ({_W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3 THEN avg(value) OVER ({_W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END, 4) AS mean3,
round(CASE WHEN count(value) OVER ({_W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3 THEN stddev_samp(value) OVER ({_W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END, 4) AS std3,
CAST(nullif(sign(change) * sign(lag(change) OVER ({_W})), 0) AS DOUBLE) AS autocorr FROM d""")
def temporal(spark, sf_dir):
    v = F.col("value")
    s = daily_series(spark, sf_dir).withColumns({"change": F.round(S.difference(v), 6), "mean3": F.round(S.trailing(v, 3), 4), "std3": F.round(S.trailing(v, 3, F.stddev_samp), 4), "autocorr": S.short_autocorrelation(F.round(v, 6))})
    return s.select("series_id", "date", "change", "mean3", "std3", "autocorr")


RESIDUALS = f"""{SERIES}, t AS (SELECT *, median(value) OVER ({_W} ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS trend FROM series),
res AS (SELECT series_id, date, value, trend, median(value - trend) OVER (PARTITION BY series_id, isodow(date)) AS seasonal FROM t)"""


@query("w05_w06_residuals", f"WITH {RESIDUALS} SELECT series_id, date, round(trend, 4) AS trend, round(seasonal, 4) AS seasonal, round(value - trend - seasonal, 4) AS residual FROM res")
def residuals(spark, sf_dir):
    return rounded(S.residuals(daily_series(spark, sf_dir)).select("series_id", "date", "trend", "seasonal", "residual"), 4)


@query("w07_w08_centred", f"""WITH {SERIES} SELECT series_id, date,
round(CASE WHEN count(value) OVER w30 >= 5 THEN avg(value) OVER w30 END, 4) AS mean30, round(CASE WHEN count(value) OVER w30 >= 5 THEN stddev_samp(value) OVER w30 END, 4) AS std30,
round(CASE WHEN count(value) OVER w7 >= 3 THEN avg(value) OVER w7 END, 4) AS mean7, round(CASE WHEN count(value) OVER w7 >= 3 THEN stddev_samp(value) OVER w7 END, 4) AS std7
FROM series WINDOW w30 AS ({_W} ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING), w7 AS ({_W} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""")
def centred(spark, sf_dir):
    v = F.col("value")
    s = daily_series(spark, sf_dir).withColumns({"mean30": S.centred(v, 30, F.avg, 5), "std30": S.centred(v, 30, F.stddev_samp, 5), "mean7": S.centred(v, 7, F.avg, 3), "std7": S.centred(v, 7, F.stddev_samp, 3)})
    return rounded(s.drop("value"), 4)


GAPS = f"{SERIES}, gappy AS (SELECT series_id, date, CASE WHEN day(date) % 4 <> 0 THEN value END AS value FROM series)"


def gappy(spark, sf_dir):
    return daily_series(spark, sf_dir).withColumn("value", F.when(F.dayofmonth("date") % 4 != 0, F.col("value")))


@query("w09_filled", f"WITH {GAPS} SELECT series_id, date, round(coalesce(last_value(value IGNORE NULLS) OVER ({_W} ROWS UNBOUNDED PRECEDING), 0), 4) AS value FROM gappy")
def filled(spark, sf_dir):
    return rounded(S.filled(gappy(spark, sf_dir)), 4)


@query("w10_interpolated", f"""WITH {GAPS}, n AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN date END IGNORE NULLS) OVER b AS d0, last_value(value IGNORE NULLS) OVER b AS v0,
first_value(CASE WHEN value IS NOT NULL THEN date END IGNORE NULLS) OVER a AS d1, first_value(value IGNORE NULLS) OVER a AS v1 FROM gappy WINDOW b AS ({_W} ROWS UNBOUNDED PRECEDING), a AS ({_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT series_id, date, round(CASE WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL THEN v0 WHEN d1 = d0 THEN v0 ELSE v0 + (v1 - v0) * (date - d0) / (d1 - d0) END, 3) AS value FROM n""")
def interpolated(spark, sf_dir):
    return rounded(S.interpolated(gappy(spark, sf_dir)), 3)


@query("w11_z_scores", f"WITH {SERIES} SELECT series_id, date, round((value - avg(value) OVER (PARTITION BY series_id)) / (stddev_samp(value) OVER (PARTITION BY series_id) + 1e-8), 6) AS z FROM series")
def z_scores(spark, sf_dir):
    return rounded(daily_series(spark, sf_dir).select("series_id", "date", S.z_scores(F.col("value")).alias("z")))


_lagged = f"(SELECT *, lag(value) OVER (PARTITION BY series_id, period_index ORDER BY date) AS l1, lag(value, 7) OVER (PARTITION BY series_id, period_index ORDER BY date) AS l7, row_number() OVER (PARTITION BY series_id, period_index ORDER BY date) - 1 AS t FROM sp)"
_pct = ", ".join(f"round(quantile_cont(value, {p / 100}), 1) AS p{p:02d}" for p in (5, 25, 50, 75, 95))


@query("x11_period_statistics", f"""WITH {IN_PERIODS} SELECT series_id, period_index, count(*) AS n, round(avg(value), 2) AS mean, round(stddev_pop(value), 2) AS std, round(var_pop(value) / 1e6, 4) AS variance_m, round(min(value), 2) AS min, round(max(value), 2) AS max,
round(max(value) - min(value), 2) AS range, round(skewness(value) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0)), 6) AS skewness, round(kurtosis_pop(value), 6) AS kurtosis, round(stddev_pop(value) / (avg(value) + 1e-12), 6) AS cv, {_pct},
round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 1) AS iqr, round(corr(value, l1), 6) AS autocorr_1, round(corr(value, l7), 6) AS autocorr_7, round(regr_slope(value, t), 4) AS trend_slope FROM {_lagged} GROUP BY 1, 2""")
def period_statistics(spark, sf_dir):
    st = S.statistics(in_periods(spark, sf_dir), ["period_index"]).withColumn("variance_m", F.col("variance") / 1e6).drop("variance")
    digits = dict.fromkeys(("skewness", "kurtosis", "cv", "autocorr_1", "autocorr_7"), 6) | {"trend_slope": 4, "variance_m": 4} | dict.fromkeys(("p05", "p25", "p50", "p75", "p95", "iqr"), 1)
    return st.select(*(F.round(c, digits.get(c, 2)).alias(c) if t == "double" else F.col(c) for c, t in st.dtypes))


@query("x10_summary", f"""WITH {SERIES} SELECT series_id, count(*) AS n, round(avg(value), 2) AS mean, round(median(value), 2) AS median, round(stddev_samp(value), 2) AS std, round(skewness(value), 6) AS skewness, round(kurtosis(value), 6) AS kurtosis,
round(100 * stddev_samp(value) / avg(value), 6) AS cv_percent, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 2) AS iqr FROM series GROUP BY 1""")
def summary(spark, sf_dir):
    s = S.summary(daily_series(spark, sf_dir))
    two, six = ("mean", "median", "std", "iqr"), ("skewness", "kurtosis", "cv_percent")
    return s.select("series_id", "n", *(F.round(c, 2).alias(c) for c in two), *(F.round(c, 6).alias(c) for c in six))


@query("x10_normality")
def normality(spark, sf_dir):
    daily = daily_series(spark, sf_dir)
    return rounded(S.summary(daily).select("series_id", "z_skewness", "p_skewness", "z_kurtosis", "p_kurtosis").join(S.normality(daily), "series_id"))


@query("x12_comparison", f"""WITH {SERIES}, q AS (SELECT *, quantile_cont(value, 0.25) OVER (PARTITION BY series_id) AS q1, quantile_cont(value, 0.75) OVER (PARTITION BY series_id) AS q3, CASE WHEN count(value) OVER w >= 5 THEN (value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0) END AS z
  FROM series WINDOW w AS ({_W} ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING))
SELECT series_id, count(*) AS n, round(avg(value), 2) AS mean, round(median(value), 2) AS median, round(stddev_samp(value), 2) AS std, round(skewness(value), 6) AS skewness, round(kurtosis(value), 6) AS kurtosis, round(100 * stddev_samp(value) / avg(value), 6) AS cv_percent, round(max(q3 - q1), 2) AS iqr,
round(max(value), 2) AS max, arg_max(date, value) AS max_date, count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS iqr_count, count(*) FILTER (WHERE abs(z) > 3) AS zscore_count FROM q GROUP BY 1""")
def comparison(spark, sf_dir):
    """One row a series: its summary, its largest day, and how many days each method flags."""
    daily = daily_series(spark, sf_dir)
    flags = daily.withColumns({"iqr_flag": detectors.iqr_flag(), "z": detectors.rolling_z()})
    counts = flags.groupBy("series_id").agg(F.count_if("iqr_flag").alias("iqr_count"), F.count_if(F.abs("z") > 3).alias("zscore_count"), F.round(F.max("value"), 2).alias("max"), F.max_by("date", "value").alias("max_date"))
    return summary(spark, sf_dir).join(counts, "series_id")


@query("x02_iqr_flags", f"""WITH {SERIES}, q AS (SELECT *, quantile_cont(value, 0.25) OVER (PARTITION BY series_id) AS q1, quantile_cont(value, 0.75) OVER (PARTITION BY series_id) AS q3 FROM series)
SELECT series_id, date FROM q WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""")
def iqr_flags(spark, sf_dir):
    return daily_series(spark, sf_dir).withColumn("flag", detectors.iqr_flag()).where("flag").select("series_id", "date")


@query("x03_rolling_z", f"""WITH {SERIES}, z AS (SELECT *, CASE WHEN count(value) OVER w >= 5 THEN (value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0) END AS z FROM series WINDOW w AS ({_W} ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING))
SELECT series_id, date, round(z, 6) AS z FROM z WHERE abs(z) > 2""")
def rolling_z(spark, sf_dir):
    return rounded(daily_series(spark, sf_dir).withColumn("z", detectors.rolling_z()).where("abs(z) > 2").select("series_id", "date", "z"))


@query("x04_rolling_sigma", f"""WITH {SERIES}, z AS (SELECT *, count(value) OVER w >= 3 AND abs(value - avg(value) OVER w) > 1.9 * stddev_samp(value) OVER w AS flag FROM series WINDOW w AS ({_W} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))
SELECT series_id, date FROM z WHERE flag""")
def rolling_sigma(spark, sf_dir):
    return daily_series(spark, sf_dir).withColumn("flag", detectors.rolling_sigma_flag(k=1.9)).where("flag").select("series_id", "date")


@query("j10_in_periods", f"WITH {IN_PERIODS} SELECT series_id, period_index, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM sp GROUP BY 1, 2")
def period_rows(spark, sf_dir):
    return in_periods(spark, sf_dir).groupBy("series_id", "period_index").agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query("j09_year_boundaries", f"""WITH {SERIES}, y AS (SELECT series_id, year(date) AS y, arg_max(value, date) AS last, arg_min(value, date) AS first, min(date) AS d FROM series GROUP BY 1, 2)
SELECT a.series_id, b.d AS date, a.last AS before, b.first AS after FROM y a JOIN y b ON a.series_id = b.series_id AND b.y = a.y + 1""")
def year_boundaries(spark, sf_dir):
    return S.year_boundaries(daily_series(spark, sf_dir), "value")


@query("x13_stitched", f"""WITH {SERIES}, parts AS (SELECT * FROM series UNION ALL SELECT series_id, date, value + 1 FROM series WHERE dayofyear(date) = 2) SELECT series_id, date, round(max(value), 2) AS value FROM parts GROUP BY 1, 2""")
def stitched(spark, sf_dir):
    s = daily_series(spark, sf_dir)
    extra = s.where(F.dayofyear("date") == 2).withColumn("value", F.col("value") + 1)
    return rounded(S.stitched(s.unionByName(extra)), 2)


@query("v09_events", f"""WITH {SERIES}, f AS (SELECT series_id, date FROM series WHERE value > 900000), g AS (SELECT *, CASE WHEN date - lag(date) OVER ({_W}) <= 3 THEN 0 ELSE 1 END AS o FROM f), e AS (SELECT *, sum(o) OVER ({_W}) AS event FROM g)
SELECT series_id, CAST(event AS BIGINT) AS event, min(date) AS first_day, max(date) AS last_day, count(*) AS n_days FROM e GROUP BY 1, 2""")
def events(spark, sf_dir):
    return S.runs_of_days(daily_series(spark, sf_dir).where("value > 900000"), ["series_id"], 3)


@query("k08_normal_days", f"""WITH {SERIES}, m AS (SELECT *, round(abs(value - median(value) OVER (PARTITION BY series_id)), 9) AS off FROM series), r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY off, date) AS r FROM m)
SELECT series_id, date, value FROM r WHERE r <= 5""")
def normal_days(spark, sf_dir):
    return S.nearest_to_median(daily_series(spark, sf_dir), 5)


@query("x01a_x01b_s_esd")
def s_esd(spark, sf_dir):
    return rounded(detectors.s_esd(daily_series(spark, sf_dir)).where("flag"))


@query("x01c_period_esd")
def period_esd(spark, sf_dir):
    return detectors.period_esd(in_periods(spark, sf_dir), ("series_id", "period_index")).where("flag").select("series_id", "period_index", "date")


@query("x05_isolation_forest")
def isolation(spark, sf_dir):
    return rounded(detectors.isolation(daily_series(spark, sf_dir)).where("flag"))


@query("x06_local_outlier_factor")
def lof(spark, sf_dir):
    return rounded(detectors.lof(daily_series(spark, sf_dir)).where("flag"))


@query("x07_x09_ensemble")
def ensemble(spark, sf_dir):
    return detectors.ensemble(detectors.yearly_flags(daily_series(spark, sf_dir))).where("n_votes > 0").drop("value")


@query("x08_k11_consensus")
def consensus(spark, sf_dir):
    return detectors.consensus(detectors.period_flags(in_periods(spark, sf_dir)))


@query("x14_x15_change_points")
def change_points(spark, sf_dir):
    s = daily_series(spark, sf_dir)
    return changepoint.periods(changepoint.change_points(s), s)


SCORED = f"scored AS (SELECT CASE WHEN tx_value > 0 THEN 1 ELSE 0 END AS y, CAST(total_input_bytes AS DOUBLE) AS a, total_gas_fees + tx_value / 1000 AS b, date FROM canon WHERE total_input_bytes IS NOT NULL)"


def scored(spark, sf_dir):
    c = canonical(spark, sf_dir).where("total_input_bytes IS NOT NULL")
    return c.select((F.col("tx_value") > 0).cast("int").alias("y"), F.col("total_input_bytes").cast("double").alias("a"), (F.col("total_gas_fees") + F.col("tx_value") / 1000).alias("b"), "date")


@query("s22_analysis_documents")
def analysis(spark, sf_dir):
    """One JSON document a series: periods with statistics and what each method flags."""
    rows = in_periods(spark, sf_dir)
    return documents.analysis_documents(detectors.period_flags(rows), S.statistics(rows, ["period_index"]))


@query("v02_auc", f"""WITH {USER_EDGES}, {SCORED}, r AS (SELECT date, y, rank() OVER (PARTITION BY date ORDER BY a) + (count(*) OVER (PARTITION BY date, a) - 1) / 2.0 AS r FROM scored),
s AS (SELECT date, sum(CASE WHEN y = 1 THEN r ELSE 0 END) AS s, CAST(sum(y) AS BIGINT) AS p, CAST(sum(1 - y) AS BIGINT) AS q FROM r GROUP BY 1) SELECT date, round(CASE WHEN p > 0 AND q > 0 THEN (s - p * (p + 1) / 2.0) / (p * q) END, 6) AS auc, p AS n_positive, q AS n_negative FROM s""")
def auc(spark, sf_dir):
    return rounded(validation.auc(scored(spark, sf_dir), "y", "a", ["date"]))


@query("v01_paired_bootstrap")
def bootstrap(spark, sf_dir):
    return rounded(validation.paired_bootstrap(scored(spark, sf_dir), "y", "a", "b", n_boot=1000))


RESULTS = f"results AS (SELECT erc20 AS target, date, round(avg(tx_value), 6) AS value, round(avg(tx_value) / 100, 9) AS p_value FROM canon GROUP BY 1, 2)"


def results(spark, sf_dir):
    return canonical(spark, sf_dir).groupBy(F.col("erc20").alias("target"), "date").agg(F.round(F.avg("tx_value"), 6).alias("value"), F.round(F.avg("tx_value") / 100, 9).alias("p_value"))


@query("v03_fdr", f"""WITH {USER_EDGES}, {RESULTS}, r AS (SELECT *, p_value * count(*) OVER (PARTITION BY target) / (rank() OVER (PARTITION BY target ORDER BY p_value) + count(*) OVER (PARTITION BY target, p_value) - 1) AS q FROM results)
SELECT target, date, round(least(1.0, min(q) OVER (PARTITION BY target ORDER BY p_value RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS p_value_fdr FROM r""")
def fdr(spark, sf_dir):
    return rounded(validation.benjamini_hochberg(results(spark, sf_dir), by=["target"]).select("target", "date", "p_value_fdr"))


@query("v04_placebo", f"WITH {USER_EDGES}, {RESULTS} SELECT target, round(100 * (avg(value) - 10.0) / 20.0, 6) AS residual_percent, count(*) FILTER (WHERE value >= 30.0) AS n_beating FROM results GROUP BY 1")
def placebo(spark, sf_dir):
    r = results(spark, sf_dir).withColumns({"a": F.lit(10.0), "b": F.lit(30.0)})
    return rounded(validation.placebo_residual(r, ["target"], "a", "b", "value"))


@query("v05_best_choice", f"WITH {USER_EDGES}, {RESULTS} SELECT target, arg_min(date, (p_value, date)) AS date, min(p_value) AS p_value FROM results GROUP BY 1")
def best_choice(spark, sf_dir):
    return validation.best_by(results(spark, sf_dir), "p_value", "date", ["target"])


@query("v06_w16_lagged", f"""WITH {USER_EDGES}, l AS (SELECT 'all' AS series_id, date, CASE WHEN avg(tx_value) > 19 THEN 1 ELSE 0 END AS a FROM canon GROUP BY 2),
x AS (SELECT series_id, lag, a, CASE lag WHEN 0 THEN a WHEN 1 THEN lead(a, 1) OVER w WHEN 2 THEN lead(a, 2) OVER w ELSE lead(a, 3) OVER w END AS later FROM l, (SELECT unnest([0, 1, 2, 3]) AS lag) k WINDOW w AS (PARTITION BY lag ORDER BY date))
SELECT series_id, lag, round(avg(CASE WHEN a = later THEN 1.0 ELSE 0.0 END), 6) AS agreement, count(*) AS n FROM x WHERE later IS NOT NULL GROUP BY 1, 2""")
def lagged(spark, sf_dir):
    daily = canonical(spark, sf_dir).groupBy("date").agg((F.avg("tx_value") > 19).cast("int").alias("a")).withColumn("series_id", F.lit("all"))
    return rounded(validation.lagged_agreement(daily, "a", "a", range(4)))


@query("v08_attribution", f"""WITH {SERIES}, an AS (SELECT series_id, date AS anomaly_date FROM series WHERE value > 900000), ev AS (SELECT DISTINCT date AS event_date FROM series WHERE day(date) = 15)
SELECT series_id, anomaly_date, event_date, CAST(anomaly_date - event_date AS INTEGER) AS lag_days, CASE WHEN anomaly_date - event_date BETWEEN 0 AND 3 THEN 'direct' WHEN anomaly_date - event_date BETWEEN 4 AND 7 THEN 'indirect' ELSE 'precursor' END AS relation
FROM an JOIN ev ON anomaly_date - event_date BETWEEN -7 AND 7""")
def attribution(spark, sf_dir):
    s = daily_series(spark, sf_dir)
    anomalies = s.where("value > 900000").select("series_id", F.col("date").alias("anomaly_date"))
    happened = s.where(F.dayofmonth("date") == 15).select(F.col("date").alias("event_date")).distinct()
    return validation.attributed(anomalies, happened)
