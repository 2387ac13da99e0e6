"""Queries of features (with SQL) and models (rows only)."""

from __future__ import annotations

from pyspark.sql import functions as F

from worklens.functions.params import DEFAULT as P
from worklens.operators import flow, ml as M
from worklens.plans.registry import NOW, days, query
from worklens.plans.report_queries import SP, TEAM, TR, TRIMMED, training

c = F.col
#: Trees and rounds of the on-time models: the operator's defaults, which are the report's.
TREES, ROUNDS = 1500, 100
#: Trees, rounds and learning rate of the registered throughput queries, which show results on small tables; the operators' defaults are the reports'.
MONTHLY_TREES, MONTHLY_ROUNDS, RATE = 24, 12, 0.1
TR_ALL = TR.replace("updated, ", "created, updated, target_end_date, ", 1)
LATE = f"SELECT *, greatest(0.0, {days('target_end_date', 'updated')}) AS late FROM tr"
_delay = "(SELECT {g}, (sum(late) + " + TRIMMED.format(x="late", tr="lt") + " * 8.0) / (count(*) + 8.0) AS v FROM lt GROUP BY 1)"
LBL = f"""SELECT *, CASE WHEN label = 1 THEN 1.0 ELSE greatest(0.0, 1 - {days('target_end_date', 'adjusted')} / 7.0) END AS adherence FROM (
 SELECT *, CAST(CAST(adjusted AS DATE) <= CAST(target_end_date AS DATE) AS DOUBLE) AS label FROM (
 SELECT lt.*, coalesce(a.v, p.v) AS delay, make_timestamp(CAST(epoch_us(updated) - round(coalesce(a.v, p.v) * 86400000000) AS BIGINT)) AS adjusted
 FROM lt LEFT JOIN {_delay.format(g='assignee')} a ON a.assignee = lt.assignee LEFT JOIN {_delay.format(g='priority')} p ON p.priority = lt.priority))"""
LABELS = {"tr": TR_ALL, "lt": LATE, "lb": LBL}
labelled = lambda t: M.on_time_label(stored(t, training(t)))


def features(t, leave_out: bool = False):
    rows = labelled(t)
    return M.with_features(rows.withColumn("budget_days", c("budget")), M.history(rows, M.open_pairs(t.issues, P)), leave_out)


query(
    "on_time_label",
    lambda t: labelled(t).select("key", F.round("delay", 6).alias("delay"), "label", F.round("adherence", 6).alias("adherence")),
    "SELECT key, round(delay, 6) AS delay, label, round(adherence, 6) AS adherence FROM lb",
    **LABELS,
)
_backlog = f"status NOT IN ('Done', 'Closed', 'Resolved') AND assignee_name IN ({TEAM})"
_values = lambda loo: ", ".join(
    f"({g[0]}.{x} - {y if loo else '0'} + o.{x} * 8.0) / ({f'greatest({g[0]}.n - 1, 0)' if loo else f'{g[0]}.n'} + 8.0) AS {g}_{x}" for x, y in (("on_time", "lb.label"), ("adherence", "lb.adherence")) for g in ("assignee", "priority")
)
FEATURES = """SELECT key, CAST(budget AS DOUBLE) AS budget_days, a.v AS assignee_velocity, p.v AS priority_velocity, CAST({done} AS DOUBLE) AS assignee_done, {values}, CAST(coalesce(b.n, 0) AS DOUBLE) AS assignee_backlog, CAST(coalesce(ab.n, 0) AS DOUBLE) AS assignee_priority_backlog,
 budget - a.v AS gap_assignee, budget - p.v AS gap_priority, budget / greatest(a.v, 1.0) AS ratio_assignee, budget / greatest(p.v, 1.0) AS ratio_priority
 FROM lb JOIN (SELECT assignee, quantile_cont(cycle, 0.5) AS v, count(*) AS n, sum(label) AS on_time, sum(adherence) AS adherence FROM lb GROUP BY 1) a ON a.assignee = lb.assignee
 JOIN (SELECT priority, quantile_cont(cycle, 0.5) AS v, count(*) AS n, sum(label) AS on_time, sum(adherence) AS adherence FROM lb GROUP BY 1) p ON p.priority = lb.priority
 CROSS JOIN (SELECT avg(label) AS on_time, avg(adherence) AS adherence FROM lb) o
 LEFT JOIN (SELECT assignee_name, count(*) AS n FROM w_issues WHERE {backlog} GROUP BY 1) b ON b.assignee_name = lb.assignee
 LEFT JOIN (SELECT assignee_name, coalesce(priority_name, 'No Priority') AS priority, count(*) AS n FROM w_issues WHERE {backlog} GROUP BY 1, 2) ab ON ab.assignee_name = lb.assignee AND ab.priority = lb.priority"""
_rounded = ", ".join(f"round({x}, 6) AS {x}" for x in M.NUMERIC)
for _name, _loo in (("on_time_features", False), ("on_time_features_loo", True)):
    query(
        _name,
        lambda t, loo=_loo: features(t, loo).select("key", *[F.round(x, 6).alias(x) for x in M.NUMERIC]),
        f"SELECT key, {_rounded} FROM fe",
        **LABELS,
        fe=FEATURES.format(done="greatest(a.n - 1, 0)" if _loo else "a.n", values=_values(_loo), backlog=_backlog),
    )


def stored(t, df):
    """The frame as a table in the shared folder: models read it many times."""
    return M.written(df)


def fitted(t):
    rows = stored(t, training(t))
    delays = tuple(stored(t, x) for x in M.validation_delays(rows))
    return M.fit_on_time(stored(t, M.on_time_label(rows, delays)), t.issues, P, delays, trees=TREES, rounds=ROUNDS)


REPORT = "model_name string, training_rows long, training_accuracy double, validation_rows long, validation_accuracy double, accuracy_target_met boolean, probability_calibrated boolean, on_time_rate double, average_validation_days double"


def model_report(t):
    found = fitted(t)
    return t.spark.createDataFrame([] if found is None else [tuple(found.report[x.split()[0]] for x in REPORT.split(", "))], REPORT)


def requests(t):
    """Every open issue of the team asks for its own deadline, and in 45 days where it has none."""
    date = F.coalesce(F.to_date("target_end_date"), F.date_add(F.to_date(P.now()), 45))
    return t.issues.filter((c("status_category") != "done") & c("assignee_name").isin(*P.team)).select("key", F.coalesce("priority_name", F.lit("No Priority")).alias("priority"), c("assignee_name").alias("assignee"), date.alias("date"))


def scored(t):
    found = fitted(t)
    if found is None:
        return t.spark.createDataFrame([], "key string, probability double, band string")
    return M.score_requests(found, stored(t, requests(t)), P).select("key", F.round("probability", 9).alias("probability"), "band")


def curve(t):
    found, pairs = fitted(t), t.issues.filter(c("assignee_name").isin(*P.team)).select(F.coalesce("priority_name", F.lit("No Priority")).alias("priority"), c("assignee_name").alias("assignee")).distinct()
    if found is None:
        return t.spark.createDataFrame([], "priority string, assignee string, date date, percent double")
    return M.probability_curve(found, pairs.withColumn("start", F.to_date(P.now())), P)


def calibration(t):
    """Coefficients of the sigmoid over out-of-fold scores, and the mean error of scores before and after it."""
    rows = stored(t, features(t, True))
    if not M.can_calibrate(rows):
        return t.spark.createDataFrame([], "slope double, intercept double, n long, brier_before double, brier_after double")
    scores = stored(t, M.out_of_fold(rows, M.classifiers(TREES, ROUNDS)["forest"]))
    found = M.platt(scores)
    after = 1 / (1 + F.exp(-(found.coefficients[0] * c("score") + found.intercept)))
    return scores.agg(F.lit(float(found.coefficients[0])).alias("slope"), F.lit(float(found.intercept)).alias("intercept"), F.count("*").alias("n"), F.avg((c("score") - c("label")) ** 2).alias("brier_before"), F.avg((after - c("label")) ** 2).alias("brier_after"))


query("on_time_model", model_report)
query("model_report", model_report)
query("platt_calibration", calibration)
query("score_probability", scored)
query("probability_curve", curve)


def series(t):
    """Created and completed issues by month of every lead, zero months included."""
    lead = c("business_lead").alias("series")
    done = t.issues.filter("status = 'Done'").groupBy(lead, F.date_format(F.coalesce("resolved", "updated"), "yyyy-MM").alias("month")).agg(F.count("*").alias("completed"))
    made = t.issues.groupBy(lead, F.date_format("created", "yyyy-MM").alias("month")).agg(F.count("*").alias("created"))
    grid = t.issues.filter("business_lead is not null").select(lead).distinct().crossJoin(F.broadcast(flow.spine_of(t.issues, P)))
    return grid.join(done, ["series", "month"], "left").join(made, ["series", "month"], "left").fillna(0, ["completed", "created"])


SR = """SELECT s.series, sp.month, coalesce(d.n, 0) AS completed, coalesce(k.n, 0) AS created FROM (SELECT DISTINCT business_lead AS series FROM w_issues WHERE business_lead IS NOT NULL) s CROSS JOIN sp
 LEFT JOIN (SELECT business_lead AS series, strftime(coalesce(resolved, updated), '%Y-%m') AS month, count(*) AS n FROM w_issues WHERE status = 'Done' GROUP BY 1, 2) d ON d.series = s.series AND d.month = sp.month
 LEFT JOIN (SELECT business_lead AS series, strftime(created, '%Y-%m') AS month, count(*) AS n FROM w_issues GROUP BY 1, 2) k ON k.series = s.series AND k.month = sp.month"""
_lag = lambda k: f"CAST(lag(completed, {k}) OVER w AS DOUBLE) AS lag{k}"
_day = "CAST(month || '-01' AS DATE)"
query(
    "throughput_features",
    lambda t: M.throughput_features(series(t)).select("series", "month", "completed", *[F.round(x, 6).alias(x) if x in ("rolling_mean", "rolling_std") else c(x) for x in M.MAIN]),
    f"""SELECT * FROM (SELECT series, month, CAST(completed AS DOUBLE) AS completed, {_lag(1)}, {_lag(2)}, {_lag(3)}, CAST(month({_day}) AS INT) AS month_number, CAST(isodow({_day}) - 1 AS INT) AS day_of_week, CAST(CASE WHEN isodow({_day}) >= 6 THEN 1 ELSE 0 END AS INT) AS is_weekend,
 CAST(max(completed) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE) AS high, CAST(min(completed) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE) AS low,
 round(avg(completed) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 6) AS rolling_mean, round(stddev_samp(completed) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 6) AS rolling_std, CAST(created AS DOUBLE) AS created FROM sr WINDOW w AS (PARTITION BY series ORDER BY month)) WHERE lag3 IS NOT NULL""".replace("(w ROWS", "(PARTITION BY series ORDER BY month ROWS"),
    sp=SP, sr=SR,
)
query(
    "seasonal_lags",
    lambda t: M.seasonal_lags(series(t)).select("series", "month", "completed", *[c(f"lag{k}") for k in range(1, 7)], *[(F.round(x, 6) + 0.0).alias(x) for x in ("sine", "cosine")], "trend"),
    f"SELECT * FROM (SELECT series, month, CAST(completed AS DOUBLE) AS completed, {', '.join(map(_lag, range(1, 7)))}, round(sin(2 * pi() * CAST(substr(month, 6, 2) AS INT) / 12), 6) + 0.0 AS sine, round(cos(2 * pi() * CAST(substr(month, 6, 2) AS INT) / 12), 6) + 0.0 AS cosine, CAST(row_number() OVER w - 1 AS DOUBLE) AS trend FROM sr WINDOW w AS (PARTITION BY series ORDER BY month)) WHERE lag6 IS NOT NULL",
    sp=SP, sr=SR,
)
STEPS = 6


def throughput_model(t):
    found = M.fit_throughput(stored(t, M.throughput_features(series(t))), MONTHLY_ROUNDS, RATE)
    return t.spark.createDataFrame([], "series string, month string, completed double, prediction double") if found is None else found[0]


def compared(t):
    """(rows, best, models, errors, backtests), or None where there are too few months for a model."""
    rows = stored(t, M.seasonal_lags(series(t)))
    found = M.compare_throughput(rows, MONTHLY_ROUNDS, MONTHLY_TREES)
    return None if found is None else (rows, *found)


def or_empty(schema: str):
    """A query of the comparison's parts; an empty result where there is no comparison."""

    def of(make):
        def run(t):
            found = compared(t)
            return t.spark.createDataFrame([], schema) if found is None else make(t, *found)

        return run

    return of


BANDED = "series string, month string, low double, mid double, high double"


@or_empty("model string, mae double, mse double, chosen boolean")
def model_comparison(t, rows, best, models, errors, tested):
    return t.spark.createDataFrame([(n, float(e["mae"]), float(e["mse"]), n == best) for n, e in sorted(errors.items())], "model string, mae double, mse double, chosen boolean")


@or_empty(BANDED)
def forecast(t, rows, best, models, errors, tested):
    return M.band(M.recursive_forecast(models[best], rows, STEPS), float(errors[best]["mae"]))


@or_empty(BANDED)
def ensemble_forecast(t, rows, best, models, errors, tested):
    return M.ensemble({n: M.recursive_forecast(m, rows, STEPS) for n, m in models.items()}, float(errors[best]["mae"]))


@or_empty("series string, month string, kind string, value double")
def forecast_concat(t, rows, best, models, errors, tested):
    ahead = M.band(M.recursive_forecast(models[best], rows, STEPS), float(errors[best]["mae"]))
    return tested[best].select("series", "month", F.lit("backtest").alias("kind"), c("prediction").alias("value")).unionByName(ahead.select("series", "month", F.lit("forecast").alias("kind"), c("mid").alias("value")))


query("throughput_model", throughput_model)
query("model_comparison", model_comparison)
query("recursive_forecast", forecast)
query("ensemble_forecast", ensemble_forecast)
query("forecast_band", lambda t: forecast(t).groupBy("series").agg(*[F.sum(x).alias(x) for x in ("low", "mid", "high")]))
query("forecast_concat", forecast_concat)
query(
    "model_error",
    lambda t: M.throughput_features(series(t)).agg(F.round(F.avg(F.abs(c("lag1") - c("completed"))), 6).alias("mae"), F.round(F.avg((c("lag1") - c("completed")) ** 2), 6).alias("mse")),
    "SELECT round(avg(abs(lag1 - completed)), 6) AS mae, round(avg((lag1 - completed) ** 2), 6) AS mse FROM (SELECT CAST(completed AS DOUBLE) AS completed, CAST(lag(completed) OVER w AS DOUBLE) AS lag1, lag(completed, 3) OVER w AS l3 FROM sr WINDOW w AS (PARTITION BY series ORDER BY month)) WHERE l3 IS NOT NULL",
    sp=SP, sr=SR,
)
