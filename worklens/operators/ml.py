"""Feature building and models on MLlib: on-time completion, and monthly throughput of many series at once."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from worklens.functions import scalars as S
from worklens.functions.params import Params
from worklens.operators.reports import numbered, trimmed_mean
from worklens.sources.ingest import shared_dir

c = F.col
#: Weight of the overall value in smoothed ones, statuses that are no backlog, days of lateness that leave no adherence.
PRIOR_WEIGHT, DONE_STATUSES, TOLERANCE_DAYS = 8.0, ("Done", "Closed", "Resolved"), 7.0
NUMERIC = (
    "budget_days", "assignee_velocity", "priority_velocity", "assignee_done", "assignee_on_time", "priority_on_time", "assignee_adherence", "priority_adherence",
    "assignee_backlog", "assignee_priority_backlog", "gap_assignee", "gap_priority", "ratio_assignee", "ratio_priority",
)


#: Rows of a file that fits read, and files at least where there are LEAST_ROWS rows for each: a file is one task at least. Every task sends sums of all nodes of 1,500 trees, so tasks are few and their rows many.
FILE_ROWS, FILES, LEAST_ROWS = 200_000, 24, 1000


def dealt(rows: DataFrame, n: int) -> DataFrame:
    """The n rows dealt out by key, to be written as files for fits. What follows a window or a join may otherwise be a single file, and every pass of a fit a single task."""
    files = max(-(-n // FILE_ROWS), min(-(-n // LEAST_ROWS), FILES), 1)
    return rows.repartition(files, "key").sortWithinPartitions("key")


def written(rows: DataFrame) -> DataFrame:
    """The frame as a table in the shared folder: models read it many times, and its plan ends there."""
    path = shared_dir(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def training_rows(issues: DataFrame, p: Params, lookback_days: int = 90) -> DataFrame:
    """The team's Done issues with dates, inside the lookback, with a cycle of 0 whole days or more and a budget of 1 or more."""
    kept = (F.lower(F.trim("status")) == "done") & c("assignee_name").isin(*p.team) & (c("updated") >= p.cutoff(lookback_days))
    rows = issues.filter(kept).select(
        "key", c("assignee_name").alias("assignee"), F.coalesce("priority_name", F.lit("No Priority")).alias("priority"), "created", "updated", "target_end_date",
        S.floor_days(c("created"), c("updated")).alias("cycle"), S.floor_days(c("created"), c("target_end_date")).alias("budget"),
        (c("updated") <= c("target_end_date")).cast("double").alias("on_time"),
    )
    return rows.filter("cycle >= 0 and budget >= 1")


def training_detail(issues: DataFrame) -> DataFrame:
    """All Done issues with a deadline: days past it, and whether they are on time once the usual validation delay is taken off."""
    kept = (F.lower(F.trim("status")) == "done") & c("target_end_date").isNotNull() & c("updated").isNotNull()
    rows = issues.filter(kept).select("key", F.coalesce("assignee_name", F.lit("Unassigned")).alias("assignee"), F.coalesce("priority_name", F.lit("No Priority")).alias("priority"), "updated", "target_end_date")
    offset = trimmed_mean(rows.withColumn("late", _late()), None, "late").select(F.coalesce("trimmed", F.lit(0.0)).alias("offset"))
    adjusted = F.timestamp_micros((S.micros(c("updated")) - F.round(c("offset") * S.DAY)).cast("long")).cast("timestamp_ntz")
    on_time = F.when(F.to_date(adjusted) <= F.to_date("target_end_date"), "Yes").otherwise("No")
    return rows.crossJoin(F.broadcast(offset)).withColumns({"past_due": F.datediff("updated", "target_end_date"), "on_time": on_time})


def _late() -> Column:
    return F.greatest(F.lit(0.0), S.days_between(c("target_end_date"), c("updated")))


def validation_delays(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Days from deadline to completion, 0 at least: smoothed by assignee, by priority (columns delay_a, delay_p), and the trimmed mean of all (delay_all).

    The mean of all is a stored table: its quantiles take several passes over the rows, and every table of delays and every frame with delays reads it.
    """
    late = rows.withColumn("late", _late())
    overall = written(trimmed_mean(late, None, "late").toDF("delay_all").select(F.coalesce("delay_all", F.lit(0.0)).alias("delay_all")))

    def by(group: str, name: str) -> DataFrame:
        per = late.groupBy(group).agg(F.sum("late").alias("s"), F.count("*").alias("n"))
        return per.crossJoin(F.broadcast(overall)).select(group, ((c("s") + c("delay_all") * PRIOR_WEIGHT) / (c("n") + PRIOR_WEIGHT)).alias(name))

    return by("assignee", "delay_a"), by("priority", "delay_p"), overall


def with_delay(rows: DataFrame, delays: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    """rows with ``delay``: the assignee's, else the priority's, else that of all."""
    a, p, overall = delays
    out = rows.join(a, "assignee", "left").join(p, "priority", "left").crossJoin(F.broadcast(overall))
    return out.withColumn("delay", F.coalesce("delay_a", "delay_p", "delay_all")).drop("delay_a", "delay_p", "delay_all")


def on_time_label(rows: DataFrame, delays: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """rows with ``delay``, ``label`` (done less the delay falls on the deadline's day or before) and ``adherence``. delays: validation_delays of these rows, where the caller has them."""
    adjusted = F.timestamp_micros((S.micros(c("updated")) - F.round(c("delay") * S.DAY)).cast("long")).cast("timestamp_ntz")
    out = with_delay(rows, delays or validation_delays(rows)).withColumn("adjusted", adjusted)
    label = (F.to_date("adjusted") <= F.to_date("target_end_date")).cast("double")
    late = S.days_between(c("target_end_date"), c("adjusted"))
    out = out.withColumns({"label": label, "days_late": late})
    return out.withColumn("adherence", F.when(c("label") == 1, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - c("days_late") / TOLERANCE_DAYS))).drop("adjusted", "days_late")


@dataclass
class History:
    """What is known of assignees and priorities: one row each, and one row of all."""

    assignees: DataFrame
    priorities: DataFrame
    overall: DataFrame
    backlog: DataFrame
    pair_backlog: DataFrame

    def stored(self) -> History:
        """The same as tables: what they are made of isn't read again by every fit and score."""
        return History(*[written(x) for x in (self.assignees, self.priorities, self.overall, self.backlog, self.pair_backlog)])


def open_pairs(issues: DataFrame, p: Params) -> DataFrame:
    """Open issues of every assignee of the team and priority: assignee, priority, assignee_priority_backlog."""
    open_ = issues.filter(~c("status").isin(*DONE_STATUSES) & c("assignee_name").isin(*p.team)).select(c("assignee_name").alias("assignee"), F.coalesce("priority_name", F.lit("No Priority")).alias("priority"))
    return open_.groupBy("assignee", "priority").agg(F.count("*").alias("assignee_priority_backlog"))


def history(rows: DataFrame, pairs: DataFrame) -> History:
    """rows: as of on_time_label; pairs: as of open_pairs."""
    stats = lambda s: [F.percentile("cycle", 0.5).alias("velocity" + s), F.count("*").alias("n" + s), F.sum("label").alias("on_time" + s), F.sum("adherence").alias("adherence" + s)]
    overall = rows.agg(F.percentile("cycle", 0.5).alias("velocity_all"), F.avg("label").alias("on_time_all"), F.avg("adherence").alias("adherence_all"))
    return History(
        rows.groupBy("assignee").agg(*stats("_a")), rows.groupBy("priority").agg(*stats("_p")), overall,
        pairs.groupBy("assignee").agg(F.sum("assignee_priority_backlog").alias("assignee_backlog")), pairs,
    )


def with_features(rows: DataFrame, past: History, leave_out: bool = False) -> DataFrame:
    """rows (assignee, priority, budget_days) with the fourteen NUMERIC features.

    With ``leave_out`` rows are those that the history was made of: a row's own outcome does not enter its groups' counts, rates and adherence.
    The history has a row for each name, so joins to it are broadcast by Spark as long as it is small.
    """
    out = rows.join(past.assignees, "assignee", "left").join(past.priorities, "priority", "left").join(past.backlog, "assignee", "left").join(past.pair_backlog, ["assignee", "priority"], "left")
    out = out.crossJoin(F.broadcast(past.overall))

    def smoothed(x: str, g: str) -> Column:
        own, n = (F.col("label" if x == "on_time" else x), F.greatest(c("n_" + g) - 1, F.lit(0))) if leave_out else (F.lit(0.0), c("n_" + g))
        return F.coalesce((c(f"{x}_{g}") - own + c(f"{x}_all") * PRIOR_WEIGHT) / (n + PRIOR_WEIGHT), c(f"{x}_all"))

    made = {"assignee_velocity": F.coalesce("velocity_a", "velocity_all"), "priority_velocity": F.coalesce("velocity_p", "velocity_all")}
    made["assignee_done"] = (F.greatest(c("n_a") - 1, F.lit(0)) if leave_out else F.coalesce("n_a", F.lit(1))).cast("double")
    made |= {f"{name}_{x}": smoothed(x, name[0]) for x in ("on_time", "adherence") for name in ("assignee", "priority")}
    made |= {x: F.coalesce(x, F.lit(0)).cast("double") for x in ("assignee_backlog", "assignee_priority_backlog")}
    out = out.withColumn("budget_days", c("budget_days").cast("double")).withColumns(made)
    out = out.withColumns({f"gap_{g}": c("budget_days") - c(f"{g}_velocity") for g in ("assignee", "priority")} | {f"ratio_{g}": c("budget_days") / F.greatest(c(f"{g}_velocity"), F.lit(1.0)) for g in ("assignee", "priority")})
    return out.select(*[x for x in rows.columns if x not in NUMERIC], *NUMERIC)


def split_by_time(rows: DataFrame) -> DataFrame:
    """rows with ``held_out``: the last fifth by completion, at least one row, leaving ten if there are as many."""
    n = rows.agg(F.count("*").alias("n"))
    size = F.least(F.greatest(F.floor(c("n") * 0.2), F.lit(1)), F.greatest(c("n") - 10, F.lit(1)))
    placed = numbered(rows, [F.to_date("updated")], ["updated", "key"])
    return placed.crossJoin(F.broadcast(n)).withColumn("held_out", c("place") > c("n") - size).drop("place", "n")


def fit_all(pipelines: dict[str, Pipeline], rows: DataFrame) -> dict[str, PipelineModel]:
    """The pipelines fitted on rows. They differ in their last stage alone, which goes over its rows many times: what the stages before it make of them is made once and kept for all."""
    *common, _ = next(iter(pipelines.values())).getStages()
    made = Pipeline(stages=common).fit(rows)
    ready = made.transform(rows).select("features", "label", "weight").persist()
    try:
        return {name: PipelineModel([*made.stages, p.getStages()[-1].fit(ready)]) for name, p in pipelines.items()}
    finally:
        ready.unpersist()


class PreparedPipeline(Pipeline):
    """A pipeline whose last stage finds its rows prepared by the stages before it, as in fit_all."""

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        return fit_all({"": self}, dataset)[""]


def classifiers(trees: int = 1500, rounds: int = 100, depth: int = 8) -> dict[str, Pipeline]:
    index = StringIndexer(inputCols=["assignee", "priority"], outputCols=["i_a", "i_p"], handleInvalid="keep")
    hot = OneHotEncoder(inputCols=["i_a", "i_p"], outputCols=["h_a", "h_p"])
    features = VectorAssembler(inputCols=[*NUMERIC, "h_a", "h_p"], outputCol="features")
    common = {"featuresCol": "features", "labelCol": "label", "weightCol": "weight", "seed": 7}
    models = {"forest": RandomForestClassifier(numTrees=trees, maxDepth=depth, **common), "boosted": GBTClassifier(maxIter=rounds, maxDepth=min(depth, 4), **common)}
    return {n: PreparedPipeline(stages=[index, hot, features, m]) for n, m in models.items()}


def weighted(rows: DataFrame) -> DataFrame:
    """Class weights n / (2 n_class)."""
    n = rows.agg(F.count("*").alias("_n"), F.sum("label").alias("_k"))
    w = F.when(c("label") == 1, c("_n") / (2 * F.greatest(c("_k"), F.lit(1.0)))).otherwise(c("_n") / (2 * F.greatest(c("_n") - c("_k"), F.lit(1.0))))
    return rows.crossJoin(F.broadcast(n)).withColumn("weight", w).drop("_n", "_k")


def folded(rows: DataFrame, folds: int = 3) -> DataFrame:
    """rows with ``fold``, dealt out within each class in an order by hash: folds hold equal numbers of a class, one apart at most."""
    dealt = numbered(rows.withColumn("_h", F.xxhash64("key")), [c("label"), F.shiftrightunsigned("_h", 48)], ["_h", "key"], "_place")
    first = dealt.groupBy("label").agg(F.min("_place").alias("_first")).withColumnRenamed("label", "_label")
    return dealt.join(F.broadcast(first), c("label") == c("_label")).withColumn("fold", F.pmod(c("_place") - c("_first"), F.lit(folds))).drop("_h", "_place", "_first", "_label")


def can_calibrate(rows: DataFrame, least: int = 30) -> bool:
    """Calibration asks for ``least`` rows and both classes."""
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    return n >= least and 0 < ones < n


def out_of_fold(features: DataFrame, pipeline: Pipeline, folds: int = 3) -> DataFrame:
    """(label, score): every row scored by a model of the other folds; folds are stratified by class."""
    rows = written(dealt(folded(weighted(features), folds), features.count()))
    parts = [pipeline.fit(rows.filter(c("fold") != k)).transform(rows.filter(c("fold") == k)) for k in range(folds)]
    return reduce(DataFrame.unionByName, [p.select("label", vector_to_array("probability")[1].alias("score")) for p in parts])


def platt(scores: DataFrame):
    """Sigmoid calibration: logistic regression on out-of-fold scores."""
    return LogisticRegression(featuresCol="s", labelCol="label", predictionCol="calibrated", rawPredictionCol="cr", probabilityCol="cp").fit(scores.select("label", array_to_vector(F.array("score")).alias("s")))


@dataclass
class OnTime:
    """A fitted model with its calibration (None under 30 rows), the history that requests are scored with, and the report's values."""

    model: object
    calibration: object
    past: History
    delays: tuple[DataFrame, DataFrame, DataFrame]
    report: dict


def fit_on_time(labelled: DataFrame, issues: DataFrame, p: Params, delays: tuple[DataFrame, DataFrame, DataFrame] | None = None, **sizes: int) -> OnTime | None:
    """Candidates are compared on the last fifth by completion, with a history of the rows before it; the best is fitted on all rows. None under 20 rows or with one class.

    labelled: a stored table as of on_time_label, for it is read many times. So are the frames with features, which are written once for all fits; the history is small and stored as well.
    delays: stored tables as of validation_delays, by which the rows were labelled; without them they are made again.
    """
    n, ones, average = labelled.agg(F.count("*"), F.sum("label"), F.avg("label")).first()
    if n < 20 or ones in (0, n):
        return None
    rows, pairs = written(dealt(split_by_time(labelled.withColumn("budget_days", c("budget"))), n)), written(open_pairs(issues, p))
    early, late = rows.filter("not held_out"), rows.filter("held_out")
    classes = {r["held_out"]: (r["n"], r["k"]) for r in rows.groupBy("held_out").agg(F.count("*").alias("n"), F.countDistinct("label").alias("k")).collect()}
    use = classes[False][0] >= 10 and all(classes.get(x, (0, 0))[1] == 2 for x in (False, True))
    accuracy = MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy")
    past = history(early if use else rows, pairs).stored()
    train, test = written(weighted(with_features(early if use else rows, past, leave_out=True))), written(with_features(late, past)) if use else None
    scores = {name: accuracy.evaluate(m.transform(test if use else train)) for name, m in fit_all(classifiers(**sizes), train).items()}
    best = max(sorted(scores), key=lambda k: scores[k])
    past = history(labelled, pairs).stored()
    full = written(weighted(with_features(rows, past, leave_out=True)))
    model = classifiers(**sizes)[best].fit(full)
    calibration = platt(written(out_of_fold(full.drop("weight"), classifiers(**sizes)[best]))) if can_calibrate(full) else None
    delays = delays or tuple(written(x) for x in validation_delays(labelled))
    fitted = OnTime(model, calibration, past, delays, {})
    own = probabilities(fitted, full).agg(F.avg((((c("probability") >= 0.5).cast("double")) == c("label")).cast("double"))).first()[0]
    fitted.report = {
        "model_name": best, "training_rows": n, "training_accuracy": float(own), "validation_rows": classes.get(True, (0,))[0] if use else 0, "validation_accuracy": float(scores[best]) if use else None,
        "accuracy_target_met": (scores[best] if use else own) >= 0.9, "probability_calibrated": calibration is not None, "on_time_rate": float(average), "average_validation_days": float(delays[2].first()[0]),
    }
    return fitted


def probabilities(fitted: OnTime, features: DataFrame) -> DataFrame:
    """Whole frames at once: features with ``probability`` and ``band``."""
    scored = fitted.model.transform(features).withColumn("s", array_to_vector(F.array(vector_to_array("probability")[1])))
    scored = scored.drop("probability", "rawPrediction", "prediction")
    p = vector_to_array("s")[0] if fitted.calibration is None else vector_to_array("cp")[1]
    scored = scored if fitted.calibration is None else fitted.calibration.transform(scored)
    out = scored.select(*features.columns, p.alias("probability"))
    return out.withColumn("band", F.when(c("probability") >= 0.75, "High confidence").when(c("probability") >= 0.5, "Moderate confidence").otherwise("Low confidence"))


#: What the score of a request hangs on.
ASKED = ("priority", "assignee", "date")


def score_requests(fitted: OnTime, requests: DataFrame, p: Params) -> DataFrame:
    """requests (priority, assignee, date) with features, probability and band. The budget is the days to the date less the usual validation delay, cut to whole days.

    Requests that agree in all three have the same score: each different one is scored once, and every request takes its own from the table of these.
    """
    rows = with_delay(requests.select(*ASKED).distinct(), fitted.delays)
    budget = (F.datediff("date", p.now()) - c("delay")).cast("int")
    scored = written(probabilities(fitted, with_features(rows.withColumn("budget_days", budget).drop("delay"), fitted.past)))
    same = reduce(lambda a, b: a & b, [c(f"r.{x}").eqNullSafe(c(f"s.{x}")) for x in ASKED])
    own = [c(f"r.{x}") for x in requests.columns if x not in NUMERIC]
    return requests.alias("r").join(scored.alias("s"), same).select(*own, *[c(f"s.{x}") for x in scored.columns if x not in ASKED])


def probability_curve(fitted: OnTime, requests: DataFrame, p: Params, horizon: int = 120, step: int = 7) -> DataFrame:
    """requests (priority, assignee, start) -> probability in percent at every seventh day from the start to the horizon."""
    days = requests.select("priority", "assignee", "start", F.explode(F.sequence(F.lit(0), F.lit(horizon), F.lit(step))).alias("day"))
    scored = score_requests(fitted, days.withColumn("date", F.date_add("start", c("day"))), p)
    return scored.select("priority", "assignee", "date", (c("probability") * 100).alias("percent"))


LAGS = 6
_ANGLE = 0.5235987755982988  # a twelfth of the circle
MAIN = ("lag1", "lag2", "lag3", "month_number", "day_of_week", "is_weekend", "high", "low", "rolling_mean", "rolling_std", "created")
SEASONAL = (*(f"lag{k}" for k in range(1, LAGS + 1)), "sine", "cosine", "trend")


def throughput_features(monthly: DataFrame) -> DataFrame:
    """series, month, completed, created -> lags, date parts, three-month maximum and minimum, shifted rolling mean and deviation, created, where all exist: from the fourth month on."""
    w = Window.partitionBy("series").orderBy("month")
    first, y = F.to_date(F.concat("month", F.lit("-01"))), c("completed").cast("double")
    rows = monthly.select(
        "series", "month", y.alias("completed"), *[F.lag(y, k).over(w).alias(f"lag{k}") for k in (1, 2, 3)], F.month(first).alias("month_number"), F.weekday(first).alias("day_of_week"),
        F.when(F.weekday(first) >= 5, 1).otherwise(0).alias("is_weekend"), F.max(y).over(w.rowsBetween(-2, 0)).alias("high"), F.min(y).over(w.rowsBetween(-2, 0)).alias("low"),
        F.avg(y).over(w.rowsBetween(-3, -1)).alias("rolling_mean"), F.stddev_samp(y).over(w.rowsBetween(-3, -1)).alias("rolling_std"), c("created").cast("double").alias("created"), (F.row_number().over(w) - 1).cast("double").alias("trend"),
    )
    return rows.filter("lag3 is not null")


def seasonal_lags(monthly: DataFrame) -> DataFrame:
    """series, month, completed -> six lags, the season's sine and cosine, and the trend, where all lags exist."""
    w = Window.partitionBy("series").orderBy("month")
    angle, y = F.substring("month", 6, 2).cast("int") * _ANGLE, c("completed").cast("double")
    rows = monthly.select("series", "month", y.alias("completed"), *[F.lag(y, k).over(w).alias(f"lag{k}") for k in range(1, LAGS + 1)], F.sin(angle).alias("sine"), F.cos(angle).alias("cosine"), (F.row_number().over(w) - 1).cast("double").alias("trend"))
    return rows.filter(f"lag{LAGS} is not null")


def _tested(model, columns, rows: DataFrame, least: int) -> tuple[DataFrame, dict]:
    """(backtest rows, errors): fitted on the first four fifths of the months, tested on the rest. All series have the same months."""
    low, high = rows.agg(F.min("trend"), F.max("trend")).first()
    n = int(high - low) + 1
    split = low + min(max(int(n * 0.8), least), n - 2)
    fitted = Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="features"), model]).fit(rows.filter(c("trend") < split))
    tested = fitted.transform(rows.filter(c("trend") >= split)).select("series", "month", "completed", "prediction")
    gap = c("prediction") - c("completed")
    return tested, tested.agg(F.avg(F.abs(gap)).alias("mae"), F.avg(gap * gap).alias("mse")).first().asDict()


def fit_throughput(features: DataFrame, rounds: int = 5000, rate: float = 0.01):
    """(backtest rows, errors) of boosted trees over MAIN; None under 8 months. Few rounds want a greater learning rate."""
    if features.select("month").distinct().count() < 8:
        return None
    return _tested(GBTRegressor(labelCol="completed", maxIter=rounds, maxDepth=3, stepSize=rate, seed=7), MAIN, features, 1)


def compare_throughput(rows: DataFrame, rounds: int = 400, trees: int = 500):
    """(best name, models fitted on all rows, errors by name, backtest rows by name) over SEASONAL; None under 8 months."""
    if rows.select("month").distinct().count() < 8:
        return None
    models = {"boosted": GBTRegressor(labelCol="completed", maxIter=rounds, maxDepth=3, stepSize=0.05, seed=7), "forest": RandomForestRegressor(labelCol="completed", numTrees=trees, maxDepth=8, seed=7)}
    vector = VectorAssembler(inputCols=list(SEASONAL), outputCol="features")
    found = {name: _tested(m, SEASONAL, rows, 6) for name, m in models.items()}
    errors = {name: x[1] for name, x in found.items()}
    best = min(sorted(errors), key=lambda k: errors[k]["mae"])
    return best, {name: Pipeline(stages=[vector, m]).fit(rows) for name, m in models.items()}, errors, {name: x[0] for name, x in found.items()}


def recursive_forecast(model, rows: DataFrame, steps: int) -> DataFrame:
    """series, month, value for the next months of every series, 0 at least; each step's predictions are the next step's lags. The loop runs over steps, not rows."""
    now = rows.groupBy("series").agg(F.max_by(F.struct("month", "trend", c("completed").alias("lag1"), *[c(f"lag{k}").alias(f"lag{k + 1}") for k in range(1, LAGS)]), "month").alias("x")).select("series", "x.*")
    out = None
    for _ in range(steps):
        now = now.withColumn("month", F.date_format(F.add_months(F.to_date(F.concat("month", F.lit("-01"))), 1), "yyyy-MM")).withColumn("trend", c("trend") + 1)
        angle = F.substring("month", 6, 2).cast("int") * _ANGLE
        step = model.transform(now.withColumns({"sine": F.sin(angle), "cosine": F.cos(angle)})).withColumn("value", F.greatest(F.lit(0.0), c("prediction")))
        part = step.select("series", "month", "value")
        out = part if out is None else out.unionByName(part)
        now = step.select("series", "month", "trend", c("value").alias("lag1"), *[c(f"lag{k}").alias(f"lag{k + 1}") for k in range(1, LAGS)])
    return out


def band(forecast: DataFrame, mae: float) -> DataFrame:
    """series, month, low, mid, high."""
    return forecast.select("series", "month", F.greatest(F.lit(0.0), c("value") - mae).alias("low"), c("value").alias("mid"), (c("value") + mae).alias("high"))


def ensemble(forecasts: dict[str, DataFrame], mae: float) -> DataFrame:
    """The mean of the models' forecasts, with a band of the best model's error."""
    both = reduce(DataFrame.unionByName, forecasts.values()).groupBy("series", "month").agg(F.avg("value").alias("value"))
    return band(both, mae)
