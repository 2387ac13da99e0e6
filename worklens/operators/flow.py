"""Analytics on the status-change log: completions, lead and cycle time, velocity, delivery forecast."""

from __future__ import annotations

from functools import reduce
from operator import mul
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from worklens.functions import scalars as S
from worklens.functions.params import ACTIVE, DELIVERY_TYPES, IN_PROGRESS, TERMINAL, TODO, Params

c = F.col


def completions(issues: DataFrame, transitions: DataFrame, types: tuple[str, ...] = DELIVERY_TYPES) -> DataFrame:
    """key, assignee, done_at: the earliest Done of every issue of the types that has one."""
    done = transitions.filter("to_status = 'Done'").groupBy("key").agg(F.min("changed_at").alias("done_at"))
    return issues.filter(c("issuetype").isin(*types)).join(done, "key").select("key", c("assignee_name").alias("assignee"), "done_at")


def stories_of_features(issues: DataFrame, types: tuple[str, ...] = DELIVERY_TYPES) -> DataFrame:
    """Issues of the types with the Feature that they stand under."""
    features = issues.filter("issuetype = 'Feature'").select(c("key").alias("parent_key"), c("summary").alias("feature"))
    return issues.filter(c("issuetype").isin(*types)).join(features, "parent_key")


def has_done(issues: DataFrame, transitions: DataFrame) -> DataFrame:
    return issues.join(transitions.filter("to_status = 'Done'").select("key"), "key", "left_semi")


def lead_cycle(issues: DataFrame, transitions: DataFrame) -> DataFrame:
    """key, cycle, lead, done_at of issues with a Done. Both sides are clustered by key, so the join and the windows share one exchange.

    Active days are added up in the order of ``seq`` by a window: sums of doubles in another order can differ in the last bit, and a half day is then rounded the other way.
    """
    spells = transitions.join(issues.select("key", "created"), "key")
    w = Window.partitionBy("key").orderBy("seq")
    before, since = F.lag("to_status", 1, "To Do").over(w), F.coalesce(F.lag("changed_at").over(w), c("created"))
    active = F.when(before.isin(*ACTIVE), F.greatest(F.lit(0.0), S.days_between(since, c("changed_at")))).otherwise(0.0)
    timed = spells.select("key", "created", "to_status", "changed_at", "seq", active.alias("active"))
    timed = timed.withColumn("upto", F.sum("active").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    done = F.max(F.when(c("to_status") == "Done", c("changed_at")))
    per = timed.groupBy("key").agg(F.max_by("upto", "seq").alias("active"), done.alias("done_at"), F.first("created").alias("created")).filter("done_at is not null")
    lead = F.greatest(F.lit(0.0), S.days_between(c("created"), c("done_at")))
    return per.select("key", F.greatest(F.lit(1).cast("long"), F.bround("active").cast("long")).alias("cycle"), F.bround(lead).cast("long").alias("lead"), "done_at")


def months_before(p: Params, n: int) -> tuple[Column, Column]:
    """First of the trailing n complete business months, and the current one, as yyyy-MM."""
    now = S.to_zone(p.now(), p.business_tz)
    return F.date_format(F.add_months(F.trunc(now, "month"), -n), "yyyy-MM"), F.date_format(now, "yyyy-MM")


def lead_time_report(issues: DataFrame, transitions: DataFrame, p: Params, months: int = 6) -> DataFrame:
    """Stories of Features whose last Done lies in the trailing complete business months.

    Spells are only timed for stories whose last Done lies in the months: their keys are found first and reduce the log.
    """
    low, now = months_before(p, months)
    last = transitions.filter("to_status = 'Done'").groupBy("key").agg(F.max("changed_at").alias("last_done")).withColumn("month", S.business_month(c("last_done"), p))
    stories = stories_of_features(issues).join(last.filter((c("month") >= low) & (c("month") < now)).select(c("key").alias("done_key"), "month"), c("key") == c("done_key")).drop("done_key")
    timed = lead_cycle(stories, transitions).withColumnRenamed("key", "timed_key")
    return stories.select("key", "parent_key", "feature", "month").join(timed, c("key") == c("timed_key")).drop("timed_key")


def nearest_rank(values: DataFrame, by: list[str], column: str, at: dict[str, float]) -> DataFrame:
    """Per group the value at place floor(p n) of the sorted values (the last for p = 1). Windows run over counts of distinct values, not over rows."""
    w = Window.partitionBy(*by).orderBy(column)
    counts = values.filter(c(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("_times"))
    upto = counts.select(*by, column, F.sum("_times").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_upto"), F.sum("_times").over(Window.partitionBy(*by)).alias("_n"))
    pick = lambda q: F.min(F.when(c("_upto") > F.least(c("_n") - 1, F.floor(c("_n") * q)), c(column)))
    return upto.groupBy(*by).agg(*[pick(q).alias(n) for n, q in at.items()])


def half_up_median(values: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Middle of whole numbers; for an even count the mean of the middle two, rounded half up. That is the median, rounded half up in either case."""
    return values.groupBy(*by).agg(F.count("*").alias("n"), *[F.floor(F.percentile(x, 0.5) + 0.5).cast("long").alias(f"median_{x}") for x in columns])


def lead_by_feature(report: DataFrame) -> DataFrame:
    """Per Feature: stories, median lead and cycle, queue time, and the lead relative to the largest."""
    per = half_up_median(report, ["parent_key", "feature"], ["lead", "cycle"])
    top = per.agg(F.max("median_lead").alias("top"))
    queue = F.greatest(F.lit(0).cast("long"), c("median_lead") - c("median_cycle")).alias("queue")
    return per.crossJoin(F.broadcast(top)).select("parent_key", "feature", "n", "median_lead", "median_cycle", queue, F.round(c("median_lead") / F.nullif(c("top"), F.lit(0)), 6).alias("relative"))


def month_spine(spark, low: str, high: str) -> DataFrame:
    days = spark.sql(f"SELECT explode(sequence(DATE '{low}-01', DATE '{high}-01', INTERVAL 1 MONTH)) AS day")
    return days.select(F.date_format("day", "yyyy-MM").alias("month"))


def spine_of(issues: DataFrame, p: Params) -> DataFrame:
    """Every month from the first created issue to the last created or completed one, but none after now."""
    ends = issues.agg(F.min("created").alias("low"), F.least(F.max(F.greatest("created", F.coalesce("resolved", "updated"))), p.now()).alias("high"))
    months = F.sequence(F.trunc("low", "month"), F.trunc("high", "month"), F.expr("INTERVAL 1 MONTH"))
    return ends.filter("low is not null").select(F.explode(months).alias("day")).select(F.date_format("day", "yyyy-MM").alias("month"))


def monthly_velocity(done: DataFrame, roster: DataFrame, spine: DataFrame, p: Params) -> DataFrame:
    """name, month, n on the whole roster x month grid."""
    counts = done.select(c("assignee").alias("name"), S.business_month(c("done_at"), p).alias("month")).groupBy("name", "month").agg(F.count("*").alias("n"))
    grid = roster.crossJoin(F.broadcast(spine))
    return grid.join(counts, ["name", "month"], "left").fillna(0, ["n"])


def velocity_forecast(monthly: DataFrame, current: DataFrame, elapsed: Column) -> DataFrame:
    """name -> value, low, high, baseline. monthly: name, month, n; current: name, done in the running month."""
    w = Window.partitionBy("name").orderBy(F.desc("month"))
    last = monthly.withColumn("r", F.row_number().over(w)).filter("r <= 3").groupBy("name")
    weighted = F.sum(c("n") * (4 - c("r"))) / F.lit(6.0)
    base = last.agg(weighted.alias("base"), F.stddev_pop("n").alias("sd")).join(current, "name", "left").fillna(0, ["done"])
    blend = F.when(elapsed > 0, c("base") * (1 - elapsed) + c("done") / elapsed * elapsed).otherwise(c("base"))
    value = base.withColumn("x", blend)
    whole = lambda x: F.bround(x).cast("long")
    return value.select("name", whole(c("x")).alias("value"), whole(F.greatest(F.lit(0.0), c("x") - c("sd"))).alias("low"), whole(c("x") + c("sd")).alias("high"), whole(c("base")).alias("baseline"))


def open_hierarchy(issues: DataFrame, closed: Column) -> DataFrame:
    """Open initiatives; features that are open or stand under an open initiative."""
    initiatives = issues.filter((c("issuetype") == "Initiative") & ~closed)
    keys = initiatives.select(c("key").alias("parent_key"), F.lit(True).alias("under"))
    features = issues.filter("issuetype = 'Feature'").join(keys, "parent_key", "left").filter(~closed | c("under")).drop("under")
    return initiatives.unionByName(features)


SCOPE = ("done", "remaining", "todo", "prog", "blk", "hold", "recent")


def recent_done(transitions: DataFrame, p: Params, weeks: int = 12) -> DataFrame:
    """key of issues whose last Done lies in the trailing weeks."""
    return transitions.filter("to_status = 'Done'").groupBy("key").agg(F.max("changed_at").alias("at")).filter(c("at") >= p.now() - F.expr(f"INTERVAL '{7 * weeks}' DAY")).select("key")


def child_counts(children: DataFrame, transitions: DataFrame, p: Params, weeks: int = 12) -> DataFrame:
    """Scope per parent: done, remaining (neither Done nor Will Not Do), of these todo, prog, blk and hold; how many children were done recently; first created."""
    rows = children.filter("parent_key is not null").join(recent_done(transitions, p, weeks).withColumn("recent", F.lit(True)), "key", "left")
    n, status = lambda x, name: F.count_if(F.coalesce(x, F.lit(False))).alias(name), c("status")
    return rows.groupBy("parent_key").agg(
        n(status == "Done", "done"), n(~status.isin(*TERMINAL), "remaining"), n(status.isin(*TODO), "todo"), n(status.isin(*IN_PROGRESS), "prog"),
        n(status == "Blocked", "blk"), n(status == "On Hold", "hold"), n(c("recent"), "recent"), F.min("created").alias("first_created"),
    )


def initiative_counts(features: DataFrame, counts: DataFrame) -> DataFrame:
    """Scope of every initiative: the sums of its features' scopes. features: key, parent_key."""
    rolled = features.select("key", c("parent_key").alias("initiative")).filter("initiative is not null").join(counts.withColumnRenamed("parent_key", "key"), "key")
    return rolled.groupBy("initiative").agg(*[F.sum(x).alias(x) for x in SCOPE], F.min("first_created").alias("first_created"))


def _log_gamma(z: Column) -> Column:
    """Logarithm of the gamma function for z >= 1: Stirling's series eight places further."""
    far, step = z + 8, 1 / ((z + 8) * (z + 8))
    series = (1 / 12 + step * (-1 / 360 + step * (1 / 1260 + step * (-1 / 1680 + step / 1188)))) / far
    return (far - 0.5) * F.log(far) - far + 0.9189385332046727 + series - F.log(reduce(mul, [z + k for k in range(8)]))


def gamma_quantile(shape: Column, q: float, rounds: int = 4) -> Column:
    """The m at which a Poisson(m) count reaches ``shape`` with probability q, for whole shapes >= 1.

    Newton's method from the Wilson-Hilferty approximation by the normal law. The probability is the density times a series, evaluated from its
    far end by one product a term; 40 + 9 sqrt(shape) terms leave nothing that a double could hold.
    """
    r, z = shape.cast("double"), NormalDist().inv_cdf(q)
    terms = F.sequence((40 + F.ceil(9 * F.sqrt(r))).cast("int"), F.lit(1))

    def better(m: Column) -> Column:
        series = F.aggregate(terms, F.lit(1.0), lambda s, k: 1 + s * m / (r + k))
        density = F.exp((r - 1) * F.log(m) - m - _log_gamma(r))  # of the gamma law at m; the probability is density m / r series
        return F.greatest(m / 16, m - (m / r * series - F.lit(q) / density))

    start = F.greatest(r * F.pow(1 - 1 / (9 * r) + z / (3 * F.sqrt(r)), F.lit(3.0)), r / 100)
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda m, _: better(m))


def burndown_columns(quantiles: dict[str, float], cap: int = 260) -> dict[str, Column]:
    """Columns over remaining and rate: the first week at which the finish is more likely than each quantile.

    W <= w exactly when a Poisson(rate w) count reaches the remaining work, so the week is the first whose mean passes the gamma quantile of the
    remaining work. rate 0 gives the cap, nothing remaining gives 0.
    """
    live = (c("remaining") > 0) & (c("rate") > 0)
    week = lambda q: F.least(F.lit(cap).cast("double"), F.floor(gamma_quantile(c("remaining"), q) / c("rate")) + 1)
    return {n: F.when(c("remaining") <= 0, 0).when(live, week(q)).otherwise(cap).cast("int") for n, q in quantiles.items()}


def burndown(items: DataFrame, quantiles: dict[str, float], cap: int = 260) -> DataFrame:
    """key, remaining, rate -> key and the weeks of each quantile."""
    return items.select("key", *[w.alias(n) for n, w in burndown_columns(quantiles, cap).items()])


def delivery_items(issues: DataFrame, transitions: DataFrame, p: Params) -> DataFrame:
    """Open initiatives, and features that are open or stand under one, with scope counts, start, pace, class and confidence.

    Children are counted once by parent; an initiative's scope is the sum over its features.
    """
    epics = open_hierarchy(issues, c("status_category") == "done").select("key", "issuetype", "created", "parent_key", "summary", "status")
    counts = child_counts(issues, transitions, p)
    features = epics.filter("issuetype = 'Feature'")
    own = features.join(counts.withColumnRenamed("parent_key", "key"), "key", "left").withColumn("start", F.coalesce("first_created", "created"))
    under = epics.filter("issuetype = 'Initiative'").join(initiative_counts(features, counts).withColumnRenamed("initiative", "key"), "key", "left").withColumn("start", F.coalesce("created", "first_created"))
    rows = own.unionByName(under).fillna(0, list(SCOPE)).withColumn("proxy_start", F.to_date("start")).drop("start", "first_created")
    weeks = F.greatest(F.lit(0.0), S.days_between(c("proxy_start").cast("timestamp_ntz"), p.now()) / 7)
    kind = F.when(c("done") + c("remaining") == 0, "unbroken").when(c("remaining") == 0, "complete").when(c("recent") == 0, "stalled").otherwise("forecast")
    sure = F.when((c("recent") >= 8) & (weeks >= 4), "higher").when(c("recent") >= 4, "medium").otherwise("low")
    return rows.withColumns({"rate": c("recent") / F.least(F.lit(12.0), F.greatest(F.lit(2.0), weeks)), "class": kind, "confidence": sure})


def delivery_children(issues: DataFrame, transitions: DataFrame, items: DataFrame) -> DataFrame:
    """The children of delivery items: parent_key, key, summary, status, category, assignee, last change, target, and cycle days of those with a Done."""
    children = issues.join(items.select(c("key").alias("parent_key")), "parent_key", "left_semi")
    cycle = lead_cycle(children, transitions).select("key", "cycle")
    shown = children.select("parent_key", "key", F.coalesce("summary", F.lit("")).alias("summary"), "status", "status_category", "assignee_name", F.to_date("updated").alias("changed"), F.to_date("target_end_date").alias("target"))
    return shown.join(cycle, "key", "left")
