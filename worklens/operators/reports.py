"""Ticket reports as DataFrame -> DataFrame functions: one grouping, spine or ranking each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from worklens.functions import scalars as S
from worklens.functions.params import AGE_EXCLUDED, AGE_EXCLUDED_BY_STATUS, CAPACITY_DONE, EXCLUDED_STATUSES, PRIORITIES, SIZE_BACKLOG, SIZES, TREND_DONE, Params
from worklens.operators.ranks import quantiles

c = F.col


def is_open() -> Column:
    return ~F.coalesce(c("status").isin(*EXCLUDED_STATUSES), F.lit(False))


def on_spine(counts: DataFrame, spine: Sequence[str], column: str) -> DataFrame:
    """Counts for every value of a fixed list, zeros included."""
    values = counts.sparkSession.createDataFrame([(v,) for v in spine], f"{column} string")
    return values.join(counts, column, "left").fillna(0, ["n"])


def grains(rows: DataFrame, sets: dict[str, list[str]], *aggregates: Column) -> DataFrame:
    """The same aggregates at several grains in one pass: ``grain`` names the set of columns, the others are null."""
    names = list(dict.fromkeys(x for own in sets.values() for x in own))
    mask = {sum(1 << len(names) - 1 - k for k, x in enumerate(names) if x not in own): grain for grain, own in sets.items()}
    out = rows.groupingSets([[c(x) for x in own] for own in sets.values()], *names).agg(F.grouping_id().alias("_mask"), *aggregates)
    grain = F.coalesce(*[F.when(c("_mask") == m, F.lit(g)) for m, g in mask.items()])
    return out.select(grain.alias("grain"), *names, *[x for x in out.columns if x not in ("_mask", *names)])


def owner() -> Column:
    """The assignee as workload reports name it."""
    return F.trim(F.coalesce("assignee_name", F.lit("Unassigned")))


def not_excluded(assignee: Column, p: Params) -> Column:
    return ~F.lower(assignee).isin(*[x.lower() for x in p.excluded])


def share(condition: Column) -> Column:
    return F.round(F.avg(condition.cast("double")) * 100, 6)


def top_semi(rows: DataFrame, column: str, n: int) -> DataFrame:
    """Rows of the n most frequent values of a column, ties by value. n is a report's length."""
    top = rows.filter(c(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), column).limit(n).select(column)
    return rows.join(F.broadcast(top), column, "left_semi")


def crosstab(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of every pair of values that occur, also of pairs that do not."""
    grid = rows.select(a).distinct().crossJoin(rows.select(b).distinct())
    return grid.join(rows.groupBy(a, b).agg(F.count("*").alias("n")), [a, b], "left").fillna(0, ["n"])


def created_vs_completed(issues: DataFrame, from_year: int = 1995, done: tuple[str, ...] = CAPACITY_DONE) -> DataFrame:
    """month, created, completed."""
    made = issues.groupBy(F.date_format("created", "yyyy-MM").alias("month")).agg(F.count("*").alias("created"))
    finished = issues.filter(c("status").isin(*done)).groupBy(F.date_format(F.coalesce("resolved", "updated"), "yyyy-MM").alias("month")).agg(F.count("*").alias("completed"))
    return made.join(finished, "month", "full_outer").fillna(0).filter(F.substring("month", 1, 4).cast("int") > from_year)


def trend_spine(issues: DataFrame, months: int = 9) -> DataFrame:
    """The last months (six to nine) up to that of the last update."""
    last = F.trunc("last", "month")
    ends = issues.agg(F.max(F.coalesce("resolved", "updated")).alias("last")).filter("last is not null")
    return ends.select(F.explode(F.sequence(F.add_months(last, 1 - max(6, min(9, months))), last, F.expr("INTERVAL 1 MONTH"))).alias("day")).select(F.date_format("day", "yyyy-MM").alias("month"))


def whole_spine(issues: DataFrame) -> DataFrame:
    """Every month from the first created or done issue to the last."""
    at = F.coalesce("resolved", "updated")
    ends = issues.agg(F.min(F.least("created", at)).alias("low"), F.max(F.greatest("created", at)).alias("high")).filter("low is not null")
    return ends.select(F.explode(F.sequence(F.trunc("low", "month"), F.trunc("high", "month"), F.expr("INTERVAL 1 MONTH"))).alias("day")).select(F.date_format("day", "yyyy-MM").alias("month"))


def trend_done(issues: DataFrame, spine: DataFrame) -> DataFrame:
    """Issues done in the months, with the month."""
    return issues.filter(c("status").isin(*TREND_DONE)).withColumn("month", F.date_format(F.coalesce("resolved", "updated"), "yyyy-MM")).join(F.broadcast(spine), "month")  # a row a month


def monthly_cycle(issues: DataFrame, spine: DataFrame) -> DataFrame:
    """month, median and 75th percentile of whole days from creation to update of what was done in it, 0 where nothing was. Days are few different values, so Spark's percentile holds few."""
    days = F.percentile(S.floor_days(c("created"), c("updated")), F.array(F.lit(0.5), F.lit(0.75)))
    rows = spine.join(trend_done(issues, spine).groupBy("month").agg(days.alias("q")), "month", "left")
    return rows.select("month", *[F.coalesce(c("q")[k], F.lit(0.0)).alias(n) for k, n in enumerate(("median", "p75"))])


def trend_kpis(flow: DataFrame, cycle: DataFrame) -> DataFrame:
    """Totals of the months, completion rate in percent, and the means of the months' cycle times that aren't 0."""
    totals = flow.agg(F.sum("created").alias("created"), F.sum("completed").alias("completed"))
    rate = F.coalesce(F.round(c("completed") / F.nullif(c("created"), F.lit(0)) * 100, 6), F.lit(0.0)).alias("rate")
    mean = lambda x: F.coalesce(F.round(F.avg(F.nullif(c(x), F.lit(0.0))), 6), F.lit(0.0)).alias(f"{x}_cycle")
    return totals.select("created", "completed", rate).crossJoin(F.broadcast(cycle.agg(mean("median"), mean("p75"))))


def monthly_flow(issues: DataFrame, spine: DataFrame, done: tuple[str, ...] = ("Done",)) -> DataFrame:
    """Counts on a continuous month index, net flow and its running sum. The windows run over months, not over issues."""
    rows = spine.join(created_vs_completed(issues, 0, done), "month", "left").fillna(0).withColumn("net", c("completed") - c("created"))
    return rows.withColumn("cumulative", F.sum("net").over(Window.orderBy("month")))


def velocity_union(issues: DataFrame, p: Params, days: int = 720) -> DataFrame:
    """key, assignee, priority, kind, days of the team's recent Done issues: backlog velocity (created to planned start) and execution velocity (created to updated), each where it is positive."""
    rows = issues.filter((c("status") == "Done") & c("assignee_name").isin(*p.team) & (c("created") >= p.now() - F.expr(f"INTERVAL '{days}' DAY")))
    return _both_velocities(rows, c("assignee_name"), S.canonical_priority(c("priority_name"), "velocity"), S.floor_days(c("created"), F.coalesce("resolved", "updated")))


def done_window_union(issues: DataFrame, p: Params) -> DataFrame:
    """As ``velocity_union`` for everybody but the excluded, of issues Done in the window; priorities as they stand, "Unknown" if null."""
    rows = done_window(issues, p, keep_nulls=True).filter(not_excluded(owner(), p))
    return _both_velocities(rows, owner(), F.coalesce("priority_name", F.lit("Unknown")), S.floor_days(c("created"), c("updated")))


def _both_velocities(rows: DataFrame, assignee: Column, priority: Column, execution: Column) -> DataFrame:
    """One pass: an issue gives a row for each of its two velocities that counts."""
    backlog = F.floor(S.floor_days(c("created"), c("planned_start_date")))
    kind = lambda name, days, fits: F.when(fits, F.struct(F.lit(name).alias("kind"), days.alias("days")))
    both = F.array(kind("backlog", backlog, backlog > 0), kind("execution", execution, S.floor_days(c("created"), c("updated")) > 0))
    return rows.select("key", assignee.alias("assignee"), priority.alias("priority"), F.explode(F.array_compact(both)).alias("v")).select("key", "assignee", "priority", "v.kind", "v.days")


def done_window(issues: DataFrame, p: Params, keep_nulls: bool = False) -> DataFrame:
    """Done issues last updated in the window."""
    recent = F.coalesce("resolved", "updated") >= p.cutoff()
    return issues.filter((F.lower("status") == "done") & F.coalesce(recent, F.lit(keep_nulls)))


def execution_days(done: DataFrame, p: Params) -> DataFrame:
    """assignee, x, w of done issues with a planned start: days from it to the update where positive, and their weight by recency. Excluded assignees are left out."""
    recency = F.greatest(F.lit(0.0), S.days_between(c("updated"), p.now()))
    rows = done.filter(not_excluded(owner(), p)).select(owner().alias("assignee"), S.days_between(c("planned_start_date"), c("updated")).alias("x"), S.recency_weight(recency).alias("w"))
    return rows.filter("x > 0")


def execution_profile(done: DataFrame, p: Params) -> DataFrame:
    """Per assignee median, recency-weighted mean and n of execution days; global values beside them."""
    rows = execution_days(done, p)
    weighted = F.round(F.sum(c("x") * c("w")) / F.sum("w"), 6)
    one = quantiles(rows, ["assignee"], c("x"), {"median": 0.5}).join(rows.groupBy("assignee").agg(weighted.alias("weighted")), "assignee")
    every = quantiles(rows, [], c("x"), {"median_all": 0.5}).withColumnRenamed("n", "n_all").crossJoin(F.broadcast(rows.agg(weighted.alias("weighted_all"))))
    one = one.select("assignee", F.round("median", 6).alias("median"), "weighted", "n")
    return one.crossJoin(F.broadcast(every)).select(*one.columns, F.round("median_all", 6).alias("median_all"), "weighted_all", "n_all")


def in_progress(issues: DataFrame, p: Params) -> DataFrame:
    """Work in progress without Features and excluded assignees."""
    return issues.filter((F.lower("status") == "in progress") & (F.lower("issuetype") != "feature") & not_excluded(owner(), p))


def in_progress_load(issues: DataFrame, done: DataFrame, p: Params) -> DataFrame:
    """Work in progress per assignee times the assignee's median execution days, the global ones where the assignee has none."""
    counts = in_progress(issues, p).groupBy(owner().alias("assignee")).agg(F.count("*").alias("open"))
    rows = execution_days(done, p)
    every = quantiles(rows, [], c("x"), {"all": 0.5}).select(F.coalesce(F.round("all", 6), F.lit(0.0)).alias("all"))
    own = quantiles(rows, ["assignee"], c("x"), {"median": 0.5}).select("assignee", F.round("median", 6).alias("median"))
    out = counts.join(own, "assignee", "left").crossJoin(F.broadcast(every)).select("assignee", "open", F.coalesce("median", "all").alias("velocity"))
    return out.withColumn("estimated_days", F.round(c("open") * c("velocity"), 6)).withColumn("bucket", S.load_bucket(c("estimated_days")))


def load_totals(load: DataFrame, velocity: str, estimate: str) -> DataFrame:
    """Issues, estimated days, mean velocity over assignees, and assignees with over 90 estimated days."""
    return load.agg(F.sum("open").alias("open"), F.round(F.sum(estimate), 4).alias("estimated_days"), F.round(F.avg(velocity), 4).alias("mean_velocity"), F.count_if(c(estimate) > 90).alias("critical"))


def complete_grid(union: DataFrame, digits: int | None = 6) -> DataFrame:
    """Mean days of every assignee x kind x priority, overall mean where a cell has no rows. The grid is the operator: its sides are names, not issues."""
    overall = union.agg(F.avg("days").alias("overall"))
    kinds = union.sparkSession.createDataFrame([("backlog",), ("execution",)], "kind string")
    grid = union.select("assignee").distinct().crossJoin(kinds).crossJoin(union.select("priority").distinct())
    cells = union.groupBy("assignee", "kind", "priority").agg(F.avg("days").alias("mean"))
    mean = F.coalesce("mean", "overall")
    return grid.join(cells, ["assignee", "kind", "priority"], "left").crossJoin(F.broadcast(overall)).select("assignee", "kind", "priority", (mean if digits is None else F.round(mean, digits)).alias("mean"))


def velocity_pair(union: DataFrame) -> DataFrame:
    """Backlog and execution mean per assignee, outer."""
    mean = lambda k: union.filter(c("kind") == k).groupBy("assignee").agg(F.round(F.avg("days"), 6).alias(k))
    return mean("backlog").join(mean("execution"), "assignee", "full_outer")


def backlog_complexity(issues: DataFrame, union: DataFrame) -> DataFrame:
    """Per assignee: gap of the two velocities, harmonic estimate of the open backlog and the load bucket of the gap.

    The velocities are means over the completed grid of ``complete_grid``; assignees without one get the mean of all assignees. The grid is not
    made: a cell without rows counts as the overall mean, so sums over the cells that have rows and the number of priorities are enough.
    """
    counts = issues.filter("status in ('Backlog', 'To Do')").groupBy(owner().alias("assignee")).agg(F.count("*").alias("open"))
    cells = union.groupBy("assignee", "kind", "priority").agg(F.sum("days").alias("total"), F.count("*").alias("n"))
    kinds = ("backlog", "execution")
    of = lambda k, x: F.when(c("kind") == k, x)
    own = cells.groupBy("assignee").agg(*[f(of(k, x)).alias(f"{k}_{n}") for k in kinds for n, f, x in (("sum", F.sum, c("total") / c("n")), ("cells", F.count, c("n")))])
    every = cells.agg((F.sum("total") / F.sum("n")).alias("overall"), F.countDistinct("priority").alias("priorities"))
    mean = lambda k: (F.coalesce(f"{k}_sum", F.lit(0.0)) + (c("priorities") - c(f"{k}_cells")) * c("overall")) / c("priorities")
    pairs = own.crossJoin(F.broadcast(every)).select("assignee", *[mean(k).alias(k) for k in kinds])
    overall = pairs.agg(*[F.coalesce(F.avg(k), F.lit(0.0)).alias("all_" + k) for k in kinds])
    rows = counts.join(pairs, "assignee", "left").crossJoin(F.broadcast(overall))
    execution, backlog = F.coalesce("execution", "all_execution"), F.coalesce("backlog", "all_backlog")
    gap = F.round(F.abs(execution - backlog), 6)
    return rows.select("assignee", "open", gap.alias("complexity"), F.round(S.harmonic_estimate(execution, c("open")), 6).alias("estimate"), S.load_bucket(gap).alias("bucket"))


def five_numbers(rows: DataFrame, by: str, x: Column) -> DataFrame:
    at = dict(zip(("low", "q1", "median", "q3", "high"), (0.0, 0.25, 0.5, 0.75, 1.0), strict=True))
    return quantiles(rows.filter(c(by).isNotNull()), [by], x, at).select(by, *[F.round(n, 6).alias(n) for n in at])


RISKS = ("Overdue", "Due in 7 Days", "On Track", "No Target Date")


def risk_report(rows: DataFrame, p: Params, urgent: tuple[str, ...]) -> DataFrame:
    """n, overdue, due soon and urgent issues of all, by lead and by assignee (blocked and validating reports). ``urgent``: priorities as they stand in the records."""
    risk = rows.select(c("business_lead").alias("lead"), c("assignee_name").alias("assignee"), S.due_risk_bucket(S.days_left(c("target_end_date"), p)).alias("risk"), c("priority_name").isin(*urgent).alias("urgent"))
    counts = [F.count("*").alias("n"), F.count_if(c("risk") == "Overdue").alias("overdue"), F.count_if(c("risk") == "Due in 7 Days").alias("due_soon"), F.count_if("urgent").alias("urgent")]
    return grains(risk, {"all": [], "lead": ["lead"], "assignee": ["assignee"]}, *counts)


def risk_mix(rows: DataFrame, p: Params) -> DataFrame:
    """Issues by risk, zeros included."""
    return on_spine(rows.groupBy(S.due_risk_bucket(S.days_left(c("target_end_date"), p)).alias("risk")).agg(F.count("*").alias("n")), RISKS, "risk")


def personal_kpis(issues: DataFrame, p: Params) -> DataFrame:
    """Conditional counts and ages for every assignee; open is everything that is not Done."""
    status, priority = S.normalize_text(c("status")), S.normalize_text(c("priority_name"))
    open_, left, age = status != "done", S.days_left(c("target_end_date"), p), S.age_days(c("created"), p)
    n = lambda x, name: F.count_if(x).alias(name)
    at = lambda s: n(status == s, s.replace(" ", "_"))
    return issues.filter("assignee_name is not null").groupBy("assignee_name").agg(
        F.count("*").alias("total"), n(open_, "open"), at("done"), at("in progress"), at("on hold"), at("blocked"), at("validating"), n(open_ & (left < 0), "overdue"), n(open_ & left.between(0, 7), "due_soon"),
        n(open_ & c("target_end_date").isNull(), "missing_target"), n(open_ & priority.isin("critical", "urgent", "high"), "high_priority"), at("triage"), n(status == "tech discovery required", "tech_discovery"),
        F.round(F.avg(age), 6).alias("mean_age"), F.max(age).alias("max_age"),
    )


def pivot_counts(rows: DataFrame, by: list[str], column: str, values: Sequence[str]) -> DataFrame:
    """One column per listed value (no extra job to find the values), 0 filled."""
    return rows.groupBy(*by).pivot(column, list(values)).agg(F.count(F.lit(1))).fillna(0)


def size_groups(issues: DataFrame) -> DataFrame:
    """Issues in progress and in the backlog, without Features, with group, normalised size and priority."""
    text = lambda x: F.lower(F.trim(F.coalesce(x, F.lit(""))))
    group = F.when(text("status") == "in progress", "In Progress").when(text("status").isin(*SIZE_BACKLOG), "Backlog")
    rows = issues.filter(text("issuetype") != "feature").withColumn("group", group).filter("group is not null")
    return rows.withColumns({"size": S.normalize_size(c("estimated_size_name")), "priority": S.canonical_priority(c("priority_name"), "velocity")})


def size_matrix(groups: DataFrame) -> DataFrame:
    """priority, size, n, at_risk of all priorities and estimated sizes, zeros included."""
    sizes = [x for x in SIZES if x != "Unestimated"]
    counted = pivot_counts(groups.filter(c("size").isin(*sizes)), ["priority"], "size", sizes)
    spine = groups.sparkSession.createDataFrame([(x,) for x in PRIORITIES], "priority string")
    rows = spine.join(counted, "priority", "left").fillna(0).unpivot("priority", sizes, "size", "n")
    return rows.withColumn("at_risk", c("priority").isin("Urgent", "High") & c("size").isin("Large", "XL"))


def age_by_status(issues: DataFrame, p: Params) -> DataFrame:
    """Ages of open issues by status with a risk band, and their whole median and 75th percentile over all. Ages are whole days, few different values, so Spark's percentile holds few."""
    rows = issues.filter(~F.coalesce(c("status").isin(*AGE_EXCLUDED), F.lit(False))).select("status", S.age_days(c("created"), p).alias("age")).dropna()
    rank = lambda q: F.percentile("age", q)
    out = grains(rows, {"status": ["status"], "all": []}, F.count("*").alias("n"), F.round(F.avg("age"), 6).alias("mean"), F.max("age").alias("max"), rank(0.5).alias("median"), rank(0.75).alias("p75"))
    out = out.filter((c("grain") == "all") | ~c("status").isin(*AGE_EXCLUDED_BY_STATUS))
    whole = lambda x: F.when(c("grain") == "all", F.floor(x).cast("double")).otherwise(c(x))
    return out.withColumns({"median": whole("median"), "p75": whole("p75")}).withColumn("band", S.age_risk_band(c("median")))


def lead_months(issues: DataFrame, p: Params) -> DataFrame:
    """business_lead, month, priority of issues by month of creation; change requests belong to one lead; priorities as they stand."""
    lead = F.when(c("key").contains(p.change_project + "-"), p.change_lead).otherwise(F.trim(F.coalesce("business_lead", F.lit("Unassigned"))))
    return issues.select(lead.alias("business_lead"), F.date_format("created", "yyyy-MM").alias("month"), F.coalesce("priority_name", F.lit("Unknown")).alias("priority"))


def trimmed_mean(rows: DataFrame, by: str | None, x: str) -> DataFrame:
    """Mean within the 5th and 95th percentile; the median under five values. ``by`` None: one row for all."""
    keys = [] if by is None else [by]
    own = rows.filter(c(x).isNotNull()).select(c(x).alias("x")) if by is None else rows.filter(c(x).isNotNull() & c(by).isNotNull()).select(by, c(x).alias("x"))
    q = quantiles(own, keys, c("x"), {"from": 0.05, "mid": 0.5, "to": 0.95})
    cut = own.join(q, by) if keys else own.crossJoin(F.broadcast(q))
    inner = F.avg(F.when(c("x").between(c("from"), c("to")), c("x")))
    return cut.groupBy(*keys).agg(F.round(F.when(F.first("n") < 5, F.first("mid")).otherwise(F.coalesce(inner, F.first("mid"))), 6).alias("trimmed"))


def smoothed_mean(rows: DataFrame, by: str, x: str, prior: DataFrame | None = None, weight: float = 8.0) -> DataFrame:
    """(sum + prior * weight) / (n + weight). prior: one row and column; by default the plain mean, as for rates."""
    prior = rows.agg(F.avg(x)) if prior is None else prior
    per = rows.filter(c(by).isNotNull()).groupBy(by).agg(F.sum(x).alias("total"), F.count(x).alias("n"))
    return per.crossJoin(F.broadcast(prior.toDF("prior"))).select(by, F.round((c("total") + c("prior") * weight) / (c("n") + weight), 6).alias("smoothed"))


def leave_one_out(rows: DataFrame, by: str, x: str, weight: float = 8.0) -> DataFrame:
    """rows with ``loo``: the smoothed mean of the group's other rows. Sums by group are joined back, so no group meets in a window."""
    sums = rows.groupBy(c(by).alias("group_key")).agg(F.sum(x).alias("group_sum"), F.count(x).alias("group_n"))
    out = rows.join(sums, c(by).eqNullSafe(c("group_key"))).crossJoin(F.broadcast(rows.agg(F.avg(x).alias("overall"))))
    loo = (c("group_sum") - c(x) + c("overall") * weight) / (F.greatest(c("group_n") - 1, F.lit(0)) + weight)
    return out.withColumn("loo", F.round(loo, 6)).drop("overall", "group_key", "group_sum", "group_n")


def numbered(rows: DataFrame, coarse: Sequence[Column], order: Sequence[Column], name: str = "place") -> DataFrame:
    """rows with their number from 1 in ascending order of ``coarse``, nulls first, then ``order``.

    Rows are numbered within each coarse value (a day, say), and only the counts of these values meet in one window.
    """
    keys = [f"coarse{k}" for k in range(len(coarse))]
    own = rows.withColumns(dict(zip(keys, coarse, strict=True)))
    before = F.sum("count").over(Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1))
    starts = own.groupBy(*keys).count().select(*[c(k).alias("of_" + k) for k in keys], F.coalesce(before, F.lit(0)).alias("coarse_start"))
    same = [c(k).eqNullSafe(c("of_" + k)) for k in keys]
    place = (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) + c("coarse_start")).cast("int")
    return own.join(starts, same).withColumn(name, place).drop(*keys, *("of_" + k for k in keys), "coarse_start")


def centred_mean(rows: DataFrame, place: str, x: str, reach: int = 3) -> DataFrame:
    """rows with ``rolling``: the mean of x over the places up to ``reach`` away, in percent. Each value is sent to its neighbours' places."""
    near = rows.select(F.explode(F.sequence(c(place) - reach, c(place) + reach)).alias(place), x).groupBy(place).agg((F.avg(x) * 100).alias("rolling"))
    return rows.join(near, place)
