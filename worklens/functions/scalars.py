"""Column functions of the reports: time arithmetic, labels, buckets. Rounding and flooring flavours are written once, here."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklens.functions.params import CLOSED_STATUSES, PRIORITY_MAP, Params, SIZES, SLA_DAYS

DAY = 86_400_000_000


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def days_between(start: Column, end: Column) -> Column:
    """Days as double."""
    return (micros(end) - micros(start)) / F.lit(float(DAY))


def floor_days(start: Column, end: Column) -> Column:
    """Whole days, towards minus infinity."""
    return F.floor(days_between(start, end)).cast("long")


def age_days(start: Column, p: Params) -> Column:
    return F.greatest(F.lit(0).cast("long"), floor_days(start, p.now()))


def to_zone(ts: Column, zone: str) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)


def business_month(ts: Column, p: Params) -> Column:
    return F.date_format(to_zone(ts, p.business_tz), "yyyy-MM")


def size_ordinal(size: Column) -> Column:
    out = F.lit(0)
    for n, s in reversed(list(enumerate(SIZES[:4], 1))):
        out = F.when(size == s, n).otherwise(out)
    return out


def normalize_size(size: Column) -> Column:
    t = F.trim(size)
    return F.when(t.isin(*SIZES[:4]), t).otherwise(SIZES[4])


def normalize_text(text: Column) -> Column:
    return F.lower(F.trim(F.translate(text, "_-", "  ")))


def normalize_label(text: Column, default: str) -> Column:
    return F.coalesce(F.nullif(F.trim(text), F.lit("")), F.lit(default))


def canonical_priority(raw: Column, profile: str) -> Column:
    pairs: Mapping[str, str] = {r: c for p, r, c in PRIORITY_MAP if p == profile}
    lookup = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    text = F.lower(F.trim(raw))
    return F.coalesce(F.element_at(lookup, F.replace(text, F.lit(" "), F.lit("")) if profile == "sla" else text), F.lit("None"))


def rank_in(value: Column, order: Sequence[str]) -> Column:
    """1-based place in the list, else one more than its length."""
    at = F.array_position(F.array(*map(F.lit, order)), value)
    return F.when(F.coalesce(at, F.lit(0)) > 0, at).otherwise(len(order) + 1).cast("int")


def resolve_column(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """First candidate that is a column, else the first column that a candidate's normalised name is part of."""
    have = {c: "".join(ch for ch in c.lower() if ch.isalnum()) for c in df.columns}
    for c in candidates:
        if c in have:
            return c
    for c in candidates:
        wanted = "".join(ch for ch in c.lower() if ch.isalnum())
        for name, plain in have.items():
            if wanted and wanted in plain:
                return name
    return None


def month_label(month: Column, year: Column, month_number: Column, created: Column) -> Column:
    made = F.when(year.isNotNull() & month_number.isNotNull(), F.concat_ws("-", year.cast("string"), F.lpad(month_number.cast("string"), 2, "0")))
    return F.coalesce(month, made, F.date_format(created, "yyyy-MM"))


def days_left(target: Column, p: Params) -> Column:
    return F.datediff(target, p.now())


def sla_target(target: Column, priority: Column) -> Column:
    lookup = F.create_map(*[x for k, v in SLA_DAYS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.when(target > 0, target), F.element_at(lookup, priority), F.lit(90.0))


def risk_score(elapsed: Column, target: Column, closed: Column) -> Column:
    open_ = 1 / (1 + F.exp(-(elapsed / target - 0.82) * 10))
    return F.when(closed, F.when(elapsed > target, 1.0).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), open_)))


def schedule_adherence(days_late: Column) -> Column:
    return F.when(days_late.isNull(), F.lit(None)).when(days_late <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - days_late / 7))


def recency_weight(days: Column) -> Column:
    return 1 / (1 + days / 30.0)


#: Up to here the harmonic number is summed, beyond it the expansion is exact to double precision.
HARMONIC_SUMMED = 200


def harmonic_estimate(average: Column, n: Column) -> Column:
    """average * (1 + 1/2 + ... + 1/n)."""
    x = n.cast("double")
    far = F.log(x) + 0.5772156649015329 + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * F.pow(x, F.lit(4.0)))
    near = F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(HARMONIC_SUMMED)).cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / i)
    return average * F.when(n <= 0, 0.0).when(n <= HARMONIC_SUMMED, near).otherwise(far)


def business_days_elapsed(day: Column) -> Column:
    """Weekdays from the first to this day of its month, as a part of the month's weekdays."""
    first = F.trunc(day, "month")
    weekdays = lambda end: F.size(F.filter(F.sequence(first, end), lambda d: F.weekday(d) < 5))
    return weekdays(day) / weekdays(F.last_day(day))


def percent_change(new: Column, old: Column) -> Column:
    x = (new - old) / F.nullif(old, F.lit(0).cast("double")) * 100
    return F.when(F.abs(x) < 10, F.round(x, 1)).otherwise(F.round(x, 0))


def is_closed(status: Column, resolved: Column) -> Column:
    return F.coalesce(F.lower(status).isin(*CLOSED_STATUSES), F.lit(False)) | resolved.isNotNull()


def sla_status(elapsed: Column, target: Column, closed: Column) -> Column:
    """What is closed is breached or on track; only open issues can be at risk."""
    unknown = elapsed.isNull() | target.isNull() | (target <= 0)
    return F.when(unknown, "Unknown").when(elapsed > target, "Breached").when(~closed & (elapsed >= 0.8 * target), "At Risk").otherwise("On Track")


def due_risk_bucket(left: Column) -> Column:
    return F.when(left.isNull(), "No Target Date").when(left < 0, "Overdue").when(left <= 7, "Due in 7 Days").otherwise("On Track")


def target_timeline_bucket(left: Column) -> Column:
    """Every issue has a place in the timeline; those without a date are a bucket of their own."""
    return F.when(left.isNull(), "No Target Date").when(left < 0, "Overdue").when(left <= 14, "Due in 14 Days").when(left <= 30, "Due in 30 Days").otherwise("Due Later")


def load_bucket(days: Column) -> Column:
    return F.when(days > 90, "Critical").when(days > 60, "High").when(days > 30, "Medium").when(days > 0, "Low").otherwise("None")


def age_risk_band(days: Column) -> Column:
    return F.when(days >= 90, "Critical").when(days >= 60, "Aging").when(days >= 30, "Watch").otherwise("Healthy")


def sentiment_bucket(compound: Column) -> Column:
    return F.when(compound >= 0.05, "Positive").when(compound <= -0.05, "Negative").otherwise("Neutral")


def valence_tier(valence: Column) -> Column:
    return F.when(valence >= 1.5, "very positive").when(valence > 0, "positive").when(valence <= -1.5, "very negative").when(valence < 0, "negative").otherwise("neutral")


def lead_bucket(days: Column) -> Column:
    out = F.lit("91+")
    for top, name in reversed(LEAD_BUCKETS[:-1]):
        out = F.when(days <= top, name).otherwise(out)
    return out


LEAD_BUCKETS = ((3, "0-3"), (7, "4-7"), (14, "8-14"), (30, "15-30"), (60, "31-60"), (90, "61-90"), (None, "91+"))
