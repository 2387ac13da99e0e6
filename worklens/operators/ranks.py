"""Exact order statistics of many groups at once, however many rows one of them has.

A wanted rank lies in an interval of values, at first the whole range of its group. Each round counts the rows of every open interval in
``bins`` parts of equal width, with partial sums in each task, and keeps the part that holds the rank, cut down to the values
that occur in it. When no interval with different values has more than ``small`` rows, what is left of it is counted by value and the rank
is read off. No group's rows meet in one task; the ranges take a pass over the rows, each round one and the last count one, and a round divides an interval's rows by up to ``bins``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from worklens.sources.ingest import shared_dir

c = F.col


def _written(rows: DataFrame) -> DataFrame:
    """A round's few rows as a table: plans don't grow with the rounds."""
    path = shared_dir(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _upto(by: list[str], order: str) -> Column:
    """Rows of the group's interval before this part."""
    before = Window.partitionBy(*by, "low").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("count").over(before), F.lit(0))


def quantiles(rows: DataFrame, by: list[str], x: Column, at: dict[str, float], *also: Column, bins: int = 4096, small: int = 50_000) -> DataFrame:
    """by..., n, and a column for each wanted quantile, interpolated between its two neighbours. Null and NaN values take no part; without ``by`` there is one row, of nulls where there is no value.

    ``also``: named aggregates over all rows of the groups, which the first pass brings along; then groups without values have a row, too.
    """
    keys = by or ["_all"]
    rows = rows if by else rows.withColumn("_all", F.lit(0))
    value = x.cast("double")
    value = F.when(~F.isnan(value), value)
    own = rows.select(*keys, value.alias("x")).filter("x is not null")
    every = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), *also)
    every = every.persist()  # a row a group; what a lost executor held is counted again
    spans = every.filter("n > 0")
    places = F.array(*[f(F.lit(q) * (c("n") - 1)).cast("long") for q in at.values() for f in (F.floor, F.ceil)])
    wanted = spans.select(*keys, "n", F.explode(F.array_distinct(places)).alias("rank"), F.lit(0).cast("long").alias("before"), "low", "high", c("n").alias("count"))
    same = lambda a, b: F.reduce(F.array(*[c(f"{a}.{k}").eqNullSafe(c(f"{b}.{k}")) for k in keys]), F.lit(True), lambda p, q: p & q)

    def inside(spans: DataFrame, kept: list[Column]) -> DataFrame:
        """The rows that lie in the groups' intervals; these are few and don't overlap."""
        return own.alias("r").join(spans.alias("s"), same("r", "s") & c("r.x").between(c("s.low"), c("s.high"))).select(*[c(f"s.{k}").alias(k) for k in keys], "s.low", *kept)

    closed, wide = [], (c("count") > small) & (c("low") < c("high"))
    while not (left := wanted.filter(wide)).isEmpty():
        closed.append(wanted.filter(~wide))
        part = F.least(F.floor((c("r.x") - c("s.low")) / (c("s.high") - c("s.low")) * bins), F.lit(bins - 1))
        counted = inside(left.select(*keys, "low", "high").distinct(), [part.alias("part"), c("r.x").alias("x")])
        parts = counted.groupBy(*keys, "low", "part").agg(F.count("*").alias("count"), F.min("x").alias("from"), F.max("x").alias("to"))
        parts = parts.select("*", _upto(keys, "part").alias("skip"))
        a, b = left.alias("a"), parts.alias("b")
        rank = c("a.rank") - c("a.before") - c("b.skip")
        found = a.join(b, same("a", "b") & (c("a.low") == c("b.low")) & (rank >= 0) & (rank < c("b.count")))
        wanted = _written(found.select(*[c(f"a.{k}").alias(k) for k in keys], "a.n", "a.rank", (c("a.before") + c("b.skip")).alias("before"), c("b.from").alias("low"), c("b.to").alias("high"), c("b.count").alias("count")))
    for more in closed:
        wanted = wanted.unionAll(more)
    values = inside(wanted.select(*keys, "low", "high").distinct(), [c("r.x").alias("x")]).groupBy(*keys, "low", "x").count()
    values = values.select("*", _upto(keys, "x").alias("skip"))
    a, b = wanted.alias("a"), values.alias("b")
    rank = c("a.rank") - c("a.before") - c("b.skip")
    read = a.join(b, same("a", "b") & (c("a.low") == c("b.low")) & (rank >= 0) & (rank < c("b.count"))).select(*[c(f"a.{k}").alias(k) for k in keys], "a.n", "a.rank", "b.x")
    of = lambda place: F.max(F.when(c("rank") == place, c("x")))
    between = {}
    for name, q in at.items():
        place = F.lit(q) * (c("n") - 1)
        low, high = of(F.floor(place).cast("long")), of(F.ceil(place).cast("long"))
        share = F.max(place - F.floor(place))
        between[name] = low * (1 - share) + high * share
    out = read.groupBy(*keys, "n").agg(*[v.alias(name) for name, v in between.items()])
    if also:
        more = [name for name in every.columns if name not in (*keys, "n", "low", "high")]
        a, b = every.alias("a"), out.alias("b")
        out = a.join(b, same("a", "b"), "left").select(*[c(f"a.{k}").alias(k) for k in keys], "a.n", *[c(f"b.{name}").alias(name) for name in at], *[c(f"a.{name}").alias(name) for name in more])
    if by:
        return out
    none = own.sparkSession.range(1).select(F.lit(0).alias("_one"))
    return none.join(out, c("_one") == c("_all"), "left").select(F.coalesce("n", F.lit(0).cast("long")).alias("n"), *[name for name in out.columns if name not in ("_all", "n")])
