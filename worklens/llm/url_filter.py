"""URL rules, and a character language-model ratio where no rule fits.

Two variable-order Markov models over the lower-cased host and path are counted on the distinct URLs that rules accept and
on those that rules reject. A character is predicted from the ``order`` characters before it, smoothed by the shorter
contexts down to none: p_k(c) = (n(context, c) + S p_{k-1}(c)) / (n(context) + S), and (n(c) + 1) / (n + V) without a
context, for V different characters. A URL that no rule fits is judged by the difference of its log-likelihoods divided by
its length; the threshold is the one with the best balanced accuracy on a quarter of the rule-judged URLs, taken by hash
and kept out of the counts.

A URL is a row for each of its characters; counts are tables of distinct n-grams, joined to these rows and summed by URL,
all with SQL functions. Host and path are scored once for all pages that share them.

Defined results: null URLs and URLs without ``://`` have empty host and path, fit no rule, and score 0; if rules accept
nothing or reject nothing (outside the quarter or in it), the method allows all; repeated rows are judged alike; long URLs
are cut into overlapping pieces and count whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklens.llm.common import ascii_lower, materialise, table

#: Characters of context; weight of the shorter context, in counts; characters of a URL that are cut out of one piece.
ORDER, SMOOTHING, PIECE = 4, 4.0, 256
#: Stands before the first character.
BEGIN = "\x02"
#: (host, path, verdict)
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def split_url(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host, path = (F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", k) for k in (1, 2))
    return ascii_lower(host), path


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct (n, rule, verdict) of the longest rule that fits, else null. Rules are compiled into the expression: up to some hundreds."""
    fits = [
        F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for h, p, v in rules
    ]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<n:int,rule:string,verdict:string>")


def _grams(texts: DataFrame, order: int) -> DataFrame:
    """texts (text, ...) -> a row with ``gram`` for each character: the character behind the ``order`` before it."""
    rest = [c for c in texts.columns if c != "text"]
    padded = F.concat(F.lit(BEGIN * order), "text")
    pieces = texts.select(*rest, padded.alias("padded"), F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / PIECE).cast("int"))).alias("piece"))
    pieces = pieces.select(*rest, F.substr("padded", F.col("piece") * PIECE + 1, F.lit(PIECE + order)).alias("piece"))
    at = pieces.select(*rest, "piece", F.explode(F.sequence(F.lit(1), F.length("piece") - order)).alias("at"))
    return at.select(*rest, F.substr("piece", F.col("at"), F.lit(order + 1)).alias("gram"))


def ratio_model(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """texts (text, accepted: true, false, or null where it doesn't count) -> (gram, llr) of every n-gram in any of them: log P(c|context, accepted) - log P(c|context, rejected)."""
    one = lambda x: F.sum(F.when(F.col("accepted") == x, 1).otherwise(0)).cast("double")
    model = materialise(_grams(texts.select("text", "accepted"), order).groupBy("gram").agg(one(True).alias("a"), one(False).alias("r")), "url-grams")
    last = F.substr("gram", F.lit(order + 1), F.lit(1))
    overall = model.agg(F.sum("a").alias("all_a"), F.sum("r").alias("all_r"), F.count_distinct(last).cast("double").alias("v"))
    single = model.groupBy(last.alias("last")).agg(F.sum("a").alias("n_a"), F.sum("r").alias("n_r"))
    p0 = lambda x: ((F.col("n_" + x) + 1) / (F.col("all_" + x) + F.col("v"))).alias("p_" + x)
    single = single.crossJoin(F.broadcast(overall)).select("last", p0("a"), p0("r"))
    out = model.withColumn("last", last).join(single, "last").drop("last")
    for k in range(1, order + 1):
        context, with_char = F.substr("gram", F.lit(order + 1 - k), F.lit(k)), F.substr("gram", F.lit(order + 1 - k), F.lit(k + 1))
        before = model.groupBy(context.alias("context")).agg(F.sum("a").alias("c_a"), F.sum("r").alias("c_r"))
        pairs = model.groupBy(with_char.alias("with_char")).agg(F.sum("a").alias("n_a"), F.sum("r").alias("n_r"))
        out = out.withColumns({"context": context, "with_char": with_char}).join(before, "context").join(pairs, "with_char")
        p = lambda x: ((F.col("n_" + x) + SMOOTHING * F.col("p_" + x)) / (F.col("c_" + x) + SMOOTHING)).alias("p_" + x)
        out = out.select("gram", "a", "r", p("a"), p("r"))
    return materialise(out.select("gram", (F.log("p_a") - F.log("p_r")).alias("llr")), "url-model")


def scores(texts: DataFrame, model: DataFrame, order: int = ORDER) -> DataFrame:
    """(key, text) -> (key, score): the mean log-likelihood difference of a character."""
    return _grams(texts.select("key", "text"), order).join(model, "gram").groupBy("key").agg(F.avg("llr").alias("score"))


def best_threshold(scored: DataFrame) -> float:
    """The score (in hundredths) that separates accepted from rejected with the best balanced accuracy, halfway down to the next lower score.

    Scores of a character are bounded by the smoothing, and with them the number of hundredths that come to the driver.
    """
    counted = scored.groupBy(F.floor(F.col("score") * 100).cast("int").alias("bin"), "accepted").count().collect()
    n = {True: 0, False: 0}
    for r in counted:
        n[r["accepted"]] += r["count"]
    if not n[True] or not n[False]:
        return float("-inf")
    kept, dropped, best, below = n[True], 0, (1.0, float("-inf")), None
    for b in sorted({r["bin"] for r in counted}):
        best = max(best, (kept / n[True] + dropped / n[False], (b if below is None else (b + below) / 2) / 100))
        kept -= sum(r["count"] for r in counted if r["bin"] == b and r["accepted"])
        dropped += sum(r["count"] for r in counted if r["bin"] == b and not r["accepted"])
        below = b
    return best[1]


def url_filter(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, order: int = ORDER) -> DataFrame:
    """page_id, host, path, rule, verdict, and the method's score of every row."""
    host, path = split_url(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    parts = parts.withColumn("fit", longest_rule(F.col("host"), F.col("path"), rules)).withColumn("key", F.xxhash64("host", "path"))
    text = F.lower(F.concat("host", "path"))
    texts = parts.select("key", text.alias("text"), (F.col("fit.verdict") == "allow").alias("accepted")).filter("text <> ''")
    texts = materialise(texts.groupBy("key").agg(F.first("text").alias("text"), F.first("accepted").alias("accepted")), "url-texts")
    held_out = F.pmod(F.xxhash64("key"), F.lit(4)) == 0
    classes = texts.filter(F.col("accepted").isNotNull() & ~held_out).select("accepted").distinct().count()
    model = ratio_model(texts.withColumn("accepted", F.when(~held_out, F.col("accepted"))), order)
    scored = materialise(scores(texts, model, order), "url-scores")
    threshold = best_threshold(scored.join(texts.filter(held_out & F.col("accepted").isNotNull()).select("key", "accepted"), "key")) if classes == 2 else float("-inf")
    judged = parts.join(scored, "key", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    method = F.when(F.col("score") >= F.lit(threshold), "allow").otherwise("block")
    return judged.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", method).alias("verdict"), F.round("score", 6).alias("score"))


def op5_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every page's URL under the fixed rules, the rest by the ratio."""
    return url_filter(table(spark, sf_dir, "pages"))
