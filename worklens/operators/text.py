"""Word counts and lexicon sentiment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from worklens.functions import scalars as S

c = F.col
#: Words that are left out by default.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "have", "had", "he", "her", "hers", "him", "his", "i", "in", "is", "it", "its", "me", "my", "of", "on", "or", "our", "ours",
    "she", "that", "the", "their", "them", "there", "these", "they", "this", "to", "was", "we", "were", "will", "with", "you", "your",
    "ticket", "issue", "jira", "done", "need", "please", "thanks", "thank", "update", "updated", "work", "task", "story", "project", "deploy", "deployment", "error", "errors", "fix", "fixed",
)


def tokens(texts: DataFrame, stop: DataFrame, text: str = "text") -> DataFrame:
    """A row for each word of more than two letters that is no stop word; all other columns but the text stay."""
    rest = [x for x in texts.columns if x != text]
    words = texts.select(*rest, F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"[a-zA-Z][a-zA-Z']+"), F.lit(0))).alias("word"))
    return words.filter(F.length("word") > 2).join(F.broadcast(stop), "word", "left_anti")


def top_words(words: DataFrame, n: int) -> DataFrame:
    """The n most frequent words, ties by word, with their share of the counts shown, in percent."""
    top = words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(n)
    return top.withColumn("share", F.round(c("n") / F.sum("n").over(Window.partitionBy()) * 100, 1))


def sentiment(words: DataFrame, lexicon: DataFrame, by: str) -> DataFrame:
    """Per text: sum of valences, compound s / sqrt(s^2 + 15), bucket. Texts without a word of the lexicon score 0."""
    s = words.join(lexicon, "word", "left").groupBy(by).agg(F.coalesce(F.sum("valence"), F.lit(0)).cast("double").alias("s"))
    compound = c("s") / F.sqrt(c("s") * c("s") + 15)
    return s.select(by, F.round(compound, 6).alias("compound"), S.sentiment_bucket(compound).alias("bucket"))


def text_source(df: DataFrame, candidates: tuple[str, ...] = ("comments", "description", "summary")) -> DataFrame:
    """``text``: the first of the columns that exists and is not blank."""
    have = [F.nullif(F.trim(x), F.lit("")) for x in candidates if x in df.columns]
    return df.withColumn("text", F.coalesce(*have, F.lit("")))
