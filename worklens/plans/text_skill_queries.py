"""Queries on words, sentiment and skills."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklens.functions import scalars as S
from worklens.functions.params import DEFAULT as P, DELIVERY_TYPES, WIP
from worklens.operators import reports as R, skills as K, text as T
from worklens.plans.flow_queries import CAPACITY_SQL, CUR, DONE, MV, ROSTER, SPARE, VF, capacity, spare_capacity
from worklens.plans.registry import query

c = F.col
stop_sql = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
TOK = f"SELECT doc_id, month, word FROM (SELECT doc_id, month, unnest(regexp_extract_all(lower(text), '[a-zA-Z][a-zA-Z'']+')) AS word FROM w_texts) WHERE length(word) > 2 AND word NOT IN ({stop_sql})"
LEX = "SELECT DISTINCT word, CAST(length(word) % 5 - 2 AS INT) AS valence FROM tok"


def tokens(t):
    return T.tokens(t.texts, t.spark.createDataFrame([(w,) for w in T.STOP_WORDS], "word string"))


def lexicon(t):
    return tokens(t).select("word").distinct().withColumn("valence", F.length("word") % 5 - 2)


query("tokenize", tokens, "SELECT * FROM tok", tok=TOK)
TW = "SELECT word, count(*) AS n FROM tok GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {n}"
query("word_frequency", lambda t: T.top_words(tokens(t), 15), "SELECT word, n, round(n * 100.0 / sum(n) OVER (), 1)::DOUBLE AS share FROM tw", tok=TOK, tw=TW.format(n=15))
query("top_words", lambda t: T.top_words(tokens(t), 180).select("word", "n"), "SELECT * FROM tw", tok=TOK, tw=TW.format(n=180))
SE = "SELECT doc_id, CAST(sum(valence) AS DOUBLE) AS s FROM tok JOIN lex USING (word) GROUP BY 1"
query(
    "lexicon_sentiment",
    lambda t: T.sentiment(tokens(t), lexicon(t), "doc_id"),
    "SELECT doc_id, round(s / sqrt(s * s + 15), 6) AS compound, CASE WHEN s / sqrt(s * s + 15) >= 0.05 THEN 'Positive' WHEN s / sqrt(s * s + 15) <= -0.05 THEN 'Negative' ELSE 'Neutral' END AS bucket FROM se",
    tok=TOK, lex=LEX, se=SE,
)
query(
    "sentiment_mix",
    lambda t: R.on_spine(T.sentiment(tokens(t), lexicon(t), "doc_id").groupBy("bucket").agg(F.count("*").alias("n")), ("Positive", "Neutral", "Negative"), "bucket"),
    "SELECT b.bucket, coalesce(n, 0) AS n FROM (VALUES ('Positive'), ('Neutral'), ('Negative')) b(bucket) LEFT JOIN (SELECT CASE WHEN s / sqrt(s * s + 15) >= 0.05 THEN 'Positive' WHEN s / sqrt(s * s + 15) <= -0.05 THEN 'Negative' ELSE 'Neutral' END AS bucket, count(*) AS n FROM se GROUP BY 1) x ON x.bucket = b.bucket",
    tok=TOK, lex=LEX, se=SE,
)
query("word_valence_tier", lambda t: lexicon(t).select("word", S.valence_tier(c("valence")).alias("tier")), "SELECT word, CASE WHEN valence >= 1.5 THEN 'very positive' WHEN valence > 0 THEN 'positive' WHEN valence <= -1.5 THEN 'very negative' WHEN valence < 0 THEN 'negative' ELSE 'neutral' END AS tier FROM lex", tok=TOK, lex=LEX)
query("text_source_choice", lambda t: T.text_source(t.issues.withColumn("description", F.when(c("id") % 3 == 0, F.lit(" ")).when(c("id") % 3 == 1, c("creator_name")))).select("key", "text"), "SELECT key, CASE WHEN id % 3 = 1 THEN creator_name ELSE summary END AS text FROM w_issues")
query("distinct_months", lambda t: t.texts.select("month").distinct(), "SELECT DISTINCT month FROM w_texts")

DP = "SELECT * FROM (VALUES " + ", ".join(f"('{d}', '{p}')" for d, p in K.DOMAIN_PATTERNS) + ") v(domain, pattern)"
LN = "SELECT id, author, project_path AS line FROM w_mrs UNION ALL SELECT id, author, path FROM w_mrs JOIN w_mr_files ON mr_id = id"
TG = "SELECT DISTINCT id, author, domain FROM ln JOIN dp ON regexp_matches(line, pattern, 'i')"
CT = "SELECT author AS engineer, domain, count(*) AS n FROM tg GROUP BY 1, 2"
rules = lambda t: K.patterns()
tagged = lambda t: K.mr_domains(t.mrs, t.mr_files, rules(t))
MR = {"dp": DP, "ln": LN, "tg": TG, "ct": CT}
query("mr_file_join", lambda t: K.mr_lines(t.mrs, t.mr_files).groupBy("id").agg(F.count("*").alias("lines")), "SELECT id, count(*) AS lines FROM ln GROUP BY 1", ln=LN)
query("regex_theta_join", lambda t: K.regex_join(K.mr_lines(t.mrs, t.mr_files), "line", rules(t)), "SELECT DISTINCT line, domain FROM ln JOIN dp ON regexp_matches(line, pattern, 'i')", dp=DP, ln=LN)
query("domain_tags", tagged, "SELECT * FROM tg", **MR)
query("mr_domain_counts", lambda t: K.domain_counts(tagged(t)), "SELECT * FROM ct", **MR)
query(
    "quality_coverage",
    lambda t: t.mrs.select("id").join(tagged(t).groupBy("id").agg(F.count("*").alias("n")), "id", "left").agg(F.round(F.avg(F.when(c("n") > 0, 100.0).otherwise(0.0)), 6).alias("tagged_pct"), F.round(F.avg(F.coalesce("n", F.lit(0))), 6).alias("domains")),
    "SELECT round(avg(CASE WHEN n > 0 THEN 100.0 ELSE 0.0 END), 6) AS tagged_pct, round(avg(coalesce(n, 0)), 6) AS domains FROM w_mrs LEFT JOIN (SELECT id AS i, count(*) AS n FROM tg GROUP BY 1) x ON x.i = w_mrs.id",
    **MR,
)
query(
    "mr_filter_merged",
    lambda t: t.mrs.filter(c("merged_at").isNotNull() & (c("merged_at") >= P.now() - F.expr("INTERVAL '180' DAY"))).join(F.broadcast(t.spark.createDataFrame([(x,) for x in P.team], "author string")), "author", "left_semi").select("id", "author", "merged_at"),
    "SELECT id, author, merged_at FROM w_mrs WHERE merged_at >= TIMESTAMP '2001-09-15 12:00:00' - INTERVAL 180 DAY AND author IN (" + ", ".join(f"'{x}'" for x in P.team) + ")",
)
def titled(t):
    """Issues whose titles name the project of the merge request of their number, in five of eight cases; else they say nothing that a pattern knows."""
    named = t.mrs.select("id", "project_path")
    return t.issues.join(named, "id", "left").withColumn("summary", F.when(c("id") % 8 < 5, F.concat_ws(" ", "summary", "project_path")).otherwise(c("summary")))


TI = "SELECT i.* EXCLUDE (summary), CASE WHEN i.id % 8 < 5 THEN concat_ws(' ', summary, project_path) ELSE summary END AS summary FROM w_issues i LEFT JOIN w_mrs m ON m.id = i.id"
types_sql, wip_sql = (", ".join(f"'{s}'" for s in x) for x in (DELIVERY_TYPES, WIP))
CO = f"SELECT assignee_name AS engineer, summary, CASE WHEN status_category = 'done' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS weight FROM ti WHERE issuetype IN ({types_sql}) AND assignee_name IS NOT NULL AND ((status_category = 'done' AND status <> 'Will Not Do') OR status IN ({wip_sql}))"
CS = "SELECT engineer, domain, sum(weight) AS score FROM co JOIN (SELECT s, domain FROM (SELECT DISTINCT summary AS s FROM co) x JOIN dp ON regexp_matches(s, pattern, 'i')) y ON y.s = co.summary GROUP BY 1, 2"
SK = "SELECT engineer, domain, sum(score) AS score FROM (SELECT engineer, domain, score FROM cs UNION ALL SELECT engineer, domain, CAST(n AS DOUBLE) FROM ct) GROUP BY 1, 2"
RG = "SELECT sk.engineer, domain, score, coalesce(spare, 0) AS spare, CAST(row_number() OVER (PARTITION BY domain ORDER BY score DESC, coalesce(spare, 0) DESC, sk.engineer) AS INT) AS place FROM sk LEFT JOIN se ON se.engineer = sk.engineer"
SE_SPARE = f"SELECT name AS engineer, spare FROM ({SPARE})"
CAPACITY = {"ro": ROSTER, "dn": DONE, "mv": MV, "cur": CUR, "vf": VF}
SKILLS = MR | CAPACITY | {"ti": TI, "co": CO, "cs": CS, "sk": SK, "se": SE_SPARE, "rg": RG}
corpus = lambda t: K.corpus_scores(titled(t), rules(t))
matrix = lambda t: K.skill_matrix(corpus(t), K.domain_counts(tagged(t)))
spare = lambda t: spare_capacity(t).withColumnRenamed("name", "engineer")
ranking = lambda t: K.domain_ranking(matrix(t), spare(t))
query("corpus_domain_score", corpus, "SELECT * FROM cs", **SKILLS)
query("skill_matrix", matrix, "SELECT * FROM sk", **SKILLS)
query("domain_ranking", ranking, "SELECT * FROM rg", **SKILLS)
over = lambda t: t.spark.createDataFrame([("BigQuery/Data", "Engineer 4", 1), ("BigQuery/Data", "Engineer 2", 2)], "domain string, engineer string, place int")
added = lambda t: t.spark.createDataFrame([("BigQuery/Data", "Engineer 9"), ("IAM/RBAC", "Guest")], "domain string, engineer string")
AO = "SELECT domain, engineer, place FROM rg WHERE domain <> 'BigQuery/Data' UNION ALL SELECT * FROM (VALUES ('BigQuery/Data', 'Engineer 4', 1), ('BigQuery/Data', 'Engineer 2', 2), ('BigQuery/Data', 'Engineer 9', 3)) UNION ALL SELECT 'IAM/RBAC', 'Guest', CAST(max(place) + 1 AS INT) FROM rg WHERE domain = 'IAM/RBAC'"
query("apply_overrides", lambda t: K.apply_overrides(ranking(t), over(t), added(t)), "SELECT domain, engineer, CAST(place AS INT) AS place FROM ao", **SKILLS, ao=AO)
PRIMARY = "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(summary, '{p}', 'i') THEN '{d}' END" for d, p in K.DOMAIN_PATTERNS) + ")"
_pick = lambda k, n: f"CASE WHEN domain IS NULL THEN (SELECT engineer FROM fr WHERE place = {k}) ELSE (SELECT engineer FROM rg WHERE rg.domain = d.domain AND rg.place = {k}) END AS {n}"
query(
    "ticket_to_skill",
    lambda t: K.ticket_to_skill(titled(t).filter("assignee_name is null").select("key", "summary"), ranking(t), spare(t), rules(t)),
    f"SELECT key, domain, {_pick(1, 'expert')}, {_pick(2, 'runner_up')}, {_pick(3, 'stretch')} FROM (SELECT key, {PRIMARY} AS domain FROM ti WHERE assignee_name IS NULL) d",
    **SKILLS,
    fr="SELECT engineer, row_number() OVER (ORDER BY spare DESC, engineer) AS place FROM se",
)


def intake_report(t):
    """The four parts with their fields as text, under one another."""
    parts = K.intake(titled(t), capacity(t), K.domain_counts(tagged(t)))
    shown = {"roster": ("name", "velocity", "wip", "done"), "queue": ("key", "created", "status", "issuetype", "priority_name", "reporter", "assigned", "summary"), "corpus": ("engineer", "summary", "weight"), "mr_domains": ("engineer", "domain", "n")}
    text = lambda rows, fields: F.concat_ws("|", *[F.coalesce(c(x).cast("string"), F.lit("-")) for x in fields])
    return reduce(DataFrame.unionAll, [rows.select(F.lit(name).alias("part"), text(rows, shown[name]).alias("item")) for name, rows in parts.items()])


_text = lambda *fields: " || '|' || ".join(f"coalesce(CAST({x} AS VARCHAR), '-')" for x in fields)
query(
    "intake_report",
    intake_report,
    f"""SELECT 'roster' AS part, {_text('name', 'velocity', 'wip', 'done')} AS item FROM cp UNION ALL SELECT 'queue', {_text('key', 'CAST(created AS DATE)', 'status', 'issuetype', 'priority_name', 'creator_name', "CASE WHEN assignee_name IN (SELECT name FROM ro) THEN lower(assignee_name) ELSE 'ext:' || assignee_name END", 'summary')}
 FROM ti WHERE status IN ('Triage', 'Reviewing') AND issuetype NOT IN ('Feature', 'Initiative', 'Epic') UNION ALL SELECT 'corpus', {_text('engineer', 'summary', 'weight')} FROM co WHERE engineer IN (SELECT name FROM ro)
 UNION ALL SELECT 'mr_domains', {_text('engineer', 'domain', 'n')} FROM ct WHERE engineer IN (SELECT name FROM ro)""",
    **SKILLS,
    cp=CAPACITY_SQL,
)
