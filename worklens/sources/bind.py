"""Work-item views over the sample tables: issues, status transitions, merge requests and their files, texts.

The SELECTs run unchanged in Spark and in DuckDB.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Status changes before they are numbered within their key by (changed_at, ln, pk, sk).
CHANGES = """ SELECT CASE WHEN l_orderkey % 10 = 9 THEN 'CAR-' ELSE 'OPS-' END || CAST(l_orderkey AS VARCHAR(20)) AS key,
  CASE WHEN (l_linenumber + l_partkey) % 4 = 0 THEN 'Done' WHEN l_partkey % 5 = 0 THEN 'In Progress' WHEN l_partkey % 5 = 1 THEN 'Blocked'
       WHEN l_partkey % 5 = 2 THEN 'Validating' WHEN l_partkey % 5 = 3 THEN 'On Hold' ELSE 'To Do' END AS to_status,
  o_orderdate + INTERVAL '1' HOUR * (l_orderkey % 24 + l_linenumber * 96 + l_partkey % 90) AS changed_at,
  l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk
 FROM lineitem JOIN orders ON o_orderkey = l_orderkey"""
VIEWS = {
    "w_issues": """
SELECT CASE WHEN o_orderkey % 10 = 9 THEN 'CAR-' ELSE 'OPS-' END || CAST(o_orderkey AS VARCHAR(20)) AS key,
 o_orderkey AS id,
 CASE WHEN o_orderkey % 10 = 9 THEN 'Release Management' ELSE 'DevOps' END AS project_name,
 CASE WHEN o_orderkey % 500 = 1 THEN 'Initiative' WHEN o_orderkey % 25 = 0 THEN 'Feature'
      WHEN o_orderkey % 5 = 1 THEN 'Story' WHEN o_orderkey % 5 = 2 THEN 'Task' WHEN o_orderkey % 5 = 3 THEN 'Bug'
      WHEN o_orderkey % 5 = 4 THEN 'Hotfix' ELSE 'Sub-task' END AS issuetype,
 CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 11 = 0 THEN 'Will Not Do' ELSE 'Done' END
      WHEN o_orderstatus = 'P' THEN CASE o_orderkey % 5 WHEN 0 THEN 'Staged CAR' WHEN 1 THEN 'Validating' WHEN 2 THEN 'Blocked' WHEN 3 THEN 'On Hold' ELSE 'In Progress' END
      ELSE CASE o_orderkey % 5 WHEN 0 THEN 'Backlog' WHEN 1 THEN 'Triage' WHEN 2 THEN 'Reviewing' WHEN 3 THEN 'To Do' ELSE 'Tech Discovery Required' END END AS status,
 CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'indeterminate' ELSE 'new' END AS status_category,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'Urgent' WHEN '2-HIGH' THEN 'High' WHEN '3-MEDIUM' THEN 'Medium' WHEN '5-LOW' THEN 'Low' ELSE 'No Priority' END AS priority_name,
 p_name || ' ' || lower(p_type) AS summary,
 CASE WHEN o_custkey % 15 = 14 THEN NULL ELSE 'Engineer ' || CAST(o_custkey % 15 AS VARCHAR(20)) END AS assignee_name,
 c_name AS creator_name, c_mktsegment AS business_lead,
 CASE WHEN o_orderkey % 25 = 0 THEN 'OPS-' || CAST(CAST(floor(o_orderkey / 500.0) AS BIGINT) * 500 + 1 AS VARCHAR(20))
      WHEN o_orderkey % 500 = 1 THEN NULL
      ELSE 'OPS-' || CAST(CAST(floor(o_orderkey / 25.0) AS BIGINT) * 25 AS VARCHAR(20)) END AS parent_key,
 o_orderdate + INTERVAL '1' HOUR * (o_orderkey % 24) AS created,
 o_orderdate + INTERVAL '1' HOUR * (o_orderkey % 24 + (o_orderkey * 13) % 1000) AS updated,
 CASE WHEN o_orderstatus = 'F' AND o_orderkey % 7 = 0 THEN o_orderdate + INTERVAL '1' HOUR * (o_orderkey % 24 + (o_orderkey * 13) % 1000) END AS resolved,
 CASE WHEN o_orderkey % 9 <> 0 THEN o_orderdate + INTERVAL '1' DAY * ((o_orderkey * 17) % 150) END AS target_end_date,
 CASE WHEN o_orderkey % 6 <> 0 THEN o_orderdate + INTERVAL '1' DAY * ((o_orderkey * 7) % 40 - 5) END AS planned_start_date,
 CASE o_orderkey % 6 WHEN 0 THEN 'Small' WHEN 1 THEN 'Medium' WHEN 2 THEN 'Large' WHEN 3 THEN 'XL' WHEN 4 THEN 'Huge' END AS estimated_size_name
FROM orders JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = o_orderkey % 200""",
    "w_transitions": f"""
SELECT key, to_status, changed_at, CAST(row_number() OVER (PARTITION BY key ORDER BY changed_at, ln, pk, sk) - 1 AS INT) AS seq FROM (
{CHANGES}) x""",
    "w_mrs": """
SELECT o_orderkey AS id,
 CASE o_orderkey % 6 WHEN 0 THEN 'acme/devops/eks-cluster' WHEN 1 THEN 'acme/gcp/project-factory' WHEN 2 THEN 'acme/devops/tf-network'
      WHEN 3 THEN 'acme/data/airflow' WHEN 4 THEN 'acme/web/site' ELSE 'acme/devops/grafana' END AS project_path,
 o_orderkey % 1000 AS iid, 'Engineer ' || CAST(o_custkey % 18 AS VARCHAR(20)) AS author,
 o_orderdate + INTERVAL '1' HOUR * (o_orderkey % 24) AS merged_at
FROM orders""",
    "w_mr_files": """
SELECT DISTINCT l_orderkey AS mr_id, CASE l_partkey % 8 WHEN 0 THEN 'modules/vpc/main.tf' WHEN 1 THEN 'clusters/prod/helmrelease.yaml'
 WHEN 2 THEN 'dags/daily_load.py' WHEN 3 THEN '.gitlab-ci.yml' WHEN 4 THEN 'dashboards/latency.json' WHEN 5 THEN 'sql/report.sql'
 WHEN 6 THEN 'docs/readme.md' ELSE 'iam/roles/reader.hcl' END AS path
FROM lineitem""",
    "w_texts": """
SELECT doc_id, text, '2001-' || lpad(CAST(doc_id % 8 + 1 AS VARCHAR(20)), 2, '0') AS month FROM documents WHERE text IS NOT NULL""",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")


class Tables:
    """Sample tables and views of one folder, each read when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _view(self, name: str, sql: str | None = None) -> DataFrame:
        sql = sql or VIEWS[name]
        used = {t: self.table(t) for t in TABLES if f" {t}" in sql.lower()}
        if name == "w_issues":
            # an issue's part is its key's remainder by 200, so other parts join with nothing, and few keys would hold all orders
            used["part"] = F.broadcast(used["part"].filter("p_partkey BETWEEN -199 AND 199"))
        for t in used:
            sql = sql.replace(f"FROM {t}", f"FROM {{{t}}} {t}").replace(f"JOIN {t}", f"JOIN {{{t}}} {t}")
        return self.spark.sql(sql, **used)

    @cached_property
    def issues(self) -> DataFrame:
        return self._view("w_issues")

    @cached_property
    def transitions(self) -> DataFrame:
        return self._view("w_transitions")

    @cached_property
    def logs(self) -> DataFrame:
        """id, log: the transitions of an issue in their order as an array of (changed_at, ln, pk, sk, to_status).

        A key is made of an order's key alone, so the rows meet by that: they lie together after the join of lines and orders, and neither a window nor a second exchange is needed.
        """
        changes = self._view("changes", CHANGES.replace("SELECT CASE", "SELECT o_orderkey AS id, CASE", 1))
        return changes.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("changed_at", "ln", "pk", "sk", "to_status"))).alias("log"))

    @cached_property
    def mrs(self) -> DataFrame:
        return self._view("w_mrs")

    @cached_property
    def mr_files(self) -> DataFrame:
        return self._view("w_mr_files")

    @cached_property
    def texts(self) -> DataFrame:
        return self._view("w_texts")


def with_views(sql: str, **more: str) -> str:
    """The SQL with the views it names, and further named SELECTs, as common table expressions before it."""
    named, todo, text = {}, [sql], sql
    sources = VIEWS | more
    while todo:
        text = todo.pop()
        for n in sources:
            if n in text and n not in named:
                named[n] = sources[n]
                todo.append(sources[n])
    order = [n for n in VIEWS if n in named] + [n for n in more if n in named]
    body = sql.strip()
    if not order:
        return body
    head = ",\n".join(f"{n} AS ({sources[n]})" for n in order)
    return f"WITH {head},\n{body[5:]}" if body[:5].upper() == "WITH " else f"WITH {head}\n{body}"
