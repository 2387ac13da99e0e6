"""Skill matrices from merge-request paths and ticket summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from worklens.functions.params import DELIVERY_TYPES, QUEUE, WIP

c = F.col

#: Fixed values: (domain, pattern), matched per line and in either case. Names of an organisation's own repositories are left out; add them with ``patterns(more)``.
DOMAIN_PATTERNS = (
    ("Kubernetes/GitOps", r"clusters/|namespaces/|helmrelease|kustomization|/helm/|\bk8s\b|karpenter|nodepool|nodeclass|kube-system|argocd|/flux|gitrepository|daemonset|statefulset|\bcrds?\b"),
    ("Terraform/Terragrunt", r"terragrunt\.hcl|\.tf$|\.tftpl|\.tfvars|/tf-|terraform|\.hcl$"),
    ("AWS Core", r"\baws\b|us-east-1|us-west-2|eu-west-1|\bec2\b|\bs3\b|cloudwatch|lambda|\becr\b|\brds\b|dynamodb|\bsqs\b|\bsns\b|cloudfront"),
    ("GCP Core", r"/gcp/|prj-|project-factory|landing.?zone|/folders?/|cloud-?run|/projects?/"),
    ("BigQuery/Data", r"bigquery|/bq/|\.sql$|dataflow|dataproc|looker|\bedp\b"),
    ("Grafana", r"grafana|dashboards?/|prometheus|\bloki\b|\btempo\b|alerting|servicemonitor|scrape"),
    ("GitLab", r"\.gitlab-ci|/\.gitlab/|(^|/)ci/|\bpipeline"),
    ("IAM/RBAC", r"\biam\b|/rbac|service-?account|workload-?identity|/roles?/|policies?/|clusterrole|\bsso\b|okta"),
    ("Networking", r"\bvpc\b|subnet|/dns|networking|firewall|/network/|ingress|egress|peering|cloudflare"),
    ("Secrets/Vault", r"\bvault\b|/secrets?/|\bsops\b|sealed-?secret|external-?secret"),
    ("Databases", r"cloud-?sql|alloydb|\brds\b|postgres|mysql|\bredis\b|memorystore|/database"),
    ("Composer", r"composer"),
    ("Airflow", r"airflow|/dags?/"),
    ("Cost/FinOps", r"\bcogs\b|billing|finops|\bbudget"),
    ("Storage Transfer", r"storage-?transfer|\bsts\b"),
    ("VDI/WorkSpaces", r"workspace|\bvdi\b|gcve|vsphere|citrix"),
    ("AI Plugins", r"ai-plugins"),
    ("AWS Bedrock Agents", r"bedrock"),
    ("EKS", r"\beks\b|eks-node|eks-cluster"),
    ("ECS", r"\becs\b|fargate"),
    ("OpenSearch", r"opensearch|elasticsearch"),
    ("MSK", r"\bmsk\b|kafka"),
    ("GKE", r"\bgke\b"),
    ("VertexAI", r"vertex[\s_-]?ai|vertexai|aiplatform|\bvertex\b"),
    ("Kubeflow Pipelines", r"kubeflow|\bkfp\b"),
    ("Route53", r"route\s?53|\br53\b"),
    ("Fastly", r"fastly"),
)


Rules = tuple[tuple[str, str], ...]


def patterns(more: Rules = ()) -> Rules:
    return (*DOMAIN_PATTERNS, *more)


def matches(column: str, rules: Rules) -> list[Column]:
    """The domain of each rule where the column matches it, else null. Patterns are literals, so a task compiles each of them once."""
    return [F.when(c(column).rlike(f"(?im){pattern}"), F.lit(domain)) for domain, pattern in rules]


def regex_join(texts: DataFrame, column: str, rules: Rules) -> DataFrame:
    """Distinct (text, domain) pairs that match. Distinct texts first: paths repeat heavily."""
    distinct = texts.select(column).filter(c(column).isNotNull()).distinct()
    return distinct.select(column, F.explode(F.array_distinct(F.array_compact(F.array(*matches(column, rules))))).alias("domain"))


def mr_lines(mrs: DataFrame, files: DataFrame) -> DataFrame:
    """id, author, line: the project path and every changed path of a merge request."""
    own = mrs.select("id", "author", c("project_path").alias("line"))
    return own.unionByName(mrs.select("id", "author").join(files.select(c("mr_id").alias("id"), c("path").alias("line")), "id"))


def mr_domains(mrs: DataFrame, files: DataFrame, rules: Rules) -> DataFrame:
    """id, author, domain, each domain once per merge request."""
    lines = mr_lines(mrs, files)
    return lines.join(regex_join(lines, "line", rules), "line").select("id", "author", "domain").distinct()


def domain_counts(tagged: DataFrame) -> DataFrame:
    return tagged.groupBy(c("author").alias("engineer"), "domain").agg(F.count("*").alias("n"))


def corpus(issues: DataFrame) -> DataFrame:
    """engineer, summary, weight of delivery issues: 1 for each done one but for Will Not Do, 0.5 for each in work."""
    done = c("status_category") == "done"
    rows = issues.filter(c("issuetype").isin(*DELIVERY_TYPES) & c("assignee_name").isNotNull() & ((done & (c("status") != "Will Not Do")) | c("status").isin(*WIP)))
    return rows.select(c("assignee_name").alias("engineer"), F.coalesce("summary", F.lit("")).alias("summary"), F.when(done, 1.0).otherwise(0.5).alias("weight"))


def corpus_scores(issues: DataFrame, rules: Rules) -> DataFrame:
    """engineer, domain, score: the weights of the corpus's rows whose summary matches."""
    rows = corpus(issues)
    return rows.join(regex_join(rows, "summary", rules), "summary").groupBy("engineer", "domain").agg(F.sum("weight").alias("score"))


def skill_matrix(corpus: DataFrame, counts: DataFrame) -> DataFrame:
    both = corpus.select("engineer", "domain", "score").unionByName(counts.select("engineer", "domain", c("n").cast("double").alias("score")))
    return both.groupBy("engineer", "domain").agg(F.sum("score").alias("score"))


def domain_ranking(matrix: DataFrame, spare: DataFrame) -> DataFrame:
    """matrix with ``spare`` (0 for engineers without one) and ``place`` in the domain: skill first, spare capacity second, then by name."""
    rows = matrix.join(spare, "engineer", "left").fillna(0, ["spare"])
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("score"), F.desc("spare"), "engineer")))


def apply_overrides(ranking: DataFrame, overrides: DataFrame, added: DataFrame) -> DataFrame:
    """Domains with an override take its order; added engineers come behind, unless they are in the list."""
    kept = ranking.select("domain", "engineer", "place").join(F.broadcast(overrides.select("domain").distinct()), "domain", "left_anti")
    base = kept.unionByName(overrides.select("domain", "engineer", "place"))
    new = added.join(base.select("domain", "engineer"), ["domain", "engineer"], "left_anti")
    last = base.groupBy("domain").agg(F.max("place").alias("last"))
    tail = new.join(last, "domain", "left").withColumn("place", F.coalesce("last", F.lit(0)) + F.row_number().over(Window.partitionBy("domain").orderBy("engineer")))
    return base.unionByName(tail.select("domain", "engineer", "place"))


def ticket_to_skill(tickets: DataFrame, ranking: DataFrame, spare: DataFrame, rules: Rules) -> DataFrame:
    """Expert, runner-up and stretch pick of the ticket's primary domain, the first rule that its summary matches; without a domain the three with most spare capacity."""
    named = tickets.select("key", F.coalesce(*matches("summary", rules)).alias("domain"))
    picks = lambda rows: [F.max(F.when(c("place") == k, c("engineer"))).alias(n) for k, n in ((1, "expert"), (2, "runner_up"), (3, "stretch"))]
    people = ranking.filter("place <= 3").groupBy("domain").agg(*picks(ranking))
    free = spare.orderBy(F.desc("spare"), "engineer").limit(3).withColumn("place", F.row_number().over(Window.orderBy(F.desc("spare"), "engineer")))
    people = people.unionByName(free.agg(*picks(free)).withColumn("domain", F.lit(None).cast("string")))
    return named.alias("t").join(people.alias("p"), c("t.domain").eqNullSafe(c("p.domain")), "left").select("key", "t.domain", "expert", "runner_up", "stretch")


def intake(issues: DataFrame, roster: DataFrame, counts: DataFrame) -> dict[str, DataFrame]:
    """What intake is decided from: the roster (name, velocity, wip, done), the queue oldest first, the corpus, and domains by merge requests."""
    team = roster.select("name")
    outside = F.when(c("assignee_name").isNotNull(), F.concat(F.lit("ext:"), "assignee_name"))
    inside = team.select(c("name").alias("assignee_name"), F.lower("name").alias("inside"))
    queue = issues.filter(c("status").isin(*QUEUE) & ~c("issuetype").isin("Feature", "Initiative", "Epic")).join(inside, "assignee_name", "left")
    queue = queue.select("key", F.to_date("created").alias("created"), "status", "issuetype", "priority_name", F.coalesce("creator_name", F.lit("")).alias("reporter"), F.coalesce("inside", outside).alias("assigned"), F.coalesce("summary", F.lit("")).alias("summary"))
    known = team.withColumnRenamed("name", "engineer")
    return {"roster": roster, "queue": queue, "corpus": corpus(issues).join(known, "engineer", "left_semi"), "mr_domains": counts.join(known, "engineer", "left_semi")}
