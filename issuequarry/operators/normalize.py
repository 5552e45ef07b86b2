"""Raw payloads and archive records to rows of the issues table."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from issuequarry.functions import payload as P
from issuequarry.functions.instants import utc_or_default

# Events of the first provider that carry an issue.
ISSUE_EVENTS = ("issues", "issue_comment", "pull_request")
SIGNATURE_HEADER = "X-Hub-Signature-256"
EVENT_HEADER = "X-GitHub-Event"
IDENTIFIER_HEADER = "X-Atlassian-Webhook-Identifier"


def _with_issue(df: DataFrame, raw: str) -> DataFrame:
    """Add the parsed payload and its issue object (the payload itself when it holds none)."""
    df = df.withColumn("_payload", P.parse_payload(F.col(raw)))
    nested = F.try_variant_get("_payload", "$.issue", "map<string,variant>")
    has_issue = F.coalesce(F.size(nested) > 0, F.lit(False))
    return df.withColumn(
        "_issue", F.when(has_issue, P.node(F.col("_payload"), "$.issue")).otherwise(F.col("_payload"))
    )


def readable(raw: Column) -> Column:
    """Whether a payload is a JSON object. Anything else holds no issue and belongs in quarantine."""
    return P.is_object(P.parse_payload(raw), "$")


def _id_text(v: Column) -> Column:
    return F.coalesce(P.text(v, "$.id"), F.lit("None"))


def _github_fields(p: Column, i: Column, raw: Column, run_ts: Column) -> Column:
    repo = P.text(p, "$.repository.full_name")
    number = F.coalesce(P.truthy(i, "$.number"), P.text(i, "$.id"))
    has_key = (F.coalesce(repo, F.lit("")) != "") & number.isNotNull()
    title = F.coalesce(P.text(i, "$.title"), F.lit(""))
    return F.struct(
        F.lit("github").alias("source"),
        F.when(has_key, F.concat(repo, F.lit("#"), number)).otherwise(_id_text(i)).alias("external_key"),
        title.alias("title"),
        F.coalesce(P.truthy(i, "$.body"), F.lit("")).alias("body"),
        repo.alias("repo"),
        F.lit(None).cast("string").alias("project"),
        P.text(i, "$.state").alias("status"),
        utc_or_default(P.truthy(i, "$.created_at"), run_ts).alias("created_at"),
        raw.alias("raw_json"),
        (title == "").alias("blank_title"),
    )


def _jira_fields(p: Column, i: Column, raw: Column, run_ts: Column) -> Column:
    title = F.coalesce(P.text(i, "$.fields.summary"), F.lit(""))
    return F.struct(
        F.lit("jira").alias("source"),
        F.coalesce(P.truthy(i, "$.key"), _id_text(i)).alias("external_key"),
        title.alias("title"),
        F.coalesce(P.truthy(i, "$.fields.description"), F.lit("")).alias("body"),
        F.lit(None).cast("string").alias("repo"),
        P.text(i, "$.fields.project.key").alias("project"),
        P.text(i, "$.fields.status.name").alias("status"),
        utc_or_default(P.truthy(i, "$.fields.created"), run_ts).alias("created_at"),
        raw.alias("raw_json"),
        (title == "").alias("blank_title"),
    )


def _normalized(df: DataFrame, raw: str, run_ts: Column, fields) -> DataFrame:
    kept = [c for c in df.columns if c not in (raw, "source", "headers")]
    parsed = _with_issue(df.filter(readable(F.col(raw))), raw)
    issue = fields(F.col("_payload"), F.col("_issue"), F.col(raw), run_ts)
    return parsed.select(*kept, issue.alias("_row")).select(*kept, "_row.*")


def normalize_github(df: DataFrame, run_ts: Column, raw: str = "body") -> DataFrame:
    """Issue rows from repository-tracker payloads; other columns of ``df`` are kept.

    Pull-request events keep title and body elsewhere and so come out with a
    blank title; ``blank_title`` flags them. Payloads that are no JSON object
    give no row.
    """
    return _normalized(df, raw, run_ts, _github_fields)


def normalize_jira(df: DataFrame, run_ts: Column, raw: str = "body") -> DataFrame:
    """Issue rows from project-tracker payloads; missing parents give nulls, no JSON object gives no row."""
    return _normalized(df, raw, run_ts, _jira_fields)


def normalize_deliveries(deliveries: DataFrame, run_ts: Column) -> DataFrame:
    """Issue rows of a mixed delivery table, in one scan and one projection."""

    def by_source(p: Column, i: Column, raw: Column, ts: Column) -> Column:
        return F.when(F.col("source") == "github", _github_fields(p, i, raw, ts)).otherwise(
            _jira_fields(p, i, raw, ts)
        )

    return _normalized(event_filter(deliveries), "body", run_ts, by_source)


def current_status(v: Column, flavor: Column) -> Column:
    """Target of the last transition when it is a non-empty string, else the tracker's default."""
    last = F.try_element_at(P.objects_or_scalars(v, "$.transitions"), F.lit(-1))
    target = F.nullif(P.string_only(last, "$.to"), F.lit(""))
    return F.coalesce(target, F.when(flavor == "github", F.lit("Open")).otherwise(F.lit("To Do")))


def normalize_archive(df: DataFrame, run_ts: Column, raw: str = "value", flavor: str = "flavor") -> DataFrame:
    """Issue rows from archive records, with their labels and the flavour as source."""
    df = df.withColumn("_payload", P.parse_payload(F.col(raw)))
    p, f = F.col("_payload"), F.col(flavor)
    github = f == "github"
    number = P.integer_only(p, "$.number").cast("string")
    repo, project = P.text(p, "$.repo"), P.text(p, "$.projectKey")
    # A missing id falls back to the flavour; an explicit null is spelt "None".
    plain = F.coalesce(
        P.text(p, "$.id"), F.when(P.kind(p, "$.id") == "VOID", F.lit("None")), f
    )
    github_key = F.concat(F.coalesce(P.truthy(p, "$.repo"), F.lit("sandbox")), F.lit("#"), number)
    jira_key = F.concat(P.truthy(p, "$.projectKey"), F.lit("-"), number)
    kept = [F.col(c) for c in df.columns if c not in ("_payload", raw, flavor)]
    none = F.lit(None).cast("string")
    labels = F.transform(
        F.coalesce(P.objects_or_scalars(p, "$.labels"), F.array().cast("array<variant>")),
        lambda x: P.text(x, "$"),
    )
    return df.select(
        *kept,
        f.alias("source"),
        F.coalesce(F.when(github, github_key).otherwise(jira_key), plain).alias("external_key"),
        F.coalesce(P.text(p, "$.title"), F.lit("")).alias("title"),
        F.coalesce(P.text(p, "$.body"), F.lit("")).alias("body"),
        F.when(github, repo).otherwise(none).alias("repo"),
        F.when(github, none).otherwise(project).alias("project"),
        current_status(p, f).alias("status"),
        utc_or_default(P.truthy(p, "$.createdAt"), run_ts).alias("created_at"),
        F.col(raw).alias("raw_json"),
        labels.alias("labels"),
    )


def event_filter(deliveries: DataFrame) -> DataFrame:
    """Keep issue-bearing events of the first provider and everything of the second."""
    event = F.coalesce(F.col("headers")[EVENT_HEADER], F.lit(""))
    return deliveries.filter((F.col("source") != "github") | event.isin(*ISSUE_EVENTS))


def with_verdict(deliveries: DataFrame, github_secret: str, jira_secret: str | None = None) -> DataFrame:
    """Add ``authentic``: signature check for one provider, identifier check for the other, nothing from anyone else.

    There is no built-in HMAC; composing one from hash built-ins would put key
    material into query plans, so the check runs on Arrow batches instead.
    """
    key = github_secret.encode()

    @F.pandas_udf("boolean")
    def signed(body: pd.Series, signature: pd.Series) -> pd.Series:
        def check(text: str | None, given: str | None) -> bool:
            if text is None or given is None:
                return False
            expected = "sha256=" + hmac.digest(key, text.encode(), hashlib.sha256).hex()
            return hmac.compare_digest(expected.encode(), given.encode())

        return pd.Series([check(t, g) for t, g in zip(body, signature)], dtype=bool)

    headers = F.col("headers")
    identified = F.lit(True)
    if jira_secret:
        identified = F.coalesce(headers[IDENTIFIER_HEADER] == F.lit(jira_secret), F.lit(False))
    github, jira = F.col("source") == "github", F.col("source") == "jira"
    checked = deliveries.withColumn("_signed", signed(F.col("body"), headers[SIGNATURE_HEADER]))
    return checked.withColumn("authentic", F.when(github, F.col("_signed")).when(jira, identified).otherwise(F.lit(False))).drop("_signed")


def authentic_deliveries(
    deliveries: DataFrame, github_secret: str, jira_secret: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Deliveries that pass the check, and the rejected ones for quarantine."""
    judged = with_verdict(deliveries, github_secret, jira_secret)
    return judged.filter("authentic").drop("authentic"), judged.filter("not authentic").drop("authentic")

