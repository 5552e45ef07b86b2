"""Vector and hybrid search for a table of queries, triage proposals, write-back plans."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from issuequarry.functions import payload as P
from issuequarry.functions.routes import with_route
from issuequarry.operators import neighbors as N
from issuequarry.operators import text_search as T
from issuequarry.operators.viewer import result_url_column, with_payload

# The constant parts of a proposal.
PROPOSAL_LABELS = ("needs-triage",)
PROPOSAL_SUMMARY = "Similar issues suggest investigating related regressions."

_SHOWN = ["id", "title", "source", "external_key", "repo", "project", "raw_json"]


def search_params(queries: DataFrame) -> DataFrame:
    """Fill defaults and flag queries outside the allowed ranges."""
    filled = queries.withColumns({
        "k": F.coalesce("k", F.lit(10)), "alpha": F.coalesce("alpha", F.lit(0.5)),
    })
    valid = (F.length("text") >= 2) & F.col("k").between(1, 50) & F.col("alpha").between(0.0, 1.0)
    return filled.withColumn("status", F.when(valid, F.lit("ok")).otherwise(F.lit("invalid")))


def shown(hits: DataFrame, issues: DataFrame) -> DataFrame:
    """Add title, route and URL to hits; only the hit issues have their payload parsed."""
    joined = hits.join(issues.select(*[F.col(c) for c in _SHOWN]), hits.issue_id == F.col("id"), "inner")
    return with_route(with_payload(joined)).select(
        *hits.columns, "title", F.col("parts.route").alias("route"), result_url_column().alias("url")
    )


def vector_search(queries: DataFrame, vectors: DataFrame, issues: DataFrame, k: int = 10, **options) -> DataFrame:
    """Nearest issues per query; the score 1 - distance is clamped to 0..1, the order is by distance.

    Vectors whose issue is gone are left out before the search, as the inner
    join of the two tables does. Pass ``index=`` to search a prebuilt index of
    such vectors instead of all of them.
    """
    live = vectors.join(issues.select("id"), F.col("issue_id") == F.col("id"), "left_semi")
    found = N.nearest(queries, live, k, **options)
    score = F.greatest(F.lit(1.0) - F.greatest("distance", F.lit(0.0)), F.lit(0.0))
    return shown(found.withColumn("score", score), issues)


def candidate_union(vector_hits: DataFrame, text_hits: DataFrame) -> DataFrame:
    """Issues found by either side; the missing side scores zero."""
    v = vector_hits.select("query_id", "issue_id", "vector_score")
    t = text_hits.select("query_id", "issue_id", "text_score")
    return v.join(t, ["query_id", "issue_id"], "full_outer").select(
        "query_id", "issue_id",
        F.coalesce("vector_score", F.lit(0.0)).alias("vector_score"),
        F.coalesce("text_score", F.lit(0.0)).alias("text_score"),
    )


def hybrid_search(
    queries: DataFrame, vectors: DataFrame, issues: DataFrame, k: int = 10, stemmed: bool = True, postings=None, **options
) -> DataFrame:
    """Blend of vector and text candidates: alpha * 1/(1+d) + (1 - alpha) * rank.

    Both sides are cut to ``k`` per query before they meet; the text rank is
    not rescaled. Only the final hits fetch their issue. ``postings`` and ``index`` are stored indexes
    of the issues and the vectors to read instead of them.
    """
    near = N.nearest(queries, vectors, k, **options)
    vector_hits = near.withColumn("vector_score", F.lit(1.0) / (F.lit(1.0) + F.col("distance")))
    text_hits = T.text_search(issues, queries, k, stemmed, postings)
    # A dangling vector takes up one of the k candidates, then finds no issue.
    both = candidate_union(vector_hits, text_hits).join(
        issues.select("id"), F.col("issue_id") == F.col("id"), "left_semi"
    )
    weighted = both.join(queries.select("query_id", "alpha"), "query_id")
    blend = F.col("vector_score") * F.col("alpha") + F.col("text_score") * (F.lit(1.0) - F.col("alpha"))
    scored = weighted.withColumn("score", F.round(blend, 12)).drop("alpha")
    return shown(T.top_by_score(scored, "score", k), issues)


Scorer = Callable[[pd.DataFrame], pd.Series]


def rerank(candidates: DataFrame, scorer: Scorer | None = None, score: str = "score") -> DataFrame:
    """Re-order the candidates of every query by a scorer over batches of rows.

    Without a scorer the order stays. A scorer gets whole batches and returns
    one number per row; ranks are then computed by Spark, so no query's
    candidates have to sit in one Python group.
    """
    if scorer is None:
        return candidates
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in candidates.schema.fields)

    def rescore(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(rerank_score=scorer(pdf).astype(float))

    scored = candidates.mapInPandas(rescore, f"{fields}, rerank_score double")
    every = F.lit(2**31 - 1)
    return T.top_by_score(scored.drop("rank"), "rerank_score", every).drop("rerank_score")


ListScorer = Callable[[str, pd.DataFrame], Sequence[float]]
#: The longest candidate list a list scorer is handed; searches give at most this many.
LONGEST_LIST = 200


def rerank_lists(candidates: DataFrame, queries: DataFrame, scorer: ListScorer) -> DataFrame:
    """Re-order the candidates of every query by a scorer that sees the query's text and its complete list.

    The list comes in the order of ``rank``; the scorer returns a number per candidate, higher is better, and
    equal numbers keep that order. Queries and candidates meet by a cogroup on the query, whose groups are the
    ``k`` rows of one search; a longer list than ``LONGEST_LIST`` ends the job. Queries without candidates have no rows.
    """
    schema = candidates.schema
    longest = LONGEST_LIST

    def order(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return rows
        if len(rows) > longest:
            raise ValueError(f"a list of {len(rows)} candidates, at most {longest} are taken")
        text = asked["text"].iloc[0] if len(asked) else None
        rows = rows.sort_values("rank", kind="stable").reset_index(drop=True)
        scores = np.asarray(list(scorer("" if text is None else text, rows.copy())), dtype=float)
        if scores.shape != (len(rows),):
            raise ValueError(f"the scorer returned {len(scores)} numbers for {len(rows)} candidates")
        placed = rows.iloc[np.argsort(-scores, kind="stable")].copy()
        placed["rank"] = np.arange(1, len(placed) + 1)
        return placed

    texts = queries.select("query_id", "text")
    return candidates.groupBy("query_id").cogroup(texts.groupBy("query_id")).applyInPandas(order, schema)


def issue_latest_vector(
    issues: DataFrame, vectors: DataFrame, encode: Callable[[DataFrame], DataFrame], default_model: str
) -> DataFrame:
    """Newest vector per issue, or one computed from its text."""
    newest = vectors.groupBy("issue_id").agg(
        F.max_by(F.struct("embedding", "model"), F.struct("updated_at", "model")).alias("stored")
    )
    paired = issues.select("id", "title", "body").join(newest, F.col("id") == F.col("issue_id"), "left")
    stored = paired.filter("stored is not null").select(
        F.col("id").alias("issue_id"), "stored.embedding", "stored.model", F.lit("stored").alias("origin")
    )
    missing = paired.filter("stored is null").select(F.col("id").alias("issue_id"), "title", "body")
    computed = encode(missing).select(
        "issue_id", "embedding", F.lit(default_model).alias("model"), F.lit("computed").alias("origin")
    )
    return stored.unionByName(computed)


def triage_propose(
    targets: DataFrame, vectors: DataFrame, issues: DataFrame, top_k: int = 5,
    exclude_self: bool = False, scorer: Scorer | None = None, **options,
) -> DataFrame:
    """Proposal per target (issue_id, model, embedding): fixed parts and the similar issues.

    An issue is normally its own first neighbour; ``exclude_self`` leaves it out.
    """
    asked = targets.select(F.col("issue_id").alias("query_id"), "model", "embedding")
    found = vector_search(asked, vectors, issues, top_k, exclude_self=exclude_self, **options)
    ordered = rerank(found, scorer)
    similar = ordered.groupBy("query_id").agg(F.array_sort(F.collect_list(
        F.struct("rank", "issue_id", "title", "score", "route", "url")
    )).alias("similar"))
    fixed_labels = F.array(*[F.lit(x) for x in PROPOSAL_LABELS])
    return asked.select("query_id").join(similar, "query_id", "left").select(
        F.col("query_id").alias("issue_id"), fixed_labels.alias("labels"),
        F.array().cast("array<string>").alias("assignee_candidates"), F.lit(PROPOSAL_SUMMARY).alias("summary"),
        F.coalesce("similar", F.array().cast(similar.schema["similar"].dataType)).alias("similar"),
    )


def approvals_join_issues(approvals: DataFrame, issues: DataFrame) -> DataFrame:
    """Approvals with their issue; unknown ids stay, flagged."""
    stored = issues.select(
        F.col("id").alias("_id"), F.col("source").alias("issue_source"), "repo", "project", "external_key", "raw_json"
    )
    joined = approvals.join(stored, F.col("issue_id") == F.col("_id"), "left")
    status = F.when(F.col("_id").isNull(), F.lit("issue_not_found")).otherwise(F.lit("ok"))
    return joined.withColumn("lookup", status).drop("_id")


def writeback_plan(approvals: DataFrame, issues: DataFrame, jira_base_url: str | None) -> DataFrame:
    """Outbox rows (seq, action, method, path, payload) per approval; nothing is sent.

    Approvals that cannot be applied keep one row that says why.
    """
    joined = with_payload(approvals_join_issues(approvals, issues))
    v = F.col("payload")
    stored = F.lower(F.coalesce("issue_source", F.lit("")))
    asked = F.lower(F.coalesce(F.nullif(F.col("source"), F.lit("")), stored))
    github, jira = (asked == "github") & (stored == "github"), (asked == "jira") & (stored == "jira")
    number = F.coalesce(P.truthy(v, "$.issue.number"), P.truthy(v, "$.number"))
    key = F.coalesce(P.truthy(v, "$.issue.key"), P.truthy(v, "$.key"))
    repo = F.nullif(F.col("repo"), F.lit(""))
    bad_json = (F.coalesce("raw_json", F.lit("")) != "") & v.isNull()
    status = (
        F.when(F.col("lookup") != "ok", F.lit("issue not found"))
        .when(bad_json, F.lit("stored issue payload is not valid JSON"))
        .when(github & (repo.isNull() | number.isNull()), F.lit("missing repo or number"))
        .when(jira & F.lit(not jira_base_url), F.lit("jira base url missing"))
        .when(jira & key.isNull(), F.lit("missing jira key"))
        .when(~(github | jira), F.lit("source mismatch"))
        .otherwise(F.lit("ok"))
    )
    assignee, comment = (F.nullif(F.col(c), F.lit("")) for c in ("assignee", "comment"))

    def action(seq: int, name: str, method: str, path: Column, body: Column, wanted: Column) -> Column:
        row = F.struct(
            F.lit(seq).cast("bigint").alias("seq"), F.lit(name).alias("action"), F.lit(method).alias("method"),
            path.alias("path"), F.to_json(body).alias("payload"),
        )
        return F.when(wanted, row)

    gh = F.concat(F.lit("/repos/"), repo, F.lit("/issues/"), number)
    ji = F.concat(F.lit("/rest/api/3/issue/"), key)
    note = F.struct(comment.alias("body"))
    github_actions = F.array(
        action(1, "add_labels", "POST", F.concat(gh, F.lit("/labels")), F.struct("labels"), F.size("labels") > 0),
        action(2, "assign", "POST", F.concat(gh, F.lit("/assignees")),
               F.struct(F.array(assignee).alias("assignees")), assignee.isNotNull()),
        action(3, "comment", "POST", F.concat(gh, F.lit("/comments")), note, comment.isNotNull()),
    )
    jira_actions = F.array(
        action(1, "assign", "PUT", F.concat(ji, F.lit("/assignee")),
               F.struct(assignee.alias("accountId")), assignee.isNotNull()),
        action(2, "comment", "POST", F.concat(ji, F.lit("/comment")), note, comment.isNotNull()),
    )
    chosen = F.when(F.col("status") == "ok", F.when(github, github_actions).otherwise(jira_actions))
    planned = joined.withColumn("status", status).withColumn(
        "actions", F.filter(chosen, lambda a: a.isNotNull())
    )
    return planned.select("approval_id", "issue_id", "status", F.explode_outer("actions").alias("a")).select(
        "approval_id", "issue_id", "status", "a.seq", "a.action", "a.method", "a.path", "a.payload"
    )
