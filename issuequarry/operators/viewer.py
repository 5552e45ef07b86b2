"""Corpus-wide viewer projections: routes, labels, comments, records, facet search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from issuequarry.functions import payload as P
from issuequarry.functions import routes as R
from issuequarry.functions.instants import utc_naive
from issuequarry.functions.text import non_blank
from issuequarry.session import checkpointed

COMMENT = "array<struct<author:string,body:string,body_html:string,created_at:timestamp_ntz>>"


def with_payload(issues: DataFrame) -> DataFrame:
    """Parse ``raw_json`` once; the variant column feeds every later path."""
    return issues.withColumn("payload", P.parse_payload(F.col("raw_json")))


def canonical_routes(issues: DataFrame) -> DataFrame:
    """Issue id, route and its parts; unroutable issues have nulls."""
    return R.with_route(with_payload(issues)).select(
        "id", F.col("parts.source").alias("route_source"), "parts.route", "parts.owner",
        F.col("parts.repo").alias("route_repo"), "parts.number", "parts.site",
        F.col("parts.project").alias("route_project"), "parts.key",
    )


def origin_urls(issues: DataFrame) -> DataFrame:
    return R.with_route(with_payload(issues)).select("id", "parts.route", R.origin_url(F.col("parts")).alias("origin_url"))


def result_url_column() -> Column:
    return R.result_url(*(F.col(c) for c in ("payload", "id", "source", "external_key", "repo", "project")))


def result_urls(issues: DataFrame) -> DataFrame:
    return with_payload(issues).select("id", result_url_column().alias("url"))


def distinct_routes(issues: DataFrame) -> DataFrame:
    """Distinct routes with the lowest issue id that has them, which gives first-seen order."""
    return (
        canonical_routes(issues).filter("route is not null")
        .groupBy("route").agg(F.min("id").alias("first_id"))
    )


def labels_array(labels: DataFrame) -> DataFrame:
    """Sorted distinct labels per issue; the set is built map-side first."""
    return labels.filter("label is not null").groupBy("issue_id").agg(
        F.array_sort(F.collect_set("label")).alias("labels")
    )


def issues_left_labels(
    issues: DataFrame, labels: DataFrame, wanted: Sequence[str] | None = None, strict_labels: bool = False
) -> DataFrame:
    """Issues with their label array.

    A label filter narrows the array and keeps every issue, as a predicate in
    the ON clause does; ``strict_labels`` drops issues without a wanted label.
    """
    chosen = labels.filter(F.col("label").isin(*wanted)) if wanted else labels
    arrays = labels_array(chosen).withColumnRenamed("issue_id", "id")
    joined = issues.join(arrays, "id", "inner" if strict_labels and wanted else "left")
    return joined.withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))


def stated_labels(v: Column) -> Column:
    """Label names in the payload: strings, or objects with a name or label."""

    def name(item: Column) -> Column:
        stated = F.coalesce(P.truthy(item, "$.name"), P.truthy(item, "$.label"))
        return F.when(P.is_object(item, "$"), stated).otherwise(P.string_only(item, "$"))

    at_top = P.text(v, "$.labels").isNotNull()
    listed = F.when(at_top, P.objects_or_scalars(v, "$.labels")).otherwise(
        P.objects_or_scalars(v, "$.issue.labels")
    )
    return F.coalesce(F.transform(listed, name), F.array().cast("array<string>"))


def merged_labels(stated: Column, table_labels: Column) -> Column:
    """Union of payload and table labels: trimmed, non-blank, distinct, sorted."""
    cleaned = F.transform(F.concat(table_labels, stated), non_blank)
    return F.array_sort(F.array_distinct(F.filter(cleaned, lambda x: x.isNotNull())))


def issue_labels(issues: DataFrame, labels: DataFrame) -> DataFrame:
    stated = with_payload(issues).select("id", stated_labels(F.col("payload")).alias("stated"))
    joined = issues_left_labels(stated, labels)
    return joined.select("id", merged_labels(F.col("stated"), F.col("labels")).alias("labels"))


def priority_column(v: Column) -> Column:
    def named(path: str) -> Column:
        picked = F.when(P.truthy(v, f"{path}.name").isNotNull(), P.string_only(v, f"{path}.name")).otherwise(
            P.string_only(v, f"{path}.value")
        )
        return F.when(P.is_object(v, path), non_blank(picked))

    return F.coalesce(
        named("$.priority"), non_blank(P.string_only(v, "$.priority")), named("$.issue.fields.priority")
    )


def issue_priority(issues: DataFrame) -> DataFrame:
    return with_payload(issues).select("id", priority_column(F.col("payload")).alias("priority"))


def comments_column(v: Column) -> Column:
    """Comments of the first non-empty list among the known places; rendered, with UTC times."""

    def listed(path: str) -> Column:
        items = P.objects_or_scalars(v, path)
        return F.when(F.size(items) > 0, items)

    def comment(item: Column) -> Column:
        body = F.coalesce(P.truthy(item, "$.body"), F.lit(""))

        def author_at(path: str) -> Column:
            named = F.coalesce(
                P.truthy(item, f"{path}.displayName"), P.truthy(item, f"{path}.login"), P.truthy(item, f"{path}.name")
            )
            return F.when(P.is_object(item, path), named).otherwise(F.nullif(P.string_only(item, path), F.lit("")))

        author = F.when(P.truthy(item, "$.author").isNotNull(), author_at("$.author")).otherwise(author_at("$.user"))
        created = F.coalesce(P.truthy(item, "$.created"), P.truthy(item, "$.at"), P.truthy(item, "$.updated"))
        return F.struct(
            author.alias("author"), body.alias("body"), R.render_body(body).alias("body_html"),
            utc_naive(created).alias("created_at"),
        )

    source = F.coalesce(listed("$.comments"), listed("$.issue.comments"), listed("$.issue.fields.comment"))
    objects = F.filter(source, lambda x: P.is_object(x, "$"))
    return F.coalesce(F.transform(objects, comment), F.array().cast(COMMENT))


def comments_exploded(issues: DataFrame) -> DataFrame:
    """One row per comment; issues without comments keep one row of nulls."""
    listed = with_payload(issues).select("id", comments_column(F.col("payload")).alias("comments"))
    return listed.select("id", F.posexplode_outer("comments").alias("pos", "comment")).select(
        "id", F.col("pos").cast("bigint").alias("pos"), "comment.*"
    )


def banner_column(v: Column, source: Column) -> Column:
    """Provenance line: seed and generation time where the payload states them."""
    seed = F.when(P.text(v, "$.seed").isNotNull(), P.scalar_text(v, "$.seed")).otherwise(
        P.scalar_text(v, "$.generation.seed")
    )
    in_object = F.when(P.truthy(v, "$.generation.time").isNotNull(), P.scalar_text(v, "$.generation.time")).otherwise(
        P.scalar_text(v, "$.generation.timestamp")
    )
    made = (
        F.when(P.text(v, "$.generatedAt").isNotNull(), P.scalar_text(v, "$.generatedAt"))
        .when(in_object.isNotNull(), in_object)
        .when(P.text(v, "$.generation_time").isNotNull(), P.scalar_text(v, "$.generation_time"))
        .otherwise(P.scalar_text(v, "$.createdAt"))
    )

    def part(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"{label}: "), F.nullif(value, F.lit("")), F.lit("."))

    return F.concat_ws(" ", F.lit("Synthetic."), part("Seed", seed), part("Generated", made), part("Source", source))


def provenance_banner(issues: DataFrame) -> DataFrame:
    return with_payload(issues).select(
        "id", banner_column(F.col("payload"), F.lower("source")).alias("determinism")
    )


def render_bodies(texts: DataFrame, id_col: str = "id", body: str = "body") -> DataFrame:
    return texts.select(id_col, R.render_body(F.col(body)).alias("body_html"))


def link_rewrites(texts: DataFrame, routes: DataFrame, id_col: str = "id", body: str = "body") -> DataFrame:
    """Cross-reference edges: every URL in a text, its internal route and the issue it names.

    ``routes`` has one row per route (``distinct_routes``), so the join never
    multiplies links; a popular target is a hot key on the link side only,
    which adaptive skew splitting handles.
    """
    links = texts.select(id_col, F.posexplode(R.text_urls(F.col(body))).alias("pos", "url"))
    rewritten = links.withColumn("route", R.rewrite_link(F.col("url")))
    targets = routes.select("route", F.col("first_id").alias("target_id"))
    return rewritten.join(targets, "route", "left").select(
        id_col, F.col("pos").cast("bigint").alias("pos"), "url",
        F.coalesce("route", "url").alias("href"), F.col("route").isNotNull().alias("internal"), "target_id",
    )


def in_link_counts(links: DataFrame) -> DataFrame:
    return links.filter("target_id is not null").groupBy("target_id").agg(F.count("*").alias("in_links"))


SUMMARY = [
    "id", "source", "route", "origin_url", "title", "status", "priority", "labels", "repo", "project", "created_at",
]


def _projected(issues: DataFrame, *carried: Column) -> DataFrame:
    """Everything a summary takes from the issue itself, for routable issues.

    Payloads are parsed and dropped here, before labels are joined, so that the
    join moves short columns only.
    """
    v, parts = F.col("payload"), F.col("parts")
    return R.with_route(with_payload(issues)).filter("parts is not null").select(
        "id", parts["source"].alias("source"), parts["route"].alias("route"), R.origin_url(parts).alias("origin_url"),
        F.coalesce("title", F.lit("")).alias("title"), "status", priority_column(v).alias("priority"),
        stated_labels(v).alias("stated"), "repo", "project", "created_at", *carried,
    )


def _with_labels(
    projected: DataFrame, labels: DataFrame, wanted: Sequence[str] | None = None, strict_labels: bool = False
) -> DataFrame:
    joined = issues_left_labels(projected, labels, wanted, strict_labels)
    return joined.withColumn("labels", merged_labels(F.col("stated"), F.col("labels"))).drop("stated")


def viewer_summaries(issues: DataFrame, labels: DataFrame) -> DataFrame:
    """Eleven summary fields of every routable issue; bodies are never read."""
    return _with_labels(_projected(issues), labels).select(*SUMMARY)


def viewer_records(issues: DataFrame, labels: DataFrame) -> DataFrame:
    """Fifteen record fields of every routable issue, comments nested.

    Comments are rendered before the join and bodies after it: of the two, only
    the text travels.
    """
    v = F.col("payload")
    projected = _projected(
        issues, F.coalesce("body", F.lit("")).alias("body"),
        banner_column(v, F.col("parts.source")).alias("determinism"), comments_column(v).alias("comments"),
    )
    html = R.render_body(F.col("body")).alias("body_html")
    return _with_labels(projected, labels).select(*SUMMARY, "body", html, "determinism", "comments")


def parse_routes(routes: DataFrame, route: str = "route") -> DataFrame:
    parsed = routes.withColumn("parsed", R.parse_route(F.col(route)))
    return parsed.select(*routes.columns, "parsed.*")


def issues_by_route(routes: DataFrame, issues: DataFrame, labels: DataFrame, route: str = "route") -> DataFrame:
    """Record for each requested route; routes that name no issue are flagged.

    Routes are made distinct first, then matched on (source, external_key); the
    lowest id wins. Issues are narrowed to the matched ones before labels and
    projections are computed.
    """
    wanted = routes.select(route).distinct()
    parsed = R.parse_route(F.col(route))
    keys = wanted.select(
        route, parsed["source"].alias("source"), F.explode(parsed["external_keys"]).alias("external_key")
    )
    found = (
        keys.join(issues.select("id", "source", "external_key"), ["source", "external_key"])
        .groupBy(route).agg(F.min("id").alias("id"))
    )
    needed = found.select("id").distinct()
    hits = issues.join(needed, "id", "left_semi")
    near = labels.join(needed, labels.issue_id == needed.id, "left_semi")
    records = viewer_records(hits, near).withColumnRenamed("route", "canonical_route")
    answers = wanted.join(found, route, "left").join(records, "id", "left")
    missing = F.when(F.col("canonical_route").isNull(), F.lit("route not found")).otherwise(F.lit("ok"))
    return answers.withColumn("lookup", missing)


def viewer_search(
    issues: DataFrame,
    labels: DataFrame,
    *,
    matching_ids: DataFrame | None = None,
    sources: Sequence[str] | None = None,
    repos: Sequence[str] | None = None,
    projects: Sequence[str] | None = None,
    states: Sequence[str] | None = None,
    priorities: Sequence[str] | None = None,
    label_names: Sequence[str] | None = None,
    strict_labels: bool = False,
    limit: int = 50,
) -> DataFrame:
    """Facet search, newest first.

    The limit is applied to issues before labels are joined and before
    unroutable rows are dropped. ``matching_ids`` (column ``id``) is the result
    of the text match. The limit is at most 200, so the chosen rows are few
    enough to be broadcast to the labels.
    """
    if not 1 <= limit <= 200:
        raise ValueError("limit must be between 1 and 200")
    base = issues
    for column, values in (("source", sources), ("repo", repos), ("project", projects), ("status", states)):
        if values:
            base = base.filter(F.col(column).isin(*values))
    if priorities:
        stated = P.stored_text(P.parse_payload(F.col("raw_json")), "$.priority")
        base = base.filter(F.coalesce(stated, F.lit("")).isin(*priorities))
    if matching_ids is not None:
        base = base.join(matching_ids.select("id").distinct(), "id", "left_semi")
    newest = checkpointed(base.drop("body").orderBy(F.desc("created_at"), F.desc("id")).limit(limit), "newest")
    near = labels.join(F.broadcast(newest.select("id")), F.col("issue_id") == F.col("id"), "left_semi")
    return _with_labels(_projected(newest), near, label_names, strict_labels).select(*SUMMARY)
