"""One query per operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from issuequarry import schemas
from issuequarry.functions.instants import utc_naive
from issuequarry.functions.payload import parse_payload
from issuequarry.operators import embed, evaluate, maintain, neighbors, normalize, protect, search, text_search, viewer
from issuequarry.operators.neighbor_index import StoredIndex
from issuequarry.operators.postings_index import PostingsIndex
from issuequarry.plans import views as V
from issuequarry.session import checkpointed, scratch_path
from issuequarry.sources import archives
from issuequarry.sources import deliveries as D
from issuequarry.streaming import jobs as S

Query = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _ALL[fn.__name__] = fn
    return fn


def registry() -> dict[str, Query]:
    return dict(_ALL)


def _flat(df: DataFrame) -> DataFrame:
    """Timestamps and label arrays as text, so that engines compare alike."""
    for name, kind in df.dtypes:
        if kind in ("timestamp_ntz", "timestamp"):
            df = df.withColumn(name, V.stamp(name))
        elif kind == "array<string>":
            df = df.withColumn(name, F.array_join(name, "|"))
        elif kind == "float":
            df = df.withColumn(name, F.col(name).cast("double"))
        elif kind == "int":
            df = df.withColumn(name, F.col(name).cast("bigint"))
    return df


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


# --- sources -----------------------------------------------------------------------------------


@query
def scan_ndjson(spark, sf):
    path = scratch_path(spark, "archive")
    rows = V.issues(spark, sf).select("id", "source", "external_key", "title", "body", "status")
    rows.write.option("compression", "gzip").json(path)
    return archives.scan_ndjson(spark, path, rows.schema)


@query
def scan_labelled_pairs(spark, sf):
    path = scratch_path(spark, "pairs")
    pairs = V.documents(spark, sf).select("id", "title", "body").join(V.truth(spark, sf), "id", "left")
    pairs.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False).csv(path)
    return archives.scan_labelled_pairs(spark, path)


@query
def stream_deliveries(spark, sf):
    path, out = scratch_path(spark, "deliveries"), scratch_path(spark, "received")
    V.deliveries(spark, sf).write.json(path)
    stream = D.stream_deliveries(spark, path).writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start()
    stream.awaitTermination()
    received = spark.read.schema(schemas.DELIVERY).parquet(out)
    return received.select("source", "arrival", F.col("headers")[normalize.EVENT_HEADER].alias("event"))


def _archives(spark: SparkSession, sf: str) -> dict[str, str]:
    paths = {}
    records = V.archive_records(spark, sf)
    for flavor in ("github", "jira"):
        paths[flavor] = scratch_path(spark, f"archive-{flavor}")
        records.filter(F.col("flavor") == flavor).select("value").write.text(paths[flavor])
    paths["other"] = scratch_path(spark, "absent")
    return paths


def _archive_load(spark: SparkSession, sf: str, paths: dict[str, str], force: bool) -> tuple[DataFrame, DataFrame, int, list[DataFrame]]:
    return archives.load_archives(
        spark, paths, V.issues(spark, sf), V.labels(spark, sf).select(*schemas.LABELS.names), V.RUN_ISO, force,
        [V.vectors(spark, sf)],
    )


@query
def load_guard(spark, sf):
    """Unforced load into a filled table: nothing is loaded, the table stays."""
    kept, _, loaded, _ = _archive_load(spark, sf, _archives(spark, sf), force=False)
    return kept.groupBy("source").agg(F.count("*").alias("issues"), F.lit(loaded).cast("bigint").alias("loaded"))


@query
def load_counts(spark, sf):
    """Forced load: the archives replace what was there, and nothing of the old issues stays."""
    paths = _archives(spark, sf)
    loaded, labels, _, (vectors,) = _archive_load(spark, sf, paths, force=True)
    loaded = checkpointed(loaded, "loaded")
    per_issue = labels.groupBy("issue_id").agg(F.count("*").alias("n"))
    counted = loaded.join(per_issue, F.col("id") == F.col("issue_id"), "left")
    stale = maintain.cascade_orphans(vectors, loaded).agg(F.count("*").alias("stale_vectors"))
    return maintain.load_counts(archives.archive_lines(spark, paths)).join(
        counted.groupBy("source").agg(F.sum("n").alias("labels"), F.count_distinct("id").alias("ids")), "source"
    ).join(F.broadcast(stale))


@query
def sink_ndjson_or_parquet(spark, sf):
    rows = V.issues(spark, sf).select("id", "source", "title", "body")
    path = scratch_path(spark, "sink")
    archives.write_table(rows, f"{path}/parquet")
    archives.write_table(rows, f"{path}/json", "json")
    a = spark.read.schema(rows.schema).parquet(f"{path}/parquet").withColumn("format", F.lit("parquet"))
    b = spark.read.schema(rows.schema).json(f"{path}/json").withColumn("format", F.lit("json"))
    return a.unionByName(b).groupBy("format", "source").agg(
        F.count("*").alias("rows"), F.sum(F.length("title") + F.length("body")).alias("characters")
    )


# --- table maintenance -------------------------------------------------------------------------


def _upserted(spark: SparkSession, sf: str) -> DataFrame:
    """Issues changed by their labels, plus conversations as new issues whose last turn wins."""
    base = V.issues(spark, sf)
    marks = V.table(spark, sf, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    changed = base.join(marks, "id").select(
        *[c for c in schemas.ISSUE_COLUMNS if c != "status"],
        F.when(F.col("quality") == 1, "Resolved").otherwise("Reopened").alias("status"), F.col("id").alias("arrival"),
    )
    none = F.lit(None).cast("string")
    turns = V.table(spark, sf, "conversations").select(
        F.lit("jira").alias("source"), F.concat(F.lit("CHAT-"), F.col("conv_id").cast("string")).alias("external_key"),
        F.col("role").alias("title"), F.col("text").alias("body"), none.alias("repo"), F.lit("CHAT").alias("project"),
        F.lit("Open").alias("status"), V.run_ts().alias("created_at"), F.lit("{}").alias("raw_json"),
        (F.col("conv_id") * 100000 + F.col("turn")).alias("arrival"),
    )
    return maintain.upsert_issues(base, changed.unionByName(turns))


@query
def upsert_issues(spark, sf):
    return _flat(_upserted(spark, sf).select("id", "source", "external_key", "title", "body", "status", "created_at"))


@query
def assign_issue_ids(spark, sf):
    return _upserted(spark, sf).select("source", "external_key", "id")


@query
def upsert_vectors(spark, sf):
    """Every vector of one cluster parity re-sent reversed and under a new model."""
    base = V.vectors(spark, sf)
    later = F.col("updated_at") + F.expr("interval 1 day")
    resent = base.join(V.table(spark, sf, "labels").select(F.col("doc_id").alias("issue_id")), "issue_id").select(
        "issue_id", F.reverse("embedding").alias("embedding"), F.lit("m2").alias("model"), later.alias("updated_at")
    )
    both = resent.unionByName(resent.withColumns({"model": F.lit("m3"), "updated_at": later}))
    done = maintain.upsert_vectors(base, both)
    return _flat(_rounded(done.select(
        "issue_id", "model", "updated_at", F.get("embedding", F.lit(0)).cast("double").alias("first")), "first"))


@query
def replace_labels(spark, sf):
    docs = V.documents(spark, sf)
    batch = docs.join(V.table(spark, sf, "labels").filter("quality = 1").select(F.col("doc_id").alias("id")), "id").select(
        F.col("id").alias("issue_id"), F.array(F.concat(F.lit(" "), "lang"), F.lit(" "), F.col("lang"), F.col("origin")).alias("labels"),
        F.lit("import").alias("source"), F.col("id").alias("arrival"),
    )
    emptied = batch.join(V.table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("issue_id")), "issue_id").select(
        "issue_id", F.array().cast("array<string>").alias("labels"), "source", (F.col("arrival") + 1).alias("arrival")
    )
    done = maintain.replace_labels(
        V.labels(spark, sf).select(*schemas.LABELS.names), batch.unionByName(emptied), V.run_ts()
    )
    return done.groupBy("issue_id", "label", "source").agg(F.count("*").alias("copies"))


@query
def similar_refresh(spark, sf):
    """Neighbours of labelled issues replace a stale row; other issues keep theirs."""
    v = V.vectors(spark, sf)
    stale = v.select(
        "issue_id", F.lit(-1).cast("bigint").alias("neighbor_id"), F.lit(0.5).cast("float").alias("score"), V.run_ts().alias("ts")
    )
    targets = V.table(spark, sf, "labels").select(F.col("doc_id").alias("issue_id"))
    fresh = maintain.similar_refresh(stale, v, V.issues(spark, sf), targets, V.run_ts())
    return fresh.select("issue_id", "neighbor_id", F.round(F.col("score").cast("double"), 4).alias("score"))


@query
def cascade_orphans(spark, sf):
    """Dependents that survive when only labelled issues are left."""
    left = V.documents(spark, sf).join(V.table(spark, sf, "labels").select(F.col("doc_id").alias("id")), "id", "left_semi")
    v = maintain.cascade_orphans(V.vectors(spark, sf).select("issue_id"), left)
    lab = maintain.cascade_orphans(V.labels(spark, sf).select("issue_id"), left)
    return v.withColumn("child", F.lit("vectors")).unionByName(lab.withColumn("child", F.lit("labels")))


# --- normalisation -----------------------------------------------------------------------------


def _normal_columns(df: DataFrame) -> DataFrame:
    return _flat(df.select(
        "doc_id", "external_key", "title", "body", "repo", "project", "status", "created_at", "blank_title"))


@query
def normalize_github(spark, sf):
    payloads = V.github_payloads(spark, sf).select(F.col("id").alias("doc_id"), F.col("payload_body").alias("body"))
    return _normal_columns(normalize.normalize_github(payloads, V.run_ts()))


@query
def normalize_jira(spark, sf):
    payloads = V.jira_payloads(spark, sf).select(F.col("id").alias("doc_id"), F.col("payload_body").alias("body"))
    return _normal_columns(normalize.normalize_jira(payloads, V.run_ts()))


@query
def normalize_archive(spark, sf):
    records = V.archive_records(spark, sf).withColumnRenamed("id", "doc_id").drop("lang")
    done = normalize.normalize_archive(records, V.run_ts())
    return _flat(done.select(
        "doc_id", "source", "external_key", "title", "body", "repo", "project", "status", "created_at", "labels"))


@query
def current_status(spark, sf):
    records = V.archive_records(spark, sf)
    return records.select("id", normalize.current_status(parse_payload(F.col("value")), F.col("flavor")).alias("status"))


@query
def coerce_timestamps(spark, sf):
    lang, base = F.col("lang"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss")
    raw = (
        F.when(lang == "en", F.concat(base, F.lit("Z"))).when(lang == "fr", F.concat(base, F.lit("+05:30")))
        .when(lang == "de", base).otherwise(F.concat(F.lit("at "), base))
    )
    docs = V.documents(spark, sf).select("id", raw.alias("raw"))
    strict = utc_naive(F.col("raw"))
    return _flat(docs.select("id", strict.alias("strict"), F.coalesce(strict, V.run_ts()).alias("defaulted")))


@query
def event_filter(spark, sf):
    kept = normalize.event_filter(V.deliveries(spark, sf))
    return kept.groupBy("source", F.col("headers")[normalize.EVENT_HEADER].alias("event")).agg(
        F.count("*").alias("deliveries"), F.sum("arrival").alias("arrivals"))


@query
def authentic_deliveries(spark, sf):
    judged = normalize.with_verdict(V.deliveries(spark, sf), V.SECRET, V.SECRET)
    return judged.select("source", "arrival", "authentic")


@query
def embedding_text(spark, sf):
    return V.documents(spark, sf).select(
        "id", embed.embedding_text(F.col("title"), F.concat(F.col("body"), F.lit(" \n\t"))).alias("text"))


@query
def vector_quality(spark, sf):
    return embed.vector_quality(V.vectors(spark, sf), 64)


# --- joins and aggregates ----------------------------------------------------------------------


@query
def vectors_join_issues(spark, sf):
    joined = neighbors.vectors_join_issues(V.vectors(spark, sf), V.issues(spark, sf))
    return joined.select("issue_id", "model", "source", "external_key", "title")


@query
def issues_left_labels(spark, sf):
    """Labels narrowed to two names; issues without them stay."""
    joined = viewer.issues_left_labels(
        V.issues(spark, sf).select("id", "external_key"), V.labels(spark, sf), ["quality-1", "toxic-1"])
    return _flat(joined)


@query
def hybrid_candidate_union(spark, sf):
    """Vectors with their own norm gap as one side, labelled issues as the other."""
    v = V.vectors(spark, sf).select(
        F.col("model").alias("query_id"), "issue_id", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("vector_score"))
    t = V.table(spark, sf, "labels").select(
        F.concat(F.lit("m"), F.col("quality").cast("string")).alias("query_id"), F.col("doc_id").alias("issue_id"),
        (F.col("toxic") + 0.5).cast("double").alias("text_score"))
    return search.candidate_union(v, t)


@query
def missing_vectors(spark, sf):
    return embed.missing_vectors(V.issues(spark, sf), V.vectors(spark, sf)).select("id", "external_key")


@query
def keys_semi_lookup(spark, sf):
    """Issues named by conversation ids."""
    keys = V.table(spark, sf, "conversations").select(F.col("conv_id").alias("id")).join(
        V.issues(spark, sf).select("id", "source", "external_key"), "id").select("source", "external_key")
    return maintain.keys_semi_lookup(V.issues(spark, sf).select("id", "source", "external_key", "title"), keys)


@query
def approvals_join_issues(spark, sf):
    return search.approvals_join_issues(V.approvals(spark, sf), V.issues(spark, sf)).select(
        "approval_id", "issue_id", "issue_source", "external_key", "lookup")


@query
def issue_latest_vector(spark, sf):
    """Newest of two vectors per issue; issues without any get one from their text."""
    v = V.vectors(spark, sf)
    older = v.withColumns({"model": F.lit("old"), "updated_at": F.col("updated_at") - F.expr("interval 1 day")})
    latest = search.issue_latest_vector(
        V.issues(spark, sf), v.unionByName(older),
        lambda texts: embed.embed_corpus(texts, "issue_id"), embed.HASHING_MODEL)
    first = F.when(F.col("origin") == "stored", F.round(F.get("embedding", F.lit(0)).cast("double"), 6))
    return latest.select("issue_id", "model", "origin", F.size("embedding").cast("bigint").alias("dim"), first.alias("first"))


@query
def labels_array(spark, sf):
    doubled = V.labels(spark, sf).unionByName(V.labels(spark, sf))
    return _flat(viewer.labels_array(doubled))


@query
def embedding_coverage(spark, sf):
    return embed.embedding_coverage(V.issues(spark, sf), V.vectors(spark, sf))


@query
def distinct_routes(spark, sf):
    return viewer.distinct_routes(V.issues(spark, sf))


def _duplicates(spark: SparkSession, sf: str, strict: bool) -> DataFrame:
    one_model = V.vectors(spark, sf).withColumn("model", F.lit("m"))
    found = checkpointed(neighbors.all_pairs_similarity(one_model, 5), "pairs")
    return evaluate.duplicate_metrics(found, V.truth(spark, sf), 5, strict)


@query
def dup_hit_rate(spark, sf):
    return _rounded(_duplicates(spark, sf, False).select("count", "hit_rate"), "hit_rate")


@query
def dup_precision_at_k(spark, sf):
    return _rounded(_duplicates(spark, sf, True).select("count", "p_at_k"), "p_at_k")


@query
def dup_ndcg(spark, sf):
    return _rounded(_duplicates(spark, sf, False).select("count", "ndcg"), "ndcg")


# --- vector retrieval --------------------------------------------------------------------------


@query
def vector_search(spark, sf):
    hits = search.vector_search(
        V.queries(spark, sf).select("query_id", "model", "embedding"), V.vectors(spark, sf), V.issues(spark, sf), 10)
    return _rounded(hits.select("query_id", "issue_id", "rank", "distance", "score", "title", "route", "url"), "distance", "score")


@query
def vector_search_stored(spark, sf):
    """The same search, of an index that was written in two segments and lost its orphans by a third."""
    index = StoredIndex(spark, scratch_path(spark, "index"), keep=10)
    v, issues = V.vectors(spark, sf), V.issues(spark, sf)
    index.append(v.filter("model = 'm0'"))
    index.append(v.filter("model <> 'm0'"))
    index.append(v.limit(0), index.ids().join(issues.select("id"), F.col("issue_id") == F.col("id"), "left_anti"))
    asked = V.queries(spark, sf).select("query_id", "model", "embedding")
    hits = search.vector_search(asked, v, issues, 10, index=index)
    return _rounded(hits.select("query_id", "issue_id", "rank", "distance", "score", "title", "route", "url"), "distance", "score")


@query
def knn_graph(spark, sf):
    return _rounded(neighbors.knn_graph(V.vectors(spark, sf), 5), "distance", "score")


@query
def all_pairs_similarity(spark, sf):
    return _rounded(neighbors.all_pairs_similarity(V.vectors(spark, sf), 5), "similarity")


def _asked(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    v = V.vectors(spark, sf).select("issue_id", "model", "embedding")
    return v.withColumnRenamed("issue_id", "query_id"), v


@query
def ann_ivf(spark, sf):
    q, v = _asked(spark, sf)
    return neighbors.ivf_index(v).search(q, 5, exclude_self=True)


@query
def ann_lsh(spark, sf):
    q, v = _asked(spark, sf)
    return neighbors.projection_index(v).search(q, 5, exclude_self=True)


@query
def ann_recall(spark, sf):
    """Recall and compared share of both approximate paths against the exact one."""
    q, v = _asked(spark, sf)
    exact = checkpointed(neighbors.exact_knn(q, v, 5, exclude_self=True), "exact")
    rows = None
    for name, index in (("ivf", neighbors.ivf_index(v)), ("lsh", neighbors.projection_index(v))):
        found, share = index.search_with_cost(q, 5, exclude_self=True)
        row = neighbors.recall(found, exact, 5).select(
            F.lit(name).alias("path"), "queries", "recall", F.lit(None).cast("double").alias("candidate_share")
        ).unionByName(share.select(
            F.lit(name).alias("path"), F.lit(None).cast("bigint").alias("queries"),
            F.lit(None).cast("double").alias("recall"), "candidate_share",
        )).groupBy("path").agg(*[F.max(c).alias(c) for c in ("queries", "recall", "candidate_share")])
        rows = row if rows is None else rows.unionByName(row)
    return rows


@query
def embed_corpus(spark, sf):
    made = embed.embed_corpus(V.issues(spark, sf))
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return made.select("issue_id", F.size("embedding").cast("bigint").alias("dim"), F.round(F.sqrt(norm), 5).alias("norm"))


def _reversing(rows):
    return rows["rank"]


@query
def rerank_candidates(spark, sf):
    """Neighbours re-ranked by a scorer that turns their order round."""
    found = neighbors.knn_graph(V.vectors(spark, sf), 5).select(
        F.col("issue_id").alias("query_id"), F.col("neighbor_id").alias("issue_id"), "rank", "distance")
    return _rounded(search.rerank(found, _reversing), "distance")


# --- full text ---------------------------------------------------------------------------------


def _postings_flat(df: DataFrame) -> DataFrame:
    return df.select("term", "issue_id", F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("positions"))


@query
def text_index(spark, sf):
    return _postings_flat(text_search.text_index(V.issues(spark, sf), stemmed=False))


@query
def text_index_english(spark, sf):
    return _postings_flat(text_search.text_index(V.issues(spark, sf), stemmed=True))


_STORED: dict[tuple, str] = {}


def _postings(spark: SparkSession, sf: str, stemmed: bool = False) -> PostingsIndex:
    """The stored postings of the issues, built by the first search of a session and again when the table changes."""
    state = V.table(spark, sf, "documents").agg(F.max("_metadata.file_modification_time"), F.count("*")).first()
    key = (spark.sparkContext.applicationId, sf, stemmed, *state)
    if key not in _STORED:
        root = scratch_path(spark, "postings")
        PostingsIndex(spark, root, stemmed).append(V.issues(spark, sf))
        _STORED[key] = root
    return PostingsIndex(spark, _STORED[key], stemmed)


@query
def text_match(spark, sf):
    q = V.queries(spark, sf)
    terms = checkpointed(text_search.query_terms(q, stemmed=False), "terms")
    postings, frequency = _postings(spark, sf).lookup(terms)
    return text_search.text_match(postings, terms, frequency).select("query_id", "issue_id", "n_terms")


@query
def text_rank_topk(spark, sf):
    found = text_search.text_search(V.issues(spark, sf), V.queries(spark, sf), 10, index=_postings(spark, sf))
    return _rounded(found.select("query_id", "issue_id", "rank", "text_score"), "text_score")


@query
def text_rank_english(spark, sf):
    found = text_search.text_search(V.issues(spark, sf), V.queries(spark, sf), 10, index=_postings(spark, sf, stemmed=True))
    return _rounded(found.select("query_id", "issue_id", "rank", "text_score"), "text_score")


# --- hybrid search and triage ------------------------------------------------------------------


@query
def hybrid_search(spark, sf):
    hits = search.hybrid_search(V.queries(spark, sf), V.vectors(spark, sf), V.issues(spark, sf), 10, postings=_postings(spark, sf))
    return _rounded(hits.select(
        "query_id", "issue_id", "rank", "vector_score", "text_score", "score", "title", "route", "url"),
        "vector_score", "text_score", "score")


@query
def search_params(spark, sf):
    """Conversation texts as queries whose turn sets k and alpha."""
    q = V.table(spark, sf, "conversations").select(
        F.concat_ws(":", "conv_id", "turn").alias("query_id"), "text",
        F.when(F.col("turn") > 0, (F.col("turn") * 20).cast("int")).alias("k"),
        F.when(F.col("role") != "user", F.col("turn") / F.lit(2.0)).alias("alpha"))
    return search.search_params(q).select("query_id", F.col("k").cast("bigint").alias("k"), "alpha", "status")


@query
def triage_propose(spark, sf):
    """Proposal for every issue, by its stored vector or one computed from its text; similar issues in rank order."""
    v, issues = V.vectors(spark, sf), V.issues(spark, sf)
    latest = search.issue_latest_vector(
        issues, v, lambda texts: embed.embed_corpus(texts, "issue_id"), embed.HASHING_MODEL)
    targets = checkpointed(latest.select("issue_id", "model", "embedding"), "targets")
    proposed = search.triage_propose(targets, v, issues, 5)
    ids = F.array_join(F.transform("similar", lambda s: s["issue_id"].cast("string")), ",")
    return _flat(proposed.select("issue_id", "labels", "assignee_candidates", "summary", ids.alias("similar_ids")))


@query
def writeback_plan(spark, sf):
    return search.writeback_plan(V.approvals(spark, sf), V.issues(spark, sf), V.JIRA_BASE_URL)


# --- viewer ------------------------------------------------------------------------------------


@query
def canonical_routes(spark, sf):
    return viewer.canonical_routes(V.issues(spark, sf))


@query
def origin_urls(spark, sf):
    return viewer.origin_urls(V.issues(spark, sf))


@query
def result_urls(spark, sf):
    return viewer.result_urls(V.issues(spark, sf))


@query
def issue_labels(spark, sf):
    return _flat(viewer.issue_labels(V.issues(spark, sf), V.labels(spark, sf)))


@query
def issue_priority(spark, sf):
    return viewer.issue_priority(V.issues(spark, sf))


@query
def comments_exploded(spark, sf):
    rows = viewer.comments_exploded(V.issues(spark, sf, with_comments=True))
    return _flat(rows.select("id", "pos", "author", "body", "created_at"))


@query
def provenance_banner(spark, sf):
    return viewer.provenance_banner(V.issues(spark, sf))


@query
def render_bodies(spark, sf):
    return viewer.render_bodies(V.linked_texts(spark, sf))


@query
def link_rewrites(spark, sf):
    return viewer.link_rewrites(V.linked_texts(spark, sf), viewer.distinct_routes(V.issues(spark, sf)))


@query
def viewer_records(spark, sf):
    records = viewer.viewer_records(V.issues(spark, sf, with_comments=True), V.labels(spark, sf))
    comments = F.col("comments")
    return _flat(records.withColumns({
        "comments": F.size(comments).cast("bigint"),
        "comment_characters": F.aggregate(comments, F.lit(0), lambda a, c: a + F.length(c["body"])).cast("bigint"),
        "comment_html": F.array_join(F.transform(comments, lambda c: c["body_html"]), ""),
    }))


@query
def viewer_summaries(spark, sf):
    return _flat(viewer.viewer_summaries(V.issues(spark, sf), V.labels(spark, sf)))


def _requested_routes(spark: SparkSession, sf: str) -> DataFrame:
    """Every route, and one that names no issue for each page."""
    known = viewer.canonical_routes(V.issues(spark, sf)).select("route").filter("route is not null")
    absent = V.table(spark, sf, "pages").select(F.concat(F.lit("gh/none/page/issues/"), F.col("page_id").cast("string")).alias("route"))
    return known.unionByName(absent)


@query
def parse_routes(spark, sf):
    return _flat(viewer.parse_routes(_requested_routes(spark, sf)))


@query
def issues_by_route(spark, sf):
    found = viewer.issues_by_route(_requested_routes(spark, sf), V.issues(spark, sf), V.labels(spark, sf))
    return _flat(found.select("route", "id", "lookup", "canonical_route", "title", "labels", "priority", "determinism"))


@query
def viewer_search(spark, sf):
    found = viewer.viewer_search(
        V.issues(spark, sf), V.labels(spark, sf), sources=["github", "jira"], states=["Open", "Closed"],
        priorities=[" Medium ", '{"name": "High"}'], label_names=["quality-1", "toxic-1"], limit=50)
    return _flat(found)


@query
def viewer_search_text(spark, sf):
    """Facet search with a text: issues that hold both words, newest first."""
    issues = V.issues(spark, sf)
    matching = text_search.matching_issue_ids(issues, "les des", index=_postings(spark, sf))
    found = viewer.viewer_search(issues, V.labels(spark, sf), matching_ids=matching, limit=200)
    return _flat(found)


@query
def in_link_counts(spark, sf):
    links = viewer.link_rewrites(V.linked_texts(spark, sf), viewer.distinct_routes(V.issues(spark, sf)))
    return viewer.in_link_counts(links)


# --- protection and edit accounting ------------------------------------------------------------


@query
def locked_entities(spark, sf):
    found = protect.locked_entities(V.masked_inputs(spark, sf))
    return _flat(found)


@query
def mask_corpus(spark, sf):
    masked = protect.mask_corpus(V.masked_inputs(spark, sf))
    return masked.select("doc_id", "masked", F.size("spans").cast("bigint").alias("n_spans"))


@query
def unmask_corpus(spark, sf):
    """Round trip: the restored text of every document, checked against the original."""
    back = protect.unmask_corpus(protect.mask_corpus(V.masked_inputs(spark, sf)))
    return back.select("doc_id", "restored", (F.col("restored") == F.col("text")).alias("same"))


@query
def entity_stats(spark, sf):
    """Kinds that the added sentence of every document names once or more."""
    found = protect.entity_stats(protect.locked_entities(V.masked_inputs(spark, sf)))
    return found.select("kind", "spans", "distinct_values")


@query
def token_counts(spark, sf):
    return protect.token_counts(V.table(spark, sf, "documents"))


@query
def edit_budget_gate(spark, sf):
    """Every turn as a rewrite of the turn before it, and of itself with one word added."""
    turns = V.table(spark, sf, "conversations").select("conv_id", "turn", "text")
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("candidate"))
    next_turn = turns.join(following, ["conv_id", "turn"]).withColumn("pair", F.lit("next"))
    longer = turns.select("*", F.concat("text", F.lit(" indeed")).alias("candidate"), F.lit("longer").alias("pair"))
    gated = protect.edit_budget_gate(next_turn.select(*longer.columns).unionByName(longer))
    return gated.select("conv_id", "turn", "pair", "total_tokens", "edited_tokens",
                        (F.col("result") == F.col("candidate")).alias("accepted"))


@query
def protected_terms(spark, sf):
    guarded = protect.protect_terms(V.masked_inputs(spark, sf))
    back = protect.restore_terms(guarded)
    return back.select("doc_id", "guarded", "restored")


# --- streaming ---------------------------------------------------------------------------------


def _ingested(spark: SparkSession, sf: str) -> str:
    inbox, root = scratch_path(spark, "inbox"), scratch_path(spark, "tables")
    V.deliveries(spark, sf).unionByName(V.stray_deliveries(spark, sf)).write.json(inbox)
    S.stream_ingest(D.stream_deliveries(spark, inbox), root, V.run_ts(), V.SECRET, V.SECRET).awaitTermination()
    return root


@query
def stream_ingest(spark, sf):
    return _flat(S.current_issues(spark, _ingested(spark, sf)).select(
        "id", "source", "external_key", "title", "body", "status", "created_at"))


@query
def rejected_deliveries(spark, sf):
    """The quarantine: forged deliveries, markup instead of JSON, and an unknown source."""
    stray = F.col("arrival") >= 10**12
    return S.quarantined(spark, _ingested(spark, sf)).select(
        "source", "arrival", F.when(stray, F.md5(F.col("body").cast("binary"))).alias("body_md5"))


@query
def embed_jobs(spark, sf):
    """Jobs the ingest stream queued, one per issue of the batch."""
    root = _ingested(spark, sf)
    jobs = spark.read.schema(schemas.EMBED_JOB).json(f"{root}/embed_jobs")
    return jobs.select("issue_id", "force")


def _embedded(spark: SparkSession, sf: str) -> str:
    inbox, root = scratch_path(spark, "jobs"), scratch_path(spark, "tables")
    good = V.jobs(spark, sf).select(F.to_json(F.struct("issue_id", "force")).alias("value"))
    bad = V.table(spark, sf, "pages").select(F.concat(F.lit('{"page": '), F.col("page_id").cast("string")).alias("value"))
    good.unionByName(bad).write.text(inbox)
    issues = V.issues(spark, sf)
    S.stream_embed(
        D.stream_jobs(spark, inbox), root, lambda: issues, V.vectors(spark, sf), V.run_ts(),
    ).awaitTermination()
    return root


@query
def stream_embed(spark, sf):
    return S.job_log(spark, _embedded(spark, sf)).select("issue_id", "status")


@query
def stream_embed_status(spark, sf):
    """Batch twin: the status of every single job in event order."""
    return S.job_status(V.jobs(spark, sf), V.issues(spark, sf), V.vectors(spark, sf))


@query
def dead_letter(spark, sf):
    return S.dead_letters(spark, _embedded(spark, sf)).select("value")
