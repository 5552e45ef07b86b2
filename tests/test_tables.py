import datetime as dt
import gzip
import json

import pytest
from pyspark.sql import functions as F

from issuequarry import schemas
from issuequarry.functions.instants import run_timestamp
from issuequarry.operators import embed, maintain
from issuequarry.plans import views as V
from issuequarry.session import scratch_path
from issuequarry.sources import archives
from issuequarry.sources import deliveries as D
from issuequarry.streaming import jobs as S

RUN = "2025-01-01T00:00:00"
NOW = dt.datetime(2025, 1, 1)


def _issue(i, key, title):
    return (i, "github", key, title, "", "o/r", None, "Open", NOW, "{}")


def _batch(spark, rows):
    return spark.createDataFrame(
        [("github", k, t, "", "o/r", None, "Open", NOW, "{}", a) for k, t, a in rows],
        "source string, external_key string, title string, body string, repo string, project string, status string, "
        "created_at timestamp_ntz, raw_json string, arrival long")


def test_upsert_keeps_ids_and_numbers_new_keys_densely(spark):
    target = spark.createDataFrame([_issue(4, "a", "old"), _issue(9, "b", "kept")], schemas.ISSUES)
    batch = _batch(spark, [("a", "new", 5), ("z", "first", 1), ("z", "last", 9), ("y", "only", 3), ("a", "newer", 6)])
    once = maintain.upsert_issues(target, batch)
    rows = {r.external_key: (r.id, r.title) for r in once.collect()}
    assert rows == {"a": (4, "newer"), "b": (9, "kept"), "z": (10, "last"), "y": (11, "only")}
    twice = maintain.upsert_issues(once, batch)
    assert sorted(twice.collect()) == sorted(once.collect())


def test_ids_are_dense_over_many_partitions_with_a_hot_key(spark):
    rows = spark.range(3000).select(
        F.lit("github").alias("source"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("external_key"),
        F.lit("t").alias("title"), F.lit("").alias("body"), F.lit("r").alias("repo"), F.lit("p").alias("project"),
        F.lit("s").alias("status"), run_timestamp(RUN).alias("created_at"), F.lit("{}").alias("raw_json"), F.col("id").alias("arrival"))
    done = maintain.upsert_issues(spark.createDataFrame([], schemas.ISSUES), rows)
    got = {r.external_key: r.id for r in done.collect()}
    assert sorted(got.values()) == list(range(1, 2002)) and got["hot"] == 1 and got["2999"] == 2001


def test_vectors_labels_and_cascade(spark):
    old = spark.createDataFrame([(1, [1.0], "m", NOW), (2, [2.0], "m", NOW)], schemas.ISSUE_VECTORS)
    new = spark.createDataFrame([(2, [5.0], "n", NOW), (3, [3.0], "n", NOW)], schemas.ISSUE_VECTORS)
    assert {r.issue_id: r.embedding for r in maintain.upsert_vectors(old, new).collect()} == {1: [1.0], 2: [5.0], 3: [3.0]}
    labels = spark.createDataFrame([(1, "x", "s", False, NOW), (2, "y", "s", False, NOW)], schemas.LABELS)
    batch = spark.createDataFrame([(1, [" a ", "", "a"], "i", 1), (2, ["q"], "i", 1), (2, [], "i", 2)],
                                  "issue_id long, labels array<string>, source string, arrival long")
    done = maintain.replace_labels(labels, batch, run_timestamp(RUN))
    assert sorted((r.issue_id, r.label) for r in done.collect()) == [(1, "a"), (1, "a")]
    issues = spark.createDataFrame([_issue(1, "a", "t")], schemas.ISSUES)
    assert [r.issue_id for r in maintain.cascade_orphans(old, issues).collect()] == [1]
    assert embed.missing_vectors(issues, new).count() == 1 and embed.missing_vectors(issues, old, force=True).count() == 1


def test_similar_refresh_is_idempotent(spark):
    issues = spark.createDataFrame([_issue(i, str(i), "t") for i in range(4)], schemas.ISSUES)
    v = spark.createDataFrame([(i, [float(i), 0.0], "m", NOW) for i in range(5)], schemas.ISSUE_VECTORS)
    empty = spark.createDataFrame([], schemas.SIMILAR_ISSUES)
    targets = spark.createDataFrame([(0,), (0,)], "issue_id long")
    once = maintain.similar_refresh(empty, v, issues, targets, run_timestamp(RUN), k=2)
    twice = maintain.similar_refresh(once, v, issues, targets, run_timestamp(RUN), k=2)
    assert sorted((r.issue_id, r.neighbor_id, r.score) for r in twice.collect()) == [(0, 1, 0.0), (0, 2, -1.0)]


def test_archives(spark, tmp_path):
    path = tmp_path / "github.ndjson"
    records = [{"id": "r1", "repo": "a/b", "number": 1, "title": "t", "labels": ["x", " "]}, {"id": "r2", "title": "u"}]
    with gzip.open(f"{path}.gz", "wt") as out:
        out.write("\n\n".join(json.dumps(r) for r in records) + "\n \n")
    assert archives.scan_ndjson_lines(spark, str(path)).count() == 2
    typed = archives.scan_ndjson(spark, str(path), spark.createDataFrame([], "id string, title string").schema)
    assert {r.id for r in typed.collect()} == {"r1", "r2"}
    issues, labels = spark.createDataFrame([], schemas.ISSUES), spark.createDataFrame([], schemas.LABELS)
    with pytest.warns(UserWarning, match="jira missing"):
        loaded, tags, n, _ = archives.load_archives(
            spark, {"github": str(path), "jira": str(tmp_path / "none")}, issues, labels, RUN)
    assert n == 2 and {r.external_key for r in loaded.collect()} == {"a/b#1", "r2"}
    assert [(r.label, r.source) for r in tags.collect()] == [("x", "github")]
    again = archives.load_archives(spark, {"github": str(path)}, loaded, tags, RUN)
    assert again[2] == 0 and again[0].count() == 2
    old = spark.createDataFrame([(1, [0.5], "m", None)], schemas.ISSUE_VECTORS)
    assert archives.load_archives(spark, {"github": str(path)}, loaded, tags, RUN, dependants=[old])[3][0].count() == 1
    forced = archives.load_archives(spark, {"github": str(path)}, loaded, tags, RUN, force=True, dependants=[old])
    assert forced[2] == 2 and forced[3][0].count() == 0
    bad = tmp_path / "bad.ndjson"
    bad.write_text('{"id": "ok"}\n{"id": \n')
    with pytest.raises(Exception, match="malformed"):
        archives.scan_ndjson_lines(spark, str(bad)).collect()
    with pytest.raises(FileNotFoundError):
        archives.scan_ndjson_lines(spark, str(tmp_path / "gone"))


def test_labelled_pairs_and_sink(spark, tmp_path):
    path = tmp_path / "pairs.csv"
    path.write_text('id,title,body,extra,duplicate_of\n1,"a, b","x\ny",q,2\n2,t,b,q,\n')
    rows = archives.scan_labelled_pairs(spark, str(path)).orderBy("id").collect()
    assert [(r.id, r.title, r.body, r.duplicate_of) for r in rows] == [(1, "a, b", "x\ny", 2), (2, "t", "b", None)]
    path.write_text("id,title\n1,t\n")
    with pytest.raises(ValueError, match="duplicate_of"):
        archives.scan_labelled_pairs(spark, str(path))
    assert archives.write_table(spark.range(7), str(tmp_path / "out"), "json") == 7


SF = "/root/testdata/sf0.001"


def test_stream_in_several_batches_equals_one_upsert(spark):
    inbox, root = scratch_path(spark, "inbox"), scratch_path(spark, "tables")
    d = V.deliveries(spark, SF)
    middle = d.agg(F.percentile_approx("arrival", 0.5)).first()[0]
    for part in (d.filter(F.col("arrival") <= middle), d.filter(F.col("arrival") > middle)):
        part.coalesce(1).write.mode("append").json(inbox)
        S.stream_ingest(D.stream_deliveries(spark, inbox), root, V.run_ts(), V.SECRET, V.SECRET).awaitTermination()
    from issuequarry.operators import normalize

    kept, rejected = normalize.authentic_deliveries(d, V.SECRET, V.SECRET)
    rows = normalize.normalize_deliveries(kept, V.run_ts())
    expected = maintain.upsert_issues(spark.createDataFrame([], schemas.ISSUES), rows)
    current = S.current_issues(spark, root)
    assert sorted(map(repr, current.collect())) == sorted(map(repr, expected.select(*current.columns).collect()))
    assert S.quarantined(spark, root).count() == rejected.count()
    # A replayed batch leaves everything as it was.
    S.ingest_batch(d.filter(F.col("arrival") > middle), 1, root, V.run_ts(), V.SECRET, V.SECRET)
    assert sorted(map(repr, S.current_issues(spark, root).collect())) == sorted(map(repr, expected.select(*current.columns).collect()))


def test_embed_stream_keeps_one_neighbour_set_per_issue(spark):
    inbox, root = scratch_path(spark, "jobs"), scratch_path(spark, "tables")
    issues = spark.createDataFrame([_issue(i, str(i), f"title {i} common") for i in range(8)], schemas.ISSUES)
    none = spark.createDataFrame([], schemas.ISSUE_VECTORS)

    def send(*lines):
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(inbox)
        S.stream_embed(D.stream_jobs(spark, inbox), root, lambda: issues, none, V.run_ts()).awaitTermination()

    send(*[json.dumps({"issue_id": i, "force": False}) for i in range(7)], '{"issue_id": 99}', "broken", '{"issue_id": 1}')
    assert S.current_vectors(spark, root).count() == 7
    assert {r.status for r in S.job_log(spark, root).filter("issue_id = 99").collect()} == {"issue_missing"}
    assert [r.value for r in S.dead_letters(spark, root).collect()] == ["broken"]
    send('{"issue_id": 1, "force": true}', '{"issue_id": 2}', '{"issue_id": 7}')
    later = {r.issue_id: r.status for r in S.job_log(spark, root).filter("epoch = 1").collect()}
    assert later == {1: "embedded", 2: "exists", 7: "embedded"}
    per_issue = {r.issue_id: r["count"] for r in S.current_similar(spark, root).groupBy("issue_id").count().collect()}
    assert per_issue == {i: 5 for i in range(8)}


def test_plans(spark):
    facets = V.table(spark, SF, "documents").filter("lang = 'en'").select("doc_id")
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in facets._jdf.queryExecution().executedPlan().toString()
    target = V.issues(spark, SF)
    plan = maintain.last_arrival(target.withColumn("arrival", F.col("id")), ["source"], "arrival")
    assert "WindowGroupLimit" in plan._jdf.queryExecution().executedPlan().toString()
    summaries = V.vectors(spark, SF).select("issue_id")
    assert "embedding" not in summaries._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


def test_expensive_steps_run_once(spark):
    from issuequarry.operators import protect, text_search

    entities = protect.locked_entities(V.masked_inputs(spark, SF))
    assert entities._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    for stemmed in (False, True):
        plan = text_search.text_index(V.issues(spark, SF), stemmed)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and plan.count("regexp_extract_all") <= 3
