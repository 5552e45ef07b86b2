"""Cases of wrong rows that were mended."""

import gzip
import json

from issuequarry.operators import normalize, protect
from issuequarry.sources import archives
from issuequarry.streaming import jobs


def test_last_line_wins_in_a_gzip_archive(spark, tmp_path):
    path = tmp_path / "issues.ndjson.gz"
    with gzip.open(path, "wt") as out:
        for title in ("old", "new"):
            for k in range(500):
                out.write(json.dumps({"key": k, "title": title}) + "\n")
    rows = archives.scan_ndjson_lines(spark, str(path)).selectExpr("get_json_object(value, '$.key') k", "get_json_object(value, '$.title') t", "arrival")
    last = rows.groupBy("k").agg({"k": "count"}).count()
    newest = {r.k: r.t for r in rows.orderBy("arrival").collect()}
    assert last == 500 and set(newest.values()) == {"new"}


def test_unknown_sources_are_rejected(spark):
    rows = [("Other", "{}"), ("GitHub", "{}"), (None, "{}"), ("jira", "{}")]
    df = spark.createDataFrame([(s, {"x": "y"}, b, k) for k, (s, b) in enumerate(rows)], "source string, headers map<string,string>, body string, arrival bigint")
    kept, rejected = normalize.authentic_deliveries(df, "secret", None)
    assert [r.source for r in kept.collect()] == ["jira"] and rejected.count() == 3


def test_bodies_that_are_no_object_are_set_aside(spark):
    bodies = ["no json", "", None, "[1]", "5", "null", '{"issue": {"id": 1}}', "{}"]
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    good = [r.body for r in df.filter(normalize.readable(df.body)).collect()]
    assert good == ['{"issue": {"id": 1}}', "{}"]


def test_job_ids_may_be_text(spark):
    lines = spark.createDataFrame([('{"issue_id": "5"}',), ('{"issue_id": 6, "force": true}',), ('{"issue_id": "x"}',), ("no json",)], "value string")
    good, bad = jobs.parse_jobs(lines)
    assert sorted(map(tuple, good.collect())) == [(5, False), (6, True)] and bad.count() == 2


def test_common_words_of_long_texts_are_aligned():
    source = [w for k in range(150) for w in ("the", f"w{k}")]
    target = [w if k != 7 else "changed" for k, w in enumerate(source)]
    assert protect._edits(source, target, 50) == 1
