import datetime as dt
import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from issuequarry.functions.instants import run_timestamp, utc_naive
from issuequarry.functions.text import embedding_text
from issuequarry.operators import normalize
from issuequarry.schemas import DELIVERY

RUN = "2025-01-01T00:00:00"


def _frame(spark, payloads):
    return spark.createDataFrame([(i, json.dumps(p) if not isinstance(p, str) else p) for i, p in enumerate(payloads)],
                                 "n long, body string")


def _by_n(df):
    return {r.n: r for r in df.collect()}


def test_github_payload(spark):
    full = {"issue": {"id": 100, "title": "T", "body": "B", "state": "open", "number": 4,
                      "created_at": "2024-01-01T02:00:00+02:00"}, "repository": {"full_name": "org/repo"}}
    sparse = {"issue": {"id": 123, "title": "Bug#123"}}
    falsy = {"issue": {"id": 7, "number": 0, "title": None, "body": None}, "repository": {"full_name": "a/b"}}
    pull = {"pull_request": {"title": "x"}, "number": 9, "repository": {"full_name": "a/b"}}
    rows = _by_n(normalize.normalize_github(_frame(spark, [full, sparse, falsy, pull, "no json"]), run_timestamp(RUN)))
    r = rows[0]
    assert (r.external_key, r.repo, r.status, r.title, r.body, r.project) == ("org/repo#4", "org/repo", "open", "T", "B", None)
    assert r.created_at == dt.datetime(2024, 1, 1)
    assert rows[1].external_key == "123" and rows[1].created_at == dt.datetime(2025, 1, 1)
    assert (rows[2].external_key, rows[2].body, rows[2].title) == ("a/b#7", "", "")
    assert rows[3].external_key == "a/b#9" and rows[3].blank_title
    assert 4 not in rows


def test_jira_payload(spark):
    full = {"issue": {"id": "1", "key": "TEST-34", "fields": {
        "summary": "S", "description": "D", "project": {"key": "TEST"}, "status": {"name": "To Do"},
        "created": "2024-01-01T00:00:00.000+0000"}}}
    bare = {"id": 55, "fields": {}}
    rows = _by_n(normalize.normalize_jira(_frame(spark, [full, bare]), run_timestamp(RUN)))
    r = rows[0]
    assert (r.external_key, r.project, r.status, r.title, r.body, r.repo) == ("TEST-34", "TEST", "To Do", "S", "D", None)
    assert r.created_at == dt.datetime(2024, 1, 1)
    assert (rows[1].external_key, rows[1].title, rows[1].project) == ("55", "", None)


def test_archive_records(spark):
    records = [
        ("github", {"repo": "a/b", "number": 3, "id": "x", "labels": ["l"], "transitions": [{"to": "Closed"}]}),
        ("github", {"number": 3}), ("github", {"number": "3", "id": 8}), ("github", {"id": None}),
        ("jira", {"projectKey": "P", "number": 2, "transitions": [{"to": "Done"}, {"to": ""}]}), ("jira", {"number": 2}),
    ]
    df = spark.createDataFrame([(i, f, json.dumps(v)) for i, (f, v) in enumerate(records)], "n long, flavor string, value string")
    rows = _by_n(normalize.normalize_archive(df, run_timestamp(RUN)))
    assert [rows[i].external_key for i in range(6)] == ["a/b#3", "sandbox#3", "8", "None", "P-2", "jira"]
    assert [rows[i].status for i in (0, 1, 4, 5)] == ["Closed", "Open", "To Do", "To Do"]
    assert rows[0].labels == ["l"] and rows[1].labels == []


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_timestamps_do_not_depend_on_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    cases = {
        "2024-03-01T10:00:00Z": dt.datetime(2024, 3, 1, 10), "2024-03-01T10:00:00z": dt.datetime(2024, 3, 1, 10),
        "2024-03-01T10:00:00.123456+05:30": dt.datetime(2024, 3, 1, 4, 30, 0, 123456),
        "2024-03-01 10:00:00-0230": dt.datetime(2024, 3, 1, 12, 30), "2024-03-01T10:00:00": dt.datetime(2024, 3, 1, 10),
        "2024-03-01": dt.datetime(2024, 3, 1), "2024-03-01T10:30+01": dt.datetime(2024, 3, 1, 9, 30),
        "2024-03-10T02:30:00Z": dt.datetime(2024, 3, 10, 2, 30), "T10:00": None, "2024": None, "soon": None, "": None,
    }
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        df = spark.createDataFrame([(k,) for k in cases], "raw string").select("raw", utc_naive(F.col("raw")).alias("t"))
        assert {r.raw: r.t for r in df.collect()} == cases
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_signatures_and_events(spark):
    body = '{"issue": {"id": 1}}'
    good = "sha256=" + hmac.new(b"secret", body.encode(), hashlib.sha256).hexdigest()
    rows = [
        ("github", {"X-Hub-Signature-256": good, "X-GitHub-Event": "issues"}, body, 0),
        ("github", {"X-Hub-Signature-256": "sha256=bad", "X-GitHub-Event": "issues"}, body, 1),
        ("github", {"X-GitHub-Event": "push"}, body, 2),
        ("jira", {"X-Atlassian-Webhook-Identifier": "secret"}, body, 3),
        ("jira", {"X-Atlassian-Webhook-Identifier": "wrong"}, body, 4), ("jira", {}, body, 5),
    ]
    df = spark.createDataFrame(rows, DELIVERY)
    kept, rejected = normalize.authentic_deliveries(df, "secret", "secret")
    assert {r.arrival for r in kept.collect()} == {0, 3}
    assert {r.arrival for r in rejected.collect()} == {1, 2, 4, 5}
    open_jira, _ = normalize.authentic_deliveries(df, "secret", None)
    assert {r.arrival for r in open_jira.collect()} == {0, 3, 4, 5}
    assert {r.arrival for r in normalize.event_filter(df).collect()} == {0, 1, 3, 4, 5}


def test_embedding_text(spark):
    df = spark.createDataFrame([("Title", "Body"), (None, "  x \n"), ("t", None)], "title string, body string")
    out = [r[0] for r in df.select(embedding_text(F.col("title"), F.col("body"))).collect()]
    assert out == ["Title\n\nBody", "x", "t"]
