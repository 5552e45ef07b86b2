import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from issuequarry.functions import routes as R
from issuequarry.operators import search, viewer

SCHEMA = ("id long, source string, external_key string, title string, body string, repo string, project string, "
          "status string, created_at timestamp_ntz, raw_json string")


def _issue(i, source="github", key=None, repo="o/r", project=None, raw=None, body="", status="Open"):
    text = raw if isinstance(raw, str) else json.dumps(raw or {})
    return (i, source, f"o/r#{i}" if key is None else key, f"t{i}", body, repo, project, status,
            dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), text)


def _routes(spark, rows):
    return {r.id: r for r in viewer.canonical_routes(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_routes(spark):
    rows = _routes(spark, [
        _issue(1), _issue(2, repo="plain"), _issue(3, repo=None, key="9", raw={"repository": {"full_name": "a/b/c"}, "number": 5}),
        _issue(4, repo=None, raw={"repository": {"name": "solo"}}), _issue(5, repo=None, raw={"repo": "x/y"}),
        _issue(6, repo=None), _issue(7, key="none", raw={"issue": {"id": "77"}}), _issue(8, key="o/r#abc"),
        _issue(9, source="gitlab"), _issue(10, key="o/r# 12 "), _issue(11, raw="not json"),
    ])
    assert [rows[i].route for i in range(1, 12)] == [
        "/gh/o/r/issues/1", "/gh/sandbox/plain/issues/2", "/gh/a/b/c/issues/5", "/gh/sandbox/solo/issues/4",
        "/gh/x/y/issues/5", "/gh/sandbox/unknown/issues/6", "/gh/o/r/issues/77", None, None, "/gh/o/r/issues/12",
        "/gh/o/r/issues/11",
    ]
    jira = dict(source="jira", repo=None)
    rows = _routes(spark, [
        _issue(1, key="P-1", raw={"issue": {"self": "https://Acme.atlassian.net/rest/1"}}, **jira),
        _issue(2, key="P-2", raw={"issue": {"self": "nonsense", "url": "http://u:p@jira.corp.example:8443/x"}}, **jira),
        _issue(3, key="P-3", project="Q", raw={"self": "https://top.example/1", "site": "s"}, **jira),
        _issue(4, key="P-4", raw={"site": "s"}, **jira), _issue(5, key="", raw={"site": "s"}, **jira), _issue(6, key="P6", **jira),
    ])
    assert [rows[i].route for i in range(1, 7)] == [
        "/jira/acme/P/P-1", "/jira/jira/P/P-2", "/jira/top/Q/P-3", "/jira/s/P/P-4", None, "/jira/sandbox/P6/P6"]


def test_result_urls(spark):
    jira = dict(source="jira", repo=None)
    rows = [
        _issue(1), _issue(2, key="x"), _issue(3, raw={"issue": {"url": "U"}, "html_url": "H"}), _issue(4, raw={"html_url": "H"}),
        _issue(5, key="JIRA-2", project="proj", **jira), _issue(6, key="PROJ-2", project="proj", **jira),
        _issue(7, key="K-1", project=None, **jira), _issue(8, repo=None, key="o/r#1"),
    ]
    got = {r.id: r.url for r in viewer.result_urls(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[i] for i in range(1, 9)] == [
        "https://github.com/o/r/issues/1", "https://github.com/o/r/issues/2", "U", "H",
        "https://proj.atlassian.net/browse/5", "https://proj.atlassian.net/browse/PROJ-2", None, None]


@pytest.mark.parametrize("text,fragment", [
    ("See https://github.com/a/b/issues/5", '<a href="/gh/a/b/issues/5"'),
    ("https://x.atlassian.net/browse/ABC-42 fix", '<a href="/jira/x/ABC/ABC-42"'),
    ("Visit https://example.com/docs", 'rel="nofollow noopener noreferrer"'),
    ("(https://example.com/a?b=1&c=2).", "a?b=1&amp;c=2</a>)."),
])
def test_links(spark, text, fragment):
    df = spark.createDataFrame([(text,)], "t string")
    assert fragment in df.select(R.render_body(F.col("t")).alias("h")).first().h


def test_rendering(spark):
    cases = {
        "": "", " \n ": "<p></p>", "a": "<p>a</p>", "a\nb": "<p>a<br />\nb</p>", "a\n \n\nb": "<p>a</p><p>b</p>",
        "\n\n  a\n": "<p>  a</p>", "a\r\n\r\nb\rc": "<p>a</p><p>b<br />\nc</p>", "<i>'\"&": "<p>&lt;i&gt;&#x27;&quot;&amp;</p>",
        "a  b": "<p>a</p><p>b</p>", "https://": "<p>https://</p>",
        "https://e.io/x<b>": '<p><a href="https://e.io/x" rel="nofollow noopener noreferrer">https://e.io/x</a>&lt;b&gt;</p>',
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.h for r in df.select("t", R.render_body(F.col("t")).alias("h")).collect()} == cases


def test_payload_projections(spark):
    raws = [
        {"labels": ["b", {"name": " a "}, {"label": "c"}, 5, "", {"x": 1}], "priority": {"value": " P "}, "seed": 1,
         "generation": {"time": "T"}, "comments": [{"body": "x", "author": {"login": "l"}, "at": "2024-01-01T00:00:00+01:00"}, "skip"]},
        {"issue": {"labels": ["z"], "comments": [{"body": None, "user": "me"}], "fields": {"priority": {"name": "H"}}}, "priority": " "},
        {"issue": {"fields": {"comment": {"comments": []}}}, "generatedAt": 5, "generation": {"seed": "s"}},
    ]
    issues = spark.createDataFrame([_issue(i, raw=r) for i, r in enumerate(raws)], SCHEMA)
    labels = spark.createDataFrame([(0, " a"), (0, None), (2, "t"), (2, "t")], "issue_id long, label string")
    assert {r.id: r.labels for r in viewer.issue_labels(issues, labels).collect()} == {0: ["a", "b", "c"], 1: ["z"], 2: ["t"]}
    assert {r.id: r.priority for r in viewer.issue_priority(issues).collect()} == {0: "P", 1: "H", 2: None}
    assert {r.id: r.determinism for r in viewer.provenance_banner(issues).collect()} == {
        0: "Synthetic. Seed: 1. Generated: T. Source: github.", 1: "Synthetic. Source: github.",
        2: "Synthetic. Seed: s. Generated: 5. Source: github."}
    rows = {(r.id, r.pos): r for r in viewer.comments_exploded(issues).collect()}
    assert set(rows) == {(0, 0), (1, 0), (2, None)}
    assert (rows[0, 0].author, rows[0, 0].body, rows[0, 0].body_html) == ("l", "x", "<p>x</p>")
    assert rows[0, 0].created_at == dt.datetime(2023, 12, 31, 23) and (rows[1, 0].author, rows[1, 0].body) == ("me", "")


def test_label_filter_narrows_and_strict_drops(spark):
    issues = spark.createDataFrame([_issue(1), _issue(2)], SCHEMA)
    labels = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b")], "issue_id long, label string")
    loose = viewer.issues_left_labels(issues, labels, ["a"]).collect()
    assert {r.id: r.labels for r in loose} == {1: ["a"], 2: []}
    strict = viewer.issues_left_labels(issues, labels, ["a"], strict_labels=True).collect()
    assert {r.id: r.labels for r in strict} == {1: ["a"]}


def test_facet_search_limits_before_dropping_unroutable(spark):
    rows = [_issue(i, key="x" if i == 5 else None, raw={"priority": "P1"} if i % 2 else {}) for i in range(1, 7)]
    issues = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(6, "a")], "issue_id long, label string")
    found = viewer.viewer_search(issues, labels, limit=3).collect()
    assert sorted(r.id for r in found) == [4, 6] and {r.id: r.labels for r in found}[6] == ["a"]
    assert [r.id for r in viewer.viewer_search(issues, labels, priorities=["P1"], limit=2).collect()] == [3]
    ids = spark.createDataFrame([(1,), (2,)], "id long")
    assert {r.id for r in viewer.viewer_search(issues, labels, matching_ids=ids, sources=["github"]).collect()} == {1, 2}


def test_facets_compare_priorities_by_their_stored_text(spark):
    stated = [
        ("P1", "P1"), ({"name": "High"}, '{"name": "High"}'), ({"value": "x,y:\"z", "id": 3}, '{"id": 3, "value": "x,y:\\"z"}'),
        ({"bb": [1, {"k": None}], "a": True, "": {}}, '{"": {}, "a": true, "bb": [1, {"k": null}]}'), ([1, "a,b"], '[1, "a,b"]'),
        (5, "5"), (False, "false"), (None, ""),
    ]
    issues = spark.createDataFrame([_issue(i, key=f"o/r#{i}", raw={"priority": p}) for i, (p, _) in enumerate(stated)], SCHEMA)
    labels = spark.createDataFrame([], "issue_id long, label string")
    for i, (_, text) in enumerate(stated):
        assert [r.id for r in viewer.viewer_search(issues, labels, priorities=[text]).collect()] == [i], text


def test_lookup_by_route(spark):
    issues = spark.createDataFrame([_issue(7, key="r#5"), _issue(3, key="o/r#5"), _issue(4, "jira", "P-1", None, "P")], SCHEMA)
    labels = spark.createDataFrame([(3, "a")], "issue_id long, label string")
    asked = spark.createDataFrame([("/gh/o/r/issues/5",), ("gh/o/r/issues/5/extra",), ("/jira/any/where/P-1",),
                                   ("/gh/missing/repo/issues/42",), ("/what",)], "route string")
    rows = {r.route: r for r in viewer.issues_by_route(asked, issues, labels).collect()}
    assert len(rows) == 5
    assert rows["/gh/o/r/issues/5"].id == 3 and rows["/gh/o/r/issues/5"].labels == ["a"]
    assert rows["gh/o/r/issues/5/extra"].id == 3 and rows["/jira/any/where/P-1"].id == 4
    assert {k for k, r in rows.items() if r.lookup == "route not found"} == {"/gh/missing/repo/issues/42", "/what"}


def test_link_edges(spark):
    issues = spark.createDataFrame([_issue(1, body="https://github.com/o/r/issues/2, http://e.io"), _issue(2)], SCHEMA)
    links = viewer.link_rewrites(issues, viewer.distinct_routes(issues))
    assert {(r.id, r.href, r.internal, r.target_id) for r in links.collect()} == {
        (1, "/gh/o/r/issues/2", True, 2), (1, "http://e.io", False, None)}
    assert [(r.target_id, r.in_links) for r in viewer.in_link_counts(links).collect()] == [(2, 1)]


def test_writeback_plan(spark):
    issues = spark.createDataFrame([
        _issue(1, raw={"issue": {"number": 2}}, repo="org/repo"), _issue(2, "jira", "K-1", None, "K", {"issue": {"key": "K-1"}}),
        _issue(3, raw={}), _issue(4, "jira", "K-2", None, "K", {}), _issue(5, raw="{broken"),
    ], SCHEMA)
    asks = spark.createDataFrame([
        (1, 1, ["bug"], "user", "body", None), (2, 2, ["bug"], "aUserID", "c", "jira"), (3, 3, [], None, "x", None),
        (4, 4, [], None, "x", None), (5, 5, [], None, "x", None), (6, 99, [], None, "x", None), (7, 1, [], None, "x", "jira"),
        (8, 1, [], None, None, None),
    ], "approval_id long, issue_id long, labels array<string>, assignee string, comment string, source string")
    rows = search.writeback_plan(asks, issues, "https://j").orderBy("approval_id", "seq").collect()
    plan = {}
    for r in rows:
        plan.setdefault(r.approval_id, []).append((r.action, r.method, r.path, r.payload) if r.action else r.status)
    assert plan == {
        1: [("add_labels", "POST", "/repos/org/repo/issues/2/labels", '{"labels":["bug"]}'),
            ("assign", "POST", "/repos/org/repo/issues/2/assignees", '{"assignees":["user"]}'),
            ("comment", "POST", "/repos/org/repo/issues/2/comments", '{"body":"body"}')],
        2: [("assign", "PUT", "/rest/api/3/issue/K-1/assignee", '{"accountId":"aUserID"}'),
            ("comment", "POST", "/rest/api/3/issue/K-1/comment", '{"body":"c"}')],
        3: ["missing repo or number"], 4: ["missing jira key"], 5: ["stored issue payload is not valid JSON"],
        6: ["issue not found"], 7: ["source mismatch"], 8: ["ok"],
    }
    no_base = search.writeback_plan(asks.filter("approval_id = 2"), issues, None).first()
    assert no_base.status == "jira base url missing"
