"""Stored postings against an index made anew, through appends, replacements, removals and compaction; and its plan."""

import contextlib
import io
import os

from issuequarry.operators import text_search
from issuequarry.operators.postings_index import PostingsIndex
from issuequarry.session import checkpointed

ISSUES = "id long, title string, body string"


def _issues(spark, held):
    return spark.createDataFrame([(i, t, b) for i, (t, b) in held.items()], ISSUES)


def _queries(spark):
    texts = ["disk failure", "disk", "the", "network well-known card", "full disk full", "nothing like it", "common", ""]
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


def _same(spark, index, held):
    fresh = text_search.text_search(_issues(spark, held), _queries(spark), 4, index.stemmed)
    stored = text_search.text_search(None, _queries(spark), 4, index=index)
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, fresh.collect()))
    postings = text_search.text_index(_issues(spark, held), index.stemmed)
    assert sorted(map(tuple, index.all_postings().collect())) == sorted(map(tuple, postings.collect()))
    return fresh.count()


def test_what_is_stored_is_what_is_there(spark, tmp_path):
    words = ["disk", "failure", "network", "card", "full", "well-known", "failing", "the", "of"]
    held = {i: (f"{words[i % 9]} common", " ".join(words[(i * j) % 9] for j in range(i % 7 + 1))) for i in range(60)}
    held |= {60: (None, None), 61: ("", ""), 62: ("disk", None), 63: ("é ünï", "disk full " * 400)}
    index = PostingsIndex(spark, str(tmp_path), stemmed=True, buckets=3)
    assert text_search.text_search(None, _queries(spark), 4, index=index).count() == 0
    index.append(_issues(spark, held))
    changed = {5: ("disk failure", "now"), 6: ("gone", ""), 70: ("network card", "well-known disk")}
    out = [0, 1, 2, 63, 999]
    for _ in range(2):
        index.append(_issues(spark, changed), spark.createDataFrame([(i,) for i in out], "issue_id long"), version=2)
    now = {i: x for i, x in (held | changed).items() if i not in out}
    assert _same(spark, index, now) > 0
    index.compact(version=3)
    now[1] = ("disk", "is back")
    index.append(_issues(spark, {1: now[1]}))
    _same(spark, index, now)


def test_a_search_reads_the_folders_of_its_terms_and_no_texts(spark, tmp_path):
    words = [f"word{k}" for k in range(300)]
    held = {i: (words[i], " ".join(words[i : i + 20])) for i in range(280)}
    index = PostingsIndex(spark, str(tmp_path), stemmed=False, buckets=16)
    index.append(_issues(spark, held))
    files = sorted(os.listdir(tmp_path))
    q = spark.createDataFrame([(1, "word7 word9")], "query_id long, text string")
    found = text_search.text_search(None, q, 5, index=index)
    plan = io.StringIO()
    with contextlib.redirect_stdout(plan):
        found.explain("formatted")
    scans = [line for line in plan.getvalue().splitlines() if line.startswith("PartitionFilters")]
    assert sum("bucket" in line for line in scans) >= 2
    assert "body" not in plan.getvalue() and "CartesianProduct" not in plan.getvalue()
    assert {r.issue_id for r in found.collect()} == {0, 1, 2, 3, 4}
    assert sorted(os.listdir(tmp_path)) == files


def test_blocks_below_the_kth_score_are_skipped(spark, tmp_path, monkeypatch):
    """Equal rows to the full rank with ties, several segments and stale peaks; most blocks are never matched."""
    monkeypatch.setattr(text_search, "BLOCK_BITS", 2)
    monkeypatch.setattr(text_search, "FIRST_BLOCKS", 2)

    def body(i):
        often = 30 if i in (17, 18, 19, 60, 61, 90) else 1 + i % 3
        return "disk failure " * often + "filler " * (i % 5) + ("card " * (i % 4))

    held = {i: (f"title {i}", body(i)) for i in range(-8, 120)}
    index = PostingsIndex(spark, str(tmp_path), stemmed=False, buckets=4)
    index.append(_issues(spark, held))
    changed = {18: ("quiet", "disk"), 200: ("new", "failure disk " * 25), 201: ("same", "failure disk " * 25)}
    index.append(_issues(spark, changed))
    held |= changed
    texts = ["disk", "disk failure", "card disk failure", "title", "absent disk", "quiet"]
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
    for k in (1, 4, 300):
        full = text_search.text_search(_issues(spark, held), queries, k, False)
        assert sorted(map(tuple, text_search.text_search(None, queries, k, index=index).collect())) == sorted(map(tuple, full.collect()))
    terms = text_search.query_terms(queries, False)
    reach = text_search.block_reach(index.blocks(terms)[1], terms)
    ranked = text_search.text_search(_issues(spark, held), queries, 300, False)
    bounded = ranked.withColumn("block", text_search.block_of(ranked.issue_id)).join(reach, ["query_id", "block"], "left")
    assert bounded.filter("reach is null or text_score > reach + 1e-9").count() == 0
    best = text_search.text_search(_issues(spark, held), queries, 4, False)
    left = text_search.blocks_left(reach, reach.limit(0), best, 4).groupBy("query_id").count().collect()
    kept, whole = {r.query_id: r["count"] for r in left}, {r.query_id: r["count"] for r in reach.groupBy("query_id").count().collect()}
    assert whole[0] > 30 and kept[0] <= 6 and kept[1] <= 6 and kept[3] == whole[3]


def test_words_are_grouped_where_their_documents_stand(spark, monkeypatch):
    """Ids in several rows and null ids give one posting per term; no word is a row, whatever the size of a batch."""
    words = ["disk", "failure", "the", "failing", "well-known", "full"]
    rows = [(i % 9 or None, f"{words[i % 6]} common", " ".join(words[(i * j) % 6] for j in range(i % 5))) for i in range(60)]
    issues = spark.createDataFrame([*rows, (77, None, None), (78, "a", "a")], ISSUES)
    for stemmed in (False, True):
        content = text_search.document_text(issues.title, issues.body)
        one_by_one = text_search.positioned_terms(issues, "id", content, stemmed).collect()
        want = {}
        for row in one_by_one:
            want.setdefault((row.term, row.id), []).append(row.pos)
        for grouped, records in ((1 << 18, 10_000), (3, 4)):
            monkeypatch.setattr(text_search, "GROUPED_WORDS", grouped)
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
            index = text_search.text_index(issues, stemmed)
            found = index.collect()
            assert len(found) == len(want) and {(r.term, r.issue_id): r.positions for r in found} == {k: sorted(v) for k, v in want.items()}
            plan = index._jdf.queryExecution().executedPlan().toString()
            assert "Aggregate" not in plan and "Generate" not in plan
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_common_terms_are_looked_up_for_few_candidates(spark, tmp_path):
    """More terms than ``RAREST``, all but the rarest held by many issues; postings of one segment meet no mask and are not shuffled to be matched."""
    held = {i: (f"a{i % 2} b{i % 3} c{i % 4}", f"d{i % 5} e{i % 6} everywhere always") for i in range(240)}
    index = PostingsIndex(spark, str(tmp_path), stemmed=False, buckets=4)
    index.append(_issues(spark, held))
    texts = ["a1 b1 c1 d1 e1 everywhere always", "a1 b1 c1 d1 e2", "everywhere", "everywhere always a0", "a0 absent everywhere always", "c3 d4"]
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
    terms = checkpointed(text_search.query_terms(queries, False), "terms")
    postings, frequency = index.lookup(terms)
    found = text_search.text_match(postings, terms, frequency)
    words = {i: set(f"{t} {b}".split()) for i, (t, b) in held.items()}
    want = {(q, i) for q, t in enumerate(texts) for i, w in words.items() if set(t.split()) <= w}
    assert {(r.query_id, r.issue_id) for r in found.collect()} == want and len(want) > 240
    assert all(len(r.hits) == r.n_terms for r in found.collect())
    assert "/gone/" not in postings._jdf.queryExecution().toString() and "_gone" not in postings._jdf.queryExecution().toString()
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert sum(r.df for r in index.blocks(terms)[1].filter("term = 'everywhere'").collect()) == 240
