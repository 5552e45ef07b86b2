import math

import numpy as np
import duckdb
import pytest
from pyspark.sql import functions as F

from issuequarry.functions.stemming import stem
from issuequarry.functions.text import tokens
from issuequarry.operators import embed, evaluate, neighbors, search, text_search

ISSUES = "id long, source string, external_key string, title string, body string, repo string, project string, raw_json string"


def _vectors(spark, matrix, models=None):
    rows = [(i, (models or ["m"] * len(matrix))[i], [float(x) for x in v]) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, "issue_id long, model string, embedding array<float>")


def _brute(matrix, models, k, metric):
    matrix = np.asarray(matrix, dtype=np.float32).astype(float)
    out = set()
    for i, q in enumerate(matrix):
        cost = -(matrix @ q) if metric == "ip" else np.sqrt(((matrix - q) ** 2).sum(1))
        others = [j for j in range(len(matrix)) if j != i and models[j] == models[i]]
        others.sort(key=lambda j: (round(cost[j], 12), j))
        out |= {(i, j, rank + 1) for rank, j in enumerate(others[:k])}
    return out


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_exact_search_equals_brute_force_on_clusters_copies_and_ties(spark, metric):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((6, 8)) * 5
    matrix = np.vstack([
        centres[rng.integers(0, 6, 150)] + rng.standard_normal((150, 8)) * 0.2,
        np.tile(centres[0], (100, 1)),  # a third of all rows are copies of one vector
        rng.integers(0, 2, (50, 8)),  # many equal distances
    ])
    models = ["a" if i % 3 else "b" for i in range(300)]
    v = _vectors(spark, matrix, models)
    found = neighbors.exact_knn(
        v.withColumnRenamed("issue_id", "query_id"), v, 4, metric=metric, exclude_self=True, block_rows=16)
    got = {(r.query_id, r.issue_id, r.rank) for r in found.collect()}
    assert got == _brute(matrix, models, 4, metric)


def test_clusters_are_pruned(spark):
    rng = np.random.default_rng(2)
    matrix = np.repeat(rng.standard_normal((20, 8)) * 50, 40, axis=0) + rng.standard_normal((800, 8)) * 0.01
    v = _vectors(spark, matrix)
    points = neighbors.checkpointed(neighbors.distinct_vectors(v, 4), "points")
    routers = neighbors.exact_routers(points, 4, block_rows=8)
    blocks, n_blocks = neighbors._counted(neighbors.pack_vectors(points, routers, 4, 8), "blocks")
    routers = neighbors.learn_bounds(routers, blocks)
    chunks = neighbors.pack_queries(v.withColumnRenamed("issue_id", "query_id"), routers, 8)
    everything = n_blocks * chunks[1]
    met = neighbors.block_pairs(neighbors.probe_cells(chunks[0], routers), blocks).count()
    assert met < 0.35 * everything
    lasts = neighbors._home_lasts(blocks, n_blocks, chunks, 4, "l2")
    closer = neighbors.block_pairs(neighbors.probe_cells(chunks[0], routers, lasts), blocks).count()
    assert closer < 0.6 * met


def test_a_block_travels_once_per_row_of_the_grid(spark, monkeypatch):
    rng = np.random.default_rng(3)
    matrix = rng.standard_normal((240, 4))
    v = _vectors(spark, matrix)
    monkeypatch.setattr(neighbors, "TILE_ROWS", 4)
    points = neighbors.checkpointed(neighbors.distinct_vectors(v, 4), "points")
    routers = neighbors.exact_routers(points, 4, block_rows=8)
    blocks, n_blocks = neighbors._counted(neighbors.pack_vectors(points, routers, 4, 8), "blocks")
    routers = neighbors.learn_bounds(routers, blocks)
    chunks, n_chunks = neighbors.pack_queries(v.withColumnRenamed("issue_id", "query_id"), routers, 8)
    pairs = chunks.select("chunk_id").crossJoin(blocks.select("block_id")).withColumn("wants", F.lit(None).cast("array<int>"))
    work = neighbors.tiles(pairs, blocks, chunks, n_blocks, n_chunks)
    shipped = {r.id: r.n for r in work.filter("turn = 1").groupBy("id").agg(F.count("*").alias("n")).collect()}
    rows = chunks.select(F.floor(F.col("chunk_id") / 4)).distinct().count()
    assert len(shipped) == n_blocks and max(shipped.values()) <= rows < n_chunks
    assert work.filter("turn = 1").select(F.sum(F.size("looks"))).first()[0] == n_blocks * n_chunks
    found = neighbors.exact_knn(v.withColumnRenamed("issue_id", "query_id"), v, 3, exclude_self=True, block_rows=8)
    assert {(r.query_id, r.issue_id, r.rank) for r in found.collect()} == _brute(matrix, ["m"] * 240, 3, "l2")


def _mixed(spark):
    """Two models, one of them with two widths, a model that only asks, and vectors that have no distances."""
    rng = np.random.default_rng(8)
    rows = [(i, "ab"[i % 2], rng.standard_normal(6 if i % 4 == 1 else 3).tolist()) for i in range(90)]
    rows += [(100, "c", [1.0]), (101, "a", None), (102, "a", [1.0, None, 2.0]), (103, None, [0.0, 0.0, 0.0]), (104, "a", []), (105, "a", [float("nan")] * 3)]
    return rows, spark.createDataFrame(rows, "issue_id long, model string, embedding array<float>")


def test_models_of_several_widths_stay_apart(spark):
    rows, v = _mixed(spark)
    stored = v.filter("model <> 'c'")
    q = v.withColumnRenamed("issue_id", "query_id")
    want = set()
    usable = {i: (m, np.array(x, dtype=np.float32).astype(float)) for i, m, x in rows[:90]}
    for i, (m, x) in usable.items():
        near = sorted((round(float(np.linalg.norm(x - y)), 12), j) for j, (n, y) in usable.items() if n == m and len(x) == len(y) and i != j)
        want |= {(i, j, rank) for rank, (_, j) in enumerate(near[:3], 1)}
    got = neighbors.exact_knn(q, stored, 3, exclude_self=True, block_rows=4)
    assert {(r.query_id, r.issue_id, r.rank) for r in got.collect()} == want
    lists = neighbors.ivf_index(stored, lists=3, nprobe=3).search(q, 3, exclude_self=True)
    assert {(r.query_id, r.issue_id, r.rank) for r in lists.collect()} == want
    graph = neighbors.knn_graph(v, 3)
    assert {(r.issue_id, r.neighbor_id, r.rank) for r in graph.collect()} == want
    assert neighbors.projection_index(stored, width=100.0).search(q, 3, exclude_self=True).filter("query_id = 100").count() == 0


def test_proposals_for_issues_with_and_without_a_vector(spark):
    issues = spark.createDataFrame([
        (i, "github", f"o/r#{i}", f"title {i}", "", "o/r", None, "{}") for i in range(1, 7)], ISSUES)
    stored = spark.createDataFrame([
        (1, "m", [0.0, 0.0], 1), (2, "m", [0.0, 1.0], 1), (3, "hashing-4", [1.0, 0.0, 0.0, 0.0], 1),
    ], "issue_id long, model string, embedding array<float>, updated_at long")
    targets = search.issue_latest_vector(issues, stored, lambda df: embed.embed_corpus(df, "issue_id", dim=4), "hashing-4")
    rows = {r.issue_id: r for r in search.triage_propose(targets, stored, issues, 2).collect()}
    assert set(rows) == {1, 2, 3, 4, 5, 6}
    assert [s.issue_id for s in rows[1].similar] == [1, 2] and [s.issue_id for s in rows[4].similar] == [3]
    assert rows[4].labels == ["needs-triage"] and rows[4].similar[0].title == "title 3"


def test_fewer_vectors_than_k_and_none_at_all(spark):
    v = _vectors(spark, np.eye(3))
    q = v.withColumnRenamed("issue_id", "query_id")
    assert neighbors.exact_knn(q, v, 10, exclude_self=True).count() == 6
    assert neighbors.exact_knn(q, v.filter("issue_id < 0"), 10).count() == 0


def test_plan_has_no_pairing_of_everything(spark):
    v = _vectors(spark, np.random.default_rng(4).standard_normal((50, 4)))
    plan = neighbors.knn_graph(v, 3)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "WindowGroupLimit" in plan


def test_approximate_paths_find_most_neighbours_of_clusters(spark):
    rng = np.random.default_rng(5)
    matrix = np.repeat(rng.standard_normal((12, 16)), 20, axis=0) + rng.standard_normal((240, 16)) * 0.02
    v = _vectors(spark, matrix)
    q = v.withColumnRenamed("issue_id", "query_id")
    exact = neighbors.exact_knn(q, v, 5, exclude_self=True)
    for index in (neighbors.ivf_index(v, lists=12, nprobe=2), neighbors.projection_index(v, tables=6, projections=1, width=1.0)):
        found, share = index.search_with_cost(q, 5, exclude_self=True)
        assert neighbors.recall(found, exact, 5).first().recall > 0.9
        assert 0 < share.first().candidate_share
    graph = neighbors.knn_graph(v, 5, index=index)
    assert graph.count() == 240 * 5 and graph.filter("issue_id = neighbor_id").count() == 0


def _clustered(spark, n, dim=16):
    rng = np.random.default_rng(n)
    centres = rng.standard_normal((n // 20, dim))
    matrix = centres[rng.integers(0, len(centres), n)] + rng.standard_normal((n, dim)) * 0.05
    return _vectors(spark, np.vstack([matrix, matrix[:3], np.zeros((n // 4, dim))]))


def test_approximate_indexes_compare_a_falling_share(spark):
    shares = {"lists": [], "projections": []}
    for n in (400, 3200):
        v = _clustered(spark, n)
        q = v.withColumnRenamed("issue_id", "query_id")
        exact = neighbors.checkpointed(neighbors.exact_knn(q, v, 5, exclude_self=True), "exact")
        for name, index in (("lists", neighbors.ivf_index(v)), ("projections", neighbors.projection_index(v))):
            found, share = index.search_with_cost(q, 5, exclude_self=True)
            assert neighbors.recall(found, exact, 5).first().recall >= 0.9
            shares[name].append(share.first().candidate_share)
            if name == "lists":
                counts = index.packed[0].groupBy("cell").agg(F.sum("n").alias("n")).agg(F.max("n"), F.count("*")).first()
                assert counts[0] <= 2 * math.sqrt(n) + 3 and counts[1] >= 0.5 * math.sqrt(n)
    assert all(later < 0.7 * earlier for earlier, later in shares.values()), shares


def test_vector_search_scores_routes_and_urls(spark):
    issues = spark.createDataFrame([
        (1, "github", "org/repo#1", "A", "", "org/repo", None, "{}"),
        (2, "jira", "JIRA-2", "B", "", None, "proj", '{"site":"example"}'),
    ], ISSUES)
    v = spark.createDataFrame([(1, "m", [0.2, 0.0]), (2, "m", [0.0, 0.5]), (3, "m", [0.0, 0.1])],
                              "issue_id long, model string, embedding array<float>")
    q = spark.createDataFrame([(9, "m", [0.0, 0.0])], "query_id long, model string, embedding array<float>")
    rows = search.vector_search(q, v, issues, 10).orderBy("rank").collect()
    assert [(r.issue_id, round(r.score, 6), r.route, r.url) for r in rows] == [
        (1, 0.8, "/gh/org/repo/issues/1", "https://github.com/org/repo/issues/1"),
        (2, 0.5, "/jira/example/proj/JIRA-2", "https://proj.atlassian.net/browse/2"),
    ]


def test_hybrid_blend(spark):
    issues = spark.createDataFrame([
        (i, "github", f"o/r#{i}", t, "", "o/r", None, "{}") for i, t in ((1, "disk failure"), (2, "disk full"), (3, "other"))
    ], ISSUES)
    v = spark.createDataFrame([(1, "m", [1.0]), (3, "m", [0.0]), (7, "m", [0.0])], "issue_id long, model string, embedding array<float>")
    q = spark.createDataFrame([(1, "disk", "m", [0.0], 0.75)], "query_id long, text string, model string, embedding array<float>, alpha double")
    rows = {r.issue_id: r for r in search.hybrid_search(q, v, issues, 3).collect()}
    assert set(rows) == {1, 2, 3}
    assert rows[1].score == pytest.approx(0.5 * 0.75 + 0.1 * 0.25)
    assert rows[2].score == pytest.approx(0.1 * 0.25) and rows[3].score == pytest.approx(0.75)


def test_rerank_identity_and_reversal(spark):
    c = spark.createDataFrame([(1, 10, 1, 0.9), (1, 11, 2, 0.8)], "query_id long, issue_id long, rank long, score double")
    assert search.rerank(c).collect() == c.collect()
    turned = search.rerank(c, lambda pdf: -pdf["score"])
    assert {r.issue_id: r.rank for r in turned.collect()} == {11: 1, 10: 2}


def _rank_by_all_intervals(terms, positions):
    """Cover density from every interval of occurrences that is a shortest one."""
    places = sorted((p, t) for t, ps in zip(terms, positions) for p in ps)
    whole = set(terms)

    def holds(i, j):
        return {t for _, t in places[i:j + 1]} == whole

    total = 0.0
    for i in range(len(places)):
        for j in range(i, len(places)):
            smaller = (i < j) and (holds(i + 1, j) or holds(i, j - 1))
            if holds(i, j) and not smaller:
                total += 0.1 / (1 + (places[j][0] - places[i][0]) - (j - i))
    return total


def test_cover_density_against_all_intervals(spark):
    rng = np.random.default_rng(6)
    cases = []
    for n in range(60):
        pool = rng.permutation(40)[: rng.integers(3, 25)] + 1
        owner = rng.integers(0, 3, len(pool))
        cases.append([sorted(map(int, pool[owner == t])) or [41 + t] for t in range(int(rng.integers(1, 4)))])
    rows = [(i, [(str(t), ps) for t, ps in enumerate(c)]) for i, c in enumerate(cases)]
    df = spark.createDataFrame(rows, "n long, hits array<struct<term:string,positions:array<bigint>>>")
    got = {r.n: r.rank for r in df.select("n", text_search.cover_density(F.col("hits")).alias("rank")).collect()}
    for i, c in enumerate(cases):
        assert got[i] == pytest.approx(_rank_by_all_intervals([str(t) for t in range(len(c))], c))


def test_tokens(spark):
    cases = {
        "Well-known bug": ["well-known", "well", "known", "bug"], "ABC-42 v1.5": ["abc", "-42", "v1", "5"],
        "2024-01-02, 3.14": ["2024", "-01", "-02", "3.14"], "foo_bar a-b-c": ["foo", "bar", "a-b-c", "a", "b", "c"],
        "Élan -- 12abc": ["élan", "12abc"], "": [],
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.w for r in df.select("t", tokens(F.col("t")).alias("w")).collect()} == cases


def test_token_classes(spark):
    """The examples of the published parser documentation, then edges of each class."""
    url = "example.com/stuff/index.html"
    cases = {
        "foo-bar-beta1": ["foo-bar-beta1", "foo", "bar", "beta1"],
        f"http://{url}": [url, "example.com", "/stuff/index.html"], "http://example.com": ["example.com"],
        "/usr/local/fred.txt": ["/usr/local/fred.txt"], "usr/local/fred.txt": ["usr/local/fred.txt"],
        "-1.234e56 -1.234 -1234 1234 8.3.0": ["-1.234e56", "-1.234", "-1234", "1234", "8.3.0"],
        '<a href="dictionaries.html">&amp; on': ["on"],
        "Mail A_b-c.d@Mail.Example.com.": ["mail", "a_b-c.d@mail.example.com"], "x@y": ["x", "y"],
        "see org/repo at host:80 a.b host.de:80/p?q=1&r <z": [
            "see", "org/repo", "at", "host", "80", "a", "b", "host.de:80/p?q=1&r", "host.de:80", "/p?q=1&r", "z"],
        "~/notes.md ./run ../up 1.5ex 1.2.3.4 a_b": [
            "~/notes.md", "./run", "../up", "1.5", "ex", "1.2.3.4", "a", "b"],
        "well-known.example.org, end": ["well-known.example.org", "end"], "3 < 4 & 5": ["3", "4", "5"],
        "https://localhost/x": ["localhost/x"], "é/ü": ["é/ü"],
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: r.w for r in df.select("t", tokens(F.col("t")).alias("w")).collect()}
    assert got == cases
    con = duckdb.connect()
    from issuequarry.plans.oracle import _tokens
    for text, expected in cases.items():
        assert con.execute(f"SELECT {_tokens('t')} FROM (SELECT ?::VARCHAR AS t)", [text]).fetchone()[0] == expected


def test_long_chains_of_every_class(spark):
    n = 20_000
    chains = ["a-" * n + "a", "a." * n + "a", "1." * n + "1", "a/" * n + "a", "a_" * n, "x@" * n, "&" * n, "<a" * n, ".e" * n]
    df = spark.createDataFrame(list(enumerate(chains)), "k int, t string").repartition(len(chains))
    sizes = {r.k: r.n for r in df.select("k", F.size(tokens(F.col("t"))).alias("n")).collect()}
    assert sizes == {0: n + 2, 1: n + 1, 2: 1, 3: 1, 4: n, 5: n, 6: 0, 7: n, 8: n}


def test_a_host_is_found_by_its_name_and_keeps_its_form(spark):
    issues = spark.createDataFrame([
        (1, "Timeouts", "see https://status.example.com/incidents/7 for details"),
        (2, "example", "status com"), (3, "Hosts", "status.example.com answers beta1s"),
    ], "id long, title string, body string")
    q = spark.createDataFrame([(1, "status.example.com"), (2, "/incidents/7"), (3, "details")], "query_id long, text string")
    rows = {(r.query_id, r.issue_id) for r in text_search.text_search(issues, q).collect()}
    assert rows == {(1, 1), (1, 3), (2, 1), (3, 1)}
    index = {(r.term, r.issue_id): r.positions for r in text_search.text_index(issues).collect()}
    assert index[("status.example.com", 1)] == [4] and index[("detail", 1)] == [7] and ("beta1s", 3) in index


def test_text_search_stems_and_drops_stop_words(spark):
    issues = spark.createDataFrame([
        (1, "The failing connections", "were failing again"), (2, "Connected once", ""), (3, "the of", "and"),
    ], "id long, title string, body string")
    q = spark.createDataFrame([(1, "connection fails"), (2, "the of and"), (3, "connect")], "query_id long, text string")
    rows = {(r.query_id, r.issue_id) for r in text_search.text_search(issues, q).collect()}
    assert rows == {(1, 1), (3, 1), (3, 2)}
    index = {(r.term, r.issue_id): r.positions for r in text_search.text_index(issues).collect()}
    assert index[("fail", 1)] == [2, 5] and index[("connect", 1)] == [3] and ("the", 1) not in index
    assert {r.id for r in text_search.matching_issue_ids(issues, "failing").collect()} == {1}


@pytest.mark.parametrize("word,expected", [
    ("consigned", "consign"), ("generously", "generous"), ("knightly", "knight"), ("happy", "happi"), ("cried", "cri"),
    ("ties", "tie"), ("hopping", "hop"), ("hoping", "hope"), ("relational", "relat"), ("databases", "databas"),
    ("generate", "generat"), ("organization", "organ"), ("skies", "sky"), ("dying", "die"), ("gas", "gas"),
    ("agreed", "agre"), ("say", "say"), ("roll", "roll"), ("by", "by"), ("proceed", "proceed"), ("news", "news"),
])
def test_stems(word, expected):
    assert stem(word) == expected


def test_encoders(spark):
    texts = spark.createDataFrame([(1, "a", "b b"), (2, None, None)], "id long, title string, body string")
    rows = {r.issue_id: r.embedding for r in embed.embed_corpus(texts).collect()}
    assert len(rows[1]) == 384 and np.linalg.norm(rows[1]) == pytest.approx(1, abs=1e-6) and not any(rows[2])

    def three():
        return lambda batch: np.array([[len(t), 0, 0] for t in batch])

    got = embed.embed_corpus(texts, make_encoder=three, dim=3).filter("issue_id = 1").first().embedding
    assert got == [1.0, 0.0, 0.0]
    with pytest.raises(Exception, match="expected"):
        embed.embed_corpus(texts, make_encoder=three, dim=4).collect()
    with pytest.raises(Exception, match="expected 4 dimensions"):
        embed.require_dimension(spark.createDataFrame([([1.0, 2.0],)], "embedding array<float>"), 4).collect()


def test_duplicate_metrics(spark):
    near = spark.createDataFrame([
        (1, 10, 1, 0.9), (1, 11, 2, 0.8), (1, 12, 3, 0.7),
        (2, 20, 1, 0.9), (2, 21, 2, 0.8), (2, 22, 3, 0.7),
        (3, 30, 1, 0.5), (3, 31, 2, 0.5), (3, 32, 3, 0.1),
        (4, 40, 1, 0.9), (5, 50, 1, 0.9),
    ], "issue_id long, neighbor_id long, rank long, similarity double")
    truth = spark.createDataFrame([(1, 10), (2, 22), (3, 31), (4, 99), (5, None)], "id long, duplicate_of long")
    m = evaluate.duplicate_metrics(near, truth, 3).first()
    tied = (1 + 1 / np.log2(3)) / 2
    assert m["count"] == 4 and m.hit_rate == pytest.approx(0.75) and m.p_at_k == pytest.approx(0.25)
    assert m.ndcg == pytest.approx((1 + 0.5 + tied + 0) / 4)
    strict = evaluate.duplicate_metrics(near, truth, 3, strict_reference=True).first()
    assert strict["count"] == 5 and strict.hit_rate == pytest.approx(0.6)
