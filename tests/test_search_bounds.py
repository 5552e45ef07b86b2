"""What a tile of the exact search offers to its queries: no more than they may keep, and nothing beyond a known bound."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from issuequarry.operators import neighbors

KEEP = 4


def _best(points, metric="l2", lasts=None):
    keys = np.arange(len(points))
    return neighbors._Best(SimpleNamespace(space="s", h1s=keys, h2s=keys, mat=points.tobytes(), lasts=lasts), KEEP, metric)


def _block(points, first, metric="l2", dead=None):
    sizes = np.ones(len(points), dtype=np.int32)
    row = SimpleNamespace(mat=points.tobytes(), ids=first + np.arange(len(points)), sizes=sizes, dead=dead)
    return neighbors._Block(row, metric)


def _merged(monkeypatch):
    """Numbers of candidates handed to a merge."""
    seen, merge = [], neighbors._Best._merge

    def counted(self, rows, cost, ids):
        seen.append(len(rows))
        merge(self, rows, cost, ids)

    monkeypatch.setattr(neighbors._Best, "_merge", counted)
    return seen


def _brute(points, blocks, metric):
    every = np.vstack(blocks).astype(np.float64)
    inner = points.astype(np.float64) @ every.T
    cost = -inner if metric == "ip" else np.sqrt(((points[:, None].astype(np.float64) - every[None]) ** 2).sum(2))
    return np.argsort(np.round(cost, 10), axis=1, kind="stable")[:, :KEEP]


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_a_nearer_block_offers_no_more_than_is_kept(monkeypatch, metric):
    draw = np.random.default_rng(7)
    points = (draw.standard_normal((64, 8)) + 5).astype(np.float32)
    # Every vector of a later block beats all of the block before it.
    blocks = [(draw.standard_normal((256, 8)) + far).astype(np.float32) for far in (-60, -30, 5 if metric == "l2" else 60)]
    seen, best = _merged(monkeypatch), _best(points, metric)
    for n, block in enumerate(blocks):
        best.offer(_block(block, 256 * n, metric))
    assert max(seen) <= 2 * KEEP * len(points)
    assert best.ids.reshape(-1, KEEP).tolist() == _brute(points, blocks, metric).tolist()


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_a_known_bound_keeps_out_what_lies_beyond_and_lets_ties_in(monkeypatch, metric):
    points = np.eye(8, dtype=np.float32)
    far, equal = points[::-1] * (9 if metric == "l2" else 0), points.copy()
    known = np.full(8, np.sqrt(2.0) if metric == "l2" else 0.0)
    seen, best = _merged(monkeypatch), _best(points, metric, [np.full(8, np.inf), known])
    if metric == "l2":
        best.offer(_block(far, 100, metric))
        assert seen == []
    best.offer(_block(equal, 0, metric))
    assert best.ids.reshape(-1, KEEP).tolist() == _brute(points, [equal], metric).tolist()


def test_only_wanted_queries_and_living_places_count():
    draw = np.random.default_rng(3)
    points = draw.standard_normal((32, 8)).astype(np.float32)
    best = _best(points[:8])
    best.offer(_block(points, 0, dead=[0, 1]), np.array([1, 5]))
    assert set(best.rows.tolist()) == {1, 5} and not {0, 1} & set(best.ids.tolist())
    assert best.ids[best.rows == 5][0] == 5


def test_tiles_start_with_the_bound_of_their_chunks(spark):
    draw = np.random.default_rng(5)
    rows = [(n, "m", v.tolist()) for n, v in enumerate(draw.standard_normal((200, 4)).astype(np.float32))]
    vectors = spark.createDataFrame(rows, "issue_id long, model string, embedding array<float>")
    queries = vectors.withColumnRenamed("issue_id", "query_id")
    points = neighbors.distinct_vectors(vectors, KEEP)
    routers = neighbors.exact_routers(points, KEEP, block_rows=16)
    blocks, n_blocks = neighbors._counted(neighbors.pack_vectors(points, routers, KEEP, 16), "blocks")
    routers = neighbors.learn_bounds(routers, blocks)
    chunks = neighbors.pack_queries(queries, routers, 16)
    lasts = neighbors._home_lasts(blocks, n_blocks, chunks, KEEP, "l2")
    pairs = neighbors.block_pairs(neighbors.probe_cells(chunks[0], routers, lasts), blocks)
    asked = neighbors.tiles(pairs, blocks, chunks[0], n_blocks, chunks[1], lasts=lasts)
    known = asked.filter("turn = 0").select("lasts").collect()
    assert known and all(len(r.lasts[0]) and np.isfinite(neighbors._least(r.lasts)).all() for r in known)


def test_few_rows_of_a_tile_are_python_objects_at_once():
    looks = [[{"chunk_id": c, "wants": [c]} for c in range(40)]] * (5 * neighbors.SLICE_ROWS + 3)
    batch = pa.record_batch({"id": pa.array(range(len(looks))), "looks": pa.array(looks)})
    parts = [p for p in neighbors._slices(iter([batch.slice(7), batch.slice(0, 0)]))]
    assert max(map(len, parts)) <= neighbors.SLICE_ROWS
    assert [i for p in parts for i in p["id"]] == list(range(7, len(looks)))
    assert list(parts[-1]["looks"].iloc[-1][39]["wants"]) == [39]


def _scattered(spark):
    """Vectors in 160 far cells, so that no chunk of queries holds more than a few; indexed by projections."""
    draw = np.random.default_rng(11)
    points = np.repeat(draw.standard_normal((160, 4)) * 50, 3, axis=0) + draw.standard_normal((480, 4)) * 0.01
    rows = [(n, "ab"[n % 2], v.tolist()) for n, v in enumerate(points.astype(np.float32))]
    vectors = spark.createDataFrame(rows, "issue_id long, model string, embedding array<float>")
    return vectors, vectors.withColumnRenamed("issue_id", "query_id"), neighbors.projection_index(vectors, tables=2, projections=3, width=5.0, nearby=2)


def test_small_chunks_share_a_row_of_the_grid_and_a_look_at_a_block(spark, monkeypatch):
    vectors, queries, index = _scattered(spark)
    chunks = neighbors.pack_queries(queries, index.routers, 16)
    assert chunks[1] > 2 * neighbors.TILE_ROWS
    pairs = neighbors.block_pairs(neighbors.probe_cells(chunks[0], index.routers), index.packed[0])
    work = neighbors.tiles(pairs, index.packed[0], chunks[0], index.packed[1], chunks[1])
    columns = work.select(*(c for c, kind in work.dtypes if kind != "void")).collect()
    blocks = [r.id for r in columns if r.turn == 1]
    assert len(blocks) == len(set(blocks)) < pairs.count()
    seen, offer = [], neighbors._Best.offer
    monkeypatch.setattr(neighbors._Best, "offer", lambda self, block, wants=None: (seen.append(len(wants)), offer(self, block, wants))[1])
    tiles = list(neighbors._searched(iter(work.toArrow().to_batches()), 3, "l2"))
    assert len(seen) == len(blocks) and sum(seen) == pairs.selectExpr("sum(cn)").first()[0]
    assert sum(len(list(t.lasts())) for t in tiles) == sum(r.turn == 0 for r in columns)


def test_chunks_that_mean_all_their_queries_and_some_that_name_them_meet_the_same_block(spark):
    draw = np.random.default_rng(13)
    points = draw.standard_normal((24, 4)).astype(np.float32)
    keys = np.arange(8)
    chunks = [SimpleNamespace(id=40 + n, space="s", h1s=keys, h2s=keys + 8 * n, mat=points[8 * n:8 * n + 8].tobytes(), lasts=None) for n in range(3)]
    tile = neighbors._Tile(chunks, KEEP, "l2")
    looks = pa.array([None, [], [{"chunk_id": 42, "wants": [7, 0]}, {"chunk_id": 40, "wants": None}]], pa.list_(pa.struct({"chunk_id": pa.int64(), "wants": pa.list_(pa.int32())})))
    tile.look(_block(points, 0), *neighbors._Looks(looks.slice(1)).at(1))
    (best,) = tile.bests
    assert sorted(set(best.rows.tolist())) == [*range(8), 16, 23]
    assert best.ids.reshape(-1, KEEP).tolist() == _brute(points[[*range(8), 16, 23]], [points], "l2").tolist()


def test_every_tile_is_a_task_of_its_own(spark):
    draw = np.random.default_rng(17)
    rows = [(n, "m", v.tolist()) for n, v in enumerate(draw.standard_normal((400, 4)).astype(np.float32))]
    vectors = spark.createDataFrame(rows, "issue_id long, model string, embedding array<float>")
    index = neighbors.ivf_index(vectors, lists=20, nprobe=20)
    chunks = neighbors.pack_queries(vectors.withColumnRenamed("issue_id", "query_id"), index.routers, 16)
    pairs = neighbors.block_pairs(neighbors.probe_cells(chunks[0], index.routers), index.packed[0])
    work = neighbors.tiles(pairs, index.packed[0], chunks[0], index.packed[1], chunks[1])
    tiles = work.selectExpr("spark_partition_id() AS task", "tile_row", "tile_column").distinct().collect()
    assert len(tiles) > 8 and len({t.task for t in tiles}) == len(tiles)
