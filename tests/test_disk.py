"""What a search and the writes of a batch leave on the executors' disks."""

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from issuequarry.operators import neighbors
from issuequarry.operators.neighbor_index import StoredIndex
from issuequarry.operators.segments import Segments
from issuequarry.session import checkpointed, shuffles_released
from issuequarry.streaming import jobs
from issuequarry.streaming.snapshots import KeyedTable


def _shuffled(spark):
    """Shuffle data files of the session."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f for top in manager.localDirsString() for _, _, files in os.walk(top) for f in files
            if f.startswith("shuffle_") and f.endswith(".data")}


def _left(spark, before, seconds=10):
    """Files that are still there a while later: they are taken away in the background."""
    until = time.time() + seconds
    while (left := _shuffled(spark) - before) and time.time() < until:
        time.sleep(0.1)
    return left


@pytest.mark.parametrize("write", ["checkpoint", "segment", "keyed", "epoch"])
def test_a_write_leaves_no_shuffle_files(spark, tmp_path, write):
    rows = spark.range(1000).repartition(3, F.col("id") % 7).groupBy((F.col("id") % 100).alias("issue_id")).agg(F.count("*").alias("n"))
    held = rows  # a reference, so that nothing is collected as garbage
    before = _shuffled(spark)
    if write == "checkpoint":
        assert checkpointed(rows, "rows").count() == 100
    elif write == "segment":
        assert Segments(spark, str(tmp_path), {"rows": "issue_id long, n long"}).write(rows, "rows", 1).count() == 100
    elif write == "keyed":
        KeyedTable(spark, str(tmp_path), "rows", rows.schema, ["issue_id"]).append(rows, 0)
    else:
        jobs._append(rows, str(tmp_path), "rows", 0)
    # Of what is read back, a count alone is shuffled.
    assert len(_left(spark, before)) <= (8 if write in ("checkpoint", "segment") else 0)
    assert held.count() == 100


def test_the_setting_comes_back(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    for value in (None, "false"):
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)
        with pytest.raises(ZeroDivisionError), shuffles_released(spark):
            assert spark.conf.get(name) == "true"
            1 / 0
        assert spark.conf.get(name, None) == value
    spark.conf.unset(name)


def _vectors(spark, matrix):
    rows = [(n, "m", v.tolist()) for n, v in enumerate(matrix.astype(np.float32))]
    return spark.createDataFrame(rows, "issue_id long, model string, embedding array<float>")


def test_rows_of_the_grid_are_searched_in_waves(spark, monkeypatch):
    """Ten rows of the grid: no wave ships more than the vectors once for its row, and all answers come."""
    matrix = np.random.default_rng(23).standard_normal((160, 4))
    monkeypatch.setattr(neighbors, "TILE_ROWS", 2)
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 8)
    laid, tiles = [], neighbors.tiles

    def seen(*args):
        laid.append(tiles(*args))
        return laid[-1]

    v = _vectors(spark, matrix)
    monkeypatch.setattr(neighbors, "tiles", seen)
    found = neighbors.exact_knn(v.withColumnRenamed("issue_id", "query_id"), v, 3, exclude_self=True, block_rows=8)
    got = {(r.query_id, r.issue_id, r.rank) for r in found.collect()}
    x = matrix.astype(np.float32).astype(np.float64)
    gap = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(gap, np.inf)
    assert got == {(q, int(i), rank) for q, near in enumerate(np.argsort(gap, axis=1)) for rank, i in enumerate(near[:3], 1)}
    waves = laid[1:]  # the first is the look at home
    assert len(waves) == 10
    asked = set()
    for wave in waves:
        held = wave.select("turn", "id", F.size("ids").alias("n"), F.size("h1s").alias("asking")).collect()
        assert sum(r.n for r in held if r.turn == 1) <= len(matrix)
        chunks = {r.id: r.asking for r in held if r.turn == 0}
        assert not asked & set(chunks) and sum(chunks.values()) <= 3 * 16
        asked |= set(chunks)


def test_waves_hold_every_chunk_once_and_read_its_tasks_alone(spark, monkeypatch):
    matrix = np.random.default_rng(29).standard_normal((300, 4))
    monkeypatch.setattr(neighbors, "TILE_ROWS", 2)
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 8)
    v = _vectors(spark, matrix)
    points = neighbors.checkpointed(neighbors.distinct_vectors(v, 4), "points")
    routers = neighbors.exact_routers(points, 4, block_rows=8)
    blocks, n_blocks = neighbors._counted(neighbors.pack_vectors(points, routers, 4, 8), "blocks")
    chunks, _ = neighbors.pack_queries(v.withColumnRenamed("issue_id", "query_id"), routers, 8)
    (whole,) = neighbors._grids(blocks, chunks, n_blocks)
    at = {r.chunk_id: r.tile_row for r in whole.placed.collect()}
    first = 0
    for wave in neighbors._grids(blocks, chunks, n_blocks, in_waves=True):
        placed = {r.chunk_id: r.tile_row for r in wave.placed.collect()}
        assert placed == {c: row - first for c, row in at.items() if first <= row < first + wave.rows}
        assert {c >> 32 for c in placed} == {r.chunk_id >> 32 for r in wave.chunks.select("chunk_id").collect()}
        first += wave.rows
    assert first == whole.rows == 19


def test_the_stored_index_is_searched_in_waves_past_dead_places(spark, tmp_path, monkeypatch):
    """The search of the embed stream: a batch that replaces vectors, and asks for neighbours in more than one wave."""
    monkeypatch.setattr(neighbors, "TILE_ROWS", 2)
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 8)
    waves, written = [], neighbors._in_waves
    monkeypatch.setattr(neighbors, "_in_waves", lambda parts: (waves.append(len(parts)), written(parts))[1])
    x = np.random.default_rng(31).standard_normal((80, 4)).astype(np.float32)
    index = StoredIndex(spark, str(tmp_path), keep=4, block_rows=8)
    index.append(_vectors(spark, x[::-1].copy()))
    moved = _vectors(spark, x).filter("issue_id < 70")
    index.append(moved, spark.range(75, 80).select(F.col("id").alias("issue_id")))
    held = {i: (x[i] if i < 70 else x[79 - i]).astype(np.float64) for i in range(75)}
    found = index.search(moved.withColumnRenamed("issue_id", "query_id"), 3, exclude_self=True)
    want = set()
    for q in range(70):
        near = sorted((round(float(np.linalg.norm(held[q] - v)), 12), i) for i, v in held.items() if i != q)
        want |= {(q, i, rank) for rank, (_, i) in enumerate(near[:3], 1)}
    assert {(r.query_id, r.issue_id, r.rank) for r in found.collect()} == want
    assert waves == [5]
