"""Nearest neighbours for a table of query vectors against a table of vectors.

Only vectors of one *space* can be compared: the same model and the same number of components. Everything below is kept
apart by space, and a query whose space holds no vector has no answers.

Both sides are packed into blocks of nearby vectors, and only block pairs that
can hold a neighbour meet, by an equi-join on a cell id. What differs between
the exact and the approximate searches is the router that names the cells:

* exact: cells around pivots; the triangle inequality rules cells and blocks out,
  so nothing that could be a neighbour is skipped;
* lists: cells around k-means centres, of which each query probes a few;
* projections: cells are buckets of random projections, several tables of them.

Pairs are worked off on a grid of tiles: a row of the grid is a group of query blocks that one task holds at once, a
column a share of the vector blocks. A vector block travels once per row that needs it, not once per query block, and
each tile hands on the best few of its queries. A few rows of the grid are worked off at a time, and what travelled for
them is gone before the next ones start: however many rows there are, the disk holds a few times the vectors.

Identical vectors are collapsed before any distance is computed and expanded
after, so a group of copies costs one row however large it is. Blocks have a
fixed number of rows, so a crowded cell becomes many blocks, not a large one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from issuequarry.functions.vectors import l2_norm, pairwise_l2, stack
from issuequarry.session import checkpointed, scratch_path, shuffles_released, written

BLOCK_ROWS = 1024
#: Full query blocks' worth of queries that a task holds at once, and of vectors that stream past them in one tile.
TILE_ROWS = 64
TILE_COLUMNS = 4096
#: Pairs of a query and a vector whose costs are in memory at once, few enough to stay near the processor.
PAIRS = 1 << 18
#: Queries whose answers leave a tile at once.
OUT_ROWS = 4096
#: Rows of a tile that are Python objects at once.
SLICE_ROWS = 64
#: Candidates whose distances are taken in double precision at once.
EXACT_ROWS = 4096
#: Pivots whose cells bound the answers of a query; more of them cannot loosen a bound.
BOUND_CELLS = 32
# Distances closer than this are ties, and ties go to the lower id.
DECIMALS = 12
_KEY = ["space", "h1", "h2"]

_BLOCK_SCHEMA = (
    "block_id long, space string, cell long, n int, pmin double, pmax double, heads array<double>, "
    "rings array<double>, ids array<long>, sizes array<int>, mat binary"
)
_CHUNK_SCHEMA = (
    "chunk_id long, before long, space string, cell long, n int, pmin double, pmax double, h1s array<long>, h2s array<long>, "
    "mat binary"
)
_PROBE_SCHEMA = "chunk_id long, space string, cn int, cell long, lo double, hi double, wants array<int>"
#: Some queries of a chunk (a cell to visit, the range of centre distances that matters, the queries or None for all).
Probe = tuple[int, float, float, np.ndarray | None]


class Router:
    """Names the cells of the vectors of one space and the cells a group of queries has to visit."""

    def vector_cells(self, points: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """One (cell, distance to its centre) pair of arrays per cell a vector belongs to."""
        raise NotImplementedError

    def probes(self, points: np.ndarray, last: np.ndarray | None = None) -> list[Probe]:
        """Cells to visit, each with the range of centre distances and the queries that matter.

        ``last`` holds, per point, a cost that its answers are known not to exceed.
        """
        raise NotImplementedError


def _wanted(cells: np.ndarray) -> list[Probe]:
    """The queries that visit each cell, from the cells of each query (one row each)."""
    flat = cells.ravel()
    query = np.repeat(np.arange(len(cells)), cells.shape[1])
    order = np.lexsort((query, flat))
    flat, query = flat[order], query[order]
    bounds = np.append(np.flatnonzero(np.diff(flat, prepend=flat[0] - 1)), len(flat))
    return [(int(flat[a]), -math.inf, math.inf, np.unique(query[a:b])) for a, b in zip(bounds[:-1], bounds[1:])]


#: The router of every space that holds vectors.
Routers = dict[str, Router]


@dataclass
class PivotRouter(Router):
    """Exact routing. ``lift`` turns inner products into distances by one more coordinate.

    ``radius`` and ``heads`` say, per cell, how far its vectors reach and how near its nearest ``keep`` are.
    """

    pivots: np.ndarray
    keep: int
    lift: float | None = None
    radius: np.ndarray | None = None
    heads: np.ndarray | None = None

    def _centres(self) -> np.ndarray:
        return self._lifted(self.pivots)

    def _lifted(self, points: np.ndarray) -> np.ndarray:
        if self.lift is None:
            return points
        rest = np.sqrt(np.maximum(self.lift**2 - (points * points).sum(1), 0.0))
        return np.hstack([points, rest[:, None]])

    def vector_cells(self, points):
        distance = pairwise_l2(self._lifted(points), self._centres())
        cell = distance.argmin(1)
        return [(cell, distance[np.arange(len(cell)), cell])]

    def probes(self, points, last=None):
        known = math.inf if last is None else last
        if self.lift is not None:
            squared = (points * points).sum(1) + self.lift**2
            points = np.hstack([points, np.zeros((len(points), 1))])
            known = np.sqrt(np.maximum(squared + 2.0 * known, 0.0))
        distance = pairwise_l2(points, self._centres())
        cells = min(BOUND_CELLS, distance.shape[1])
        reach = np.full(len(points), math.inf)
        for start in range(0, len(points), 64):
            part = distance[start:start + 64]
            nearest = np.argpartition(part, cells - 1, axis=1)[:, :cells]
            ends = (np.take_along_axis(part, nearest, 1)[:, :, None] + self.heads[nearest]).reshape(len(part), -1)
            reach[start:start + 64] = np.partition(ends, self.keep - 1, axis=1)[:, self.keep - 1]
        reach = np.minimum(reach, known) + 1e-6 * (1.0 + distance.max(1))
        near = distance - reach[:, None] <= self.radius[None, :]
        low = np.where(near, distance - reach[:, None], math.inf).min(0)
        high = np.where(near, distance + reach[:, None], -math.inf).max(0)
        return [(int(c), float(low[c]), float(high[c]), None) for c in np.flatnonzero(near.any(0))]


@dataclass
class CentreRouter(Router):
    """Inverted-list routing: a vector sits in one list, a query probes the nearest few."""

    centres: np.ndarray
    nprobe: int

    def vector_cells(self, points):
        distance = pairwise_l2(points, self.centres)
        cell = distance.argmin(1)
        return [(cell, distance[np.arange(len(cell)), cell])]

    def probes(self, points, last=None):
        distance = pairwise_l2(points, self.centres)
        count = min(self.nprobe, distance.shape[1])
        nearest = np.argpartition(distance, count - 1, axis=1)[:, :count]
        return _wanted(nearest)


@dataclass
class ProjectionRouter(Router):
    """Random-projection routing: in each of several tables, the bucket is named by several projections together.

    A bucket's name is a sum over its projections, so the buckets beyond the nearest bounds of a query follow
    by adding or taking away one term; ``nearby`` of them are visited in each table besides the query's own.
    """

    directions: np.ndarray
    offsets: np.ndarray
    terms: np.ndarray
    width: float
    nearby: int

    @classmethod
    def make(cls, dim: int, tables: int, projections: int, width: float, nearby: int, seed: int = 42) -> ProjectionRouter:
        draw = np.random.default_rng(seed)
        directions = draw.standard_normal((tables, projections, dim))
        terms = draw.integers(1, 1 << 62, (tables, projections), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        return cls(
            directions / np.linalg.norm(directions, axis=2, keepdims=True), draw.random((tables, projections)), terms, width, nearby
        )

    def _named(self, sums: np.ndarray) -> np.ndarray:
        """Cell numbers of summed terms (n x tables x names): the upper bits, behind the number of the table."""
        spread = (sums ^ (sums >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        return (spread >> np.uint64(20)).astype(np.int64) | (np.arange(len(self.terms), dtype=np.int64) << 48)[None, :, None]

    def _placed(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sum of terms of each point in each table, and how far each projection lies above its lower bound."""
        at = np.einsum("nd,tpd->ntp", points, self.directions) / self.width + self.offsets[None]
        step = np.floor(at)
        return (step.astype(np.int64).view(np.uint64) * self.terms[None]).sum(2, dtype=np.uint64), at - step

    def vector_cells(self, points):
        cells = self._named(self._placed(points)[0][:, :, None])[:, :, 0]
        return [(cells[:, t], np.zeros(len(points))) for t in range(cells.shape[1])]

    def probes(self, points, last=None):
        sums, above = self._placed(points)
        # One step down or up along each projection, by how near that bound is.
        far = np.concatenate([above, 1.0 - above], axis=2)
        steps = np.concatenate([np.uint64(0) - self.terms, self.terms], axis=1)[None]
        count = min(self.nearby, far.shape[2])
        best = np.argsort(far, axis=2, kind="stable")[:, :, :count]
        moved = sums[:, :, None] + np.take_along_axis(np.broadcast_to(steps, far.shape), best, axis=2)
        cells = self._named(np.concatenate([sums[:, :, None], moved], axis=2))
        return _wanted(cells.reshape(len(points), -1))


def _keyed(df: DataFrame) -> DataFrame:
    """The space of a vector, and 128 bits of hash that name it; equal vectors share them.

    Rows without model or vector, and vectors with null or undefined components, have no distances and no place here.
    """
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x))
    usable = df.filter("model is not null and size(embedding) > 0").filter(~odd)
    return usable.withColumns({
        "space": F.concat("model", F.lit("/"), F.size("embedding").cast("string")),
        "h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(1), F.col("embedding")),
    })


def distinct_vectors(vectors: DataFrame, keep: int) -> DataFrame:
    """One row per distinct vector of a space with its ``keep`` lowest ids.

    More than ``keep`` copies can never all be neighbours of one query. The
    limit works inside each map task first, so a vector copied a billion times
    sends ``keep`` rows per task.
    """
    w = Window.partitionBy(*_KEY).orderBy("issue_id")
    lowest = _keyed(vectors).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= keep)
    return lowest.groupBy(*_KEY).agg(
        F.array_sort(F.collect_list("issue_id")).alias("ids"), F.any_value("embedding").alias("embedding")
    )


def _routed(points: DataFrame, routers: Routers, extra: str) -> DataFrame:
    """Add cell and centre distance, then lay rows out by them in even ranges.

    Range partitioning on (cell, distance, key) splits a crowded cell over
    tasks, which hashing on the cell would not. A batch is split by space first.
    """

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for space, part in pdf.groupby("space", sort=False):
                if space in routers:
                    for cell, distance in routers[space].vector_cells(stack(part["embedding"])):
                        yield part.assign(cell=cell.astype(np.int64), pdist=distance)

    schema = f"space string, h1 long, h2 long, {extra}embedding array<float>, cell long, pdist double"
    order = ["space", "cell", "pdist", "h1", "h2"]
    return points.mapInPandas(route, schema).repartitionByRange(*order).sortWithinPartitions(*order)


def _groups(batches: Iterator[pd.DataFrame], size: int) -> Iterator[tuple[int, pd.DataFrame]]:
    """Cut a sorted partition into runs of one (space, cell) of at most ``size`` rows, with unique ids."""
    partition = TaskContext.get().partitionId()
    serial = 0
    held: pd.DataFrame | None = None
    for pdf in batches:
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        held = None
        new_run = ((pdf["space"] != pdf["space"].shift()) | (pdf["cell"] != pdf["cell"].shift())).cumsum()
        runs = [run for _, run in pdf.groupby(new_run, sort=False)]
        for at, run in enumerate(runs):
            for start in range(0, len(run), size):
                part = run.iloc[start:start + size]
                if at == len(runs) - 1 and start + size > len(run):
                    held = part
                else:
                    yield (partition << 32) | serial, part
                    serial += 1
    if held is not None and len(held):
        yield (partition << 32) | serial, held


def _matrix_bytes(part: pd.DataFrame) -> bytes:
    return np.stack([np.asarray(v, dtype=np.float32) for v in part["embedding"]]).tobytes()


def pack_vectors(points: DataFrame, routers: Routers, keep: int, block_rows: int) -> DataFrame:
    """Blocks of the searched side: ids, matrix, and the ring of centre distances its rows lie in."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block_id, part in _groups(batches, block_rows):
            ring = part["pdist"].to_numpy()
            sizes = part["ids"].map(len).to_numpy()
            heads = np.repeat(ring, sizes)[:keep]
            yield pd.DataFrame({
                "block_id": [block_id], "space": [part["space"].iloc[0]], "cell": [int(part["cell"].iloc[0])],
                "n": [len(part)], "pmin": [ring.min()], "pmax": [ring.max()], "heads": [heads.tolist()], "rings": [ring.tolist()],
                "ids": [np.concatenate(part["ids"].tolist())], "sizes": [sizes.astype(np.int32)], "mat": [_matrix_bytes(part)],
            })

    return _routed(points.select(*_KEY, "ids", "embedding"), routers, "ids array<long>, ").mapInPandas(pack, _BLOCK_SCHEMA)


def _counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    stored, facts = written(df, name, n=F.count(F.lit(1)))
    return stored, facts["n"] or 0


class _HomeCell(Router):
    """Lays queries out by their first cell only; they probe the others by name."""

    def __init__(self, router: Router):
        self.router = router

    def vector_cells(self, points):
        return self.router.vector_cells(points)[:1]


def pack_queries(queries: DataFrame, routers: Routers, chunk_rows: int) -> tuple[DataFrame, int]:
    """Chunks of the asking side (keys, matrix, home cell and ring, queries packed by its task before it), and their number."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = 0
        for chunk_id, part in _groups(batches, chunk_rows):
            yield pd.DataFrame({
                "chunk_id": [chunk_id], "before": [before], "space": [part["space"].iloc[0]], "cell": [int(part["cell"].iloc[0])],
                "n": [len(part)], "pmin": [part["pdist"].min()], "pmax": [part["pdist"].max()],
                "h1s": [part["h1"].tolist()], "h2s": [part["h2"].tolist()], "mat": [_matrix_bytes(part)],
            })
            before += len(part)

    distinct = _keyed(queries).groupBy(*_KEY).agg(F.any_value("embedding").alias("embedding"))
    home = {space: _HomeCell(router) for space, router in routers.items()}
    return _counted(_routed(distinct, home, "").mapInPandas(pack, _CHUNK_SCHEMA), "chunks")


def probe_cells(chunks: DataFrame, routers: Routers, lasts: DataFrame | None = None) -> DataFrame:
    """The cells every chunk has to visit, one row each."""
    asked = chunks.select("chunk_id", "space", "n", "mat")
    if lasts is None:
        asked = asked.withColumn("lasts", F.lit(None).cast("array<array<double>>"))
    else:
        asked = asked.join(lasts, "chunk_id", "left")

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                last = None if row.lasts is None else _least(row.lasts)
                probes = routers[row.space].probes(_matrix(row.mat, row.n).astype(np.float64), last)
                frame = pd.DataFrame(probes, columns=["cell", "lo", "hi", "wants"])
                asking = [row.n if wants is None else len(wants) for wants in frame["wants"]]
                yield frame.assign(chunk_id=row.chunk_id, space=row.space, cn=asking)[
                    ["chunk_id", "space", "cn", "cell", "lo", "hi", "wants"]
                ]

    return asked.mapInPandas(probe, _PROBE_SCHEMA)


def block_pairs(probes: DataFrame, blocks: DataFrame) -> DataFrame:
    """Chunk and block ids that have to meet: equal space and cell, overlapping ring.

    A block has one cell and a chunk names a cell once, so no pair comes twice.
    """
    rings = blocks.select("block_id", "space", "cell", "pmin", "pmax", F.col("n").alias("bn"))
    met = probes.join(rings, ["space", "cell"]).filter("pmax >= lo and pmin <= hi")
    return met.select("chunk_id", "block_id", "cn", "bn", "wants")


def _home_lasts(
    blocks: DataFrame, n_blocks: int, packed_queries: tuple[DataFrame, int], keep: int, metric: str, dead: DataFrame | None = None,
) -> DataFrame:
    """A first look at the nearest blocks of the home cell: per chunk, costs its answers cannot exceed.

    Whatever is found there bounds the search; two blocks per chunk keep the
    look short and leave the result untouched.
    """
    chunks, n_chunks = packed_queries
    home = chunks.select("chunk_id", "space", "cell", ((F.col("pmin") + F.col("pmax")) / 2).alias("at"))
    rings = blocks.select("block_id", "space", "cell", ((F.col("pmin") + F.col("pmax")) / 2).alias("mid"))
    w = Window.partitionBy("chunk_id").orderBy(F.abs(F.col("mid") - F.col("at")), "block_id")
    near = home.join(rings, ["space", "cell"]).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= 2)
    near = near.withColumn("wants", F.lit(None).cast("array<int>"))
    work = tiles(near, blocks, chunks, n_blocks, n_chunks, dead)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in _searched(batches, keep, metric):
            for chunk_id, last in tile.lasts():
                yield pa.record_batch({"chunk_id": pa.array([chunk_id], pa.int64()), "last": pa.array([last], pa.list_(pa.float64()))})

    found = work.mapInArrow(look, "chunk_id long, last array<double>")
    return found.groupBy("chunk_id").agg(F.collect_list("last").alias("lasts"))


@dataclass
class _Grid:
    """Some rows of the grid, one after another: the chunks they hold, each with its row among them, their number, and the columns."""

    chunks: DataFrame
    placed: DataFrame
    rows: int
    columns: int


def _grids(blocks: DataFrame, chunks: DataFrame, n_blocks: int, in_waves: bool = False) -> list[_Grid]:
    """The grid of all chunks, or its waves: chunks one after another, as many to a row as hold its queries.

    Chunks that a cell leaves small fill a row all the same, so a block travels by the number of queries, not of cells.
    One row per task that packed chunks reaches the driver.

    A row sends its queries to every column, and every row of a wave gets the vectors. So a wave has no more tiles than
    cores are kept busy by or than there are rows' worth of vectors, and no more rows than take, together, half as much as its tiles.
    """
    task, size = F.shiftright("chunk_id", 32), TILE_ROWS * BLOCK_ROWS
    held = chunks.groupBy(task.alias("_task")).agg(F.sum("n").alias("n")).orderBy("_task").collect()
    starts, total = [], 0
    for row in held:
        starts.append((row["_task"], total, total + row["n"]))
        total += row["n"]
    rows, spark = max(1, math.ceil(total / size)), chunks.sparkSession
    vectors = blocks.agg(F.sum("n")).first()[0] or 0
    tasks, step = _tasks(chunks), rows
    if in_waves:
        share = max(1, math.ceil(vectors / size))
        tasks = max(2 * spark.sparkContext.defaultParallelism, min(tasks, share))
        step = min(rows, max(1, tasks // (2 * share)))
    columns = max(1, min(n_blocks, max(math.ceil(tasks / step), math.ceil(vectors / (TILE_COLUMNS * BLOCK_ROWS)))))
    offsets = F.broadcast(spark.createDataFrame([s[:2] for s in starts], "_task long, _start long"))
    row = F.floor((F.col("_start") + F.col("before")) / size)
    grids = []
    for first in range(0, rows, step):
        # Of the chunks only the files of these tasks are read.
        own = [n for n, start, end in starts if start < (first + step) * size and end > first * size]
        part = chunks if step == rows else chunks.filter(F.col("chunk_id").between(min(own) << 32, ((max(own) + 1) << 32) - 1))
        placed = part.select("chunk_id", "before", task.alias("_task")).join(offsets, "_task").select("chunk_id", row.alias("tile_row"))
        if step < rows:
            placed = placed.filter(F.col("tile_row").between(first, first + step - 1))
        placed = placed.select("chunk_id", (F.col("tile_row") - first).alias("tile_row"))
        grids.append(_Grid(part, placed, min(step, rows - first), columns))
    return grids


def tiles(
    pairs: DataFrame, blocks: DataFrame, chunks: DataFrame, n_blocks: int, n_chunks: int, dead: DataFrame | None = None,
    lasts: DataFrame | None = None, grid: _Grid | None = None,
) -> DataFrame:
    """Rows for the search, laid out on the grid: in every tile its chunks, then the blocks some of them look at.

    ``pairs``: chunk_id, block_id and the queries of the chunk that look at the block, null for all.

    A grid row is chunks packed one after another, ``TILE_ROWS`` full blocks' worth of queries, so they mostly need the same blocks.
    Blocks are dealt to as many columns as give every task a tile, and a tile at most ``TILE_COLUMNS`` full blocks' worth of vectors
    or so. The number of tasks is fixed: the bytes are few for the work they cause, so sizing tasks by bytes would leave cores idle.
    ``dead`` names places of blocks (block_id, dead) that no longer count, ``lasts`` per chunk the costs its answers are known not to
    exceed, so that no tile starts without a bound. ``grid`` is the wave to lay out, without it all rows.
    """
    grid = grid or _grids(blocks, chunks, n_blocks)[0]
    chunks, rows, columns = grid.chunks, grid.rows, grid.columns
    placed = pairs.join(grid.placed, "chunk_id").select(
        "chunk_id", "block_id", "wants", "tile_row", F.pmod(F.xxhash64("block_id"), F.lit(columns)).alias("tile_column"),
    )
    shipped = placed.groupBy("block_id", "tile_row", "tile_column").agg(
        F.collect_list(F.struct("chunk_id", "wants")).alias("looks"))
    wanted = ["ids", "sizes", "mat"]
    none = F.lit(None)
    if dead is None:
        shipped = shipped.withColumn("dead", none.cast("array<int>"))
    else:
        shipped = shipped.join(dead, "block_id", "left")
    looked_at = shipped.join(blocks.select("block_id", *wanted), "block_id").select(
        "tile_row", "tile_column", F.lit(1).alias("turn"), F.col("block_id").alias("id"), none.cast("string").alias("space"),
        none.cast("array<long>").alias("h1s"), none.cast("array<long>").alias("h2s"), "looks", *wanted, "dead",
        none.cast("array<array<double>>").alias("lasts"),
    )
    asking = chunks.withColumn("lasts", none.cast("array<array<double>>")) if lasts is None else chunks.join(lasts, "chunk_id", "left")
    asked = placed.select("tile_row", "tile_column", "chunk_id").distinct().join(asking, "chunk_id").select(
        "tile_row", "tile_column", F.lit(0).alias("turn"), F.col("chunk_id").alias("id"), "space", "h1s", "h2s",
        none.cast("array<struct<chunk_id:long,wants:array<int>>>").alias("looks"), none.cast("array<long>").alias("ids"), none.cast("array<int>").alias("sizes"),
        "mat", none.cast("array<int>").alias("dead"), "lasts",
    )
    # Every tile is a task of its own: hashed, some tasks would get several and others none.
    tile = (F.col("tile_row") * columns + F.col("tile_column")).cast("int")
    return asked.unionByName(looked_at).repartitionById(rows * columns, tile).sortWithinPartitions(
        "tile_row", "tile_column", "turn", "id"
    )


class _Block:
    """A block's living vectors, ids and copies, with what every chunk that looks at it needs."""

    def __init__(self, row, metric: str):
        self.v, self.ids, self.sizes = _alive(row)
        norms = np.einsum("ij,ij->i", self.v, self.v, dtype=np.float64)
        self.longest = norms.max(initial=0.0)
        self.scaled = self.v * np.float32(-1.0 if metric == "ip" else -2.0)
        self.norms32 = norms.astype(np.float32)


class _Best:
    """The best ``keep`` (cost, id) pairs of every row of one chunk, or of several taken as one, block by block.

    A block only has to offer what is no worse than a row's current last place,
    which after the first blocks is next to nothing.
    """

    def __init__(self, row, keep: int, metric: str):
        self.names = (row.space, np.asarray(row.h1s), np.asarray(row.h2s))
        self.q = _matrix(row.mat, len(row.h1s))
        self.norms = np.einsum("ij,ij->i", self.q, self.q, dtype=np.float64)
        self.keep, self.metric = keep, metric
        self.last = np.full(len(self.q), math.inf) if row.lasts is None else _least(row.lasts)
        # Per row the first so many places are taken, best first.
        self.taken = np.zeros(len(self.q), dtype=np.int64)
        self.costs = np.full((len(self.q), keep), math.inf)
        self.held = np.zeros((len(self.q), keep), dtype=np.int64)

    def _full(self, rows: np.ndarray | slice) -> np.ndarray:
        return np.arange(self.keep) < self.taken[rows][:, None]

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.q)), self.taken)

    @property
    def cost(self) -> np.ndarray:
        return self.costs[self._full(slice(None))]

    @property
    def ids(self) -> np.ndarray:
        return self.held[self._full(slice(None))]

    def offer(self, block: _Block, wants: np.ndarray | None = None) -> None:
        """Compare the queries named by ``wants``, all of them without it, with a block."""
        if not len(block.v):
            return
        asked = np.arange(len(self.q)) if wants is None else np.asarray(wants)
        step = max(1, PAIRS // len(block.v))
        for start in range(0, len(asked), step):
            self._compare(block, asked[start:start + step])

    def _compare(self, block: _Block, mine: np.ndarray) -> None:
        v = block.v
        q, own, last = self.q[mine], self.norms[mine], self.last[mine]
        # What depends on the query alone stands on the side of the bound.
        cost = q @ block.scaled.T
        if self.metric == "ip":
            limit = last
        else:
            cost += block.norms32
            limit = last**2 - own
        # Single precision sorts out the candidates; the bound covers its rounding, twice.
        slack = (4 * v.shape[1] + 16) * 6e-8 * (own + block.longest)
        near = cost <= (limit + slack)[:, None].astype(np.float32)
        found = np.flatnonzero(near)
        if not len(found):
            return
        # A row that finds more than it may keep needs no more than the best of this block.
        crowded = np.flatnonzero(np.bincount(found // len(v), minlength=len(mine)) > self.keep)
        if len(crowded):
            part = cost[crowded]
            kth = np.partition(part, self.keep - 1, axis=1)[:, self.keep - 1]
            near[crowded] &= part <= (kth + slack[crowded])[:, None].astype(np.float32)
            found = np.flatnonzero(near)
        rows, cols = np.divmod(found, near.shape[1])
        exact = np.empty(len(rows))
        for start in range(0, len(rows), EXACT_ROWS):
            r, c = rows[start:start + EXACT_ROWS], cols[start:start + EXACT_ROWS]
            if self.metric == "ip":
                exact[start:start + EXACT_ROWS] = -np.einsum("ij,ij->i", q[r], v[c], dtype=np.float64)
            else:
                gap = q[r].astype(np.float64) - v[c]
                exact[start:start + EXACT_ROWS] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
        exact = np.round(exact, DECIMALS)
        # The same distance may differ in its last place where it is taken among other rows.
        within_reach = exact <= (last + 1e-9 * (1.0 + np.abs(last)))[rows]
        rows, cols, exact = mine[rows[within_reach]], cols[within_reach], exact[within_reach]
        if not len(rows):
            return
        sizes = block.sizes
        copies = sizes[cols]
        within = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
        start = np.repeat((np.cumsum(sizes) - sizes)[cols], copies)
        self._merge(np.repeat(rows, copies), np.repeat(exact, copies), block.ids[start + within])

    def _merge(self, rows: np.ndarray, cost: np.ndarray, ids: np.ndarray) -> None:
        """Only the rows that are offered something are sorted anew."""
        touched, place = np.unique(rows, return_inverse=True)
        full = self._full(touched)
        rows = np.concatenate([np.nonzero(full)[0], place])
        cost, ids = np.concatenate([self.costs[touched][full], cost]), np.concatenate([self.held[touched][full], ids])
        order = np.lexsort((ids, cost, rows))
        rows, cost, ids = rows[order], cost[order], ids[order]
        # The same pair can come from several tables of an index; copies of a pair are adjacent.
        fresh = np.ones(len(rows), dtype=bool)
        fresh[1:] = (rows[1:] != rows[:-1]) | (ids[1:] != ids[:-1])
        rows, cost, ids = rows[fresh], cost[fresh], ids[fresh]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
        kept = place < self.keep
        rows, place = rows[kept], place[kept]
        self.taken[touched] = np.bincount(rows, minlength=len(touched))
        self.costs[touched[rows], place], self.held[touched[rows], place] = cost[kept], ids[kept]
        self.last[touched] = np.minimum(self.last[touched], self.costs[touched, self.keep - 1])

    def found(self) -> Iterator[pa.RecordBatch]:
        space, h1s, h2s = self.names
        for start in range(0, len(self.q), OUT_ROWS):
            part = slice(start, start + OUT_ROWS)
            full, rows = self._full(part), np.repeat(np.arange(len(self.q))[part], self.taken[part])
            yield pa.record_batch({
                "space": pa.array([space] * len(rows), pa.string()), "h1": pa.array(h1s[rows], pa.int64()),
                "h2": pa.array(h2s[rows], pa.int64()), "cost": pa.array(self.costs[part][full], pa.float64()),
                "id": pa.array(self.held[part][full], pa.int64()),
            })


class _Looks:
    """Who looks at the blocks of a batch, read from Arrow's own arrays: as Python objects they would outweigh the comparison."""

    def __init__(self, column: pa.ListArray):
        chunk, wants = column.values.flatten()
        self.bounds, self.chunk = column.offsets.to_numpy(), chunk.to_numpy(zero_copy_only=False)
        self.ends, self.wants = wants.offsets.to_numpy(), wants.values.to_numpy(zero_copy_only=False)
        self.every = wants.is_null().to_numpy(zero_copy_only=False)

    def at(self, place: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Chunks that look at one block, how many queries each names, whether it means all of them, and the queries."""
        a, b = self.bounds[place], self.bounds[place + 1]
        return self.chunk[a:b], np.diff(self.ends[a:b + 1]), self.every[a:b], self.wants[self.ends[a]:self.ends[b]]


class _Tile:
    """The chunks of one tile. Those of one space are asked as one, so a block is compared once with all that look at it."""

    def __init__(self, chunks: list, keep: int, metric: str):
        spaces: dict[str, list[int]] = {}
        for n, row in enumerate(chunks):
            spaces.setdefault(row.space, []).append(n)
        sizes = np.array([len(row.h1s) for row in chunks], dtype=np.int64)
        first = np.zeros(len(chunks), dtype=np.int64)
        self.bests, self.best_of = [], np.zeros(len(chunks), dtype=np.int64)
        for space, places in spaces.items():
            rows = [chunks[n] for n in places]
            first[places] = np.cumsum(sizes[places]) - sizes[places]
            self.best_of[places] = len(self.bests)
            known = [np.full(len(row.h1s), math.inf) if row.lasts is None else _least(row.lasts) for row in rows]
            self.bests.append(_Best(SimpleNamespace(
                space=space, h1s=np.concatenate([row.h1s for row in rows]), h2s=np.concatenate([row.h2s for row in rows]),
                mat=b"".join(row.mat for row in rows), lasts=[np.concatenate(known)],
            ), keep, metric))
        # Chunks come in the order of their ids.
        self.ids, self.first, self.sizes = np.array([row.id for row in chunks], dtype=np.int64), first, sizes

    def look(self, block: _Block, chunk: np.ndarray, named: np.ndarray, every: np.ndarray, wants: np.ndarray) -> None:
        place = np.searchsorted(self.ids, chunk)
        count = np.where(every, self.sizes[place], named)
        query = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        query[np.repeat(~every, count)] = wants
        self.bests[self.best_of[place[0]]].offer(block, np.repeat(self.first[place], count) + query)

    def lasts(self) -> Iterator[tuple[int, np.ndarray]]:
        for chunk_id, best, first, size in zip(self.ids, self.best_of, self.first, self.sizes):
            yield int(chunk_id), self.bests[best].last[first:first + size]


def _matrix(raw: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.float32).reshape(rows, -1)


def _least(lasts) -> np.ndarray:
    """Per query, the least of the costs that its answers are known not to exceed."""
    return np.min(np.stack([np.asarray(x) for x in lasts]), axis=0)


def _alive(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matrix, ids and copies of a block without the places that are dead."""
    v, ids, sizes = _matrix(row.mat, len(row.sizes)), row.ids, row.sizes.astype(np.int64)
    if row.dead is None or not len(row.dead):
        return v, ids, sizes
    live = np.ones(len(ids), dtype=bool)
    live[np.asarray(row.dead)] = False
    copies = np.add.reduceat(live.astype(np.int64), np.cumsum(sizes) - sizes)
    return v[copies > 0], ids[live], copies[copies > 0]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """A few rows of a batch at a time: as Python objects, what looks at a block takes many times its bytes."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(start, SLICE_ROWS).to_pandas()


def _searched(batches: Iterator[pa.RecordBatch], keep: int, metric: str) -> Iterator[_Tile]:
    """Each tile with the best that its chunks found in its blocks."""
    at, chunks, tile = None, [], None
    for batch in batches:
        looks, place = _Looks(batch.column("looks")), 0
        for pdf in _slices(iter([batch.drop_columns(["looks"])])):
            for row in pdf.itertuples(index=False):
                if (row.tile_row, row.tile_column) != at:
                    if tile is not None:
                        yield tile
                    at, chunks, tile = (row.tile_row, row.tile_column), [], None
                if row.turn == 0:
                    chunks.append(row)
                else:
                    if tile is None:
                        tile, chunks = _Tile(chunks, keep, metric), []
                    tile.look(_Block(row, metric), *looks.at(place))
                place += 1
    if tile is not None:
        yield tile


def _candidates(work: DataFrame, keep: int, metric: str) -> DataFrame:
    """(query key, cost, id) rows: the best ``keep`` of every chunk in each of its tiles."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in _searched(batches, keep, metric):
            for best in tile.bests:
                yield from best.found()

    return work.mapInArrow(search, "space string, h1 long, h2 long, cost double, id long")


def _tasks(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _in_waves(parts: list[DataFrame]) -> DataFrame:
    """All parts as one; several are written one after another, each with no shuffle files of the others beside it."""
    if len(parts) == 1:
        return parts[0]
    spark = parts[0].sparkSession
    path = scratch_path(spark, "nearest")
    with shuffles_released(spark):
        for n, part in enumerate(parts):
            part.write.parquet(f"{path}/{n}")
    return spark.read.schema(parts[0].schema).parquet(*[f"{path}/{n}" for n in range(len(parts))])


def _answers(
    queries: DataFrame, blocks: DataFrame, n_blocks: int, packed_queries: tuple[DataFrame, int],
    pairs: DataFrame, k: int, keep: int, metric: str, exclude_self: bool, overlapping: bool, dead: DataFrame | None = None,
    lasts: DataFrame | None = None,
) -> DataFrame:
    """Merge the best of all tiles, and hand them to every query that asked with the same vector.

    A chunk is in one row of the grid, so the tiles of a wave hold all that its queries can find.
    """
    chunks, n_chunks = packed_queries
    w = Window.partitionBy(*_KEY).orderBy("cost", "id")

    def merged(grid: _Grid) -> DataFrame:
        found = _candidates(tiles(pairs, blocks, chunks, n_blocks, n_chunks, dead, lasts, grid), keep, metric)
        if overlapping:
            # Laid out by query first, so that neither the distinct pairs nor their ranks need another shuffle.
            found = found.repartition(*_KEY).distinct()
        best = found.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= keep)
        return best.groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("cost", "id"))).alias("near"))

    lists = _in_waves([merged(grid) for grid in _grids(blocks, chunks, n_blocks, in_waves=True)])
    asked = _keyed(queries).select("query_id", *_KEY)
    near: Column = F.col("near")
    if exclude_self:
        near = F.filter(near, lambda x: x["id"] != F.col("query_id"))
    value = -F.col("hit.cost") if metric == "ip" else F.col("hit.cost")
    return (
        asked.join(lists, _KEY)
        .select("query_id", F.posexplode(F.slice(near, 1, k)).alias("pos", "hit"))
        .select(
            "query_id", F.col("hit.id").alias("issue_id"), (F.col("pos") + 1).cast("bigint").alias("rank"),
            value.alias("similarity" if metric == "ip" else "distance"),
        )
    )


def no_answers(queries: DataFrame, metric: str = "l2") -> DataFrame:
    value = "similarity" if metric == "ip" else "distance"
    return queries.limit(0).select(
        "query_id", F.col("query_id").cast("bigint").alias("issue_id"), F.lit(0).cast("bigint").alias("rank"), F.lit(0.0).alias(value),
    )


def exact_routers(points: DataFrame, keep: int, metric: str = "l2", block_rows: int = BLOCK_ROWS) -> dict[str, PivotRouter]:
    """Pivots of every space: as many as the square root of its blocks, the vectors with the lowest hashes.

    So what a task holds grows with the root of a space's size. Spaces are few; a row of each reaches the driver.
    """
    longest = F.max(l2_norm(F.col("embedding"))) if metric == "ip" else F.lit(None).cast("double")
    sizes = {r.space: r for r in points.groupBy("space").agg(F.count("*").alias("n"), longest.alias("longest")).collect()}
    if not sizes:
        return {}
    wanted = {space: math.ceil(math.sqrt(math.ceil(r.n / block_rows))) for space, r in sizes.items()}
    w = Window.partitionBy("space").orderBy("h1", "h2")
    first = points.select(*_KEY, "embedding").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= max(wanted.values()))
    limits = F.broadcast(points.sparkSession.createDataFrame(list(wanted.items()), "space string, _limit int"))
    picked: dict[str, list] = {}
    for row in first.join(limits, "space").filter("_n <= _limit").select("space", "embedding").collect():
        picked.setdefault(row.space, []).append(row.embedding)
    return {space: PivotRouter(stack(rows), keep, sizes[space].longest) for space, rows in picked.items()}


def learn_bounds(routers: dict[str, PivotRouter], rings: DataFrame) -> dict[str, PivotRouter]:
    """Per space and cell: the outer radius and the smallest centre distances, one row per cell.

    ``rings``: space, cell, pmin, pmax, heads of every block.
    """
    keep = max((router.keep for router in routers.values()), default=1)
    w = Window.partitionBy("space", "cell").orderBy("pmin")
    first = rings.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= keep)
    heads = first.groupBy("space", "cell").agg(
        F.slice(F.array_sort(F.flatten(F.collect_list("heads"))), 1, keep).alias("heads")
    )
    radii = rings.groupBy("space", "cell").agg(F.max("pmax").alias("radius"))
    for router in routers.values():
        router.radius = np.full(len(router.pivots), -math.inf)
        router.heads = np.full((len(router.pivots), router.keep), math.inf)
    for row in radii.join(heads, ["space", "cell"]).collect():
        router = routers[row.space]
        router.radius[row.cell] = row.radius
        router.heads[row.cell, : len(row.heads)] = row.heads
    return routers


def search_blocks(
    queries: DataFrame, blocks: DataFrame, n_blocks: int, routers: Routers, k: int, keep: int, *, metric: str = "l2",
    exclude_self: bool = False, block_rows: int = BLOCK_ROWS, dead: DataFrame | None = None,
) -> DataFrame:
    """Exact search of packed blocks: a look at home bounds each chunk, then the tiles of what is left."""
    chunks = pack_queries(queries, routers, block_rows)
    lasts = checkpointed(_home_lasts(blocks, n_blocks, chunks, keep, metric, dead), "lasts")
    pairs = checkpointed(block_pairs(probe_cells(chunks[0], routers, lasts), blocks), "pairs")
    return _answers(queries, blocks, n_blocks, chunks, pairs, k, keep, metric, exclude_self, overlapping=False, dead=dead, lasts=lasts)


def exact_knn(
    queries: DataFrame, vectors: DataFrame, k: int, *, metric: str = "l2", exclude_self: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The ``k`` nearest vectors of the same space for every query.

    ``queries``: query_id, model, embedding. ``vectors``: issue_id, model,
    embedding. ``metric`` is ``l2`` (ascending) or ``ip`` (inner product,
    descending). Returns query_id, issue_id, rank and distance or similarity;
    equal values rank by id.
    """
    keep = k + int(exclude_self)
    points = checkpointed(distinct_vectors(vectors, keep), "points")
    routers = exact_routers(points, keep, metric, block_rows)
    if not routers:
        return no_answers(queries, metric)
    blocks, n_blocks = _counted(pack_vectors(points, routers, keep, block_rows), "blocks")
    routers = learn_bounds(routers, blocks.select("space", "cell", "pmin", "pmax", "heads"))
    return search_blocks(
        queries, blocks, n_blocks, routers, k, keep, metric=metric, exclude_self=exclude_self, block_rows=block_rows
    )


@dataclass
class AnnIndex:
    """Packed vectors with the routers that placed them; reusable for any query table."""

    packed: tuple[DataFrame, int]
    routers: Routers
    keep: int
    overlapping: bool

    def search(self, queries: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
        return self._search(queries, k, exclude_self)[0]

    def _search(self, queries: DataFrame, k: int, exclude_self: bool) -> tuple[DataFrame, DataFrame]:
        if k + int(exclude_self) > self.keep:
            raise ValueError(f"this index holds at most {self.keep} copies per vector")
        chunks = pack_queries(queries, self.routers, BLOCK_ROWS // 8)
        pairs = checkpointed(block_pairs(probe_cells(chunks[0], self.routers), self.packed[0]), "pairs")
        found = _answers(
            queries, *self.packed, chunks, pairs, k, k + int(exclude_self), "l2", exclude_self, self.overlapping
        )
        return found, pairs

    def search_with_cost(self, queries: DataFrame, k: int, exclude_self: bool = False) -> tuple[DataFrame, DataFrame]:
        """Neighbours, and one row with the share of all vector pairs that was compared."""
        found, pairs = self._search(queries, k, exclude_self)
        zero = F.lit(0.0)
        compared = pairs.agg(
            F.sum(F.col("cn").cast("double") * F.col("bn")).alias("compared"), zero.alias("asked"), zero.alias("stored")
        )
        asked = _keyed(queries).agg(
            zero.alias("compared"), F.count_distinct(*_KEY).cast("double").alias("asked"), zero.alias("stored")
        )
        stored = self.packed[0].select(F.explode("ids").alias("ids")).agg(
            zero.alias("compared"), zero.alias("asked"), F.count_distinct("ids").cast("double").alias("stored")
        )
        counts = compared.unionByName(asked).unionByName(stored)
        share = counts.agg(
            (F.sum("compared") / (F.sum("asked") * F.sum("stored"))).alias("candidate_share")
        )
        return found, share


def _spaces(points: DataFrame) -> list:
    """Number of vectors and components of every space."""
    return points.groupBy("space").agg(F.count("*").alias("n"), F.any_value(F.size("embedding")).alias("dim")).collect()


#: Queries per space, and neighbours of each, that the reach of an approximate index is set by.
SAMPLE_QUERIES, SAMPLE_NEIGHBOURS = 64, 10
TARGET_RECALL = 0.95


def _sampled_neighbours(points: DataFrame) -> dict[str, list[tuple[np.ndarray, np.ndarray]]]:
    """Per space: the vectors with the lowest hashes, each with its exact neighbours among all vectors.

    One pass compares all vectors with the sample; each task hands on the nearest few, so what travels is bounded.
    """
    w = Window.partitionBy("space").orderBy("h1", "h2")
    first = points.select(*_KEY, "embedding").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= SAMPLE_QUERIES)
    asked: dict[str, list] = {}
    for row in first.orderBy(*_KEY).collect():
        asked.setdefault(row.space, []).append(row.embedding)
    sample = {space: stack(rows) for space, rows in asked.items()}

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for space, part in pdf.groupby("space", sort=False):
                distance = pairwise_l2(sample[space], stack(part["embedding"]))
                distance[distance < 1e-6] = math.inf  # itself; other vectors differ
                nearest = np.argsort(distance, axis=1)[:, :SAMPLE_NEIGHBOURS]
                rows, cols = np.repeat(np.arange(len(nearest)), nearest.shape[1]), nearest.ravel()
                yield pd.DataFrame({
                    "space": space, "query": rows, "distance": distance[rows, cols], "embedding": part["embedding"].iloc[cols].tolist(),
                })

    found = points.select("space", "embedding").mapInPandas(near, "space string, query int, distance double, embedding array<float>")
    each = Window.partitionBy("space", "query").orderBy("distance")
    found = found.withColumn("_n", F.row_number().over(each)).filter(F.col("_n") <= SAMPLE_NEIGHBOURS).filter("distance < double('inf')")
    pairs: dict[tuple, list] = {}
    for row in found.orderBy("space", "query", "_n").collect():
        pairs.setdefault((row.space, row.query), []).append(row.embedding)
    out: dict[str, list] = {space: [] for space in sample}
    for (space, query), rows in sorted(pairs.items()):
        out[space].append((sample[space][query], stack(rows)))
    return out


def _reaching(choices: Iterator[Router], pairs: list[tuple[np.ndarray, np.ndarray]], target: float) -> Router:
    """The first router, from narrow to wide, under which the sampled queries visit the target share of their neighbours; else the last."""
    router = None
    for router in choices:
        met = asked = 0
        for query, near in pairs:
            visited = np.array([probe[0] for probe in router.probes(query[None])])
            met += int(np.any([np.isin(cells, visited) for cells, _ in router.vector_cells(near)], axis=0).sum())
            asked += len(near)
        if met >= target * asked:
            break
    return router


#: Parts a list is cut into at once, and vectors of a list that fit the cut, per part.
FANOUT = 64
TRAIN_PER_PART = 64


def _cut_list(points: np.ndarray, parts: int, seed: int) -> np.ndarray:
    """Centres of ``parts`` clusters of one list, or of fewer where there are no more different points."""
    draw = np.random.default_rng(seed)
    centres = points[draw.integers(len(points))][None]
    gap = pairwise_l2(points, centres)[:, 0] ** 2
    while len(centres) < parts and gap.max() > 0:
        centres = np.vstack([centres, points[draw.choice(len(points), p=gap / gap.sum())]])
        gap = np.minimum(gap, pairwise_l2(points, centres[-1:])[:, 0] ** 2)
    for _ in range(10):
        home = pairwise_l2(points, centres).argmin(1)
        counts = np.bincount(home, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, home, points)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def _grown_lists(points: DataFrame, wanted: dict[str, int], sizes: dict[str, int], dims: dict[str, int], seed: int) -> dict[str, np.ndarray]:
    """List centres of every space, level by level: what holds more than twice its share is cut into up to ``FANOUT`` parts.

    A cut is fitted to at most ``FANOUT * TRAIN_PER_PART`` vectors of its list, those with the lowest hashes; the vectors
    that lists hold are counted over all. The driver holds the centres and one row per list.
    """
    centres = {space: np.zeros((1, dims[space])) for space in wanted}
    while True:
        now = dict(centres)

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for space, part in pdf.groupby("space", sort=False):
                    home = pairwise_l2(stack(part["embedding"]), now[space]).argmin(1)
                    yield part[["space", "h1", "embedding"]].assign(list=home.astype(np.int64))

        placed = points.select("space", "h1", "embedding").mapInPandas(place, "space string, h1 long, embedding array<float>, list long")
        over = []
        for row in placed.groupBy("space", "list").agg(F.count("*").alias("n")).collect():
            share = sizes[row.space] / wanted[row.space]
            if row.n > 2 * share:
                over.append((row.space, row.list, min(FANOUT, max(2, math.ceil(row.n / share)))))
        if not over:
            return centres
        cuts = F.broadcast(points.sparkSession.createDataFrame(over, "space string, list long, parts int"))
        w = Window.partitionBy("space", "list").orderBy("h1")
        train = placed.join(cuts, ["space", "list"]).withColumn("_n", F.row_number().over(w)).filter(
            F.col("_n") <= FANOUT * TRAIN_PER_PART).filter(F.col("_n") <= F.col("parts") * TRAIN_PER_PART)

        def cut(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("h1")
            found = _cut_list(stack(rows["embedding"]), int(rows["parts"].iloc[0]), seed)
            return pd.DataFrame({"space": rows["space"].iloc[0], "list": rows["list"].iloc[0], "centre": list(found)})

        fitted = train.groupBy("space", "list").applyInPandas(cut, "space string, list long, centre array<double>")
        fresh: dict[tuple, list] = {}
        for row in fitted.collect():
            fresh.setdefault((row.space, row.list), []).append(row.centre)
        parted = {key: sorted(rows) for key, rows in fresh.items() if len(rows) > 1}
        if not parted:
            return centres
        for space, held in centres.items():
            out = sorted(n for s, n in parted if s == space)
            if out:
                more = [np.array(parted[space, n]) for n in out]
                kept = np.delete(held, out, axis=0)
                centres[space] = np.vstack([kept, *more])


def ivf_index(
    vectors: DataFrame, *, lists: int | None = None, nprobe: int | None = None, target: float = TARGET_RECALL, keep: int = 51,
    seed: int = 42, block_rows: int = BLOCK_ROWS,
) -> AnnIndex:
    """Inverted lists around centres that grow with the table: the square root of a space's vectors, unless told otherwise.

    Every vector is placed in a list; a query visits ``nprobe`` of them, by default as few as reach ``target`` of the
    neighbours of sampled queries. On clustered vectors the share that is compared falls as the table grows.
    """
    points = checkpointed(distinct_vectors(vectors, keep), "points")
    spaces = _spaces(points)
    sizes, dims = {r.space: r.n for r in spaces}, {r.space: r.dim for r in spaces}
    wanted = {space: max(1, min(n, lists or math.ceil(math.sqrt(n)))) for space, n in sizes.items()}
    centres = _grown_lists(points, wanted, sizes, dims, seed) if spaces else {}
    near = _sampled_neighbours(points) if nprobe is None and spaces else {}
    routers: Routers = {
        space: CentreRouter(c, nprobe) if nprobe else _reaching((CentreRouter(c, n + 1) for n in range(len(c))), near[space], target)
        for space, c in centres.items()
    }
    return AnnIndex(_counted(pack_vectors(points, routers, keep, block_rows), "blocks"), routers, keep, overlapping=False)


def projection_index(
    vectors: DataFrame, *, tables: int = 8, projections: int | None = None, width: float | None = None, nearby: int = 6,
    target: float = TARGET_RECALL, keep: int = 51, seed: int = 42, block_rows: int = BLOCK_ROWS,
) -> AnnIndex:
    """Random-projection tables; a vector appears once per table.

    Unless given, the width of a bucket is four times what neighbours of sampled queries differ by along a line, and as
    many projections name a bucket, 16 at most, as let these queries still meet ``target`` of their neighbours; where
    one is too many, buckets get wider.
    """
    points = checkpointed(distinct_vectors(vectors, keep), "points")
    spaces = _spaces(points)
    near = _sampled_neighbours(points) if spaces and (projections is None or width is None) else {}
    routers: Routers = {}
    for row in spaces:
        gaps = [float(np.linalg.norm(x - query, axis=1).min()) for query, x in near.get(row.space, []) if len(x)]
        own = width or 4.0 * (float(np.median(gaps)) if gaps else 1.0) / math.sqrt(row.dim)
        wanted = [(projections, own)] if projections else [*((n, own) for n in range(16, 0, -1)), *((1, own * 2**n) for n in range(1, 8))]
        choices = (ProjectionRouter.make(row.dim, tables, n, wide, nearby, seed) for n, wide in wanted)
        routers[row.space] = _reaching(choices, near.get(row.space, []), target)
    return AnnIndex(_counted(pack_vectors(points, routers, keep, block_rows), "blocks"), routers, keep, overlapping=True)


def nearest(
    queries: DataFrame, vectors: DataFrame, k: int, *, index=None, exclude_self: bool = False, **options
) -> DataFrame:
    """Exact neighbours, or those of an index (``AnnIndex`` or a stored one) built before over the same vectors."""
    if index is not None:
        return index.search(queries, k, exclude_self)
    return exact_knn(queries, vectors.select("issue_id", "model", "embedding"), k, exclude_self=exclude_self, **options)


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Mean share of the true ``k`` neighbours that were found."""
    hits = truth.select("query_id", "issue_id").join(
        found.select("query_id", "issue_id", F.lit(1).alias("hit")), ["query_id", "issue_id"], "left"
    )
    per_query = hits.groupBy("query_id").agg((F.count("hit") / F.lit(k)).alias("share"))
    return per_query.agg(F.count("*").alias("queries"), F.avg("share").alias("recall"))


def vectors_join_issues(vectors: DataFrame, issues: DataFrame, model: str | None = None) -> DataFrame:
    """Vectors of one model with their issues; the model filter reaches the scan."""
    chosen = vectors if model is None else vectors.filter(F.col("model") == model)
    return chosen.join(issues, chosen.issue_id == issues.id, "inner")


def knn_graph(vectors: DataFrame, k: int = 5, **options) -> DataFrame:
    """The ``k`` nearest other issues of the same model; the score is 1 - distance, unclamped."""
    queries = vectors.select(F.col("issue_id").alias("query_id"), "model", "embedding")
    found = nearest(queries, vectors, k, exclude_self=True, **options)
    return found.select(
        F.col("query_id").alias("issue_id"), F.col("issue_id").alias("neighbor_id"), "rank", "distance",
        (F.lit(1.0) - F.col("distance")).alias("score"),
    )


def all_pairs_similarity(vectors: DataFrame, k: int = 5, **options) -> DataFrame:
    """Top ``k`` inner products of every row against all others, best first."""
    queries = vectors.select(F.col("issue_id").alias("query_id"), "model", "embedding")
    found = exact_knn(
        queries, vectors.select("issue_id", "model", "embedding"), k, metric="ip", exclude_self=True, **options
    )
    return found.select(
        F.col("query_id").alias("issue_id"), F.col("issue_id").alias("neighbor_id"), "rank", "similarity"
    )
