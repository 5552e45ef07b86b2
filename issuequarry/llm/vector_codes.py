"""Product quantisation of vectors over Hilbert-sorted flat blocks, in exact integers.

Components become integers and vectors are cut into equal parts, each with its own codebook. Vectors are gathered in
chunks of ``CHUNK``; inside a chunk every part position is sorted by its place on a Hilbert curve and laid out flat in
blocks of ``BLOCK`` neighbours, each with its min/max box and its sum. A round of fitting measures the distances from
boxes to entries first: an entry farther from a whole box than another one's far corner cannot be nearest to anything
inside. What is left is the block's shortlist. A block with one entry left is added to it by its sum alone, the others
are settled by integer kernels over the entries of their list, so the result is that of a full comparison.

Chunks are written once and read in every round; a round sends one row per part and entry from each task and brings
``PARTS * ENTRIES`` sums to the driver, whatever the number of vectors. No vector is shuffled: chunks hold whole
vectors, so codes are put together where they are.

Defined results: rows whose vector is null or holds null or non-finite components are left out. Vectors of unequal
length are filled up with zeros to the longest one, and its length to a multiple of ``PARTS``. Components are held
within +-sqrt(2**60 / length) (2**27 at 64 components), so that errors fit 64 bits. With fewer than ``ENTRIES`` vectors there
are fewer entries; equal or null vec_ids are ordered by their vectors, null last. Repeated rows are rows of their own. An empty
table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issuequarry.llm.common import lists
from issuequarry.session import written

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
CHUNK = 8192
BLOCK = 32

_FLAT = "ids array<{id}>, labels array<{label}>, n int, " + ", ".join(
    f"{name} array<binary>" for name in ("mats", "orders", "lows", "highs", "sums")
)


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of grid cells (n x d, unsigned) on the Hilbert curve with ``bits`` bits per axis, ``d * bits <= 64``.

    Works on the transposed form of the index: rotations are undone from the coarsest bit on, then the Gray code is
    read off and the bits of all axes are interleaved.
    """
    axes = [cells[:, i].astype(np.uint64) for i in range(cells.shape[1])]
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        low = (one << np.uint64(level)) - one
        for i in range(len(axes)):
            turned = (axes[i] >> np.uint64(level) & one).astype(bool)
            swap = np.where(turned, np.uint64(0), (axes[0] ^ axes[i]) & low)
            axes[0] = np.where(turned, axes[0] ^ low, axes[0] ^ swap)
            if i:
                axes[i] = axes[i] ^ swap
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    fix = np.zeros(len(cells), dtype=np.uint64)
    for level in range(bits - 1, 0, -1):
        low = (one << np.uint64(level)) - one
        fix ^= np.where((axes[-1] >> np.uint64(level) & one).astype(bool), low, np.uint64(0))
    key = np.zeros(len(cells), dtype=np.uint64)
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            key = key << one | ((axis ^ fix) >> np.uint64(level) & one)
    return key


def curve_order(points: np.ndarray) -> np.ndarray:
    """Order of integer points along a Hilbert curve over their own box; at most 64 axes steer it."""
    points = points[:, :64]
    bits = max(1, min(16, 64 // max(1, points.shape[1])))
    low = points.min(0)
    width = np.maximum(points.max(0) - low + 1, 1)
    cells = ((points - low).astype(np.float64) / width * (1 << bits)).astype(np.uint64)
    return np.argsort(hilbert_keys(np.minimum(cells, np.uint64((1 << bits) - 1)), bits), kind="stable")


class FlatPart:
    """One part position of a chunk: points in curve order with the boxes and sums of their blocks."""

    def __init__(self, points: np.ndarray, lows: np.ndarray, highs: np.ndarray, sums: np.ndarray):
        self.points, self.lows, self.highs, self.sums = points, lows, highs, sums

    @classmethod
    def laid_out(cls, points: np.ndarray) -> tuple[FlatPart, np.ndarray]:
        order = curve_order(points)
        points = points[order]
        first = np.arange(0, len(points), BLOCK)
        lows, highs = np.minimum.reduceat(points, first), np.maximum.reduceat(points, first)
        return cls(points, lows, highs, np.add.reduceat(points, first)), order

    def sizes(self) -> np.ndarray:
        return np.minimum(BLOCK, len(self.points) - np.arange(len(self.lows)) * BLOCK)

    def shortlists(self, entries: np.ndarray) -> np.ndarray:
        """blocks x entries: True where the entry may be nearest to a point of the block's box."""
        near = np.zeros((len(self.lows), len(entries)), dtype=np.int64)
        far = np.zeros_like(near)
        for axis in range(self.lows.shape[1]):
            below = self.lows[:, axis, None] - entries[None, :, axis]
            above = entries[None, :, axis] - self.highs[:, axis, None]
            outside = np.maximum(np.maximum(below, above), 0)
            corner = np.maximum(np.abs(below), np.abs(above))
            near += outside * outside
            far += corner * corner
        return near <= far.min(1)[:, None]

    def nearest(self, entries: np.ndarray, blocks: np.ndarray, listed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the points of ``blocks`` with their nearest listed entry and its squared distance.

        Blocks with equally long lists are settled together, entry by entry in ascending order, so ties keep the lower one.
        """
        places, codes, errors = [], [], []
        length = listed.sum(1)
        for many in np.unique(length).tolist():
            group = np.flatnonzero(length == many)
            names = np.nonzero(listed[group])[1].reshape(len(group), many)
            place = blocks[group, None] * BLOCK + np.arange(BLOCK)
            inside = place < len(self.points)
            points = self.points[np.minimum(place, len(self.points) - 1)]
            best = np.zeros(place.shape, dtype=np.int64)
            error = np.full(place.shape, np.iinfo(np.int64).max)
            for turn in range(many):
                entry = entries[names[:, turn]]
                distance = np.zeros(place.shape, dtype=np.int64)
                for axis in range(points.shape[2]):
                    gap = points[:, :, axis] - entry[:, None, axis]
                    distance += gap * gap
                closer = distance < error
                best = np.where(closer, names[:, turn, None], best)
                error = np.where(closer, distance, error)
            places.append(place[inside])
            codes.append(best[inside])
            errors.append(error[inside])
        if not places:
            return tuple(np.zeros(0, dtype=np.int64) for _ in range(3))
        return np.concatenate(places), np.concatenate(codes), np.concatenate(errors)

    def totals(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per entry the number and the sum of the points nearest to it."""
        listed = self.shortlists(entries)
        alone = listed.sum(1) == 1
        counts = np.zeros(len(entries), dtype=np.int64)
        sums = np.zeros((len(entries), self.points.shape[1]), dtype=np.int64)
        owner = listed[alone].argmax(1)
        np.add.at(counts, owner, self.sizes()[alone])
        np.add.at(sums, owner, self.sums[alone])
        place, code, _ = self.nearest(entries, np.flatnonzero(~alone), listed[~alone])
        counts += np.bincount(code, minlength=len(entries))
        np.add.at(sums, code, self.points[place])
        return counts, sums

    def coded(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry and squared distance of every point, in curve order."""
        place, code, error = self.nearest(entries, np.arange(len(self.lows)), self.shortlists(entries))
        codes, errors = np.empty(len(self.points), dtype=np.int64), np.empty(len(self.points), dtype=np.int64)
        codes[place], errors[place] = code, error
        return codes, errors


def _usable(vectors: DataFrame) -> DataFrame:
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label").filter(
        F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(False))
    )


def _integers(values: np.ndarray, width: int) -> np.ndarray:
    bound = math.isqrt((1 << 60) // max(1, width))
    return np.clip(np.floor(values * float(SCALE)), -bound, bound).astype(np.int64)


def _rows(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of a batch as integers, filled up with zeros to ``width``."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return _integers(out, width)


def flat_chunks(vectors: DataFrame, width: int) -> DataFrame:
    """Chunks of whole vectors, every part position in its own curve order."""
    types = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}

    def chunk(ids: list[pa.Array], labels: list[pa.Array], points: np.ndarray) -> pa.RecordBatch:
        columns: dict[str, list[bytes]] = {name: [] for name in ("mats", "orders", "lows", "highs", "sums")}
        for part in np.split(points, PARTS, axis=1):
            flat, order = FlatPart.laid_out(part)
            for name, values in zip(columns, (flat.points, order, flat.lows, flat.highs, flat.sums)):
                columns[name].append(values.astype(np.int32 if name != "sums" else np.int64).tobytes())
        whole = [pa.ListArray.from_arrays(pa.array([0, len(points)], pa.int32()), pa.concat_arrays(x)) for x in (ids, labels)]
        binary = [pa.array([x], pa.list_(pa.binary())) for x in columns.values()]
        return pa.RecordBatch.from_arrays([*whole, pa.array([len(points)], pa.int32()), *binary], names=["ids", "labels", "n", *columns])

    def gather(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, pa.Array, np.ndarray]] = []
        size = 0
        for batch in stream:
            while batch.num_rows:
                take = batch.slice(0, CHUNK - size)
                batch = batch.slice(len(take))
                held.append((take.column("vec_id"), take.column("label"), _rows(take.column("embedding"), width)))
                size += len(take)
                if size == CHUNK:
                    yield joined(held)
                    held, size = [], 0
        if held:
            yield joined(held)

    def joined(held: list) -> pa.RecordBatch:
        ids, labels, points = zip(*held)
        return chunk(list(ids), list(labels), np.concatenate(points))

    return vectors.select("vec_id", "embedding", "label").mapInArrow(gather, _FLAT.format(id=types["vec_id"], label=types["label"]))


def _parts(row: dict, names: tuple[str, ...], width: int) -> Iterator[FlatPart]:
    axes = width // PARTS
    for mat, low, high, total in zip(*(row[name] for name in names)):
        points, lows, highs = (np.frombuffer(raw, dtype=np.int32).astype(np.int64).reshape(-1, axes) for raw in (mat, low, high))
        yield FlatPart(points, lows, highs, np.frombuffer(total, dtype=np.int64).reshape(-1, axes))


_READ = ("mats", "lows", "highs", "sums")


def _one_by_one(stream: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in stream:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def round_totals(chunks: DataFrame, codebooks: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts (parts x entries) and sums (parts x entries x axes) of what each entry is nearest to."""

    def total(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(codebooks.shape[:2], dtype=np.int64)
        sums = np.zeros(codebooks.shape, dtype=np.int64)
        for row in _one_by_one(stream):
            for p, part in enumerate(_parts(row, _READ, width)):
                more = part.totals(codebooks[p])
                counts[p] += more[0]
                sums[p] += more[1]
        part_no, entry = np.nonzero(counts)
        axes = codebooks.shape[2]
        numbers = lists(np.concatenate([counts[part_no, entry][:, None], sums[part_no, entry]], axis=1).ravel(), np.full(len(part_no), axes + 1), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(part_no.astype(np.int32)), pa.array(entry.astype(np.int32)), numbers], names=["part", "entry", "numbers"])

    rows = chunks.select(*_READ).mapInArrow(total, "part int, entry int, numbers array<long>")
    added = rows.groupBy("part", "entry").agg(*[F.sum(F.get("numbers", F.lit(k))).alias(f"s{k}") for k in range(codebooks.shape[2] + 1)])
    counts = np.zeros(codebooks.shape[:2], dtype=np.int64)
    sums = np.zeros(codebooks.shape, dtype=np.int64)
    for part, entry, count, *values in added.collect():
        counts[part, entry], sums[part, entry] = count, values
    return counts, sums


def fitted(chunks: DataFrame, codebooks: np.ndarray, width: int) -> np.ndarray:
    """Codebooks after ``ROUNDS`` rounds; an entry that nothing is nearest to stays."""
    for _ in range(ROUNDS):
        counts, sums = round_totals(chunks, codebooks, width)
        used = counts > 0
        codebooks = codebooks.copy()
        codebooks[used] = sums[used] // counts[used][:, None]
    return codebooks


def assigned(chunks: DataFrame, codebooks: np.ndarray, width: int) -> DataFrame:
    """vec_id, label, code and error of every vector."""
    types = {f.name: f.dataType.elementType.simpleString() for f in chunks.schema.fields if f.name in ("ids", "labels")}

    def code(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                row = one.select([*_READ, "orders", "n"]).to_pylist()[0]
                codes = np.empty((row["n"], PARTS), dtype=np.uint8)
                errors = np.zeros(row["n"], dtype=np.int64)
                for p, part in enumerate(_parts(row, _READ, width)):
                    order = np.frombuffer(row["orders"][p], dtype=np.int32)
                    nearest, error = part.coded(codebooks[p])
                    codes[order, p] = nearest
                    errors[order] += error
                yield pa.RecordBatch.from_arrays([
                    one.column("ids").flatten(), one.column("labels").flatten(),
                    pa.array([c.tobytes().hex() for c in codes]), pa.array(errors),
                ], names=["vec_id", "label", "code", "error"])

    return chunks.mapInArrow(code, f"vec_id {types['ids']}, label {types['labels']}, code string, error long")


def digest_of(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """Codes (vec_id, label, code, error) of all usable vectors, and the codebooks (parts x entries x axes)."""
    usable = _usable(vectors)
    longest = usable.agg(F.max(F.size("embedding")).alias("n")).first().n or 0
    width = max(1, math.ceil(longest / PARTS)) * PARTS
    order = [F.col("vec_id").asc_nulls_last(), "embedding"]
    first = usable.orderBy(*order).limit(ENTRIES).select("embedding").collect()
    start = np.zeros((len(first), width))
    for k, row in enumerate(first):
        start[k, : len(row.embedding)] = row.embedding
    codebooks = np.stack(np.split(_integers(start, width), PARTS, axis=1))
    chunks = written(flat_chunks(usable, width), "vector-chunks")[0]
    if len(first):
        codebooks = fitted(chunks, codebooks, width)
    return assigned(chunks, codebooks, width), codebooks


def restored(codes: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """vec_id and the vector that each code stands for."""
    entries = np.ascontiguousarray(codebooks)

    def decode(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            parts = np.array([list(bytes.fromhex(c)) for c in batch.column("code").to_pylist()], dtype=np.int64).reshape(-1, PARTS)
            values = np.concatenate([entries[p][parts[:, p]] for p in range(PARTS)], axis=1) / float(SCALE)
            column = lists(values.ravel().astype(np.float32), np.full(len(parts), values.shape[1]), pa.float32())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), column], names=["vec_id", "embedding"])

    kind = codes.schema["vec_id"].dataType.simpleString()
    return codes.select("vec_id", "code").mapInArrow(decode, f"vec_id {kind}, embedding array<float>")


def digest(codes: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """One row per vector with the error of its label and the hash of the codebooks.

    Errors are added up per label inside the map tasks; the join's other side has one row per label, so that adaptive
    execution may split a label that many vectors share.
    """
    rows = written(codes, "vector-codes")[0]
    per_label = rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    return rows.join(per_label, F.col("label").eqNullSafe(F.col("_label")), "left").select(
        "vec_id", "code", "error", "label_error", F.lit(digest_of(codebooks)).alias("codebooks_sha256"),
    )


def oracle() -> str:
    """DuckDB twin of ``digest(*compress(embeddings))`` for vectors of one length, a multiple of ``PARTS``."""
    rounds = []
    for r in range(ROUNDS + 1):
        rounds.append(f"""
d{r} AS (SELECT x.vec_id, x.part, x.v, b.entry,
    list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS error
  FROM parts x JOIN b{r} b ON x.part = b.part),
a{r} AS MATERIALIZED (SELECT * FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY error, entry) = 1)""")
        if r < ROUNDS:
            rounds.append(f"""
u{r} AS (SELECT part, entry, place, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x
  FROM (SELECT part, entry, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM a{r}) GROUP BY ALL),
b{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(n.v, b.v) AS v FROM b{r} b
  LEFT JOIN (SELECT part, entry, list(x ORDER BY place) AS v FROM u{r} GROUP BY ALL) n USING (part, entry))""")
    chain = ",".join(rounds)
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, p AS part, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] AS v
  FROM kept, range({PARTS}) t(p)),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v FROM parts
  QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= {ENTRIES}),{chain},
books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS}),
codes AS (SELECT vec_id, string_agg(printf('%02x', CAST(entry AS INTEGER)), '' ORDER BY part) AS code,
  CAST(sum(error) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM codes JOIN kept USING (vec_id), books
"""
