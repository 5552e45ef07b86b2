"""Helpers the training-data operators share: reading tables, lean columns, hashing of words in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from issuequarry.session import scratch_path

#: Odd multiplier of the polynomial word hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame) -> DataFrame:
    """Id and text alone: further columns, whatever their names, never reach an operator."""
    return docs.select("doc_id", "text")


class Scratch:
    """Scratch tables of one job, which it empties once nothing reads them any more.

    A table is emptied by writing it anew without rows. Only do so when every frame that reads it has been written itself:
    a lost executor then reads the later table.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def counted(self, df: DataFrame, name: str, **facts: Column) -> tuple[DataFrame, dict]:
        """The written table, and aggregates observed while it was written."""
        path, seen = scratch_path(self.spark, name), Observation()
        if facts:
            df = df.observe(seen, *[fact.alias(key) for key, fact in facts.items()])
        df.write.parquet(path)
        stored = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(stored)] = (stored, path)
        return stored, (seen.get if facts else {})

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        return self.counted(df, name)[0]

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            if id(table) in self.paths:
                stored, path = self.paths.pop(id(table))
                self.spark.createDataFrame([], stored.schema).write.mode("overwrite").parquet(path)

    def drop_all_but(self, *tables: DataFrame) -> None:
        names = {id(table) for table in tables}
        self.drop(*[stored for key, (stored, _) in list(self.paths.items()) if key not in names])


def fresh_names(df: DataFrame, n: int) -> list[str]:
    """Column names that the table does not have, in any spelling."""
    taken = {name.lower() for name in df.columns}
    found = (f"_own{k}" for k in range(n + len(taken) + n))
    return [name for name in found if name not in taken and f"{name}_" not in taken][:n]


def row_keys(n: int, state: dict) -> np.ndarray:
    """Keys of the next ``n`` rows of this task, unlike those of any other task.

    Rows are told apart by these keys, so repeated or null ids stay separate rows. Keys are stored
    with the rows at once: a second run of a lost task replaces both.
    """
    first = state.setdefault("next", TaskContext.get().partitionId() << 33)
    state["next"] = first + n
    return np.arange(first, first + n, dtype=np.int64)


def batches(stream: Iterator[pa.RecordBatch], limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about ``limit`` bytes of column ``text``, or one longer text."""
    for batch in stream:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        start = 0
        while start < len(sizes):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts with one blank after each, and where each text starts (and the last ends).

    Null is read as the empty text. The blanks keep words of neighbouring texts apart.
    """
    texts = [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(x) + 1 for x in texts], out=starts[1:])
    joined = b" ".join(texts) + b" " if texts else b""
    return np.frombuffer(joined, dtype=np.uint8), starts


def spans_of(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    return edge[::2], edge[1::2]


#: Bytes of one block of the prefix sums: what hashing needs beside the data does not grow with a text.
_BLOCK = 1 << 18
_powers: dict[int, np.ndarray] = {}


def _powers_of(base: int, n: int = _BLOCK) -> np.ndarray:
    """base**0 to base**n modulo 2**64; tables of one block are kept."""
    if n == _BLOCK and base in _powers:
        return _powers[base]
    steps = np.full(n + 1, base, dtype=np.uint64)
    steps[0] = 1
    table = np.multiply.accumulate(steps)
    if n == _BLOCK:
        _powers[base] = table
    return table


def _prefix_sums(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The polynomial of all bytes before each place, places in ascending order, a block of the data at a time."""
    up = _powers_of(BASE)
    out = np.zeros(len(at), dtype=np.uint64)
    total, scale = np.zeros(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)
    sums = np.zeros(_BLOCK + 1, dtype=np.uint64)
    blocks = np.arange(0, len(data) + 1, _BLOCK)
    cuts = np.append(np.searchsorted(at, blocks), len(at))
    for block, i, j in zip(blocks.tolist(), cuts[:-1].tolist(), cuts[1:].tolist()):
        part = data[block : block + _BLOCK]
        np.cumsum((part + np.uint64(1)) * up[: len(part)], out=sums[1 : len(part) + 1])
        out[i:j] = total + scale * sums[at[i:j] - block]
        total += scale * sums[len(part)]
        scale *= up[_BLOCK]
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit of a 64-bit value."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, by prefix sums of a polynomial modulo 2**64. Starts and ends ascend."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    far = _powers_of(pow(INVERSE, _BLOCK, 1 << 64), len(data) // _BLOCK)
    down = far[starts // _BLOCK] * _powers_of(INVERSE)[starts % _BLOCK]
    return mix((_prefix_sums(data, ends) - _prefix_sums(data, starts)) * down + mix((ends - starts).astype(np.uint64)))


def hash_runs(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` consecutive word hashes."""
    count = max(0, len(words) - length + 1)
    out = np.full(count, length, dtype=np.uint64)
    for i in range(length):
        out = mix(out * np.uint64(BASE) + words[i : i + count])
    return out


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data | 32, data)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column: ``counts[i]`` of the values belong to row i."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def sampled(rows: DataFrame, keys: list[str], about: int) -> DataFrame:
    """About ``about`` rows, chosen by a hash of their keys at a rate set by the counted total. For model fitting only."""
    grain = 1 << 30
    rate = min(1.0, about / max(1, rows.count()))
    return rows.filter(F.pmod(F.xxhash64(*keys), F.lit(grain)) < F.lit(int(rate * grain)))
