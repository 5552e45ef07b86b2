"""Packing token sequences by minimum bin slack.

Every document's ids (with the end id) are cut into windows of ``CAPACITY``; full windows are sequences of their own.
What remains of each document has a length below the capacity, so all that planning needs is a table of counts per
length, which has less than ``CAPACITY`` rows whatever the corpus. Each step of the plan takes the longest remaining
length and lets a bitset subset-sum search pick the multiset of remaining lengths that comes closest to filling the
window; the choice is traced back to counts and used as often as the counts allow. Pieces are then numbered per
length, and their number says which sequence and place they get.

Numbers come from counts per (task, length) taken while the pieces are made, so no length is ever sorted or gathered
in one task, however hot it is.

Defined results: a null or empty text is the end id alone; repeated rows are packed each; ids are not used to place
rows, so null ids do no harm; an empty table has no pieces; a long text gives many pieces; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from issuequarry.llm.common import batches, lists
from issuequarry.llm.tokens import default_path, encode_column
from issuequarry.session import checkpointed

CAPACITY = 2048


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, within ``counts``, whose sum is the largest up to ``room``.

    Bit s of ``reach`` says that s is a sum of the lengths seen so far. Counts are split into powers of two, so a
    length costs few shifts; the states before each shift are kept and walked backwards.
    """
    whole = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left:
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= (reach << (length * k)) & whole
            left -= k
            k *= 2
        if reach >> room:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + k
            total -= length * k
    return chosen


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first number, pieces per sequence, first sequence, first offset), for all counted lengths."""
    left = {n: c for n, c in counts.items() if c}
    taken = dict.fromkeys(left, 0)
    rows, sequence = [], 0
    while left:
        longest = max(left)
        rest = {n: c - (n == longest) for n, c in left.items() if c > (n == longest)}
        pattern = fill(rest, capacity - longest)
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(left[n] // k for n, k in pattern.items())
        offset = 0
        for n in sorted(pattern, reverse=True):
            k = pattern[n]
            rows.append((n, taken[n], k, sequence, offset))
            taken[n] += k * times
            left[n] -= k * times
            if not left[n]:
                del left[n]
            offset += n * k
        sequence += times
    return rows


def _cut(path: str, capacity: int, with_ids: bool):
    def cut(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches(stream):
            ids, starts = encode_column(batch.column("text"), path)
            sizes = np.diff(starts)
            pieces = -(-sizes // capacity)
            owner = np.repeat(np.arange(len(sizes)), pieces)
            first = (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
            length = np.minimum(capacity, sizes[owner] - first)
            at = starts[owner] + first
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = np.fromiter((zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist())), dtype=np.int64, count=len(at))
            # Number of each piece among those of its length in this task.
            order = np.argsort(length, kind="stable")
            ranked = length[order]
            begin = np.flatnonzero(np.diff(ranked, prepend=-1))
            number = np.empty(len(order), dtype=np.int64)
            number[order] = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order)))) + seen[ranked]
            seen += np.bincount(length, minlength=capacity + 1)
            columns = [
                batch.column("doc_id").take(pa.array(owner)), pa.array(first), pa.array(length), pa.array(crc),
                pa.array(sizes[owner]), pa.array(np.full(len(at), task, dtype=np.int64)), pa.array(number),
            ]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "number"]
            if with_ids:
                columns.append(lists(ids.astype(np.int32), length, pa.int32()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return cut


def _placed(rows: list[tuple[int, int, int, int, int]]):
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    keys = table[:, 0] << 48 | table[:, 1]

    def place(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            _, first, each, sequence, offset = table[np.searchsorted(keys, length << 48 | rank, side="right") - 1].T
            nth = rank - first
            kept = [(n, batch.column(n)) for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays(
                [c for _, c in kept] + [pa.array(sequence + nth // each), pa.array(offset + nth % each * length)],
                names=[n for n, _ in kept] + ["sequence_id", "offset"],
            )

    return place


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece; with ``with_ids`` also its token ids."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    given = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    ids = ", ids array<int>" if with_ids else ""
    cut = docs.select("doc_id", "text").mapInArrow(_cut(path or default_path(), capacity, with_ids), f"{given}, task bigint, number bigint{ids}")
    pieces = checkpointed(cut, "pack-pieces")
    counted = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    # One row per task and length: never more than a fraction of the pieces, and no piece is sorted.
    first = counted.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # CAPACITY rows at most
    ranked = pieces.join(first, ["task", "length"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else []), (F.col("first") + F.col("number")).alias("rank"),
    )
    return ranked.mapInArrow(_placed(plan(counts, capacity)), f"{given}{ids}, sequence_id bigint, offset bigint")


def sequences(packed: DataFrame) -> DataFrame:
    """The token ids of each sequence, from a packing made with ids. A sequence holds ``CAPACITY`` ids at most."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return parts.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))
