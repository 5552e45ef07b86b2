"""Removal of long repeated byte strings by suffix arrays over shards.

Every window of ``LENGTH`` bytes has an anchor: the smallest hash among its ``GRAM``-byte grams, the leftmost of equal
ones. Equal windows have equal anchors at equal places, so they can meet in a shard chosen by the anchor's hash. The
windows of one anchor are neighbours; together they are one extract of the text, ``2 * LENGTH`` bytes at most.

1. Texts become anchors and digests; equal texts are one from here on, with a count.
2. Anchors that occur once drop out (counted inside the map tasks). Equal extracts are one, with a count.
3. Each distinct extract is cut from one text and sent to its anchor's shard. The shard's suffix array is made by
   induced sorting, permuted common prefixes are computed from it, and windows that share ``LENGTH`` bytes with a
   neighbour in order, or whose extract was counted twice, are repeated.
4. Repeated windows go back to every text that has the extract, become byte spans, and are cut out.

Shards are sized by the counted bytes. An anchor whose distinct extracts alone exceed a shard is not gathered: each of
its windows is hashed and counted instead, which is the same question asked window by window.

Defined results: null is the empty text; texts shorter than ``LENGTH`` stay whole; repeats inside one text count; all
copies are cut, strings are judged on the input; repeated rows are copies of each other; null ids are passed on; an
empty table gives no rows; further columns are ignored. A cut can part a multi-byte character, as bytes are judged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issuequarry.llm.common import batches, hash_spans, lists, mix, signed, text_bytes
from issuequarry.llm.suffix_arrays import repeated_starts
from issuequarry.session import checkpointed

LENGTH = 400
GRAM = 32
#: Bytes of distinct extracts in one shard, about, and the most that one anchor may bring.
SHARD_BYTES = 2 << 20
FILTER_BITS = 22

_KEY = "hi bigint, lo bigint"


def text_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each text."""
    raw = b"".join(xxhash.xxh3_128_digest(t) for t in texts)
    both = np.frombuffer(raw, dtype=np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _window_minima(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` neighbours, by running minima of blocks from both sides."""
    n = len(x)
    if n < width:
        return x[:0]
    padded = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors_of(data: np.ndarray, starts: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """All extracts: text number, anchor hash, content hash, first byte in the text, bytes."""
    n = len(data) - gram + 1
    empty = np.zeros(0, dtype=np.int64)
    if len(data) < length:
        return empty, empty.view(np.uint64), empty.view(np.uint64), empty, empty
    at = np.arange(n)
    hashes = hash_spans(data, at, at + gram)
    low = np.uint64(max(1, n.bit_length()))
    packed = (hashes >> low << low) | at.astype(np.uint64)
    anchor = (_window_minima(packed, length - gram + 1) & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    text = np.searchsorted(starts, at[: len(anchor)], side="right") - 1
    whole = at[: len(anchor)] + length <= starts[text + 1] - 1  # the blank behind a text is not part of it
    first = np.flatnonzero(whole & np.concatenate(([True], (anchor[1:] != anchor[:-1]) | ~whole[:-1] | (text[1:] != text[:-1]))))
    stop = np.flatnonzero(whole & np.concatenate(((anchor[1:] != anchor[:-1]) | ~whole[1:] | (text[1:] != text[:-1]), [True])))
    size = stop - first + length
    return text[first], hashes[anchor[first]], hash_spans(data, first, first + size) ^ mix((anchor[first] - first).astype(np.uint64)), first - starts[text[first]], size


def _scan(length: int, gram: int):
    def scan(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream):
            texts = [b"" if t is None else t for t in batch.column("text").cast(pa.binary()).to_pylist()]
            hi, lo = text_keys(texts)
            text, gram_hash, content, first, size = anchors_of(*text_bytes(batch.column("text")), length, gram)
            fields = {"g": pa.array(signed(gram_hash)), "x": pa.array(signed(content)), "at": pa.array(first.astype(np.int32)), "size": pa.array(size.astype(np.int32))}
            offsets = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=len(texts))))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(hi), pa.array(lo),
                    pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(list(fields.values()), list(fields))),
                ],
                names=["doc_id", "n_bytes", "hi", "lo", "sha", "anchors"],
            )

    return scan


def _keyed(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(stream):
        texts = batch.column("text").cast(pa.binary())
        hi, lo = text_keys([b"" if t is None else t for t in texts.to_pylist()])
        yield pa.RecordBatch.from_arrays([pa.array(hi), pa.array(lo), texts], names=["hi", "lo", "raw"])


def _extracts(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's wanted extracts."""
    for batch in stream:
        g, x, n, out = [], [], [], []
        for raw, wanted in zip(batch.column("raw").to_pylist(), batch.column("wanted").to_pylist()):
            for w in wanted:
                g.append(w["g"]), x.append(w["x"]), n.append(w["n"]), out.append(raw[w["at"] : w["at"] + w["size"]])
        yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(x, pa.int64()), pa.array(n, pa.int64()), pa.array(out, pa.binary())], names=["g", "x", "n", "extract"])


def _runs(flags: np.ndarray) -> list[int]:
    """Starts and ends of the runs of True, one after the other."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).view(np.int8)))
    return edge.tolist()


def _sorted_shard(length: int):
    def shard(table: pa.Table) -> pa.Table:
        starts = repeated_starts(table.column("extract").to_pylist(), length)
        counts = table.column("n").to_pylist()
        runs = [[0, len(own)] if n > 1 else _runs(own) for own, n in zip(starts, counts)]
        return pa.table({"g": table.column("g"), "x": table.column("x"), "runs": pa.array(runs, pa.list_(pa.int32()))})

    return shard


def _windows(length: int):
    """Every window of the extracts of crowded anchors: hash, place."""
    def spell(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for k, raw in enumerate(batch.column("extract").to_pylist()):
                keys = [xxhash.xxh3_128_digest(raw[a : a + length]) for a in range(len(raw) - length + 1)]
                one = batch.slice(k, 1)
                take = pa.array(np.zeros(len(keys), dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*(one.column(c).take(take) for c in ("g", "x", "n")), pa.array(keys, pa.binary()), pa.array(range(len(keys)), pa.int32())],
                    names=["g", "x", "n", "w", "at"],
                )

    return spell


def _cut(length: int):
    """Merged spans, counts and the digest of what is left of each text."""
    def cut(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            removed, spans, digests, kept = [], [], [], []
            for raw, found in zip(batch.column("raw").to_pylist(), batch.column("found").to_pylist()):
                parts, at, end, count = [], 0, -1, 0
                for lo, hi in sorted((f["lo"], f["hi"]) for f in found):
                    if lo > end:
                        parts.append(raw[at:lo])
                        count += 1
                        at = end = hi
                    elif hi > end:
                        at = end = hi
                rest = b"".join([*parts, raw[at:]])
                removed.append(len(raw) - len(rest)), spans.append(count), digests.append(hashlib.sha256(rest).hexdigest()), kept.append(rest)
            yield pa.RecordBatch.from_arrays(
                [batch.column("hi"), batch.column("lo"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.binary())],
                names=["hi", "lo", "n_removed", "n_spans", "cut_sha", "kept_bytes"],
            )

    return cut


def cut_texts(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """(a row per document with its text's key, a row per text that loses bytes with what is left of it)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    lean = docs.select("doc_id", "text")
    anchors = "array<struct<g:bigint,x:bigint,at:int,size:int>>"
    rows = checkpointed(lean.mapInArrow(_scan(length, gram), f"doc_id {kind}, n_bytes bigint, {_KEY}, sha string, anchors {anchors}"), "suffix-anchors")
    texts = rows.filter(F.size("anchors") > 0).groupBy("hi", "lo", "anchors").agg(F.count("*").alias("m"))
    texts = checkpointed(texts, "suffix-texts")
    places = texts.select("hi", "lo", "m", F.explode("anchors").alias("a")).select("hi", "lo", "m", "a.*")
    # Sides with one row per key are written first: then the other side's hot keys can be split at run time.
    again = checkpointed(places.groupBy("g").agg(F.sum("m").alias("n")).filter("n > 1").select("g"), "suffix-again")
    places = checkpointed(places.join(again, "g"), "suffix-places")
    contents = places.groupBy("g", "x").agg(F.sum("m").alias("n"), F.min(F.struct("hi", "lo", "at", "size")).alias("r"))
    contents = checkpointed(contents.select("g", "x", "n", "r.*"), "suffix-contents")

    # Texts with a place, once each. The filter over keys has a fixed size whatever the corpus.
    slot = lambda key: F.pmod(key, F.lit(1 << FILTER_BITS)).cast("int")
    named = places.select("hi", "lo").distinct()
    used = named.select(slot(F.col("hi")).alias("s")).distinct().toArrow().column("s").to_numpy()
    bits = np.zeros(1 << FILTER_BITS, dtype=bool)
    bits[used] = True

    def needed(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _keyed(stream):
            keys = batch.column("hi").to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(bits[keys % (1 << FILTER_BITS)]))

    raw = lean.select("text").mapInArrow(needed, f"{_KEY}, raw binary").join(named, ["hi", "lo"], "left_semi")
    raw = checkpointed(raw.groupBy("hi", "lo").agg(F.first("raw").alias("raw")), "suffix-raw")

    wanted = contents.groupBy("hi", "lo").agg(F.collect_list(F.struct("g", "x", "n", "at", "size")).alias("wanted"))
    cut = raw.join(wanted, ["hi", "lo"]).select("raw", "wanted").mapInArrow(_extracts, "g bigint, x bigint, n bigint, extract binary")
    weights = checkpointed(contents.groupBy("g").agg(F.sum("size").alias("bytes")), "suffix-weights")
    total = weights.agg(F.sum("bytes")).first()[0] or 0
    shards = max(1, -(-int(total) // shard_bytes))
    crowded = weights.filter(F.col("bytes") > shard_bytes).select("g", F.lit(True).alias("crowded"))
    extracts = checkpointed(cut.join(crowded, "g", "left"), "suffix-extracts")
    usual = extracts.filter("crowded IS NULL").select("g", "x", "n", "extract", F.pmod(F.xxhash64("g"), F.lit(shards)).alias("shard"))
    judged = usual.groupBy("shard").applyInArrow(lambda t: _sorted_shard(length)(t), "g bigint, x bigint, runs array<int>")
    spelt = extracts.filter("crowded").select("g", "x", "n", "extract").mapInArrow(_windows(length), "g bigint, x bigint, n bigint, w binary, at int")
    twice = checkpointed(spelt.groupBy("g", "w").agg(F.sum("n").alias("total")).filter("total > 1").select("g", "w"), "suffix-twice")
    single = spelt.join(twice, ["g", "w"]).select("g", "x", F.array(F.col("at"), F.col("at") + 1).alias("runs"))
    judged = checkpointed(judged.unionByName(single).filter(F.size("runs") > 0), "suffix-judged")

    spans = places.select("g", "x", "hi", "lo", "at").join(judged, ["g", "x"]).select(
        "hi", "lo", F.explode(F.transform(
            F.sequence(F.lit(0), F.size("runs") - 2, F.lit(2)),
            lambda i: F.struct((F.col("at") + F.get("runs", i)).alias("lo"), (F.col("at") + F.get("runs", i + 1) + (length - 1)).alias("hi")),
        )).alias("f"),
    )
    found = spans.groupBy("hi", "lo").agg(F.collect_list("f").alias("found"))
    left = raw.join(found, ["hi", "lo"]).mapInArrow(_cut(length), f"{_KEY}, n_removed bigint, n_spans bigint, cut_sha string, kept_bytes binary")
    return rows, left


def removals(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows, left = cut_texts(docs, length)
    joined = rows.select("doc_id", "n_bytes", "hi", "lo", "sha").join(left.drop("kept_bytes"), ["hi", "lo"], "left")
    zero = F.lit(0).cast("bigint")
    return joined.select(
        "doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("cut_sha", "sha").alias("kept_sha256"),
    )


def kept_bytes(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id and the bytes that are left, for documents that lose some; all others keep their text."""
    rows, left = cut_texts(docs, length)
    return rows.select("doc_id", "hi", "lo").join(left, ["hi", "lo"]).select("doc_id", "n_removed", "kept_bytes")
