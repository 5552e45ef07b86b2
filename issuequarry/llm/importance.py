"""Importance resampling towards a target corpus, with Arrow kernels.

Features are all runs of one to three words, hashed to a fixed number of buckets. A bucket's gain is the logarithm of
how much likelier it is in the target than in the corpus; a document weighs the sum of its features' gains, and
Gumbel noise drawn from its id turns weights into a sample without replacement: the highest scores are drawn.

Inside a task, texts are lower-cased, cut and flattened by Arrow kernels and words become dictionary indices. Indices
shifted by one and two places form the longer runs; each *distinct* run is hashed once, by carrying the CRC of its
beginning on over its last word, and the buckets are taken back to the places where the run stands. Two passes read
the texts: one counts buckets (one dense table per task, so at most ``BUCKETS`` rows a task travel), one weighs
documents. What reaches the driver and the tasks is ``BUCKETS`` numbers, whatever the size of the corpus. The ranking
sorts narrow rows over ranges of the score.

Defined results: a null, empty or wordless text has no features and weight 0. A null doc_id draws its noise from the
empty text and ranks behind equal scores with an id. Repeated rows are rows of their own with neighbouring ranks; ties
go to the smaller id. An empty corpus gives no rows, an empty target counts as no features. Very long texts are
handled one at a time in one task; further columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from issuequarry.llm.common import batches, row_keys, texts_of
from issuequarry.session import checkpointed, written

#: Fixed pattern of what stands between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
LONGEST_RUN = 3
SEED = 42
LEAST_WORDS = 20
PERCENT = 5
#: Words of more bytes are hashed one by one instead of by tables.
_TABLED = 64
_carry: dict[int, np.ndarray] = {}


def _carry_table(length: int) -> np.ndarray:
    """What each byte of a CRC becomes when ``length`` more bytes follow: 4 x 256 values to be combined by xor."""
    if length not in _carry:
        zeros = bytes(length)
        none = zlib.crc32(zeros)
        bits = np.array([zlib.crc32(zeros, 1 << b) ^ none for b in range(32)], dtype=np.uint32).reshape(4, 8)
        table = np.zeros((4, 256), dtype=np.uint32)
        for b in range(8):
            held = (np.arange(256) >> b & 1).astype(bool)
            table[:, held] ^= bits[:, b, None]
        _carry[length] = table
    return _carry[length]


def carried(crcs: np.ndarray, tails: list[bytes], which: np.ndarray) -> np.ndarray:
    """CRC of ``a + tails[which]`` for each CRC of an ``a``."""
    sizes = np.fromiter(map(len, tails), dtype=np.int64, count=len(tails))[which]
    out = np.fromiter(map(zlib.crc32, tails), dtype=np.uint32, count=len(tails))[which]
    short = np.flatnonzero(sizes <= _TABLED)
    if len(short):
        lengths, at = np.unique(sizes[short], return_inverse=True)
        tables = np.stack([_carry_table(int(n)) for n in lengths])
        begun = crcs[short]
        for byte in range(4):
            out[short] ^= tables[at, byte, begun >> np.uint32(8 * byte) & np.uint32(255)]
    for k in np.flatnonzero(sizes > _TABLED).tolist():
        out[k] = zlib.crc32(tails[which[k]], int(crcs[k]))
    return out


class Runs:
    """Words and buckets of a batch: word counts per text and, per run length, the bucket at every place."""

    def __init__(self, texts: pa.Array):
        # No cast to large_string here: Arrow reads the wrong bytes when it widens the offsets of a slice.
        lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), pattern=BETWEEN)
        words = pc.list_flatten(lists)
        text_of = pc.list_parent_indices(lists).to_numpy()
        real = pc.not_equal(words, "")
        words, text_of = words.filter(real), text_of[real.to_numpy(zero_copy_only=False)]
        self.n_words = np.bincount(text_of, minlength=len(texts)).astype(np.int64)
        coded = words.dictionary_encode()
        spelled = coded.dictionary.cast(pa.large_binary()).to_pylist()
        tails = [b" " + word for word in spelled]
        index = coded.indices.to_numpy().astype(np.int64)
        crcs = np.fromiter(map(zlib.crc32, spelled), dtype=np.uint32, count=len(spelled))
        run, self.buckets = index, [crcs[index] % np.uint32(BUCKETS)]
        # Place i holds the run that starts at word i; runs that leave their text are not looked at.
        self.places = [np.arange(len(index))]
        for length in range(2, LONGEST_RUN + 1):
            last = length - 1
            inside = np.flatnonzero(text_of[: len(index) - last] == text_of[last:]) if len(index) > last else np.zeros(0, dtype=np.int64)
            at = np.searchsorted(self.places[-1], inside)
            longer = pa.array(run[at] * max(1, len(spelled)) + index[inside + last]).dictionary_encode()
            distinct = longer.dictionary.to_numpy().astype(np.int64)
            crcs = carried(crcs[distinct // max(1, len(spelled))], tails, distinct % max(1, len(spelled)))
            run = longer.indices.to_numpy().astype(np.int64)
            self.buckets.append(crcs[run] % np.uint32(BUCKETS))
            self.places.append(inside)

    def counts(self) -> np.ndarray:
        return sum(np.bincount(b, minlength=BUCKETS) for b in self.buckets)

    def n_features(self) -> np.ndarray:
        return sum(np.maximum(self.n_words - k, 0) for k in range(LONGEST_RUN))

    def weights(self, gains: np.ndarray) -> np.ndarray:
        """Sum of the gains of each text."""
        at_place = np.zeros(len(self.places[0]), dtype=np.int64)
        for place, bucket in zip(self.places, self.buckets):
            at_place[place] += gains[bucket]
        sums = np.concatenate(([0], np.cumsum(at_place)))
        ends = np.cumsum(self.n_words)
        return sums[ends] - sums[ends - self.n_words]


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How many features fall in each bucket, over all texts; at most ``BUCKETS`` rows reach the driver."""

    def count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches(stream):
            total += Runs(batch.column("text")).counts()
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["bucket", "n"])

    rows = texts.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, dtype=np.int64)
    for row in rows.collect():
        out[row.bucket] = row.n
    return out


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed share in the target and in the corpus."""
    s, t = float(corpus.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    ratio = ((target + 1.0) * s) / ((corpus + 1.0) * t)
    return np.array([math.floor(1000 * math.log(x)) for x in ratio.tolist()], dtype=np.int64)


def _noise(doc_id: Column) -> Column:
    digits = F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("bigint")
    return F.floor(F.lit(-1000) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("bigint")


def scored(docs: DataFrame, gains: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and a key per row."""

    def weigh(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for batch in batches(stream):
            runs = Runs(batch.column("text"))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(row_keys(batch.num_rows, state)), pa.array(runs.n_words),
                pa.array(runs.n_features()), pa.array(runs.weights(gains)),
            ], names=["doc_id", "key", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    weighed = texts_of(docs).mapInArrow(weigh, f"doc_id {kind}, key long, n_words long, n_features long, weight long")
    return weighed.withColumn("score", F.col("weight") + _noise(F.col("doc_id")))


def ranked(rows: DataFrame, limit: int) -> DataFrame:
    """``rank`` 1 to ``limit`` by descending score, then doc_id; null beyond.

    Rows are sorted over ranges and numbered inside each range; the sizes of the ranges, one row each, give the rest.
    """
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("key")]
    place = F.monotonically_increasing_id()
    placed = checkpointed(
        rows.repartitionByRange(*order).sortWithinPartitions(*order)
        .select("*", F.shiftright(place, 33).alias("part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("at")),
        "importance-ranges",
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rank = (F.col("before") + F.col("at") + 1).cast("bigint")
    return placed.join(F.broadcast(offsets), "part").withColumn("rank", F.when(rank <= limit, rank)).drop("part", "at", "before")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Every document with n_features, weight, score and rank; the drawn share of those with enough words has a rank."""
    gains = gains_of(bucket_counts(docs), bucket_counts(target))
    rows, facts = written(scored(docs, gains), "importance-scores", n=F.count_if(F.col("n_words") >= least_words))
    enough = F.col("n_words") >= least_words
    drawn = ranked(rows.filter(enough), percent * (facts["n"] or 0) // 100)
    rest = rows.filter(~enough).withColumn("rank", F.lit(None).cast("bigint"))
    return drawn.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
