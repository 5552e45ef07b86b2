"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad. Its features are counts read off its bytes (share of capitals, symbols, repeats, word
lengths, ...), those of the line before and of the line after. Forward-backward gives each line's marginal; a document's
score is their mean, weighted by line length. Lines learn from their document's label.

Fitting uses about ``TRAIN_DOCS`` labelled documents, chosen by hash from those whose crc32(doc_id as text) mod 3 is
not 1; only their line features reach the driver. Scoring is one narrow pass over all whole texts without a shuffle.

Defined results: null and empty texts, or texts without words, count as one line of no features and get the score that
the fitted bias gives such a line; without any usable label every score is 0.5. Labels that contradict each other are
left out, repeated ones count once; null labels are ignored. Repeated rows get equal scores, empty tables no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from issuequarry.llm.common import batches, hash_spans, lists, sampled, spans_of, text_bytes

TRAIN_DOCS = 3000
ROUNDS = 120
FEATURES = 15

_CLASSES = {
    "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": b"0123456789", "symbol": b"#*$%&|<>@^~=_{}[]\\",
    "shout": b"!?", "stop": b".,;:", "accent": bytes([0xC3]),
}
_TABLE = np.zeros((len(_CLASSES), 256), dtype=np.uint8)
for _row, _members in zip(_TABLE, _CLASSES.values()):
    _row[list(_members)] = 1
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def line_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line with a word, line lengths in bytes, and how many lines each text has (1 at least)."""
    data, starts = text_bytes(column)
    n_texts = len(starts) - 1
    begin, end = spans_of(~_BLANK[data])
    text_of_word = np.searchsorted(starts, begin, side="right") - 1
    breaks = np.searchsorted(np.flatnonzero(data == 10), begin)
    opens = np.flatnonzero(np.concatenate(([True], (np.diff(breaks) > 0) | (np.diff(text_of_word) > 0)))[: len(begin)])
    n_words = np.diff(np.append(opens, len(begin)))
    line_begin, line_end = begin[opens], end[np.append(opens[1:], len(begin)) - 1] if len(opens) else begin[opens]
    text = text_of_word[opens]
    size = (line_end - line_begin).astype(np.float64)

    bounds = np.stack((line_begin, line_end), axis=1).ravel()  # a blank ends each text, so ends are places too

    def per_line(flags: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flags, bounds, dtype=np.int64)[::2].astype(np.float64) if len(bounds) else np.zeros(0)

    upper, lower, digit, symbol, shout, stop, accent = (per_line(row[data]) for row in _TABLE)
    if len(data):  # capitals of the Latin-1 block: C3 80 to C3 9E
        upper += per_line(np.concatenate(([False], (data[:-1] == 0xC3) & (data[1:] <= 0x9E))))
    words = hash_spans(data, begin, end)
    line_of_word = np.repeat(np.arange(len(opens)), n_words)

    def share(flags: np.ndarray) -> np.ndarray:
        return np.bincount(line_of_word[flags], minlength=len(opens)) / np.maximum(1, n_words)

    same = np.concatenate(([False], (words[1:] == words[:-1]) & (line_of_word[1:] == line_of_word[:-1])))[: len(words)]
    lone = np.zeros(len(words), dtype=bool)
    lone[:] = (end - begin == 1) & ~_TABLE[1][data[begin]].astype(bool) & ~_TABLE[0][data[begin]].astype(bool)
    whole = hash_spans(data, line_begin, line_end) ^ (text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(whole, kind="stable")
    again = np.zeros(len(opens), dtype=np.float64)
    again[order[1:]] = whole[order[1:]] == whole[order[:-1]]
    letters = np.maximum(1, upper + lower + accent)
    length = np.maximum(1, size)
    features = np.stack([
        upper / letters, digit / length, symbol / length, symbol / np.maximum(1, n_words), shout / np.maximum(1, n_words),
        stop / np.maximum(1, n_words), accent / length, np.log1p(n_words), size / np.maximum(1, n_words), share(same), share(lone), again,
        (np.isin(data[line_end - 1], list(b".!?")) if len(opens) else size).astype(np.float64), np.log1p(size), (n_words < 4).astype(np.float64),
    ], axis=1).reshape(-1, FEATURES)
    counts = np.bincount(text, minlength=n_texts)
    if (counts == 0).any():  # texts without words: one line without features
        at = np.cumsum(counts)[counts == 0]
        features = np.insert(features, at, 0.0, axis=0)
        size = np.insert(size, at, 1.0)
        counts = np.maximum(counts, 1)
    return features, size, counts


def _neighbours(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each line's features with those of the lines around it, two edge flags and a bias."""
    ends = np.cumsum(counts)
    first, last = np.zeros(len(x), dtype=bool), np.zeros(len(x), dtype=bool)
    first[ends - counts], last[ends - 1] = True, True
    before, after = np.roll(x, 1, axis=0), np.roll(x, -1, axis=0)
    before[first], after[last] = 0, 0
    return np.concatenate((x, before, after, first[:, None], last[:, None], np.ones((len(x), 1))), axis=1)


def _steps(counts: np.ndarray) -> Iterator[np.ndarray]:
    """Per step t the numbers of the lines that are t-th of their document."""
    order = np.argsort(-counts, kind="stable")
    start, length = (np.cumsum(counts) - counts)[order], counts[order]
    for t in range(int(length[0]) if len(length) else 0):
        yield start[: np.searchsorted(-length, -t, side="left")] + t


def messages(e: np.ndarray, trans: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log-odds of good against bad; their sum is the marginal's log-odds."""
    ahead, back = e.copy(), np.zeros_like(e)
    steps = list(_steps(counts))
    add = np.logaddexp
    for now in steps[1:]:
        a = ahead[now - 1]
        ahead[now] += add(a + trans[1, 1], trans[0, 1]) - add(a + trans[1, 0], trans[0, 0])
    for now in reversed(steps[1:]):
        b = e[now] + back[now]
        back[now - 1] = add(b + trans[1, 1], trans[1, 0]) - add(b + trans[0, 1], trans[0, 0])
    return ahead, back


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fit(x: np.ndarray, counts: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Weights by gradient ascent (Adam) on the chain likelihood; ``labels`` per document."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    phi = _neighbours((x - mean) / scale, counts)
    y = np.repeat(labels, counts).astype(np.float64)
    ends = np.cumsum(counts)
    edge = np.setdiff1d(np.arange(len(x)), ends - 1)  # each line that has a next one
    seen = np.array([[((y[edge] == s) & (y[edge + 1] == t)).sum() for t in (0, 1)] for s in (0, 1)], dtype=np.float64)
    n = max(1, len(labels))
    theta = np.zeros(phi.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        w, trans = theta[:-4], theta[-4:].reshape(2, 2)
        e = phi @ w
        ahead, back = messages(e, trans, counts)
        p = _sigmoid(ahead + back)
        a, b = ahead[edge], (e + back)[edge + 1]
        joint = np.stack([np.full(len(edge), trans[0, 0]), b + trans[0, 1], a + trans[1, 0], a + b + trans[1, 1]])
        joint = np.exp(joint - joint.max(axis=0)) if len(edge) else joint
        expected = (joint / joint.sum(axis=0)).sum(axis=1).reshape(2, 2) if len(edge) else np.zeros((2, 2))
        gradient = np.concatenate((phi.T @ (y - p), (seen - expected).ravel())) / n - 1e-3 * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        theta += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return {"mean": mean, "scale": scale, "w": theta[:-4], "trans": theta[-4:].reshape(2, 2)}


def document_scores(model: dict[str, np.ndarray] | None, x: np.ndarray, size: np.ndarray, counts: np.ndarray) -> np.ndarray:
    if model is None:
        return np.full(len(counts), 0.5)
    if not len(counts):
        return np.zeros(0)
    e = _neighbours((x - model["mean"]) / model["scale"], counts) @ model["w"]
    ahead, back = messages(e, model["trans"], counts)
    at = np.cumsum(counts) - counts
    return np.add.reduceat(_sigmoid(ahead + back) * size, at) / np.add.reduceat(size, at)


def _extract(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(stream):
        x, _, counts = line_features(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("label"), lists(x.astype(np.float32).ravel(), counts * FEATURES, pa.float32())], names=["label", "features"])


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1


def learn(docs: DataFrame, labels: DataFrame, about: int = TRAIN_DOCS) -> dict[str, np.ndarray] | None:
    """The model of about ``about`` labelled documents; None without labels of both kinds."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).filter(~held_out())
    agreed = known.groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("most")).filter("label = most")
    # About TRAIN_DOCS ids and small integers: bounded by the parameter, so they may be broadcast.
    chosen = F.broadcast(sampled(agreed.select("doc_id", F.col("label").cast("int")), ["doc_id"], about))
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select("label", "text").mapInArrow(_extract, "label int, features array<float>").toArrow()
    label = np.array(rows.column("label").to_pylist(), dtype=np.int64)
    if len(set(label.tolist())) < 2:
        return None
    features = rows.column("features").combine_chunks()
    counts = np.diff(features.offsets.to_numpy()) // FEATURES
    x = features.flatten().to_numpy().reshape(-1, FEATURES).astype(np.float64)
    # An order of its own makes the sums, and so the model, the same on every run.
    key = np.lexsort((*np.add.reduceat(x, np.cumsum(counts) - counts).T, counts, label))
    take = np.concatenate([np.arange(b, b + c) for b, c in zip((np.cumsum(counts) - counts)[key], counts[key])])
    return fit(x[take], counts[key], label[key])


def scored(docs: DataFrame, model: dict[str, np.ndarray] | None, name: str = "_score") -> DataFrame:
    """The documents, all their columns, with the score as column ``name``. Only the text is read for it."""
    columns = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def score(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream):
            found = document_scores(model, *line_features(batch.column("text")))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(found)], names=[*columns, name])

    return docs.mapInArrow(score, schema)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = learn(docs, labels)
    lean = docs.select("doc_id", "text")

    def score(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(document_scores(model, *line_features(batch.column("text"))))], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return lean.mapInArrow(score, f"doc_id {kind}, score double").select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
