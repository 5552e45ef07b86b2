"""Substring dedup by sliding sentence spans.

A sentence ends after ``.``, ``!`` or ``?`` at the end of a word, or at a line break; a longer one than ``LONGEST``
words is cut every ``LONGEST`` words, so that long passages without full stops have spans too. Every run of ``RUN``
consecutive sentences is hashed. Hashes are counted over the whole corpus, occurrences of repeated ones are joined
back, the first of each (by doc_id, then row, then place) stays, and sentences covered by any other are removed.

Counting combines inside the map tasks, and the joins have one row per hash on one side, so a passage in a third of
all documents is split by adaptive execution. Only hashes and places are shuffled, never texts.

``removals`` misses some repeats that start or end in mid-sentence: a passage merged with the text around it may keep fewer
than ``RUN`` sentences of its own, and long sentences are cut by count. ``passages`` covers these. Its pieces begin at
the smallest word hash of any ``REACH`` words, whatever is around them, and a run goes on to the first piece ``LEAST``
words on. Cuts differ only within ``REACH - 1`` words of a shared stretch's edges, so every stretch of
``LEAST + 4 * REACH - 3`` = 51 words has a run in common wherever it stands, and no shorter repeat than ``LEAST`` is removed.

Defined results: null and empty texts have no sentences; texts of fewer than ``RUN`` sentences have no span and stay;
repeats inside one text count; of equal texts the one with the smallest id stays whole; rows of one id are told apart
by row; null ids come first; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issuequarry.llm.common import BASE, INVERSE, _powers_of, batches, hash_runs, hash_spans, lists, mix, row_keys, signed, spans_of, text_bytes
from issuequarry.session import checkpointed

RUN = 3
LONGEST = 16
REACH = 8
LEAST = 22

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[33, 46, 63]] = True


def sentences_of(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte spans of the sentences of all texts, and how many each text has."""
    begin, end = spans_of(~_BLANK[data])
    if not len(begin):
        return begin, end, np.zeros(len(starts) - 1, dtype=np.int64)
    breaks = np.flatnonzero(data == 10)
    text = np.searchsorted(starts, begin, side="right") - 1
    closes = _STOP[data[end[:-1] - 1]] | (np.searchsorted(breaks, begin[1:]) > np.searchsorted(breaks, end[:-1])) | (text[1:] != text[:-1])
    opens = np.flatnonzero(np.concatenate(([True], closes)))
    place = np.arange(len(begin)) - np.repeat(opens, np.diff(np.append(opens, len(begin))))
    first = np.flatnonzero(place % LONGEST == 0)
    last = np.append(first[1:], len(begin)) - 1
    return begin[first], end[last], np.bincount(text[first], minlength=len(starts) - 1)


def _scan(run: int):
    def scan(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for batch in batches(stream):
            data, starts = text_bytes(batch.column("text"))
            begin, end, counts = sentences_of(data, starts)
            runs = hash_runs(hash_spans(data, begin, end), run)
            owner = np.repeat(np.arange(len(counts)), counts)
            inside = owner[: len(runs)] == owner[run - 1 : run - 1 + len(runs)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row_keys(len(counts), state)), batch.column("doc_id"), pa.array(counts.astype(np.int64)),
                    lists(signed(runs[inside]), np.maximum(0, counts - run + 1), pa.int64()),
                    lists((begin - starts[owner]).astype(np.int32), counts, pa.int32()), lists((end - starts[owner]).astype(np.int32), counts, pa.int32()),
                ],
                names=["row", "doc_id", "n_sentences", "runs", "begins", "ends"],
            )

    return scan


def _covered(rows: DataFrame, run: int) -> DataFrame:
    """Per row with something to remove: the numbers of its removed sentences, sorted."""
    places = rows.select("row", "doc_id", F.posexplode("runs").alias("at", "run"))
    # Sides with one row per run are written first: then the other side's hot runs can be split at run time.
    again = checkpointed(places.groupBy("run").agg(F.count("*").alias("n")).filter("n > 1").select("run"), "sentence-again")
    found = checkpointed(places.join(again, "run"), "sentence-found")
    first = checkpointed(found.groupBy("run").agg(F.min(F.struct("doc_id", "row", "at")).alias("first")), "sentence-first")
    later = found.join(first, "run").filter((F.col("row") != F.col("first.row")) | (F.col("at") != F.col("first.at")))
    marks = later.select("row", F.explode(F.sequence("at", F.col("at") + (run - 1))).alias("at")).distinct()
    return marks.groupBy("row").agg(F.sort_array(F.collect_list("at")).alias("removed"))


def scanned(docs: DataFrame, run: int = RUN) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"row bigint, doc_id {kind}, n_sentences bigint, runs array<bigint>, begins array<int>, ends array<int>"
    return checkpointed(docs.select("doc_id", "text").mapInArrow(_scan(run), schema), "sentence-spans")


def removals(docs: DataFrame, run: int = RUN) -> DataFrame:
    """One row per document: sentences, removed sentences and the removed byte spans, gaps of blanks not counted."""
    rows = scanned(docs, run)
    none = F.array().cast("array<int>")
    joined = rows.select("row", "doc_id", "n_sentences", "begins", "ends").join(_covered(rows, run), "row", "left")
    gone = F.coalesce("removed", none)
    size = lambda at: F.get(F.col("ends"), at) - F.get(F.col("begins"), at)
    return joined.select(
        "doc_id", "n_sentences", F.size(gone).cast("bigint").alias("n_removed"),
        F.aggregate(gone, F.lit(0).cast("bigint"), lambda total, at: total + size(at)).alias("removed_bytes"),
        F.array_join(gone.cast("array<string>"), ",").alias("removed"),
    )


def pieces_of(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Numbers of the words that begin a piece: each text's first, and the smallest of any ``REACH`` words of a text."""
    opens = np.zeros(len(words), dtype=bool)
    opens[(np.cumsum(counts) - counts)[counts > 0]] = True
    count = len(words) - REACH + 1
    if count > 0:
        text = np.repeat(np.arange(len(counts)), counts)
        best, step_of = words[:count].copy(), np.zeros(count, dtype=np.int64)
        for step in range(1, REACH):
            other = words[step : step + count]
            better = other < best
            np.copyto(best, other, where=better)
            step_of[better] = step
        opens[(np.arange(count) + step_of)[text[:count] == text[REACH - 1 :]]] = True
    return np.flatnonzero(opens)


def _scan_pieces(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state: dict = {}
    for batch in batches(stream):
        data, starts = text_bytes(batch.column("text"))
        begin, end = spans_of(~_BLANK[data])
        words = mix(hash_spans(data, begin, end))
        per_text = np.diff(np.searchsorted(begin, starts))
        at = pieces_of(words, per_text)
        owner = np.repeat(np.arange(len(per_text)), per_text)[at]
        counts = np.bincount(owner, minlength=len(per_text))
        after = np.append(at, len(words))
        # A run ends where a piece begins, or with its text.
        upto = np.minimum(after[np.searchsorted(at, at + LEAST)], np.cumsum(per_text)[owner])
        whole = upto - at >= LEAST
        up = _powers_of(BASE, len(words))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)], dtype=np.uint64)))
        a, b = at[whole], upto[whole]
        runs = mix((sums[b] - sums[a]) * _powers_of(INVERSE, len(words))[a] + mix((b - a).astype(np.uint64)))
        lasts = np.searchsorted(at, b) - 1 - (np.cumsum(counts) - counts)[owner[whole]]
        n_runs = np.bincount(owner[whole], minlength=len(per_text))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(row_keys(len(counts), state)), batch.column("doc_id"), pa.array(counts.astype(np.int64)),
                lists(signed(runs), n_runs, pa.int64()), lists(lasts.astype(np.int32), n_runs, pa.int32()),
                lists((begin[at] - starts[owner]).astype(np.int32), counts, pa.int32()), lists((end[after[1:] - 1] - starts[owner]).astype(np.int32), counts, pa.int32()),
            ],
            names=["row", "doc_id", "n_pieces", "runs", "lasts", "begins", "ends"],
        )


def passages(docs: DataFrame) -> DataFrame:
    """One row per document: pieces, pieces of passages that are repeated from an earlier place, and their byte spans."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"row bigint, doc_id {kind}, n_pieces bigint, runs array<bigint>, lasts array<int>, begins array<int>, ends array<int>"
    rows = checkpointed(docs.select("doc_id", "text").mapInArrow(_scan_pieces, schema), "passage-pieces")
    places = rows.select("row", "doc_id", F.posexplode(F.arrays_zip("runs", "lasts")).alias("at", "e")).select("row", "doc_id", "at", F.col("e.runs").alias("run"), F.col("e.lasts").alias("last"))
    again = checkpointed(places.groupBy("run").agg(F.count("*").alias("n")).filter("n > 1").select("run"), "passage-again")
    found = checkpointed(places.join(again, "run"), "passage-found")
    first = checkpointed(found.groupBy("run").agg(F.min(F.struct("doc_id", "row", "at")).alias("first")), "passage-first")
    later = found.join(first, "run").filter((F.col("row") != F.col("first.row")) | (F.col("at") != F.col("first.at")))
    covered = later.groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.sequence("at", "last"))))).alias("removed"))
    joined = rows.select("row", "doc_id", "n_pieces", "begins", "ends").join(covered, "row", "left")
    gone = F.coalesce("removed", F.array().cast("array<int>"))
    size = lambda at: F.get(F.col("ends"), at) - F.get(F.col("begins"), at)
    return joined.select(
        "doc_id", "n_pieces", F.size(gone).cast("bigint").alias("n_removed"),
        F.aggregate(gone, F.lit(0).cast("bigint"), lambda total, at: total + size(at)).alias("removed_bytes"),
        F.array_join(F.transform(gone, lambda at: F.concat_ws(":", F.get(F.col("begins"), at), F.get(F.col("ends"), at))), ",").alias("removed"),
    )


def _cut(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        out = []
        for text, begins, ends, gone in zip(*(batch.column(c).to_pylist() for c in ("text", "begins", "ends", "removed"))):
            if gone:
                raw, parts, at = text.encode(), [], 0
                for k in gone:
                    parts.append(raw[at : begins[k]])
                    at = ends[k]
                text = b"".join([*parts, raw[at:]]).decode()
            out.append(text)
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string())], names=["row", "text"])


def deduplicated(docs: DataFrame, run: int = RUN) -> DataFrame:
    """doc_id and the text without its removed sentences. The texts are kept beside the spans, under one row key."""
    keyed = checkpointed(docs.select(F.monotonically_increasing_id().alias("doc_id"), F.col("doc_id").alias("given"), "text"), "sentence-texts")
    numbered = keyed.select(F.struct("given", "doc_id").alias("doc_id"), "text")
    rows = scanned(numbered, run)
    found = rows.join(_covered(rows, run), "row").select(F.col("doc_id.doc_id").alias("doc_id"), "begins", "ends", "removed")
    joined = keyed.join(found, "doc_id", "left")
    cut = joined.select(F.col("doc_id").alias("row"), "text", "begins", "ends", "removed").mapInArrow(_cut, "row bigint, text string")
    return keyed.select(F.col("doc_id").alias("row"), F.col("given").alias("doc_id")).join(cut, "row").drop("row")


#: DuckDB twin of ``removals``.
ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*')) AS w,
        generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*'), 1) AS i FROM t),
b AS (SELECT *, coalesce(sum(CAST(regexp_matches(w, '[.!?][\x20\x09-\x0D]*$') OR contains(w, chr(10)) AS INT))
        OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM w),
k AS (SELECT *, (row_number() OVER (PARTITION BY r, s ORDER BY i) - 1) // 16 AS p FROM b),
s AS (SELECT r, doc_id, min(i) AS i, regexp_replace(string_agg(w, '' ORDER BY i), '[\x20\x09-\x0D]+$', '') AS x FROM k GROUP BY r, doc_id, s, p),
n AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY i) - 1 AS q, lead(x) OVER (PARTITION BY r ORDER BY i) AS x1, lead(x, 2) OVER (PARTITION BY r ORDER BY i) AS x2 FROM s),
g AS (SELECT r, doc_id, q, row_number() OVER (PARTITION BY x, x1, x2 ORDER BY doc_id, r, q) AS nth FROM n WHERE x2 IS NOT NULL),
m AS (SELECT DISTINCT r, unnest([q, q + 1, q + 2]) AS q FROM g WHERE nth > 1),
d AS (SELECT n.r, count(*) AS n_removed, sum(strlen(n.x)) AS removed_bytes, string_agg(CAST(n.q AS VARCHAR), ',' ORDER BY n.q) AS removed
      FROM m JOIN n ON m.r = n.r AND m.q = n.q GROUP BY n.r),
c AS (SELECT r, count(*) AS n_sentences FROM s GROUP BY r)
SELECT doc_id, CAST(coalesce(n_sentences, 0) AS BIGINT) AS n_sentences, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(removed_bytes, 0) AS BIGINT) AS removed_bytes, coalesce(removed, '') AS removed
FROM t LEFT JOIN c USING (r) LEFT JOIN d USING (r)
"""
