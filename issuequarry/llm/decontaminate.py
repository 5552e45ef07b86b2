"""Benchmark decontamination by winnowing.

Each text is a sequence of word hashes. In every window of ``WINDOW - GRAM + 1`` consecutive grams of ``GRAM`` words
the smallest gram hash is kept (the rightmost of equal ones), so two texts that share ``WINDOW`` words keep one gram
in common inside them. Kept grams of documents and benchmark items meet in a join; each meeting is extended word by
word to both sides, and a run of ``WINDOW`` equal words or more is a hit. Items shorter than ``WINDOW`` words are one
window and are joined by the hash of all their words.

Documents pass once through numpy. A fixed-size filter (``FILTER_BITS``, whatever the benchmark's size) drops grams
that no item can have; what is left, with the words around it, meets the items in a shuffled join in which only the
document side can be hot, so adaptive execution can split it.

Defined results: null or empty texts have no words, no hits and are clean; an empty benchmark hits nothing; repeated
rows are judged row by row; items with equal texts are all named; null item ids are left out of the list of items.
Very long texts are handled whole. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issuequarry.llm.common import batches, fresh_names, hash_runs, hash_spans, lower_ascii, row_keys, signed, spans_of, text_bytes
from issuequarry.session import checkpointed

WINDOW = 13
GRAM = 5
#: Words kept on each side of a gram: enough to reach any window that holds it.
REACH = WINDOW - GRAM
FILTER_BITS = 22
_CONTEXT = 2 * REACH + GRAM

#: Bytes of a word after lower-casing: 0-9, a-z and all that is not ASCII.
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts and how many words each text has."""
    data, starts = text_bytes(column)
    data = lower_ascii(data)
    begin, end = spans_of(_WORD[data])
    return hash_spans(data, begin, end), np.diff(np.searchsorted(begin, starts))


def _winnowed(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kept grams of texts of ``WINDOW`` words and more: hash, place in ``words``, number of the text.

    One pass over all texts together: windows that would cross into the next text are dropped before the minimum
    is taken, which leaves exactly the windows of each text.
    """
    width = WINDOW - GRAM + 1
    grams = hash_runs(words, GRAM)
    count = len(grams) - width + 1
    if count <= 0:
        return grams[:0], np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    text = np.repeat(np.arange(len(counts)), counts)
    best, step_of = grams[:count].copy(), np.zeros(count, dtype=np.int64)
    for step in range(1, width):
        other = grams[step : step + count]
        better = other <= best
        np.copyto(best, other, where=better)
        step_of[better] = step
    whole = text[:count] == text[WINDOW - 1 : WINDOW - 1 + count]
    at = (np.arange(count) + step_of)[whole]
    at = at[np.concatenate(([True], np.diff(at) != 0))] if len(at) else at
    return grams[at], at, text[at]


def _contexts(words: np.ndarray, counts: np.ndarray, at: np.ndarray, text: np.ndarray) -> pa.Array:
    """The words around each gram, 0 outside its text, as fixed-size binary rows."""
    ends = np.cumsum(counts)
    places = at[:, None] + np.arange(-REACH, GRAM + REACH)[None, :]
    inside = (places >= (ends - counts)[text][:, None]) & (places < ends[text][:, None])
    near = np.where(inside, words[np.clip(places, 0, max(0, len(words) - 1))], np.uint64(0)) if len(at) else np.zeros((0, _CONTEXT), np.uint64)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(_CONTEXT * 8), len(at), [None, pa.py_buffer(np.ascontiguousarray(near).tobytes())]).cast(pa.binary())


_MARKS = "array<struct<gram:bigint,place:int,near:binary>>"


def _marks(values: dict[str, pa.Array], per_text: np.ndarray) -> pa.ListArray:
    offsets = np.zeros(len(per_text) + 1, dtype=np.int32)
    np.cumsum(per_text, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(list(values.values()), list(values)))


def _scan(width_of_short: list[int], keep: np.ndarray | None):
    """Arrow function: key columns pass through; n_words, kept grams and whole short windows are added.

    ``width_of_short``: lengths of the short items. ``keep``: the filter; None for the items themselves.
    """
    def scan(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for batch in batches(stream):
            words, counts = words_of(batch.column("text"))
            first = np.cumsum(counts) - counts
            gram, at, text = _winnowed(words, counts)
            if keep is not None and len(gram):
                passed = keep[(gram >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]
                gram, at, text = gram[passed], at[passed], text[passed]
            whole: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
            if keep is None:
                for n in np.unique(counts[(counts > 0) & (counts < WINDOW)]):
                    of = np.flatnonzero(counts == n)
                    whole.append((hash_runs(words, int(n))[first[of]], np.zeros(len(of), np.int64), of, np.full(len(of), n)))
            else:
                owner = np.repeat(np.arange(len(counts)), counts)
                for n in width_of_short:
                    runs = hash_runs(words, n)
                    ok = np.flatnonzero(keep[(runs >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
                    ok = ok[owner[ok] == owner[ok + n - 1]] if len(ok) else ok
                    whole.append((runs[ok], ok - first[owner[ok]], owner[ok], np.full(len(ok), n)))
            s_hash, s_at, s_text, s_len = (np.concatenate(x) if whole else np.zeros(0, np.uint64 if k == 0 else np.int64) for k, x in enumerate(zip(*whole) if whole else [()] * 4))
            order = np.argsort(s_text, kind="stable")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row_keys(len(counts), state)), batch.column("id"), pa.array(counts.astype(np.int64)),
                    _marks({
                        "gram": pa.array(signed(gram)), "place": pa.array((at - first[text]).astype(np.int32)),
                        "near": _contexts(words, counts, at, text),
                    }, np.bincount(text, minlength=len(counts))),
                    _marks({
                        "hash": pa.array(signed(s_hash.astype(np.uint64))[order]), "place": pa.array(s_at[order].astype(np.int32)),
                        "length": pa.array(s_len[order].astype(np.int32)),
                    }, np.bincount(s_text.astype(np.int64), minlength=len(counts))),
                ],
                names=["row", "id", "n_words", "marks", "shorts"],
            )

    return scan


def _scanned(texts: DataFrame, id_column: str, short: list[int], keep: np.ndarray | None, name: str) -> DataFrame:
    kind = texts.schema[id_column].dataType.simpleString()
    given = texts.select(F.col(id_column).alias("id"), "text")
    schema = f"row bigint, id {kind}, n_words bigint, marks {_MARKS}, shorts array<struct<hash:bigint,place:int,length:int>>"
    return checkpointed(given.mapInArrow(_scan(short, keep), schema), name)


def _extend(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Meetings of two equal grams, grown word by word; those of ``WINDOW`` words and more stay."""
    for batch in stream:
        n = batch.num_rows
        if not n:
            continue
        mine, theirs = (
            np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint64).reshape(n, _CONTEXT) for c in ("near", "near_item")
        )
        same = (mine == theirs) & (mine != 0)
        left = np.cumprod(same[:, REACH - 1 :: -1][:, :REACH], axis=1).sum(axis=1)
        right = np.cumprod(same[:, REACH + GRAM :], axis=1).sum(axis=1)
        hit = same[:, REACH : REACH + GRAM].all(axis=1) & (left + GRAM + right >= WINDOW)
        place = batch.column("place").to_numpy(zero_copy_only=False).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("row").filter(pa.array(hit)), batch.column("item").filter(pa.array(hit)),
                pa.array((place - left)[hit]), pa.array((place + GRAM + right)[hit]),
            ],
            names=["row", "item", "lo", "hi"],
        )


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, hit word spans, item ids, counts and the verdict."""
    items = _scanned(benchmark, "item_id", [], None, "decontaminate-items")
    slot = lambda c: F.shiftrightunsigned(c, 64 - FILTER_BITS)
    # At most 2**FILTER_BITS slots and WINDOW - 1 lengths reach the driver, however large the benchmark is.
    slots = items.select(F.explode(F.concat(F.transform("marks", lambda m: m["gram"]), F.transform("shorts", lambda s: s["hash"]))).alias("h"))
    used = slots.select(slot(F.col("h")).cast("int").alias("s")).distinct().toArrow().column("s").to_numpy()
    keep = np.zeros(1 << FILTER_BITS, dtype=bool)
    keep[used] = True
    short = items.select(F.explode("shorts.length").alias("n")).distinct().orderBy("n").toArrow().column("n").to_pylist()

    rows = _scanned(docs.select("doc_id", "text"), "doc_id", short, keep, "decontaminate-documents")
    item_grams = items.select(F.col("id").cast("string").alias("item"), F.explode("marks").alias("m")).select(
        "item", F.col("m.gram").alias("gram"), F.col("m.near").alias("near_item"),
    )
    # Several places of an item may look alike; each content is needed once.
    item_grams = checkpointed(item_grams.distinct(), "decontaminate-grams")
    item_wholes = items.select(F.col("id").cast("string").alias("item"), F.explode("shorts").alias("s")).select("item", "s.hash")
    item_wholes = checkpointed(item_wholes.distinct(), "decontaminate-wholes")
    grams = rows.select("row", F.explode("marks").alias("m")).select("row", "m.gram", "m.place", "m.near")
    wholes = rows.select("row", F.explode("shorts").alias("s")).select("row", "s.hash", "s.place", "s.length")
    met = grams.join(item_grams, "gram").select("row", "item", "place", "near", "near_item")
    hits = met.mapInArrow(_extend, "row bigint, item string, lo bigint, hi bigint").unionByName(
        wholes.join(item_wholes, "hash").select("row", "item", F.col("place").cast("bigint").alias("lo"), (F.col("place") + F.col("length")).cast("bigint").alias("hi")),
    )
    per_row = hits.groupBy("row").agg(
        F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("spans"), F.sort_array(F.collect_set("item")).alias("items"),
    )
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end"))
    n_hit = F.aggregate("spans", start, lambda seen, s: F.struct(
        (seen["n"] + F.greatest(F.lit(0).cast("bigint"), s["hi"] - F.greatest(s["lo"], seen["end"]))).alias("n"),
        F.greatest(seen["end"], s["hi"]).alias("end"),
    ), lambda seen: seen["n"])
    judged = rows.select("row", F.col("id").alias("doc_id"), "n_words").join(per_row, "row", "left")
    hit = F.coalesce(n_hit, F.lit(0).cast("bigint"))
    return judged.select(
        "row", "doc_id", "n_words", hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), "spans",
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def digest(judged: DataFrame) -> DataFrame:
    return judged.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without those that are contaminated. Rows with one id share a verdict; null ids are judged by text."""
    own, bad_key = fresh_names(docs, 2)
    # 128 bits of the id, or of the text where there is none.
    key = F.md5(F.coalesce(F.concat(F.lit("id"), F.col("doc_id").cast("string")), F.concat(F.lit("text"), F.coalesce("text", F.lit("")))))
    bad = contamination(docs.select(key.alias("doc_id"), "text"), benchmark).filter("contaminated").select(F.col("doc_id").alias(bad_key)).distinct()
    return docs.withColumn(own, key).join(bad, F.col(own) == F.col(bad_key), "left_anti").select(*docs.columns)


#: DuckDB twin: every window of every item against every window of every document, by its words.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
l AS (SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT item_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM l)),
ns AS (SELECT DISTINCT n FROM l),
dw AS (SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
       FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, ns WHERE len(w) >= n)),
m AS (SELECT dw.r, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM (SELECT DISTINCT r, item_id FROM m WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
