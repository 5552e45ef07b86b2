"""Full-text index, match and cover-density rank for a table of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from issuequarry.functions.text import ENGLISH_STOP_WORDS, stem_tokens, tokens, word_stems
from issuequarry.session import checkpointed


def document_text(title: Column, body: Column) -> Column:
    empty = F.lit("")
    return F.concat(F.coalesce(title, empty), F.lit(" "), F.coalesce(body, empty))


def positioned_terms(df: DataFrame, key: str, content: Column, stemmed: bool = True) -> DataFrame:
    """(key, term, pos) rows: stop words removed but counted, positions from one."""
    # The arrays are built inside the explode: exploding a column would add a
    # pushed-down size filter that cuts every text a second time.
    if stemmed:
        words = df.select(key, tokens(content).alias("words"))
        paired = words.select(key, "words", stem_tokens("words").alias("stems"))
        # A stop word is recognised before stemming.
        rows = paired.select(key, F.posexplode(F.arrays_zip("words", "stems")).alias("p", "t")).select(
            key, "p", F.col("t.words").alias("word"), F.col("t.stems").alias("term")
        )
    else:
        rows = df.select(key, F.posexplode(tokens(content)).alias("p", "word")).withColumn("term", F.col("word"))
    kept = rows.filter(~F.col("word").isin(*ENGLISH_STOP_WORDS))
    return kept.select(key, "term", (F.col("p") + 1).cast("bigint").alias("pos"))


#: Words that are grouped at once; one longer document counts as one.
GROUPED_WORDS = 1 << 18


def _rows_by_id(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Pieces of a stream that is sorted by its first column, with a group number per row; no id is in two pieces."""

    def pieces(held: list[pa.Table]) -> Iterator[tuple[pa.Table, np.ndarray]]:
        rows = pa.concat_tables(held).combine_chunks()
        group = np.cumsum(np.append([False], _changes(rows.column(0))))
        sizes = pc.fill_null(pc.list_value_length(rows.column(1)), 0).to_numpy()
        ends = np.cumsum(np.bincount(group, weights=sizes))
        last_row = np.cumsum(np.bincount(group))
        start = 0
        while start < len(ends):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + GROUPED_WORDS, side="right")))
            a, b = last_row[start - 1] if start else 0, last_row[stop - 1]
            yield rows.slice(a, b - a), group[a:b] - start
            start = stop

    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        changed = np.flatnonzero(_changes(rows.column(0)))
        if len(changed):
            cut = int(changed[-1]) + 1
            yield from pieces([*held, rows.slice(0, cut)])
            held = [rows.slice(cut)]
        elif held and held[0].column(0)[0].as_py() != rows.column(0)[0].as_py():
            yield from pieces(held)
            held = [rows]
        else:
            held.append(rows)
    if held:
        yield from pieces(held)


def _changes(ids: pa.ChunkedArray) -> np.ndarray:
    """Whether each value but the first differs from the one before it; nulls are alike."""
    codes = ids.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    return codes[1:] != codes[:-1]


def _grouped_words(rows: pa.Table, group: np.ndarray, stemmed: bool, stems: Callable[[str], str]) -> pa.RecordBatch:
    """Postings of one piece: the words of each group by term, stop words removed but counted."""
    words = rows.column(1).combine_chunks()
    flat, row = pc.list_flatten(words), pc.list_parent_indices(words).to_numpy()
    pos = np.arange(len(row)) - np.searchsorted(row, row, side="left") + 1
    coded = flat.dictionary_encode()
    held, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    # A stop word is recognised before stemming.
    stop = pc.is_in(held, value_set=pa.array(ENGLISH_STOP_WORDS, held.type)).to_numpy(zero_copy_only=False)
    if stemmed:
        found = pa.array(["" if s else stems(w) for w, s in zip(held.to_pylist(), stop)], held.type).dictionary_encode()
        kept = ~stop[code]
        held, code = found.dictionary, found.indices.to_numpy().astype(np.int64)[code]
    else:
        kept = ~stop[code]
    code, pos, at = code[kept], pos[kept], group[row[kept]]
    key = at * max(1, len(held)) + code
    order = np.lexsort((pos, key))
    key = key[order]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, dtype=np.int64)
    first = order[starts]
    first_row = np.searchsorted(group, at[first], side="left")
    positions = pa.ListArray.from_arrays(
        pa.array(np.append(starts, len(key)).astype(np.int32)), pa.array(pos[order], type=pa.int64()))
    term = held.take(pa.array(code[first]))
    ids = rows.column(0).combine_chunks().take(pa.array(first_row))
    return pa.RecordBatch.from_arrays([term, ids, positions], names=["term", "issue_id", "positions"])


def text_index(issues: DataFrame, stemmed: bool = True) -> DataFrame:
    """Postings (term, issue_id, positions) of title and body.

    Documents are dealt out by id and sorted by it before they are cut into words, so the words of an id, in one row or
    several, are grouped where they stand: neither a word nor a posting is shuffled, sorted by Spark or spilled.
    """
    kind = issues.schema["id"].dataType.simpleString()
    documents = issues.select(F.col("id").alias("issue_id"), document_text(F.col("title"), F.col("body")).alias("content"))
    dealt = documents.repartition("issue_id").sortWithinPartitions("issue_id")

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stems = word_stems()
        for rows, numbers in _rows_by_id(batches):
            yield _grouped_words(rows, numbers, stemmed, stems)

    words = dealt.select("issue_id", tokens(F.col("content")).alias("words"))
    return words.mapInArrow(group, f"term string, issue_id {kind}, positions array<long>")


def query_terms(queries: DataFrame, stemmed: bool = True, text: str = "text") -> DataFrame:
    """Distinct terms of every query with their number; queries of stop words only vanish."""
    rows = positioned_terms(queries.select("query_id", text), "query_id", F.col(text), stemmed)
    terms = rows.groupBy("query_id", "term").agg(F.min("pos").alias("first_pos"))
    # The count stays beside the rows; a query has as many rows as it has words.
    counts = terms.groupBy("query_id").agg(F.count("*").alias("n_terms"))
    return terms.join(counts, "query_id").select("query_id", "term", "n_terms")


def relevant_postings(issues: DataFrame, terms: DataFrame, stemmed: bool = True) -> DataFrame:
    """Postings of the asked terms only, straight from the texts.

    Words no query asks for are dropped before the first shuffle when the term
    list is small enough for Spark to broadcast.
    """
    rows = positioned_terms(
        issues.select(F.col("id").alias("issue_id"), "title", "body"), "issue_id",
        document_text(F.col("title"), F.col("body")), stemmed,
    )
    asked = terms.select("term").distinct()
    return rows.join(asked, "term", "left_semi").groupBy("issue_id", "term").agg(
        F.array_sort(F.collect_list("pos")).alias("positions")
    )


#: Ids that differ only in their last bits make a block; a ranked search looks at the most promising blocks first.
BLOCK_BITS = 8
FIRST_BLOCKS = 8


#: Terms of a query that an issue has to hold before its other terms are looked up.
RAREST = 3


def block_of(issue_id: Column) -> Column:
    return F.shiftright(issue_id, BLOCK_BITS)


def text_match(
    postings: DataFrame, terms: DataFrame, frequency: DataFrame | None = None, inside: DataFrame | None = None, few: bool = True,
) -> DataFrame:
    """(query_id, issue_id, positions per term) where the issue holds every term of the query.

    Candidates hold each query's ``RAREST`` rarest terms, so a term found in a
    third of all issues never drives the join; the other terms then only check
    those candidates. ``few`` candidates are written first, so that Spark knows when they can be brought to the postings instead
    of shuffling these. ``frequency`` (term, df) saves counting them; ``inside`` (query_id, block) leaves the other
    blocks of ids out.
    """
    if frequency is None:
        frequency = postings.groupBy("term").agg(F.count("*").alias("df"))
    weighted = terms.join(frequency, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    order = Window.partitionBy("query_id").orderBy("df", "term")
    ranked = weighted.withColumn("_at", F.row_number().over(order)).filter(F.col("_at") <= RAREST)
    rarest = checkpointed(ranked.select("query_id", "n_terms", "term"), "rarest")
    held = rarest.join(postings.select("term", "issue_id"), "term")
    if inside is not None:
        placed = held.withColumn("block", block_of(F.col("issue_id")))
        held = placed.join(inside.select("query_id", "block"), ["query_id", "block"], "left_semi")
    candidates = held.groupBy("query_id", "n_terms", "issue_id").agg(F.count("*").alias("_n")).filter(
        F.col("_n") == F.least(F.col("n_terms"), F.lit(RAREST)))
    wanted = candidates.drop("_n").join(terms.select("query_id", "term"), "query_id")
    if few:
        wanted = checkpointed(wanted, "wanted")
    found = wanted.join(postings, ["issue_id", "term"])
    return (
        found.groupBy("query_id", "issue_id", "n_terms")
        .agg(F.collect_list(F.struct("term", "positions")).alias("hits"))
        .filter(F.size("hits") == F.col("n_terms"))
    )


def cover_density(hits: Column) -> Column:
    """Cover-density rank with equal weights of 0.1 and no length normalisation.

    ``hits`` holds (term, positions) for every query term. A cover is a
    shortest stretch with all terms in it: walking the occurrences in order,
    it starts at the oldest of the latest places of all terms, and each start
    counts once, at its first end. With ``gap`` foreign words inside, a cover
    adds 0.1 / (1 + gap). Positions are not cut off in long documents.
    """
    n_terms = F.size(hits)
    places = F.array_sort(F.flatten(F.transform(
        hits, lambda h, t: F.transform(h["positions"], lambda p: F.struct(p.alias("pos"), t.alias("term")))
    )))
    numbered = F.transform(places, lambda x, i: F.struct(x["pos"].alias("pos"), x["term"].alias("term"), i.alias("at")))
    nowhere = F.struct(F.lit(-1).alias("at"), F.lit(-1).cast("bigint").alias("pos"))
    start = F.struct(
        F.array_repeat(nowhere, n_terms).alias("latest"), F.lit(-1).alias("begun"), F.lit(0.0).alias("rank")
    )

    def walk(acc: Column, x: Column) -> Column:
        latest = F.transform(
            acc["latest"],
            lambda old, t: F.when(t == x["term"], F.struct(x["at"].alias("at"), x["pos"].alias("pos"))).otherwise(old),
        )
        begin = F.array_min(latest)
        fresh = begin["at"] > acc["begun"]
        gap = (x["pos"] - begin["pos"]) - (x["at"] - begin["at"])
        return F.struct(
            latest.alias("latest"),
            F.when(fresh, begin["at"]).otherwise(acc["begun"]).alias("begun"),
            (acc["rank"] + F.when(fresh, F.lit(0.1) / (F.lit(1.0) + gap)).otherwise(F.lit(0.0))).alias("rank"),
        )

    return F.aggregate(numbered, start, walk, lambda acc: acc["rank"])


def text_rank(matches: DataFrame) -> DataFrame:
    return matches.select("query_id", "issue_id", F.round(cover_density(F.col("hits")), 12).alias("text_score"))


def top_by_score(scored: DataFrame, score: str, k: Column | int) -> DataFrame:
    """Best ``k`` rows per query, equal scores by id; ``k`` may be a column of the rows."""
    w = Window.partitionBy("query_id").orderBy(F.desc(score), "issue_id")
    ranked = scored.withColumn("rank", F.row_number().over(w).cast("bigint"))
    return ranked.filter(F.col("rank") <= k)


def _matched(issues: DataFrame, queries: DataFrame, stemmed: bool, index) -> DataFrame:
    """Matches read off a stored index, or off the texts.

    The match reads terms and postings several times, so what comes from texts is written once instead of
    cutting every text anew; stored postings are read through the folders of the asked terms.
    """
    terms = checkpointed(query_terms(queries, stemmed if index is None else index.stemmed), "terms")
    if index is not None:
        postings, frequency = index.lookup(terms)
        return text_match(postings, terms, frequency)
    return text_match(checkpointed(relevant_postings(issues, terms, stemmed), "postings"), terms)


def block_reach(counts: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, block, reach): no issue of the block ranks above ``reach``; blocks that lack a term are left out.

    Covers begin at different places and hold a place of each term, so there are at most as many as places without
    the last ``n_terms - 1``; between two terms a place ends and begins one cover each. No cover adds more than 0.1.
    """
    held = terms.join(counts.select("term", "block", "peak"), "term").groupBy("query_id", "n_terms", "block").agg(
        F.count("*").alias("n"), F.sum("peak").alias("places"), F.min("peak").alias("fewest")
    ).filter(F.col("n") == F.col("n_terms"))
    starts = F.col("places") - F.col("n_terms") + 1
    starts = F.when(F.col("n_terms") == 2, F.least(starts, F.col("fewest") * 2)).otherwise(starts)
    return held.select("query_id", "block", (starts * 0.1).alias("reach"))


def blocks_left(reach: DataFrame, looked: DataFrame, near: DataFrame, k: int) -> DataFrame:
    """Blocks that may still hold one of the ``k`` best: those not looked at whose reach is no lower than the k-th score."""
    bar = near.filter(F.col("rank") == k).select("query_id", F.col("text_score").alias("bar"))
    rest = reach.join(looked.select("query_id", "block"), ["query_id", "block"], "left_anti").join(bar, "query_id", "left")
    return rest.filter(F.col("bar").isNull() | (F.col("reach") >= F.col("bar") - 1e-9)).select("query_id", "block")


def _best_of_index(index, terms: DataFrame, k: int) -> DataFrame:
    """The ``k`` best issues per query, reading the positions of promising blocks alone.

    The ``FIRST_BLOCKS`` blocks of the highest reach give a k-th score; a block below it is never matched nor ranked.
    """
    postings, counts = index.blocks(terms)
    frequency = counts.groupBy("term").agg(F.sum("df").alias("df"))
    reach = checkpointed(block_reach(counts, terms), "reach")
    order = Window.partitionBy("query_id").orderBy(F.desc("reach"), "block")
    looked = reach.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= FIRST_BLOCKS)
    first = text_rank(text_match(postings, terms, frequency, looked))
    near = checkpointed(top_by_score(first, "text_score", k), "near-texts")
    far = text_rank(text_match(postings, terms, frequency, blocks_left(reach, looked, near, k), few=False))
    return top_by_score(near.drop("rank").unionByName(far), "text_score", k)


def text_search(issues: DataFrame, queries: DataFrame, k: int = 10, stemmed: bool = True, index=None) -> DataFrame:
    """Match and rank: query_id, issue_id, text_score, rank. ``index`` is a ``PostingsIndex`` of the same issues.

    From an index, blocks of issues that cannot reach the k-th score are skipped; the rows are the same.
    """
    if index is not None:
        return _best_of_index(index, checkpointed(query_terms(queries, index.stemmed), "terms"), k)
    return top_by_score(text_rank(_matched(issues, queries, stemmed, index)), "text_score", k)


def matching_issue_ids(issues: DataFrame, text: str, stemmed: bool = True, index=None) -> DataFrame:
    """Ids of the issues one query text matches, for facet search."""
    query = issues.sparkSession.range(1).select(F.col("id").alias("query_id"), F.lit(text).alias("text"))
    return _matched(issues, query, stemmed, index).select(F.col("issue_id").alias("id"))
