"""Protected spans, masking and edit accounting over text tables."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from difflib import SequenceMatcher
from itertools import chain, pairwise

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from issuequarry.functions.text import strip, word_count

# Protected kinds and their patterns, in order of priority.
ENTITY_PATTERNS = (
    ("fence", r"```[\s\S]*?```|~~~[\s\S]*?~~~", 0),
    ("traceback", r"Traceback \(most recent call last\):[\s\S]+?(?=\n{2,}|\Z)", 0),
    ("inline_code", r"`[^`]+`", 0),
    ("url", r"https?://[^\s]+", re.IGNORECASE),
    ("path", r"(?:\.{1,2}/|/)[\w@~./-]+", 0),
    ("repo", r"\b[\w.-]+/[\w.-]+\b", 0),
    ("issue_key", r"\b[A-Z][A-Z0-9]+-\d+\b", 0),
    ("id", r"\b(?:id:?\s*#?\d{3,}|#\d{3,}|\d{5,})\b", re.IGNORECASE),
    ("timestamp", r"\b\d{4}-\d{2}-\d{2}(?:[ T]\d{2}:\d{2}:\d{2}(?:Z|[+-]\d{2}:\d{2})?)?\b", 0),
    ("version", r"\bv?\d+\.\d+(?:\.\d+)?(?:-[\w.]+)?\b", 0),
    ("error", r"\b[A-Z][A-Za-z0-9]+Error\b", 0),
)
# The private-use marks around a placeholder's number.
SPAN_MARKS = ("\uf8ff", "\uf8fe")
TERM_MARKS = ("\uf8fd", "\uf8fc")
EDIT_BUDGET = 15
EDIT_RATIO = 0.25

#: A text cut at all span bounds: pieces at odd places are spans, the others lie between them.
_CUT = T.StructType([
    T.StructField("kinds", T.ArrayType(T.StringType())), T.StructField("bounds", T.ArrayType(T.IntegerType())),
    T.StructField("pieces", T.ArrayType(T.StringType())),
])
_COMPILED = [(kind, re.compile(pattern, flags)) for kind, pattern, flags in ENTITY_PATTERNS]


def find_spans(text: str) -> list[tuple[int, int, str]]:
    """Accepted (start, end, kind), by start. A match touching an accepted span is left out whole."""
    starts: list[int] = []
    spans: list[tuple[int, int, str]] = []
    for kind, pattern in _COMPILED:
        for match in pattern.finditer(text):
            start, end = match.span()
            at = bisect_right(starts, start)
            free_before = at == 0 or spans[at - 1][1] <= start
            free_after = at == len(spans) or end <= starts[at]
            if start < end and free_before and free_after:
                starts.insert(at, start)
                spans.insert(at, (start, end, kind))
    return spans


#: Texts that are cut at once: what Python holds beside the Arrow batch does not grow with the batch.
CUT_TEXTS = 64
_CUT_ARROW = pa.struct([
    ("kinds", pa.list_(pa.string())), ("bounds", pa.list_(pa.int32())), ("pieces", pa.list_(pa.string())),
])


def _cut(text: str | None) -> dict:
    spans = find_spans(text) if text is not None else []
    bounds = [0, *chain.from_iterable(span[:2] for span in spans), len(text or "")]
    pieces = [text[a:b] for a, b in pairwise(bounds)] if text is not None else None
    return {"kinds": [kind for _, _, kind in spans], "bounds": bounds, "pieces": pieces}


@F.arrow_udf(_CUT)
def _cut_at_spans(texts: pa.Array) -> pa.Array:
    starts = range(0, len(texts), CUT_TEXTS)
    parts = [pa.array(map(_cut, texts.slice(k, CUT_TEXTS).to_pylist()), type=_CUT_ARROW) for k in starts]
    return pa.concat_arrays(parts) if parts else pa.array([], type=_CUT_ARROW)


def mask_corpus(texts: DataFrame, text: str = "text") -> DataFrame:
    """Add ``masked`` and ``spans`` to every row. Python cuts the text, Spark puts numbers in place of the spans."""
    cut = texts.withColumn("_cut", _cut_at_spans(F.col(text)))
    pieces, bounds = F.col("_cut.pieces"), F.col("_cut.bounds")
    number = lambda i: F.floor(i / 2).cast("string")
    masked = F.array_join(F.transform(pieces, lambda piece, i: F.when(
        i % 2 == 1, F.concat(F.lit(SPAN_MARKS[0]), number(i), F.lit(SPAN_MARKS[1]))).otherwise(piece)), "")
    spans = F.transform("_cut.kinds", lambda kind, i: F.struct(
        i.alias("idx"), kind.alias("kind"), F.get(pieces, 2 * i + 1).alias("value"),
        F.get(bounds, 2 * i + 1).alias("start"), F.get(bounds, 2 * i + 2).alias("end")))
    return cut.select(*texts.columns, masked.alias("masked"), spans.alias("spans"))


def locked_entities(texts: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per protected span.

    An inner explode would add a size filter that scans every text twice; the
    outer one with a filter on its own output does not.
    """
    masked = mask_corpus(texts.select(id_col, text), text)
    return masked.select(id_col, F.inline_outer("spans")).filter("idx is not null")


def entity_stats(entities: DataFrame) -> DataFrame:
    return entities.groupBy("kind").agg(
        F.count("*").alias("spans"), F.count_distinct("value").alias("distinct_values")
    )


def unmasked(col: Column, values: Column, marks: tuple[str, str] = SPAN_MARKS) -> Column:
    """Put values back for their placeholders, in one pass whatever order they come in."""
    pattern = f"{marks[0]}(\\d+){marks[1]}"
    between = F.split(col, pattern, -1)
    numbers = F.regexp_extract_all(col, F.lit(pattern), F.lit(1))

    def restore(gap: Column, number: Column) -> Column:
        value = F.get(values, number.try_cast("int"))
        mark = F.concat(F.lit(marks[0]), number, F.lit(marks[1]))
        return F.concat(gap, F.coalesce(value, mark, F.lit("")))

    return F.array_join(F.zip_with(between, numbers, restore), "")


def unmask_corpus(masked: DataFrame, text: str = "masked") -> DataFrame:
    """Add ``restored``; spans carry the values."""
    values = F.transform("spans", lambda s: s["value"])
    return masked.withColumn("restored", unmasked(F.col(text), values))


def protect_terms(texts: DataFrame, terms: str = "terms", text: str = "text") -> DataFrame:
    """Add ``guarded``: each listed string replaced by its placeholder, in list order."""
    numbered = F.transform(terms, lambda t, i: F.struct(t.alias("term"), i.cast("string").alias("at")))
    guarded = F.aggregate(
        numbered, F.col(text),
        lambda acc, x: F.replace(acc, x["term"], F.concat(F.lit(TERM_MARKS[0]), x["at"], F.lit(TERM_MARKS[1]))),
    )
    return texts.withColumn("guarded", guarded)


def restore_terms(guarded: DataFrame, terms: str = "terms", text: str = "guarded") -> DataFrame:
    return guarded.withColumn("restored", unmasked(F.col(text), F.col(terms), TERM_MARKS))


def token_counts(texts: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    return texts.select(id_col, word_count(F.col(text)).alias("tokens"))


def allowed_edits(tokens: Column, budget: int, ratio: float) -> Column:
    """Edits a text of that many words may take."""
    if budget <= 0 or ratio <= 0:
        return F.lit(0)
    by_ratio = F.greatest(F.floor(tokens * F.lit(ratio)).cast("int"), F.lit(1))
    return F.when(tokens == 0, 0).otherwise(F.least(F.lit(budget), by_ratio))


_WORD = re.compile(r"\b\w+\b")


def _edits(source: list[str], target: list[str], allowed: int) -> int:
    """Token edits, or any number above ``allowed`` once that is certain.

    Words kept cannot outnumber the words both sides share, which settles most
    rewrites without aligning them.
    """
    shared = (Counter(source) & Counter(target)).total()
    at_least = max(len(source), len(target)) - shared
    if at_least > allowed:
        return at_least
    # Common words count in long texts as they do in short ones.
    blocks = SequenceMatcher(a=source, b=target, autojunk=False).get_opcodes()
    return sum(max(i2 - i1, j2 - j1) for tag, i1, i2, j1, j2 in blocks if tag != "equal")


@F.pandas_udf(T.IntegerType())
def _token_edits(source: pd.Series, target: pd.Series, allowed: pd.Series) -> pd.Series:
    return pd.Series([
        _edits(_WORD.findall(s or ""), _WORD.findall(t or ""), int(a)) for s, t, a in zip(source, target, allowed)
    ])


def edit_budget_gate(
    pairs: DataFrame, budget: int = EDIT_BUDGET, ratio: float = EDIT_RATIO,
    source: str = "text", candidate: str = "candidate",
) -> DataFrame:
    """Add result, edited_tokens, total_tokens: the candidate when it stays in budget, else the source."""
    src, cand = F.col(source), F.col(candidate)
    sized = pairs.withColumn("total_tokens", word_count(src))
    limited = sized.withColumn("_allowed", allowed_edits(F.col("total_tokens"), budget, ratio))
    counted = limited.withColumn("_edits", _token_edits(src, cand, F.col("_allowed")))
    accept = (strip(src) != "") & (F.col("_edits") <= F.col("_allowed"))
    return counted.withColumns({
        "result": F.when(accept, cand).otherwise(src),
        "edited_tokens": F.when(accept, F.col("_edits")).otherwise(0).cast("bigint"),
    }).drop("_allowed", "_edits")
