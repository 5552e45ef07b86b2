import re
import tracemalloc
from difflib import SequenceMatcher

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from issuequarry.operators import protect as P


def _spans_by_trying_all(text):
    """Accept every match, kind by kind, that shares no character with an accepted one."""
    taken, out = set(), []
    for kind, pattern, flags in P.ENTITY_PATTERNS:
        for m in re.finditer(pattern, text, flags):
            cells = set(range(*m.span()))
            if cells and not cells & taken:
                taken |= cells
                out.append((*m.span(), kind))
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(
    ["`a b`", "https://e.io/x.", "./src/a.py", "org/repo", "ABC-12", "id: #1234", "#123", "12345", "2024-01-02T03:04:05Z", "v1.2.3",
     "ValueError", "```", "~~~", "\n\n", " ", "word", "Traceback (most recent call last):", "é", "/", "-", "1.5"]), max_size=25))
def test_spans_equal_trying_all(parts):
    text = "".join(parts)
    assert P.find_spans(text) == _spans_by_trying_all(text)


def test_hand_cases(spark):
    text = "Visit https://example.com/api for details on repo/test failing."
    assert [(text[a:b], k) for a, b, k in P.find_spans(text)] == [("https://example.com/api", "url"), ("/test", "path")]
    df = spark.createDataFrame([(1, text), (2, "plain"), (3, None), (4, "`x` then `x`")], "doc_id long, text string")
    masked = P.mask_corpus(df)
    rows = {r.doc_id: r for r in P.unmask_corpus(masked).collect()}
    assert rows[1].masked == "Visit \uf8ff0\uf8fe for details on repo\uf8ff1\uf8fe failing." and rows[1].restored == text
    assert rows[2].masked == "plain" and rows[2].spans == [] and rows[3].restored in (None, "")
    stats = {r.kind: (r.spans, r.distinct_values) for r in P.entity_stats(P.locked_entities(df)).collect()}
    assert stats["inline_code"] == (2, 1)


def test_placeholders_in_any_order(spark):
    df = spark.createDataFrame([(["A", "B"], "\uf8ff1\uf8fe-\uf8ff0\uf8fe-\uf8ff1\uf8fe-\uf8ff7\uf8fe")], "v array<string>, t string")
    from pyspark.sql import functions as F

    assert df.select(P.unmasked(F.col("t"), F.col("v")).alias("r")).first().r == "B-A-B-\uf8ff7\uf8fe"


def test_terms(spark):
    df = spark.createDataFrame([("keep Foo and Bar, Foo", ["Foo", "Bar", "absent"])], "text string, terms array<string>")
    row = P.restore_terms(P.protect_terms(df)).first()
    assert row.guarded == "keep \uf8fd0\uf8fc and \uf8fd1\uf8fc, \uf8fd0\uf8fc" and row.restored == row.text


def _reference_edits(a, b):
    ops = SequenceMatcher(a=a, b=b).get_opcodes()
    return sum(max(j - i, n - m) for tag, i, j, m, n in ops if tag != "equal")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcdef"), max_size=30), st.lists(st.sampled_from("abcdef"), max_size=30), st.integers(0, 15))
def test_early_rejection_never_changes_the_verdict(a, b, allowed):
    exact, fast = _reference_edits(a, b), P._edits(a, b, allowed)
    assert fast == exact if exact <= allowed else fast > allowed


@pytest.mark.parametrize("text,candidate,budget,ratio,result,edits", [
    ("Service fails intermittently", "Totally other words entirely here", 1, 0.25, "Service fails intermittently", 0),
    ("a b c d", "a b c x", 15, 0.25, "a b c x", 1), ("a b c d", "a b x y", 15, 0.25, "a b c d", 0),
    ("a b", "a c", 15, 0.25, "a c", 1), ("a b c d", "a b c x", 0, 0.25, "a b c d", 0), ("a b c d", "a b c x", 15, 0.0, "a b c d", 0),
    ("  ", "x", 15, 0.25, "  ", 0), ("a b!", "a b?", 0, 0.0, "a b?", 0), ("naïve café", "naïve thé", 15, 0.5, "naïve thé", 1),
])
def test_budget(spark, text, candidate, budget, ratio, result, edits):
    df = spark.createDataFrame([(text, candidate)], "text string, candidate string")
    row = P.edit_budget_gate(df, budget, ratio).first()
    assert (row.result, row.edited_tokens) == (result, edits)
    assert row.total_tokens == len(re.findall(r"\b\w+\b", text))


def test_spans_of_a_batch_are_never_all_in_python():
    """Every text is cut as ``find_spans`` says, and Python holds a few texts at once, whatever the size of the batch."""
    texts = ["see `run 1` at https://example.com/a or ./src/x.py and ABC-123 since v1.2.3 " * 10, None, "", "plain"] * 1000
    tracemalloc.start()
    try:
        cut = P._cut_at_spans.func(pa.array(texts))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 4 << 20 and len(cut) == len(texts)
    for text, row in zip(texts[:8], cut.slice(0, 8).to_pylist()):
        spans = P.find_spans(text or "")
        assert row["kinds"] == [kind for _, _, kind in spans]
        assert row["pieces"] is None if text is None else "".join(row["pieces"]) == text and row["pieces"][1::2] == [text[a:b] for a, b, _ in spans]
