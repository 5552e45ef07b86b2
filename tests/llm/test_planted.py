"""Planted passages for the 400-byte rule: what is shorter stays, what is long enough goes, at any place and in any script."""

import random

import pytest

from issuequarry.llm import suffix_dedup


def _filler(draw, n):
    return " ".join("".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randrange(3, 9))) for _ in range(n))


@pytest.mark.parametrize("script", ["plain", "accents"])
def test_passages_by_their_bytes(spark, script):
    draw = random.Random(4)
    sizes = (300, 399, 400, 401, 600)
    rows, passages = [], {}
    for k, size in enumerate(sizes):
        passage = _filler(draw, 200)
        if script == "accents":
            passage = passage.replace("a", "é")
        raw = passage.encode()[:size]
        # Whole characters only; the last bytes are made up of a sign found nowhere else.
        text = raw.decode(errors="ignore")
        text += "q" * (size - len(text.encode()))
        passages[size] = text
        for copy in range(3):
            rows.append((10 * k + copy, f"{_filler(draw, 20 + copy)} {copy}{text}{copy} {_filler(draw, 11 * copy + 3)}"))
    got = {r.doc_id: r for r in suffix_dedup.removals(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for k, size in enumerate(sizes):
        for copy in range(3):
            r = got[10 * k + copy]
            assert (r.n_removed, r.n_spans) == ((size, 1) if size >= 400 else (0, 0))
            assert r.n_bytes == len(dict(rows)[10 * k + copy].encode())
