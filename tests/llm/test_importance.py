"""Importance resampling against a word-by-word version, on odd rows and on the smallest tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from issuequarry.llm import importance

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, key bigint, rank int, part string"


def _words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def _buckets(text):
    w = _words(text)
    runs = [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]
    return [zlib.crc32(r.encode()) % 10000 for r in runs]


def _expected(rows, target):
    docs = [(doc_id, _buckets(text), len(_words(text))) for doc_id, text in rows]
    s = Counter(b for _, x, _ in docs for b in x)
    t = Counter(b for text in target for b in _buckets(text))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in range(10000)}
    out = []
    for doc_id, x, n in docs:
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in x)
        out.append([doc_id, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    for rank, row in enumerate(able[: 5 * len(able) // 100], 1):
        row[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=repr)


def _got(df):
    return sorted(map(tuple, df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def test_odd_rows(spark):
    texts = [None, "", " .,! ", "one", "One two", "a-b_c`d{e}f é É ß €uro", "x" * 500 + " " + "y" * 70 + " tail", "naïve Ünï\tcode\n" * 9]
    texts += [" ".join(f"W{(k * j) % 17}" for j in range(15 + k)) for k in range(60)] + ["long word " * 30_000]
    rows = [(k, t) for k, t in enumerate(texts)]
    rows += [rows[30], rows[30], (None, texts[40]), (None, None), (None, texts[41])]
    target = ["w1 w2 w3", None, "", "code naïve", "w1 w2 w3"]
    docs = spark.createDataFrame([(k, t, 7, 1, "x") for k, t in rows], SCHEMA).repartition(5)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    assert _got(importance.resample(docs, aim)) == _expected(rows, target)
    assert _got(importance.resample(docs, aim.limit(0))) == _expected(rows, [])
    assert importance.resample(docs.limit(0), aim).count() == 0


def test_whole_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    aim = spark.read.parquet(f"{SF}/benchmark.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = _expected(rows, [r.text for r in aim.select("text").collect()])
    assert _got(importance.resample(docs, aim)) == want
    assert any(r[4] for r in want)


@pytest.mark.parametrize("length", [0, 1, 5, 63, 64, 65, 300])
def test_a_crc_is_carried_on(length):
    heads, tails = [b"", b"a", "é".encode() * 40], [b" " * length, b"z" * length]
    crcs = np.array([zlib.crc32(h) for h in heads for _ in tails], dtype=np.uint32)
    which = np.tile(np.arange(len(tails)), len(heads))
    assert importance.carried(crcs, tails, which).tolist() == [zlib.crc32(h + t) for h in heads for t in tails]


def test_runs_stay_in_their_text():
    runs = importance.Runs(pa.array(["a b", None, "c", "a b c"]))
    assert runs.n_words.tolist() == [2, 0, 1, 3] and runs.n_features().tolist() == [3, 0, 1, 6]
    want = Counter(b for t in ("a b", "c", "a b c") for b in _buckets(t))
    assert {k: v for k, v in enumerate(runs.counts().tolist()) if v} == want


def test_slices_are_read_from_their_own_start():
    texts = ["a b", "c D e", "f", "G h i j", "k l"]
    for start in range(len(texts)):
        runs = importance.Runs(pa.array(texts).slice(start))
        assert runs.n_words.tolist() == [len(_words(t)) for t in texts[start:]]
        want = Counter(b for t in texts[start:] for b in _buckets(t))
        assert {k: v for k, v in enumerate(runs.counts().tolist()) if v} == want


def test_a_task_of_several_batches(spark):
    """More text than ``batches`` passes on at once, in one partition and without nulls."""
    rows = [(k, " ".join(f"W{(k * j) % 997}x" for j in range(20_000))) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    aim = spark.createDataFrame([("w1x w2x w3x",)], "text string")
    assert _got(importance.resample(docs, aim)) == _expected(rows, ["w1x w2x w3x"])
