"""Near-duplicates among many texts that share a passage, and among many copies with small edits."""

import random

import pytest
from pyspark.sql import functions as F

from issuequarry.llm import near_dedup
from issuequarry.llm.common import Scratch


def _passage(own):
    draw = random.Random(7)
    words = [f"w{k}" for k in range(60)]
    return [" ".join(words + [f"o{draw.randrange(10**9)}" for _ in range(own)]) for _ in range(30)]


def _copies():
    draw = random.Random(8)
    base = [f"b{k}" for k in range(140)]
    found = []
    for k in range(40):
        words = list(base)
        for at in draw.sample(range(140), k % 9):
            words[at] = f"e{draw.randrange(10**9)}"
        found.append(" ".join(words))
    return found


def _shingles(text):
    w = text.split()
    return {tuple(w[k : k + 4]) for k in range(len(w) - 3)}


def _components(texts):
    sets, top = [_shingles(t) for t in texts], list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((top[a], top[b]))
                top = [low if t == high else t for t in top]
    return top


@pytest.mark.parametrize("meetings", [0, 64])
def test_crowded_lists_lose_no_link(spark, monkeypatch, meetings):
    monkeypatch.setattr(near_dedup, "CROWDED", 4)
    monkeypatch.setattr(near_dedup, "LISTS_SEEN", 3)
    monkeypatch.setattr(near_dedup, "MEETINGS", meetings)
    texts = [*_passage(45), *_copies()]
    found = near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    want = _components(texts)
    assert {r.doc_id: r.component_id for r in found} == dict(enumerate(want)) and len(set(want)) < len(want)


def test_texts_that_share_only_a_passage_are_in_no_crowded_list(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "CROWDED", 4)
    sets = [s for batch in [_passage(45)] for s in near_dedup.shingle_sets(near_dedup.pa.array(batch), 4)]
    classes = spark.createDataFrame([(k, len(s), s[: near_dedup.KEPT].tolist(), s.tobytes()) for k, s in enumerate(sets)], "cid bigint, n bigint, sketch array<bigint>, shingles binary")
    scratch, overlap = Scratch(spark), F.ceil(F.col("n") * 80 / 100)
    lists = near_dedup._listed(classes.select("cid", "n", F.explode("sketch").alias("value")), F.least(F.lit(near_dedup.SHARED), overlap), scratch)
    assert lists.groupBy("value").count().agg(F.max("count")).first()[0] > 20
    fewer = near_dedup._uncrowded(lists, classes.select("cid", "shingles"), overlap, scratch).groupBy("value").count()
    assert fewer.filter(F.col("count") > near_dedup.CROWDED).count() == 0


def test_stars_need_one_table_of_minima(spark, monkeypatch):
    made = []
    counted = Scratch.counted
    monkeypatch.setattr(Scratch, "counted", lambda self, df, name, **facts: made.append(name) or counted(self, df, name, **facts))
    edges = spark.createDataFrame([(1, 5), (6, 1), (2, 7)], "a bigint, b bigint")
    assert sorted(map(tuple, near_dedup.connected(edges).collect())) == [(1, 1), (2, 2), (5, 1), (6, 1), (7, 2)]
    assert made == ["edges", "edges-least", "edges-labels"]
    assert near_dedup.connected(edges.limit(0)).count() == 0
