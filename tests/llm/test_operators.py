"""Every operator on odd rows: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from math import comb

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from issuequarry.llm import (
    bilstm_crf, chat_format, decontaminate, near_dedup, packing, pii, quality_crf, quality_rules, sentence_spans, sharding,
    suffix_arrays, suffix_dedup, tokens,
)

SCHEMA = "doc_id bigint, text string, n bigint, value string, row int, comp int"


def _texts():
    draw = random.Random(5)
    words = ["alpha", "Beta", "gamma,", "delta.", "épsilon", "zeta!", "eta", "theta", "iota", "kappa.", "Lambda", "mu"]
    long = " ".join(draw.choice(words) + str(draw.randrange(40)) for _ in range(3000))
    base = [" ".join(draw.choice(words) + str(draw.randrange(9)) for _ in range(120)) for _ in range(6)]
    near = [b.replace("alpha1", "omega", 1).replace("mu3", "nu", 1) + " end" for b in base]
    shared = " ".join(draw.choice(words) + str(draw.randrange(9)) for _ in range(90))
    mixed = [f"{b[:200]}\n{shared}\n{b[200:420]}" for b in base[:3]]
    return [None, "", " \n\t ", "one", "two words", *base, *near, *mixed, long, long[:9000], base[0], base[0], "x" * 900, "a@b.co 1.2.3.4"]


def _rows():
    rows = [(k, t, 1, "v", 2, 3) for k, t in enumerate(_texts())]
    return [*rows, rows[5], (None, rows[6][1], 1, None, None, None), (None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _words(text):
    return re.findall("[^\x20\x09-\x0D]+", text or "")


def test_near_dedup_is_brute_force(docs, none):
    got = near_dedup.near_duplicates(docs).collect()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for doc_id, text, *_ in _rows():
        if doc_id is not None:
            w = _words((text or "").translate(lower))
            sets[doc_id] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set()
    comp = {k: k for k in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    known = [r for r in got if r.doc_id is not None]
    assert len(got) == len(_rows())
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in known} == {(k, len(s), comp[k], comp[k] == k) for k, s in sets.items()}
    assert {(r.component_id, r.kept) for r in got if r.doc_id is None} == {(comp[6], False), (None, True)}
    assert near_dedup.near_duplicates(none).count() == 0
    kept = near_dedup.kept(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {None} | {k for k in comp if comp[k] == k}


def test_one_row_of_each_component_is_kept(spark):
    a, b, c, d = (" ".join(f"{w}{k}" for k in range(60)) for w in "abcd")
    rows = [(1, a), (1, a), (None, a), (4, a + " end"), (None, b), (None, b), (None, b + " end"), (2, ""), (None, None), (3, c), (3, d)]
    kept = near_dedup.kept(spark.createDataFrame(rows, "doc_id int, text string").repartition(3)).collect()
    first_of_b = {b, b + " end"} & {r.text for r in kept}
    assert len(first_of_b) == 1
    want = Counter([(1, a), (None, first_of_b.pop()), (2, ""), (None, None), (3, c), (3, d)])
    assert Counter(map(tuple, kept)) == want


def test_parity_never_exceeds_the_unshared(spark):
    draw = np.random.default_rng(3)
    for size in (5, 200, 3000):
        x = np.unique(draw.integers(-(2**62), 2**62, size))
        y = np.unique(np.concatenate((x[: size * 3 // 4], draw.integers(-(2**62), 2**62, size // 3))))
        unshared = len(np.setxor1d(x, y))
        bits = np.unpackbits((near_dedup.odd_bits(x) ^ near_dedup.odd_bits(y)).view(np.uint8)).sum()
        assert bits <= unshared


def test_links_with_few_shared_values_reach_the_exact_check(spark):
    kept = near_dedup.KEPT
    assert sum(comb(kept, k) * 0.8**k * 0.2 ** (kept - k) for k in range(near_dedup.SHARED)) < 1e-9
    # Of the union's 32 smallest values, 10 (9) are in both sketches.
    rows = [(hits, list(range(hits)) + list(range(100, 200, 2))[: kept - hits], list(range(hits)) + list(range(101, 200, 2))[: kept - hits]) for hits in (9, 10)]
    pairs = spark.createDataFrame(rows, "hits int, a array<bigint>, b array<bigint>")
    fit = near_dedup._plausible(F.col("a"), F.col("b"), F.lit(1000), F.lit(1000), near_dedup.PERCENT)
    assert {r.hits: r.fit for r in pairs.select("hits", fit.alias("fit")).collect()} == {9: False, 10: True}


def test_connected_finds_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7)], "a bigint, b bigint")
    assert {(r.node, r.comp) for r in near_dedup.connected(edges).collect()} == {(k, 0) for k in range(41)} | {(100, 100), (101, 100)}


def test_edge_sets_that_agree_by_chance_differ(spark):
    hashes = spark.range(20000).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")).withColumn("h", F.xxhash64("u", "v") % 1_000_003)
    same = hashes.groupBy("h").agg(F.sort_array(F.collect_list("u")).alias("us")).filter("size(us) > 1").orderBy("h").first().us
    edges = [spark.createDataFrame([(u, u + 1)], "u bigint, v bigint") for u in same[:2]]
    sums = {e.agg(F.sum(F.xxhash64("u", "v") % 1_000_003)).first()[0] for e in edges}
    assert len(sums) == 1 and len({tuple(e.agg(*near_dedup._facts().values()).first()) for e in edges}) == 2
    assert sorted(map(tuple, near_dedup.connected(edges[0].toDF("a", "b")).collect())) == [(same[0], same[0]), (same[0] + 1, same[0])]


def test_suffix_arrays_are_sorted():
    draw = np.random.default_rng(1)
    for n in range(1, 120):
        x = np.append(draw.integers(1, 2 + n % 4, n), 0).astype(np.int16)
        assert suffix_arrays.suffix_array(x).tolist() == sorted(range(n + 1), key=lambda i: x[i:].tolist())


@pytest.mark.parametrize("shard_bytes", [2 << 20, 600])
def test_suffix_dedup_is_brute_force(docs, none, shard_bytes):
    rows, left = suffix_dedup.cut_texts(docs, 100, 16, shard_bytes)
    got = defaultdict(set)
    for r in rows.join(left, ["hi", "lo"], "left").collect():
        got[r.doc_id].add((r.n_bytes, r.n_removed or 0, r.n_spans or 0, r.cut_sha or r.sha))
    all_texts = [(k, (t or "").encode()) for k, t, *_ in _rows()]
    seen = Counter(t[k : k + 100] for _, t in all_texts for k in range(len(t) - 99))
    want = defaultdict(set)
    for doc_id, t in all_texts:
        gone = np.zeros(len(t), dtype=bool)
        for k in range(len(t) - 99):
            gone[k : k + 100] |= seen[t[k : k + 100]] > 1
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        want[doc_id].add((len(t), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    assert got == want
    assert suffix_dedup.removals(none).count() == 0


def test_tokens_are_those_of_the_tokenizer():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokens.default_path())
    odd = ["don't, O'Neil's <|endoftext|> q", "<|ENDOFTEXT|>", "U.S.A. a\x1cb é́ İstanbul, 中文字 ...'s ,,a.b x²½", "z" * 500, "İİ ıßẞ"]
    texts = [*odd, *_texts()]
    ids, starts = tokens.encode_column(pa.array(texts, pa.string()), tokens.default_path())
    for k, text in enumerate(texts):
        assert ids[starts[k] : starts[k + 1]].tolist() == [*own.encode(text or "", add_special_tokens=False).ids, tokens.END_ID]


def test_packing_round_trip(docs, none):
    packed = packing.pack(docs, 64, with_ids=True).cache()
    rows = packed.collect()
    by_sequence = defaultdict(list)
    for r in rows:
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r.length for r in rows)
    assert len(by_sequence) <= -(-total // 64) + 6  # a few remainders of like length stay alone
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    assert sum(len(r.ids) for r in packing.sequences(packed).collect()) == total
    pieces = Counter((r.doc_id, r.start) for r in rows)
    assert pieces[(5, 0)] == 2 and pieces[(None, 0)] == 2
    assert packing.pack(none).count() == 0


def test_fill_is_optimal():
    draw = random.Random(2)
    for _ in range(200):
        counts = {draw.randrange(1, 30): draw.randrange(1, 4) for _ in range(5)}
        room = draw.randrange(1, 60)
        sums = {0}
        for length, count in counts.items():
            sums = {s + k * length for s in sums for k in range(count + 1)}
        chosen = packing.fill(counts, room)
        assert all(k <= counts[n] for n, k in chosen.items())
        assert sum(n * k for n, k in chosen.items()) == max(s for s in sums if s <= room)


def test_decontamination_is_brute_force(spark, docs, none):
    base = _texts()[5]
    w = base.split()
    items = [(1, " ".join(w[20:50])), (2, " ".join(w[21:40]).upper()), (3, "two words"), (4, ""), (5, None), (6, "no such words at all"), (6, "x" * 900), (None, "one")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
    want = Counter()
    for doc_id, text, *_ in _rows():
        d, hit, names = words(text), set(), set()
        for item, passage in items:
            x = words(passage)
            n = min(13, len(x))
            windows = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)} if n else set()
            for k in range(len(d) - n + 1):
                if tuple(d[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    if item is not None:
                        names.add(str(item))
        sha = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        want[(doc_id, len(d), len(hit), len(names), sha, bool(hit) and 20 * len(hit) >= len(d))] += 1
    assert Counter(map(tuple, decontaminate.digest(decontaminate.contamination(docs, bench)).collect())) == want
    left = decontaminate.clean(docs, bench)
    assert left.columns == docs.columns and left.count() == sum(n for k, n in want.items() if not k[5])
    assert decontaminate.contamination(none, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_sentence_spans_and_texts(docs, none):
    rows = {r.doc_id: r for r in sentence_spans.removals(docs).collect() if r.doc_id is not None}
    assert rows[0].n_sentences == rows[1].n_sentences == rows[2].n_sentences == 0
    copies = [k for k, t in enumerate(_texts()) if t == _texts()[5]]
    assert rows[copies[1]].n_removed == rows[copies[1]].n_sentences > 2
    texts = sentence_spans.deduplicated(docs).collect()
    assert len(texts) == len(_rows())
    assert any(r.doc_id == copies[-1] and not r.text.strip() for r in texts)
    assert sentence_spans.removals(none).count() == 0


@pytest.mark.parametrize("stops", [(), (12, 25, 38)])
def test_passages_in_mid_sentence(spark, none, stops):
    passage = [f"p{k}" + ("." if k in stops else "") for k in range(51)]
    heads = [0, 3, 8, 13, 29]
    around = lambda k, n, w: [f"{w}{k}x{j}" for j in range(n)]
    texts = [" ".join([*around(k, n, "a"), *passage, *around(k, 40 - n, "z")]) for k, n in enumerate(heads)]
    texts += [" ".join([*around(9, 5, "a"), *passage[:21], *around(9, 5, "z")]), "\n".join(passage)]
    rows = {r.doc_id: r for r in sentence_spans.passages(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)).collect()}
    assert rows[0].n_removed == rows[5].n_removed == 0
    for k in (1, 2, 3, 4, 6):
        gone = [texts[k].encode()[slice(*map(int, s.split(":")))].decode().split() for s in rows[k].removed.split(",")]
        gone = [w for words in gone for w in words]
        assert len(gone) >= sentence_spans.LEAST and set(gone) <= set(passage)
    assert sentence_spans.passages(none).count() == 0


def test_passages_on_odd_rows(docs):
    rows = sentence_spans.passages(docs).collect()
    assert len(rows) == len(_rows())
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    copies = [k for k, t in enumerate(_texts()) if t == _texts()[5]]
    assert by_id[0].n_pieces == by_id[1].n_pieces == by_id[2].n_pieces == 0
    assert by_id[copies[-1]].n_removed == by_id[copies[-1]].n_pieces > 2


def test_quality_rules_base_values(docs, none):
    def brute(text):
        w = _words(text)
        grams = defaultdict(list)
        for k in range(len(w) - 4):
            grams[tuple(w[k : k + 5])].append(k)
        again = {k + j for at in grams.values() if len(at) > 1 for k in at for j in range(5)}
        lines = [x for x in (text or "").split("\n") if _words(x)]
        symbols = sum(c in "#*$%&|<>" for c in text or "")
        return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(again), len(w) < 10 or 100 * len(again) > 20 * len(w)

    got = quality_rules.rule_verdicts(docs).collect()
    want = Counter((k, *brute(t)) for k, t, *_ in _rows())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert all(not r.kept for r in got if r.base_failed)
    assert quality_rules.rule_verdicts(none).count() == 0
    entries = quality_rules.ledger(docs)
    table = {r.rule: (r.n_failed, r.n_only) for r in quality_rules.ablations(entries, "v2").collect()}
    masks = [r.fail_bits for r in entries.collect()]
    for k, rule in enumerate(quality_rules.RULES):
        assert table.get(rule, (0, 0)) == (sum(m >> k & 1 for m in masks), sum(m == 1 << k for m in masks))


def test_chat_round_trip(spark):
    said = ["</s>[INST] ok [/INST]", "a\\b", "[/INST]", "<s>[INST]", "", None, "x</", "s>", "\\[INST]\n\\\\", "plain " * 500]
    rows = [(k // 4, k % 4, ["user", "assistant", None, "[/INST]"][k % 4], t, 1) for k, t in enumerate(said * 3)]
    rows += [(None, None, "assistant", "lost", 1), rows[0]]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, turns int")
    got = {r.conv_id: r for r in chat_format.digest(chat_format.format_chats(chat_format.with_probe(table))).collect()}
    every = [*[r[:4] for r in rows], (-7, 0, "user", said[0]), (-7, 1, "assistant", said[0])]
    for conv in {r[0] for r in every}:
        turns = sorted(((-1 if t is None else t, r or "", x or "") for c, t, r, x in every if c == conv))
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.digest(chat_format.format_chats(table.limit(0))).count() == 0


def test_sharding_is_balanced_and_moves_little(docs, none):
    before, after = (sharding.lookup_table(sharding.shard_names(n), 1009) for n in (20, 21))
    sizes = np.bincount(before)
    assert sizes.max() - sizes.min() <= 1
    assert (before != after).mean() < 0.25
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 1000)
    rows = sharding.placements(docs).collect()
    assert len(rows) == len(_rows()) and len({(r.doc_id, r.shard) for r in rows if r.doc_id == 5}) == 1
    assert sharding.placements(none).count() == 0


def test_pii_patterns_and_masks(docs, none):
    text = "A.b@c.de x@y @z.de 256.1.1.1 1.2.3.4 or 4111 1111 1111 1111, 4111111111111112, +1 (456) 555-2186 +12 é9"
    spans = [(pii.KINDS[k], text[a:b]) for a, b, k in pii.base_spans(text)]
    assert spans == [("email", "A.b@c.de"), ("ip", "1.2.3.4"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (456) 555-2186")]
    assert pii.mask("ab 1.2.3.4.", [(3, 10, 1)]) == "ab [IP]."
    for probe in ("a@b@c.de", "..@x.y.z@q.r", "a@b.c@d.e f@g..h"):
        assert [s[:2] for s in pii._emails(probe)] == [m.span() for m in pii._EMAIL.finditer(probe)]
    rows = pii.detect(docs, None).collect()
    assert len(rows) == len(_rows())
    assert {r.spans for r in rows if r.n_email} == {"email:0:6,ip:7:14"}
    assert pii.learn(none) is None and pii.detect(none, None).count() == 0
    assert pii.masked(docs, None).filter("text like '[EMAIL] [IP]'").count() == 1


def test_tagger_gradients_and_learning():
    draw = np.random.default_rng(0)
    model = bilstm_crf.new_model(5)
    ids, tags = draw.integers(0, bilstm_crf.CLASSES, (3, 6)), draw.integers(0, 5, (3, 6))
    _, grads = bilstm_crf.loss_and_gradients(model, ids, tags)
    for key, at in (("input", (1, ids[0, 2], 3)), ("recur", (0, 2, 5)), ("bias", (1, 0, 7)), ("out", (3, 1)), ("trans", (1, 2))):
        model[key][at] += 1e-5
        up, _ = bilstm_crf.loss_and_gradients(model, ids, tags)
        model[key][at] -= 2e-5
        down, _ = bilstm_crf.loss_and_gradients(model, ids, tags)
        model[key][at] += 1e-5
        assert abs((up - down) / 2e-5 - grads[key][at]) < 1e-6
    texts = [f"word {'word ' * (k % 5)}{draw.integers(1, 255)}.{draw.integers(1, 255)}.7.{k % 250} more text" for k in range(160)]
    windows = [(pii.window_ids(bilstm_crf.char_ids(t), s), pii.window_ids(pii.tags_of(len(t), pii.base_spans(t)), s)) for t in texts for s in pii.window_starts(t)]
    x, y = (np.array(z) for z in zip(*windows))
    trained = bilstm_crf.train(x[:-60], y[:-60], pii.TAGS, 60)
    assert (bilstm_crf.decode(trained, x[-60:], pii._ALLOWED) == y[-60:]).mean() > 0.97


def test_quality_classifier_on_held_out_rows(spark):
    draw = random.Random(4)
    good = lambda: "\n".join("The " + " ".join(draw.choice(["river", "runs", "past", "old", "mills"]) for _ in range(9)) + "." for _ in range(4))
    bad = lambda: "\n".join(" ".join(draw.choice(["BUY", "NOW", "###", "$$$"]) + "!!" for _ in range(9)) for _ in range(4))
    rows = [(k, good() if k % 3 else bad(), "x") for k in range(300)] + [(1000, None, "x"), (1001, "", "x"), (1001, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(300)] + [(5, 0, 0), (None, 1, 0), (7, None, 0)], "doc_id bigint, quality int, toxic int")
    got = quality_crf.quality(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 300]
    assert sum(r.predicted == (r.doc_id % 3 > 0) for r in held) / len(held) > 0.98
    assert {r.score for r in quality_crf.quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_crf.quality(docs.limit(0), labels).count() == 0


def test_line_marginals_are_those_of_all_labellings():
    draw = np.random.default_rng(2)
    counts, trans = np.array([1, 4, 2]), draw.normal(size=(2, 2))
    e = draw.normal(size=7)
    ahead, back = quality_crf.messages(e, trans, counts)
    at = 0
    for n in counts:
        weight, good = 0.0, np.zeros(n)
        for code in range(1 << n):
            y = np.array([code >> k & 1 for k in range(n)])
            p = np.exp((e[at : at + n] * y).sum() + sum(trans[a, b] for a, b in zip(y, y[1:])))
            weight, good = weight + p, good + p * y
        assert np.allclose(1 / (1 + np.exp(-(ahead + back)[at : at + n])), good / weight)
        at += n
