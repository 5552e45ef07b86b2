"""Vector codes against full comparisons, on odd rows and clustered points; the tables are compared with SQL elsewhere."""

import hashlib
import math

import numpy as np
import pytest

from issuequarry.llm import vector_codes as V

SCHEMA = "vec_id bigint, embedding array<float>, label int, code string, part int, error string"


def _expected(rows):
    def usable(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)

    kept = sorted((r for r in rows if usable(r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = max(1, math.ceil(max((len(r[1]) for r in kept), default=0) / 8)) * 8
    bound = math.isqrt((1 << 60) // width)
    axes = width // 8
    whole = [[max(-bound, min(bound, math.floor(4096 * float(np.float32(x))))) for x in r[1]] + [0] * (width - len(r[1])) for r in kept]
    parts = [[w[p * axes : (p + 1) * axes] for w in whole] for p in range(8)]
    books = [[list(x) for x in parts[p][:16]] for p in range(8)]

    def nearest(p):
        return [min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p])) for x in parts[p]]

    for _ in range(6):
        for p in range(8):
            near = nearest(p) if kept else []
            for k in range(len(books[p])):
                mine = [x for x, (_, at) in zip(parts[p], near) if at == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    ends = [nearest(p) for p in range(8)] if kept else []
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, per_label = [], {}
    for k, (vec_id, _, label) in enumerate(kept):
        error = sum(ends[p][k][0] for p in range(8))
        per_label[label] = per_label.get(label, 0) + error
        out.append((vec_id, "".join(f"{ends[p][k][1]:02x}" for p in range(8)), error, label))
    return sorted(((v, c, e, per_label[label], digest) for v, c, e, label in out), key=repr)


def _compressed(spark, rows):
    df = spark.createDataFrame([(v, e, label, "x", 1, "y") for v, e, label in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, V.digest(*V.compress(df)).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


def _vectors(n, dim, seed=3):
    draw = np.random.default_rng(seed)
    centres = draw.standard_normal((5, dim))
    return (centres[draw.integers(0, 5, n)] + 0.1 * draw.standard_normal((n, dim))).astype(np.float32).tolist()


def test_odd_rows(spark):
    rows = [(k, v, [None, 1, 2][k % 3]) for k, v in enumerate(_vectors(300, 24))]
    rows += [(400, None, 1), (401, [1.0, None], 1), (402, [float("nan")] * 24, 1), (403, [float("inf")] * 24, 1), (404, [], 2)]
    rows += [(405, [0.5] * 5, None), (406, [1e30] * 24, 1), (407, [-1e30] * 24, 1), (None, rows[3][1], 1), (5, rows[7][1], 1), rows[9], rows[9]]
    rows += [(500 + k, rows[0][1], 9) for k in range(200)]
    assert _compressed(spark, rows) == _expected(rows)


@pytest.mark.parametrize("n", [0, 1, 15, 17])
def test_few_vectors(spark, n):
    rows = [(k, v, 1) for k, v in enumerate(_vectors(n, 8) if n else [])]
    assert _compressed(spark, rows) == _expected(rows)


def test_unequal_lengths_are_filled_up(spark):
    rows = [(k, v[: 3 + k % 9], 1) for k, v in enumerate(_vectors(60, 11))]
    assert _compressed(spark, rows) == _expected(rows)


def test_blocks_settle_what_a_full_comparison_does():
    points = (np.array(_vectors(3001, 8)) * 4096).astype(np.int64)
    entries = points[:16]
    part, order = V.FlatPart.laid_out(points)
    full = ((points[:, None, :] - entries[None]) ** 2).sum(2)
    codes, errors = part.coded(entries)
    assert (codes == full.argmin(1)[order]).all() and (errors == full.min(1)[order]).all()
    counts, sums = part.totals(entries)
    assert counts.tolist() == np.bincount(full.argmin(1), minlength=16).tolist()
    assert all((sums[k] == points[full.argmin(1) == k].sum(0)).all() for k in range(16))
    # Boxes leave fewer comparisons than all of them.
    assert part.shortlists(entries).mean() < 0.6


@pytest.mark.parametrize("axes, bits", [(2, 4), (3, 3), (1, 5), (4, 2)])
def test_neighbours_on_the_curve_touch(axes, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes).astype(np.uint64)
    keys = V.hilbert_keys(cells, bits)
    assert sorted(keys.tolist()) == list(range(1 << (axes * bits)))
    walk = cells[np.argsort(keys)].astype(np.int64)
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_restored_vectors_are_near(spark):
    rows = [(k, v, 1) for k, v in enumerate(_vectors(400, 16))]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    codes, books = V.compress(df)
    back = {r.vec_id: r.embedding for r in V.restored(codes, books).collect()}
    errors = {r.vec_id: r.error for r in codes.collect()}
    for k, v, _ in rows:
        gap = sum((math.floor(4096 * x) - round(4096 * y)) ** 2 for x, y in zip(v, back[k]))
        assert gap == errors[k]
