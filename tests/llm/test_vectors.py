"""Top-k by segment bounds and whitening against numpy on all pairs, with nulls, ties, repeats, short and empty vectors."""

import math

import numpy as np
import pytest

from tallgrass.llm import segment_topk, whitening

SF = "/root/testdata/sf0.001"
KINDS = "vec_id long, embedding array<float>, label int, score string, n int, component double"
NAN, INF = float("nan"), float("inf")
ODD = [
    (50_000, None), (50_001, [1.0, None]), (50_002, [NAN] * 64), (50_003, [0.5] * 63 + [INF]), (50_004, []), (50_050, [0.25] * 3), (None, [0.1] * 64),
    (50_100, [0.5] * 64), (50_101, [0.5] * 64), (50_102, [0.5] * 64), (50_150, [0.5] * 64), (50_150, [0.5] * 64), (50_151, [0.5] * 63 + [0.75]), (50_151, [0.5] * 64), (50_007, [3e30] * 64),
]


def frame(spark, rows):
    """With columns that clash with the operators' own names."""
    return spark.createDataFrame([(i, v, 1, "s", 7, 0.5) for i, v in rows], KINDS)


@pytest.fixture(scope="module")
def table(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    return rows + ODD


def quantised(rows, scale, shift, limit):
    out = []
    for i, v in rows:
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        x = [math.floor(scale * float(np.float32(c))) for c in v]
        if all(abs(scale * float(np.float32(c))) < limit for c in v):
            out.append((i, [c + shift for c in x]))
    return out


def brute_topk(rows, every, k):
    best = {}
    for i, v in quantised(rows, 256, 0, segment_topk.LIMIT):
        if i is not None:
            best[i] = max(best.get(i, v), v)
    out = []
    for q in (i for i in best if i % every == 0):
        scores = sorted((-sum(a * b for a, b in zip(best[q], v)), i) for i, v in best.items() if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_segment_topk_equals_all_pairs(spark, table):
    got = segment_topk.search_embeddings(frame(spark, table), 50, 5)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute_topk(table, 50, 5)


def test_segment_topk_in_many_blocks(spark, table, monkeypatch):
    for name, rows in (("QUERY_ROWS", 3), ("SLOT_ROWS", 40), ("LEAST_ROWS", 40)):
        monkeypatch.setattr(segment_topk, name, rows)
    got = segment_topk.search_embeddings(frame(spark, table).repartition(5), 20, 7)
    assert sorted(map(tuple, got.collect())) == brute_topk(table, 20, 7)


def test_segment_topk_of_few_and_none(spark):
    assert sorted(map(tuple, segment_topk.search_embeddings(frame(spark, [(0, [1.0]), (1, [2.0])]), 50, 5).collect())) == [(0, 1, 1, 256 * 512)]
    assert segment_topk.search_embeddings(frame(spark, [(0, [1.0])]), 50, 5).count() == 0
    assert segment_topk.search_embeddings(frame(spark, [(1, [1.0]), (2, [2.0])]), 50, 5).count() == 0
    assert segment_topk.search_embeddings(frame(spark, []), 50, 5).count() == 0


def test_bounds_hold_and_tighten():
    rng = np.random.default_rng(3)
    x = rng.integers(-300, 300, (50, 61)).astype(float) * rng.integers(0, 2, (50, 1))
    dots, last = x @ x.T, None
    for s in (1, 4, 16, 32):
        stats = segment_topk.segment_statistics(x, s)
        bound = stats @ stats.T
        assert (bound >= dots - 1e-6).all()
        assert last is None or bound.sum() < last
        last = bound.sum()


def test_bounds_leave_most_of_clustered_items_out():
    rng = np.random.default_rng(4)
    centres = np.repeat(rng.integers(-200, 200, (40, 16)), 4, axis=1)
    x = (centres[rng.integers(0, 40, 4000)] + rng.integers(-20, 20, (4000, 64))).astype(np.int64)
    block = segment_topk.Block(5)
    block.add(np.arange(20), x[:20])
    for lo in range(0, 4000, 1000):
        block.meet(np.arange(lo, lo + 1000), x[lo : lo + 1000])
    assert block.n_scored < block.n_pairs / 10
    scores = x[:20] @ x.T
    scores[np.arange(20), np.arange(20)] = -(10**12)
    got = block.rows().to_pydict()
    assert got["score"] == [s for r in scores for s in sorted(r, reverse=True)[:5]]


def brute_whitening(rows, k=8):
    rows = quantised(rows, whitening.SCALE, whitening.SHIFT, whitening.LIMIT)
    w = max((len(v) for _, v in rows), default=0)
    ints = [v + [whitening.SHIFT] * (w - len(v)) for _, v in rows]
    n, sums = len(ints), [sum(c) for c in zip(*ints)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(v, sums)) for v in ints]
    x = np.array(ints, float)
    y = x - np.array([s / n for s in sums])
    values, vectors = np.linalg.eigh(y.T @ y / n)
    order = np.argsort(-values)[:k]
    return [i for i, _ in rows], deviation, y @ vectors[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def test_whitening_equals_eigh(spark, table):
    rows = [r for r in table if r[0] != 50_007 and r[1:] != ([0.5] * 63 + [0.75],)]  # one vector an id
    got = whitening.whiten(frame(spark, rows)).collect()
    ids, deviation, white, explained = brute_whitening(rows)
    assert len(got) == 8 * len(ids) and {r.n for r in got} == {len(ids)}
    assert sorted((str(r.vec_id), r.deviation) for r in got) == sorted((str(i), d) for i, d in zip(ids, deviation) for _ in range(8))
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    for c in range(8):
        mine = np.array([by[i, c + 1][0].whitened for i in ids])
        sign = np.sign(mine @ white[:, c])
        assert np.allclose(mine * sign, white[:, c], atol=1e-8)
        assert math.isclose(by[ids[0], c + 1][0].explained, explained[c], rel_tol=1e-9)
    assert got[0].identity_error < 1e-9


def test_jacobi_is_accurate_on_small_eigenvalues():
    rng = np.random.default_rng(5)
    q, _ = np.linalg.qr(rng.normal(size=(30, 30)))
    scale = 10.0 ** -np.arange(30)
    for a in ((q * scale) @ q.T, np.eye(4), np.zeros((3, 3)), np.zeros((0, 0)), np.full((5, 5), 2.0)):
        a = (a + a.T) / 2
        values, vectors = whitening.jacobi(a)
        assert (np.diff(values) <= 0).all()
        assert np.allclose(vectors.T @ vectors, np.eye(len(a)), atol=1e-13)
        assert np.allclose((vectors * values) @ vectors.T, a, atol=1e-14)
    graded = np.diag(scale) @ (np.eye(30) + 0.1 * np.ones((30, 30))) @ np.diag(scale)  # small values that a scaled matrix fixes well
    values, _ = whitening.jacobi(graded)
    from fractions import Fraction

    exact = _smallest_by_inverse([[Fraction(float(c)) for c in r] for r in graded])
    assert math.isclose(values[-1], exact, rel_tol=1e-10)


def _smallest_by_inverse(a):
    """The smallest eigenvalue of a small graded matrix: 1 / the largest of its exact inverse, by power iteration."""
    from fractions import Fraction

    n = len(a)
    m = [r[:] + [Fraction(int(i == j)) for j in range(n)] for i, r in enumerate(a)]
    for i in range(n):
        p = m[i][i]
        m[i] = [x / p for x in m[i]]
        for j in range(n):
            if j != i and m[j][i]:
                f = m[j][i]
                m[j] = [x - f * y for x, y in zip(m[j], m[i])]
    inv = np.array([[float(x) for x in r[n:]] for r in m])
    v = np.ones(n)
    for _ in range(50):
        v = inv @ v
        v /= np.linalg.norm(v)
    return 1 / float(v @ inv @ v)


def test_whitening_of_odd_tables(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, None), (2, [])])).count() == 0
    one = whitening.whiten(frame(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(one)] == [(i, c, 2, 0, None, None, None) for i in (1, 2) for c in (1, 2)]
    line = whitening.whiten(frame(spark, [(i, [float(i), 2.0 * i, 1.0]) for i in range(10)])).where("vec_id = 9").orderBy("component").collect()
    assert math.isclose(line[0].explained, 1.0) and line[1].whitened is None and line[0].identity_error < 1e-9
    far = whitening.whiten(frame(spark, [(1, [5e8, 0.0]), (2, [-5e8, 0.0]), (3, [1.0, 1.0])])).collect()
    exact = {i: d for i, d in zip(*brute_whitening([(1, [5e8, 0.0]), (2, [-5e8, 0.0]), (3, [1.0, 1.0])], 2)[:2])}
    assert {(r.vec_id, r.deviation) for r in far} == {(i, d if d < 2**63 else None) for i, d in exact.items()}


def test_whitening_does_not_depend_on_partitions(spark, table):
    a, b = (whitening.whiten(frame(spark, table).repartition(p)).where("vec_id < 100").orderBy("vec_id", "component").collect() for p in (1, 7))
    assert np.allclose([r.whitened for r in a], [r.whitened for r in b], atol=1e-9)
