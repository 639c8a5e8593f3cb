import math

import numpy as np
import pytest

from menurank.llm import whiten


def plain(rows, count=16):
    kept = [(i, np.array([math.floor(64 * float(c)) + 1_000_000 for c in v], dtype=np.int64)) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for d in sorted({len(x) for _, x in kept} - {0}):
        own = [(i, x) for i, x in kept if len(x) == d]
        fit = np.unique(np.array([x for _, x in own]), axis=0)
        n, s = len(fit), fit.sum(axis=0)
        centred = (n * fit - s) / n
        e, q = np.linalg.eigh(centred.T @ centred / n)
        e, q = e[::-1], q[:, ::-1]
        k = min(count, int((e > 1e-11 * max(e[0], 1e-300)).sum()))
        for i, x in own:
            off = n * x - s
            out += [(i, c + 1, n, sum(int(o) ** 2 for o in off), float(off @ q[:, c] / n / math.sqrt(e[c])), e[c] / e.sum()) for c in range(k)]
    return out


def vectors(n, d, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)) * np.linspace(3, 1, d) + rng.standard_normal((n, 2)) @ rng.standard_normal((2, d)) * 2 + 5
    return [(i, [float(c) for c in v]) for i, v in enumerate(x.astype(np.float32))]


def compare(spark, rows, count=16):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, component string, n int")
    got = sorted((tuple(r) for r in whiten.whiten(df, count=count).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[2], r[1], r[3]))
    want = sorted(plain([(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows], count), key=lambda r: (r[0] is None, r[0] or 0, r[2], r[1], r[3]))
    assert [r[:4] for r in got] == [r[:4] for r in want]
    signs = {}
    for g, w in zip(got, want, strict=True):
        if abs(w[4]) > 1e-3:
            assert signs.setdefault((g[2], g[1]), g[4] * w[4] > 0) == (g[4] * w[4] > 0)
        assert abs(g[4]) == pytest.approx(abs(w[4]), abs=1e-7) and g[5] == pytest.approx(w[5], rel=1e-9) and g[6] < 1e-8
    return got


def test_whitening_against_numpy(spark):
    rows = vectors(400, 64)
    rows += [(7, rows[7][1]), (900, rows[3][1]), (None, rows[4][1]), (901, None), (902, [None] * 64), (903, [float("nan")] * 64), (904, [float("inf")] + [0.0] * 63), (905, []), (906, [1.0, 2.0]), (907, [2.0, 1.0]), (908, [3.0])]
    got = compare(spark, rows)
    assert {r[0] for r in got} >= {900, None, 906, 907} and not {r[0] for r in got} & {901, 902, 903, 904, 905, 908}
    assert sum(r[0] == 7 for r in got) == 32


def test_few_directions_and_empty(spark):
    compare(spark, vectors(12, 64))  # 11 directions
    compare(spark, vectors(60, 5))
    assert compare(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []
    assert whiten.whiten(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_spectra_without_gaps():
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.standard_normal((90, 90)))[0]
    for values in (np.ones(90), np.r_[np.full(20, 2.0), np.ones(70)], np.r_[np.full(10, 5.0), np.linspace(2, 1, 80)], np.r_[1e9, np.linspace(1, 0, 89)], np.geomspace(1, 1e-9, 90)):
        v = q * values @ q.T
        found, vectors_, passes = whiten.leading(lambda x, v=v: v @ x, 90, values.sum(), 16, guard=24, degree=10, most_rounds=40)
        kept = values[:16][values[:16] > whiten.RANK * values[0]]
        assert found == pytest.approx(kept, rel=1e-9, abs=1e-13 * values[0]) and passes < 400
        assert np.abs(v @ vectors_ - vectors_ * found).max() <= 1e-11 * values[0]


def test_exact_deviations():
    x = np.array([[0, 10], [1 << 40, 3]], dtype=np.int64)
    assert whiten.deviations(x, 3, np.array([7, 8])) == [49 + 22**2, None]
    assert whiten.deviations(np.array([[1 << 30, 0]], dtype=np.int64), 2, np.array([0, 0])) == [1 << 62]
