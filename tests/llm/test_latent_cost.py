"""What op8's products and search do for each word and passage."""

import numpy as np

from tallyforge.llm import decontaminate as d


def test_few_small_matrices(monkeypatch):
    """Rare features are added without a matrix product each, frequent ones in groups of 32."""
    r = np.random.default_rng(4)
    f = np.sort(np.concatenate([np.repeat(np.arange(a, b), n) for a, b, n in [(0, 3000, 1), (3000, 5000, 2), (5000, 6000, 3), (6000, 6200, 100), (6200, 6201, 5000)]]))
    rows, y = r.integers(0, 50, len(f)), r.standard_normal((50, 5)).astype(np.float32)
    want = np.zeros((6300, 5))
    np.add.at(want, f, y[rows])
    made, plain = [], np.matmul
    monkeypatch.setattr(np, "matmul", lambda a, b, **k: made.append(len(b)) or plain(a, b, **k))
    out = np.zeros((6300, 5), np.float32)
    d._add_rows(out, f, rows, y)
    assert np.abs(out - want).max() < 1e-2 and np.abs(out - want)[:6200].max() < 1e-4
    assert sum(made) < 1200  # 9,917 in groups of eight with the rare ones among them


def test_near_pairs():
    r = np.random.default_rng(6)
    v, m = r.standard_normal((2500, 7)).astype(np.float32), r.standard_normal((11, 7)).astype(np.float32)
    limits = r.standard_normal(11).astype(np.float32) + 2
    want = np.nonzero(np.concatenate([v[a : a + 1024] @ m.T >= limits for a in range(0, 2500, 1024)]))
    got = d._near(v, m, limits)
    assert len(got[0]) and all((a == b).all() for a, b in zip(got, want, strict=True))
    assert all(len(x) == 0 for x in d._near(v, m[:0], limits[:0])) and all(len(x) == 0 for x in d._near(v, m, limits + 99))
