"""What op8 does for each word: fingerprints, products and the look at runs, against plain ones."""

import random

import numpy as np
import pyarrow as pa

from tallyforge.llm import common
from tallyforge.llm import decontaminate as d


def _texts(r, n):
    word = lambda: "".join(r.choice("aAbZ\u00e9\u6f22\x00\x1f~\U0001f600") for _ in range(r.choice([1, 2, 3, 4, 9, 31, 32, 33, 70, 900])))
    return [r.choice([None, "", " \n", r.choice(["", "\x0b "]) + r.choice([" ", "\t\n"]).join(word() for _ in range(r.choice([1, 5, 40])))]) for _ in range(n)]


def test_fingerprints_of_few_lookups(monkeypatch):
    """The values are the sum of byte values times powers of the base; a short word's bytes are looked up two at a time."""
    r = random.Random(8)
    texts = _texts(r, 60)
    data, starts = common.joined_bytes(texts)
    for given in (pa.array(texts, pa.string()), pa.chunked_array([pa.array(["x", *texts[:9]])[1:], pa.array(texts[9:], pa.string())])):
        got = common.joined_bytes(given)
        assert got[0].tobytes() == data.tobytes() and (got[1] == starts).all()
    for lower in (True, False):
        hashes, first, at = common.word_hashes(data, starts, lower)
        split = [w for t in texts for w in (t or "").encode().translate(bytes(32 if i in b"\t\n\x0b\x0c\r" else i for i in range(256))).split(b" ") if w]
        want = [sum(int(common.BYTE64[b + 32 if lower and 65 <= b <= 90 else b]) * pow(int(common._BASE), i + 1, 2**64) for i, b in enumerate(w)) + len(w) for w in split]
        assert (hashes == common.mix64(np.array([x % 2**64 for x in want], np.uint64))).all()
        assert [data[a : a + len(w)].tobytes() for a, w in zip(first, split, strict=True)] == split and at[-1] == len(split)
    looked = []
    monkeypatch.setattr(common, "_SPACE", type("T", (np.ndarray,), {"__getitem__": lambda s, i: looked.append(np.size(i)) or np.ndarray.__getitem__(s, i)})((256,), bool, common._SPACE.tobytes()))
    common.word_hashes(data, starts)
    assert sum(looked) < len(data)  # each byte was looked up


def test_runs_that_may_hold():
    """No run that _able finds is lost, few others are kept, whatever the number of texts looked at together."""
    r = np.random.default_rng(3)
    n = np.array([0, 700, 5, 16, 0, 333, 1200])
    first = np.concatenate(([0], np.cumsum(n)))
    hashes = r.integers(0, 2**63, int(first[-1])).astype(np.uint64) * np.uint64(2)
    words = [hashes[a : a + m].tolist() for a, m in [(40, 48), (300, 20), (705, 16), (1300, 48), (1500, 90)]] + [r.integers(0, 2**63, 30).astype(np.uint64).tolist() for _ in range(6)]
    size, marks = np.array([len(w) for w in words]), d._marks(words)
    needed = size * 0.6
    place, owner = d._steps(first, d.STEP)
    os = np.sort(r.choice(np.flatnonzero(n), 400))
    starts = first[os] + (r.random(400) * n[os]).astype(int)
    ends = np.minimum(starts + r.integers(1, 260, 400), first[os + 1])
    ks = r.integers(0, len(words), 400)
    able = d._able(hashes, starts, ends, ks, size, needed, marks)
    assert able.any()
    for part in (1, 400, 1 << 21):
        may = d._may_hold(hashes, first, place, os, starts, ends, ks, size, needed, marks, part)
        assert not (able & ~may).any()
    assert may.sum() < 3 * able.sum() + 20


def test_product_of_few_passages_and_of_many():
    """Keys of 32 and of 64 bits give A'(A Q)."""
    r = np.random.default_rng(5)
    idf = r.random(d.FEATURES, np.float32)
    idf[::7] = 0
    scaled = d._times(r.standard_normal((d.FEATURES, 3)).astype(np.float16), idf)
    assert scaled.shape == (d.FEATURES + 1, 3) and not scaled[-1].any()
    for texts, long in ((50, 70), (70_000, 2)):
        f = r.integers(0, 300, texts * long) * 11
        first = np.arange(texts + 1) * long
        out = np.zeros((d.FEATURES, 3), np.float32)
        d._product(out, f, first, idf, scaled)
        if texts == 50:
            a = np.zeros((len(d._steps(first, d.WIDTH)[0]), 300 * 11), np.float32)
            for i, (p, o) in enumerate(zip(*d._steps(first, d.WIDTH), strict=True)):
                np.add.at(a[i], f[p : min(p + d.WIDTH, first[o + 1])], 1)
            norm2 = ((a * idf[: 300 * 11]) ** 2).sum(1)
            want = a.T @ ((a @ scaled[: 300 * 11]) / norm2[:, None]) * (idf[: 300 * 11, None] > 0)
        else:
            pair = f.reshape(-1, 2)
            w = idf[pair]
            norm2 = np.where(pair[:, 0] == pair[:, 1], 4 * w[:, 0] ** 2, (w**2).sum(1))
            y = scaled[pair].sum(1) * np.divide(1, norm2, out=np.zeros(len(pair)), where=norm2 > 0)[:, None]
            want = np.zeros((300 * 11, 3))
            np.add.at(want, f, np.repeat(y, 2, axis=0))
            want *= idf[: 300 * 11, None] > 0
        assert np.abs(out[: 300 * 11] - want).max() < 1e-3 * max(1, np.abs(want).max())
