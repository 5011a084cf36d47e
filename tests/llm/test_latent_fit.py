"""The latent space of op8 against an exact SVD of the passages of all documents and items."""

import random

import numpy as np

from tallyforge.llm import decontaminate as d


def test_space_holds_all_documents(spark):
    r = random.Random(3)
    texts = [" ".join(f"w{i % 60}x{int(40 * r.random() ** 2)}" for _ in range(r.choice([0, 5, 32, 100]))) for i in range(1500)] + [None, ""]
    items = [" ".join(f"w{r.randrange(60)}x{r.randrange(40)}" for _ in range(40)) for _ in range(5)]
    table = lambda x: d.feature_rows(spark.createDataFrame([(t,) for t in x], "text string").repartition(5))
    docs = table(texts)
    df, n, n_words = d.document_frequencies(docs)
    split = [(t or "").split() for t in texts]
    assert n == len(texts) and n_words == sum(map(len, split))
    names = sorted({w for x in [*split, *(t.split() for t in items)] for w in x})
    feature = dict(zip(names, d._feature(d.word_hashes(*d.joined_bytes([" ".join(names)]))[0]).tolist(), strict=True))
    want = np.zeros(d.FEATURES, np.int64)
    for x in split:
        want[list({feature[w] for w in x})] += 1
    assert (df == want).all()
    idf = np.log((1 + n) / (1 + df)).astype(np.float32)
    passages = [x[a : a + d.WIDTH] for x in [*split, *(t.split() for t in items)] for a in range(0, len(x), d.WIDTH)]
    used = sorted(set(feature.values()))
    place = {f: i for i, f in enumerate(used)}
    a = np.zeros((len(passages), len(used)))
    for i, p in enumerate(passages):
        for w in p:
            a[i, place[feature[w]]] += idf[feature[w]]
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    best = (np.linalg.svd(a, compute_uv=False)[:50] ** 2).sum()
    space = d.latent_space(docs, table(items), idf, rank=50, extra=30, common=0).astype(np.float64)[used]
    assert np.abs(space.T @ space - np.eye(50)).max() < 0.02
    held = ((a @ space) ** 2).sum()
    of = [i for i, x in enumerate([*split, *(t.split() for t in items)]) for _ in range(0, len(x), d.WIDTH)]
    some = set(r.sample(range(len(texts)), 512)) | set(range(len(texts), len(texts) + len(items)))
    sampled = np.linalg.svd(a[[i for i, o in enumerate(of) if o in some]], full_matrices=False)[2][:50]
    assert held > 0.93 * best and held > 1.02 * ((a @ sampled.T) ** 2).sum()  # exact, but of the sample that was fitted on before
    again = d.latent_space(docs, table(items), idf, rank=50, extra=30, common=0)
    assert (again[used] == space).all()


def test_stage_fits_on_every_document(spark, tmp_path, monkeypatch):
    """The pipeline's stage: 700 documents, more than the 512 that were fitted on before."""
    seen = []

    def spy(rows, items, idf):
        seen.append(d.document_frequencies(rows)[1])
        return np.eye(d.FEATURES, 1, dtype=np.float16)

    monkeypatch.setattr(d, "latent_space", spy)
    docs = spark.createDataFrame([(i, f"a{i} b{i % 7} c") for i in range(700)], "doc_id long, text string")
    spark.createDataFrame([(1, "x y z")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert d.stage_decontaminate(spark, docs, str(tmp_path)).count() == 700
    assert seen == [700]


def test_space_holds_documents_whose_words_no_item_has(spark):
    """Three quarters of the documents share no word with any item; an exact SVD of all passages is what the space must come near."""
    r = random.Random(5)
    topic = lambda kind, k: " ".join(f"{kind}{k}x{int(30 * r.random() ** 2)}" for _ in range(64))
    texts = [topic("a", i % 40) for i in range(400)] + [topic("b", i % 40) for i in range(1200)]
    items = [topic("a", r.randrange(40)) for _ in range(120)]
    table = lambda x: d.feature_rows(spark.createDataFrame([(t,) for t in x], "text string").repartition(5))
    docs = table(texts)
    df, n, _ = d.document_frequencies(docs)
    idf = np.log((1 + n) / (1 + df)).astype(np.float32)
    a = []
    for t in [*texts, *items]:
        f = d._feature(d.word_hashes(*d.joined_bytes([t]))[0])
        a += [np.bincount(f[i : i + d.WIDTH], minlength=d.FEATURES) for i in range(0, len(f), d.WIDTH)]
    used = np.flatnonzero(np.any(a, axis=0))
    a = np.array([x[used] for x in a]) * idf[used].astype(np.float64)
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    best = (np.linalg.svd(a, compute_uv=False)[:40] ** 2).sum()
    space = d.latent_space(docs, table(items), idf, rank=40, common=0).astype(np.float64)[used]
    assert ((a @ space) ** 2).sum() > 0.95 * best  # 0.53 where the subspace came from the items


def test_sums_of_rows():
    r = np.random.default_rng(2)
    f = np.sort(np.concatenate((np.repeat(3, 700), r.integers(0, 90, 400), np.arange(100, 140))))
    rows, y = r.integers(0, 50, len(f)), r.standard_normal((50, 5)).astype(np.float32)
    out, want = np.ones((150, 5), np.float32), np.ones((150, 5))
    d._add_rows(out, f, rows, y)
    np.add.at(want, f, y[rows])
    assert np.abs(out - want).max() < 1e-3
    d._add_rows(out, f[:0], rows[:0], y)
