"""Scoring by context trees holds one block of the tree and of the word counts at a time."""

import tracemalloc
import weakref

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast

from tallyforge.llm import ctw


class _Captured:
    """Stands for the texts to score; gives the function that scores their batches."""

    dtypes = [("doc_id", "bigint")]

    def __init__(self, spark):
        self.sparkSession = spark

    def select(self, *_):
        return self

    def mapInArrow(self, work, _):
        return work


def test_one_block_in_memory(spark, monkeypatch):
    rows = [(i, i % 5 == 0, " ".join(f"w{i * 7 + j}z" for j in range(40))) for i in range(500)] + [(-1, False, None), (-2, True, "Zürich \x00 \t")]
    docs = spark.createDataFrame(rows, "doc_id long, held_out boolean, text string")
    want = {r["doc_id"]: r for r in ctw.score_texts(docs, docs.filter("not held_out")).collect()}
    work = ctw.score_texts(_Captured(spark), docs.filter("not held_out"), block_contexts=500, block_words=300)
    loaded, most = [], [0]

    def load(self, path, read=Broadcast.load_from_path):
        most[0] = max(most[0], sum(r() is not None for r in loaded))  # arrays of other blocks that are still there
        value = read(self, path)
        loaded.extend(weakref.ref(x) for x in (value if isinstance(value, tuple) else (value,)))
        return value

    monkeypatch.setattr(Broadcast, "load_from_path", load)
    tracemalloc.start()
    table = pa.table({k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("text", pa.string())])})
    got = [r for b in work(iter(table.to_batches())) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert len(loaded) > 20 and most[0] == 0
    assert peak < 40  # 64 MB by an array over all triples of bytes
    for r in got:
        w = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["n_predicted"]) == (w["n_tokens"], w["n_known"], w["train_tokens"], w["n_predicted"])
        assert np.allclose((r["base_score"], r["score"]), (w["base_score"], w["score"]), rtol=1e-9)
    assert len(got) == len(rows)
