"""Benchmark decontamination by latent semantic retrieval.

Words are hashed to features; idf comes from all documents. A randomised SVD of TF-IDF passages - those of every
benchmark item and of every document - is computed by distributed products with the passage table: from a random start,
subspace iteration by A'(AQ) over all passages, the last product giving the space (Nystroem's approximation of A'A). Every
document is cut into overlapping passages of 32 words, each projected
into the latent space and compared by cosine with all benchmark segments. Passages above a segment's threshold are
candidates: the cosine that the least common subsequence still accepted gives in the worst position (least_cosine), so
the search is as wide as the check behind it, less one deviation of random cosines in the latent space. Runs of candidates are checked by the longest common subsequence with the whole item, and paraphrases (shorter common
subsequence) by whether the item's answer, its last sentence, is found there too.

The fit sees every item and document, about fit_words words a task, kept as features of two bytes a word; sums of tasks are
added in their order. Every document and item is searched.
The benchmark is compared in blocks of segments, each a broadcast of bounded size of which a task holds one at a time
where there are many. Texts are never shuffled.

Nulls and texts without words leak nothing; items without words match nothing. Repeated rows are reported each. Ties: of
equally good places of an item in a document the one with the larger cosine is told. Very long texts are searched whole,
a batch of their own. Columns other than those named aren't read; the stage passes them, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_shuffles, joined_bytes, materialize, packed, text_batches, trim_worker, unpacked, word_hashes

BITS = 16
FEATURES = 1 << BITS
SLICES = 16
STEP, WIDTH = 16, 32
SEGMENT = 48


def _feature(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def feature_rows(texts: DataFrame) -> DataFrame:
    """(features, first): the features of a batch of texts, as uint16, and the place of each text's first word and the end, as int64."""

    def work(batches):
        import pyarrow as pa

        for table in text_batches(batches, 2_000_000):
            hashes, _, first = word_hashes(*joined_bytes(table.column("text")))
            yield pa.record_batch([pa.array([_feature(hashes).astype(np.uint16).tobytes()], pa.binary()), pa.array([first.astype(np.int64).tobytes()], pa.binary())], names=["features", "first"])
        trim_worker()

    return texts.select("text").mapInArrow(work, "features binary, first binary")


def _read(table):
    """Features and first words of each row of feature_rows, one after another."""
    for f, x in zip(table.column("features"), table.column("first"), strict=True):
        yield np.frombuffer(f.as_buffer(), np.uint16).astype(np.int64), np.frombuffer(x.as_buffer(), np.int64)


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int, int]:
    """In how many texts of feature_rows each feature occurs, the number of texts and that of words: one array of fixed size a task, summed in slices."""

    def work(batches):
        import pyarrow as pa

        df, texts, words = np.zeros(FEATURES, np.int64), 0, 0
        for batch in batches:
            for f, first in _read(batch):
                owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
                both = (owner << BITS) | f
                both = np.sort(both.astype(np.uint32) if len(first) <= 1 << (32 - BITS) else both)  # short keys sort fast
                both = both[np.concatenate(([True], both[1:] != both[:-1]))] if len(both) else both
                df += np.bincount(both & (FEATURES - 1), minlength=FEATURES)
                texts, words = texts + len(first) - 1, words + len(f)
        yield pa.table([pa.array(range(SLICES), pa.int32()), [x.tobytes() for x in df.reshape(SLICES, -1)], [texts] * SLICES, [words] * SLICES], names=["slice", "x", "texts", "words"]).to_batches()[0]

    def total(key, table):
        import pyarrow as pa

        x = sum(np.frombuffer(b, np.int64) for b in table.column("x").to_pylist())
        return pa.table([pa.array([key[0].as_py()], pa.int32()), [x.tobytes()], [sum(table.column("texts").to_pylist())], [sum(table.column("words").to_pylist())]], names=["slice", "x", "texts", "words"])

    kind = "slice int, x binary, texts long, words long"
    got = rows.mapInArrow(work, kind).groupBy("slice").applyInArrow(total, kind).orderBy("slice").collect()
    return (np.concatenate([np.frombuffer(r["x"], np.int64) for r in got]), got[0]["texts"], got[0]["words"]) if got else (np.zeros(FEATURES, np.int64), 0, 0)


def passages(texts, width: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word fingerprints, text offsets in them, and (first word, text) of the steps that texts are cut into."""
    hashes, _, first = word_hashes(*joined_bytes(texts))
    return hashes, first, *_steps(first, step)


def _steps(first: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(first)
    steps = -(-n // step)
    owner = np.repeat(np.arange(len(n)), steps)
    place = first[:-1][owner] + (np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps)) * step
    return place, owner


def _sums(y: np.ndarray, rows: np.ndarray, start: np.ndarray, k: int, held: np.ndarray) -> np.ndarray:
    """Sums of y[rows] over the k places from each start on; held is room for the rows, used again and again."""
    x = y.take(rows.take((start[:, None] + np.arange(k)).reshape(-1)), axis=0, out=held[: len(start) * k], mode="clip")
    if k >= 8:
        return np.matmul(np.ones((1, k), np.float32), x.reshape(len(start), k, -1))[:, 0]
    for i in range(1, k):
        x[0::k] += x[i::k]
    return x[0::k]


def _add_rows(out: np.ndarray, f: np.ndarray, rows: np.ndarray, y: np.ndarray, group: int = 32, part: int = 2048) -> None:
    """Adds y[rows] to out[f], f ascending: sums of groups of rows of one feature, to which this is done again; what is left of a feature goes to out at once, features with as many rows left together."""
    held, place = np.empty((2, max(part, group), y.shape[1]), np.float32)
    while len(f):
        new = np.flatnonzero(np.concatenate(([True], f[1:] != f[:-1])))
        feature, count = f[new], np.diff(np.append(new, len(f)))
        full = count // group
        left = (count - full * group).astype(np.uint16)
        order = np.argsort(left, kind="stable")
        bounds = np.searchsorted(left[order], np.arange(group + 1))
        at = new + group * full
        for k in range(1, group):
            some = order[bounds[k] : bounds[k + 1]]
            for a in range(0, len(some), part // k):  # few enough for the cache
                i = some[a : a + part // k]
                to = feature[i]
                x = out.take(to, axis=0, out=place[: len(i)], mode="clip")
                x += _sums(y, rows, at[i], k, held)
                out[to] = x
        start = np.repeat(new, full) + group * (np.arange(full.sum()) - np.repeat(np.cumsum(full) - full, full))
        sums = np.empty((len(start), y.shape[1]), np.float32)
        for a in range(0, len(start), part // group):
            sums[a : a + part // group] = _sums(y, rows, start[a : a + part // group], group, held)
        f, rows, y = np.repeat(feature, full), np.arange(len(start)), sums


def _product(out: np.ndarray, f: np.ndarray, first: np.ndarray, idf: np.ndarray, scaled: np.ndarray) -> None:
    """Adds to out, but for its idf, A'(A Q) of the passages of texts; scaled: rows of Q times idf, and one of zeros."""
    place, owner = _steps(first, WIDTH)
    if not len(place):
        return
    ends = np.minimum(place + WIDTH, first[owner + 1])
    short = len(place) <= 1 << (32 - BITS)
    of = np.repeat(np.arange(len(place), dtype=np.uint32 if short else np.int64), ends - place)
    key = np.sort((f.astype(np.uint32) << 16) | of) if short else np.sort((f << 40) | of)  # by feature, then passage; short keys sort fast
    by_f, of = (key >> 16, key & np.uint32(0xFFFF)) if short else (key >> 40, key & ((1 << 40) - 1))
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    tf = np.diff(np.append(new, len(key)))
    norm2 = np.bincount(of[new], weights=(tf * idf[by_f[new]]) ** 2, minlength=len(place))
    y = _projected(f, place, ends, scaled, WIDTH)
    y *= np.divide(1, norm2, out=np.zeros(len(place)), where=norm2 > 0)[:, None].astype(np.float32)
    known = idf[by_f] > 0
    _add_rows(out, by_f[known].astype(np.int64), of[known].astype(np.int64), y)


def _multiplied(rows: DataFrame, weights, q: list[np.ndarray]) -> list[tuple[np.ndarray, float]]:
    """A'(A Q) over the passages of feature_rows: slices in half precision, each with the number it is to be multiplied by."""
    size = q[0].shape[1]
    basis = rows.sparkSession.sparkContext.broadcast(q)

    def halved(x):
        most = float(np.abs(x).max()) / 1024 or 1.0
        return (x / np.float32(most)).astype(np.float16).tobytes(), most

    def work(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        out, idf = np.zeros((FEATURES, size), np.float32), weights.value
        scaled = _times(np.concatenate(basis.value), idf)
        for batch in batches:
            for f, first in _read(batch):
                _product(out, f, first, idf, scaled)
        out *= idf[:, None]
        done = [halved(x) for x in out.reshape(SLICES, -1)]
        del out, scaled
        task = TaskContext.get().partitionId()
        yield pa.table([pa.array(range(SLICES), pa.int32()), pa.array([task] * SLICES, pa.int32()), [x for x, _ in done], [m for _, m in done]], names=["slice", "task", "x", "most"]).to_batches()[0]
        del done
        trim_worker()

    def total(key, table):
        import pyarrow as pa

        table = table.sort_by("task")  # so that reruns agree
        x, most = halved(sum(np.frombuffer(b.as_buffer(), np.float16).astype(np.float32) * np.float32(m) for b, m in zip(table.column("x"), table.column("most").to_pylist(), strict=True)))
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py() if len(key) > 1 else 0], pa.int32()), [x], [most]], names=["slice", "task", "x", "most"])

    kind = "slice int, task int, x binary, most double"
    some = rows.mapInArrow(work, kind).groupBy("slice", F.expr("task div 32").alias("part")).applyInArrow(total, kind)  # 32 tasks at a time
    got = some.groupBy("slice").applyInArrow(total, kind).orderBy("slice").collect()  # of fixed size
    z = [(np.frombuffer(r["x"], np.float16).reshape(-1, size), r["most"]) for r in got]
    basis.destroy()
    del got, some
    free_shuffles(rows.sparkSession)
    return z


def latent_space(rows: DataFrame, items: DataFrame, idf: np.ndarray, rank: int = 128, extra: int = 8, common: int = 6, rounds: int = 2, seed: int = 7) -> np.ndarray:
    """Right singular vectors of the TF-IDF passages of rows and items (feature_rows): a column each (float16).

    Subspace iteration from a random start, each round over all passages of both, gives the subspace Q; one more product
    Z = A'AQ gives A'A as Z (Q'Z)^-1 Z', whose vectors these are.
    The first `common` ones are left out: they hold languages and frequent words and make all passages alike. The driver
    holds bases in slices of half precision; small Gram matrices make them orthonormal.
    """
    size, height = rank + extra, FEATURES // SLICES
    rng = np.random.default_rng(seed)
    q = [rng.standard_normal((height, size), np.float32).astype(np.float16) for _ in range(SLICES)]
    weights = rows.sparkSession.sparkContext.broadcast(idf)
    every = rows.unionByName(items)
    for _ in range(rounds):
        z = _multiplied(every, weights, q)
        if not any(x.any() for x, _ in z):  # no passages at all
            weights.destroy()
            return np.zeros((FEATURES, 1), np.float16)
        change = _orthogonal(sum((_wide(x) * np.float32(m)).T @ (_wide(x) * np.float32(m)) for x, m in z)).astype(np.float32)
        q = [(_wide(x) * np.float32(m) @ change).astype(np.float16) for x, m in z]
        del z
    z = _multiplied(every, weights, q)
    weights.destroy()
    both, gram = np.zeros((size, size)), np.zeros((size, size))
    for (x, m), y in zip(z, q, strict=True):
        x = _wide(x) * np.float32(m)
        both += _wide(y).T @ x
        gram += x.T @ x
    del q
    values, vectors = np.linalg.eigh((both + both.T) / 2)
    change = vectors[:, values > values[-1] * 1e-5] / np.sqrt(values[values > values[-1] * 1e-5])
    values, vectors = np.linalg.eigh(change.T @ gram @ change)
    order = np.argsort(-values)[values[::-1] > values[-1] * 1e-6]
    order = order[min(common, len(order) // 8) : rank]  # few directions are all kept
    change = (change @ vectors[:, order] / np.sqrt(values[order])).astype(np.float32)
    return np.concatenate([(_wide(x) * np.float32(m) @ change).astype(np.float16) for x, m in z])


def _wide(x: np.ndarray) -> np.ndarray:
    return x.astype(np.float32)


def _orthogonal(gram: np.ndarray) -> np.ndarray:
    """The change of basis that makes columns with this Gram matrix orthonormal."""
    values, vectors = np.linalg.eigh(gram.astype(np.float64))
    scale = np.where(values > values[-1] * 1e-10, 1 / np.sqrt(np.maximum(values, 1e-30)), 0.0) if values[-1] > 0 else np.zeros(len(values))
    return vectors * scale


def _scaled(shared) -> np.ndarray:
    """Rows of the space times idf, and a row of zeros for places that hold no word."""
    return _times(*shared.value)


def _times(halves: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of half precision times idf, and a row of zeros, as float32; looked up, as NumPy converts halves one by one."""
    wide = np.arange(1 << 16, dtype=np.uint16).view(np.float16).astype(np.float32)
    out = np.zeros((len(halves) + 1, halves.shape[1]), np.float32)
    for a in range(0, len(halves), 1024):  # few enough for the cache
        np.multiply(wide.take(halves[a : a + 1024].view(np.uint16)), idf[a : a + 1024, None], out=out[a : a + 1024][: len(halves) - a])
    return out


def _projected(features: np.ndarray, place: np.ndarray, ends: np.ndarray, scaled: np.ndarray, width: int) -> np.ndarray:
    """Sums of the scaled rows of the words from each place on, `width` of them or as far as its end."""
    out = np.empty((len(place), scaled.shape[1]), np.float32)
    ones = np.ones((1, width), np.float32)
    part = max(1, 2048 // width)
    held = np.empty((part * width, scaled.shape[1]), np.float32)
    for a in range(0, len(place), part):  # few enough for the cache
        at = place[a : a + part, None] + np.arange(width)
        rows = np.where(at < ends[a : a + part, None], features.take(at, mode="clip"), FEATURES).reshape(-1)
        x = scaled.take(rows, axis=0, out=held[: len(rows)], mode="clip")
        np.matmul(ones, x.reshape(-1, width, scaled.shape[1]), out=out[a : a + part, None])
    return out


def _near(vectors: np.ndarray, matrix: np.ndarray, limits: np.ndarray, part: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Rows of vectors and of matrix whose product reaches the limit of the latter's row."""
    hits = [np.flatnonzero(vectors[a : a + part] @ matrix.T >= limits) + a * len(matrix) for a in range(0, len(vectors), part)]  # few enough for the cache
    return np.divmod(np.concatenate(hits), max(1, len(matrix)))


def _unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x))[:, None], 1e-12)


def common_subsequence(item: dict, size: int, words: list) -> int:
    """Length of the longest common subsequence; item maps a word to the bit set of its places among size words."""
    full = (1 << size) - 1
    v = full
    for m in filter(None, map(item.get, words)):
        u = v & m
        v = ((v + u) | (v - u)) & full
    return size - bin(v).count("1")


def _places(words: list) -> dict:
    out: dict = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | (1 << i)
    return out


def _answer(text: str) -> str:
    """The last sentence of an item that has several, else nothing."""
    parts = [p for p in text.replace("\n", " ").replace("?", ".").replace("!", ".").split(".") if p.strip()]
    return parts[-1] if len(parts) > 1 else ""


def least_share(size: int, answer: bool, share: float = 0.6, paraphrase: float = 0.5) -> float:
    """The least part of an item of `size` words that the check accepts as a common subsequence."""
    return min(share, paraphrase) if answer and size >= 12 else max(share, min(size, 8) / max(1, size))


def least_cosine(size: int, part: float) -> float:
    """Plain cosine of a segment of `size` words with its best passage where `part` of the words are kept, over all positions."""
    laid = lambda r, a: max(0, min(r + size, a + WIDTH) - max(r, a))
    covered = min(max(laid(r, a) for a in range(0, r + size, STEP)) for r in range(STEP))
    return part * covered / float(np.sqrt(size * WIDTH))


def leaks(docs: DataFrame, benchmark: DataFrame, cosine: float | None = None, share: float = 0.6, paraphrase: float = 0.5, fit_words: int = 8_000_000, block: int = 4096) -> DataFrame:
    """docs(doc_id, text), benchmark(item_id, text) -> doc_id, item_id, cosine, lcs_words, item_words, answer_found, first_word, last_word, kind.

    A given cosine holds for all segments instead of their own least_cosine.
    """
    spark = docs.sparkSession
    kind, item_kind = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    items = benchmark.select("item_id", "text").filter("text is not null")
    listed_words = materialize(feature_rows(docs), "lsa-documents")
    df, rows, n_words = document_frequencies(listed_words)
    idf = np.log((1 + rows) / (1 + df)).astype(np.float32)
    idf[idf < 0.7] = 0  # words of half of all documents say nothing
    space = latent_space(listed_words.coalesce(max(3, -(-n_words // fit_words))), materialize(feature_rows(items), "lsa-items"), idf)
    shared, directions = spark.sparkContext.broadcast((space, idf)), space.shape[1]
    del space

    def segments(batches):
        import pyarrow as pa

        scaled = _scaled(shared)
        for table in text_batches(batches, 1_000_000):
            hashes, first, place, owner = passages(table.column("text"), SEGMENT, SEGMENT)
            texts, ids = table.column("text").to_pylist(), table.column("item_id").to_pylist()
            if not len(place):
                continue
            vectors = _unit_rows(_projected(_feature(hashes), place, first[owner + 1], scaled, SEGMENT))
            answers, _, at = word_hashes(*joined_bytes([_answer(t) for t in texts]))
            keep = [(i, o) for i, (a, o) in enumerate(zip(place, owner, strict=True)) if min(a + SEGMENT, first[o + 1]) - a >= min(8, first[o + 1] - first[o])]
            yield pa.table([pa.array([ids[o] for _, o in keep]).cast(table.schema.field("item_id").type), pa.array([vectors[i].tobytes() for i, _ in keep], pa.binary()), pa.array([hashes[first[o] : first[o + 1]].tobytes() for _, o in keep], pa.binary()), pa.array([answers[at[o] : at[o + 1]].tobytes() for _, o in keep], pa.binary()), pa.array([min(SEGMENT, int(first[o + 1] - place[i])) for i, o in keep], pa.int32())], names=["item_id", "vector", "words", "answer", "size"]).to_batches()[0]

    listed = materialize(items.mapInArrow(segments, f"item_id {item_kind}, vector binary, words binary, answer binary, size int"), "lsa-segments")
    parts = max(1, -(-listed.count() // block))
    blocks = []
    for part in range(parts):  # at most about block segments each
        got = listed.filter(F.pmod(F.xxhash64("item_id", "vector"), F.lit(parts)) == part).toArrow()
        matrix = np.frombuffer(b"".join(got.column("vector").to_pylist()), np.float32).reshape(-1, directions)
        unpack = lambda c: [np.frombuffer(x, np.uint64).tolist() for x in got.column(c).to_pylist()]  # noqa: E731, B023
        words, answers = unpack("words"), unpack("answer")
        parts_kept = [least_share(len(w), bool(a), share, paraphrase) for w, a in zip(words, answers, strict=True)]
        spread = 1 / np.sqrt(directions)  # of cosines in so many directions
        limits = [least_cosine(n, part) - spread if cosine is None else cosine for n, part in zip(got.column("size").to_pylist(), parts_kept, strict=True)]
        needed = [part * len(w) for part, w in zip(parts_kept, words, strict=True)]
        blocks.append(spark.sparkContext.broadcast((got.column("item_id").to_pylist(), matrix, words, answers, np.array(limits, np.float32), np.array(needed))))

    def search(batches):
        import pyarrow as pa

        scaled = _scaled(shared)
        places: dict = {}
        marks: dict = {}

        def loaded(number, b):
            got = b.value
            if number not in marks:
                marks[number] = _marks(got[2])
            mine = marks[number]
            if len(blocks) > 2 and hasattr(b, "_value"):  # one block is held at a time, and read again for the next batch
                del b._value
                marks.clear()
                places.clear()
            return (*got, mine)

        for table in text_batches(batches, 4_000_000):
            hashes, first, place, owner = passages(table.column("text"), WIDTH, STEP)
            found: dict = {}
            if len(place):
                sums = _projected(_feature(hashes), place, first[owner + 1], scaled, STEP)
                ends_text = np.flatnonzero(owner[1:] != owner[:-1])
                alone = sums[ends_text]
                sums[:-1] += sums[1:]
                sums[ends_text] = alone  # the last step of a text has no next one
                vectors = _unit_rows(sums)
                for number, b in enumerate(blocks):
                    ids, matrix, words, answers, limits, needed, mark = loaded(number, b)
                    p, s = _near(vectors, matrix, limits)
                    order = np.argsort(owner[p] * len(ids) + s, kind="stable")  # by text, segment and passage
                    p, s = p[order], s[order]
                    # runs of near passages of one text and segment
                    size = np.array([len(x) for x in words], np.int64)
                    new = np.ones(len(p), bool)
                    new[1:] = (owner[p[1:]] != owner[p[:-1]]) | (s[1:] != s[:-1]) | (place[p[1:]] - place[p[:-1]] > size[s[1:]] + WIDTH)
                    cut = np.flatnonzero(new)
                    last = np.append(cut[1:], len(p))[: len(cut)] - 1
                    ks, os = s[cut], owner[p[cut]]
                    starts = np.maximum(first[os], place[p[cut]] - size[ks])
                    ends = np.minimum(first[os + 1], place[p[last]] + WIDTH + size[ks])
                    able = np.flatnonzero(_may_hold(hashes, first, place, os, starts, ends, ks, size, needed, mark))
                    able = able[_able(hashes, starts[able], ends[able], ks[able], size, needed, mark)]
                    for k, o, x, y, a, z in zip(*(v[able].tolist() for v in (ks, os, cut, last, starts, ends)), strict=True):
                        n, low = int(size[k]), int(first[o])
                        region = hashes[a:z].tolist()
                        if (number, k) not in places:
                            places[number, k] = _places(words[k]), _places(answers[k])
                        own, answer = places[number, k]
                        if sum(map(set(region).__contains__, words[k])) < needed[k]:
                            continue  # no common subsequence is long enough
                        lcs, there = _best_region(own, n, region, needed[k])
                        if lcs < min(share, paraphrase) * n:
                            continue
                        has = bool(answers[k]) and common_subsequence(answer, len(answers[k]), region) >= 0.8 * len(answers[k])
                        what = "copy" if lcs >= max(share * n, min(n, 8)) else "paraphrase" if has and n >= 12 and lcs >= paraphrase * n else None
                        if what:
                            near = float((vectors[p[x : y + 1]] @ matrix[k]).max())
                            row = (lcs, near, n, has, a - low + there[0], a - low + there[1], what)
                            found[o, ids[k]] = max(found.get((o, ids[k]), row), row)
            docs_ids = table.column("doc_id").to_pylist()
            out = [(docs_ids[o], i, r[1], r[0], r[2], r[3], r[4], r[5], r[6]) for (o, i), r in found.items()]
            names = ["doc_id", "item_id", "cosine", "lcs_words", "item_words", "answer_found", "first_word", "last_word", "kind"]
            types = [table.schema.field("doc_id").type, None, pa.float64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string()]
            types[1] = pa.int64() if item_kind in ("bigint", "long") else pa.int32() if item_kind == "int" else pa.string()
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 9, types, strict=True)], names=names)
        del scaled
        places.clear()
        marks.clear()
        trim_worker()

    return docs.select("doc_id", "text").mapInArrow(search, f"doc_id {kind}, item_id {item_kind}, cosine double, lcs_words long, item_words long, answer_found boolean, first_word long, last_word long, kind string")


#: Places a segment has for its words, as a power of two: a row of them stays in the cache while a run is looked at.
_MARK_BITS = 12


def _marks(words: list) -> np.ndarray:
    """A row of places for each segment, in which its words are marked; others may be marked by chance."""
    table = np.zeros((len(words), 1 << _MARK_BITS), bool)
    for k, w in enumerate(words):
        table[k, _mark(np.array(w, np.uint64))] = True
    return table.reshape(-1)


def _mark(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - _MARK_BITS)).astype(np.int32)


def _may_hold(hashes, first, place, os, starts, ends, ks, size, needed, marks, part: int = 1 << 21) -> np.ndarray:
    """Runs that _able may find: counts of marked words of whole steps (place) of all segments at once, summed over the steps that a window can touch, are no smaller than its own."""
    out = np.ones(len(ks), bool)
    many = len(size)
    if not len(ks) or int((ends - starts).sum()) * 256 < len(hashes) * many:  # dearer than to look at the runs' words
        return out
    table = np.zeros(((1 << _MARK_BITS) + 1, many), np.uint8)
    table[:-1] = marks.reshape(many, -1).T
    short = _mark(hashes)
    stop = np.append(place[1:], len(hashes))
    base = np.searchsorted(place, first)  # the first step of each text, and the end
    low = base[os] + (starts - first[os]) // STEP
    high = base[os] + (ends - 1 - first[os]) // STEP + 1
    i = 0
    while i < len(ks):  # runs come by text; texts of so many steps that the counts stay in the cache
        a = base[os[i]]
        text = max(int(os[i]) + 1, int(np.searchsorted(base, a + part // many, "right")) - 1)
        j, z = int(np.searchsorted(os, text)), base[min(text, len(base) - 1)]
        if (z - a) * many <= 32 * part:  # else a very long text, whose runs are all looked at
            counts = np.empty((z - a, many), np.uint8)
            for b in range(a, z, 128):
                at = place[b : min(b + 128, z), None] + np.arange(STEP)
                rows = np.where(at < stop[b : min(b + 128, z), None], short.take(at, mode="clip"), 1 << _MARK_BITS)
                x = table.take(rows.reshape(-1), axis=0).reshape(-1, STEP, many)
                while x.shape[1] > 1:  # halves together, so that long rows are added
                    x = x[:, : x.shape[1] // 2] + x[:, x.shape[1] // 2 :]
                counts[b - a : b - a + len(rows)] = x[:, 0]
            n = (high - low)[i:j]
            begin = np.cumsum(n) - n
            at = np.arange(int(n.sum())) + np.repeat(low[i:j] - a - begin, n)
            sums = np.concatenate(([0], np.cumsum(counts.reshape(-1).take(at * many + np.repeat(ks[i:j], n)), dtype=np.int64)))
            m = size[ks[i:j]]
            touched = (np.maximum(12, m + m // 2) + STEP - 2) // STEP + 1
            windows = np.maximum(1, n - touched + 1)
            run = np.repeat(np.arange(j - i), windows)
            at = np.arange(len(run)) - np.repeat(np.cumsum(windows) - windows, windows)
            most = sums[begin[run] + np.minimum(at + touched[run], n[run])] - sums[begin[run] + at]
            out[i:j] = np.maximum.reduceat(most, np.cumsum(windows) - windows) >= needed[ks[i:j]]
        i = j
    return out


def _able(hashes, starts, ends, ks, size, needed, marks, part: int = 200_000) -> np.ndarray:
    """Runs in which some window of _best_region has as many marked words as the common subsequence needs."""
    out = np.zeros(len(ks), bool)
    short = _mark(hashes)
    long = np.cumsum(ends - starts)
    i = 0
    while i < len(ks):  # so many words at a time that they stay in the cache
        j = max(i + 1, int(np.searchsorted(long, (long[i - 1] if i else 0) + part, "right")))
        n = (ends - starts)[i:j]
        base = np.cumsum(n) - n
        at = np.arange(int(n.sum()), dtype=np.int32) + np.repeat((starts[i:j] - base).astype(np.int32), n)
        marked = marks.take(short.take(at) + np.repeat((ks[i:j] << _MARK_BITS).astype(np.int32), n))
        sums = np.zeros(len(marked) + 1, np.int32)
        np.cumsum(marked, out=sums[1:])
        m = size[ks[i:j]]
        width, step = np.maximum(12, m + m // 2), np.maximum(1, m // 4)
        count = np.maximum(1, -(-(n - width + step) // step))
        run = np.repeat(np.arange(j - i), count)
        a = (np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)) * step[run]
        most = sums[base[run] + np.minimum(a + width[run], n[run])] - sums[base[run] + np.minimum(a, n[run])]
        out[i:j] = np.maximum.reduceat(most, np.cumsum(count) - count) >= needed[ks[i:j]]
        i = j
    return out


def _best_region(item: dict, size: int, region: list, needed: float) -> tuple[int, tuple[int, int]]:
    """LCS with the stretch of the region that is about as long as the item and has most of it; 0 where none reaches needed."""
    width = max(12, size + size // 2)
    step = max(1, size // 4)
    own = np.concatenate(([0], np.cumsum(np.fromiter(map(item.__contains__, region), np.int64, len(region)))))
    starts = np.arange(0, max(1, len(region) - width + step), step)
    most = own[np.minimum(starts + width, len(region))] - own[np.minimum(starts, len(region))]  # no subsequence is longer
    best = (0, 0)
    for a in starts[most >= needed].tolist():
        if own[min(a + width, len(region))] - own[a] > best[0]:
            n = common_subsequence(item, size, region[a : a + width])
            best = max(best, (n, -a))
    return best[0], (-best[1], min(len(region), -best[1] + width))


def op8_latent_leaks(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def stage_decontaminate(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    keyed = packed(docs).withColumn("_th", F.xxhash64("doc_id", "text"))
    found = leaks(keyed.select(F.col("_th").alias("doc_id"), "text"), benchmark)
    bad = materialize(found.select("doc_id").distinct(), "leaking")
    return unpacked(keyed.join(bad.withColumnRenamed("doc_id", "_th"), "_th", "left_anti"), docs.columns)
