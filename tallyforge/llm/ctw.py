"""Scoring texts by context-tree weighting over bytes.

The byte values seen in training and one symbol for all others are decomposed into binary decisions; every decision has a context tree over the previous bytes. A node
holds a Krichevsky-Trofimov estimate of its zeros and ones. The weighted probability of a node is the mean of its own
estimate and the product of its children's, so all depths are mixed, with one weight a node: the share of its own
estimate in its weighted probability. A child context is split off where it was seen at least min_count times; the
other continuations of a context share one leaf. So the tree grows with the corpus, and every training byte is in exactly
one leaf.

Texts are lower-cased (A-Z) and end with byte 0xFF, which UTF-8 doesn't use and which also fills the context before the
first byte. Training counts (context, next byte) over all training texts: packed counts per task and bucket of contexts
that agree in the last two bytes, summed per bucket, so each subtree from depth two down is worked out in one task; the
levels above are bounded arrays. For scoring, each context becomes a row of log10 P(byte | context). Rows are held in
blocks of at most block_contexts, each a broadcast of its own that a task loads in turn; names of contexts are at hand.

Word counts for the base score are packed per task and bucket of 64-bit word fingerprints, summed per bucket, and kept
in blocks of ascending ranges of at most about block_words words that scoring loads in turn like the tree's; no more than one
block is in a worker's memory. Texts are never shuffled.

Nulls and empty texts: one end token and one end byte. Repeated rows are scored each. With no training text every
estimate is one half and the base score 0 known words. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, free_shuffles, joined_bytes, materialize, text_batches, trim_worker, word_hashes

END = 255
DEPTH = 5
MIN_COUNT = 2
CONTEXT_BUCKETS = 64
BLOCK_CONTEXTS = 32_768
BLOCK_WORDS = 1_000_000
#: Training bytes a bucket of word counts is made for.
BUCKET_BYTES = 64_000_000
#: Bytes of text scored with one pass over the blocks, and positions worked on at a time.
SCORED_BYTES, PART = 4_000_000, 1 << 16


def _stream(texts) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased texts, each after three and before one end byte, and the offsets of their first bytes."""
    pad = b"\xff" * DEPTH
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts.to_pylist()]
    data = np.frombuffer(b"".join(pad + p + b"\xff" for p in parts), np.uint8)
    sizes = np.fromiter((len(p) + DEPTH + 1 for p in parts), np.int64, len(parts))
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum(sizes, out=starts[1:])
    return _LOWER[data], starts


def _grams(data: np.ndarray) -> np.ndarray:
    """For each position from DEPTH on: its context, latest byte first from the top, and the byte itself lowest (uint64)."""
    n = len(data) - DEPTH
    out = data[DEPTH:].astype(np.uint64)
    for k in range(1, DEPTH + 1):
        out |= data[DEPTH - k : DEPTH - k + n].astype(np.uint64) << np.uint64(64 - 8 * k)
    return out


def _positions(starts: np.ndarray) -> np.ndarray:
    """Mask of the grams that predict a byte of a text or its end, not the padding of the next."""
    mask = np.ones(int(starts[-1]) - DEPTH, bool)
    for j in range(DEPTH):
        mask[starts[1:-1] + j - DEPTH] = False
    return mask


def _bucket_of(grams: np.ndarray, buckets: int) -> np.ndarray:
    return (((grams >> np.uint64(48)) * np.uint64(0x9E3779B1)) >> np.uint64(7)) % np.uint64(buckets)


def _packed(keys: np.ndarray, counts: np.ndarray, bucket: np.ndarray, buckets: int):
    """One row a bucket: (bucket, keys, counts), both packed."""
    import pyarrow as pa

    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
    keys, counts = keys[order], counts[order]
    pick = [i for i in range(buckets) if cut[i] < cut[i + 1]]
    return pa.table([pa.array(pick, pa.int32()), pa.array([keys[cut[i] : cut[i + 1]].tobytes() for i in pick], pa.binary()), pa.array([counts[cut[i] : cut[i + 1]].tobytes() for i in pick], pa.binary())], names=["bucket", "keys", "counts"]).to_batches()


def _counted(train: DataFrame, keys_of, bucket_of, buckets: int) -> DataFrame:
    """(bucket, keys, counts, v, n): sums over all texts of the uint64 keys that keys_of gives for a batch of texts."""

    def work(batches):
        held, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for table in text_batches(batches, 2_000_000):
            w, n = np.unique(keys_of(table.column("text")), return_counts=True)
            held.append(w)
            counts.append(n)
            if sum(map(len, held)) > 2_000_000:  # sums what is held, and hands it on where it is large by itself
                w, n = _summed(held, counts)
                held, counts = [w], [n]
                if len(w) > 1_200_000:
                    yield from _packed(w, n, bucket_of(w, buckets), buckets)
                    held, counts = [w[:0]], [n[:0]]
        w, n = _summed(held, counts)
        yield from _packed(w, n, bucket_of(w, buckets), buckets)
        del held, counts, w, n
        trim_worker()

    def total(key, table):
        import pyarrow as pa

        w, n = _summed([np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()], [np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist()])
        return pa.table([pa.array([key[0].as_py()], pa.int32()), [w.tobytes()], [n.tobytes()], [len(w)], [int(n.sum())]], names=["bucket", "keys", "counts", "v", "n"])

    parts = train.select("text").mapInArrow(work, "bucket int, keys binary, counts binary")
    return parts.groupBy("bucket").applyInArrow(total, "bucket int, keys binary, counts binary, v long, n long")


def gram_counts(train: DataFrame, buckets: int = CONTEXT_BUCKETS) -> DataFrame:
    """Packed counts of (context, next byte) over all texts, by bucket of the last two context bytes."""

    def keys(texts):
        data, starts = _stream(texts)
        return _grams(data)[_positions(starts)]

    return _counted(train, keys, _bucket_of, buckets)


def _summed(grams: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
    g, n = np.concatenate(grams), np.concatenate(counts)
    order = np.argsort(g, kind="stable")
    g, n = g[order], n[order]
    if not len(g):
        return g, n
    new = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
    return g[new], np.add.reduceat(n, new)


def _codes(symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol the tree node at each of its binary decisions, and the decisions."""
    bits = symbols.bit_length() - 1
    node = np.array([[(1 << i) | (x >> (bits - i)) for i in range(bits)] for x in range(symbols)])
    return node, np.array([[(x >> (bits - 1 - i)) & 1 for i in range(bits)] for x in range(symbols)])


def bit_counts(hist: np.ndarray) -> np.ndarray:
    """(..., S) symbol counts, S a power of two -> (..., S, 2): zeros and ones of each binary node (index 0 unused)."""
    out = np.zeros((*hist.shape, 2))
    level = hist
    for i in range(hist.shape[-1].bit_length() - 2, -1, -1):
        pairs = level.reshape(*hist.shape[:-1], 1 << i, 2)
        out[..., 1 << i : 2 << i, :] = pairs
        level = pairs.sum(-1)
    return out


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov block probability."""
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - _lgamma(zeros + ones + 1) - np.log(np.pi)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """ln gamma for x >= 0.5 by Stirling's series after shifting the argument above 7."""
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(7):
        small = y < 7
        shift[small] += np.log(y[small])
        y[small] += 1
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y - shift


def _log10(p_one: np.ndarray) -> np.ndarray:
    """(..., S) P(one) of binary nodes -> (..., S) log10 P(symbol)."""
    node, bit = _codes(p_one.shape[-1])
    one, zero = np.log10(p_one), np.log10(1 - p_one)
    out = np.zeros(p_one.shape)
    for i in range(node.shape[1]):
        out += np.where(bit[:, i] == 1, one[..., node[:, i]], zero[..., node[:, i]])
    return out


class Alphabet:
    """Symbols: the byte values seen in training, ascending, and one for all others, which share its probability."""

    def __init__(self, seen: np.ndarray):
        self.bytes = np.flatnonzero(seen)
        self.width = len(self.bytes) + (len(self.bytes) < 256)
        self.size = max(2, 1 << (self.width - 1).bit_length())  # a power of two for the binary decisions
        self.of = np.full(256, len(self.bytes) if len(self.bytes) < 256 else 0)
        self.of[self.bytes] = np.arange(len(self.bytes))

    def rows(self, p_one: np.ndarray) -> np.ndarray:
        """float32 log10 P of a byte by its symbol."""
        out = _log10(p_one)[..., : self.width]
        if len(self.bytes) < 256:
            out[..., -1] -= np.log10(256 - len(self.bytes))
        return out.astype(np.float32)


def _kt_of(counts: np.ndarray) -> np.ndarray:
    """ln KT of binary nodes (..., 256, 2); 0 where nothing was counted."""
    zeros, ones = counts[..., 0], counts[..., 1]
    out = np.zeros(zeros.shape)
    seen = zeros + ones > 0
    out[seen] = _log_kt(zeros[seen], ones[seen])
    return out


def _estimate(counts: np.ndarray) -> np.ndarray:
    """KT estimate of a one at each node."""
    return (counts[..., 1] + 0.5) / (counts.sum(-1) + 1)


def _by_parts(f, x: np.ndarray, part: int = 2048) -> np.ndarray:
    return np.concatenate([f(x[i : i + part]) for i in range(0, len(x), part)]) if len(x) else x.astype(float)


def _kt_rows(hist: np.ndarray) -> np.ndarray:
    return _by_parts(lambda h: _kt_of(bit_counts(h)), hist)


class _Level:
    """The contexts of one depth that are split off: names (top bytes), place of the parent, byte counts, counts of the shared leaf."""

    def __init__(self, names, parent, hist):
        self.names, self.parent, self.hist, self.rest = names, parent, hist, hist.copy()
        self.below, self.inner = np.zeros(hist.shape), np.zeros(len(hist), bool)

    def weigh(self, child: "_Level | None", child_ln: np.ndarray | None) -> np.ndarray:
        """ln weighted probability of each node; sets the weights."""
        if child is not None and len(child.names):
            np.add.at(self.below, child.parent, child_ln)
            np.subtract.at(self.rest, child.parent, child.hist)
            self.inner[child.parent] = True
        own = _kt_rows(self.hist)
        both = np.where(self.inner[:, None], np.logaddexp(own, self.below + _kt_rows(self.rest)) - np.log(2), own)
        self.weight = np.where(self.inner[:, None], np.exp(own - both - np.log(2)), 1.0)
        return both


def _levels(keys: np.ndarray, counts: np.ndarray, least: float, alphabet: Alphabet) -> list[_Level]:
    """Depth 2 to DEPTH of the contexts of a bucket (keys ascending) that hold at least `least` bytes."""
    out: list[_Level] = []
    symbol = alphabet.of[(keys & np.uint64(255)).astype(np.int64)]
    for k in range(2, DEPTH + 1):
        prefix = keys >> np.uint64(64 - 8 * k)
        start = np.flatnonzero(np.concatenate(([True], prefix[1:] != prefix[:-1]))) if len(keys) else np.zeros(0, np.int64)
        names, total = prefix[start], np.add.reduceat(counts, start) if len(start) else counts
        keep = total >= least
        if out:
            above = names >> np.uint64(8)
            place = np.searchsorted(out[-1].names, above)
            inside = place < len(out[-1].names)
            inside[inside] = out[-1].names[place[inside]] == above[inside]
            keep &= inside
        names = names[keep]
        parent = place[keep] if out else np.zeros(len(names), np.int64)
        hist = np.zeros((len(names), alphabet.size))
        if len(names):
            at = np.minimum(np.searchsorted(names, prefix), len(names) - 1)
            here = names[at] == prefix
            np.add.at(hist, (at[here], symbol[here]), counts[here])
        out.append(_Level(names, parent, hist))
    return out


def _bottom_up(levels: list[_Level]) -> np.ndarray:
    child = ln = None
    for level in reversed(levels):
        ln = level.weigh(child, ln)
        child = level
    return ln


def _unpack(table) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(table.column("keys")[0].as_py(), np.uint64), np.frombuffer(table.column("counts")[0].as_py(), np.int64)


class ContextTree:
    """The tree of all training counts: lower levels distributed, depth 0 and 1 as arrays here."""

    def __init__(self, grams: DataFrame, min_count: int = MIN_COUNT):
        self.grams = materialize(grams, "ctw-grams")
        self.least = least = min_count

        def used(key, table):
            import pyarrow as pa

            keys, counts = _unpack(table)
            return pa.table([[np.bincount((keys & np.uint64(255)).astype(np.int64), counts, 256).tobytes()]], names=["seen"])

        # one row of 256 numbers for each of the fixed number of buckets
        parts = self.grams.groupBy("bucket").applyInArrow(used, "seen binary").collect()
        self.alphabet = alphabet = Alphabet(sum((np.frombuffer(r["seen"]) for r in parts), np.zeros(256)))
        size = alphabet.size

        def subtree(key, table):
            import pyarrow as pa

            keys, counts = _unpack(table)
            levels = _levels(keys, counts, least, alphabet)
            ln = _bottom_up(levels)
            one = (levels[0].names >> np.uint64(8)).astype(np.int64)
            below, split, everything = (np.zeros((256, size)) for _ in range(3))
            np.add.at(below, one, ln)
            np.add.at(split, one, levels[0].hist)
            np.add.at(everything, ((keys >> np.uint64(56)).astype(np.int64), alphabet.of[(keys & np.uint64(255)).astype(np.int64)]), counts)
            return pa.table([[below.tobytes()], [split.tobytes()], [everything.tobytes()]], names=["below", "split", "everything"])

        # one row of three arrays of at most 256 x 256 for each of the fixed number of buckets
        parts = self.grams.groupBy("bucket").applyInArrow(subtree, "below binary, split binary, everything binary")
        below, split, everything = (np.zeros((256, size)) for _ in range(3))
        for r in parts.toLocalIterator():
            for into, x in zip((below, split, everything), (r["below"], r["split"], r["everything"]), strict=True):
                into += np.frombuffer(x).reshape(256, size)
        keep = np.flatnonzero(everything.sum(1) >= least)
        one = _Level(keep, np.zeros(len(keep), np.int64), everything[keep])
        one.below, one.rest, one.inner = below[keep], everything[keep] - split[keep], split[keep].sum(1) > 0
        zero = _Level(np.zeros(1, np.int64), np.zeros(1, np.int64), everything.sum(0)[None])
        zero.weigh(one, one.weigh(None, None))
        # what depth 0 and 1 give to every deeper estimate: P = a + b * deeper
        a0 = zero.weight[0] * _estimate(bit_counts(zero.hist[0]))
        b0 = 1 - zero.weight[0]
        self.root = alphabet.rows(a0 + b0 * _estimate(bit_counts(zero.rest[0])))
        self.ones = keep
        a1 = a0 + b0 * one.weight * _by_parts(lambda h: _estimate(bit_counts(h)), one.hist)
        b1 = b0 * (1 - one.weight)
        self.one_rows = alphabet.rows(a1 + b1 * _by_parts(lambda h: _estimate(bit_counts(h)), one.rest))
        self.a, self.b = np.tile(a0, (256, 1)), np.tile(b0, (256, 1))
        self.a[keep], self.b[keep] = a1, b1

    def rows(self) -> DataFrame:
        """(bucket, depth, name, row) of the contexts of depth two and more."""
        least, a1, b1, alphabet = self.least, self.a, self.b, self.alphabet

        def work(key, table):
            import pyarrow as pa

            levels = _levels(*_unpack(table), least, alphabet)
            _bottom_up(levels)
            depth, names, rows = [], [], []
            a = b = None
            for k, level in enumerate(levels, 2):
                if k == 2:
                    one = (level.names >> np.uint64(8)).astype(np.int64)
                    a, b = a1[one], b1[one]
                else:
                    a, b = a[level.parent], b[level.parent]
                a = a + b * level.weight * _by_parts(lambda h: _estimate(bit_counts(h)), level.hist)
                b = b * (1 - level.weight)
                p = a + b * _by_parts(lambda h: _estimate(bit_counts(h)), level.rest)
                depth += [k] * len(p)
                names.append(level.names.astype(np.int64))
                rows += [x.tobytes() for i in range(0, len(p), 2048) for x in alphabet.rows(p[i : i + 2048])]
            return pa.table([pa.array([key[0].as_py()] * len(depth), pa.int32()), pa.array(depth, pa.int32()), pa.array(np.concatenate(names), pa.int64()), pa.array(rows, pa.binary())], names=["bucket", "depth", "name", "row"])

        return self.grams.groupBy("bucket").applyInArrow(work, "bucket int, depth int, name long, row binary")

    def blocks(self, block_contexts: int = BLOCK_CONTEXTS):
        """(depths, names, float32 rows) of at most about block_contexts contexts at a time; the root and depth one first."""
        yield np.array([0] + [1] * len(self.ones)), np.concatenate(([0], self.ones)), np.concatenate((self.root[None], self.one_rows))
        table = materialize(self.rows(), "ctw-rows")
        sizes = table.groupBy("bucket").count().orderBy("bucket").collect()  # one row for each of the fixed number of buckets
        group, held = [], 0
        for r in [*sizes, None]:
            if group and (r is None or held + r["count"] > block_contexts):
                got = table.filter(F.col("bucket").isin(group)).select("depth", "name", "row").toArrow()
                yield got.column("depth").to_numpy(), got.column("name").to_numpy(), np.frombuffer(b"".join(got.column("row").to_pylist()), np.float32).reshape(-1, self.alphabet.width)
                group, held = [], 0
            if r is not None:
                group.append(r["bucket"])
                held += r["count"]


class _Finder:
    """Place of the deepest context of each gram: an array over symbols for three bytes, an open hash table for the deeper ones."""

    def __init__(self, depths: np.ndarray, names: np.ndarray, alphabet: Alphabet):
        place = np.arange(len(names), dtype=np.int32)
        # a context holds bytes seen in training only; all others share a symbol that is in no context
        self.of, w = alphabet.of.astype(np.int32), alphabet.width
        self.width = w
        three = np.zeros((w, w, w), np.int32)  # latest byte first
        for k in (1, 2, 3):
            at = depths == k
            x = names[at].astype(np.int64)
            symbols = tuple(self.of[(x >> (8 * (k - 1 - i))) & 255] for i in range(k))
            three[symbols] = place[at].reshape(-1, *[1] * (3 - k))
        self.three = three.reshape(-1)
        deep = depths > 3
        keys = (names[deep].astype(np.uint64) << np.uint64(3)) | depths[deep].astype(np.uint64)
        self.bits = max(4, int(np.ceil(np.log2(len(keys) * 2 + 1))))
        self.keys, self.places = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        at, value, slot = keys, place[deep], self._slot(keys)
        while len(at):  # all keys at once; those that lose their slot try the next
            free = self.keys[slot] == 0
            self.keys[slot[free]] = at[free]
            mine = self.keys[slot] == at
            self.places[slot[mine]] = value[mine]
            at, value, slot = at[~mine], value[~mine], (slot[~mine] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        byte = lambda i: self.of[((grams >> np.uint64(56 - 8 * i)) & np.uint64(255)).astype(np.int64)]
        out = self.three[(byte(0) * self.width + byte(1)) * self.width + byte(2)]
        live = None
        for k in range(4, DEPTH + 1):
            g = grams if live is None else grams[live]
            keys = ((g >> np.uint64(64 - 8 * k)) << np.uint64(3)) | np.uint64(k)
            slot = self._slot(keys)
            found = self.keys[slot]
            hit, go = found == keys, (found != keys) & (found != 0)
            where = np.flatnonzero(go)
            while len(where):
                slot[where] = (slot[where] + 1) & ((1 << self.bits) - 1)
                found = self.keys[slot[where]]
                hit[where] = found == keys[where]
                where = where[(found != keys[where]) & (found != 0)]
            hits = np.flatnonzero(hit)
            live = hits if live is None else live[hits]
            out[live] = self.places[slot[hits]]
        return out

    def of_bytes(self, data: np.ndarray) -> np.ndarray:
        """The same for all positions of bytes from DEPTH on, some at a time."""
        n = len(data) - DEPTH
        out = np.empty(n, np.int32)
        for a in range(0, n, PART):
            out[a : a + PART] = self(_grams(data[a : a + PART + DEPTH]))
        return out


def _scores(at: np.ndarray, symbol: np.ndarray, firsts: list, blocks, width: int) -> np.ndarray:
    """log10 P of the symbols after the contexts at these places (float32); blocks come one after another."""
    out = np.empty(len(at), np.float32)
    for first, stop in zip(firsts, firsts[1:], strict=False):
        rows = None  # gone before the next is read
        rows = next(blocks)
        for a in range(0, len(at), PART):
            x = at[a : a + PART]
            here = np.flatnonzero((x >= first) & (x < stop))
            out[a + here] = rows[(x[here].astype(np.int64) - first) * width + symbol[a + here]]
    return out


def _counts_of(words: np.ndarray, blocks) -> np.ndarray:
    """Counts of ascending fingerprints; blocks (fingerprints, counts) come one after another, in ascending ranges."""
    out, a = np.zeros(len(words)), 0
    for keys, counts in blocks:
        if len(keys):
            b = int(np.searchsorted(words, keys[-1], side="right"))
            place = np.searchsorted(keys, words[a:b])
            hit = keys[place] == words[a:b]
            out[a:b][hit] = counts[place[hit]]
            a = b
        keys = counts = None  # gone before the next is read
    return out


def _in_turn(shared: list):
    """The values of broadcasts, one after another; none stays in memory, but one that is alone."""
    for b in shared:
        try:
            yield b.value
        finally:
            if len(shared) > 1 and hasattr(b, "_value"):  # read again for the next batch
                del b._value


def word_counts(train: DataFrame, buckets: int) -> DataFrame:
    """Packed counts of the 64-bit fingerprints of all training words, by range of the fingerprint."""

    def bucket(words, n):
        return np.searchsorted(_edges(n)[1:-1], words, side="right").astype(np.uint64)

    return _counted(train, lambda texts: word_hashes(*joined_bytes(texts))[0], bucket, buckets)


def _edges(buckets: int) -> list:
    """Bounds of the buckets: equal ranges of the 64-bit fingerprints."""
    return np.array([min(2**64 - 1, (i << 64) // buckets) for i in range(buckets + 1)], np.uint64)


def score_texts(docs: DataFrame, train: DataFrame, block_contexts: int = BLOCK_CONTEXTS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs(doc_id, held_out, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes."""
    context = docs.sparkSession.sparkContext
    depths, names, firsts, tree_blocks = [], [], [0], []
    tree = ContextTree(gram_counts(train))
    alphabet = tree.alphabet
    free_shuffles(docs.sparkSession)  # and broadcasts of earlier calls
    for d, x, rows in tree.blocks(block_contexts):
        depths.append(d)
        names.append(x)
        firsts.append(firsts[-1] + len(x))
        tree_blocks.append(context.broadcast(rows.reshape(-1)))
    listed = context.broadcast((np.concatenate(depths), np.concatenate(names)))  # nine bytes or so a context; rows come in blocks
    size = train.agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("rows")).first()
    vocabulary = materialize(word_counts(train, max(1, -(-(size["b"] or 0) // BUCKET_BYTES))), "ctw-words")
    sums = vocabulary.select("bucket", "v", "n").orderBy("bucket").collect()  # one small row for each 64 MB of training text
    ends = size["rows"]
    n_all, v_all = sum(r["n"] for r in sums) + ends, sum(r["v"] for r in sums) + (ends > 0)
    word_blocks, group, held = [], [], 0
    for r in [*sums, None]:
        if group and (r is None or held + r["v"] > block_words):
            rows = vocabulary.filter(F.col("bucket").isin(group)).select("bucket", "keys", "counts").toArrow().sort_by("bucket")
            join = lambda c, t: np.frombuffer(b"".join(rows.column(c).to_pylist()), t)  # noqa: E731, B023
            keys, counts = join("keys", np.uint64), join("counts", np.int64)
            for a in range(0, len(keys), block_words):  # a bucket may be larger
                word_blocks.append(context.broadcast((keys[a : a + block_words], counts[a : a + block_words])))
            del rows, keys, counts
            group, held = [], 0
        if r is not None:
            group.append(r["bucket"])
            held += r["v"]
    bottom = np.log10(n_all + 0.1 * (v_all + 1))

    def work(batches):
        import pyarrow as pa

        trim_worker()  # what earlier tasks left
        finder = _Finder(*listed.value, alphabet)
        if hasattr(listed, "_value"):  # the finder has what it needs of it
            del listed._value
        symbols = alphabet.of.astype(np.uint8)
        for table in text_batches(batches, SCORED_BYTES):
            texts = table.column("text")
            data, starts = _stream(texts)
            score = _scores(finder.of_bytes(data), symbols[data[DEPTH:]], firsts, _in_turn(tree_blocks), alphabet.width)
            score[~_positions(starts)] = 0
            by_text, sizes = np.add.reduceat(score, starts[:-1], dtype=np.float64), np.diff(starts) - DEPTH
            del data, score
            hashes, _, first = word_hashes(*joined_bytes(texts))
            names, inverse = np.unique(hashes, return_inverse=True)
            count = _counts_of(names, _in_turn(word_blocks))
            each = np.append(np.log10(count + 0.1)[inverse], 0.0)
            known = np.append((count > 0)[inverse].astype(np.int64), 0)
            n = np.diff(first)
            add = lambda x: np.where(n > 0, np.add.reduceat(x, np.minimum(first[:-1], len(x) - 1)), 0)  # noqa: E731, B023
            base = add(each) + np.log10(ends + 0.1) - bottom * (n + 1)
            cols = [table.column("doc_id").combine_chunks(), table.column("held_out").combine_chunks(), pa.array(n + 1), pa.array(add(known) + (ends > 0)), pa.array(np.full(len(n), n_all)), pa.array(base), pa.array(by_text), pa.array(sizes)]
            yield from pa.table(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_predicted"]).to_batches()
            del hashes, names, inverse, count, each, known, base, by_text, cols
            trim_worker()

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "held_out", "text").mapInArrow(work, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_predicted long")


def op2_context_tree(spark, sf_dir: str) -> DataFrame:
    ids = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(0))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", (F.pmod(ids, F.lit(10)) == 0).alias("held_out"))
    scored = score_texts(docs, docs.filter("not held_out"))
    return scored.withColumn("bits_per_byte", -F.col("score") / F.log10(F.lit(2.0)) / F.col("n_predicted"))
