"""Removal of repeated byte strings by a logarithmic family of sparse suffix indexes.

Every 100-byte window has one anchor: the leftmost smallest of its 32-byte gram hashes. Equal windows have equal
anchors at equal distance, so only suffixes at anchors (about one byte in 35) are indexed. An entry stands for the run
of consecutive windows with one anchor; its rank is a fingerprint of all bytes of the run. A batch of entries is sorted
(its sparse suffix array), merge-scanned against the sorted levels that exist - whichever of two equal entries starts
later has all its windows repeated and leaves the index - and added as a level; levels of equal size merge, so there
are logarithmically many. Families run twice: per task, and per bucket of anchors over the tasks' surviving entries,
so that a passage copied a million times leaves one entry a task.

Where an anchor survives with different runs, matches may begin or end inside a run. A window reaches at least 34 bytes
beyond its anchor on one side, so only runs that share those 66 bytes with another run can share a window; each entry
carries a fingerprint of either side for that. The windows of such runs alone are compared one by one, by window
fingerprints, in the same way: first per chunk of documents, then per bucket.

Strings are judged on the input. Order of starts is (doc_id, text hash where ids repeat, byte); a null doc_id comes
first, and rows that repeat in full are one document (ties have no order). Ids must be integers. Null and empty texts have no bytes. Very long
texts are a batch and a chunk of their own. Runs are told apart by 64 bits of all their bytes and 32 of their anchor's, and where a
side is complete 32 more; windows by 64 bits and 32 of their first half. Columns other than doc_id and text aren't read.
Empty tables give empty results.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE64, free_shuffles, materialize, mix64, text_batches

GRAM = 32
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_FIELDS = ("key", "group", "left", "right", "doc", "th", "start", "run")
_TYPES = (np.uint64, np.uint32, np.uint32, np.uint32, np.int64, np.int64, np.int32, np.uint8)
_NO_ID = -(2**63)


class RangeHash:
    """Fingerprints of byte ranges of one array."""

    def __init__(self, data: np.ndarray):
        self.inverse = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(data), _P_INVERSE))))
        powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(max(0, len(data) - 1), _P))))[: len(data)]
        self.sums = np.concatenate(([np.uint64(0)], np.cumsum(BYTE64[data] * powers)))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.inverse[start])


def window_runs(data: np.ndarray, starts: np.ndarray, length: int):
    """Runs of windows with one anchor: (text, first window, last window, anchor place, anchor hash), and the range hash."""
    n, wide = len(data), length - GRAM + 1
    empty = np.zeros(0, np.int64)
    if n < length:
        return empty, empty, empty, empty, np.zeros(0, np.uint64), RangeHash(data)
    d = data.astype(np.uint64)
    p = (d[:-1] << np.uint64(8)) | d[1:]
    p = (p[:-2] << np.uint64(16)) | p[2:]
    p = (p[:-4] << np.uint64(32)) | p[4:]
    m = n - GRAM + 1
    h = p[:m] * _P
    for j in (8, 16, 24):
        h = (h ^ (h >> np.uint64(29))) * _P + p[j : j + m]
    h = mix64(h)
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(m, dtype=np.uint64)
    pad = -m % wide
    rows = np.concatenate((key, np.full(pad, np.uint64(2**64 - 1)))).reshape(-1, wide)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    windows = n - length + 1
    anchor = (np.minimum(back[:windows], ahead[wide - 1 : wide - 1 + windows]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.searchsorted(starts, np.arange(windows), side="right") - 1
    inside = np.arange(windows) + length <= starts[text + 1]
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | (inside[1:] != inside[:-1])))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [windows])) - 1
    good = inside[first]
    first, last = first[good], last[good]
    return text[first], first, last, anchor[first], h[anchor[first]], RangeHash(data)


class Entries:
    """Parallel arrays of index entries."""

    def __init__(self, *columns):
        self.columns = [np.asarray(c, t) for c, t in zip(columns, _TYPES, strict=True)]

    def __getattr__(self, name):
        return self.columns[_FIELDS.index(name)]

    def __len__(self):
        return len(self.columns[0])

    def take(self, index) -> "Entries":
        return Entries(*(c[index] for c in self.columns))

    @staticmethod
    def concat(parts: list["Entries"]) -> "Entries":
        return Entries(*(np.concatenate(c) for c in zip(*(p.columns for p in parts), strict=True))) if parts else Entries(*[[]] * len(_FIELDS))

    def pack(self) -> bytes:
        """The columns, each by bytes of one place in the number after another: high bytes are alike and compress away."""
        planes = (np.ascontiguousarray(c).view(np.uint8).reshape(len(self), -1).T.tobytes() for c in self.columns)
        return np.int64(len(self)).tobytes() + b"".join(planes)

    @staticmethod
    def unpack(data: bytes) -> "Entries":
        n, at, out = int(np.frombuffer(data, np.int64, 1)[0]), 8, []
        for t in _TYPES:
            wide = np.dtype(t).itemsize
            planes = np.frombuffer(data, np.uint8, n * wide, at).reshape(wide, n)
            out.append(np.ascontiguousarray(planes.T).view(t).reshape(n))
            at += n * wide
        return Entries(*out)


def _same_string(a: Entries, b: Entries) -> np.ndarray:
    return (a.key == b.key) & (a.group == b.group) & (a.left == b.left) & (a.right == b.right)


def _same_place(a: Entries, b: Entries) -> np.ndarray:
    return (a.doc == b.doc) & (a.th == b.th) & (a.start == b.start)


def _earlier(a: Entries, b: Entries) -> np.ndarray:
    return (a.doc < b.doc) | ((a.doc == b.doc) & ((a.th < b.th) | ((a.th == b.th) & (a.start < b.start))))


class Family:
    """Sorted levels of distinct entries, the earliest of each; gone: the later ones."""

    def __init__(self):
        self.levels: list[Entries] = []
        self.gone: list[Entries] = []

    def add(self, batch: Entries) -> None:
        if not len(batch):
            return
        batch = batch.take(np.lexsort((batch.start, batch.th, batch.doc, batch.right, batch.left, batch.group, batch.key)))
        new = np.concatenate(([True], ~_same_string(batch.take(slice(1, None)), batch.take(slice(None, -1)))))
        head = batch.take(np.maximum.accumulate(np.where(new, np.arange(len(batch)), 0)))
        self.gone.append(batch.take(~new & ~_same_place(batch, head)))
        batch = batch.take(new)
        for i, level in enumerate(self.levels):
            at = np.minimum(np.searchsorted(level.key, batch.key), len(level) - 1)
            twin = level.take(at)
            equal = _same_string(twin, batch)
            here = equal & _earlier(batch, twin)
            self.gone.append(batch.take(equal & _earlier(twin, batch)))
            if here.any():  # the level's entry starts later: it goes, and the batch's takes its place
                self.gone.append(level.take(at[here]))
                columns = [c.copy() for c in level.columns]
                for c, x in zip(columns, batch.columns, strict=True):
                    c[at[here]] = x[here]
                self.levels[i] = Entries(*columns)
            batch = batch.take(~equal)
        if len(batch):
            self.levels.append(batch)
        while len(self.levels) > 1 and len(self.levels[-1]) * 2 > len(self.levels[-2]):
            both = Entries.concat([self.levels.pop(), self.levels.pop()])
            self.levels.append(both.take(np.argsort(both.key, kind="stable")))

    def survivors(self) -> Entries:
        return Entries.concat(self.levels)

    def removed(self) -> Entries:
        return Entries.concat(self.gone)


def _split(entries: Entries, by: np.ndarray):
    order = np.argsort(by, kind="stable")
    by = by[order]
    cut = np.flatnonzero(np.concatenate(([True], by[1:] != by[:-1]))) if len(by) else []
    for a, b in zip(cut, [*cut[1:], len(by)], strict=False):
        yield int(by[a]), entries.take(order[a:b])


def _rows(pieces, names=("at", "kind", "data")):
    import pyarrow as pa

    a, k, d = [], [], []
    for at, kind, entries in pieces:
        a.append(at)
        k.append(kind)
        d.append(entries.pack())
    return pa.table([pa.array(a, pa.int32()), pa.array(k, pa.int32()), pa.array(d, pa.binary())], names=list(names))


def _bytes_of(table):
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in table.column("text").to_pylist()]
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=starts[1:])
    docs = table.column("doc_id").fill_null(_NO_ID).to_numpy()
    return parts, np.frombuffer(b"".join(parts), np.uint8), starts, docs, table.column("th").to_numpy()


PACKED = "at int, kind int, data binary"
GONE, EDGE = 0, 1


def _shares(side: np.ndarray) -> np.ndarray:
    """Which nonzero values occur more than once."""
    order = np.argsort(side, kind="stable")
    v = side[order]
    same = np.concatenate(([False], (v[1:] == v[:-1]) & (v[1:] != 0), [False]))
    out = np.zeros(len(side), bool)
    out[order] = same[1:] | same[:-1]
    return out


def indexed(docs: DataFrame, length: int, buckets: int, chunks: int) -> DataFrame:
    """docs(doc_id, th, text) -> (at: chunk, kind, data): runs that are repeated, and runs whose windows must be compared."""
    reach = (length - GRAM) // 2  # a window goes so far beyond its anchor on one side at least

    def batch(batches):
        family = Family()
        for table in text_batches(batches, 1_000_000):
            _, data, starts, doc, th = _bytes_of(table)
            text, first, last, anchor, h, ranges = window_runs(data, starts, length)
            # all bytes of the run make the key; the anchor's bytes the group, which picks the bucket
            key = mix64(ranges(first, last + length) + (anchor - first).astype(np.uint64) * _P + h)
            group = mix64(h) >> np.uint64(32)
            side = lambda ok, a, b: np.where(ok, (ranges(np.where(ok, a, 0), np.where(ok, b, 0)) >> np.uint64(32)) | np.uint64(1), 0)  # noqa: E731, B023
            left = side(anchor - first >= reach, anchor - reach, anchor + GRAM)
            right = side(anchor - last <= reach, anchor, anchor + GRAM + reach)
            family.add(Entries(key, group, left, right, doc[text], th[text], first - starts[text], last - first))
        for kind, e in ((GONE, family.removed()), (EDGE, family.survivors())):
            yield from _rows((b, kind, x) for b, x in _split(e, _bucket(e.group, buckets))).to_batches()

    def merged(table):
        family = Family()
        for kind, data in zip(table.column("kind").to_pylist(), table.column("data").to_pylist(), strict=True):
            entries = Entries.unpack(data)
            if kind == GONE:
                family.gone.append(entries)
            else:
                family.add(entries)
        kept, gone = family.survivors(), family.removed()
        edge = kept.take(_shares(kept.left) | _shares(kept.right))
        return _rows([(c, GONE, e) for c, e in _split(gone, _chunk(gone.doc, chunks))] + [(c, EDGE, e) for c, e in _split(edge, _chunk(edge.doc, chunks))])

    return docs.select("doc_id", "th", "text").mapInArrow(batch, PACKED).groupBy("at").applyInArrow(merged, PACKED)


def _bucket(groups: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64(groups.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _chunk(docs: np.ndarray, chunks: int) -> np.ndarray:
    """pmod(xxhash64(doc_id), chunks), as the engine has it for a long: ids with a common stride fill all chunks alike."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    h = (np.uint64(42) + p5 + np.uint64(8)) ^ (turn(docs.astype(np.int64).view(np.uint64) * p2, 31) * p1)
    h = turn(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return np.mod((h ^ (h >> np.uint64(32))).view(np.int64), chunks)


def _finished(part: bytes, start: np.ndarray, end: np.ndarray) -> tuple[int, int, int, str]:
    """Bytes, removed bytes, maximal removed runs and the hash of what is left."""
    if not len(start):
        return len(part), 0, 0, hashlib.sha256(part).hexdigest()
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate(([True], start[1:] > end[:-1]))
    first, last = start[new], end[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(end) - 1]))]
    at, digest = 0, hashlib.sha256()
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        digest.update(part[at:a])
        at = b
    digest.update(part[at:])
    return len(part), int((last - first).sum()), len(first), digest.hexdigest()


DONE = "doc_id long, th long, chunk int, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string, at int, data binary"


def compared(docs: DataFrame, found: DataFrame, length: int, buckets: int) -> DataFrame:
    """Finished documents; unfinished ones with text and the ranges found so far; and window entries for their edges."""

    def work(key, left, right):
        import pyarrow as pa

        parts, _, _, doc, th = _bytes_of(left)
        packs = [(k, Entries.unpack(x)) for k, x in zip(right.column("kind").to_pylist(), right.column("data").to_pylist(), strict=True)]
        gone, edge = (Entries.concat([e for k, e in packs if k == kind]) for kind in (GONE, EDGE))
        # the windows of edge runs, one entry each; a part of the documents at a time
        row = {}
        for i, name in enumerate(zip(doc.tolist(), th.tolist(), strict=True)):
            row.setdefault(name, i)
        owner = np.array([row[x] for x in zip(edge.doc.tolist(), edge.th.tolist(), strict=True)], np.int64)
        order = np.argsort(owner, kind="stable")
        edge, owner = edge.take(order), owner[order]
        family, low = Family(), 0
        while low < len(edge):
            high, names, size = low, [], 0
            while high < len(edge) and (not names or size < 1_000_000):
                names.append(owner[high])
                size += len(parts[owner[high]])
                high = int(np.searchsorted(owner, owner[high], side="right"))
            data = np.frombuffer(b"".join(parts[i] for i in names), np.uint8)
            begin = np.concatenate(([0], np.cumsum([len(parts[i]) for i in names])))
            e = edge.take(slice(low, high))
            count = e.run.astype(np.int64) + 1
            base = np.repeat(np.arange(len(e)), count)
            place = e.start[base] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            whole = begin[np.searchsorted(names, owner[low:high])][base] + place
            ranges = RangeHash(data)
            hashes, half = ranges(whole, whole + length), ranges(whole, whole + length // 2) >> np.uint64(32)
            family.add(Entries(hashes, half, np.zeros(len(base)), np.zeros(len(base)), e.doc[base], e.th[base], place, np.zeros(len(base))))
            low = high
        more = Entries.concat([gone, family.removed()])
        ranges = _by_document(more, length)
        pending = set(zip(edge.doc.tolist(), edge.th.tolist(), strict=True))
        out = {c: [] for c in ("doc_id", "th", "chunk", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text", "at", "data")}
        ids, texts = left.column("doc_id").to_pylist(), left.column("text").to_pylist()
        chunk = key[0].as_py()
        none = np.zeros(0, np.int64)
        for i, name in enumerate(zip(doc.tolist(), th.tolist(), strict=True)):
            start, end = ranges.get(name, (none, none))
            if name in pending:
                values = (ids[i], name[1], chunk, None, None, None, None, texts[i], None, np.stack((start, end)).astype(np.int64).tobytes())
            else:
                values = (ids[i], name[1], chunk, *_finished(parts[i], start, end), None, None, None)
            for c, v in zip(out, values, strict=True):
                out[c].append(v)
        kept = family.survivors()
        for b, e in _split(kept, (kept.key % np.uint64(buckets)).astype(np.int64)):
            for c, v in zip(out, (None,) * 8 + (b, e.pack()), strict=True):
                out[c].append(v)
        types = dict(zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.binary()), strict=True))
        return pa.table([pa.array(v, types[c]) for c, v in out.items()], names=list(out))

    return docs.select("doc_id", "th", "chunk", "text").groupBy("chunk").cogroup(found.groupBy("at")).applyInArrow(work, DONE)


def _by_document(entries: Entries, length: int) -> dict:
    """(doc, th) -> starts and ends of removed ranges."""
    order = np.lexsort((entries.start, entries.th, entries.doc))
    e = entries.take(order)
    cut = np.flatnonzero(np.concatenate(([True], (e.doc[1:] != e.doc[:-1]) | (e.th[1:] != e.th[:-1])))) if len(e) else []
    start, end = e.start.astype(np.int64), e.start.astype(np.int64) + e.run + length
    return {(int(e.doc[a]), int(e.th[a])): (start[a:b], end[a:b]) for a, b in zip(cut, [*cut[1:], len(e)], strict=False)}


def repeated_strings(docs: DataFrame, length: int = 100, chunk_bytes: int = 4_000_000) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256, one row per row of docs."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-total // chunk_bytes))
    buckets = max(4, chunks)
    once = docs.groupBy("doc_id").count().filter("count > 1").isEmpty()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (F.lit(0).cast("long") if once else F.xxhash64("text")).alias("th"))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(_NO_ID))), F.lit(chunks).cast("long")).cast("int"))
    stage = materialize(compared(rows, indexed(rows, length, buckets, chunks), length, buckets), "strings-stage")
    free_shuffles(docs.sparkSession)  # the text and the entries have been shuffled for the stage only
    done = stage.filter("kept_sha256 is not null").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")

    def windows(table):
        family = Family()
        for data in table.column("data").to_pylist():
            family.add(Entries.unpack(data))
        gone = family.removed()
        return _rows((c, GONE, e) for c, e in _split(gone, _chunk(gone.doc, chunks)))

    late = stage.filter("at is not null").select("at", "data").groupBy("at").applyInArrow(windows, PACKED)

    def finish(key, left, right):
        import pyarrow as pa

        parts, _, _, doc, th = _bytes_of(left)
        ranges = _by_document(Entries.concat([Entries.unpack(x) for x in right.column("data").to_pylist()]), length)
        none = np.zeros(0, np.int64)
        out = []
        for part, name, known in zip(parts, zip(doc.tolist(), th.tolist(), strict=True), left.column("data").to_pylist(), strict=True):
            before = np.frombuffer(known, np.int64).reshape(2, -1)
            start, end = ranges.get(name, (none, none))
            out.append(_finished(part, np.concatenate((before[0], start)), np.concatenate((before[1], end))))
        columns = list(zip(*out, strict=True)) or [[], [], [], []]
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.table([left.column("doc_id").combine_chunks(), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    pending = stage.filter("text is not null").select("doc_id", "th", "chunk", "text", "data")
    rest = pending.groupBy("chunk").cogroup(late.groupBy("at")).applyInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return done.unionByName(rest)


def op3_suffix_family(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return repeated_strings(docs)
