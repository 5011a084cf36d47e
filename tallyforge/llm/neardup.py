"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full shingle sets, union-find grouping.

A document's set is its distinct k-word shingles after lower-casing A-Z. SuperMinHash gives each element one random
permutation of the slots and lets its j-th rank touch one slot with a value in [j, j+1); values of an element are
correlated across slots, which lowers the variance below plain MinHash, and an element stops as soon as j is above
every slot. Equal sets are collapsed to one node first, so copies never meet as pairs.

Bands of four slots send nodes to buckets. Verified links are grouped by distributed union-find in three rounds. First
each bucket links its members to its smallest one only. Then buckets whose members still lie in different groups are cut
into blocks - members outside the largest group against all members - and compared by signature and size; best first,
one pair is proposed for two groups. Last, for blocks that still hold pairs of different groups which the signature
allows, the full sets of their members meet in one place: all intersections of a block are counted at once by products
of its shingle incidence, and only links that join two groups leave the block. So the groups equal those of all links
without all pairs being made. At similarity 0.8, 28 bands of 4 miss a pair with probability 4e-7, and a signature of 128
slots underrates it by 0.15 with probability 1e-5 at most.

Blocks hold at most about `block` rows and block_shingles shingles a side, but for one text that is longer by itself.

Nulls and texts without words: empty set, linked with nothing, kept. A null doc_id is compared as any other value of its
column (null last). Repeated rows share a set and thus a group; the stage keeps one of them. Ties: of texts with the same
smallest doc_id the one with the smaller hash stays. Empty tables give empty results; other columns pass, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined_bytes, materialize, mix64, packed, text_batches, unpacked, word_hashes
from .graph import components

BANDS, ROWS, SLOTS = 28, 4, 128
_A, _B = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(data: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle fingerprints of each text, ascending, and offsets of the texts in them."""
    hashes, _, at = word_hashes(data, starts)
    n = np.diff(at)
    rolled = hashes[: max(0, len(hashes) - k + 1)] * _A
    for j in range(1, k):
        rolled = mix64(rolled + hashes[j : j + len(rolled)]) * _A
    sets = []
    for i, count in enumerate(n):
        if count >= k:
            sets.append(np.unique(rolled[at[i] : at[i] + count - k + 1]))
        elif count:
            h = np.full(1, count, np.uint64)
            for x in hashes[at[i] : at[i + 1]]:
                h = mix64(h * _B + x)
            sets.append(h)
        else:
            sets.append(np.zeros(0, np.uint64))
    offsets = np.zeros(len(sets) + 1, np.int64)
    np.cumsum([len(x) for x in sets], out=offsets[1:])
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), offsets


def superminhash(elements: np.ndarray, offsets: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Signatures (sets x slots, 16 bits each) of sets given as concatenated elements; vectorised over all sets, one rank a pass."""
    sets = len(offsets) - 1
    low = np.full((sets, slots), np.uint32(0xFFFFFFFF))
    owner = np.repeat(np.arange(sets), np.diff(offsets))
    order = None
    for j in range(slots):
        u = mix64(elements + np.uint64((j + 1) * int(_B) % 2**64))
        pick = j + (((u & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j)) >> np.uint64(32)).astype(np.int64)
        value = (np.uint32(j) << np.uint32(24)) + (u >> np.uint64(40)).astype(np.uint32)
        if j == 0:
            slot = pick
        else:
            if order is None:  # ranks beyond the first are needed for small sets only
                order = np.tile(np.arange(slots, dtype=np.uint8), (len(elements), 1))
                order[np.arange(len(elements)), first], order[:, 0] = 0, first
            rows = np.arange(len(elements))
            slot = order[rows, pick].astype(np.int64)
            order[rows, pick] = order[:, j]
        np.minimum.at(low.reshape(-1), owner * slots + slot, value)
        open_sets = low.max(axis=1) >= np.uint32(j + 1) << np.uint32(24)
        stay = open_sets[owner]
        if not stay.any():
            break
        if j == 0:
            first = pick[stay].astype(np.uint8)
        if order is not None:
            order = order[stay]
        elements, owner = elements[stay], owner[stay]
    return (mix64(low.astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)


def set_fingerprints(elements: np.ndarray, offsets: np.ndarray) -> list[bytes | None]:
    """128-bit fingerprints of sets; None for the empty set."""
    sums = np.zeros((len(offsets), 2), np.uint64)
    running = np.concatenate(([np.uint64(0)], np.cumsum(mix64(elements ^ _A))))
    again = np.concatenate(([np.uint64(0)], np.cumsum(mix64(elements * _A + _B))))
    sums = np.stack((running[offsets[1:]] - running[offsets[:-1]], again[offsets[1:]] - again[offsets[:-1]]), 1)
    return [row.tobytes() if size else None for row, size in zip(sums, np.diff(offsets), strict=True)]


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, th, n, node, sig)."""

    def work(batches):
        import pyarrow as pa

        for table in text_batches(batches, 4_000_000):
            elements, offsets = shingle_sets(*joined_bytes(table.column("text")), k)
            sig = superminhash(elements, offsets)
            names = set_fingerprints(elements, offsets)
            cols = [table.column("doc_id").combine_chunks(), table.column("th").combine_chunks(), pa.array(np.diff(offsets), pa.int64()), pa.array(names, pa.binary()), pa.array([row.tobytes() if x else None for row, x in zip(sig, names, strict=True)], pa.binary())]
            yield from pa.table(cols, names=["doc_id", "th", "n", "node", "sig"]).to_batches()

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(work, f"doc_id {kind}, th long, n long, node binary, sig binary")


def _verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """pairs(a, b) with ok: whether the full sets of the two texts reach the similarity."""

    def work(batches):
        import pyarrow as pa

        for table in text_batches(batches, 2_000_000, "tb"):
            ta, tb = table.column("ta").to_pylist(), table.column("tb").to_pylist()
            place: dict = {}
            for t in ta:
                place.setdefault(t, len(place))
            left, lo = shingle_sets(*joined_bytes(list(place)), k)
            right, ro = shingle_sets(*joined_bytes(tb), k)
            ok = []
            for i, t in enumerate(ta):
                x, y = left[lo[place[t]] : lo[place[t] + 1]], right[ro[i] : ro[i + 1]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(bool(both) and 100 * both >= percent * (len(x) + len(y) - both))
            yield from pa.table([table.column("a").combine_chunks(), table.column("b").combine_chunks(), pa.array(ok, pa.bool_())], names=["a", "b", "ok"]).to_batches()

    one = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    two = one.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    return two.select("a", "b", "ta", "tb").mapInArrow(work, "a binary, b binary, ok boolean")


def _texts_of(nodes: DataFrame, docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(node, text) for the given nodes, from the smallest row of each."""
    wanted = reps.select("node", "doc_id", "th").join(nodes, "node", "left_semi")
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("th")).filter("text is not null")
    return rows.join(wanted, rows.doc_id.eqNullSafe(wanted.doc_id) & (rows.th == wanted.th)).groupBy("node").agg(F.max("text").alias("text"))


def _sig(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, SLOTS)


def _agreeing(pairs: DataFrame, reps: DataFrame, percent: int, slack: float) -> DataFrame:
    """Pairs (a, b) whose signatures and sizes allow the similarity."""
    sig = reps.select("node", "n", "sig")
    both = pairs.join(sig.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa")), "a")
    both = both.join(sig.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb")), "b")
    both = both.filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                near = (_sig(batch.column("sa")) == _sig(batch.column("sb"))).mean(axis=1)
                yield batch.select(["a", "b"]).filter(pa.array(near >= percent / 100 - slack))

    return both.select("a", "b", "sa", "sb").mapInArrow(work, "a binary, b binary")


class _Groups:
    """Union-find over a few names."""

    def __init__(self):
        self.up: dict = {}

    def root(self, c):
        while self.up.get(c, c) != c:
            self.up[c] = self.up.get(self.up[c], self.up[c])
            c = self.up[c]
        return c

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[a] = b
        return a != b


def _dealt(df: DataFrame, parts: int):
    """df by block, in a number of partitions that adaptive execution leaves alone: rows are few bytes but much work."""
    return df.repartition(parts, "key", "i", "j").groupBy("key", "i", "j")


def _parts(spark, rows: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // 4096)


def _fitting(rows: DataFrame, reps: DataFrame, percent: int, slack: float, block: int, best: bool, parts: int, block_shingles: int = 2_000_000) -> DataFrame:
    """rows(key, band, node, component, main, outer, members, outer_n, members_n) of open buckets -> pairs that signature and size allow.

    Members outside a bucket's main group, in blocks, meet all its members, in blocks; no task holds a whole bucket.
    best: (a, b), best first, one pair for two groups; else (key, i, j, node, component) of all nodes in such pairs.
    """
    full = rows.join(reps.select("node", "n", "sig"), "node").withColumns({f"_{x}": F.ceil(F.greatest(F.col(rows_) / block, F.col(f"{rows_}_n") / block_shingles)).cast("int") for x, rows_ in (("i", "outer"), ("j", "members"))})
    kept = ["key", "band", "node", "component", "n", "sig"]
    spot = F.xxhash64("node", "key")
    left = full.filter("component <> main").select(*kept, F.lit(0).alias("side"), F.pmod(spot, F.col("_i")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("_j") - 1)).alias("j"))
    right = full.select(*kept, F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("_i") - 1)).alias("i"), F.pmod(spot, F.col("_j")).cast("int").alias("j"))
    schema = "a binary, b binary" if best else "key long, i int, j int, node binary, component binary"

    def work(key, table):
        import pyarrow as pa

        side = table.column("side").to_numpy()
        nodes = np.array(table.column("node").to_pylist(), dtype=object)
        names = table.column("component").to_pylist()
        comps = np.unique(np.array(names, dtype=object), return_inverse=True)[1]
        n, sig = table.column("n").to_numpy(), _sig(table.column("sig"))
        band = table.column("band")[0].as_py()
        l, r = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        outer = set(nodes[l].tolist())
        pairs = []
        for p in l:
            near = (sig[p] == sig[r]).mean(axis=1)
            fits = (near >= percent / 100 - slack) & (comps[r] != comps[p]) & (100 * np.minimum(n[p], n[r]) >= percent * np.maximum(n[p], n[r]))
            for q in np.flatnonzero(fits):
                earlier = (sig[p][: band * ROWS] == sig[r[q]][: band * ROWS]).reshape(-1, ROWS).all(axis=1).any()
                if not earlier and not (nodes[r[q]] in outer and nodes[r[q]] < nodes[p]):  # each pair in one bucket, once
                    pairs.append((-near[q], nodes[p], nodes[r[q]], p, r[q]))
        if best:
            groups = _Groups()
            out = [(min(x, y), max(x, y)) for _, x, y, p, q in sorted(pairs) if groups.join(int(comps[p]), int(comps[q]))]
            return pa.table([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())], names=["a", "b"])
        some = sorted({nodes[x]: x for p in pairs for x in p[3:]}.values())
        here = [x.as_py() for x in key]
        return pa.table([pa.array([here[0]] * len(some), pa.int64()), pa.array([here[1]] * len(some), pa.int32()), pa.array([here[2]] * len(some), pa.int32()), pa.array([nodes[x] for x in some], pa.binary()), pa.array([names[x] for x in some], pa.binary())], names=["key", "i", "j", "node", "component"])

    return _dealt(left.unionByName(right), parts).applyInArrow(work, schema)


def _settled(members: DataFrame, texts: DataFrame, k: int, percent: int, parts: int) -> DataFrame:
    """members(key, i, j, node, component) of blocks -> links (a, b) between different groups, by full sets of all pairs."""

    def work(key, table):
        import pyarrow as pa

        elements, offsets = shingle_sets(*joined_bytes(table.column("text")), k)
        nodes = table.column("node").to_pylist()
        comps = np.unique(np.array(table.column("component").to_pylist(), dtype=object), return_inverse=True)[1]
        count, size = len(nodes), np.diff(offsets)
        owner = np.repeat(np.arange(count), size)
        order = np.argsort(elements, kind="stable")
        e, o = elements[order], owner[order]
        new = np.concatenate(([True], e[1:] != e[:-1]))
        rank = np.cumsum(new) - 1
        often = np.bincount(rank)[rank] > 1  # shingles of one text intersect with nothing
        rank, o = np.unique(rank[often], return_inverse=True)[1], o[often]
        both = np.zeros((count, count), np.float32)
        width = max(256, 16_000_000 // max(1, count))  # columns of the incidence matrix at a time
        cut = np.searchsorted(rank, np.arange(0, (rank[-1] + 1 if len(rank) else 0) + width, width))
        for a, z in zip(cut, cut[1:], strict=False):
            if z > a:
                m = np.zeros((count, width), np.float32)
                m[o[a:z], rank[a:z] % width] = 1
                both += m @ m.T
        union = size[:, None] + size[None, :] - both
        x, y = np.nonzero(np.triu((both > 0) & (100 * both >= percent * union) & (comps[:, None] != comps[None, :]), 1))
        groups = _Groups()
        out = [(nodes[p], nodes[q]) for p, q in zip(x.tolist(), y.tolist(), strict=True) if groups.join(int(comps[p]), int(comps[q]))]
        return pa.table([pa.array([p[0] for p in out], pa.binary()), pa.array([p[1] for p in out], pa.binary())], names=["a", "b"])

    return _dealt(members.join(texts, "node"), parts).applyInArrow(work, "a binary, b binary")


def near_duplicate_groups(docs: DataFrame, k: int = 4, percent: int = 80, slack: float = 0.15, salts: int = 16, block: int = 1024) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, th, n_shingles, component_id, component), one row per row of docs; th is the text's xxhash64.

    component names the group, also where ids repeat or are null; it is null for texts without words.
    """
    base = materialize(signatures(docs, k), "near-signatures")
    reps = base.filter("node is not null").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "n", "sig")).alias("r"))
    reps = materialize(reps.select("node", "r.doc_id", "r.th", "r.n", "r.sig"), "near-nodes")
    width = 2 * ROWS
    keys = F.array(*[F.xxhash64(F.substring("sig", width * i + 1, width), F.lit(i)) for i in range(BANDS)])
    banded = reps.select("node", "n", F.posexplode(keys).alias("band", "key"))
    heads = banded.groupBy("key").agg(F.min(F.struct("node", "n")).alias("head"), F.max("node").alias("last")).filter("head.node <> last")
    buckets = materialize(banded.join(heads.select("key", "head"), "key").select("key", "band", "node", "n", "head"), "near-buckets")
    star = buckets.filter((F.col("node") != F.col("head.node")) & (100 * F.least("n", "head.n") >= percent * F.greatest("n", "head.n")))
    pairs = materialize(_agreeing(star.select(F.col("head.node").alias("a"), F.col("node").alias("b")).distinct(), reps, percent, slack), "near-pairs")
    texts = materialize(_texts_of(buckets.select("node").distinct(), docs, reps), "near-texts")
    verified = lambda p: materialize(_verified(p, texts, k, percent).filter("ok").select("a", "b"), "near-links")
    labels = materialize(components(verified(pairs)), "near-labels")
    rows = buckets.select("key", "band", "node", F.col("n").alias("w"))
    for best in (True, False):
        named = rows.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        sizes = named.groupBy("key", "component").agg(F.count("*").alias("c"), F.sum("w").alias("w"))
        sizes = sizes.groupBy("key").agg(F.max(F.struct("c", "component", "w")).alias("m"), F.sum("c").alias("members"), F.sum("w").alias("members_n"), F.count("*").alias("groups"))
        opened = sizes.filter("groups > 1").select("key", F.col("m.component").alias("main"), (F.col("members") - F.col("m.c")).alias("outer"), "members", (F.col("members_n") - F.col("m.w")).alias("outer_n"), "members_n")
        open_rows = materialize(named.join(opened, "key"), "near-open")
        rows = open_rows.select("key", "band", "node", "w")
        fits = materialize(_fitting(open_rows, reps, percent, slack, block, best, _parts(docs.sparkSession, open_rows.count())), "near-fitting")
        good = verified(fits.distinct()) if best else materialize(_settled(fits, texts, k, percent, _parts(docs.sparkSession, 16 * fits.count())), "near-links")
        # groups found so far stand for their links, so that edges don't pile up
        labels = materialize(components(good.union(labels.select("node", "component"))), "near-labels")
    named = reps.select("node", "doc_id")
    named = named.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_node = named.join(least, "component").select("node", "component_id", "component").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # a set may be that of a third of all rows
    rows = base.withColumn("_salt", F.pmod(F.hash("doc_id", "th"), F.lit(salts)))
    filled = rows.filter("node is not null").join(by_node, ["node", "_salt"]).select("doc_id", "th", F.col("n").alias("n_shingles"), "component_id", "component")
    return filled.unionByName(rows.filter("node is null").select("doc_id", "th", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("binary").alias("component")))


def op7_superminhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    groups = near_duplicate_groups(docs)
    return groups.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def stage_near_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8), the one with the smallest doc_id (null last) and text hash.

    Of rows that repeat in doc_id and text one stays; texts without words all stay.
    """
    groups = near_duplicate_groups(docs.select("doc_id", "text"), k=5)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("th").alias("_th"))
    grouped = groups.filter("component is not null").groupBy("component").agg(F.min(order).alias("r"))
    grouped = grouped.select("r.doc_id", "r._th", F.lit(True).alias("_one"))
    kept = grouped.union(groups.filter("component is null").select("doc_id", "th", F.lit(False)).distinct())
    kept = materialize(kept.withColumnRenamed("doc_id", "_id"), "near-kept")
    rows = packed(docs).withColumn("_h", F.xxhash64("text"))
    found = rows.join(kept, rows.doc_id.eqNullSafe(kept._id) & rows._h.eqNullSafe(kept._th))
    return unpacked(_first_of_repeats(found.drop("_id", "_th"), groups), docs.columns)


def _first_of_repeats(found: DataFrame, groups: DataFrame) -> DataFrame:
    """found without further rows of the same doc_id and text; only where such rows exist are any rows gathered."""
    again = groups.filter("component is not null").groupBy("doc_id", "th").count().filter("count > 1")
    again = materialize(again.select(F.col("doc_id").alias("_again"), F.col("th").alias("_again_th")), "near-repeats")
    if again.isEmpty():
        return found
    match = found.doc_id.eqNullSafe(again._again) & found._h.eqNullSafe(again._again_th)
    repeats = found.filter("_one").join(again, match, "left_semi")
    columns = [c for c in repeats.columns if c not in ("doc_id", "_h")]
    one = repeats.groupBy("doc_id", "_h").agg(F.first(F.struct(*columns)).alias("x")).select("doc_id", "_h", "x.*")
    return found.join(again, match, "left_anti").unionByName(one).unionByName(found.filter("not _one").join(again, match, "left_semi"))
