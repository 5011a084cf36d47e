"""Helpers shared by the corpus operators: tables in the shared folder, native word expressions, NumPy text batches."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

import numpy as np
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words, as a Java and DuckDB class: space and 0x09 to 0x0D.
SPACES = r"[\x20\x09-\x0D]+"
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one only where that is unset (tests)."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", conf.get("spark.master", "local")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = globals().setdefault("_LOCAL", "file://" + tempfile.mkdtemp(prefix="tallyforge-"))
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tallyforge/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _MADE.append(path)
    free_shuffles(spark)
    return spark.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Lets the driver forget finished plans, so that executors delete their shuffle files now and not at some later collection.

    What Python, Arrow and the JVM's native side have freed goes back to the system too, as far as the C library can do that.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim_worker()
    trim_jvm(spark)


def trim_worker() -> None:
    """Gives what this Python process has freed back to the system; a worker of an executor waits, with its memory, for later tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)(0)


def trim_jvm(spark: SparkSession) -> None:
    """Asks the driver's JVM to return freed native memory (compiler, network and codec buffers): a diagnostic command of the JDK, where it has it."""
    jvm, new = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    types = ["javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"]
    given = new(jvm.java.lang.Class, len(types))
    for i, t in enumerate(types):
        given[i] = jvm.java.lang.Class.forName(t)
    call = jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", given)  # the class of the server itself isn't open to callers
    args = new(jvm.java.lang.Object, 4)
    args[0] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    args[1], args[2], args[3] = "systemTrimNativeHeap", new(jvm.java.lang.Object, 0), new(jvm.java.lang.String, 0)
    try:
        call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:  # a JVM without the command keeps what it has freed
        pass


def made() -> int:
    """How many tables materialize() has made and release() hasn't deleted: a mark for release()."""
    return len(_MADE)


def release(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Deletes the tables that materialize() has made in this process since a mark, but for the last `keep`; call once results are written."""
    jvm = spark.sparkContext._jvm
    gone = _MADE[since : len(_MADE) - keep]
    del _MADE[since : len(_MADE) - keep]
    for name in gone:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def words(text: Column) -> Column:
    """Array of the words [^\\x20\\x09-\\x0D]+ of a text; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


USED = ("doc_id", "text", "lang", "source")


def packed(docs: DataFrame) -> DataFrame:
    """The columns of USED, and all others in one struct, so that no name of theirs can clash with an operator's."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in USED]
    return docs.select(*[c for c in USED if c in docs.columns], F.struct(F.lit(0).alias("_"), *others).alias("_extra"))


def unpacked(df: DataFrame, columns: list[str], *more: str) -> DataFrame:
    """The given columns again, in order, and more; a column of docs that has the name of one of more is replaced by it."""
    return df.select(*[F.col(c) if c in USED else F.col(f"_extra.`{c}`").alias(c) for c in columns if c not in more], *more)


def null_safe_key(c: Column) -> Column:
    """A string that differs for every value and for null, so that plain equi-joins can be used."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def permuted(x: Column, n: Column, key: Column, rounds: int = 8, inverse: bool = False) -> Column:
    """Pseudorandom permutation of [0, n) by swap-or-not rounds, or its inverse; exact for every n, no cycle walking."""

    def step(acc, r):
        other = F.pmod(F.pmod(F.xxhash64(key, r), n) + n - acc, n)
        coin = F.xxhash64(key, r, F.greatest(acc, other)).bitwiseAND(F.lit(1))
        return F.when(coin == 1, other).otherwise(acc)

    order = F.sequence(F.lit(rounds), F.lit(1)) if inverse else F.sequence(F.lit(1), F.lit(rounds))
    return F.aggregate(order, x.cast("long"), step)  # each round is its own inverse


# --- NumPy text batches -------------------------------------------------------------------------------------

_rng = np.random.RandomState(20260714)
#: A random 64-bit value for each byte, and odd multipliers; parts of every fingerprint below.
BYTE64 = _rng.randint(0, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Longer words are fingerprinted byte by byte.
_SHORT = 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def joined_bytes(texts) -> tuple[np.ndarray, np.ndarray]:
    """Texts (pyarrow string array or list; null: empty) as one uint8 array, each followed by a newline, and start offsets."""
    if str(getattr(texts, "type", "")) == "string" and len(texts) and texts.nbytes < 1 << 30:  # bytes are joined where they lie
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(texts.combine_chunks() if hasattr(texts, "combine_chunks") else texts, "")
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        texts = pa.concat_arrays([texts, pa.array([""], texts.type)])  # so that a newline follows the last text too
        data = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), "\n")[0].as_buffer()
        return np.frombuffer(data, np.uint8), np.concatenate(([0], np.cumsum(sizes)))
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in (texts.to_pylist() if hasattr(texts, "to_pylist") else texts)]
    sizes = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum(sizes, out=starts[1:])
    return np.frombuffer(b"\n".join(parts) + b"\n" if parts else b"", np.uint8), starts


def word_hashes(data: np.ndarray, starts: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit fingerprints of all words of a batch, the first byte of each, and for each text the index of its first word."""
    space = (data - np.uint8(9) < 5) | (data == 32)
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(data) and not space[0]:
        edge = np.concatenate(([0], edge))
    first, end = edge[0::2].copy(), edge[1::2]
    if not len(first):
        return np.zeros(0, np.uint64), first, np.zeros(len(starts), np.int64)
    length = end - first
    # word value: sum of byte value times a power of the base for its place in the word; spaces after it have the value 0
    of = np.where(_SPACE, np.uint64(0), BYTE64[_LOWER] if lower else BYTE64)
    square = np.array([_BASE]) * _BASE
    pairs = (of * _BASE + of[:, None] * square).reshape(-1)  # values of two bytes at once, the second one the higher
    hashes = np.empty(len(first), np.uint64)
    for i in range(0, len(first), 65_536):  # so many words at a time that they stay in the cache
        at, left = first[i : i + 65_536], length[i : i + 65_536]
        two = data[at[0] + 1 : at[-1] + left[-1] + 1].astype(np.uint16)
        two <<= 8
        two |= data[at[0] : at[-1] + left[-1]]
        at = at - at[0]
        value = pairs.take(two.take(at))
        of_word = np.flatnonzero((left > 2) & (left <= _SHORT))
        at, left, power = at.take(of_word), left.take(of_word), square
        while len(of_word):
            at += 2
            left -= 2
            value[of_word] += pairs.take(two.take(at)) * power
            power = power * square
            more = np.flatnonzero(left > 2)
            of_word, at, left = of_word.take(more), at.take(more), left.take(more)
        hashes[i : i + 65_536] = value
    many = np.flatnonzero(length > _SHORT)
    if len(many):
        at, n = first[many], length[many]
        powers = np.cumprod(np.full(int(n.max()), _BASE, np.uint64))
        long = np.cumsum(n)
        i = 0
        while i < len(many):  # so many bytes at a time that they stay in the cache
            j = max(i + 1, int(np.searchsorted(long, (long[i - 1] if i else 0) + 32_768, "right")))
            begin = np.cumsum(n[i:j]) - n[i:j]
            place = np.arange(int(n[i:j].sum())) - np.repeat(begin, n[i:j])
            hashes[many[i:j]] = np.add.reduceat(of[data[place + np.repeat(at[i:j], n[i:j])]] * powers[place], begin)
            i = j
    hashes = mix64(hashes + length.astype(np.uint64))
    return hashes, first, np.searchsorted(first, starts)


def text_batches(batches, limit: int = 8_000_000, column: str = "text"):
    """Regroups Arrow batches into tables of about limit bytes of text, so that memory per step is bounded by the longest text."""
    import pyarrow as pa
    import pyarrow.compute as pc

    held, size = [], 0
    for batch in batches:
        start = 0
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(lengths)
        while start < batch.num_rows:
            base = total[start - 1] if start else 0
            stop = int(np.searchsorted(total, base + limit - size, side="right"))
            stop = max(stop, start + 1)
            held.append(batch.slice(start, stop - start))
            size += int(total[stop - 1] - base)
            start = stop
            if size >= limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)
