"""Helpers shared by the corpus operators: shared scratch tables, hot-key lookups and a byte-level word scanner."""

from __future__ import annotations

import ctypes
import functools
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words in a text whose A-Z were not lower-cased yet.
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A group with more than 1/HOT_SHARE of all rows is looked up map-side, so at most HOT_SHARE groups are broadcast.
HOT_SHARE = 1024


# -- shared scratch ---------------------------------------------------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset and all is one machine."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named or "file:///tmp/checkpoints/duelspark"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def saved(df: DataFrame, name: str, sweep: bool = True) -> DataFrame:
    """The rows of df, written once to the shared folder and read back: cuts lineage and survives lost executors.

    sweep: let go of the shuffle files so far; a step with small ones needn't.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    if sweep:
        released(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def released(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished steps: it does so once the driver has collected its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def dropped(*tables: DataFrame) -> None:
    """Remove saved tables that no later step reads."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(df._scratch)
        target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


# -- hot keys ---------------------------------------------------------------------------------------------------------


def lookup(rows: DataFrame, groups: DataFrame, key: list[str], count: str, total: int) -> DataFrame:
    """rows joined to groups, a saved table of one row a key with its number of rows in `count`.

    Groups above total/HOT_SHARE rows, of which there can be HOT_SHARE at most, are broadcast and their rows picked out
    by a literal list of their keys; all others are joined by an ordinary shuffle, where no key holds more than that.
    """
    limit = max(64, total // HOT_SHARE)
    hot = groups.where(F.col(count) > limit).collect()
    rest = groups.where(F.col(count) <= limit)
    if not hot:
        return rows.join(rest, key)
    is_hot = F.col(key[0]).isin([r[key[0]] for r in hot])
    keys = [r[key[0]] for r in hot]
    # Read from the saved table: rows sent by the driver go through Python workers of their own on the executors.
    first = rows.where(is_hot).join(F.broadcast(groups.where(F.col(count) > limit)), key)
    cold = rows.where(~is_hot).join(rest, key)
    if len(key) == 1 or groups.where(F.col(key[0]).isin(keys) & (F.col(count) <= limit)).isEmpty():
        return first.unionByName(cold)
    return first.unionByName(cold).unionByName(rows.where(is_hot).join(rest.where(F.col(key[0]).isin(keys)), key))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


# -- memory of Python workers -----------------------------------------------------------------------------------------


def release() -> None:
    """Give what a Python worker has freed back to the system: workers live on, and other stages' need the room."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task over batches that gives its memory back when it ends."""

    @functools.wraps(task)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from task(batches)
        finally:
            release()

    return run


# -- byte-level scanning of Arrow text --------------------------------------------------------------------------------

CHUNK = 1 << 19  # bytes of text that one numpy pass handles

_rng = np.random.default_rng(20240607)
_BYTE = np.arange(256)
_FOLD = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE)
IS_WORD = (_BYTE >= 128) | ((_FOLD >= 97) & (_FOLD <= 122)) | ((_BYTE >= 48) & (_BYTE <= 57))
_VALUE = np.where(IS_WORD, _rng.integers(1, 2**63, 256, dtype=np.uint64)[_FOLD], np.uint64(0)).astype(np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse's powers modulo 2**64."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, 2 * CHUNK + 1)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, base in (("up", _BASE), ("down", inverse)):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _POWERS[name] = np.multiply.accumulate(step)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64's published constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def pieces(offsets: np.ndarray, chunk: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have about `chunk` bytes together, one row at least."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        upto = max(row + 1, int(np.searchsorted(offsets, offsets[row] + chunk, "right")) - 1)
        yield row, min(upto, rows)
        row = upto


def _segments(word: np.ndarray) -> list[int]:
    """Places that cut a long text into passes of about CHUNK bytes, each before a byte that is in no word."""
    cuts, n = [0], len(word)
    while n - cuts[-1] > CHUNK:
        at = cuts[-1] + CHUNK
        while at < n:
            gap = np.flatnonzero(~word[at : at + CHUNK])
            if len(gap):
                at += int(gap[0])
                break
            at += CHUNK
        cuts.append(min(at, n))
    return [*cuts, n] if cuts[-1] < n else cuts


def _scan(raw: np.ndarray, word: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, its start) of one pass."""
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    up, down = _powers(len(raw))
    total = _VALUE[raw]
    total *= up[: len(raw)]
    np.cumsum(total, out=total)
    before = np.where(starts > 0, total[starts - 1], np.uint64(0))
    return mix((np.append(before[1:], total[-1]) - before) * down[starts]), starts


def scan_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts at data[offsets[i]:offsets[i+1]]: a hash of each lower-cased word, its byte start, words before each text."""
    begin, end = int(offsets[0]), int(offsets[-1])
    raw, local = data[begin:end], offsets - begin
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = IS_WORD[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    at = local[:-1][local[:-1] < len(raw)]
    first[at] = word[at]
    if len(raw) <= 2 * CHUNK:
        hashes, starts = _scan(raw, word, first)
    else:
        cuts = _segments(word)
        parts = [_scan(raw[a:b], word[a:b], first[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        hashes = np.concatenate([h for h, _ in parts])
        starts = np.concatenate([s + a for (_, s), a in zip(parts, cuts, strict=False)])
    return hashes, starts, np.searchsorted(starts, local)


def shingles(words: np.ndarray, bounds: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of `size` words (a text of fewer, but not none, has one run) and runs before each text."""
    counts = np.diff(bounds)
    n_runs = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    limits = np.concatenate([[0], np.cumsum(n_runs)])
    out = np.zeros(limits[-1], np.uint64)
    text = np.repeat(np.arange(len(counts)), n_runs)
    at = np.arange(limits[-1]) - limits[text] + bounds[text]
    length = np.minimum(counts[text], size)
    factor = np.uint64(0xD6E8FEB86659FD93)
    for k in range(size):
        have = length > k
        if have.all():
            out = out * factor + words[at + k]
        else:
            out[have] = out[have] * factor + words[at[have] + k]
    return mix(out), limits


# -- shapes that hot keys need ----------------------------------------------------------------------------------------


def bounded_batches(spark: SparkSession, size: int = 16 << 20) -> None:
    """Let a batch for Python hold about so many bytes, however long its texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) of every node of the undirected edges (a, b); root is the smallest node it is connected to.

    Alternating large-star and small-star steps (Kiveris et al. 2014), each written to the shared folder, until they
    change nothing: every node then points at a root that points nowhere. Hubs are looked up by their groups' sizes.
    """
    at = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name, False)
    before = None
    while True:
        n, sign = at.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
        if (n, sign) == before or not n:
            return at.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(at.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = n, sign
        # large star: every larger neighbour of a node points at the node's smallest neighbour
        both = at.unionByName(at.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = saved(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("n")), name, False)
        large = lookup(both, low, ["a"], "n", 2 * n).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = saved(large, name, False)
        # small star: a node and its smaller neighbours point at the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1")
        small = large.join(least, "a", "left")
        links = F.array_compact(F.array(F.struct(F.col("a"), F.coalesce("m", "b").alias("b")), F.when(F.col("m").isNotNull() & (F.col("b") != F.col("m")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))))
        small = saved(small.select(F.inline(links)).distinct(), name, False)
        dropped(at, low, large)
        at = small
