"""Shared pieces: tables between stages, whole texts as numpy arrays, connected components."""

from __future__ import annotations

import ctypes
import mmap
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.plans.order import shared_folder, temporary

#: A side of at most so many rows and bytes may be broadcast; beyond them, joins shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20
#: A process that holds less than this keeps its free memory.
HELD_BYTES = 256 << 20
#: Bytes of text that the numpy code handles at once.
CHUNK_BYTES = 4 << 20


class Work:
    """Tables written between the stages of one operator, so that no stage depends on an executor's memory. Their
    folder is in the shared one and goes when the driver ends, unless it is kept: for archives and token files."""

    def __init__(self, spark: SparkSession, name: str, keep: bool = False):
        name = f"{name}-{uuid.uuid4().hex[:12]}"
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}" if keep else temporary(spark, name)

    def table(self, name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{self.root}/{name}")
        return self.read(name, df.schema)

    def read(self, name: str, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for n in names:
            p = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{n}")
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The frame, marked for broadcast only where a count of rows and bytes shows that it is small."""
    width = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(0))
    n, size = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(width.cast("long")), F.lit(0))).head()
    return F.broadcast(df) if n <= rows and size <= BROADCAST_BYTES else df


def _bytes(c: Column, kind: T.DataType) -> Column:
    """The bytes of a value, about."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 8
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.aggregate(c, F.lit(8), lambda a, x: a + _bytes(x, kind.elementType)), F.lit(8))
    if isinstance(kind, T.StructType):
        return sum((_bytes(c[f.name], f.dataType) for f in kind.fields), F.lit(0))
    return F.lit(8)


def tasks(df: DataFrame) -> int:
    """How many partitions the frame has as planned; runs no job."""
    return max(1, df._jdf.queryExecution().toRdd().getNumPartitions())


def release() -> None:
    """Gives free memory of this process back where it holds much, which else stays with a Python worker while other
    stages run. On systems without these calls nothing happens."""
    try:
        with open("/proc/self/statm") as f:
            held = int(f.read().split()[1]) * mmap.PAGESIZE
        trim = ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return
    if held >= HELD_BYTES:
        pa.default_memory_pool().release_unused()
        trim(0)


def tidy(func: Callable) -> Callable:
    """A function over batches that releases memory when a task is over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from func(batches)
        finally:
            release()

    return run


def lower_ascii(c: Column) -> Column:
    """A-Z only, whatever the locale."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# -- whole texts as arrays ----------------------------------------------------------------------------------
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
#: Words between ASCII white space: [^\x20\x09-\x0D]+
SPACED = np.ones(256, bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False
#: Words of ASCII letters, digits and anything beyond ASCII: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    h = h ^ (h >> np.uint64(30))
    h *= _K2
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of an Arrow column, nulls empty, and the len + 1 offsets into them."""
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "").cast(pa.large_binary())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts hold about `limit` bytes; a longer text is a slice of its own."""
    for b in batches:
        size = np.asarray(pc.fill_null(pc.binary_length(b.column(column)), 0)).astype(np.int64)
        at, total = 0, np.cumsum(size)
        while at < b.num_rows:
            done = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, done + limit, "right")))
            yield b.slice(at, end - at)
            at = end


class Words:
    """Words of many texts: byte spans, 64-bit hashes of their lower-cased bytes, and each text's range."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, kind: np.ndarray):
        low = _LOW[raw]
        inside = kind[low]
        first = np.empty(len(raw) + 1, bool)
        last = np.empty(len(raw) + 1, bool)
        if len(raw):
            first[0], first[1:-1], first[-1] = inside[0], inside[1:] & ~inside[:-1], False
            last[0], last[1:-1], last[-1] = False, inside[:-1] & ~inside[1:], inside[-1]
            cut = np.unique(offsets[1:-1])
            cut = cut[(cut > 0) & (cut < len(raw))]
            cut = cut[inside[cut] & inside[cut - 1]]  # a word never runs on into the next text
            first[cut] = last[cut] = True
        else:
            first[:] = last[:] = False
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last)
        self.of = np.searchsorted(self.start, offsets)  # text d has words of[d] to of[d + 1]
        self._low = low

    def hashes(self) -> np.ndarray:
        """Every byte of a word enters, eight at a time."""
        pad = np.concatenate([self._low, np.zeros(16, np.uint8)])
        eight = np.lib.stride_tricks.as_strided(pad[:8].view(np.uint64), (len(pad) - 7,), (1,))
        size = (self.end - self.start).astype(np.int64)
        h = mix((size.astype(np.uint64) + np.uint64(1)) * _K1)
        left, at, who = size, self.start, None
        while len(left):
            block = eight[at] & _MASK[np.minimum(left, 8)]
            if who is None:
                h = mix((h ^ block) * _K1)
            else:
                h[who] = mix((h[who] ^ block) * _K1)
            more = np.flatnonzero(left > 8)
            who = more if who is None else who[more]
            left, at = left[more] - 8, at[more] + 8
        return h


def pack(*arrays: np.ndarray) -> bytes:
    """Equally long arrays, one after the other."""
    return b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(data: bytes, *kinds) -> list[np.ndarray]:
    width = sum(np.dtype(k).itemsize for k in kinds)
    n, out, at = len(data) // width, [], 0
    for k in kinds:
        out.append(np.frombuffer(data, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


def by_block(parts: np.ndarray, n: int, *arrays: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The arrays' rows, grouped by their block number below n."""
    order = np.argsort(parts.astype(np.uint16 if n <= 65536 else np.uint32), kind="stable")
    ends = np.searchsorted(parts[order], np.arange(n + 1))
    arrays = [a[order] for a in arrays]
    for b in range(n):
        if ends[b] < ends[b + 1]:
            yield b, [a[ends[b] : ends[b + 1]] for a in arrays]


def blocks_of(batches: Iterator[pa.RecordBatch], key: str = "block", data: str = "data") -> Iterator[tuple[int, list[bytes]]]:
    """All pieces of each block, from rows sorted by block: one block is in memory at a time."""
    now, held = None, []
    for b in batches:
        for k, d in zip(b.column(key).to_pylist(), b.column(data)):
            if k != now and held:
                yield now, held
                held = []
            now = k
            held.append(d.as_py())
    if held:
        yield now, held


# -- connected components -----------------------------------------------------------------------------------
def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node it is joined with) that join the same nodes as the edges (u, v)."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    below = root != np.arange(len(nodes))
    return nodes[below], nodes[root[below]]


def components(work: Work, edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (u, v); a component is named by its smallest node.

    Each round joins what a task's own edges join (a million of them at a time), points every node and what it
    pointed at to the smallest of these, and then from there to where that points, until nothing moves. After the
    first step a node is in at most one edge of each task, so no node's edges gather in one place. Each round is a
    written table, so a lost executor costs at most one round.
    """
    run = uuid.uuid4().hex[:6]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            held.append((np.asarray(b.column("u")), np.asarray(b.column("v"))))
            if sum(len(x) for x, _ in held) > 1 << 20:
                u, v = stars(*(np.concatenate(x) for x in zip(*held)))
                yield pa.record_batch([pa.array(u), pa.array(v)], ["u", "v"])
                held.clear()
        if held:
            u, v = stars(*(np.concatenate(x) for x in zip(*held)))
            yield pa.record_batch([pa.array(u), pa.array(v)], ["u", "v"])

    now, n = edges.filter("u <> v").select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")), 0
    while True:
        least = now.mapInArrow(tidy(local), "u long, v long").groupBy("u").agg(F.collect_set("v").alias("all"))
        least = work.table(f"cc{run}-least{n}", least.withColumn("m", F.array_min("all")))
        moved = least.filter(F.size("all") > 1).select(F.explode("all").alias("u"), "m").filter("u <> m").distinct()
        edge = least.select("u", F.col("m").alias("v"), (F.size("all") > 1).alias("busy")).union(moved.select("u", F.col("m").alias("v"), F.lit(True)))
        then = edge.groupBy(F.col("u").alias("via")).agg(F.min("v").alias("then"))
        jumped = edge.join(then, F.col("v") == F.col("via"), "left")
        jumped = jumped.select("u", F.coalesce("then", "v").alias("v"), (F.col("busy") | F.col("then").isNotNull()).alias("busy"))
        now = work.table(f"cc{run}-{n}", jumped)
        work.drop(f"cc{run}-least{n}", f"cc{run}-{n - 1}")
        if not now.filter("busy").limit(1).count():
            break
        n += 1
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return out.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
