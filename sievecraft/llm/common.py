"""What the corpus operators share: scratch tables, Arrow text buffers, hashing, links."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are worked on at once; keeps the numpy arrays inside the CPU caches.
CHUNK_BYTES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, which driver and executors share.

    Only where the session has no such setting and all runs on this machine is one set here;
    a cluster without one is an error, as each executor would write to its own disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: What operators remember from task to task; another operator in the same worker forgets it.
REMEMBERED: dict[str, Callable[[], None]] = {}


@contextlib.contextmanager
def lean(owner: str = "") -> Iterator[None]:
    """A task that gives freed arrays and batches back at once, and at its end all it can.

    Workers share their executor's memory and are used again for other tasks.
    """
    for name, forget in REMEMBERED.items():
        if name != owner:
            forget()
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
    except (OSError, AttributeError):  # another C library keeps its own ways
        libc = None
    if pa.default_memory_pool().backend_name != "system":
        pa.set_memory_pool(pa.system_memory_pool())
    try:
        yield
    finally:
        if libc is not None:
            libc.malloc_trim(0)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and int64 offsets (from 0) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(ids: np.ndarray, raw: np.ndarray, at: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Whole documents, about limit bytes at a time: first and last index, bytes, offsets from 0."""
    i, n = 0, len(ids)
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def documents_in(batches: Iterable[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """doc_id, bytes and offsets of (doc_id, text) batches, chunk by chunk."""
    with lean():
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            raw, at = text_buffer(batch.column("text"))
            for i, j, b, o in chunks(ids, raw, at, limit):
                yield ids[i:j], b, o


# ---------------------------------------------------------------- hashing

_rng = np.random.default_rng(20240607)
#: A random 64-bit value for each byte, and an odd multiplier: sums of T[b] * B**i are the hashes.
BYTE_VALUE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = np.uint64(int(_rng.integers(0, 1 << 63)) * 2 + 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        m = 1 << max(10, n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(m, base, np.uint64)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            _powers[k] = p
    return _powers[0], _powers[1]


def prefix_hash(b: np.ndarray, lower: bool = False) -> np.ndarray:
    """Prefix sums p such that (p[e] - p[s]) * base**-s depends on the bytes s..e alone."""
    power, _ = _grown(len(b) + 1)
    p = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((BYTE_VALUE_LOWER if lower else BYTE_VALUE)[b] * power[: len(b)], out=p[1:])
    return p


BYTE_VALUE_LOWER = BYTE_VALUE.copy()
BYTE_VALUE_LOWER[65:91] = BYTE_VALUE[97:123]


def spans_hash(p: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, inverse = _grown(len(p))
    h = (p[ends] - p[starts]) * inverse[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values, one to one."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A random 64-bit value for each byte at each of 64 places of a block.
_PLACED = _rng.integers(0, 1 << 64, (64, 256), dtype=np.uint64)
_PLACED_LOWER = _PLACED.copy()
_PLACED_LOWER[:, 65:91] = _PLACED[:, 97:123]


def words_hash(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of the words starts..ends of b, which lie apart in order, by tabulation.

    A word's blocks of 64 bytes are sums of random values by place and byte; each is spread
    with its number and length before they are added up, so that no structure of the bytes
    (as that which defeats polynomials modulo 2**64) makes different words meet.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    blocks = (size + 63) >> 6
    word = np.repeat(np.arange(len(starts)), blocks)
    number = np.arange(len(word)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    lo = starts[word] + 64 * number
    n = np.minimum(ends[word] - lo, 64)
    done = np.cumsum(n) - n
    place = np.arange(int(n.sum())) - np.repeat(done, n)
    value = (_PLACED_LOWER if lower else _PLACED)[place, b[place + np.repeat(lo, n)]]
    h = np.bitwise_xor.reduceat(value, done)
    h = mix(h + (number * 64 + n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    if len(word) == len(starts):
        return h
    total = np.add.reduceat(h, np.cumsum(blocks) - blocks)
    return np.where(blocks > 1, mix(total + size.astype(np.uint64)), total)


def equal_spans(b: np.ndarray, x: np.ndarray, y: np.ndarray, size: np.ndarray, limit: int = 1 << 20) -> np.ndarray:
    """Whether the bytes x..x+size and y..y+size of b are the same; about `limit` bytes at a time."""
    out, done, s = np.ones(len(x), bool), np.concatenate([[0], np.cumsum(size)]), 0
    while s < len(x):
        e = max(s + 1, int(np.searchsorted(done, done[s] + limit, "right")) - 1)
        step = np.arange(done[s], done[e]) - np.repeat(done[s:e], size[s:e])
        same = b[np.repeat(x[s:e], size[s:e]) + step] == b[np.repeat(y[s:e], size[s:e]) + step]
        some = size[s:e] > 0
        if some.any():
            out[s:e][some] = np.logical_and.reduceat(same, (done[s:e] - done[s])[some])
        s = e
    return out


def byte_class(pattern_bytes: Iterable[int]) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(pattern_bytes)] = True
    return t


#: [^\x20\x09-\x0D]: all but blanks.
NOT_BLANK = ~byte_class([0x20, *range(0x09, 0x0E)])
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z: digits, letters and all bytes of non-ASCII characters.
ALNUM = byte_class([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])


def words_in(b: np.ndarray, at: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of each text, and the offsets of each text's words."""
    is_word = kind[b]
    first, last = is_word.copy(), is_word.copy()
    first[1:] &= ~is_word[:-1]
    last[:-1] &= ~is_word[1:]
    edge = at[1:-1]
    edge = edge[(edge > 0) & (edge < len(b))]
    first[edge] = is_word[edge]
    last[edge - 1] = is_word[edge - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, at)


# ---------------------------------------------------------------- links to classes


def components(edges: DataFrame, name: str = "links", most: int = 60) -> DataFrame:
    """(node, component) for each node of the links (a, b): the smallest node reachable.

    Each round takes the smallest label among neighbours and then the label's own label
    (pointer jumping); rounds are written to the shared folder, and all work is joins and
    pre-aggregated minima, so no group is ever gathered. A label's reach about doubles each
    round, so rounds go with the logarithm of a component's diameter; `most` only stops
    what never settles, with an error, and drops nothing.
    """
    both = stored(edges.select("a", "b").where("a <> b").distinct(), f"{name}-edges")
    both = both.select("a", "b").union(both.select(F.col("b"), F.col("a")))
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), f"{name}-labels")
    for _ in range(most):
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        hooked = labels.join(near, "node", "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("component"))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("up"))
        after = stored(hooked.join(up, "component", "left").select("node", "old", F.least("component", F.coalesce("up", "component")).alias("component")), f"{name}-labels")
        changed = after.where("component <> old").limit(1).count()
        labels = after.select("node", "component")
        if not changed:
            return labels
    raise RuntimeError(f"links did not settle in {most} rounds")
