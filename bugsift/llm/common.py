"""Helpers shared by the operators of this subpackage: bounded Arrow chunks,
word splitting and hashing, checkpoints, partition counts, components."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import min_label_components
from ..session import ensure_checkpoint_dir, ship_package

CHUNK_BYTES = 6 << 20
U64 = np.uint64
_GOLD = U64(0x9E3779B97F4A7C15)


def prepare(spark: SparkSession) -> None:
    """Checkpoint folder (own default only on a local master) and package shipping."""
    ensure_checkpoint_dir(spark, allow_local_default=spark.sparkContext.master.startswith("local["))
    ship_package(spark)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: lost executors reread it from the shared folder."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_chunks(batches: Iterator[pa.RecordBatch], text: int = 1,
                limit: int = CHUNK_BYTES) -> Iterator[tuple[list[pa.Array], pa.Array]]:
    """Split Arrow batches into row slices of at most ``limit`` text bytes (one
    row may exceed it). Yields (all columns, text column as large_string with
    nulls as empty)."""
    for b in batches:
        if b.num_rows == 0:
            continue
        t = pc.fill_null(b.column(text).cast(pa.large_string()), "")
        ends = np.cumsum(pc.binary_length(t).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < b.num_rows:
            base = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield [c.slice(lo, hi - lo) for c in b.columns], t.slice(lo, hi - lo)
            lo = hi
    trim()


def trim() -> None:
    """Give freed memory back: workers are reused, and two share an executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):       # not glibc
        pass


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (wrapping)."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    return h ^ (h >> U64(29))


def split_words(text: pa.Array, lower: bool) -> tuple[pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every row: (flat word array, row offsets)."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(text) if lower else text)
    flat = parts.flatten()
    n_rows = len(text)
    off = parts.offsets.to_numpy() - (parts.offsets[0].as_py() if n_rows else 0)
    full = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not full.all():
        kept = np.concatenate([[0], np.cumsum(full)])
        off = kept[off]
        flat = flat.filter(pa.array(full))
    return flat, off.astype(np.int64)


def word_hashes(text: pa.Array, lower: bool, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word and the row offsets; each distinct word of the
    chunk is hashed once."""
    flat, off = split_words(text, lower)
    if len(flat) == 0:
        return np.zeros(0, U64), off
    enc = flat.dictionary_encode()
    own = enc.dictionary.cast(pa.large_binary()).to_pylist()
    h = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in own), U64, len(own))
    return h[enc.indices.to_numpy()], off


def word_codes(text: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Like ``word_hashes``, from eight bytes of all words at a time (words past
    64 bytes one by one). The two functions' hashes differ."""
    flat, off = split_words(text, lower)
    n = len(flat)
    if n == 0:
        return np.zeros(0, U64), off
    flat = flat.cast(pa.large_string())
    at = np.frombuffer(flat.buffers()[1], np.int64, n + 1, 8 * flat.offset)
    data = np.concatenate([np.frombuffer(flat.buffers()[2], np.uint8, at[-1] - at[0], at[0]), np.zeros(8, np.uint8)])
    start, size = at[:-1] - at[0], np.diff(at)
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    mask = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
    h = mix(mix(size.astype(U64) * _GOLD) + (eight[start] & mask[np.minimum(size, 8)]))
    more = np.flatnonzero(size > 8)
    for k in range(8, 64, 8):
        h[more] = mix(h[more] * _GOLD + (eight[start[more] + k] & mask[np.minimum(size[more] - k, 8)]))
        more = more[size[more] > k + 8]
    for i in more:
        h[i] = xxhash.xxh3_64_intdigest(data[start[i]:start[i] + size[i]])
    return mix(h), off


def gram_hashes(h: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of every k consecutive words (row boundaries are the caller's concern)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.full(n, U64(salt), U64)
    for i in range(k):
        out = mix(out * _GOLD + h[i:i + n])
    return out


def row_of(off: np.ndarray) -> np.ndarray:
    """Row number of every word."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(id, component_id)`` for every vertex of links (a, b); component_id is
    the smallest id. Alternating large-star / small-star rounds (Kiveris et
    al., 2014) over what is left after each partition has replaced its own links
    by a star per component (at most its vertices). No group is collected, each
    round is checkpointed, and the loop ends at a fixed point.
    """
    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = c = np.zeros(0, np.int64)
        for b in batches:
            v, c = min_label_components(np.concatenate([v, b.column(0).to_numpy()]),
                                        np.concatenate([c, b.column(1).to_numpy()]))
        yield pa.RecordBatch.from_arrays([pa.array(v[v != c]), pa.array(c[v != c])], ["hi", "lo"])

    def small(df: DataFrame, rows: int) -> DataFrame:
        """Few rows in few partitions: a round then writes few files."""
        return df.coalesce(max(1, -(-rows // 200_000)))

    def seen(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first())

    e = cut(links.select(F.col("a").alias("hi"), F.col("b").alias("lo")).where("hi <> lo")
            .mapInArrow(stars, "hi long, lo long").distinct())
    last = seen(e)
    e = small(e, last[0])
    for _ in range(max_rounds):
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(least, "u")
                 .select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct())
        small_min = large.groupBy("hi").agg(F.min("lo").alias("m"))
        linked = (large.join(small_min, "hi")
                  .select(F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"),
                          F.col("m").alias("lo"))
                  .where("hi <> lo").distinct())
        e = cut(small(linked, last[0]))
        now = seen(e)
        if now == last:
            tops = e.select(F.col("lo").alias("id"), F.col("lo").alias("component_id")).distinct()
            return e.select(F.col("hi").alias("id"), F.col("lo").alias("component_id")).unionByName(tops)
        last = now
    raise RuntimeError(f"components: no fixed point in {max_rounds} rounds")
