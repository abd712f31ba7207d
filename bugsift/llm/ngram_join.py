r"""N-gram Jaccard join with set-relation skipping.

Words ``[^\x20\x09-\x0D]+`` with A-Z lower-cased; a text's set holds its distinct
five-word shingles (the whole sequence as one shingle below five words, nothing
without words). Two sets link when ``100 * |A & B| >= 75 * |A | B|``.

Exact, after Wang, Qin, Lin, Zhang, Chang (VLDB 2017), as Spark jobs:

1. Equal sets are collapsed to their smallest id, so groups of copies of any
   size cost one vertex.
2. Prefix index. In one global order of shingles (frequent ones last), linked
   sets share a shingle among their first ``n - ceil(0.75 n) + 1``. The order's
   frequent part comes from counts over all texts; it is a bounded table
   (``HOT_MAX``) that steers work and never results.
3. Block skipping. Every index list is cut into blocks of equal (set size,
   position). Size and position alone bound the overlap, so whole block pairs
   are skipped.
4. Answer skipping. Long lists first yield only neighbouring pairs. Once these
   are verified, a set's links follow from those of the similar sets it is
   linked with: pairs inside a component need no check. A round then pairs
   one entry of each component in a list with the set that is in most lists,
   and what still is in different components is paired and verified in full.
5. Components of the verified links (star rounds, checkpointed).
6. All links (``classes``, ``link_pairs``) instead derive a set's answers from
   those of a similar set: in long lists every set is compared with the list's
   heaviest one, and each takes its neighbour with most links as its pivot. With
   the sizes x, y and the differences d, e to one pivot, the difference of two
   sets is between ``|d - e|`` and ``d + e``. Pairs that this makes sure are
   counted by one sort per pivot and never listed. The others of one pivot are
   decided from the differences alone, ``|d| + |e| - 2 |d & e|``, in blocks of
   sets that return a count per set. Pairs of different pivots are verified;
   bitmaps beside the index entries keep impossible ones from becoming rows.

``n_links`` is the number of other rows a row's set links with, copies included.

Nulls and empty texts have no shingles and link with nothing; a null id keeps
its row with a null component. Rows that share an id are one vertex. Ties and
repeated rows change nothing: the component is the smallest id. Other columns
are ignored. Shingles are compared by 64-bit hashes, sets by 128-bit digests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import (U64, components, cut, gram_hashes, mix, partitions, prepare, row_of, text_chunks,
                     word_codes)

WORDS = 5
NUM, DEN = 75, 100
HOT_LEAST = 8             # a shingle in fewer sets is not called frequent
HOT_LOCAL = 3             # copies within one block of sets that are reported
HOT_MAX = 500_000         # bound of the table of frequent shingles (12 bytes each)
HOT_BLOCK = 3_000_000     # shingles counted together in a task
LIST_PAIRS = 8            # lists up to this length are paired at once
HEAD_ROUNDS = 1           # such rounds (odd ones pair neighbours by size instead)
PAIRS_AT_ONCE = 4_000_000
BUCKET_POSTINGS = 400_000
MARK_BYTES = 128          # bitmap beside an index entry
SETS_AT_ONCE = 2048       # sets of a pivot in a block (on average)
NEED_BITS = 1 << 23       # bitmap of the ids whose texts a verification needs (1 MB)
_COLS = "kind int, tok long, a long, b long, size long, pos long"


def shingle_sets(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every row, flat, and row offsets."""
    h, off = word_codes(text, lower=True)
    n = np.diff(off)
    grams = gram_hashes(h, WORDS)
    row = row_of(off)
    keep = np.flatnonzero(off[1:][row[:len(grams)]] - np.arange(len(grams)) >= WORDS)
    tok, own = grams[keep], row[keep]
    few = []
    for k in range(1, WORDS):
        rows = np.flatnonzero(n == k)
        if len(rows):
            out = np.full(len(rows), U64(k), U64)
            for i in range(k):
                out = mix(out * U64(0x9E3779B97F4A7C15) + h[off[rows] + i])
            few.append((out, rows))
    if few:
        tok = np.concatenate([tok, *(x for x, _ in few)])
        own = np.concatenate([own, *(r for _, r in few)])
        order = np.argsort(own, kind="stable")
        tok, own = tok[order], own[order]
    ends = np.searchsorted(own, np.arange(len(n) + 1))
    for a, b in zip(ends[:-1], ends[1:]):
        if b - a > 1:
            tok[a:b].sort()
    new = np.ones(len(tok), bool)
    new[1:] = (tok[1:] != tok[:-1]) | (own[1:] != own[:-1])
    return tok[new], np.concatenate([[0], np.cumsum(new)])[ends]


def overlap_needed(a, b):
    """Least intersection of linked sets of sizes a and b."""
    return -(-NUM * (a + b) // (NUM + DEN))


def prefix_size(n):
    return n - -(-NUM * n // DEN) + 1


def possible(size_a, pos_a, size_b, pos_b):
    """Whether sets that meet first at these positions can still link."""
    left = 1 + np.minimum(size_a - pos_a, size_b - pos_b) - 1
    return ((DEN * np.minimum(size_a, size_b) >= NUM * np.maximum(size_a, size_b))
            & (left >= overlap_needed(size_a, size_b)))


class Hot:
    """Frequent shingles and their counts; a bitmap answers most lookups."""

    def __init__(self, tok: np.ndarray, count: np.ndarray):
        order = np.argsort(tok)
        self.tok, self.count = tok[order], count[order].astype(np.int32)

    def counts(self, tok: np.ndarray) -> np.ndarray:
        out = np.zeros(len(tok), np.int32)
        if len(self.tok) == 0:
            return out
        if not hasattr(self, "seen"):
            self.seen = np.zeros(1 << 22, bool)
            self.seen[self.tok >> U64(42)] = True
        maybe = np.flatnonzero(self.seen[tok >> U64(42)])
        at = np.minimum(np.searchsorted(self.tok, tok[maybe]), len(self.tok) - 1)
        hit = self.tok[at] == tok[maybe]
        out[maybe[hit]] = self.count[at[hit]]
        return out


def hot_shingles(docs: DataFrame) -> Hot:
    """Frequent shingles over all texts (id, text)."""
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(parts):
            tok, n = np.unique(np.concatenate(parts), return_counts=True)
            few = n >= HOT_LOCAL
            return pa.RecordBatch.from_arrays([pa.array(tok[few].view(np.int64)), pa.array(n[few])], ["tok", "n"])
        parts, held = [], 0
        for _, text in text_chunks(batches):
            tok, _ = shingle_sets(text)
            parts.append(tok)
            held += len(tok)
            if held >= HOT_BLOCK:
                yield flush(parts)
                parts, held = [], 0
        if held:
            yield flush(parts)

    found = (docs.mapInArrow(go, "tok long, n long").groupBy("tok").agg(F.sum("n").alias("n"))
             .where(F.col("n") >= HOT_LEAST).orderBy(F.desc("n"), "tok").limit(HOT_MAX).toArrow())
    return Hot(found["tok"].to_numpy().view(U64), found["n"].to_numpy())


def indexed_sets(docs: DataFrame, hot: Hot) -> DataFrame:
    """(id, n, set digest, prefix: first shingles in the global order, packed;
    bits: bitmap of the set's hashes, two to four slots a shingle)."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, text in text_chunks(batches):
            tok, off = shingle_sets(text)
            n = np.diff(off)
            often = shared.value.counts(tok)
            some = np.zeros(len(n), bool)
            some[row_of(off)[often > 0]] = True
            digests, prefixes, bitmaps = [], [], []
            for r, (a, b) in enumerate(zip(off[:-1], off[1:])):
                own = tok[a:b]
                digests.append(xxhash.xxh3_128_digest(own.tobytes()))
                slots = np.zeros(1 << max(6, int(2 * (b - a) - 1).bit_length()), bool)
                slots[own & U64(len(slots) - 1)] = True
                bitmaps.append(np.packbits(slots, bitorder="little").tobytes())
                if a == b:
                    prefixes.append(b"")
                    continue
                if some[r]:
                    own = own[np.lexsort((own, often[a:b]))]
                prefixes.append(own[:prefix_size(b - a)].tobytes())
            yield pa.RecordBatch.from_arrays(
                [cols[0], pa.array(n.astype(np.int64)), pa.array(digests, pa.binary()),
                 pa.array(prefixes, pa.binary()), pa.array(bitmaps, pa.binary())],
                ["id", "n", "digest", "prefix", "bits"])

    return docs.mapInArrow(go, "id long, n long, digest binary, prefix binary, bits binary")


def _pack(buckets: int):
    """Index entries of many sets as one packed row per bucket of shingles."""
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(parts):
            tok, ids, size, pos = (np.concatenate(x) for x in zip(*parts))
            bucket = (mix(tok) % U64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            names, starts = np.unique(bucket[order], return_index=True)
            ends = np.append(starts[1:], len(order))
            packed = [b"".join(x[order[a:b]].tobytes() for x in (tok, ids, size, pos)) for a, b in zip(starts, ends)]
            return pa.RecordBatch.from_arrays([pa.array(names), pa.array(packed, pa.binary())], ["bucket", "packed"])
        parts, held = [], 0
        for b in batches:
            for i, n, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                tok = np.frombuffer(p, U64)
                parts.append((tok, np.full(len(tok), i, np.int64), np.full(len(tok), n, np.int32),
                              np.arange(len(tok), dtype=np.int32)))
                held += len(tok)
                if held >= 1_500_000:
                    yield flush(parts)
                    parts, held = [], 0
        if held:
            yield flush(parts)
    return go


def _unpack(packed: list[bytes]) -> list[np.ndarray]:
    cols: list[list[np.ndarray]] = [[], [], [], []]
    for p in packed:
        n, at = len(p) // 24, 0
        for k, kind in enumerate((np.uint64, np.int64, np.int32, np.int32)):
            cols[k].append(np.frombuffer(p, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return [np.concatenate(c) for c in cols]


def _table(kind, tok, a, b, size, pos) -> pa.Table:
    n = len(a)
    fill = lambda x: pa.array(np.broadcast_to(np.asarray(x, np.int64), n))
    return pa.table({"kind": pa.array(np.full(n, kind, np.int32)), "tok": fill(tok), "a": fill(a), "b": fill(b),
                     "size": fill(size), "pos": fill(pos)})


def _lists(batch: pa.Table) -> pa.Table:
    """Pairs to verify now (kind 0) and entries of long lists (kind 1)."""
    tok, ids, size, pos = _unpack(batch.column("packed").to_pylist())
    order = np.lexsort((ids, tok))
    tok, ids, size, pos = tok[order], ids[order], size[order].astype(np.int64), pos[order].astype(np.int64)
    starts = np.flatnonzero(np.append(True, tok[1:] != tok[:-1]))
    length = np.diff(np.append(starts, len(tok)))
    own = np.repeat(length, length)
    first, second = [], []
    for step in range(1, LIST_PAIRS):
        # entries ``step`` apart: all of a short list, neighbours only in a long one
        i = np.arange(len(tok) - step)
        ok = (tok[i] == tok[i + step]) & ((own[i] <= LIST_PAIRS) if step > 1 else True)
        i = i[ok]
        i = i[possible(size[i], pos[i], size[i + step], pos[i + step]) & (ids[i] != ids[i + step])]
        first.append(ids[i])
        second.append(ids[i + step])
    a, b = np.concatenate(first), np.concatenate(second)
    if len(a):
        a, b = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    long = own > LIST_PAIRS
    return pa.concat_tables([
        _table(0, 0, a, b, 0, 0),
        _table(1, tok[long].view(np.int64), ids[long], 0, size[long], pos[long])])


def _marks(sets: DataFrame) -> DataFrame:
    """(id, marks): a set's bitmap folded or repeated to MARK_BYTES, after the
    bytes of its width and how many of its shingles share a slot."""
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for n, bits in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                x = np.frombuffer(bits, np.uint8)
                if len(x) > MARK_BYTES:
                    x = np.bitwise_or.reduce(x.reshape(-1, MARK_BYTES), axis=0)
                head = np.array([len(x), n - int(np.bitwise_count(x).sum())], np.int64)
                out.append(head.tobytes() + np.tile(x, MARK_BYTES // len(x)).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["id", "marks"])
    return sets.select("id", "n", "bits").mapInArrow(go, "id long, marks binary")


class Marks:
    """Bitmaps of entries: which pairs of them can link."""

    def __init__(self, marks: list[bytes], size: np.ndarray):
        raw = np.frombuffer(b"".join(marks), np.uint8).reshape(len(marks), 16 + MARK_BYTES)
        head = np.ascontiguousarray(raw[:, :16]).view(np.int64)
        self.width, self.twice, self.size = head[:, 0], head[:, 1], size
        self.bits = np.ascontiguousarray(raw[:, 16:]).view(np.uint64)

    def can_link(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Shared slots at the wider bitmap's width, plus what shares a slot within
        that set, bound the intersection."""
        out = np.empty(len(x), bool)
        for lo in range(0, len(x), 1 << 16):
            a, b = x[lo:lo + (1 << 16)], y[lo:lo + (1 << 16)]
            wide = np.maximum(self.width[a], self.width[b])
            both = np.bitwise_count(self.bits[a] & self.bits[b]).sum(axis=1, dtype=np.int64) * wide // MARK_BYTES
            more = np.minimum(np.where(self.width[a] == wide, self.twice[a], 1 << 40),
                              np.where(self.width[b] == wide, self.twice[b], 1 << 40))
            out[lo:lo + (1 << 16)] = both + more >= overlap_needed(self.size[a], self.size[b])
        return out


def _cross(batch: pa.Table) -> pa.Table:
    """Pairs of one list between components (or pivots) that can link. Entries of
    equal size, position and component form a block; whole block pairs are skipped,
    then single pairs by their bitmaps."""
    ids, size, pos, comp = (batch.column(c).to_numpy() for c in ("id", "size", "pos", "comp"))
    order = np.lexsort((ids, comp, pos, size))
    ids, size, pos, comp = ids[order], size[order], pos[order], comp[order]
    marks = Marks(batch.column("marks").take(pa.array(order)).to_pylist(), size)
    starts = np.flatnonzero(np.append(
        True, (size[1:] != size[:-1]) | (pos[1:] != pos[:-1]) | (comp[1:] != comp[:-1])))
    count = np.diff(np.append(starts, len(ids)))
    size, pos, comp = size[starts], pos[starts], comp[starts]
    # later blocks whose size is close enough are a range, as blocks come by size
    last = np.searchsorted(size, DEN * size // NUM, "right")
    found: list[np.ndarray] = []
    lo = 0
    while lo < len(starts):
        reach = np.cumsum(last[lo:] - np.arange(lo, len(starts)))
        hi = lo + max(1, int(np.searchsorted(reach, PAIRS_AT_ONCE, "right")))
        near = last[lo:hi] - np.arange(lo, hi)
        x = np.repeat(np.arange(lo, hi), near)
        y = x + np.arange(near.sum()) - np.repeat(np.cumsum(near) - near, near)
        fit = (comp[x] != comp[y]) & possible(size[x], pos[x], size[y], pos[y])
        x, y = x[fit], y[fit]
        step = 0
        while step < len(x):
            total = np.cumsum(count[x[step:]] * count[y[step:]])
            to = step + max(1, int(np.searchsorted(total, PAIRS_AT_ONCE, "right")))
            u, v = x[step:to], y[step:to]
            n = count[u] * count[v]
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            wide = np.repeat(count[v], n)
            i, j = np.repeat(starts[u], n) + k // wide, np.repeat(starts[v], n) + k % wide
            fit = marks.can_link(i, j)
            a, b = ids[i[fit]], ids[j[fit]]
            found.append(np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1))
            step = to
        lo = hi
    both = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), np.int64)
    both = both[:, both[0] != both[1]]
    return pa.table({"a": pa.array(both[0], pa.int64()), "b": pa.array(both[1], pa.int64())})


def _needed(pairs: DataFrame) -> bytes:
    """Bitmap over hashed ids of the pairs' members; its size is fixed."""
    at = F.pmod(F.xxhash64("id"), F.lit(NEED_BITS))
    ids = pairs.select(F.col("a").alias("id")).distinct().unionByName(pairs.select(F.col("b").alias("id")).distinct())
    rows = (ids.select(at.alias("at"))
            .groupBy(F.floor(F.col("at") / 32768).alias("k"))
            .agg(F.bitmap_construct_agg((F.col("at") % 32768).cast("long")).alias("bits")).collect())
    out = bytearray(NEED_BITS // 8)
    for k, bits in rows:
        out[k * 4096:k * 4096 + len(bits)] = bits
    return bytes(out)


def _wanted(rows: DataFrame, bits, schema: str) -> DataFrame:
    """Rows (id first) whose id the broadcast bitmap holds; few others pass."""
    cols = rows.columns

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.unpackbits(np.frombuffer(bits.value, np.uint8), bitorder="little").astype(bool)
        for b in batches:
            hit = pa.array(bitmap[b.column(len(cols)).to_numpy()])
            yield pa.RecordBatch.from_arrays([c.filter(hit) for c in b.columns[:-1]], cols)
    return rows.withColumn("_at", F.pmod(F.xxhash64("id"), F.lit(NEED_BITS))).mapInArrow(go, schema)


def overlap_at_most(n_a: int, bits_a: bytes, n_b: int, bits_b: bytes) -> int:
    """Upper bound of the intersection: shared slots, plus what shares a slot within a set."""
    x, y = np.frombuffer(bits_a, np.uint8), np.frombuffer(bits_b, np.uint8)
    if len(x) > len(y):
        x = np.bitwise_or.reduce(x.reshape(-1, len(y)), axis=0)
    elif len(y) > len(x):
        y = np.bitwise_or.reduce(y.reshape(-1, len(x)), axis=0)
    both = int(np.bitwise_count(x & y).sum())
    return both + min(n_a - int(np.bitwise_count(x).sum()), n_b - int(np.bitwise_count(y).sum()))


def verified(docs: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link, and the size d of their difference. Bitmaps bound the intersection first
    (losing none), then both texts are compared exactly."""
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(_needed(pairs))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a_id, b_id, n_a, x, n_b, y = (c.to_pylist() for c in b.columns)
            ok = [overlap_at_most(p, u, q, v) >= overlap_needed(p, q) for p, u, q, v in zip(n_a, x, n_b, y)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in b.columns[:2]], ["a", "b"])

    marks = _wanted(sets.select("id", "n", "bits"), bits, "id long, n long, bits binary")
    both = (pairs.join(marks.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b")), "b")
            .join(marks.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a")), "a"))
    pairs = cut(both.select("a", "b", "n_a", "bits_a", "n_b", "bits_b").mapInArrow(bound, "a long, b long").distinct())
    bits = spark.sparkContext.broadcast(_needed(pairs))
    texts = _wanted(docs.select("id", "text"), bits, "id long, text string")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_id, last = None, None
        for cols, text in text_chunks(batches, text=2):
            a, b = cols[0].to_numpy(), cols[1].to_numpy()
            tok_b, off_b = shingle_sets(text)
            # a's text comes sorted by a: each is cut into shingles once per run
            new = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
            tok_a, off_a = shingle_sets(cols[3].take(pa.array(new)).cast(pa.large_string()).fill_null(""))
            ok, d = np.zeros(len(a), bool), np.zeros(len(a), np.int64)
            which = np.searchsorted(new, np.arange(len(a)), "right") - 1
            for r, w in enumerate(which):
                x, y = tok_a[off_a[w]:off_a[w + 1]], tok_b[off_b[r]:off_b[r + 1]]
                if not len(x) or not len(y):
                    continue
                at = np.searchsorted(x, y)
                at[at == len(x)] = 0
                both = int((x[at] == y).sum())
                ok[r] = DEN * both >= NUM * (len(x) + len(y) - both)
                d[r] = len(x) + len(y) - 2 * both
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok]), pa.array(d[ok])], ["a", "b", "d"])

    left = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    both = left.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    return (both.select("a", "b", "text_b", "text_a").sortWithinPartitions("a", "b")
            .mapInArrow(check, "a long, b long, d long").distinct())


def links(docs: DataFrame, sets: DataFrame, every: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Verified links (a, b, d) between representatives of different sets, enough
    to join everything that is joined by links; checkpointed. ``every``: with the
    pivots (id, pivot, diff, slack); the links are the verified ones of different
    pivots and, of one pivot, what slacks and differences decide.

    docs: (id, text); sets: checkpointed rows of ``indexed_sets``."""
    spark = docs.sparkSession
    reps = sets.where("n > 0").groupBy("digest", "n").agg(F.min("id").alias("id"))
    own = sets.join(reps.select("id", "digest"), ["id", "digest"], "left_semi").select("id", "n", "prefix")
    total = sets.agg(F.sum(F.length("prefix"))).first()[0] or 0
    buckets = max(partitions(spark), total // 8 // BUCKET_POSTINGS + 1)
    found = cut(own.mapInArrow(_pack(buckets), "bucket long, packed binary")
                .groupBy("bucket").applyInArrow(_lists, _COLS))
    pairs = cut(found.where("kind = 0").select("a", "b").distinct())
    near = cut(verified(docs, sets, pairs))
    entries = found.where("kind = 1").select("tok", F.col("a").alias("id"), "size", "pos")
    # a set in many long lists holds what its kin have in common
    entries = cut(entries.join(entries.groupBy("id").agg(F.count(F.lit(1)).alias("weight")), "id"))
    done = pairs
    if every:
        # every entry against its list's heaviest one, whose answers then serve the others
        top = entries.groupBy("tok").agg(F.max_by(F.struct("size", "id"), F.struct("weight", "id")).alias("g"))
        ties = cut(entries.join(top, "tok").where("id <> g.id")
                   .where(DEN * F.least("size", "g.size") >= NUM * F.greatest("size", "g.size"))
                   .select(F.least("id", "g.id").alias("a"), F.greatest("id", "g.id").alias("b"))
                   .distinct().join(done, ["a", "b"], "left_anti"))
        if ties.head(1):
            done = cut(done.unionByName(ties))
            near = cut(near.unionByName(verified(docs, sets, ties)))
        pivot = cut(_pivots(near, own))
        rest = _between(_mixed(entries, pivot, "pivot"), sets, done)
        return (cut(near.unionByName(verified(docs, sets, rest))) if rest.head(1) else near), pivot
    for turn in range(HEAD_ROUNDS):
        # answer skipping: what a list's entries are linked to already is known
        mixed = _mixed(entries, components(near), "component_id")
        # one entry of each component in a list ...
        rank = F.struct("weight", "id") if turn % 2 == 0 else F.xxhash64("id", F.lit(turn))
        heads = mixed.groupBy("tok", "comp").agg(F.max_by(F.struct("size", "id", "weight"), rank).alias("h"))
        if turn % 2 == 0:
            # ... against the list's heaviest entry
            top = mixed.groupBy("tok").agg(F.max_by(F.struct("size", "id"), rank).alias("g"))
            ties = heads.join(top, "tok").where("h.id <> g.id")
        else:
            # ... against the next by size
            after = Window.partitionBy("tok").orderBy("h.size", "h.id")
            ties = heads.select("h", F.lead("h").over(after).alias("g")).where("g IS NOT NULL")
        ties = cut(ties.where(DEN * F.least("h.size", "g.size") >= NUM * F.greatest("h.size", "g.size"))
                   .select(F.least("h.id", "g.id").alias("a"), F.greatest("h.id", "g.id").alias("b"))
                   .distinct().join(done, ["a", "b"], "left_anti"))
        if not ties.head(1):
            continue
        done = cut(done.unionByName(ties))
        near = cut(near.unionByName(verified(docs, sets, ties)))
    rest = _between(_mixed(entries, components(near), "component_id"), sets, done)
    return (near.unionByName(verified(docs, sets, rest)) if rest.head(1) else near), None


def _between(mixed: DataFrame, sets: DataFrame, done: DataFrame) -> DataFrame:
    """Pairs between the components (or pivots) of a list that can link and are not done."""
    own = mixed.select("tok", "id", "size", "pos", "comp").join(
        _marks(sets.join(mixed.select("id").distinct(), "id", "left_semi")).dropDuplicates(["id"]), "id")
    return cut(own.repartition(partitions(sets.sparkSession), "tok").groupBy("tok").applyInArrow(_cross, "a long, b long")
               .distinct().join(done, ["a", "b"], "left_anti"))


def _pivots(near: DataFrame, own: DataFrame) -> DataFrame:
    """(id, pivot, diff, slack) of every linked set: its neighbour with most links,
    or itself if none has more. Slacks of two sets of a pivot that add up to at
    most 0 make their link sure."""
    both = near.select(F.col("a").alias("id"), F.col("b").alias("kin"), "d").unionByName(
        near.select(F.col("b").alias("id"), F.col("a").alias("kin"), "d"))
    n = both.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    rated = both.join(n.select(F.col("id").alias("kin"), "n"), "kin").select("id", F.struct(
        "n", (-F.col("kin")).alias("last"), "kin", "d").alias("k"))
    itself = n.select("id", F.struct("n", (-F.col("id")).alias("last"), F.col("id").alias("kin"),
                                     F.lit(0).cast("long").alias("d")).alias("k"))
    best = rated.unionByName(itself).groupBy("id").agg(F.max("k").alias("k"))
    return best.join(own.select("id", "n"), "id").select(
        "id", F.col("k.kin").alias("pivot"), F.col("k.d").alias("diff"),
        ((DEN + NUM) * F.col("k.d") - (DEN - NUM) * F.col("n")).cast("long").alias("slack"))


def _differences(docs: DataFrame, member: DataFrame) -> DataFrame:
    """The rows of member (id, pivot, ...) with ``n``, the set's size, and ``diff``,
    the packed shingles in which it and its pivot differ."""
    pairs = member.select(F.col("pivot").alias("a"), F.col("id").alias("b"))
    bits = docs.sparkSession.sparkContext.broadcast(_needed(pairs))
    texts = _wanted(docs.select("id", "text"), bits, "id long, text string").dropDuplicates(["id"])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, text in text_chunks(batches, text=2):
            a = cols[0].to_numpy()
            tok_b, off_b = shingle_sets(text)
            # a pivot's text is cut into shingles once per run
            new = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
            tok_a, off_a = shingle_sets(cols[3].take(pa.array(new)).cast(pa.large_string()).fill_null(""))
            which = np.searchsorted(new, np.arange(len(a)), "right") - 1
            diff = [np.setxor1d(tok_a[off_a[w]:off_a[w + 1]], tok_b[off_b[r]:off_b[r + 1]], assume_unique=True).tobytes()
                    for r, w in enumerate(which)]
            yield pa.RecordBatch.from_arrays([cols[1], pa.array(np.diff(off_b).astype(np.int64)), pa.array(diff, pa.binary())],
                                             ["id", "n", "diff"])

    both = (pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
            .join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a"))
    return member.join(both.select("a", "b", "text_b", "text_a").sortWithinPartitions("a", "b")
                       .mapInArrow(go, "id long, n long, diff binary"), "id")


def _decided(list_pairs: bool):
    """Links between the sets of two blocks of one pivot that their slacks leave
    open, from their differences to the pivot: rows (a, b), or weighted counts per set."""
    def go(batch: pa.Table) -> pa.Table:
        ids, n, slack, w, block, i, j = (batch.column(c).to_numpy() for c in ("id", "n", "slack", "w", "block", "i", "j"))
        diff = [np.frombuffer(x, U64) for x in batch.column("diff").to_pylist()]
        d = np.array([len(x) for x in diff], np.int64)
        one = np.flatnonzero(block == i[0])
        two = one if i[0] == j[0] else np.flatnonzero(block == j[0])
        # shingles of a single difference are in no intersection
        _, code, times = np.unique(np.concatenate(diff), return_inverse=True, return_counts=True)
        row, often = np.repeat(np.arange(len(d)), d), times[code] > 1
        row, code = row[often], np.unique(code[often], return_inverse=True)[1]
        order = np.argsort(code, kind="stable")
        row, code = row[order], code[order]
        step = 2048
        cuts = np.searchsorted(code, np.arange(0, (code[-1] if len(code) else 0) + step + 1, step))
        count, pairs = np.zeros(len(d), np.int64), []
        for lo in range(0, len(one), 512):
            left = one[lo:lo + 512]
            common = np.zeros((len(left), len(two)), np.float32)
            at = np.full(len(d), -1)
            at[left] = np.arange(len(left))
            to = np.full(len(d), -1)
            to[two] = np.arange(len(two))
            for k, (p, q) in enumerate(zip(cuts[:-1], cuts[1:])):
                x, y = (np.zeros((m, step), np.float32) for m in common.shape)
                for z, place in ((x, at), (y, to)):
                    own = place[row[p:q]]
                    z[own[own >= 0], code[p:q][own >= 0] - k * step] = 1
                common += x @ y.T
            apart = d[left][:, None] + d[two] - 2 * common.astype(np.int64)
            link = (((DEN + NUM) * apart <= (DEN - NUM) * (n[left][:, None] + n[two]))
                    & (slack[left][:, None] + slack[two] > 0))
            if two is one:
                link[np.arange(len(left)), np.arange(lo, lo + len(left))] = False
            else:
                count[two] += w[left] @ link
            count[left] += link @ w[two]
            if list_pairs:
                x, y = np.nonzero(link)
                a, b = ids[left[x]], ids[two[y]]
                pairs.append(np.stack([np.minimum(a, b), np.maximum(a, b)])[:, (a < b) | (two is not one)])
        if list_pairs:
            a, b = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.int64)
            return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
        return pa.table({"rep": pa.array(ids[count > 0], pa.int64()), "n": pa.array(count[count > 0], pa.int64())})
    return go


def _open(docs: DataFrame, pivot: DataFrame, copies: DataFrame, list_pairs: bool) -> DataFrame:
    """Links of one pivot that the slacks leave open: (a, b) or (rep, n)."""
    most = (pivot.groupBy("pivot").agg(F.max("slack").alias("most"))).where("most > 0")
    member = cut(pivot.join(most, "pivot").where("slack + most > 0").join(copies, "id").select("id", "pivot", "slack", "w"))
    own = cut(_differences(docs, member))
    tokens = F.length("diff") / 8
    blocks = own.groupBy("pivot").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / SETS_AT_ONCE), F.ceil(F.sum(tokens) / (512 * SETS_AT_ONCE))).cast("int").alias("k"))
    dealt = own.join(blocks, "pivot").withColumn("block", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    # a block meets every block of its pivot, itself included
    meet = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select(
        "pivot", "id", "n", "slack", "w", "diff", "block", F.least("block", "other").alias("i"),
        F.greatest("block", "other").alias("j"))
    return meet.groupBy("pivot", "i", "j").applyInArrow(
        _decided(list_pairs), "a long, b long" if list_pairs else "rep long, n long")


def _listed(found: DataFrame, pivot: DataFrame) -> DataFrame:
    """The links (a, b) that are not of one pivot: those follow from its differences."""
    side = lambda x: pivot.select(F.col("id").alias(x), F.col("pivot").alias(f"p_{x}"))
    return (found.join(side("a"), "a", "left").join(side("b"), "b", "left")
            .where(~F.coalesce(F.col("p_a") == F.col("p_b"), F.lit(False))).select("a", "b"))


def _link_counts(docs: DataFrame, found: DataFrame, pivot: DataFrame, copies: DataFrame) -> DataFrame:
    """(rep, n_links) of the representatives that link with other sets; copies: (id, w)."""
    listed = _listed(found, pivot)
    both = listed.select(F.col("a").alias("rep"), F.col("b").alias("id")).unionByName(
        listed.select(F.col("b").alias("rep"), F.col("a").alias("id")))
    one = both.join(copies, "id").select("rep", F.col("w").alias("n"))
    # sure ones: copies of the sets of a pivot with slacks up to the own one's negative; a
    # row per pivot and distinct slack
    held = pivot.join(copies, "id")
    sums = cut(held.groupBy("pivot", "slack").agg(F.sum("w").alias("w")))
    asked = sums.select("pivot", (-F.col("slack")).alias("at"), F.lit(0).cast("long").alias("w"), F.col("slack"))
    line = sums.select("pivot", F.col("slack").alias("at"), "w", F.lit(None).cast("long").alias("slack")).unionByName(asked)
    upto = (line.withColumn("sure", F.sum("w").over(Window.partitionBy("pivot").orderBy("at")))
            .where("slack IS NOT NULL").select("pivot", "slack", "sure"))
    two = held.join(upto, ["pivot", "slack"]).select(
        F.col("id").alias("rep"), (F.col("sure") - F.when(F.col("slack") <= 0, F.col("w")).otherwise(0)).alias("n"))
    three = _open(docs, pivot, copies, list_pairs=False)
    return one.unionByName(two).unionByName(three).groupBy("rep").agg(F.sum("n").alias("n_links"))


def link_pairs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every link (a, b), a < b, between the smallest ids of different sets."""
    prepare(docs.sparkSession)
    named = (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
             .where("id IS NOT NULL"))
    found, pivot = links(named, cut(indexed_sets(named, hot_shingles(named))), every=True)
    one, two = (pivot.select(F.col("id").alias(x), "pivot", F.col("slack").alias(f"s_{x}")) for x in "ab")
    sure = one.join(two, "pivot").where("a < b AND s_a + s_b <= 0").select("a", "b")
    alone = pivot.select("id", F.lit(1).cast("long").alias("w"))
    return _listed(found, pivot).unionByName(sure).unionByName(_open(named, pivot, alone, list_pairs=True))


def _mixed(entries: DataFrame, comp: DataFrame, name: str) -> DataFrame:
    """Entries, with their components (or pivots), of the lists that hold more than one."""
    own = entries.join(comp.select("id", name), "id", "left").select(
        "tok", "id", "size", "pos", "weight", F.coalesce(name, "id").alias("comp"))
    lists = (own.groupBy("tok").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi"))
             .where("_lo <> _hi").select("tok"))
    return own.join(lists, "tok")


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", count_links: bool = True) -> DataFrame:
    """(id, n_shingles, component_id, rep_id, n_links) for every row; rep_id is the
    smallest id with the same set. Without ``count_links`` only the links that
    components need are verified, and n_links is left out."""
    prepare(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    named = own.where("id IS NOT NULL")
    sets = cut(indexed_sets(named, hot_shingles(named)))
    found, pivot = links(named, sets, every=count_links)
    comp = components(found)
    slim = sets.select("id", "n", "digest")
    reps = slim.where("n > 0").groupBy("digest", "n").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("w"))
    member = slim.join(reps, ["digest", "n"], "left").select("id", "n", "w", F.coalesce("rep", "id").alias("rep"))
    # rows that share an id belong together, whatever their texts
    shared = member.groupBy("id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi")
    if shared.head(1):
        more = member.join(shared.select("id"), "id").select(F.col("id").alias("a"), F.col("rep").alias("b"))
        comp = components(comp.select(F.col("id").alias("a"), F.col("component_id").alias("b")).unionByName(more))
    out = member.join(comp.select(F.col("id").alias("rep"), "component_id"), "rep", "left")
    cols = [F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
            F.coalesce("component_id", "rep").alias("component_id"), F.col("rep").alias("rep_id")]
    if count_links:
        counted = _link_counts(named, found, pivot, reps.select(F.col("rep").alias("id"), "w"))
        out = out.join(counted, "rep", "left")
        cols.append((F.coalesce("n_links", F.lit(0)) + F.coalesce(F.col("w") - 1, F.lit(0))).alias("n_links"))
    out = out.select(cols)
    unnamed = own.where("id IS NULL")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, text in text_chunks(batches):
            n = np.diff(shingle_sets(text)[1]).astype(np.int64)
            none = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(n), none, none, pa.array(np.zeros(len(n), np.int64))],
                                             [id_col, "n_shingles", "component_id", "rep_id", "n_links"])
    return out.unionByName(unnamed.mapInArrow(
        count, f"`{id_col}` long, n_shingles long, component_id long, rep_id long, n_links long").select(out.columns))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows (all columns) that are the smallest id of their component. Rows
    with a null id stay; of rows that share an id all stay or none."""
    prepare(docs.sparkSession)
    name = "_gone"
    while name in map(str.lower, docs.columns):
        name += "_"
    gone = (classes(docs, id_col=id_col, text_col=text_col, count_links=False)
            .where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(name)).distinct())
    return docs.join(gone, F.col(id_col) == F.col(name), "left_anti")
