r"""Substring dedup: words covered by a 13-word window that also starts in a
document with a smaller id are removed.

Words are ``[^\x20\x09-\x0D]+``, unchanged. Windows are judged on the input.

1. Count-min sketch. Every task writes, per block of documents, which counters
   its windows fall on, as two sparse bitmaps cut into shards (hit by one
   document, hit by two or more). Merging shard by shard gives the counters
   reached from two documents or more: a window's count is never
   underestimated, so nothing repeated is lost. The width follows the number of
   windows up to ``MAX_COUNTERS`` (64 MB as a bitmap); past that the filter
   lets more windows through and results stay the same.
2. Exact pass over the windows whose counter was reached twice. Within a block
   of documents a window is sent once, for the smallest id that has it: the
   block's other documents are decided there and then, so a passage found in a
   third of all documents costs one entry per block. Buckets of windows then
   find the smallest id of all and report the positions that others have.
3. Positions come together per document and the words under them are dropped.

Windows are compared by 80-bit hashes. Nulls and empty texts have no words;
texts under 13 words lose none. A null id is never smaller than another, and
its row keeps all words. Rows that share an id count as one document: a window
is not removed for standing in another row of its own id, and the positions
found for an id apply to each of its rows. Empty tables give no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, cut, gram_hashes, mix, partitions, prepare, row_of, split_words, text_chunks, word_hashes
from .ngram_join import NEED_BITS, _needed

WINDOW = 13
MAX_COUNTERS = 1 << 29
MIN_COUNTERS = 1 << 20
PER_WINDOW = 4            # counters per window, up to the bound
SHARD_BITS = 22           # counters of one shard (a bitmap of 512 KB)
BLOCK = 3 << 20           # bytes of text judged together in a task
BUCKET_ENTRIES = 1_500_000


def windows(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, second hash, row, first word within the row) of every window."""
    h, off = word_hashes(text, lower=False)
    grams = gram_hashes(h, WINDOW)
    row = row_of(off)
    keep = np.flatnonzero(off[1:][row[:len(grams)]] - np.arange(len(grams)) >= WINDOW)
    first = grams[keep]
    # 16 more bits from a sum over the same words under another mixing
    other = mix(h * U64(0xD6E8FEB86659FD93) + U64(0x2545F4914F6CDD1D))
    run = np.concatenate([[U64(0)], np.cumsum(other * np.arange(1, len(h) + 1, dtype=U64))])
    plain = np.concatenate([[U64(0)], np.cumsum(other)])
    at = keep.astype(U64)
    second = (run[keep + WINDOW] - run[keep]) - at * (plain[keep + WINDOW] - plain[keep])
    return first, (mix(second) >> U64(48)).astype(np.uint16), row[keep], keep - off[row[keep]]


def _ids(col: pa.Array) -> np.ndarray:
    return pc.fill_null(col, 0).to_numpy(zero_copy_only=False).astype(np.int64)


def windows_about(docs: DataFrame) -> int:
    """Estimate of the number of windows from the length of all texts."""
    return int(docs.agg(F.sum(F.length("text") / 6)).first()[0] or 0)


def width_for(n_windows: int) -> int:
    """Counters of the sketch: a power of two, bounded."""
    width = MIN_COUNTERS
    while width < min(PER_WINDOW * n_windows, MAX_COUNTERS):
        width *= 2
    return width


def sketch(docs: DataFrame, width: int) -> bytes:
    """Bitmap of the counters that windows of two or more documents reach."""
    prepare(docs.sparkSession)
    shard_size = min(1 << SHARD_BITS, width)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, text in text_chunks(batches, limit=BLOCK):
            hashes, _, row, _ = windows(text)
            doc = _ids(cols[0])[row]
            slot = (hashes & U64(width - 1)).astype(np.int64)
            order = np.lexsort((doc, slot)) if len(slot) else np.zeros(0, np.int64)
            slot, doc = slot[order], doc[order]
            new = np.append(True, slot[1:] != slot[:-1])[:len(slot)]
            start = np.flatnonzero(new)
            end = np.append(start[1:], len(slot)) - 1
            twice = doc[start] != doc[end] if len(start) else np.zeros(0, bool)
            slot = slot[start]
            shard = slot // shard_size
            names, at = np.unique(shard, return_index=True)
            packed = []
            for k, a, b in zip(names, at, np.append(at[1:], len(slot))):
                gaps = np.diff(slot[a:b], prepend=k * shard_size)
                packed.append(_vary(gaps) + np.packbits(twice[a:b]).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names), pa.array(np.diff(np.append(at, len(slot)))), pa.array(packed, pa.binary())],
                ["shard", "n", "packed"])

    def merge(batch: pa.Table) -> pa.Table:
        once = np.zeros(shard_size, bool)
        more = np.zeros(shard_size, bool)
        for n, p in zip(batch.column("n").to_pylist(), batch.column("packed").to_pylist()):
            gaps, used = _unvary(p, n)
            slot = np.cumsum(gaps, dtype=np.int64)
            twice = np.unpackbits(np.frombuffer(p, np.uint8, offset=used), count=n).astype(bool)
            more[slot[twice | once[slot]]] = True
            once[slot] = True
        return pa.table({"shard": batch.column("shard").slice(0, 1),
                         "bits": pa.array([np.packbits(more, bitorder="little").tobytes()], pa.binary())})

    parts = (docs.select("id", "text").mapInArrow(partial, "shard long, n long, packed binary")
             .groupBy("shard").applyInArrow(merge, "shard long, bits binary"))
    out = bytearray(width // 8)
    size = shard_size // 8
    for shard, bits in parts.toLocalIterator():
        out[shard * size:(shard + 1) * size] = bits
    return bytes(out)


def _vary(gaps: np.ndarray) -> bytes:
    """16-bit steps; a 0xFFFF step only adds up."""
    big = gaps // 0xFFFF
    out = np.zeros(len(gaps) + int(big.sum()), np.uint16)
    ends = np.arange(len(gaps)) + np.cumsum(big)
    out[:] = 0xFFFF
    out[ends] = gaps % 0xFFFF
    return out.tobytes()


def _unvary(packed: bytes, n: int) -> tuple[np.ndarray, int]:
    """The first n gaps and the bytes they took."""
    steps = np.frombuffer(packed, np.uint16, count=(len(packed) - -(-n // 8)) // 2)
    total = np.cumsum(steps, dtype=np.int64)
    ends = total[steps != 0xFFFF]
    return np.diff(ends, prepend=0), len(steps) * 2


def _pack_places(doc: np.ndarray, pos: np.ndarray) -> bytes:
    ids, number = np.unique(doc, return_inverse=True)
    return b"".join(x.tobytes() for x in (np.array([len(doc), len(ids)], np.uint64), ids.astype(np.int64),
                                          number.astype(np.uint32), pos.astype(np.uint32)))


def _unpack_places(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, n_ids = np.frombuffer(packed, np.uint64, 2).tolist()
    ids = np.frombuffer(packed, np.int64, n_ids, 16)
    number, pos = np.frombuffer(packed, np.uint32, 2 * n, 16 + 8 * n_ids).reshape(2, n)
    return ids[number], pos


def _by_group(doc: np.ndarray, pos: np.ndarray, groups: int) -> tuple[list[int], list[bytes]]:
    """Window starts to remove, packed for each group of documents."""
    group = (mix(doc.view(U64)) % U64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    doc, pos = doc[order], pos[order]
    names, at = np.unique(group[order], return_index=True)
    return names.tolist(), [_pack_places(doc[a:b], pos[a:b]) for a, b in zip(at, np.append(at[1:], len(doc)))]


def _pack(first: np.ndarray, second: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> bytes:
    """Entries as columns, ids by number in a table of their own, small numbers in 16 bits."""
    ids, number = np.unique(doc, return_inverse=True)
    wide = [len(ids) > 0xFFFF, bool(len(pos)) and int(pos.max()) > 0xFFFF]
    head = np.array([len(first), len(ids), *wide], np.uint32)
    kind = [np.uint32 if w else np.uint16 for w in wide]
    return b"".join(x.tobytes() for x in (head, ids, first, second, number.astype(kind[0]), pos.astype(kind[1])))


def _unpack(packed: bytes) -> list[np.ndarray]:
    n, n_ids, *wide = np.frombuffer(packed, np.uint32, 4).tolist()
    out, at = [], 16
    for count, kind in ((n_ids, np.int64), (n, np.uint64), (n, np.uint16),
                        *((n, np.uint32 if w else np.uint16) for w in wide)):
        out.append(np.frombuffer(packed, kind, count, at))
        at += count * np.dtype(kind).itemsize
    ids, first, second, number, pos = out
    return [first, second, ids[number], pos.astype(np.uint32)]


def removals(docs: DataFrame, bits: bytes, width: int, buckets: int) -> DataFrame:
    """(id, starts): packed window starts to remove, one row per id that loses some.
    A bucket of windows sends one packed row to each of a limited number of groups of
    documents, in which the starts of a document come together."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(bits)
    groups = max(partitions(spark), buckets // 8)

    def flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.frombuffer(shared.value, np.uint8)
        for cols, text in text_chunks(batches, limit=BLOCK):
            first, second, row, pos = windows(text)
            named = pc.is_valid(cols[0]).to_numpy(zero_copy_only=False)
            slot = first & U64(width - 1)
            hit = (seen[slot >> U64(3)] >> (slot & U64(7)).astype(np.uint8)) & 1
            take = np.flatnonzero(hit.astype(bool) & named[row])
            doc = _ids(cols[0])[row[take]]
            first, second, pos = first[take], second[take], pos[take]
            order = np.lexsort((doc, second, first))
            first, second, doc, pos = first[order], second[order], doc[order], pos[order]
            new = np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1]))[:len(first)]
            least = doc[np.flatnonzero(new)][np.cumsum(new) - 1] if len(doc) else doc
            here = doc > least             # a smaller id of this very block has the window
            out_bucket, out_kind, out_packed = [], [], []
            own_doc, own_pos = doc[here], pos[here]
            for g, places in zip(*_by_group(own_doc, own_pos, groups)):
                out_bucket.append(g % buckets)
                out_kind.append(g)
                out_packed.append(places)
            decided = len(out_packed)
            first, second, doc, pos = (x[~here] for x in (first, second, doc, pos))
            bucket = (mix(first) % U64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            names, at = np.unique(bucket[order], return_index=True)
            for k, a, b in zip(names, at, np.append(at[1:], len(order))):
                own = order[a:b]
                out_bucket.append(int(k))
                out_kind.append(0)
                out_packed.append(_pack(first[own], second[own], doc[own], pos[own]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(out_bucket, pa.int64()), pa.array([True] * decided + [False] * (len(out_packed) - decided), pa.bool_()),
                 pa.array(out_kind, pa.int64()), pa.array(out_packed, pa.binary())],
                ["bucket", "decided", "id", "packed"])

    def judge(batch: pa.Table) -> pa.Table:
        decided = batch.column("decided").to_numpy(zero_copy_only=False).astype(bool)
        ready = batch.filter(pa.array(decided))
        cols = list(zip(*(_unpack(p) for p in batch.filter(pa.array(~decided)).column("packed").to_pylist())))
        ids, packed = ready.column("id").to_pylist(), ready.column("packed").to_pylist()
        if cols:
            first, second, doc, pos = map(np.concatenate, cols)
            order = np.lexsort((doc, second, first))
            first, second, doc, pos = first[order], second[order], doc[order], pos[order]
            new = np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1]))
            gone = doc > doc[np.flatnonzero(new)][np.cumsum(new) - 1]
            more = _by_group(doc[gone], pos[gone], groups)
            ids, packed = ids + more[0], packed + more[1]
        return pa.table({"group": pa.array(ids, pa.int64()), "packed": pa.array(packed, pa.binary())})

    def together(batch: pa.Table) -> pa.Table:
        doc, pos = map(np.concatenate, zip(*(_unpack_places(p) for p in batch.column("packed").to_pylist())))
        order = np.lexsort((pos, doc))
        doc, pos = doc[order], pos[order]
        names, at = np.unique(doc, return_index=True)
        return pa.table({"id": pa.array(names, pa.int64()),
                         "starts": pa.array([pos[a:b].tobytes() for a, b in zip(at, np.append(at[1:], len(doc)))], pa.binary())})

    return (docs.select("id", "text").mapInArrow(flagged, "bucket long, decided boolean, id long, packed binary")
            .groupBy("bucket").applyInArrow(judge, "group long, packed binary")
            .groupBy("group").applyInArrow(together, "id long, starts binary"))


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_text, kept_sha256) of every row; kept words
    are joined by one blank."""
    prepare(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    n = windows_about(own)
    width = width_for(n)
    buckets = max(partitions(docs.sparkSession), n // BUCKET_ENTRIES)
    gone = cut(removals(own, sketch(own, width), width, buckets))
    starts = gone.select("id", F.array("starts").alias("starts"))
    # only documents that lose something (a fixed-size bitmap says which may) meet their
    # positions in a join; the others are finished where they are read
    bits = docs.sparkSession.sparkContext.broadcast(
        _needed(gone.select(F.col("id").alias("a"), F.col("id").alias("b"))))
    slot = F.pmod(F.xxhash64("id"), F.lit(NEED_BITS)).alias("slot")

    def split(keep: bool):
        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bitmap = np.unpackbits(np.frombuffer(bits.value, np.uint8), bitorder="little").astype(bool)
            for b in batches:
                hit = pa.array(bitmap[b.column(2).to_numpy()] == keep)
                yield pa.RecordBatch.from_arrays([c.filter(hit) for c in b.columns[:2]], ["id", "text"])
        return own.select("id", "text", slot).mapInArrow(go, "id long, text string")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, text in text_chunks(batches):
            flat, off = split_words(text, lower=False)
            drop = np.zeros(len(flat) + 1, np.int64)
            for r, parts in enumerate(cols[2].to_pylist()):
                if parts:
                    at = np.unique(np.concatenate([np.frombuffer(p, np.uint32) for p in parts])).astype(np.int64)
                    at = at[at + WINDOW <= off[r + 1] - off[r]] + off[r]
                    np.add.at(drop, at, 1)
                    np.add.at(drop, at + WINDOW, -1)
            stay = np.cumsum(drop[:-1]) == 0
            kept = np.concatenate([[0], np.cumsum(stay)])[off]
            n, n_kept = np.diff(off), np.diff(kept)
            rows = pa.LargeListArray.from_arrays(pa.array(kept), flat.filter(pa.array(stay)))
            texts = pc.binary_join(rows, pa.scalar(" ", pa.large_string()))
            sha = [hashlib.sha256(t).hexdigest() for t in texts.cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [cols[0], pa.array(n), pa.array(n - n_kept), texts.cast(pa.string()), pa.array(sha, pa.string())],
                [id_col, "n_words", "n_removed", "kept_text", "kept_sha256"])

    schema = f"`{id_col}` long, n_words long, n_removed long, kept_text string, kept_sha256 string"
    whole = split(False).withColumn("starts", F.lit(None).cast("array<binary>"))
    return split(True).join(starts, "id", "left").select("id", "text", "starts").mapInArrow(apply, schema).unionByName(
        whole.mapInArrow(apply, schema))
