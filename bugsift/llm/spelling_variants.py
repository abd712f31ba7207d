r"""Grouping of spelling variants: words one inserted, deleted or replaced code
point apart, found through an index of variable-length grams.

1. Dictionary. Grams of ``QMIN`` to ``qmax`` code points of the words (between
   two end marks) are counted; those in more than ``cutoff`` places stay. The
   cutoff grows with the words so that at most ``MAX_GRAMS`` grams stay
   (a proven bound: counts add up to the places), which are then broadcast.
2. Decomposition. At every start the gram grows while the dictionary calls it
   frequent, so frequent short grams become rarer long ones. A gram is decided by
   the code points inside it alone: an edit at code point i touches exactly the
   grams that cover i, the others stay, at the same start or (behind an inserted
   code point) one further. Words of c code points and the words one longer meet
   through grams of at most half the marked word, so a word has one decomposition
   for its own length and one for the words one shorter.
3. Merging. The bound on affected grams says which lists must be merged: of a set
   of grams of which one edit touches at most ``a``, ``size - a`` are shared. Two
   grams without a common code point have ``a`` = 1, so each word merges the lists
   of the rarest such two and meets every word one edit away in one of them. Lists
   are keyed by (gram, length, start), every gram of every word is in one.
4. Verification by edit distance.

Each word's form is its near word of largest count
(ties: smallest in code-point order) if that is at least ``ratio`` times its own;
forms at least double the count, so chains are short and end: the root is found by
pointer jumping.

Null texts have no words, texts without letters none; a null id leaves its words
unchanged. Repeated rows count again, ties go by code-point order, very long
texts are taken whole, empty tables give no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions, prepare, text_chunks, trim

QMIN = 2
QMAX = 9
MIN_LENGTH = 5
MIN_CODE_POINTS = 3
MIN_PLACES = 32
MAX_GRAMS = 200_000
HEAD, TAIL = "\x02", "\x03"


def corpus_words(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
                 min_count: int = 3, slip_every: int | None = None) -> DataFrame:
    """(word, n): runs of letters (A-Z, a-z, U+00C0 to U+00FF) of whole texts, A-Z
    lower-cased, of at least ``min_length`` code points and ``min_count`` places.
    With ``slip_every`` a run loses one code point where that divides h = crc32 of
    ``<id>:<run>``: the one at h % length."""
    prepare(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, text in text_chunks(batches):
            yield _count_runs(cols[0].to_pylist(), text, min_length, slip_every)

    return (docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= min_count))


def _crc32_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc32_table()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0xC3] = True        # U+00C0 to U+00FF are C3 and one more byte
LONG_RUN = 64


def _crc_of_runs(ids: list[str | None], row: np.ndarray, low: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """crc32 of ``<id>:<run>`` of every run, byte by byte over all runs at once."""
    first = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
    order = np.argsort(-size, kind="stable")
    state, at, n = ~first[row[order]], start[order], size[order]
    for j in range(min(LONG_RUN, int(size.max(initial=0)))):
        k = int(np.searchsorted(-n, -j, "left"))
        own = state[:k]
        state[:k] = _CRC[(own ^ low[at[:k] + j]) & np.uint32(255)] ^ (own >> np.uint32(8))
    out = np.empty(len(size), np.uint32)
    out[order] = ~state
    for r in np.flatnonzero(size > LONG_RUN):
        out[r] = zlib.crc32(low[start[r]:start[r] + size[r]].tobytes(), int(first[row[r]]))
    return out


def _count_runs(ids: list[str | None], text: pa.Array, min_length: int, slip_every: int | None) -> pa.RecordBatch:
    off = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
    data = text.buffers()[2]
    raw = (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[off[0]:off[-1]]
    off = off - off[0]
    letter = _LETTER[raw]
    two = raw == 0xC3
    letter[1:] |= two[:-1]
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    before, after = np.ones(len(raw), bool), np.ones(len(raw), bool)
    before[1:], after[:-1] = ~letter[:-1], ~letter[1:]
    start = np.flatnonzero(letter & (before | edge[:-1]))
    end = np.flatnonzero(letter & (after | edge[1:])) + 1
    pairs = np.concatenate([[0], np.cumsum(two)])
    points = end - start - (pairs[end] - pairs[start])
    ok = points >= min_length
    start, end, points = start[ok], end[ok], points[ok]
    low = _LOWER[raw]
    slipped: Counter = Counter()
    if slip_every and len(start):
        row = np.searchsorted(off, start, "right") - 1
        h = _crc_of_runs(ids, row, low, start, end - start)
        named = np.array([i is not None for i in ids])
        slip = (h % np.uint32(slip_every) == 0) & named[row]
        for r in np.flatnonzero(slip & (points > min_length)):
            s, k = low[start[r]:end[r]].tobytes().decode(), int(h[r]) % int(points[r])
            slipped[s[:k] + s[k + 1:]] += 1
        start, end = start[~slip], end[~slip]
    size = end - start
    ends = np.concatenate([[0], np.cumsum(size)])
    flat = low[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])]
    runs = pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(flat)])
    found = runs.value_counts()
    return pa.RecordBatch.from_arrays(
        [pa.concat_arrays([found.field(0).cast(pa.string()), pa.array(list(slipped), pa.string())]),
         pa.concat_arrays([found.field(1), pa.array(slipped.values(), pa.int64())])], ["word", "n"])


def gram_dictionary(words: DataFrame, qmax: int = QMAX) -> dict[str, int]:
    """Frequent grams and their counts, at most ``MAX_GRAMS``."""
    size = F.length("word") + 2
    places = words.agg(F.sum(sum((F.greatest(size - q + 1, F.lit(0)) for q in range(QMIN, qmax + 1)), F.lit(0)))).first()[0] or 0
    cutoff = max(MIN_PLACES, -(-places // MAX_GRAMS))

    def rows(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["g", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for w in b.column(0).to_pylist():
                s = HEAD + w + TAIL
                end = len(s)
                seen.update([s[p:p + q] for q in range(QMIN, min(qmax, end) + 1) for p in range(end - q + 1)])
                if len(seen) >= 200_000:
                    yield rows(seen)
                    seen = Counter()
        yield rows(seen)
        trim()

    return {r["g"]: r["n"] for r in words.select("word").mapInArrow(count, "g string, n long").groupBy("g")
            .agg(F.sum("n").alias("n")).where(F.col("n") > cutoff).collect()}


def decompose(word: str, known: dict[str, int], qmax: int) -> list[str]:
    """The gram of every start of the marked word."""
    s = HEAD + word + TAIL
    end, out = len(s), []
    for p in range(end - QMIN + 1):
        q = p + QMIN
        while q < end and q - p < qmax and s[p:q] in known:
            q += 1
        out.append(s[p:q])
    return out


def affected(grams: list[str], starts: list[int]) -> int:
    """The most of the grams at ``starts`` that one edit can touch: an edit at a
    code point touches the grams that cover it, an insertion no more than that."""
    return max(sum(p <= i < p + len(grams[p]) for p in starts) for i in range(1, len(grams)))


def lists_to_merge(grams: list[str], known: dict[str, int]) -> list[int]:
    """Starts of the grams whose lists hold every word one edit away: fewest
    places among the sets of two of which an edit touches at most one."""
    cost = [known.get(g, 0) for g in grams]
    behind = [len(grams) - 1] * len(grams)        # cheapest start at or behind each start
    for p in range(len(grams) - 2, -1, -1):
        behind[p] = p if cost[p] <= cost[behind[p + 1]] else behind[p + 1]
    best = min((cost[p] + cost[behind[p + len(g)]], p, behind[p + len(g)])
               for p, g in enumerate(grams) if p + len(g) < len(grams))
    return [best[1], best[2]]


def near_pairs(words: DataFrame, *, qmax: int = QMAX) -> DataFrame:
    """Pairs (a, b) of the distinct words of ``words`` exactly one insertion,
    deletion or replacement apart; (b, a) is not listed again."""
    spark = words.sparkSession
    prepare(spark)
    words = words.select("word").repartition(partitions(spark))      # few bytes, much work for each
    known = spark.sparkContext.broadcast(gram_dictionary(words, qmax))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = known.value
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                word, side, size, start, code, merge = [], [], [], [], [], []
                for w in b.column(0).slice(lo, 2000).to_pylist():
                    n = len(w)
                    for kind, c in ((0, n), (1, n - 1)):
                        if c < MIN_CODE_POINTS:
                            continue
                        found = decompose(w, own, min((c + 2) // 2, qmax))
                        chosen = () if kind else lists_to_merge(found, own)
                        word += [w] * len(found)
                        side += [kind] * len(found)
                        size += [c] * len(found)
                        start += range(len(found))
                        code += [xxhash.xxh64_intdigest(g) >> 1 for g in found]
                        merge += [p in chosen for p in range(len(found))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(word, pa.string()), pa.array(side, pa.int8()), pa.array(size, pa.int32()),
                     pa.array(start, pa.int32()), pa.array(code, pa.int64()), pa.array(merge, pa.bool_())],
                    ["word", "side", "size", "start", "code", "merge"])
        trim()

    lists = cut(words.mapInArrow(
        index, "word string, side byte, size int, start int, code long, merge boolean"))
    here = F.xxhash64("code", "size", "start")
    # a word one code point longer holds the gram at the same start or one further
    wanted = F.array(F.struct(F.xxhash64(here, F.lit(0)).alias("key")), F.struct(F.xxhash64(here, F.lit(1)).alias("key")),
                     F.struct(F.xxhash64(F.xxhash64("code", "size", F.col("start") + 1), F.lit(1)).alias("key")))
    probes = lists.where("merge").select(F.col("word").alias("b"), F.inline(wanted))
    found = lists.select(F.xxhash64(here, F.col("side").cast("int")).alias("key"), F.col("word").alias("a")).join(probes, "key")
    # equal lengths are met from both ends, so one of them may be left out
    return (found.where((F.length("a") > F.length("b")) | (F.col("a") > F.col("b")))
            .where(F.levenshtein("a", "b", 1) == 1).select("a", "b").distinct())


def forms(words: DataFrame, pairs: DataFrame, *, ratio: int = 2) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of (word, n)."""
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other")))
    beside = both.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = beside.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"),
                                      F.min(F.struct((-F.col("other_n")).alias("m"), "other")).alias("best"))
    ok = -F.col("best.m") >= ratio * F.col("n")
    rows = cut(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(ok, F.col("best.other")).alias("form"), F.when(ok, -F.col("best.m")).alias("form_n")))
    step = cut(rows.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    for _ in range(8):                # counts double along a chain: 2 ** 6 steps reach beyond 64 bits
        further = step.join(step.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        moved = cut(further.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("more")))
        step = moved.select("word", "root")
        if not moved.where("more").head(1):
            break
    else:
        raise RuntimeError("spelling variants: a chain of forms does not end")
    return rows.join(step, "word", "left").select("word", "n", "n_near", "form", "form_n",
                                                  F.coalesce("root", "word").alias("root"))


def variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", slip_every: int | None = None,
             min_length: int = MIN_LENGTH, min_count: int = 3, ratio: int = 2) -> DataFrame:
    """Words of the corpus with their near words, forms and roots."""
    if min_length < MIN_CODE_POINTS:
        raise ValueError(f"words of at least {MIN_CODE_POINTS} code points")
    prepare(docs.sparkSession)
    words = cut(corpus_words(docs, id_col=id_col, text_col=text_col, min_length=min_length, min_count=min_count,
                             slip_every=slip_every))
    return forms(words, near_pairs(words), ratio=ratio)
