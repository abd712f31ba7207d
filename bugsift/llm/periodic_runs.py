r"""Runs of periodic words in a text, and the text without their repetitions.

A run is a longest stretch of words with smallest period q (words q apart are
equal) of at least ``max(MIN_WORDS, REPEATS * q)`` words. Inside one text:

1. Suffixes are sorted by prefix doubling; every round's ranks are kept, so the
   longest common prefix (LCP) of neighbours is read off them exactly. Only texts
   in which some ``least_shared`` words come twice are sorted: others hold no run.
2. Kruskal by falling LCP: neighbours in suffix order are united with union-find;
   a class keeps its positions in order, the smaller class goes into the larger.
   Positions p < p' that become adjacent while the LCP is l share exactly l words,
   so words from p on repeat with period d = p' - p for l + d words: a seed if that
   is long enough. At the first word of a run with period q its position and the one
   q further share ``length - q`` words, and no other position of their class lies
   between (it would make a smaller period), so every run is seeded there.
3. A seed counts if the word before it breaks the period. Pairs that are adjacent
   only until the end of their level can name a multiple of the period: of one
   stretch the smallest period stays.

Nulls and empty texts have no words and no runs; ties need no order, since a
stretch has one smallest period; repeated rows have equal results; very long texts
are taken whole (ranks of one text are what a task holds beyond its chunk); empty
tables give no rows. Null ids stay null.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .common import gram_hashes, mix, prepare, row_of, split_words, text_chunks

MIN_WORDS = 6
REPEATS = 4
CHUNK = 3 << 20
SORT_WORDS = 200_000
WORDS = r"[^\x20\x09-\x0D]+"


def suffix_order(words: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in suffix order (row by row, the end of a row behind every word) and
    the LCP of each with the next one."""
    n = len(words)
    key = row * (int(words.max(initial=0)) + 1) + words
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)

    def group(slots: np.ndarray, at: np.ndarray, sorted_key: np.ndarray) -> np.ndarray:
        """Ranks (first slot of the group) of the positions ``at``; the slots of larger groups."""
        new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
        first = np.flatnonzero(new)
        rank[at] = slots[np.repeat(first, np.diff(np.concatenate([first, [len(at)]])))]
        single = new & np.concatenate([new[1:], [True]])
        return slots[~single]

    live = group(np.arange(n), order, key[order])
    levels, k = [rank.astype(np.int32)], 1
    while len(live):
        at = order[live]
        ahead = at + k
        key = rank[at] * (n + 1) + np.where(ahead < n, rank[np.minimum(ahead, n - 1)], n)
        own = np.argsort(key, kind="stable")
        order[live] = at[own]
        live = group(live, at[own], key[own])
        levels.append(rank.astype(np.int32))
        k *= 2
    i, j = order[:-1], order[1:]
    lcp = np.zeros(max(0, n - 1), np.int64)
    near = np.arange(len(lcp))
    for level in range(len(levels) - 1, -1, -1):
        a, b = i[near] + lcp[near], j[near] + lcp[near]
        ok = (a < n) & (b < n)
        same = near[ok][levels[level][a[ok]] == levels[level][b[ok]]]
        lcp[same] += 1 << level
    return order, lcp


def least_shared(min_words: int, repeats: int) -> int:
    """Words that a run shares with itself one period further, at least: its length
    less the period q."""
    return min(max(min_words - q, (repeats - 1) * q) for q in range(1, min_words + 1))


def kruskal_runs(words: list[int], order: list[int], lcp: list[int], min_words: int = MIN_WORDS,
                 repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of one text, from its suffix order and the
    LCP of neighbours; positions count from 0."""
    top = list(range(len(order)))
    members: list[list[int] | None] = [[p] for p in order]
    found: dict[tuple[int, int], int] = {}

    def root(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    def seed(p: int, further: int, shared: int) -> None:
        d = further - p
        size = shared + d
        if size >= repeats * d and size >= min_words and (p == 0 or words[p - 1] != words[further - 1]):
            if d < found.get((p, size), size):
                found[p, size] = d

    least = least_shared(min_words, repeats)
    edges = [x for x in range(len(lcp)) if lcp[x] >= least]
    edges.sort(key=lambda x: -lcp[x])
    for x in edges:
        a, b, shared = root(x), root(x + 1), lcp[x]
        large, small = members[a], members[b]
        if len(large) < len(small):
            a, b, large, small = b, a, small, large
        last = -1
        for p in small:
            at = bisect_left(large, p)
            if at and large[at - 1] != last:        # the small class's own neighbours share more
                seed(large[at - 1], p, shared)
            if at < len(large):
                seed(p, large[at], shared)
            large.insert(at, p)
            last = p
        top[b] = a
        members[b] = None
    return sorted((p, size, d) for (p, size), d in found.items())


def _suspects(words: np.ndarray, off: np.ndarray, least: int) -> np.ndarray:
    """Rows in which some ``least`` words come twice."""
    if len(words) < least:
        return np.zeros(0, np.int64)
    row = row_of(off)
    gram = gram_hashes(mix(words.astype(np.uint64) + np.uint64(1)), least)
    start = np.flatnonzero(row[:len(gram)] == row[least - 1:])
    key = np.sort(mix(gram[start] ^ mix(row[start].astype(np.uint64) + np.uint64(7))))
    twice = np.unique(key[1:][key[1:] == key[:-1]])
    if not len(twice):
        return np.zeros(0, np.int64)
    own = mix(gram[start] ^ mix(row[start].astype(np.uint64) + np.uint64(7)))
    at = np.minimum(np.searchsorted(twice, own), len(twice) - 1)
    return np.unique(row[start[twice[at] == own]])


def find_runs(words: np.ndarray, off: np.ndarray, min_words: int = MIN_WORDS,
              repeats: int = REPEATS) -> dict[int, list[tuple[int, int, int]]]:
    """Runs by row of a chunk; ``words`` are numbers, ``off`` the row offsets."""
    least = least_shared(min_words, repeats)
    out: dict[int, list[tuple[int, int, int]]] = {}
    rows = _suspects(words, off, least)
    size = np.diff(off)[rows] if len(rows) else np.zeros(0, np.int64)
    lo = 0
    while lo < len(rows):
        hi = lo + 1
        total = size[lo]
        while hi < len(rows) and total + size[hi] <= SORT_WORDS:
            total += size[hi]
            hi += 1
        own = np.concatenate([words[off[r]:off[r + 1]] for r in rows[lo:hi]])
        order, lcp = suffix_order(own, np.repeat(np.arange(hi - lo), size[lo:hi]))
        base = 0
        for r, n in zip(rows[lo:hi], size[lo:hi]):
            part = slice(base, base + n)
            runs = kruskal_runs(own[part].tolist(), (order[part] - base).tolist(), lcp[base:base + n - 1].tolist(),
                                min_words, repeats)
            if runs:
                out[int(r)] = runs
            base += n
        lo = hi
    return out


RUN = "array<struct<start: long, length: long, period: long>>"


def runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
         repeats: int = REPEATS) -> DataFrame:
    """(id, n_words, runs, collapsed) of every whole text: the runs by start and
    period, and the words joined by one blank without those that a run repeats
    (any run holds them behind its first period)."""
    if repeats < 2 or min_words < repeats:
        raise ValueError("a run needs two repeats or more, and as many words")
    prepare(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    struct = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, text in text_chunks(batches, limit=CHUNK):
            flat, off = split_words(text, lower=False)
            code = flat.dictionary_encode().indices.to_numpy().astype(np.int64) if len(flat) else np.zeros(0, np.int64)
            found = find_runs(code, off, min_words, repeats)
            keep = np.ones(len(flat), bool)
            for r, own in found.items():
                for start, length, period in own:
                    keep[off[r] + start + period:off[r] + start + length] = False
            kept = flat.filter(pa.array(keep)) if found else flat
            new = np.concatenate([[0], np.cumsum(keep)])[off]
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(new, pa.int32()), kept.cast(pa.string())), " ")
            rows = [[dict(zip(("start", "length", "period"), x)) for x in found.get(r, ())] for r in range(len(text))]
            yield pa.RecordBatch.from_arrays(
                [cols[0], pa.array(np.diff(off)), pa.array(rows, pa.list_(struct)), joined],
                [id_col, "n_words", "runs", "collapsed"])

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(
        go, f"`{id_col}` {kind}, n_words long, runs {RUN}, collapsed string")


def looped(text: Column, seed: Column) -> Column:
    """The text with its words from a on repeated with period p, where 10 divides the
    seed: a = g % n, p = 1 + floor((n - a) / (3 + g % 8)), g = floor(seed / 10), n the
    number of words. Other texts stay."""
    g = F.floor(seed / 10)

    def loop(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(
            words, 1 + F.when(i < a, i).otherwise(a + (i - a) % p))), " ")

    words = F.regexp_extract_all(text, F.lit(WORDS), 0)
    return F.when((seed % 10 == 0) & text.rlike(WORDS), let(words, loop)).otherwise(text)


def digests(found: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Counts, the longest run (ties: smallest start, then period) and digests."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("m"), r["start"].alias("s"),
                                                              r["period"].alias("q"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    length = -F.col("b.m")
    return found.select(id_col, "n_words", F.size("runs").cast("long").alias("n_runs"), best.alias("b"),
                        lines.alias("lines"), "collapsed").select(
        id_col, "n_words", "n_runs", F.col("b.s").alias("start"), length.alias("length"), F.col("b.q").alias("period"),
        F.expr("(-1000 * b.m) div b.q").alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))
