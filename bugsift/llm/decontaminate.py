r"""Benchmark decontamination: passages of documents within a bounded edit
distance of a benchmark item.

Edits are counted over words (``[^\x20\x09-\x0D]+``, lower case, outer
punctuation stripped). A document is contaminated by an item of m words when
some window of it is within ``floor(MAX_EDIT_PCT * m / 100)`` word edits of the
item.

1. Anchors. Of the item's e + ANCHORS rarest positions at most e are edited, so
   a passage that close holds at least ANCHORS of these words, on diagonals at
   most e apart; such groups propose the item-sized windows that line them up,
   give or take e. This loses nothing and needs one pass over the words.
2. CGK. A random walk embeds item and window into 3m symbols each; edit distance
   turns into Hamming distance with high probability (Chakraborty, Goldenberg,
   Koucky 2016).
3. Bit sampling. ``tables_needed`` repetitions of SAMPLED sampled symbols are
   drawn over WALKS walks; a pair that agrees on all symbols of one table is a
   candidate. The count is set so that pairs at the distance bound are found
   with probability RECALL, measured on edited copies of the items.
4. Verification. Banded dynamic programming gives the exact edit distance.

Item words (not documents) are broadcast, in blocks of ``ITEM_BLOCK`` items.
Items with no word match nothing; items under ``MIN_ITEM_WORDS`` words must be
found unedited. Null and empty texts are clean; ties between windows go to the
smallest distance, then the leftmost start; repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, split_words, text_chunks

MAX_EDIT_PCT = 20
MIN_ITEM_WORDS = 8
ITEM_BLOCK = 5000
ANCHORS = 3
WALKS = 6
SAMPLED = 3
RECALL = 0.98
MAX_TABLES = 96
_EDGE = ".,;:!?\"'()[]{}<>*#$%&|-_~`/\\"
CHUNK = 24 << 20
_BATCH = 60_000           # windows embedded at once


def plain(words: pa.Array) -> pa.Array:
    """Lower case without outer punctuation."""
    return pc.utf8_trim(pc.utf8_lower(words), characters=_EDGE)


class Items:
    """Benchmark items as word numbers, with anchors and sampling tables."""

    def __init__(self, rows: list[tuple], max_edit_pct: int = MAX_EDIT_PCT, seed: int = 7):
        self.rng_seed, self.pct = seed, max_edit_pct
        raw = pa.array([t or "" for _, t in rows], pa.large_string())
        flat, off = split_words(raw, lower=False)
        words = plain(flat).to_pylist()
        self.vocab: dict[str, int] = {}
        codes = np.array([self.vocab.setdefault(w, len(self.vocab)) for w in words], np.int32)
        count = np.bincount(codes, minlength=len(self.vocab)) if len(codes) else np.zeros(0, int)
        own = list(self.vocab)
        self.ids, self.codes, self.edits = [], [], []
        anchors: dict[int, list[tuple[int, int]]] = {}
        for (i, _), a, b in zip(rows, off[:-1], off[1:]):
            c = codes[a:b]
            if len(c) == 0:
                continue
            e = len(c) * max_edit_pct // 100 if len(c) >= MIN_ITEM_WORDS else 0
            k = len(self.ids)
            self.ids.append(i)
            self.codes.append(c)
            self.edits.append(e)
            # rarest positions: seldom in the benchmark, then long, then leftmost
            rare = sorted(range(len(c)), key=lambda p: (-len(own[c[p]]) if own[c[p]] else 1, count[c[p]], p))
            for p in rare[:e + ANCHORS]:
                anchors.setdefault(int(c[p]), []).append((k, p))
        # CSR: word number -> (item, position)
        self.start = np.zeros(len(self.vocab) + 1, np.int64)
        for w, v in anchors.items():
            self.start[w + 1] = len(v)
        self.start = np.cumsum(self.start)
        pairs = [x for w in sorted(anchors) for x in anchors[w]]
        self.hit = np.array(pairs, np.int64).reshape(-1, 2)
        self.size = np.array([len(c) for c in self.codes], np.int64)
        self.edit = np.array(self.edits, np.int64)
        self.need = np.minimum(ANCHORS, self.size - self.edit)    # anchors that must be found
        self.own = pa.array(own, pa.large_string())
        self.walks: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        self.embedded: dict[tuple[int, int], np.ndarray] = {}
        self.tables = self.tables_needed()

    def walk(self, m: int, which: int) -> tuple[np.ndarray, np.ndarray]:
        """Steps' odd multipliers of one walk and the sampled steps of its tables."""
        if (m, which) not in self.walks:
            rng = np.random.default_rng([self.rng_seed, which, m])
            self.walks[m, which] = (rng.integers(1, 2 ** 62, 3 * m) * 2 + 1,
                                    rng.integers(0, 3 * m, (MAX_TABLES, SAMPLED)))
        return self.walks[m, which]

    def embed(self, block: np.ndarray, m: int, which: int) -> np.ndarray:
        """CGK embedding of rows of m symbols into 3m symbols (-2: past the end)."""
        odd, _ = self.walk(m, which)
        n = len(block)
        flat = np.concatenate([block, np.full((n, 1), -2, block.dtype)], axis=1).astype(np.int64).ravel()
        row = np.arange(n) * (m + 1)
        at, end = row.copy(), row + m
        out = np.empty((3 * m, n), np.int64)
        for j in range(3 * m):
            cur = flat[at]
            out[j] = cur
            # one random bit of (step, symbol): stay or walk on
            at = np.minimum(at + (((cur + 7) * odd[j]) >> 41 & 1), end)
        return out

    def item_embedding(self, k: int, which: int) -> np.ndarray:
        if (k, which) not in self.embedded:
            self.embedded[k, which] = self.embed(self.codes[k][None, :], len(self.codes[k]), which)[:, 0]
        return self.embedded[k, which]

    def collide(self, windows: np.ndarray, owner: np.ndarray, m: int) -> np.ndarray:
        """Which windows agree with their items on a whole table of some walk."""
        items = np.stack([self.codes[k] for k in owner])
        got = (windows == items).all(axis=1)
        per = -(-self.tables // WALKS)
        for which in range(WALKS):
            rest = np.flatnonzero(~got)
            if len(rest) == 0:
                break
            _, picks = self.walk(m, which)
            steps = picks[:per]
            own = self.embed(windows[rest], m, which)[steps]              # tables x symbols x windows
            names, at = np.unique(owner[rest], return_inverse=True)
            want = np.stack([self.item_embedding(k, which) for k in names], axis=1)[steps][:, :, at]
            got[rest[(own == want).all(axis=1).any(axis=0)]] = True
        return got

    def tables_needed(self) -> int:
        """Repetitions that find copies at the distance bound with RECALL,
        estimated from agreement of embedded copies edited that often."""
        rng = np.random.default_rng(self.rng_seed)
        picks = [k for k in range(len(self.ids)) if self.edits[k] > 0]
        if not picks:
            return WALKS
        rates = []
        for k in rng.choice(picks, min(48, 4 * len(picks))):
            c = list(self.codes[k])
            m = len(c)
            for _ in range(self.edits[k]):
                p, kind = int(rng.integers(len(c))), int(rng.integers(3))
                if kind == 0:
                    c[p] = -1
                elif kind == 1 and len(c) > 1:
                    del c[p]
                else:
                    c.insert(p, -1)
            w = np.array((c + [-1] * m)[:m], np.int32)[None, :]
            rates.append([float((self.embed(w, m, r)[:, 0] == self.item_embedding(k, r)).mean()) ** SAMPLED
                          for r in range(WALKS)])
        miss = 1 - np.array(rates)
        for tables in range(WALKS, MAX_TABLES + 1, WALKS):
            if 1 - np.prod(miss ** (tables // WALKS), axis=1).mean() >= RECALL:
                return tables
        return MAX_TABLES

    def numbers(self, words: pa.Array) -> np.ndarray:
        """Vocabulary numbers of distinct words (-1: in no item)."""
        return pc.fill_null(pc.index_in(plain(words), value_set=self.own), -1).to_numpy(zero_copy_only=False)


def edit_distance(windows: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Word edit distance of each item row to the best prefix of its window row
    (window rows may be longer than the item by the edits allowed), and that
    prefix' length."""
    n, m = items.shape
    wide = windows.shape[1]
    prev = np.repeat(np.arange(wide + 1)[None, :], n, 0)
    steps = np.arange(wide + 1)
    for i in range(1, m + 1):
        cur = np.empty_like(prev)
        cur[:, 0] = i
        cur[:, 1:] = np.minimum(prev[:, 1:] + 1, prev[:, :-1] + (windows != items[:, i - 1:i]))
        # insertions: running minimum along the row
        prev = np.minimum.accumulate(cur - steps, axis=1) + steps
    best = prev.min(axis=1)
    return best, prev.argmin(axis=1)


def chunk_hits(items: Items, text: pa.Array) -> list[tuple[int, int, int, int, int]]:
    """(row, item, distance, first word, words) of the best window per row and item."""
    flat, off = split_words(text, lower=False)
    if len(flat) == 0 or not items.ids:
        return []
    enc = flat.dictionary_encode()
    code = items.numbers(enc.dictionary)[enc.indices.to_numpy()]
    anchored = np.append(np.diff(items.start) > 0, False)          # -1 looks up the last
    pos = np.flatnonzero(anchored[code])
    if len(pos) == 0:
        return []
    reps = items.start[code[pos] + 1] - items.start[code[pos]]
    which = np.repeat(items.start[code[pos]], reps) + (np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps))
    item, q = items.hit[which].T
    p = np.repeat(pos, reps)
    r = np.searchsorted(off, p, "right") - 1
    order = np.lexsort((p - q, r, item))
    item, r, diag = item[order], r[order], (p - q)[order]
    grouped = np.zeros(len(item), bool)
    for need in np.unique(items.need):
        ahead = need - 1                    # the hit that closes a group begun here
        n = len(item) - ahead
        if n <= 0:
            continue
        a, b = slice(0, n), slice(ahead, ahead + n)
        close = ((items.need[item[a]] == need) & (item[a] == item[b]) & (r[a] == r[b])
                 & (diag[b] - diag[a] <= items.edit[item[a]]))
        grouped[:n] |= close
    item, r, diag = item[grouped], r[grouped], diag[grouped]
    if len(item) == 0:
        return []
    e = items.edit[item]
    # item-sized windows that line the anchor up, shifted by up to e
    width = 2 * e + 1
    owner = np.repeat(np.arange(len(item)), width)
    shift = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) - e[owner]
    start = diag[owner] + shift
    item, r = item[owner], r[owner]
    first, last = off[r], off[r + 1]
    # the window may run e words past either end of the row
    fits = (start >= first - items.edit[item]) & (start < last)
    key = np.unique(np.stack([item[fits], r[fits], start[fits]]), axis=1)
    if key.shape[1] == 0:
        return []
    item, r, start = key
    first, last = off[r], off[r + 1]
    size = items.size[item]
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for m in np.unique(size):
        own = np.flatnonzero(size == m)
        for lo in range(0, len(own), _BATCH):
            s = own[lo:lo + _BATCH]
            want = np.stack([items.codes[k] for k in item[s]])
            edits = items.edit[item[s]]
            wide = int(m + edits.max())
            at = start[s][:, None] + np.arange(wide)[None, :]
            inside = (at >= first[s][:, None]) & (at < last[s][:, None])
            win = np.where(inside, code[np.clip(at, 0, len(code) - 1)], -3).astype(np.int32)
            near = items.collide(win[:, :m], item[s], int(m))
            s, win, want, edits, inside = s[near], win[near], want[near], edits[near], inside[near]
            if len(s) == 0:
                continue
            dist, length = edit_distance(win, want)
            for k in np.flatnonzero(dist <= edits):
                begin = max(int(start[s[k]]), int(first[s[k]]))
                end = min(int(start[s[k]] + length[k]), int(last[s[k]]))
                got = (int(dist[k]), begin - int(first[s[k]]), end - begin)
                name = (int(r[s[k]]), int(item[s[k]]))
                if end > begin and (name not in best or got < best[name]):
                    best[name] = got
    return [(a, b, *v) for (a, b), v in sorted(best.items())]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple]]:
    """The stated query set (benchmark items) in blocks of bounded size."""
    block: list[tuple] = []
    for x in benchmark.select(item_col, text_col).orderBy(item_col, text_col).toLocalIterator():
        block.append((x[0], x[1]))
        if len(block) == ITEM_BLOCK:
            yield block
            block = []
    if block:
        yield block




def hits(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text: str = "text", max_edit_pct: int = MAX_EDIT_PCT) -> DataFrame:
    """(id, item_id, distance, start_word, n_words): one row per document and
    item found in it, with the closest passage."""
    spark = docs.sparkSession
    prepare(spark)
    kind, item_kind = dict(docs.dtypes)[id_col], dict(benchmark.dtypes)[item_col]
    schema = f"`{id_col}` {kind}, `{item_col}` {item_kind}, distance long, start_word long, n_words long"
    out = None
    for block in _blocks(benchmark, item_col, item_text):
        shared = spark.sparkContext.broadcast(Items(block, max_edit_pct))

        def go(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for cols, text in text_chunks(batches, limit=CHUNK):
                got = chunk_hits(items, text)
                if got:
                    r, k, d, s, n = zip(*got)
                    yield pa.RecordBatch.from_arrays(
                        [cols[0].take(pa.array(r)), pa.array([items.ids[x] for x in k]),
                         *(pa.array(x, pa.int64()) for x in (d, s, n))],
                        [id_col, item_col, "distance", "start_word", "n_words"])

        part = docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(go, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text",
                      max_edit_pct: int = MAX_EDIT_PCT) -> DataFrame:
    """The rows (all columns) without a passage close to any benchmark item."""
    spark = docs.sparkSession
    prepare(spark)
    at = docs.columns.index(text_col)
    out = docs
    for block in _blocks(benchmark, "item_id", "text"):
        shared = spark.sparkContext.broadcast(Items(block, max_edit_pct))

        def go(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for cols, text in text_chunks(iter([b]), text=at, limit=CHUNK):
                    clean = np.ones(len(text), bool)
                    clean[[h[0] for h in chunk_hits(shared.value, text)]] = False
                    yield pa.RecordBatch.from_arrays([c.filter(pa.array(clean)) for c in cols], b.schema.names)

        out = out.mapInArrow(go, docs.schema)
    return out
