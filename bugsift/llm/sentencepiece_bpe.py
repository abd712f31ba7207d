"""SentencePiece (BPE with byte fallback) encoding and decoding.

Exact merge-type encoding by backtracking. For each run of known characters an
Aho-Corasick pass gives the longest vocabulary piece starting at every
position. Pieces are laid left to right, longest first; a piece is accepted
when the boundary to its predecessor survives re-merging (merging the two
pieces' characters from scratch gives exactly those two pieces) and its end is
not marked in the bitfield of failed positions. A position where nothing fits
is marked and the previous piece is replaced by its next shorter prefix. The
result is the merge order's own segmentation, in time linear in the text up to
the bounded memo of boundary checks.

Facts of the model that the method rests on (checked when it is loaded): the
normaliser is the identity with escaped white space and a dummy prefix, no
piece but runs of the space mark holds one after its first character, and every
character of a piece is itself a piece. So text falls into independent
stretches at space marks and at characters outside the vocabulary, which are
written as bytes; stretches repeat, and short ones are kept in a bounded cache.

Nulls are empty texts; an empty text has no ids and decodes to the empty text.
The model file's path is a parameter and is read on the workers.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, text_chunks

SPACE = "▁"
CACHE_CHARS = 48          # longer stretches are encoded but not kept
CACHE_SIZE = 300_000      # stretches kept per worker, then forgotten together
CHUNK = 8 << 20
PAIR_MEMO = 150_000


class PieceModel:
    """Vocabulary of a sentencepiece BPE model and the backtracking encoder."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece
        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.lib.get_piece_size()
        self.piece: dict[int, str] = {}
        self.score: dict[int, float] = {}
        self.byte: dict[int, int] = {}
        for i in range(n):
            p = self.lib.id_to_piece(i)
            if self.lib.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
            elif not (self.lib.is_control(i) or self.lib.is_unknown(i) or self.lib.is_unused(i)):
                self.piece[i] = p
                self.score[i] = self.lib.get_score(i)
        self.id = {p: i for i, p in self.piece.items()}
        self.chars = {p for p in self.id if len(p) == 1}
        if len(self.byte) != 256 or any(set(p) - self.chars for p in self.id):
            raise ValueError("the model needs byte fallback and a piece for every character used")
        if any(SPACE in p[1:] and set(p) != {SPACE} for p in self.id):
            raise ValueError("pieces must hold the space mark only at their start")
        if self.lib.encode("a  a") and self.lib.normalize("ﬁ  x ") != SPACE + "ﬁ" + SPACE * 2 + "x" + SPACE:
            raise ValueError("the model's normaliser must be the identity with a dummy prefix")
        self.size = {i: len(p) for i, p in self.piece.items()}
        self.find = ahocorasick.Automaton()
        for p, i in self.id.items():
            self.find.add_word(p, i)
        self.find.make_automaton()
        self.longest = max(self.size.values())
        # a piece's next shorter prefix that is a piece itself
        self.shorter: dict[int, int | None] = {}
        for p, i in self.id.items():
            cut = next((k for k in range(len(p) - 1, 0, -1) if p[:k] in self.id), None)
            self.shorter[i] = self.id[p[:cut]] if cut else None
        self.pairs: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, str] = {}
        # the bytes that a piece decodes to
        raw = [b""] * n
        for i, p in self.piece.items():
            raw[i] = p.replace(SPACE, " ").encode()
        for b, i in self.byte.items():
            raw[i] = bytes([b])
        self.raw = pa.array(raw, pa.large_binary())
        self.stretch = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")

    def merge(self, symbols: list[str]) -> list[str]:
        """Merges from scratch: the best-scored adjacent pair first, leftmost on ties."""
        while len(symbols) > 1:
            best, at = None, -1
            for k in range(len(symbols) - 1):
                i = self.id.get(symbols[k] + symbols[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if at < 0:
                break
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def adjacent(self, left: int, right: int) -> bool:
        """Whether re-merging the two pieces' characters leaves the same two pieces."""
        got = self.pairs.get((left, right))
        if got is None:
            a, b = self.piece[left], self.piece[right]
            got = self.merge(list(a + b)) == [a, b]
            if len(self.pairs) >= PAIR_MEMO:
                self.pairs.clear()
            self.pairs[left, right] = got
        return got

    def run(self, s: str) -> list[int]:
        """Ids of a run of known characters, by backtracking. The automaton's
        leftmost-longest matches are tried first as they stand; its matches from
        a later position are asked for only where a piece was given up."""
        ahead = [i for _, i in self.find.iter_long(s)]
        pairs, adjacent = self.pairs, self.adjacent
        good = 1                      # pieces of the greedy cover that fit together
        while good < len(ahead):
            pair = (ahead[good - 1], ahead[good])
            fits = pairs.get(pair)
            if not (adjacent(*pair) if fits is None else fits):
                break
            good += 1
        if good >= len(ahead):
            return ahead
        n, size, shorter, find = len(s), self.size, self.shorter, self.find
        out = ahead[:good]
        pos = sum(map(size.__getitem__, out))
        token: int | None = ahead[good]
        failed = bytearray((n >> 3) + 1)          # one bit per position
        reach = self.longest
        while True:
            last = out[-1] if out else None
            while token is not None:
                end = pos + size[token]
                if not failed[end >> 3] >> (end & 7) & 1 and (last is None or adjacent(last, token)):
                    break
                token = shorter[token]
            if token is None:
                failed[pos >> 3] |= 1 << (pos & 7)
                token = out.pop()
                pos -= size[token]
                continue
            out.append(token)
            pos = end
            if pos >= n:
                return out
            token = next(find.iter_long(s[pos:pos + reach]))[1]

    def encode_stretch(self, s: str) -> list[int]:
        if self.chars.issuperset(s):
            return self.run(s)
        out: list[int] = []
        start = 0
        for k, ch in enumerate(s):
            if ch not in self.chars:
                if k > start:
                    out += self.run(s[start:k])
                out += [self.byte[b] for b in ch.encode()]
                start = k + 1
        return out + self.run(s[start:]) if start < len(s) else out

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text."""
        if not text:
            return []
        return list(chain.from_iterable(
            map(self.encode_stretch, self.stretch.findall(SPACE + text.replace(" ", SPACE)))))

    def decode(self, ids: list[int]) -> str:
        return self.lib.decode(ids)

    def id_text(self, s: str) -> str:
        """Decimal ids of one stretch joined by commas, from the cache or encoded
        now; blanks in it stand for space marks."""
        got = self.cache.get(s)
        if got is None:
            got = ",".join(map(str, self.encode_stretch(s.replace(" ", SPACE))))
            if len(s) <= CACHE_CHARS:
                if len(self.cache) >= CACHE_SIZE:
                    self.cache.clear()
                self.cache[s] = got
        return got


def cut_stretches(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Independent stretches of every text, as (flat string array, row offsets).

    Every non-empty text gets the dummy prefix (a blank). A stretch starts at a
    row's start, at a blank after anything but a blank, and at and after a line
    feed. Texts must hold no space mark of their own."""
    own = pa.compute.binary_join_element_wise(
        pa.compute.if_else(pa.compute.equal(text, ""), "", " ").cast(pa.large_string()), text,
        pa.scalar("", pa.large_string()))
    offsets = np.frombuffer(own.buffers()[1], np.int64)[own.offset:own.offset + len(own) + 1]
    if offsets[-1] == offsets[0]:
        return pa.array([], pa.large_string()), np.zeros(len(text) + 1, np.int64)
    data = np.frombuffer(own.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    starts = offsets - offsets[0]
    blank, line = data == 32, data == 10
    first = np.zeros(len(data), bool)
    first[1:] = (blank[1:] & ~blank[:-1]) | line[1:] | line[:-1]
    first[starts[:-1][np.diff(starts) > 0]] = True
    cuts = np.flatnonzero(first)
    bounds = np.append(cuts, len(data))
    flat = pa.LargeStringArray.from_buffers(
        len(cuts), pa.py_buffer(bounds.tobytes()), pa.py_buffer(data.tobytes()))
    return flat, np.searchsorted(cuts, starts)


_LOADED: dict[str, PieceModel] = {}


def load(path: str) -> PieceModel:
    """The model, once per worker process."""
    if path not in _LOADED:
        _LOADED[path] = PieceModel(path)
    return _LOADED[path]


def encode_documents(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, n_tokens) of every whole text; other columns are dropped."""
    prepare(docs.sparkSession)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model)
        for cols, text in text_chunks(batches):
            ids = [m.encode(t) for t in text.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [cols[0], pa.array(ids, pa.list_(pa.int32())), pa.array(map(len, ids), pa.int64())],
                [id_col, "ids", "n_tokens"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(
        go, f"`{id_col}` {kind}, ids array<int>, n_tokens long")


def decode_documents(encoded: DataFrame, model: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) from ids; null ids decode to the empty text."""
    prepare(encoded.sparkSession)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model)
        for b in batches:
            texts = [m.decode(i) if i else "" for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    kind = dict(encoded.dtypes)[id_col]
    return encoded.select(id_col, ids_col).mapInArrow(go, f"`{id_col}` {kind}, text string")


def digest_chunk(m: PieceModel, text: pa.Array) -> tuple[list[int], list[str], list[str]]:
    """Number of ids, digest of the ids and digest of the decoded text of every
    row. Each distinct stretch of the chunk is encoded and decoded once; a row's
    ids and text are its stretches' in order, less the dummy prefix."""
    odd = pa.compute.match_substring(text, SPACE).to_numpy(zero_copy_only=False)
    flat, off = cut_stretches(pa.compute.if_else(pa.array(odd), "", text) if odd.any() else text)
    enc = flat.dictionary_encode()
    own = [m.id_text(x) for x in enc.dictionary.to_numpy(zero_copy_only=False)]
    size = np.array([x.count(",") + 1 for x in own], np.int64)
    ids = np.array(",".join(own).split(",") if own else [], np.int32)
    ends = pa.array(np.concatenate([[0], np.cumsum(size)]))
    blank = pa.scalar(b"", pa.large_binary())
    plain = pa.compute.binary_join(pa.LargeListArray.from_arrays(ends, m.raw.take(pa.array(ids))), blank)
    at, rows = enc.indices, pa.array(off)
    count = np.concatenate([[0], np.cumsum(size[at.to_numpy()])])
    n = (count[off[1:]] - count[off[:-1]]).tolist()
    listed = pa.compute.binary_join(
        pa.LargeListArray.from_arrays(rows, pa.array(own, pa.large_string()).take(at)),
        pa.scalar(",", pa.large_string())).cast(pa.large_binary())
    whole = pa.compute.binary_join(pa.LargeListArray.from_arrays(rows, plain.take(at)), blank)
    a = [hashlib.sha256(x).hexdigest() for x in listed.to_pylist()]
    b = [hashlib.sha256(memoryview(x)[1:]).hexdigest() for x in whole.to_pylist()]
    for r in np.flatnonzero(odd):     # the text itself holds the space mark
        ids = m.encode(text[int(r)].as_py())
        n[r] = len(ids)
        a[r] = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        b[r] = hashlib.sha256(m.decode(ids).encode()).hexdigest()
    return n, a, b


def round_trip(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text in one pass: id, n_tokens,
    ids_sha256 (decimal ids joined by commas), decoded_sha256 (UTF-8)."""
    prepare(docs.sparkSession)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model)
        for cols, text in text_chunks(batches, limit=CHUNK):
            n, a, b = digest_chunk(m, text)
            yield pa.RecordBatch.from_arrays(
                [cols[0], pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(
        go, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
