r"""Toxicity by multiple-instance learning.

A document's sentences are instances; only documents carry labels. A sentence
with cue words x has p = sigmoid(b + w.x), one without any has 0, and the
document's score is the noisy-or ``1 - (1 - leak) * prod(1 - p)``. Cue words come
from counts over the training sample (chi-square against the label), weights,
bias and leak by maximum likelihood on the document labels alone. The trained
sentence model then locates the offending sentences.

The training sample is a hash-chosen part of the labelled rows, at most about
``TRAIN_ROWS`` (a documented bound); every document is scored on its whole text.
Labels, language, source and id are never inputs of a score.

Nulls and empty texts have no sentence and score the leak (below 0.5). Labelled
rows with a null label or id are not used; of several labels of one id the
largest counts. Without any usable label the scores are 0. Ties among cue words
go by the word; repeated rows score alike; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, split_words, text_chunks

TRAIN_ROWS = 20_000
MAX_CUES = 500
MIN_CHI2 = 25.0
MIN_DOCS = 4
FOLDS = 5
SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
_EDGE = ".,;:!?\"'()[]{}<>*#$%&|-_~`/\\"


def fold(id_col: str | Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; fold 0 is held out."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(c.cast("string").cast("binary")) % FOLDS


def plain(words: pa.Array) -> pa.Array:
    return pc.utf8_trim(pc.utf8_lower(words), characters=_EDGE)


@dataclass
class Model:
    cues: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -4.0
    leak: float = 0.0

    def __post_init__(self):
        self.index = {c: i for i, c in enumerate(self.cues)}

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, probability) of the sentences that hold a cue."""
        out = []
        for m in SENTENCE.finditer(text):
            found = {self.index[w] for w in (x.strip(_EDGE) for x in m[0].lower().split()) if w in self.index}
            if found:
                z = self.bias + sum(self.weights[i] for i in sorted(found))
                out.append((m.start(), m.end(), float(1 / (1 + np.exp(-z)))))
        return out

    def score(self, sentences: list[tuple[int, int, float]]) -> float:
        rest = 1.0 - self.leak
        for _, _, p in sentences:
            rest *= 1.0 - p
        return min(1.0, max(0.0, 1.0 - rest))


def labelled(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "toxic") -> DataFrame:
    """(text, label) of the training sample: labelled rows outside fold 0."""
    own = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (fold(id_col) != 0))
           .groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("label")))
    n = own.count()
    if n > TRAIN_ROWS:
        step = -(-n // TRAIN_ROWS)
        own = own.where(F.pmod(F.xxhash64("_id"), F.lit(step)) == 0)
    # at most about TRAIN_ROWS short rows
    slim = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return slim.join(F.broadcast(own), "_id").select("text", "label")


def choose_cues(train: DataFrame) -> list[str]:
    """Words that mark labelled-1 documents, by chi-square over the sample."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, text in text_chunks(batches, text=0):
            label = cols[1].to_numpy()
            flat, off = split_words(text, lower=False)
            words = plain(flat).to_pylist()
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for r, y in enumerate(label):
                seen[int(y != 0)].update(set(words[off[r]:off[r + 1]]))
            own = sorted(seen[0] | seen[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(own, pa.string()), *(pa.array([s[w] for w in own], pa.int64()) for s in seen)],
                ["word", "n0", "n1"])

    total = {r["label"] != 0: r["count"] for r in train.groupBy("label").count().collect()}
    n1, n0 = total.get(True, 0), total.get(False, 0)
    if not n1 or not n0:
        return []
    a, b = F.col("n1"), F.col("n0")
    c, d = n1 - a, n0 - b
    chi2 = (n1 + n0) * (a * d - b * c) * (a * d - b * c) / ((a + b) * (c + d) * F.lit(float(n1)) * n0)
    rows = (train.mapInArrow(count, "word string, n0 long, n1 long").groupBy("word")
            .agg(F.sum("n0").cast("double").alias("n0"), F.sum("n1").cast("double").alias("n1"))
            .where((a >= MIN_DOCS) & (c + d > 0) & (a * n0 > 2 * b * n1) & (F.col("word") != ""))
            .select("word", chi2.alias("chi2")).where(F.col("chi2") >= MIN_CHI2)
            .orderBy(F.desc("chi2"), "word").limit(MAX_CUES).collect())
    return [r["word"] for r in rows]


def fit(train: DataFrame, rounds: int = 400, rate: float = 0.2, ridge: float = 1e-3) -> Model:
    """Noisy-or maximum likelihood over the sample's cue sentences."""
    train = train.cache()
    try:
        cues = choose_cues(train)
        index = {c: i for i, c in enumerate(cues)}

        def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            probe = Model(cues, np.zeros(len(cues)))
            for cols, text in text_chunks(batches, text=0):
                found = []
                for t in text.to_pylist():
                    per = []
                    for m in SENTENCE.finditer(t):
                        own = sorted({probe.index[w] for w in (x.strip(_EDGE) for x in m[0].lower().split())
                                      if w in probe.index})
                        if own:
                            per.append(own)
                    found.append(per)
                yield pa.RecordBatch.from_arrays(
                    [cols[1], pa.array(found, pa.list_(pa.list_(pa.int32())))], ["label", "bags"])

        rows = train.mapInArrow(bags, "label int, bags array<array<int>>").collect() if index else []
        base = train.agg(F.avg((F.col("label") != 0).cast("double"))).first()[0]
    finally:
        train.unpersist()
    if not rows:
        return Model(leak=min(0.4, float(base or 0.0)))
    # documents in a fixed order: sums do not depend on how Spark dealt the rows
    rows = sorted((int(r["label"] != 0), r["bags"]) for r in rows)
    y = np.array([r[0] for r in rows], float)
    doc, sent, word = [], [], []
    n = 0
    for d, (_, per) in enumerate(rows):
        for own in per:
            doc.append(d)
            sent += [n] * len(own)
            word += own
            n += 1
    doc, sent, word = np.array(doc, np.int64), np.array(sent, np.int64), np.array(word, np.int64)
    theta = np.concatenate([np.full(len(cues), 3.0), [-3.0, -4.0]])      # weights, bias, leak (logit)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        z = np.bincount(sent, theta[word], minlength=n) + theta[-2]
        p = 1 / (1 + np.exp(-z))
        leak = 1 / (1 + np.exp(-theta[-1]))
        rest = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(y)) + np.log1p(-leak)
        q = np.clip(1 - np.exp(rest), 1e-9, 1 - 1e-9)
        # d log-likelihood / d rest, then through log(1 - p) of each sentence
        back = (1 - y) - y * (1 - q) / q
        dz = -p * back[doc]
        grad = np.concatenate([np.bincount(word, dz[sent], minlength=len(cues)) - ridge * len(y) * theta[:-2],
                               [dz.sum()], [(-leak * back).sum()]]) / len(y)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        theta = theta + rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    leak = float(1 / (1 + np.exp(-theta[-1])))
    return Model(cues, theta[:-2], float(theta[-2]), min(leak, 0.4))


def _suspects(model: Model, text: pa.Array) -> np.ndarray:
    """Rows with a cue word."""
    flat, off = split_words(text, lower=False)
    if len(flat) == 0 or not model.cues:
        return np.zeros(0, np.int64)
    enc = flat.dictionary_encode()
    cue = pc.is_in(plain(enc.dictionary), value_set=pa.array(model.cues, pa.large_string()))
    hit = cue.to_numpy(zero_copy_only=False)[enc.indices.to_numpy()]
    count = np.concatenate([[0], np.cumsum(hit)])[off]
    return np.flatnonzero(np.diff(count))


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted, n_offending) of every whole text."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[id_col]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for cols, text in text_chunks(batches):
            value = np.full(len(text), own.score([]))
            bad = np.zeros(len(text), np.int64)
            for r in _suspects(own, text):
                s = own.sentences(text[int(r)].as_py())
                value[r] = own.score(s)
                bad[r] = sum(p >= 0.5 for _, _, p in s)
            yield pa.RecordBatch.from_arrays(
                [cols[0], cols[2], pa.array(value), pa.array((value >= 0.5).astype(np.int32)), pa.array(bad)],
                [id_col, "held_out", "score", "predicted", "n_offending"])

    return docs.select(id_col, F.col(text_col).cast("string"),
                       F.coalesce(fold(id_col) == 0, F.lit(False)).alias("held_out")).mapInArrow(
        go, f"`{id_col}` {kind}, held_out boolean, score double, predicted int, n_offending long")


def locate(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, end, probability, sentence) of the offending sentences (0.5 or
    more), in code points."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[id_col]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for cols, text in text_chunks(batches):
            at, rows = [], []
            for r in _suspects(own, text):
                t = text[int(r)].as_py()
                for a, b, p in own.sentences(t):
                    if p >= 0.5:
                        at.append(int(r))
                        rows.append((a, b, p, t[a:b]))
            a, b, p, s = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [cols[0].take(pa.array(at, pa.int64())), pa.array(a, pa.int64()), pa.array(b, pa.int64()),
                 pa.array(p, pa.float64()), pa.array(s, pa.string())],
                [id_col, "start", "end", "probability", "sentence"])

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(
        go, f"`{id_col}` {kind}, start long, end long, probability double, sentence string")
