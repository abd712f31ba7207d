r"""Quality score by a regularised quadratic discriminant.

Every whole text becomes ``FEATURES``, statistics of its characters, words and
lines, each through a logarithm so that classes look more like normal clouds. For
both labels the mean and covariance come from all labelled rows outside fold 0 (no
sample): sums and products of values rounded to ``1 / SCALE`` are exact integers, so
the model does not depend on how Spark dealt the rows. Covariances are shrunk

    S_k = (1 - g) * ((1 - l) * C_k + l * C_pooled) + g * diag(C_pooled)

and factored once (Cholesky, kept in the model). A row's raw score is the difference
of the two log densities, ``-(m_1 - m_0 + logdet S_1 - logdet S_0) / 2`` with squared
Mahalanobis distances m. ``l`` and ``g`` come from ``GRID`` by the area under the ROC
curve over four folds (a fold's model is the total of the others: sums are subtracted,
nothing is fitted again), and so does the logistic line that turns raw scores into
probabilities, fitted on a histogram of ``BINS`` bins.

Labels, language, source and id are never inputs of a score. Null and empty texts have
zero counts and get the score of those; labelled rows with a null id or label are not
used; of several labels of one id the largest counts, and each row of a repeated id is
one training row. Without rows of both labels every score is the share of label 1 (0.5
without any). Rows with equal texts score alike, very long texts are read whole, empty
tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, gram_hashes, mix, prepare, row_of, split_words, text_chunks
from .toxicity import FOLDS, fold

FEATURES = ["words", "word_size", "word_spread", "upper", "symbols", "marks", "exclaims", "digits", "stops", "commas",
            "breaks", "foreign", "repeats", "top_word", "repeated_grams", "repeated_lines", "line_words", "long_words",
            "short_words", "points"]
SCALE = 1024
LIMIT = 15.0
GRID = [(lam, gam) for lam in (0.0, 0.1, 0.3, 0.6, 1.0) for gam in (0.01, 0.1, 0.3)]
BINS, REACH = 4000, 40.0
CHUNK = 4 << 20

# byte classes
_LOW, _UP, _DIGIT, _BREAK, _STOP, _COMMA, _BANG, _POINT, _SYMBOL, _MARK, _LEAD, _REST = range(12)
_CLASS = np.full(256, _REST, np.uint8)
for _k, _own in ((_LOW, range(97, 123)), (_UP, range(65, 91)), (_DIGIT, range(48, 58)), (_BREAK, b"\n"), (_STOP, b".?"),
                 (_COMMA, b","), (_BANG, b"!"), (_POINT, b";:'\"-()"), (_SYMBOL, b"#*$%&"), (_MARK, b"|<>{}[]\\/=_~^@+`"),
                 (_LEAD, range(0xC0, 256))):
    _CLASS[list(_own)] = _k


def _repeated(row: np.ndarray, code: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """By row: distinct codes, and places of the most frequent one."""
    distinct, most = np.zeros(n_rows, np.int64), np.zeros(n_rows, np.int64)
    if len(row):
        order = np.lexsort((code, row))
        r, c = row[order], code[order]
        first = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (c[1:] != c[:-1])]))
        np.add.at(distinct, r[first], 1)
        np.maximum.at(most, r[first], np.diff(np.concatenate([first, [len(r)]])))
    return distinct, most


def statistics(text: pa.Array) -> np.ndarray:
    """FEATURES of every row (large_string without nulls)."""
    n = len(text)
    off = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + n + 1]
    data = text.buffers()[2]
    raw = (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[off[0]:off[-1]]
    kinds = np.zeros((n, 12))
    at = np.repeat(np.arange(n, dtype=np.int32), np.diff(off)) * 12
    at += _CLASS[raw]
    kinds += np.bincount(at, minlength=n * 12).reshape(n, 12)
    flat, woff = split_words(text, lower=False)
    words = np.diff(woff).astype(float)
    row = row_of(woff)
    size = pc.binary_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
    by_row = lambda x: np.bincount(row, x, minlength=n)
    total, squares = by_row(size), by_row(size * size)
    code = flat.dictionary_encode().indices.to_numpy().astype(np.int64) if len(flat) else np.zeros(0, np.int64)
    distinct, most = _repeated(row, code, n)
    gram = gram_hashes(mix(code.astype(np.uint64) + np.uint64(1)), 3)
    start = np.flatnonzero(row[:len(gram)] == row[2:]) if len(gram) else np.zeros(0, np.int64)
    grams = np.bincount(row[start], minlength=n)
    gram_kinds, _ = _repeated(row[start], gram[start], n)
    lines = pc.split_pattern(text, "\n")
    loff = lines.offsets.to_numpy() - lines.offsets[0].as_py()
    line_row = row_of(loff)
    flat_lines = lines.flatten()
    full = pc.not_equal(pc.binary_length(flat_lines), 0).to_numpy(zero_copy_only=False)
    line_code = flat_lines.dictionary_encode().indices.to_numpy().astype(np.int64) if len(flat_lines) else np.zeros(0, np.int64)
    n_lines = np.bincount(line_row[full], minlength=n)
    line_kinds, _ = _repeated(line_row[full], line_code[full], n)
    behind = np.concatenate([[0], np.cumsum((raw & 0xC0) == 0x80)])
    chars = np.diff(off) - np.diff(behind[off - off[0]])
    w, c = words + 1, chars + 1
    mean = total / w
    share = lambda x, of, a=0.01: np.log(x / of + a)
    ascii_letters = kinds[:, _LOW] + kinds[:, _UP]
    out = np.column_stack([
        np.log1p(words), np.log1p(mean), np.log1p(np.sqrt(np.maximum(squares / w - mean * mean, 0))),
        share(kinds[:, _UP], ascii_letters + 5), share(kinds[:, _SYMBOL], w), share(kinds[:, _MARK], w),
        share(kinds[:, _BANG], w), share(kinds[:, _DIGIT], c), share(kinds[:, _STOP], w), share(kinds[:, _COMMA], w),
        share(kinds[:, _BREAK], w), share(kinds[:, _LEAD], c), np.log1p(words) - np.log1p(distinct), share(most, w),
        share(grams - gram_kinds, grams + 5), share(n_lines - line_kinds, n_lines + 2), np.log1p(words / (n_lines + 1)),
        share(by_row(size > 15), w), share(by_row(size <= 3), w, 0.05), share(kinds[:, _POINT], w)])
    return np.rint(np.clip(out, -LIMIT, LIMIT) * SCALE) / SCALE


@dataclass
class Model:
    """Means and Cholesky factors of both classes; ``line`` maps raw scores to log odds."""
    mean: np.ndarray | None = None           # (2, d)
    factor: np.ndarray | None = None         # (2, d, d), lower triangles
    log_prior: float = 0.0
    line: tuple[float, float] = (1.0, 0.0)
    base: float = 0.5

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log density under label 1 less that under label 0, plus the log prior odds."""
        part = []
        for k in (0, 1):
            z = np.linalg.solve(self.factor[k], (x - self.mean[k]).T)
            part.append(-0.5 * np.einsum("ij,ij->j", z, z) - np.log(np.diag(self.factor[k])).sum())
        return part[1] - part[0] + self.log_prior

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.mean is None:
            return np.full(len(x), self.base)
        a, b = self.line
        return 1 / (1 + np.exp(-(a * np.clip(self.raw(x), -REACH, REACH) + b)))


def discriminant(count: np.ndarray, total: np.ndarray, product: np.ndarray, lam: float, gam: float) -> Model:
    """Model from counts (2), sums (2, d) and sums of products (2, d, d)."""
    mean = total / count[:, None]
    cov = product / count[:, None, None] - mean[:, :, None] * mean[:, None, :]
    pooled = (cov * count[:, None, None]).sum(0) / count.sum()
    ridge = np.diag(np.diag(pooled) + 1e-4)
    own = (1 - gam) * ((1 - lam) * cov + lam * pooled) + gam * ridge + np.eye(len(pooled)) * 1e-6
    return Model(mean, np.linalg.cholesky(own), float(np.log(count[1] / count[0])), base=float(count[1] / count.sum()))


def described(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fold, x) of every whole text: the one pass over texts, kept as a table."""
    prepare(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, text in text_chunks(batches, limit=CHUNK):
            x = statistics(text).astype(np.float32)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([cols[0], cols[2], flat], [id_col, "fold", "x"])

    return cut(docs.select(id_col, F.col(text_col).cast("string"), fold(id_col).cast("int")).mapInArrow(
        go, f"`{id_col}` {kind}, fold int, x array<float>"))


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(col), -1)


def fit(table: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality") -> Model:
    """Model from all labelled rows of ``described`` outside fold 0."""
    own = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
           .groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("y")))
    rows = table.where("fold <> 0").select(F.col(id_col).alias("_id"), "fold", "x").join(own, "_id").select(
        "fold", (F.col("y") != 0).cast("int").alias("y"), "x")
    d = len(FEATURES)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            f, y = b.column(0).to_numpy(), b.column(1).to_numpy()
            x = np.concatenate([np.full((b.num_rows, 1), SCALE), np.rint(_matrix(b.column(2)) * SCALE)], 1).astype(np.int64)
            for k in {*zip(f.tolist(), y.tolist())}:
                part = x[(f == k[0]) & (y == k[1])]
                acc[k] = acc.get(k, 0) + part.T @ part
        for (f, y), m in acc.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([f], pa.int32()), pa.array([y], pa.int32()), pa.array([m.ravel().tolist()], pa.list_(pa.int64()))],
                ["fold", "y", "m"])

    # (d + 1)^2 numbers for each of at most 8 groups and task, summed by Spark
    found = (rows.mapInArrow(sums, "fold int, y int, m array<long>")
             .select("fold", "y", F.posexplode("m").alias("k", "v")).groupBy("fold", "y", "k")
             .agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect())
    moments = np.zeros((FOLDS, 2, (d + 1) ** 2))
    for r in found:
        moments[r["fold"], r["y"], r["k"]] = float(r["v"])
    moments = moments.reshape(FOLDS, 2, d + 1, d + 1) / SCALE ** 2

    def model(m: np.ndarray, lam: float, gam: float) -> Model:
        return discriminant(m[:, 0, 0], m[:, 0, 1:], m[:, 1:, 1:], lam, gam)

    total = moments.sum(0)
    count = total[:, 0, 0]
    if count.min() < 2:
        return Model(base=float(count[1] / count.sum()) if count.sum() else 0.5)
    folds = [f for f in range(1, FOLDS) if (count - moments[f][:, 0, 0]).min() >= 2]
    if not folds:
        return model(total, 1.0, 0.3)
    shared = rows.sparkSession.sparkContext.broadcast(
        {f: [model(total - moments[f], lam, gam) for lam, gam in GRID] for f in folds})

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hist = np.zeros((len(GRID), 2, BINS), np.int64)
        for b in batches:
            f, y = b.column(0).to_numpy(), b.column(1).to_numpy()
            x = _matrix(b.column(2)) if b.num_rows else np.zeros((0, d))
            for own_fold, models in shared.value.items():
                at = f == own_fold
                if at.any():
                    for g, m in enumerate(models):
                        where = np.clip((m.raw(x[at]) + REACH) * (BINS / (2 * REACH)), 0, BINS - 1).astype(np.int64)
                        np.add.at(hist[g], (y[at], where), 1)
        g, y, k = np.nonzero(hist)
        yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int32)) for v in (g, y, k)] + [pa.array(hist[g, y, k])],
                                         ["g", "y", "k", "n"])

    hist = np.zeros((len(GRID), 2, BINS))
    for r in rows.mapInArrow(scores, "g int, y int, k int, n long").groupBy("g", "y", "k").agg(F.sum("n").alias("n")).collect():
        hist[r["g"], r["y"], r["k"]] = r["n"]
    best = int(np.argmax([round(auc(h), 6) for h in hist]))
    out = model(total, *GRID[best])
    out.line = logistic(hist[best])
    return out


def auc(hist: np.ndarray) -> float:
    """Area under the ROC curve of a histogram (2, bins)."""
    below = np.concatenate([[0], np.cumsum(hist[0])[:-1]])
    both = hist[0].sum() * hist[1].sum()
    return float((hist[1] * (below + hist[0] / 2)).sum() / both) if both else 0.5


def logistic(hist: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and offset by Newton steps on the histogram, lightly held near (0.1, 0)."""
    z = (np.arange(BINS) + 0.5) * (2 * REACH / BINS) - REACH
    x = np.column_stack([z, np.ones(BINS)])
    n = hist.sum(0)
    theta, centre, hold = np.array([0.1, 0.0]), np.array([0.1, 0.0]), np.diag([1.0, 0.1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ theta)))
        grad = x.T @ (hist[1] - n * p) - hold @ (theta - centre)
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + hold, grad)
        theta = theta + np.clip(step, -1, 1)
    return max(float(theta[0]), 1e-3), float(theta[1])


def score(table: DataFrame, model: Model, *, id_col: str = "doc_id") -> DataFrame:
    """(id, held_out, score, predicted) of every row of ``described``."""
    shared = table.sparkSession.sparkContext.broadcast(model)
    kind = dict(table.dtypes)[id_col]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = shared.value.score(_matrix(b.column(2))) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pc.fill_null(pc.equal(b.column(1), 0), False), pa.array(s), pa.array((s >= 0.3).astype(np.int32))],
                [id_col, "held_out", "score", "predicted"])

    return table.select(id_col, "fold", "x").mapInArrow(
        go, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")


def assess(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
           label_col: str = "quality") -> DataFrame:
    """Train on ``labels`` and score every document."""
    table = described(docs, id_col=id_col, text_col=text_col)
    return score(table, fit(table, labels, id_col=id_col, label_col=label_col), id_col=id_col)
