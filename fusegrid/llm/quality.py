"""Quality classifier: naive Bayes support vectors.

Indicators of n-grams (words, pairs of word shapes, word endings and beginnings, and how much of a text repeats) are hashed to
2**18 features, scaled by the log ratio of their class counts, and a linear hinge-loss model is fitted on them by dual
coordinate descent. Margins become scores by a logistic curve fitted on rows kept back from the fit.

Defined results: null or empty text has no n-grams and scores by the bias alone; rows without a label teach nothing; with one
class only (or none) among the labels every score is that class's share (or 0.5); repeated rows score alike; null ids are never
held out; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fusegrid.llm.common import mix64, span_hashes, text_bytes, word_spans

FEATURES = 1 << 18
#: At most so many labelled rows are fitted, those first in the order of a hash of their ids.
SAMPLE_ROWS = 16_000
PENALTY = 0.5
EPOCHS = 8
SMOOTH = 1.0


def _classes() -> np.ndarray:
    """Coarse classes of bytes: lower, upper, digit, stop, other mark, beyond ASCII."""
    out = np.full(256, 4, np.uint64)
    out[ord("a") : ord("z") + 1], out[ord("A") : ord("Z") + 1], out[ord("0") : ord("9") + 1] = 0, 1, 2
    out[[ord(c) for c in ".,;:?'\""]] = 3
    out[128:] = 5
    return out


_CLASS = _classes()


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of each indicator, sorted, without repeats."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    starts, ends = word_spans(data)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edges = np.cumsum([0] + [len(t) + 1 for t in texts])
    row = (np.searchsorted(edges, starts, "right") - 1).astype(np.uint64)
    word = span_hashes(data, starts, ends)
    tail = span_hashes(data, np.maximum(starts, ends - 3), ends)
    head = span_hashes(data, starts, np.minimum(ends, starts + 3))
    length = np.minimum(ends - starts, 12).astype(np.uint64) // np.uint64(3)
    shape = (_CLASS[data[starts]] * np.uint64(8) + _CLASS[data[ends - 1]]) * np.uint64(8) + length
    same = row[1:] == row[:-1]
    two = mix64(word[:-1] * np.uint64(3) + word[1:])[same]
    shapes = mix64(shape[:-1] * np.uint64(1000003) + shape[1:])[same]
    keys = [_keys(row, word, 1), _keys(row, tail, 2), _keys(row, head, 3), _keys(row[1:][same], shapes, 4)]
    n = len(texts)
    pairs = np.bincount(row[1:][same].astype(np.int64), minlength=n)
    kinds = np.bincount((np.unique(_keys(row[1:][same], two, 0, 1 << 32)) >> np.uint64(32)).astype(np.int64), minlength=n)
    for salt, total in ((5, pairs), (6, np.bincount(row.astype(np.int64), minlength=n))):
        some = np.flatnonzero(total)
        level = (10 * kinds[some] / np.maximum(1, pairs[some])).astype(np.uint64) if salt == 5 else np.log2(total[some]).astype(np.uint64)
        keys.append(_keys(some.astype(np.uint64), mix64(level + np.uint64(1)), salt))
    keys = np.unique(np.concatenate(keys))
    return (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(FEATURES - 1)).astype(np.int64)


def _keys(row: np.ndarray, value: np.ndarray, salt: int, size: int = FEATURES) -> np.ndarray:
    return (row << np.uint64(32)) | (mix64(value + np.uint64(salt * 7919)) & np.uint64(size - 1))


@dataclass
class QualityModel:
    weights: np.ndarray
    squares: np.ndarray
    bias: float
    slope: float
    offset: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        row, feature = features(texts)
        length = np.sqrt(np.bincount(row, weights=self.squares[feature], minlength=len(texts)))
        margin = np.bincount(row, weights=self.weights[feature], minlength=len(texts)) / np.maximum(length, 1e-9) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def _log_ratio(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    by = {}
    for label in (0, 1):
        own = [r for r, c in zip(rows, y, strict=True) if c == label]
        count = np.bincount(np.concatenate(own) if own else np.zeros(0, np.int64), minlength=FEATURES) + SMOOTH
        by[label] = np.log(count / count.sum())
    return by[1] - by[0]


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, penalty: float = PENALTY, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model with L2 penalty; y is -1 or 1. Each dual variable stays in [0, penalty]."""
    w, bias = np.zeros(FEATURES), 0.0
    alpha = np.zeros(len(rows))
    # rows are brought to unit length, so that long texts don't rule
    values = [v / max(1e-9, np.sqrt((v * v).sum())) for v in (scale[r] for r in rows)]
    norm = np.array([(v * v).sum() + 1.0 for v in values])
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            r, v = rows[i], values[i]
            gradient = y[i] * (w[r] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), penalty)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[r] += step * v
                bias += step
                alpha[i] = new
    return w, bias


def fit(rows: list[np.ndarray], labels: np.ndarray) -> QualityModel:
    """A model from sorted feature lists and 0/1 labels; every fifth row is kept for the logistic curve."""
    labels = np.asarray(labels)
    if len(set(labels.tolist())) < 2:
        share = float(np.clip(labels.mean() if len(labels) else 0.5, 0.01, 0.99))
        return QualityModel(np.zeros(FEATURES), np.zeros(FEATURES), 0.0, 0.0, float(np.log(share / (1 - share))))
    back = np.arange(len(rows)) % 5 == 4
    if len(set(labels[~back].tolist())) < 2 or len(set(labels[back].tolist())) < 2:
        back[:] = False
    train = [r for r, b in zip(rows, back, strict=True) if not b]
    y = np.where(labels[~back] == 1, 1.0, -1.0)
    scale = _log_ratio(train, labels[~back])
    w, bias = dual_coordinate_descent(train, y, scale)
    weights, squares = w * scale, scale**2
    margins = np.array([weights[r].sum() / max(1e-9, np.sqrt(squares[r].sum())) for r in rows]) + bias
    use = back if back.any() else ~back
    slope, offset = _logistic(margins[use], labels[use])
    return QualityModel(weights, squares, bias, slope, offset)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps, with targets drawn in a little and a weak pull to slope 1."""
    t = np.where(y == 1, 1 - 1 / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((p - t) * x).sum() + 0.01 * (a - 1), (p - t).sum() + 0.01 * b])
        q = p * (1 - p) + 1e-9
        h = np.array([[(q * x * x).sum() + 0.01, (q * x).sum()], [(q * x).sum(), q.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 0.0)), float(b)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Fit on the rows of ``labels`` (those that may be learned from), at most SAMPLE_ROWS of them."""

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            row, feature = features(text_bytes(batch))
            at = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(feature.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("_h"), batch.column("_y"), lists], ["h", "y", "f"])

    some = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"), F.xxhash64(id_col).alias("_h"))
    some = F.broadcast(some.orderBy("_h", "_y").limit(SAMPLE_ROWS))  # bounded by the limit, as is what comes to the driver
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(some, "_id")
    table = own.select("_h", "_y", "text").mapInArrow(rows, "h long, y int, f array<int>").toArrow()
    h, y = table.column("h").to_numpy(), table.column("y").to_numpy()
    f = table.column("f").combine_chunks()
    if hasattr(f, "chunks"):
        f = f.chunk(0) if f.num_chunks else None
    n = len(y)
    if not n:
        return fit([], np.zeros(0, np.int64))
    flat, ends = f.flatten().to_numpy(), f.offsets.to_numpy()
    order = np.lexsort((y, h))
    return fit([flat[ends[i] : ends[i + 1]] for i in order], y[order])


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score double for every document."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(text_bytes(batch)), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")
