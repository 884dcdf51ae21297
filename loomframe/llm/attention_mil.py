"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of `PASSAGE` words. Each passage is described by counts of character classes, of repeated
words, and of words by `BUCKETS` hash buckets with signs, encoded by one hidden layer, and weighted by gated attention, softmax(w . (tanh(V h) * sigmoid(U h)));
the weighted mean of the encodings gives the document's logit. All weights are learnt together from document labels, by
full-batch Adam in numpy on the driver, on a sample of at most `SAMPLE` labelled rows (those with the smallest hash of
the id) with all their passages. Scoring uses every passage of every text in one pass without a shuffle.

Defined cases: a null or empty text is one passage without words; label rows without a document, or with a null label,
teach nothing; two labels of one document both teach; with no usable label every score is 0.5; repeated rows get equal
scores; very long texts are read whole; only the text enters a score; columns of any name pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import STEP_BYTES, byte_view, fresh, lowered, mixed, pieces_of, within, word_bounds, word_hashes

_U = np.uint64
PASSAGE = 64
SAMPLE = 6_000
HIDDEN, GATES, ROUNDS, RATE, DECAY = 32, 16, 400, 0.03, 1e-4
#: Hash buckets of words.
BUCKETS = 64

_CLASSES = ["#*$%&<>@^~", "|", "!", ".", ",", "?;:", "0123456789", "\n", "\"'()[]{}", "/\\=+_-", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
_CLASS = np.zeros((len(_CLASSES) + 1, 256), bool)
for _i, _c in enumerate(_CLASSES):
    _CLASS[_i, [ord(x) for x in _c]] = True
_CLASS[-1, 0xC2:0xF5] = True
COUNTS = len(_CLASSES) + 1 + 9
FEATURES = COUNTS + BUCKETS


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages (rows) and offsets by text; a text without words has one passage."""
    starts, ends, own = word_bounds(data, offsets)
    count = np.diff(own)
    many = np.maximum(-(-count // PASSAGE), 1)
    bag = np.concatenate([[0], np.cumsum(many)])
    total = int(bag[-1])
    row = np.repeat(np.arange(len(count)), many)
    number = np.arange(total) - bag[row]
    a = np.minimum(own[row] + number * PASSAGE, own[row + 1])
    b = np.minimum(a + PASSAGE, own[row + 1])
    last = number == many[row] - 1
    begin = np.where(number == 0, offsets[row], np.append(starts, len(data))[np.minimum(a, len(starts))])
    stop = np.where(last, offsets[row + 1], np.append(starts, len(data))[np.minimum(b, len(starts))])
    n = np.maximum(b - a, 1).astype(np.float64)
    size = np.maximum(stop - begin, 1).astype(np.float64)
    out = np.zeros((total, FEATURES))
    for i in range(len(_CLASS)):
        sums = np.concatenate([[0], np.cumsum(_CLASS[i][data], dtype=np.int32)])
        out[:, i] = (sums[stop] - sums[begin]) / size
    k = len(_CLASS)
    width = np.concatenate([[0], np.cumsum(ends - starts)])
    out[:, k] = (width[b] - width[a]) / n / 8
    out[:, k + 1] = np.log1p(b - a)
    out[:, k + 2] = np.log1p(count[row])
    if len(starts):
        h = word_hashes(lowered(data), starts, ends)
        doc = within(own)
        place = bag[doc] + (np.arange(len(h)) - own[doc]) // PASSAGE
        again = np.concatenate([[0], np.cumsum(np.concatenate([[False], (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])]))])
        out[:, k + 3] = (again[b] - again[a]) / n
        whole = np.unique(mixed(h + place.astype(_U) * _U(0x9E3779B97F4A7C15)) >> _U(24) | place.astype(_U) << _U(40))
        out[:, k + 4] = np.bincount((whole >> _U(40)).astype(np.int64), minlength=total) / n
        short = np.concatenate([[0], np.cumsum(ends - starts == 1)])
        out[:, k + 5] = (short[b] - short[a]) / n
        tail = data[ends - 1]
        marked = np.concatenate([[0], np.cumsum(_CLASS[0][tail] | (tail == 0x21) | (tail == 0x7C))])
        out[:, k + 6] = (marked[b] - marked[a]) / n
        # 3-word windows that the text has already had.
        if len(h) > 2:
            three = mixed(h[:-2] * _U(3) + h[1:-1] * _U(0x9E3779B97F4A7C15) + h[2:])
            fit = doc[:-2] == doc[2:]
            key = np.where(fit, mixed(three + doc[:-2].astype(_U)), np.arange(len(three), dtype=_U))
            _, first = np.unique(key, return_index=True)
            old = np.ones(len(key), bool)
            old[first] = False
            old = np.concatenate([[0], np.cumsum(np.append(old & fit, [False, False]))])
            out[:, k + 7] = (old[b] - old[a]) / n
        sign = (h & _U(1)).astype(np.float64) * 2 - 1
        cell = place * BUCKETS + (h >> _U(40)).astype(np.int64) % BUCKETS
        out[:, COUNTS:] = np.bincount(cell, sign, total * BUCKETS).reshape(total, BUCKETS) / np.sqrt(n)[:, None]
    lines = np.concatenate([[0], np.cumsum(data == 0x0A)])
    out[:, k + 8] = np.log1p((stop - begin) / (lines[stop] - lines[begin] + 1))
    return out.astype(np.float32), bag


class Model:
    """Weights of the encoder, the attention and the output."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 8):
        r = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        sizes = ((FEATURES, HIDDEN), 1 / np.sqrt(FEATURES)), (HIDDEN, 0.0), ((HIDDEN, GATES), 0.2), ((HIDDEN, GATES), 0.2), (GATES, 0.2), (HIDDEN, 0.2), (1, 0.0)
        self.w = [r.normal(0, deviation, size) for size, deviation in sizes]

    def forward(self, x: np.ndarray, bag: np.ndarray) -> tuple[np.ndarray, tuple]:
        w, b, v, u, g, o, c = self.w
        h = np.tanh(x @ w + b)
        t, s = np.tanh(h @ v), 1 / (1 + np.exp(-(h @ u)))
        e = (t * s) @ g
        at = bag[:-1]
        row = within(bag)
        e = np.exp(e - np.maximum.reduceat(e, at)[row])
        weight = e / np.add.reduceat(e, at)[row]
        z = np.add.reduceat(weight[:, None] * h, at)
        return 1 / (1 + np.exp(-np.clip(z @ o + c, -40, 40))), (h, t, s, weight, z, row)

    def gradient(self, x: np.ndarray, bag: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        w, b, v, u, g, o, c = self.w
        p, (h, t, s, weight, z, row) = self.forward(x, bag)
        d = (p - y) / len(y)
        dz = d[:, None] * o
        through = (dz[row] * h).sum(axis=1)
        de = weight * (through - np.add.reduceat(weight * through, bag[:-1])[row])
        dt, ds = de[:, None] * s * g * (1 - t * t), de[:, None] * t * g * s * (1 - s)
        dh = weight[:, None] * dz[row] + dt @ v.T + ds @ u.T
        da = dh * (1 - h * h)
        return [x.T @ da + DECAY * w, da.sum(axis=0), h.T @ dt + DECAY * v, h.T @ ds + DECAY * u, (de[:, None] * t * s).sum(axis=0), z.T @ d + DECAY * o, np.array([d.sum()])]

    def fit(self, x: np.ndarray, bag: np.ndarray, y: np.ndarray) -> Model:
        """Trains in single precision, which halves the time."""
        x, y = x.astype(np.float32), y.astype(np.float32)
        self.w = [p.astype(np.float32) for p in self.w]
        first, second = [np.zeros_like(p) for p in self.w], [np.zeros_like(p) for p in self.w]
        for step in range(1, ROUNDS + 1):
            rate = RATE * min(1.0, 2 * (1 - step / (ROUNDS + 1)))
            for i, g in enumerate(self.gradient(x, bag, y)):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                self.w[i] = self.w[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
        self.w = [p.astype(np.float64) for p in self.w]
        return self

    def score(self, x: np.ndarray, bag: np.ndarray) -> np.ndarray:
        return self.forward((x - self.mean) / self.scale, bag)[0]


def train(docs: DataFrame, labels: DataFrame, use: Column, label: str = "quality", key: str = "doc_id", sample: int = SAMPLE) -> Model | None:
    """A model from the labelled rows for which `use` holds; the sample is the rows with the smallest hash of the key."""
    chosen = labels.filter(use & F.col(label).isNotNull()).select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("key"), "key", "label").limit(sample)
    texts = docs.select(F.col(key).alias("key"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "key")  # at most `sample` rows

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, "text", 1 << 20):
                x, bag = passages(*byte_view(part.column("text")))
                out = [x[a:b].tobytes() for a, b in zip(bag[:-1].tolist(), bag[1:].tolist())]
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("label"), pa.array(out, pa.binary())], names=["key", "label", "x"])

    kind = docs.schema[key].dataType.simpleString()
    rows = texts.mapInArrow(encode, f"key {kind}, label int, x binary").orderBy("key", "label", "x").limit(sample).collect()
    if not rows:
        return None
    parts = [np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES) for r in rows]
    bag = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    x = np.concatenate(parts).astype(np.float64)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    return Model(mean, scale).fit((x - mean) / scale, bag, np.array([r["label"] for r in rows], np.float64))


def score(docs: DataFrame, model: Model | None, name: str = "_score") -> DataFrame:
    """All columns of `docs` and the score under the given name, which none of them may have."""
    text = F.coalesce("text", F.lit("")).alias("text")
    if fresh(docs.columns, name) != name:
        raise ValueError(f"the input has a column {name}; give another name for the score")
    inner = docs.select(text, F.struct(*docs.columns).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, "text", STEP_BYTES):
                n = part.num_rows
                own = model.score(*passages(*byte_view(part.column("text")))) if model is not None and n else np.full(n, 0.5)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(own, pa.float64())], names=["row", "score"])

    row = docs.schema.simpleString()
    return inner.mapInArrow(run, f"row {row}, score double").select(*(F.col("row")[c].alias(c) for c in docs.columns), F.col("score").alias(name))
