"""Quality scores: random-indexing word vectors, pooled per document, under a two-layer network.

Random indexing gives each token bucket a sparse random index vector; a token's own vector is the sum of
the index vectors around it over the training sample (plus its own). A document is the mean of its tokens'
vectors beside a few shares (repeated tokens, capitals, symbols, distinct tokens, length). The network
is trained with numpy on the driver from at most ``max_train`` labelled rows (a bounded, hashed sample), and its
logits are divided by a temperature fitted on rows that the training left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.store import stored

BUCKETS = 1 << 15
SIZE = 32
WINDOW = 2
SHARES = 6
_TOKENS = re.compile(r"\w+|[^\w\s]+")
_CACHE = 300_000
_STEP = 1 << 18


def index_vectors(seed: int = 7) -> np.ndarray:
    """A sparse vector for each bucket: two +1 and two -1."""
    rng = np.random.default_rng(seed)
    out = np.zeros((BUCKETS, SIZE), np.float32)
    at = rng.permuted(np.tile(np.arange(SIZE), (BUCKETS, 1)), axis=1)[:, :4]
    np.put_along_axis(out, at, np.array([1, 1, -1, -1], np.float32), axis=1)
    return out


class Tokens:
    """Token buckets of texts; bit 15 up: 1 for capitals, 2 for symbols. Keeps at most ``_CACHE`` tokens."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def _code(self, token: str) -> int:
        flags = (token.isupper() and len(token) > 1) + 2 * (not (token[0].isalnum() or token[0] == "_"))
        code = crc32(token.lower().encode("utf-8", "surrogatepass")) % BUCKETS + flags * BUCKETS
        if len(self.known) >= _CACHE:
            self.known.clear()
        self.known[token] = code
        return code

    def codes(self, text: str) -> np.ndarray:
        get, code = self.known.get, self._code
        return np.fromiter((c if (c := get(t)) is not None else code(t) for t in _TOKENS.findall(text)), np.int64)


def features(codes: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The pooled vector and the shares of one document."""
    out = np.zeros(SIZE + SHARES, np.float32)
    if not codes.size:
        return out
    bucket = codes % BUCKETS
    for at in range(0, codes.size, _STEP):
        out[:SIZE] += vectors[bucket[at : at + _STEP]].sum(0)
    out[:SIZE] /= codes.size
    flags = codes // BUCKETS
    same = [(bucket[k:] == bucket[:-k]).mean() if codes.size > k else 0.0 for k in (1, 2)]
    distinct = np.count_nonzero(np.bincount(bucket, minlength=1)) / codes.size
    out[SIZE:] = (*same, (flags & 1).mean(), (flags & 2).mean() / 2, distinct, np.log1p(codes.size) / 10)
    return out


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index, tokens = index_vectors(), Tokens()
    total = np.zeros((BUCKETS, SIZE), np.float64)
    for batch in batches:
        for text in batch.column("text"):
            bucket = tokens.codes(text.as_py() or "") % BUCKETS
            if not bucket.size:
                continue
            near = index[bucket].astype(np.float64)
            around = near.copy()
            for k in range(1, WINDOW + 1):
                around[k:] += near[:-k]
                around[:-k] += near[k:]
            np.add.at(total, bucket, around)
    at = np.flatnonzero(total.any(1))
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(list(total[at]), pa.list_(pa.float64()))], names=["bucket", "sums"])


@dataclass
class QualityModel:
    vectors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, np.ndarray, np.ndarray, float]
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.centre) / self.scale @ w1 + b1) @ w2 + b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = 24, rounds: int = 400, seed: int = 11) -> tuple[tuple, float]:
    """Adam over all rows; a fifth of them is left out and then sets the temperature. x is already scaled."""
    rng = np.random.default_rng(seed)
    left_out = rng.random(len(y)) < 0.2 if len(y) >= 50 else np.zeros(len(y), bool)
    tx, ty = x[~left_out], y[~left_out]
    share = ty.mean().clip(0.02, 0.98)
    weight = np.where(ty > 0, 0.5 / share, 0.5 / (1 - share)) ** 0.5  # eases, but does not undo, the classes' sizes
    params = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.array(np.log(share / (1 - share)))]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, rounds + 1):
        h = np.tanh(tx @ params[0] + params[1])
        p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -30, 30)))
        d = weight * (p - ty) / len(ty)
        dh = d[:, None] * params[2] * (1 - h * h)
        grads = [tx.T @ dh + 1e-4 * params[0], dh.sum(0), h.T @ d + 1e-4 * params[2], d.sum()]
        for k, g in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            params[k] = params[k] - 0.02 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    vx, vy = (x[left_out], y[left_out]) if left_out.any() else (tx, ty)
    z = np.tanh(vx @ params[0] + params[1]) @ params[2] + params[3]

    def loss(temperature: float) -> float:
        return float(np.mean(np.logaddexp(0, -(2 * vy - 1) * z / temperature)))

    return (params[0], params[1], params[2], float(params[3])), min(np.exp(np.linspace(-1.5, 2.5, 81)), key=loss)


def _featurise(batches: Iterator[pa.RecordBatch], vectors: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    tokens = Tokens()
    for batch in batches:
        rows = [features(tokens.codes(t.as_py() or ""), vectors) for t in batch.column("text")]
        yield batch, np.stack(rows) if rows else np.zeros((0, SIZE + SHARES), np.float32)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, max_train: int) -> DataFrame:
    """``id``, ``text``, ``label`` of at most ``max_train`` labelled rows, written once.

    A document with several labels takes their mean, rounded up at a half; null labels and ids teach nothing. The ids are
    the first by a hash, so the sample is bounded whatever the size of the tables, and small enough to broadcast. Of several
    rows of one id that with the smallest hash of its text stands for all; they are cut in each task before they meet.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.avg(label) >= 0.5).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64(F.lit("share"), "id"), "id").limit(max_train)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(F.col("id").isNotNull())
    one = F.min_by("text", F.struct(F.col("text").isNull(), F.xxhash64("text")))
    return stored(rows.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(one.alias("text")).select("id", "text", "label"), "labelled-sample")


def train_quality_model(sample: DataFrame) -> QualityModel | None:
    """Fit on a bounded sample (id, text, label), whose size bounds what the driver receives; None if it has no rows.

    A null text is an empty one, with features of zero.
    """
    parts = sample.repartition(8, "id").select("text").mapInArrow(_contexts, "bucket int, sums array<double>").toArrow()
    vectors = np.zeros((BUCKETS, SIZE))
    for bucket, sums in zip(parts.column("bucket").chunks, parts.column("sums").chunks):
        if len(bucket):
            np.add.at(vectors, bucket.to_numpy(), sums.flatten().to_numpy().reshape(-1, SIZE))
    vectors = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True).clip(1e-9)).astype(np.float32)
    shared = sample.sparkSession.sparkContext.broadcast(vectors)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _featurise(batches, shared.value):
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.string()), batch.column("label"), pa.array(list(x), pa.list_(pa.float32()))], names=["id", "label", "x"])

    table = sample.select("id", "text", "label").mapInArrow(rows, "id string, label int, x array<float>").toArrow().sort_by("id")
    if not table.num_rows:
        return None
    x = np.concatenate([c.flatten().to_numpy().reshape(-1, SIZE + SHARES) for c in table.column("x").chunks if len(c)]).astype(np.float64)
    y = table.column("label").to_numpy().astype(np.float64)
    centre, scale = x.mean(0), x.std(0).clip(1e-3)
    layers, temperature = fit_network((x - centre) / scale, y)
    return QualityModel(vectors, centre, scale, layers, float(temperature))


def score_quality(docs: DataFrame, model: QualityModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``score`` (0 to 1), ``predicted`` (1 from a score of 0.5) for every row of ``docs``.

    A null text scores as an empty one, which has features of zero. Without a model every score is 0.5. Only the id
    and the text are read; repeated rows score alike.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    if model is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _featurise(batches, shared.value.vectors):
            p = shared.value.probability(x)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], names=["id", "score", "predicted"])

    return rows.mapInArrow(score, f"id {rows.schema['id'].dataType.simpleString()}, score double, predicted int").withColumnRenamed("id", id_col)
