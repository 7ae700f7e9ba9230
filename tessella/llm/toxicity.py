"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

One weight vector over hashed features is shared by all ordered thresholds: P(grade >= k) =
sigmoid(w.x - theta_k) with theta_1 < theta_2 < ... Expected severity is the sum of these probabilities. The features
of a text are its words and their beginnings of four to seven letters, so forms of a known word tell as well.

Trained with numpy on the driver from at most ``max_train`` labelled rows (a bounded, hashed sample). Features are counted
by class on Spark; those that do not tell the classes apart (by a two-proportion z-score, either way) are left out, so chance words of
long documents carry no weight, and all others are kept, in sparse rows. Where a label has only two values, the grades of its
positive rows follow an out-of-fold score: how sure a model is of them that has not seen them. Severity then means that certainty, cut in
grades; with a label of more grades it would be theirs.
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

from tessella.llm.quality import labelled_sample

BUCKETS = 1 << 20
GRADES = 4
BEGINNINGS = (4, 5, 6, 7)
FOLDS = 5
_WORDS = re.compile(r"\w+")
_CACHE = 300_000


def features_of(word: str) -> tuple[int, ...]:
    """Buckets of a word and of its beginnings, in lower case."""
    low = word.lower()
    code = lambda s: crc32(s.encode("utf-8", "surrogatepass")) % BUCKETS
    return (code(low), *(code(f"{low[:k]}~") for k in BEGINNINGS if len(low) > k))


class Features(dict):
    """Feature buckets by word, those in ``wanted`` if given; keeps at most ``_CACHE`` words."""

    def __init__(self, wanted: set[int] | None = None) -> None:
        super().__init__()
        self.wanted = wanted

    def __missing__(self, word: str) -> tuple[int, ...]:
        codes = features_of(word)
        if self.wanted is not None:
            codes = tuple(c for c in codes if c in self.wanted)
        if len(self) >= _CACHE:
            self.clear()
        self[word] = codes
        return codes

    def buckets(self, text: str) -> list[int]:
        return [c for w in _WORDS.findall(text) for c in self[w]]


@dataclass
class Rows:
    """Sparse rows: of entry i, its row, column and value."""

    row: np.ndarray
    column: np.ndarray
    value: np.ndarray
    shape: tuple[int, int]

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], self.shape[0])

    def back(self, d: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.value * d[self.row], self.shape[1])

    def where(self, kept: np.ndarray) -> Rows:
        at = np.cumsum(kept) - 1
        mine = kept[self.row]
        return Rows(at[self.row[mine]], self.column[mine], self.value[mine], (int(kept.sum()), self.shape[1]))


def strength(n: np.ndarray, most: int = 50) -> np.ndarray:
    """How much ``n`` occurrences of a feature count: their number, as one alone is often chance; beyond ``most`` nothing is added."""
    return np.minimum(n, most).astype(np.float64)


@dataclass
class SeverityModel:
    weight: dict[int, float]  # by bucket
    thresholds: np.ndarray
    most: int = 50  # occurrences of a feature in a text that count

    def at_least(self, buckets: list[int]) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ...; a feature counts by ``strength``. Other buckets than the model's must not come."""
        total = 0.0
        if buckets:
            which, n = np.unique(buckets, return_counts=True)
            total = float(np.array([self.weight[b] for b in which.tolist()]) @ strength(n, self.most))
        return 1 / (1 + np.exp(-np.clip(total - self.thresholds, -30, 30)))


def loss_and_slopes(x: Rows, grade: np.ndarray, weight: np.ndarray, theta: np.ndarray, decay: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood with the weights' penalty, and its slopes by weight and threshold."""
    n, rows = len(grade), np.arange(len(grade))
    p = 1 / (1 + np.exp(-np.clip(x.times(weight)[:, None] - theta, -30, 30)))
    edge = np.concatenate([np.ones((n, 1)), p, np.zeros((n, 1))], 1)
    mass = (edge[rows, grade] - edge[rows, grade + 1]).clip(1e-12)
    slope = edge * (1 - edge)  # d p / d (w.x - theta)
    upper, lower = slope[rows, grade] / mass / n, slope[rows, grade + 1] / mass / n
    by_theta = np.bincount(grade, upper, theta.size + 2) - np.bincount(grade + 1, lower, theta.size + 2)
    return float(-np.log(mass).mean() + decay / 2 * weight @ weight), x.back(lower - upper) + decay * weight, by_theta[1:-1]


def first_thresholds(grade: np.ndarray) -> np.ndarray:
    """Thresholds that give each grade its share where nothing else is known."""
    share = np.array([(grade >= j).mean() for j in range(1, int(grade.max(initial=1)) + 1)]).clip(1e-3, 1 - 1e-3)
    return np.log((1 - share) / share)


def fit_thresholds(x: Rows, grade: np.ndarray, rounds: int = 500, rate: float = 0.05, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the cumulative-link model by Adam. Thresholds are the first one and the logs of the further steps."""
    first = first_thresholds(grade)
    params = [np.zeros(x.shape[1]), first[:1].copy(), np.log(np.diff(first).clip(0.2))]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, rounds + 1):
        theta = np.cumsum(np.concatenate([params[1], np.exp(params[2])]))
        _, by_weight, by_theta = loss_and_slopes(x, grade, params[0], theta, decay)
        tail = np.cumsum(by_theta[::-1])[::-1]
        for i, g in enumerate((by_weight, tail[:1], tail[1:] * np.exp(params[2]))):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            params[i] = params[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return params[0], np.cumsum(np.concatenate([params[1], np.exp(params[2])]))


def graded(x: Rows, positive: np.ndarray, fold: np.ndarray, grades: int = GRADES) -> np.ndarray:
    """Grade 0 where the label is 0; else 1 to ``grades - 1`` by how a model of the other folds scores the row. Grades without rows are left out."""
    score = np.zeros(positive.size)
    for f in range(FOLDS):
        mine = fold == f
        if mine.any() and 0 < positive[~mine].sum() < (~mine).sum():
            weight, _ = fit_thresholds(x.where(~mine), positive[~mine], rounds=150)
            score[mine] = x.where(mine).times(weight)
    cuts = np.quantile(score[positive == 1], np.arange(1, grades - 1) / (grades - 1))
    grade = np.where(positive == 1, 1 + np.searchsorted(cuts, score, side="left"), 0)
    return np.searchsorted(np.unique(grade), grade)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, having, with_1): how many of the task's rows have each feature, and how many of those are of label 1."""
    features, having, with_1 = Features(), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for text, label in zip(batch.column("text"), batch.column("label").to_pylist()):
            mine = np.unique(np.array(features.buckets(text.as_py() or ""), np.int64))
            having[mine] += 1
            with_1[mine] += label
    at = np.flatnonzero(having)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(having[at]), pa.array(with_1[at])], names=["bucket", "having", "with_1"])


def train_severity_model(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
                         max_train: int = 20_000, grades: int = GRADES, least_z: float = 5.0, most: int = 50) -> SeverityModel:
    """Fit on a 0/1 label of at most ``max_train`` rows.

    A null text has no features; null labels and ids teach nothing; of repeated ids one row counts. Every feature that tells the labels
    apart by ``least_z`` or more, for either of them, and that five rows or more but not all have, is kept. Without such a feature every text has
    the labels' shares as its score. Without rows of both labels, as with empty tables, the model knows no feature and finds nothing toxic.
    """
    sample = labelled_sample(docs, labels, label, id_col, text_col, max_train)
    none = SeverityModel({}, np.full(grades - 1, 5.0))
    total, ones = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < ones < total:
        return none
    counts = sample.select("text", "label").mapInArrow(_counted, "bucket int, having long, with_1 long").groupBy("bucket").agg(F.sum("having").alias("n"), F.sum("with_1").alias("k"))
    z = (F.col("k") / F.col("n") - ones / total) / F.sqrt(F.lit(ones / total * (1 - ones / total)) / F.col("n"))
    chosen = sorted(r[0] for r in counts.where((F.abs(z) >= least_z) & (F.col("n") >= 5) & (F.col("n") < total)).select("bucket").collect())  # at most BUCKETS numbers
    if not chosen:
        return SeverityModel({}, np.repeat(first_thresholds(np.repeat([0, 1], [total - ones, ones])), grades - 1) + np.arange(grades - 1) * np.log(2), most)
    wanted = sample.sparkSession.sparkContext.broadcast(set(chosen))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(wanted.value)
        for batch in batches:
            found = [np.unique(features.buckets(t.as_py() or ""), return_counts=True) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.string()), batch.column("label"), pa.array([b for b, _ in found], pa.list_(pa.int32())), pa.array([n for _, n in found], pa.list_(pa.int32()))], names=["id", "label", "bucket", "n"])

    table = sample.select("id", "text", "label").mapInArrow(told, "id string, label int, bucket array<int>, n array<int>").toArrow().sort_by("id").combine_chunks()
    positive = table.column("label").to_numpy().astype(np.int64)
    lists = table.column("bucket").combine_chunks()
    row = np.repeat(np.arange(positive.size), np.diff(lists.offsets.to_numpy()))
    column, n = np.searchsorted(chosen, lists.flatten().to_numpy()), table.column("n").combine_chunks().flatten().to_numpy()
    x = Rows(row, column, strength(n, most), (positive.size, len(chosen)))
    fold = np.array([crc32(i.encode()) % FOLDS for i in table.column("id").to_pylist()])
    weight, thresholds = fit_thresholds(x, graded(x, positive, fold, grades))
    return SeverityModel(dict(zip(chosen, weight.tolist())), thresholds, most)


def score_severity(docs: DataFrame, model: SeverityModel, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.2) -> DataFrame:
    """``id_col``, ``severity`` (expected grade), ``grade``, ``score`` (P(grade >= 1)), ``toxic`` (score >= ``cut``) for every row.

    ``grade`` is 0 where the row is not toxic, else the likeliest from 1. A null text scores as an empty one; texts of any
    length are read whole. Only the id and the text are read; repeated rows score alike; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, k = Features(set(shared.value.weight)), shared.value.thresholds.size
        for batch in batches:
            p = np.array([shared.value.at_least(features.buckets(t.as_py() or "")) for t in batch.column("text")]).reshape(-1, k)
            mass = -np.diff(p, axis=1, append=0.0)  # of the grades from 1
            toxic = p[:, 0] >= cut
            grade = np.where(toxic, 1 + mass.argmax(1), 0).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(p.sum(1)), pa.array(grade), pa.array(p[:, 0]), pa.array(toxic)], names=["id", "severity", "grade", "score", "toxic"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(score, f"id {rows.schema['id'].dataType.simpleString()}, severity double, grade int, score double, toxic boolean").withColumnRenamed("id", id_col)
