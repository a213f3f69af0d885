"""Quality by ordinal cumulative-link regression on graded ratings.

One weight for each hashed text feature is shared by all grades; ordered thresholds turn the weighted sum
into P(grade > k) = sigmoid(sum - threshold_k), from which come the expected grade and any tail probability.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_of_id, documents, id_and_text, per_slice, slices, utf8

DIMENSIONS = 1 << 16
#: Labelled rows a fit reads at most, and passes of its gradient descent.
FIT_ROWS = 12_000
FIT_STEPS = 120
FOLDS = 5

#: Letters, capitals and digits become one byte each; other bytes stay.
_SHAPE = bytes(b"A"[0] if 65 <= i <= 90 else b"0"[0] if 48 <= i <= 57 else b"a"[0] if i >= 128 or 97 <= i <= 122 else i for i in range(256))


class _Hashes(dict):
    """Feature numbers by name, kept up to a bound."""

    def __missing__(self, name: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[name] = got = zlib.crc32(name) % DIMENSIONS
        return got


_hashes = _Hashes()


def features(text: bytes) -> np.ndarray:
    """Distinct feature numbers of a text: its words, and how often each word shape is used (by powers of two
    of its share), with the text's length and repetition. An empty text has its length feature only."""
    words = text.lower().split()
    n = len(words)
    got = {_hashes[w] for w in words}
    shapes = text.translate(_SHAPE).split()
    seen: dict[bytes, int] = {}
    for s in shapes:
        s = s[:1] + s[-3:]
        seen[s] = seen.get(s, 0) + 1
    # a share of 1/2^k counts as all smaller ones too, so that weights add up along it
    for s, c in seen.items():
        level = min(7, int(np.log2(n / c)))
        got.update(_hashes[b"\x00%d%s" % (k, s)] for k in range(level, 8))
    lines = text.split(b"\n")
    again = 1 - len(set(lines)) / len(lines)
    got.add(_hashes[b"\x01%d" % n.bit_length()])
    got.update(_hashes[b"\x02%d" % k] for k in range(int(again * 8)))
    rate = len(set(words)) / n if n else 1.0
    got.update(_hashes[b"\x03%d" % k] for k in range(int(rate * 8)))
    return np.fromiter(got, np.int64, len(got))


@dataclass
class CumulativeLink:
    """Weights by feature, and ascending thresholds between grades."""

    weights: np.ndarray
    thresholds: np.ndarray

    def sums(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[r].sum() / np.sqrt(len(r)) if len(r) else 0.0 for r in rows])

    def tails(self, rows: list[np.ndarray]) -> np.ndarray:
        """P(grade > k) for each row and threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - self.sums(rows)[:, None], -50, 50)))


def fit(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, steps: int = FIT_STEPS, ridge: float = 1e-3, rate: float = 0.25) -> CumulativeLink:
    """Maximum likelihood by Adam over all rows; thresholds are the first one and positive gaps, so they stay
    ordered. A grade that never occurs only widens its neighbours' gap."""
    index = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    size = np.array([len(r) for r in rows], np.int64)
    row = np.repeat(np.arange(len(rows)), size)
    value = np.repeat(1 / np.sqrt(np.maximum(size, 1)), size)
    above = [float(np.clip(np.mean(grades > k), 0.01, 0.99)) if len(grades) else 0.5 for k in range(n_grades - 1)]
    start = np.array([-np.log(a / (1 - a)) for a in above])
    gaps = np.log(np.expm1(np.maximum(np.diff(start), 0.05)))
    params = np.concatenate([np.zeros(DIMENSIONS), start[:1], gaps])
    first, second = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1 if rows else 1):
        weights, cut = params[:DIMENSIONS], _thresholds(params[DIMENSIONS:])
        sums = np.bincount(row, weights[index] * value, len(rows))
        edge = np.concatenate([np.ones((len(rows), 1)), 1 / (1 + np.exp(np.clip(cut[None, :] - sums[:, None], -50, 50))), np.zeros((len(rows), 1))], axis=1)
        slope = edge * (1 - edge)
        at = np.arange(len(rows))
        chance = np.maximum(edge[at, grades] - edge[at, grades + 1], 1e-9)
        low, high = slope[at, grades] / chance, slope[at, grades + 1] / chance
        by_sum = -(low - high) / len(rows)
        by_cut = np.zeros(n_grades + 1)
        np.add.at(by_cut, grades, low / len(rows))
        np.add.at(by_cut, grades + 1, -high / len(rows))
        by_cut = by_cut[1:n_grades]
        raw = params[DIMENSIONS + 1 :]
        by_params = np.concatenate([[by_cut.sum()], [by_cut[k + 1 :].sum() / (1 + np.exp(-raw[k])) for k in range(len(raw))]])
        grad = np.concatenate([np.bincount(index, value * by_sum[row], DIMENSIONS) + ridge * weights / len(rows) ** 0.5, by_params])
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        params = params - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return CumulativeLink(params[:DIMENSIONS].astype(np.float32), _thresholds(params[DIMENSIONS:]))


def _thresholds(raw: np.ndarray) -> np.ndarray:
    return np.cumsum(np.concatenate([raw[:1], np.log1p(np.exp(raw[1:]))]))


def graded(labels: DataFrame) -> DataFrame:
    """``doc_id, grade``: 0 for low quality, 1 for good but toxic, 2 for good. Rows without a quality or an id
    give no grade; a null toxic counts as not toxic. Of repeated ids the lowest grade counts."""
    good, toxic = F.col("quality").cast("int"), F.coalesce(F.col("toxic").cast("int"), F.lit(0))
    grade = F.when(good == 0, 0).otherwise(F.when(toxic == 1, 1).otherwise(2))
    rows = labels.where(good.isNotNull() & F.col("doc_id").isNotNull())
    return rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(grade).alias("grade"))


def fit_quality(docs: DataFrame, ratings: DataFrame, n_grades: int = 3, rows: int = FIT_ROWS) -> CumulativeLink:
    """Fits on at most ``rows`` ratings, those with the smallest hash of their id; features are made where the
    documents are and only they come to the driver."""
    sample = ratings.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # at most `rows` rows of 12 bytes, so it may be broadcast
    texts = id_and_text(docs).join(F.broadcast(sample), "doc_id")

    def fn(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "grade": batch.column("grade"), "index": [features(t).astype(np.int32) for t in utf8(batch.column("text"))]}

    got = per_slice(texts.select("doc_id", "text", "grade"), fn, "doc_id long, grade int, index array<int>").orderBy("doc_id").toArrow()
    return fit([np.array(x, np.int64) for x in got["index"].to_pylist()], got["grade"].to_numpy().astype(np.int64), n_grades)


def score_quality(docs: DataFrame, model: CumulativeLink, tail: int = 1) -> DataFrame:
    """``doc_id, text, expected_grade, tail_probability`` of every whole text; the tail is P(grade >= tail)."""

    def fn(batch: pa.RecordBatch) -> dict:
        tails = model.tails([features(t) for t in utf8(batch.column("text"))]).astype(np.float64)
        return {"doc_id": batch.column("doc_id"), "expected_grade": tails.sum(axis=1), "tail_probability": tails[:, tail - 1]}

    return per_slice(id_and_text(docs), fn, "doc_id long, expected_grade double, tail_probability double")


def quality_grades(docs: DataFrame, labels: DataFrame, keep_from: float = 0.5) -> DataFrame:
    """``doc_id, held_out, expected_grade, tail_probability, keep`` for every row of ``docs``.

    Held out: crc32 of the id as text is a multiple of 5; those ratings are never fitted on. ``keep``: P(grade
    >= 1) is at least ``keep_from``. Null text is empty; an empty text is scored by its length alone; equal
    texts score alike; without ratings every tail is one half and all rows stay. Other columns are not read.
    """
    model = fit_quality(docs, graded(labels).where(crc_of_id() % FOLDS != 0))
    scored = score_quality(docs, model)
    return scored.select("doc_id", F.coalesce(crc_of_id() % FOLDS == 0, F.lit(False)).alias("held_out"), "expected_grade", "tail_probability", (F.col("tail_probability") >= keep_from).alias("keep"))


def filter_quality(docs: DataFrame, labels: DataFrame, keep_from: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose own text has P(grade >= 1) of at least ``keep_from``."""
    model = fit_quality(docs, graded(labels).where(crc_of_id() % FOLDS != 0))
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            tails = model.tails([features(t) for t in utf8(batch.column("text"))])[:, 0]
            yield batch.filter(pa.array(tails >= keep_from))

    return docs.mapInArrow(run, schema)


def op4_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades of all documents, from the ratings in ``labels``."""
    return quality_grades(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
