"""Quality scores by a factorisation machine.

A document's features are its words hashed to buckets (logarithmic counts, scaled to length 1), statistics of its
structure, and the metadata column ``n_chars``. The machine adds to a linear score the low-rank products of all pairs of
features, ``sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2) / 2``, so a text is scored in time linear in its features.
It is fitted by logistic loss on a bounded sample of labelled documents; scoring covers whole texts of all rows.

Defined results: null and empty texts are scored by their statistics (all 0); null ``n_chars`` counts as 0; documents without a
label, labels without a document and null labels are not learned from; a document with several labels has their majority, 1 if
even; without any label every score is 0.5; rows are handled one by one; an empty table gives an empty table; input columns
named like an output column are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log1p
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh32_intdigest

#: The most labelled documents that are learned from: the first in the order of md5(doc_id).
SAMPLE_DOCUMENTS = 8000
WORD_BUCKETS = 4096
RANK = 8
EPOCHS = 15
BATCH = 128
RATE = 0.05
DECAY = 1e-5
#: Word buckets kept for reuse in a Python worker; a full store starts anew.
KEPT_WORDS = 400_000

_UPPER = bytes(range(0x41, 0x5B))
_DIGIT = bytes(range(0x30, 0x3A))
_MARKS = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum())
_ENDS = b".,;:?"
STATISTICS = 15


class Features:
    """Sparse word features and statistics of a text."""

    def __init__(self) -> None:
        self.kept: dict[bytes, int] = {}

    def __call__(self, text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray, list[float]]:
        data = (text or "").encode("utf-8", "surrogatepass")
        words = data.lower().split()
        counts = Counter(words)
        kept = self.kept
        if len(kept) > KEPT_WORDS:
            kept.clear()
        for w in counts:
            if w not in kept:
                kept[w] = xxh32_intdigest(w) % WORD_BUCKETS
        buckets = np.fromiter(map(kept.__getitem__, counts), np.int64, len(counts))
        values = np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
        values = np.bincount(buckets, values, WORD_BUCKETS) if len(values) else np.zeros(WORD_BUCKETS)
        used = np.flatnonzero(values)
        values = values[used]
        values /= max(1e-12, float(np.sqrt(values @ values)))
        return used.astype(np.int32), values.astype(np.float32), self._statistics(data, words, counts, n_chars or 0)

    @staticmethod
    def _statistics(data: bytes, words: list[bytes], counts: Counter, n_chars: int) -> list[float]:
        size, n = max(1, len(data)), max(1, len(words))
        without = [len(data) - len(data.translate(None, c)) for c in (_UPPER, _DIGIT, _MARKS, _ENDS)]
        lines = data.split(b"\n")
        return [
            log1p(len(data)),
            log1p(len(words)),
            log1p(len(lines)),
            sum(map(len, words)) / n / 10,
            *[c / size for c in without],
            len(counts) / n,
            max(counts.values(), default=0) / n,
            sum(map(eq, words, words[1:])) / n,
            1 - len(set(lines)) / len(lines),
            sum(len(w) == 1 for w in words) / n,
            log1p(n_chars),
            (n_chars - len(text)) / size if (text := data.decode("utf-8", "surrogatepass")) or n_chars else 0.0,
        ]


@dataclass
class Machine:
    """Weights over the word buckets and the statistics, and how the statistics are scaled."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    middle: np.ndarray
    spread: np.ndarray

    def scaled(self, statistics: np.ndarray) -> np.ndarray:
        return np.clip((statistics - self.middle) / self.spread, -4, 4) * 0.5

    def score(self, rows: list[tuple[np.ndarray, np.ndarray, list[float]]]) -> np.ndarray:
        """Probability of label 1, through the sum-of-squares identity."""
        stats = self.scaled(np.array([r[2] for r in rows], float).reshape(len(rows), STATISTICS))
        total = self.bias + stats @ self.linear[WORD_BUCKETS:].astype(float)
        v = self.factors[WORD_BUCKETS:].astype(float)
        sums, squares = stats @ v, stats**2 @ v**2
        sizes = np.array([len(r[0]) for r in rows])
        if sizes.sum():
            index = np.concatenate([r[0] for r in rows])
            value = np.concatenate([r[1] for r in rows]).astype(float)
            owner = np.repeat(np.arange(len(rows)), sizes)
            total = total + np.bincount(owner, self.linear[index] * value, len(rows))
            part = self.factors[index] * value[:, None]
            starts = (np.cumsum(sizes) - sizes)[sizes > 0]
            sums[sizes > 0] += np.add.reduceat(part, starts)
            squares[sizes > 0] += np.add.reduceat(part**2, starts)
        total = total + 0.5 * (sums**2 - squares).sum(axis=1)
        # rounded, as the last digits depend on which rows are added up side by side
        return np.round(1 / (1 + np.exp(-np.clip(total, -30, 30))), 9)


def _fit(rows: list[tuple[np.ndarray, np.ndarray, list[float]]], labels: np.ndarray) -> Machine:
    """Adaptive gradient steps over shuffled batches; the seed is fixed, so reruns agree."""
    rng = np.random.default_rng(0)
    n = WORD_BUCKETS + STATISTICS
    stats = np.array([r[2] for r in rows], float).reshape(len(rows), STATISTICS)
    machine = Machine(
        0.0,
        np.zeros(n, np.float32),
        rng.normal(0, 0.01, (n, RANK)).astype(np.float32),
        stats.mean(axis=0) if len(rows) else np.zeros(STATISTICS),
        stats.std(axis=0) + 1e-3 if len(rows) else np.ones(STATISTICS),
    )
    if not len(rows):
        machine.factors[:] = 0
        return machine
    scaled = machine.scaled(stats).astype(np.float32)
    share = np.clip(labels.mean(), 0.01, 0.99)
    machine.bias = float(np.log(share / (1 - share)))
    seen_w, seen_v, seen_b = np.full(n, 1e-6, np.float32), np.full((n, RANK), 1e-6, np.float32), 1e-6
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for start in range(0, len(rows), BATCH):
            chosen = order[start : start + BATCH]
            x = np.zeros((len(chosen), n), np.float32)
            for k, i in enumerate(chosen):
                x[k, rows[i][0]] = rows[i][1]
            x[:, WORD_BUCKETS:] = scaled[chosen]
            sums = x @ machine.factors
            total = machine.bias + x @ machine.linear + 0.5 * (sums**2 - x**2 @ machine.factors**2).sum(axis=1)
            error = (1 / (1 + np.exp(-np.clip(total, -30, 30))) - labels[chosen]).astype(np.float32) / len(chosen)
            d_w = x.T @ error + DECAY * machine.linear
            d_v = x.T @ (error[:, None] * sums) - (x**2).T @ error[:, None] * machine.factors + DECAY * machine.factors
            d_b = float(error.sum())
            seen_w += d_w**2
            seen_v += d_v**2
            seen_b += d_b**2
            machine.linear -= RATE * d_w / np.sqrt(seen_w)
            machine.factors -= RATE * d_v / np.sqrt(seen_v)
            machine.bias -= RATE * d_b / seen_b**0.5
    return machine


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Machine:
    """A machine fitted to at most ``SAMPLE_DOCUMENTS`` of ``docs`` (doc_id, text, n_chars) that ``labels`` (doc_id, label) marks."""
    marked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id")
    marked = marked.agg((F.avg(label) >= 0.5).cast("int").alias("_label"))
    marked = marked.orderBy(F.md5(F.col("doc_id").cast("string"))).limit(SAMPLE_DOCUMENTS)
    chosen = docs.select("doc_id", "text", "n_chars").join(F.broadcast(marked), "doc_id").select("doc_id", "text", "n_chars", "_label")
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("label", T.IntegerType())]
        + [T.StructField(c, T.BinaryType()) for c in ("buckets", "values", "statistics")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            rows = [features(*x) for x in zip(batch.column("text").to_pylist(), batch.column("n_chars").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    batch.column("_label").cast(pa.int32()),
                    pa.array([r[0].tobytes() for r in rows], pa.binary()),
                    pa.array([r[1].tobytes() for r in rows], pa.binary()),
                    pa.array([np.array(r[2]).tobytes() for r in rows], pa.binary()),
                ],
                schema.names,
            )

    found = chosen.mapInArrow(run, schema).toArrow().sort_by([("doc_id", "ascending"), ("statistics", "ascending")])
    rows = [
        (np.frombuffer(b, np.int32), np.frombuffer(v, np.float32), np.frombuffer(s, np.float64).tolist())
        for b, v, s in zip(*[found.column(c).to_pylist() for c in ("buckets", "values", "statistics")])
    ]
    return _fit(rows, np.array(found.column("label").to_pylist(), float))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """``docs`` (text, n_chars, ...) with ``score``."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    keep = [c for c in docs.columns if c != "score"]
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                rows = [features(*x) for x in zip(batch.column("text").to_pylist(), batch.column("n_chars").to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in keep], pa.array(sent.value.score(rows).astype(float))], [*keep, "score"]
                )

    return docs.select(*keep).mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def op4_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "n_chars")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
