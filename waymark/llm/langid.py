"""Language identification by language-bitmask n-gram filters.

For every language the frequent letter n-grams of labelled texts go into a Bloom filter. The filters are bit-sliced: one
table of slots, in which bit ``l`` of a slot belongs to the filter of language ``l``, so that AND-ing an n-gram's slots
gives the languages that have it. A text's n-grams are counted for every language by those bits, the counts are
corrected for the filters' false positives, and the largest decides.

Defined results: a null text or one without a letter is ``und`` with score 0; ties go to the language with more learned
documents, then the smaller name; without learned languages every text is ``und``; rows are handled one by one; texts of any
length are read whole; an empty table gives an empty table; input columns named like an output column are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm.tables import only_ids
from waymark.session import materialise

ORDERS = (3, 5)
#: Bounds of learning: documents of a language, its n-grams kept, and in how many of the documents an n-gram must occur.
DOCUMENTS_PER_LANGUAGE = 4000
GRAMS_PER_LANGUAGE = 30_000
LEAST_DOCUMENTS = 3
#: Learned documents of a language for each document more that an n-gram must occur in, from one up to the bound.
DOCUMENTS_A_STEP = 50
SLOT_BITS = 20
PROBES = 3
#: Letters worked on at once in a Python worker; longer texts are counted piece by piece, without losing what lies across.
PIECE = 1 << 18
#: Rows worked on at once in a Python worker.
ROWS = 512
UND = "und"

_letters: list[np.ndarray] = []


def _pieces(text: str, size: int) -> Iterator[tuple[np.ndarray, int]]:
    """Code points of the lower-cased text with every run of other characters as one space, and a space at both ends.

    They come in pieces, each with so many of the last points of the piece before in front, at most those that a longest n-gram over the
    border needs. So every n-gram is in one piece as a whole, whatever the size.
    """
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    text, tail, lead = text.lower(), np.array([32], np.uint32), 0
    for start in range(0, max(1, len(text)), size):
        points = np.frombuffer(text[start : start + size].encode("utf-32-le", "surrogatepass"), np.uint32)
        points = np.concatenate([tail, np.where(_letters[0][points], points, np.uint32(32)), [32] if start + size >= len(text) else []]).astype(np.uint32)
        points = points[np.append(True, (points[1:] != 32) | (points[:-1] != 32))]
        yield points, lead
        tail = points[-(max(ORDERS) - 1) :]
        lead = len(tail)


def _grams(points: np.ndarray, order: int, lead: int = 0) -> np.ndarray:
    """64-bit hashes of all n-grams of one order that end after the first ``lead`` points."""
    points = points[max(0, lead - order + 1) :]
    n = len(points) - order + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, order, np.uint64)
    for i in range(order):
        h = (h ^ points[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


@dataclass
class Filters:
    """Bit-sliced filters: ``slots[w]`` holds languages 64*w to 64*w+63."""

    languages: list[str]
    slots: np.ndarray
    false_positive: np.ndarray

    def masks(self, h: np.ndarray) -> Iterator[np.ndarray]:
        """For each word of 64 languages, the languages whose filters have each n-gram."""
        at = [(h >> np.uint64(SLOT_BITS * i)) & np.uint64((1 << SLOT_BITS) - 1) for i in range(PROBES)]
        for plane in self.slots:
            found = plane[at[0]]
            for slots in at[1:]:
                found &= plane[slots]
            yield found

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """n-grams of each text, and how many of them each language's filter has."""
        total = np.zeros(len(texts), np.int64)
        hits = np.zeros((len(texts), len(self.languages)), np.int64)
        group: list[tuple[int, np.ndarray, int]] = []

        def count() -> None:
            for order in ORDERS:
                hashes = [_grams(p, order, lead) for _, p, lead in group]
                ends = np.cumsum([len(h) for h in hashes])
                for plane, mask in enumerate(self.masks(np.concatenate(hashes))):
                    for bit in range(min(64, len(self.languages) - 64 * plane)):
                        so_far = np.append(0, np.cumsum((mask >> np.uint64(bit)) & np.uint64(1), dtype=np.int64))[np.append(0, ends)]
                        np.add.at(hits[:, 64 * plane + bit], [i for i, *_ in group], np.diff(so_far))
                np.add.at(total, [i for i, *_ in group], np.diff(np.append(0, ends)))
            group.clear()

        held = 0
        for i, text in enumerate(texts):
            for points, lead in _pieces(text, PIECE):
                group.append((i, points, lead))
                held += len(points)
                if held >= PIECE:
                    count()
                    held = 0
        if group:
            count()
        return total, hits


def _in_fold(doc_id: Column | str, folds: int = 5) -> Column:
    """Whether a document is held out: crc32 of its id as text is a multiple of ``folds``."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % folds == 0


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield batch.slice(start, ROWS)


def learn(docs: DataFrame) -> Filters:
    """Filters from all rows with a language among ``docs`` (doc_id, text, lang).

    At most ``DOCUMENTS_PER_LANGUAGE`` documents of each language are read, those first in the order of ``md5(doc_id)``.
    """
    named = docs.where("lang is not null and text is not null and doc_id is not null")
    first = Window.partitionBy("lang").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id")
    chosen = named.select("doc_id", "lang").withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= DOCUMENTS_PER_LANGUAGE)
    chosen = materialise(chosen.select("doc_id", "lang"), "language-sample")
    sizes = {r["lang"]: r["count"] for r in chosen.groupBy("lang").count().collect()}
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("gram", T.LongType()), T.StructField("docs", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            found: dict[str, Counter] = {}
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                seen: set[int] = set()
                for points, lead in _pieces(text, PIECE):
                    for order in ORDERS:
                        seen.update(np.unique(_grams(points, order, lead)).view(np.int64).tolist())
                found.setdefault(lang, Counter()).update(seen)
            for lang, grams in found.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams)), pa.array(list(grams), pa.int64()), pa.array(list(grams.values()), pa.int64())],
                    schema.names,
                )

    texts = only_ids(named.select("doc_id", "text", "lang"), chosen, "doc_id").select("text", "lang")
    counted = texts.mapInArrow(run, schema).groupBy("lang", "gram").agg(F.sum("docs").alias("docs"))
    steps = F.lit(1) + F.floor(F.count("*") / DOCUMENTS_A_STEP)
    least = chosen.groupBy("lang").agg(F.least(F.lit(LEAST_DOCUMENTS), steps).alias("least"))
    counted = counted.join(F.broadcast(least), "lang").where("docs >= least").drop("least")
    most = Window.partitionBy("lang").orderBy(F.desc("docs"), "gram")
    kept = counted.withColumn("_n", F.row_number().over(most)).where(F.col("_n") <= GRAMS_PER_LANGUAGE).select("lang", "gram")
    return _filled(sorted(sizes, key=lambda lang: (-sizes[lang], lang)), kept.toArrow())


def _filled(languages: list[str], grams: pa.Table) -> Filters:
    slots = np.zeros((max(1, -(-len(languages) // 64)), 1 << SLOT_BITS), np.uint64)
    lang, gram = np.array(grams.column("lang").to_pylist(), object), grams.column("gram").to_numpy().view(np.uint64)
    rates = np.zeros(len(languages))
    for i, name in enumerate(languages):
        h = gram[lang == name]
        plane, bit = slots[i // 64], np.uint64(1) << np.uint64(i % 64)
        for probe in range(PROBES):
            plane[(h >> np.uint64(SLOT_BITS * probe)) & np.uint64((1 << SLOT_BITS) - 1)] |= bit
        rates[i] = np.count_nonzero(plane & bit) / len(plane)
    return Filters(languages, slots, rates**PROBES)


OUTPUT = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("known", T.DoubleType())]


def identify(docs: DataFrame, filters: Filters, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (its share of all languages' corrected counts) and ``known`` (the corrected share
    of the text's n-grams that the language has)."""
    sent = docs.sparkSession.sparkContext.broadcast(filters)  # 8 MB for every 64 languages
    names = {f.name for f in OUTPUT}
    keep = [c for c in docs.columns if c not in names]
    source = docs.select(*keep, F.col(text).alias("_langid_text"))
    schema = T.StructType([*docs.select(*keep).schema.fields, *OUTPUT])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sent.value
        for batch in _sliced(batches):
            texts = [t or "" for t in batch.column("_langid_text").to_pylist()]
            total, hits = found.counts(texts)
            lettered = np.array([any(map(str.isalpha, t)) for t in texts], bool)
            if found.languages:
                wrong = found.false_positive
                likely = np.maximum(0.0, (hits - total[:, None] * wrong) / (1 - wrong))
                best = likely.argmax(axis=1)
                top = likely[np.arange(len(texts)), best]
                score = np.where(lettered, top / np.maximum(likely.sum(axis=1), 1e-300), 0.0)
                known = np.where(lettered, np.minimum(1.0, top / np.maximum(total, 1)), 0.0)
                names_ = [found.languages[i] if ok else UND for i, ok in zip(best, lettered)]
            else:
                score = known = np.zeros(len(texts))
                names_ = [UND] * len(texts)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(names_, pa.string()), pa.array(score), pa.array(known)],
                [*keep, *[f.name for f in OUTPUT]],
            )

    return source.mapInArrow(run, schema)


def op6_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    filters = learn(docs.where(~_in_fold("doc_id")))
    return identify(docs.select("doc_id", "text"), filters).select("doc_id", _in_fold("doc_id").alias("held_out"), "lang_pred", "score")
