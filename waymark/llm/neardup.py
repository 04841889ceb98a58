"""Near-duplicate documents by HyperMinHash.

A document's set is its distinct five-word shingles, each a 64-bit hash. The top bits of a hash choose one of 128
buckets; a bucket keeps its smallest hash, compressed to a register of leading zeros (6 bits) and the mantissa bits
that follow (10 bits). Runs of five registers form bands. Documents that agree in a band are candidates; an estimate of the Jaccard
index from the registers, corrected for chance agreement, drops the hopeless ones; the rest are confirmed on full sets.

Copies of one set share one representative before anything is compared. Candidates come in two steps, so that a group of
thousands of near copies is not expanded into its pairs: each document with the smallest id of each of its bands; then, of bands
whose members confirmed links do not yet connect, the pairs across components, compared inside the join so that only links
come out of it; documents too many of whose shingles occur in no other such document stay out.

Defined results: a null, empty or blank text has an empty set and no links; fewer than five words make one shingle; equal
texts are linked; each row is a document of its own, and rows with one doc_id count as one node when links are followed, also those
through equal sets; a row with a null doc_id gives and gets no link (null component and kept); an empty table gives an empty table; extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from waymark.llm.components import components
from waymark.llm.tables import only_ids
from waymark.session import materialise

WORDS = 5
BUCKET_BITS = 7
BUCKETS = 1 << BUCKET_BITS
MANTISSA_BITS = 10
BAND_ROWS = 5
#: Pairs whose estimate is this far (in standard errors) below the threshold are dropped.
SLACK_ERRORS = 5.0
#: Word hashes kept for reuse by one call in a Python worker; a full store starts anew.
KEPT_WORDS = 400_000

_EDGES = np.arange(BUCKETS, dtype=np.uint64) << np.uint64(64 - BUCKET_BITS)
_EMPTY = 0xFFFF


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the finaliser of a public hash function)."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Shingler:
    """Sorted distinct shingle hashes of texts."""

    def __init__(self) -> None:
        self.kept: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: only A-Z, and the six white bytes
        if not words:
            return np.empty(0, np.uint64)
        kept = self.kept
        if len(kept) > KEPT_WORDS:
            kept.clear()
        for w in set(words).difference(kept):
            kept[w] = xxh3_64_intdigest(w)
        h = np.fromiter(map(kept.__getitem__, words), np.uint64, len(words))
        n = min(WORDS, len(words))
        total = np.zeros(len(h) - n + 1, np.uint64)
        for i in range(n):
            total = _mixed(total + h[i : len(h) - n + 1 + i]) + np.uint64(i + 1)
        return np.unique(_mixed(total + np.uint64(n)))


def registers(h: np.ndarray) -> np.ndarray:
    """128 registers of sorted distinct hashes: leading zeros and mantissa of each bucket's smallest, or the empty mark."""
    at = np.searchsorted(h, _EDGES)
    out = np.full(BUCKETS, _EMPTY, np.uint16)
    ends = np.append(at[1:], len(h))
    full = at < ends
    rest = h[at[full]] << np.uint64(BUCKET_BITS)
    # leading zeros of the part after the bucket bits, at most 50 so that the mantissa stays inside the number
    exponent = np.frexp((rest >> np.uint64(11)).astype(np.float64))[1]  # exact: 53 bits fit a double
    zeros = np.minimum(53 - exponent, 50).astype(np.uint64)
    mantissa = (rest << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA_BITS)
    out[full] = ((zeros << np.uint64(MANTISSA_BITS)) | mantissa).astype(np.uint16)
    return out


SIGNATURE = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("set_hash", T.BinaryType()),
        T.StructField("set_id", T.LongType()),
        T.StructField("registers", T.BinaryType()),
        T.StructField("fold_1", T.LongType()),
        T.StructField("fold_2", T.LongType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
    ]
)
_SIGNATURE_ARROW = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64())]


def set_id(h: np.ndarray) -> int | None:
    """Half of the digest of sorted distinct hashes, which tells the sets of one doc_id apart; null for the empty set."""
    return int(np.bitwise_xor.reduce(_mixed(h + np.uint64(7))).view(np.int64)) if len(h) else None


def signature(h: np.ndarray) -> tuple:
    """Size, digest, half of it, registers, one bit of every register as two longs, and band keys of sorted distinct hashes."""
    if not len(h):
        return 0, None, None, None, None, None, None
    r = registers(h)
    bands = r[: BUCKETS // BAND_ROWS * BAND_ROWS].reshape(-1, BAND_ROWS)
    keys = [xxh3_64_intdigest(b.tobytes(), seed=i) - (1 << 63) for i, b in enumerate(bands) if (b != _EMPTY).any()]
    half = set_id(h)
    digest = np.array([h.sum(dtype=np.uint64), np.array(half).view(np.uint64)]).tobytes()
    folds = np.packbits((r & 1).astype(np.uint8)).view(np.int64)
    return len(h), digest, half, r.tobytes(), int(folds[0]), int(folds[1]), keys


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingles = Shingler()
    for whole in batches:
        for start in range(0, whole.num_rows, 2048):
            batch = whole.slice(start, 2048)
            found = list(zip(*[signature(shingles(t)) for t in batch.column(1).to_pylist()]))
            columns = [batch.column(0), *[pa.array(c, t) for c, t in zip(found, _SIGNATURE_ARROW[1:])]]
            yield pa.RecordBatch.from_arrays(columns, SIGNATURE.names)


SETS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("shingles", T.BinaryType())])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingles = Shingler()
    for whole in batches:
        for start in range(0, whole.num_rows, 512):
            batch = whole.slice(start, 512)
            sets = [shingles(t).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], SETS.names)


def estimate(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard index of each row of registers, less the agreements expected by chance, and the registers in use."""
    used = ((x != _EMPTY) | (y != _EMPTY)).sum(axis=1)
    same = ((x == y) & (x != _EMPTY)).sum(axis=1)
    # two unrelated smallest hashes of alike buckets have as many leading zeros in about a third of all cases
    chance = used / 3.0 / (1 << MANTISSA_BITS)
    return (same - chance) / (used - chance), used


def _promising(pairs: DataFrame, threshold: float) -> DataFrame:
    """Adds ``est`` to pairs of (a, b, r_a, r_b) and drops those too far below the threshold to be a chance result."""
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("est", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, BUCKETS) for c in ("r_a", "r_b")
            )
            est, used = estimate(x, y)
            keep = pa.array(est >= threshold - SLACK_ERRORS * np.sqrt(threshold * (1 - threshold) / used))
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(keep), batch.column("b").filter(keep), pa.array(est).filter(keep)], schema.names
            )

    return pairs.select("a", "b", "r_a", "r_b").mapInArrow(run, schema)


def _confirmed(pairs: DataFrame, texts: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose full sets have ``den * intersection >= num * union``."""
    ends = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    sets = materialise(only_ids(texts, ends, "doc_id").select("doc_id", "text").mapInArrow(_sets, SETS), "shingle-sets")
    joined = (
        pairs.select("a", "b")
        .join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("s_a")), "a")
        .join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("s_b")), "b")
    )
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for s, t in zip(batch.column("s_a"), batch.column("s_b")):
                x, y = np.frombuffer(s.as_buffer(), np.uint64), np.frombuffer(t.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], schema.names)

    return materialise(joined.mapInArrow(run, schema), "links")


def near_duplicates(docs: DataFrame, num: int = 85, den: int = 100) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every document; documents with a Jaccard index of at least
    ``num / den`` are linked, and a component is named by its smallest doc_id."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = materialise(texts.mapInArrow(_signatures, SIGNATURE), "signatures")
    members = signed.where("n > 0 and doc_id is not null").groupBy("set_hash", "n").agg(F.min("doc_id").alias("doc_id"))
    members = materialise(members, "sets")
    reps = signed.join(members, ["set_hash", "n", "doc_id"], "left_semi").dropDuplicates(["set_hash", "n", "doc_id"])
    reps = materialise(reps, "representatives")
    roots = components(_links(reps, texts, num, den).union(_own_links(signed, members)))
    named = members.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "set_hash", "n", F.coalesce("root", "doc_id").alias("component_id")
    )
    out = signed.select("doc_id", "n", "set_hash").join(named, ["set_hash", "n"], "left")
    component = F.coalesce("component_id", "doc_id")
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def _own_links(signed: DataFrame, members: DataFrame) -> DataFrame:
    """Links (a, b) between a doc_id that has several sets and the representative of each."""
    filled = signed.where("n > 0 and doc_id is not null")
    several = filled.groupBy("doc_id").agg(F.min("set_id").alias("least"), F.max("set_id").alias("most")).where("least != most")
    sets = materialise(filled.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("b"), "set_hash", "n"), "several-sets")
    return sets.join(members, ["set_hash", "n"]).select(F.col("doc_id").alias("a"), "b").distinct()


def _links(reps: DataFrame, texts: DataFrame, num: int, den: int) -> DataFrame:
    """Confirmed links that connect every component of the representatives."""
    threshold = num / den
    slim = reps.select("doc_id", "registers")
    entries = reps.select(F.explode("bands").alias("band"), "doc_id", "set_id", "n", "fold_1", "fold_2")
    entries = materialise(_shared(entries), "bands")
    left = slim.select(F.col("doc_id").alias("a"), F.col("registers").alias("r_a"))
    right = slim.select(F.col("doc_id").alias("b"), F.col("registers").alias("r_b"))

    def estimated(pairs: DataFrame) -> DataFrame:
        return materialise(_promising(pairs.distinct().join(left, "a").join(right, "b"), threshold), "pairs")

    # every document against the smallest id of each of its bands
    lowest = [F.min_by(c, "doc_id").alias(f"{c}_lo") for c in ("n", "fold_1", "fold_2")]
    ends = entries.groupBy("band").agg(F.min("doc_id").alias("lo"), *lowest)
    star = entries.alias("a").join(ends.select("band", *[F.col(c + "_lo").alias(c) for c in ("n", "fold_1", "fold_2")], "lo").alias("b"), "band")
    star = star.where("doc_id != lo").where(_alike("a", "b", num, den)).select(F.col("doc_id").alias("a"), F.col("lo").alias("b"))
    star = estimated(star)
    links = _confirmed(star, texts, num, den)
    roots = components(links)

    # bands that still mix components: their pairs across components, unless the registers tell them apart
    placed = entries.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    mixed = placed.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("band")
    placed = materialise(placed.join(mixed, "band", "left_semi"), "mixed-bands")
    placed = placed.join(_common(placed.select("doc_id", "set_id", "n").distinct(), texts), ["doc_id", "set_id", "n"])
    placed = materialise(placed.where(F.col("common") * den >= F.col("n") * num), "open-bands")
    sets = only_ids(texts, placed, "doc_id").select("doc_id", "text").mapInArrow(_arrays, ARRAYS)
    placed = placed.join(sets.dropDuplicates(["doc_id", "set_id", "n"]), ["doc_id", "set_id", "n"])
    a, b = placed.alias("a"), placed.alias("b")
    # the sets are compared as part of the join, so only links come out of it
    both = F.size(F.array_intersect("a.shingles", "b.shingles"))
    pairs = a.join(
        b,
        (F.col("a.band") == F.col("b.band"))
        & (F.col("a.doc_id") > F.col("b.doc_id"))
        & (F.col("a.root") != F.col("b.root"))
        & (F.least("a.common", "b.common") * (den + num) >= (F.col("a.n") + F.col("b.n")) * num)
        & _alike("a", "b", num, den)
        & (both * (den + num) >= (F.col("a.n") + F.col("b.n")) * num),
    )
    more = pairs.select(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b")).distinct()
    return links.union(materialise(more, "links"))


ARRAYS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("set_id", T.LongType()),
        T.StructField("shingles", T.ArrayType(T.LongType())),
    ]
)


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingles = Shingler()
    for whole in batches:
        for start in range(0, whole.num_rows, 512):
            batch = whole.slice(start, 512)
            sets = [shingles(t).view(np.int64) for t in batch.column(1).to_pylist()]
            columns = [[len(s) for s in sets], [set_id(s.view(np.uint64)) for s in sets]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in columns], pa.array(sets, pa.list_(pa.int64()))], ARRAYS.names
            )


def _common(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, set_id, n, common): how many shingles of each of ``members`` (doc_id, set_id, n) another set may have too.

    No member's intersection with another can be larger, which rules out pairs of heavily edited copies one document at a
    time. A shingle that only one set has is recognised by its count, so frequent ones are only counted.
    """
    schema = T.StructType([T.StructField("set_id", T.LongType()), T.StructField("shingle", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler()
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                sets = [s for t in batch.column(0).to_pylist() if len(s := shingles(t))]
                ids = np.repeat(np.array([set_id(s) for s in sets], np.int64), [len(s) for s in sets])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), pa.array(np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64))], schema.names
                )

    held = only_ids(texts, members, "doc_id").select("text").mapInArrow(run, schema)
    alone = held.groupBy("shingle").agg(F.min("set_id").alias("set_id"), F.max("set_id").alias("last")).where("set_id = last")
    alone = alone.groupBy("set_id").agg(F.count("*").alias("alone"))
    common = (F.col("n") - F.coalesce("alone", F.lit(0))).alias("common")
    return members.join(alone, "set_id", "left").select("doc_id", "set_id", "n", common)


def _shared(entries: DataFrame) -> DataFrame:
    """Entries of bands that at least two documents have."""
    bands = entries.groupBy("band").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo != hi").select("band")
    return entries.join(bands, "band", "left_semi")


def _alike(a: str, b: str, num: int, den: int) -> Column:
    """Whether two sets' sizes allow the index, and few enough of their registers differ in the lowest bit (half of those
    that differ do)."""
    p = (1 - num / den) / 2
    most = int(BUCKETS * p + SLACK_ERRORS * (BUCKETS * p * (1 - p)) ** 0.5)
    bits = sum((F.bit_count(F.col(f"{a}.fold_{i}").bitwiseXOR(F.col(f"{b}.fold_{i}"))) for i in (1, 2)), F.lit(0))
    n_a, n_b = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (F.least(n_a, n_b) * den >= F.greatest(n_a, n_b) * num) & (bits <= most)


def op9_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
