"""Importance resampling towards a target: draw the documents whose word runs are more usual in the target than in the corpus.

Words, pairs and triples of neighbouring words are hashed to buckets. A bucket's gain is the logarithm of its smoothed share of the target
over that of the corpus; a document's weight is the sum over all its runs, and Gumbel noise from a hash of its id turns the largest
weights into a sample without replacement.

In a task, Arrow kernels work on slices of bounded size: ``ascii_lower``, ``split_pattern_regex`` and ``list_flatten`` give the words,
``dictionary_encode`` numbers them. Shifted numbers are pairs, which are numbered again, and pairs with a third word are triples. The CRC is
worked out once for each different word, pair and triple: that of a pair follows from those of its parts, as appending bytes to a CRC is
linear. ``take`` brings the gains back to the positions, and sums over each document's segment are its weight. A text longer than a
slice is numbered whole and its runs are worked on in pieces that overlap by two words, so none is lost.

Defined results: a null or empty text, or one without a word, has no features and weight 0; ties go to the smaller doc_id (null last) and
rows equal in score and id are drawn one by one; a null doc_id is hashed as empty text; an empty table gives an empty table and without
target texts every bucket counts as empty; columns of the documents are carried through, but those named like an output column are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.session import materialise

#: What separates words once A-Z are lower case.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
LONGEST_RUN = 3
LEAST_WORDS = 20
SHARE = (5, 100)
SEED = 42
#: Bytes of text, and word positions, worked on at once in a Python worker.
SLICE_BYTES = 1 << 22
SLICE_WORDS = 1 << 20

_operators: list[np.ndarray] = []


def _powers() -> np.ndarray:
    """Tables (power, byte of the CRC, value): what appending ``2**power`` bytes does to a CRC."""
    if not _operators:
        step = np.array([zlib.crc32(bytes([b]), 0xFFFFFFFF) ^ 0xFFFFFFFF for b in range(256)], np.uint32)
        # zlib inverts before and after; without that, one zero byte turns c into step[c & 255] ^ (c >> 8)
        columns = np.uint32(1) << np.arange(32, dtype=np.uint32)
        columns = step[columns & np.uint32(255)] ^ (columns >> np.uint32(8))
        values = np.arange(256)
        made = []
        for _ in range(40):
            tables = np.zeros((4, 256), np.uint32)
            for byte in range(4):
                for bit in range(8):
                    tables[byte] ^= np.where((values >> bit) & 1, columns[8 * byte + bit], np.uint32(0))
            made.append(tables)
            columns = _applied(tables, columns)
        _operators.append(np.stack(made))
    return _operators[0]


def _applied(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 255] ^ tables[1][(crc >> 8) & 255] ^ tables[2][(crc >> 16) & 255] ^ tables[3][crc >> 24]


def appended(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs of texts of which ``first`` are the CRCs of the beginnings and ``second`` those of the last ``length`` bytes."""
    out = first.copy()
    for power in range(int(length.max(initial=0)).bit_length()):
        here = np.flatnonzero((length >> power) & 1)
        out[here] = _applied(_powers()[power], out[here])
    return out ^ second


def _numbered(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each code among the different ones, and these."""
    found = pc.dictionary_encode(pa.array(codes))
    return found.indices.to_numpy(), found.dictionary.to_numpy()


def runs(texts: pa.Array, buckets: int = BUCKETS, at_once: int = SLICE_WORDS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, number, bucket of each number): documents in rising order with the number of the run at each position.

    The first yield of each piece are words, then pairs and triples.
    """
    listed = pc.split_pattern_regex(pc.ascii_lower(texts), SEPARATOR)
    words, doc = pc.list_flatten(listed), pc.list_parent_indices(listed)
    filled = pc.greater(pc.binary_length(words), 0)
    coded = pc.dictionary_encode(words.filter(filled))
    doc, code, n_codes = doc.filter(filled).to_numpy(), coded.indices.to_numpy(), len(coded.dictionary)
    written = [w.as_py().encode() for w in coded.dictionary]
    crc = np.fromiter((zlib.crc32(w) for w in written), np.uint32, n_codes)
    spaced = np.fromiter((zlib.crc32(w + b" ") for w in written), np.uint32, n_codes)
    length = np.fromiter(map(len, written), np.int64, n_codes)
    space, one = np.uint32(zlib.crc32(b" ")), np.ones(1, np.int64)
    for at in range(0, len(code), at_once):
        end = min(at + at_once, len(code))
        yield doc[at:end], code[at:end], crc % buckets
        # pairs that start here, and one more for the last triple
        starts = at + np.flatnonzero(doc[at : end + 1][: len(code) - at - 1] == doc[at + 1 : end + 2])
        number, pairs = _numbered(code[starts].astype(np.int64) * n_codes + code[starts + 1])
        second = pairs % n_codes
        pair_crc = appended(spaced[pairs // n_codes], crc[second], length[second])
        own = starts < end
        yield doc[starts[own]], number[own], pair_crc % buckets
        there = np.full(end - at + 2, -1, np.int64)
        there[starts - at] = number
        starts = starts[own & (there[starts - at + 1] >= 0)]
        number, triples = _numbered(there[starts - at] * n_codes + code[starts + 2])
        first, third = triples // n_codes, triples % n_codes
        before = appended(pair_crc, np.full(1, space), np.repeat(one, len(pair_crc)))[first]
        yield doc[starts], number, appended(before, crc[third], length[third]) % buckets


def _slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Rows of at most ``SLICE_BYTES`` of text, or one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
        yield batch.slice(at, end - at)
        at = end


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many runs of all ``texts`` (text) fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for rows in _slices(batch, "text"):
                for _, number, bucket in runs(rows.column("text"), buckets):
                    total += np.bincount(bucket[number], minlength=buckets)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(total[full])], ["bucket", "n"])

    found = texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)  # one number per bucket, however large the corpus
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket, in thousandths and rounded down."""
    s, t = corpus.astype(np.float64), target.astype(np.float64)
    ratio = ((t + 1) * (s.sum() + len(s))) / ((s + 1) * (t.sum() + len(t)))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


WEIGHED = [T.StructField(c, T.LongType()) for c in ("n_features", "n_words", "weight")]


def weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """``docs`` (text, ...) with ``n_features``, ``n_words`` and ``weight``, the sum of its runs' gains."""
    keep = [c for c in docs.columns if c not in {f.name for f in WEIGHED}]
    rows = docs.select(*keep, F.col("text").alias("_weighed_text"))
    schema = T.StructType([*docs.select(*keep).schema.fields, *WEIGHED])
    sent = docs.sparkSession.sparkContext.broadcast(gain)  # one number per bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _slices(batch, "_weighed_text"):
                count, weight = np.zeros((LONGEST_RUN, rows.num_rows), np.int64), np.zeros(rows.num_rows, np.int64)
                for i, (doc, number, bucket) in enumerate(runs(rows.column("_weighed_text"), len(sent.value))):
                    if len(doc):
                        found, starts = np.unique(doc, return_index=True)
                        weight[found] += np.add.reduceat(sent.value[bucket][number], starts)
                        count[i % LONGEST_RUN, found] += np.diff(np.append(starts, len(doc)))
                columns = [pa.array(c) for c in (count.sum(axis=0), count[0], weight)]
                yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in keep], *columns], schema.names)

    return rows.mapInArrow(run, schema)


def scored(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """``docs`` (doc_id, text, ...) weighed against the texts of ``target`` (text), with ``score``: the weight and Gumbel noise."""
    found = weighed(docs, gains(bucket_counts(docs, buckets), bucket_counts(target, buckets)))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    return found.withColumn("score", (F.col("weight") + noise).cast("long"))


def ranked(scores: DataFrame, share: tuple[int, int] = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scores`` (doc_id, n_features, n_words, weight, score) with ``rank`` from 1 in the order of the draw, null for what isn't drawn.

    ``share`` of the documents with ``least_words`` words are drawn. Scores are sorted by ranges, which are written, so that their
    numbers stay; a rank is the place inside a range and the sizes of the ranges before it (one row per range).
    """
    able = F.col("n_words") >= least_words
    order = [F.desc("able"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features")]
    ranged = scores.select("*", able.alias("able")).repartitionByRange(*order)
    ranged = materialise(ranged.withColumn("_part", F.spark_partition_id()), "resample-ranges")
    n = ranged.where("able").count()
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order)).cast("long") + F.col("_before")
    placed = ranged.join(F.broadcast(before), "_part").withColumn("rank", rank)
    drawn = F.col("able") & (F.col("rank") <= share[0] * n // share[1])
    return placed.withColumn("rank", F.when(drawn, F.col("rank"))).drop("able", "_part", "_before")


def resampled(docs: DataFrame, target: DataFrame, share: tuple[int, int] = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """The drawn rows of ``docs`` with all columns; rows that equal the last drawn one in score, id and size come too."""
    found = materialise(scored(docs.select("doc_id", "text"), target).drop("text"), "resample-scores")
    last = ranked(found, share, least_words).where("rank is not null").groupBy().agg(F.max_by(F.struct("score", "doc_id", "n_features"), "rank").alias("l")).first()["l"]
    if last is None:
        return docs.where(F.lit(False))
    upto = found.where((F.col("n_words") >= least_words) & (F.col("score") >= last["score"])).select("doc_id", "n_features", "score")
    same, order = F.col("score") == last["score"], F.coalesce(F.col("doc_id") < last["doc_id"], F.lit(last["doc_id"] is None))
    tied = F.col("doc_id").eqNullSafe(F.lit(last["doc_id"])) & (F.col("n_features") <= last["n_features"])
    keys = upto.where(~same | order | tied).select(F.col("doc_id").alias("_drawn_id")).distinct()
    return docs.join(keys, F.col("doc_id").eqNullSafe(F.col("_drawn_id")), "left_semi")


def op11_resample(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scored(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text")
    return ranked(found).select("doc_id", "n_features", "weight", "score", "rank")


OP11_SQL = r"""
with texts as materialized (
  select 'd' kind, row_number() over (order by doc_id) id, doc_id, text from documents
  union all select 'b', item_id, null, text from benchmark),
words as materialized (
  select kind, id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from texts),
feats as materialized (
  select kind, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
                                      list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) f from words),
steps as materialized (select list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, b)) t),
names as materialized (select f, hex(encode(f)) h from (select distinct f from feats)),
crcs as materialized (
  select f, xor(list_reduce(list_transform(range(0, len(h) // 2), lambda i: cast('0x' || substr(h, cast(2 * i + 1 as bigint), 2) as bigint)),
                            lambda c, b: xor(t[xor(c & 255, b) + 1], c >> 8), 4294967295::bigint), 4294967295) % 10000 bucket from names, steps),
counted as (select bucket, count(*) filter (kind = 'd') s, count(*) filter (kind = 'b') t from feats join crcs using (f) group by bucket),
gain as (select bucket, cast(floor(1000 * ln((t + 1)::double * (sum(s) over () + 10000)::double / ((s + 1)::double * (sum(t) over () + 10000)::double))) as bigint) g from counted),
weights as (select id, count(*) n_features, sum(g) weight from feats join crcs using (f) join gain using (bucket) where kind = 'd' group by id),
noise as (
  select id, doc_id, len(w) n_words,
         cast(floor(-1000 * ln(-ln((cast('0x' || substr(sha256('42:' || coalesce(doc_id::varchar, '')), 1, 8) as bigint) + 0.5::double) / 4294967296))) as bigint) z
  from words where kind = 'd'),
scores as (
  select doc_id, n_words, cast(coalesce(n_features, 0) as bigint) n_features, cast(coalesce(weight, 0) as bigint) weight,
         cast(coalesce(weight, 0) + z as bigint) score from noise left join weights using (id)),
places as (select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id nulls last, n_features) r, count(*) filter (n_words >= 20) over () n from scores)
select doc_id, n_features, weight, score, case when n_words >= 20 and r <= 5 * n // 100 then r end as rank from places"""
