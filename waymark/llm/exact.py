"""Exact dedup: of texts that are equal but for white space, the longest stays.

Texts are compared without the six white characters, under their SHA-256 digest and always in full. Every row is digested once; digests
that only one row has need no comparison. The texts of the others are combined in three steps, each of which groups by the digest *and* the
whole text: inside every input partition (what Spark combines before a shuffle), then over the partitions of one of ``SALTS`` salts, then
over the salts. So a text that makes up a third of all rows is one row of each input partition, spread over all salts, before it is one
row. Should different texts share a digest, rows with that digest look their group up by the whole text, all others by digest.

The rows meet their group by digest alone. A digest with more than one in ``HOT_SHARE`` of all rows goes to every task; there are never more
than ``HOT_SHARE`` of these, whatever the data. All of it is DataFrame operations.

Defined results: a null text counts as empty; texts without any other character are all equal; of equal texts the row with the most
code points stays, then that of the smallest doc_id (null last), and of rows equal in these exactly one; a group whose best row has a null
doc_id has a null keep_id; texts of any length are compared whole, each as one value; an empty table gives an empty table; columns
other than doc_id and text play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.tables import only_ids
from waymark.session import materialise

WHITE = r"[\x20\x09-\x0D]+"
#: Groups of input partitions that are merged on their own before all are.
SALTS = 16
#: A group with more than this part of all rows doesn't wait in one task for its rows.
HOT_SHARE = 10_000


def normalised(text: str = "text") -> Column:
    """The text as it is compared."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), WHITE, "")


def sha256(content: Column) -> Column:
    return F.unhex(F.sha2(content, 256))


def groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): ``doc_id, keep_id, group_size, kept, points`` (its code points) and ``digest``."""
    read = docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("points"), normalised().alias("content"))
    read = read.select("*", digest(F.col("content")).alias("digest"))
    rows = materialise(read.groupBy("digest", "doc_id", "points").agg(F.count("*").alias("again")), "exact-rows")
    total = rows.agg(F.coalesce(F.sum("again"), F.lit(0)).alias("n")).first()["n"]

    repeated = rows.groupBy("digest").agg(F.sum("again").alias("n")).where("n > 1")
    repeated = materialise(repeated.select(F.xxhash64("digest").alias("id")), "exact-repeated")
    winners = materialise(_winners(only_ids(_salted(read), repeated, "id")), "exact-winners")
    torn = materialise(winners.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest"), "exact-torn")

    placed = _placed(rows, winners.drop("content"), total)
    if not torn.isEmpty():
        placed = placed.join(torn, "digest", "left_anti").unionByName(_by_content(read, winners, torn))
    best = (F.col("doc_id").eqNullSafe(F.col("keep_id"))) & (F.col("points") == F.col("keep_points"))
    each = placed.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("again"))).alias("copy"))
    alone = F.col("group_size").isNull()
    return each.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (best & (F.col("copy") == 1))).alias("kept"),
        "points",
        "digest",
    )


def _salted(read: DataFrame) -> DataFrame:
    """Rows with the salt of their input partition: all copies of a text inside one partition have the same."""
    return read.select("*", (F.spark_partition_id() % SALTS).alias("salt"), F.xxhash64("digest").alias("id"))


def _winners(salted: DataFrame) -> DataFrame:
    """(digest, content, keep_points, keep_id, group_size): one row for each different text of ``salted``."""
    row = F.struct(-F.col("points"), F.col("doc_id").isNull(), F.col("doc_id"))
    merged = salted.groupBy("digest", "salt", "content").agg(F.min(row).alias("best"), F.count("*").alias("n"))
    final = merged.groupBy("digest", "content").agg(F.min("best").alias("best"), F.sum("n").alias("group_size"))
    return final.select("digest", "content", (-F.col("best.col1")).alias("keep_points"), F.col("best.doc_id").alias("keep_id"), "group_size")


def _placed(rows: DataFrame, groups_: DataFrame, total: int) -> DataFrame:
    """``rows`` beside the group of their digest, if it has several rows."""
    large = F.col("group_size") * HOT_SHARE > total
    hot = F.broadcast(groups_.where(large))
    columns = [*rows.columns, "keep_points", "keep_id", "group_size"]
    rest = rows.join(hot, "digest", "left_anti").join(groups_.where(~large), "digest", "left")
    return rows.join(hot, "digest").select(*columns).unionByName(rest.select(*columns))


def _by_content(read: DataFrame, winners: DataFrame, torn: DataFrame) -> DataFrame:
    """Rows whose digest several texts share, beside the group of their text."""
    keyed = torn.select("digest", F.xxhash64("digest").alias("id"))
    met = only_ids(read.withColumn("id", F.xxhash64("digest")), keyed, "id").join(torn, "digest", "left_semi")
    met = met.groupBy("digest", "content", "doc_id", "points").agg(F.count("*").alias("again"))
    return met.join(winners, ["digest", "content"]).drop("content")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Of rows equal in doc_id, length and compared text any one stays."""
    kept = groups(docs).where("kept").select(F.col("doc_id").alias("_exact_id"), F.col("points").alias("_exact_n"), F.col("digest").alias("_exact_h"))
    keyed = docs.select("*", F.coalesce(F.length("text"), F.lit(0)).alias("_exact_points"), sha256(normalised()).alias("_exact_digest"))
    same = (F.col("_exact_digest") == F.col("_exact_h")) & (F.col("_exact_points") == F.col("_exact_n"))
    stay = keyed.join(kept, same & F.col("doc_id").eqNullSafe(F.col("_exact_id")), "left_semi")
    return stay.dropDuplicates(["doc_id", "_exact_points", "_exact_digest"]).select(*docs.columns)


def op13_exact(spark, sf_dir: str) -> DataFrame:
    found = groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP13_SQL = r"""
with d as (select doc_id, coalesce(length(text), 0) points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') content from documents)
select doc_id, first_value(doc_id) over w keep_id, count(*) over (partition by content) group_size, row_number() over w = 1 kept,
       sha256(content) text_sha256
from d window w as (partition by content order by points desc, doc_id nulls last rows between unbounded preceding and unbounded following)"""
