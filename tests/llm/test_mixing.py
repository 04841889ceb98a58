from collections import Counter

import duckdb
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from waymark.llm import mixing


def water_level(sizes, weights, budget):
    """Targets by filling until none is above three times its size."""
    open_, target = set(sizes), {}
    left = budget
    while open_:
        level = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if 3 * sizes[s] <= level * weights[s]}
        if not full:
            return {**target, **{s: level * weights[s] for s in open_}}
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 500, "c": 300}, {"a": 1, "b": 1, "c": 1, "d": 1000}, {"a": 0, "b": 7}, {"a": 5}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
    got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    want = water_level(sizes, weights, sum(sizes.values()))
    assert got == pytest.approx(want)


def test_hard_rows(spark):
    texts = [("b", "x y z"), ("b", None), (None, "one two"), ("a", ""), ("a", "w " * 5000), ("a", "p q")] * 3
    rows = [Row(doc_id=None if i == 4 else i // 2, text=t, source=s, size="mine") for i, (s, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    assert all(0 <= r.copies <= 3 and (r["size"] > 0 or r.copies == 0) for r in out)
    assert sum(r["size"] * r.copies for r in out) <= sum(r["size"] for r in out)
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(docs).collect()))
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mixed(docs).columns == docs.columns
    assert mixing.mix(docs.withColumn("text", F.lit(None).cast("string"))).where("copies > 0").count() == 0


def test_sources_come_near_their_targets(spark):
    sf = "/root/testdata/sf0.01"
    mix = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet")).groupBy("source")
    rows = mix.agg(F.max("target").alias("target"), F.sum(F.col("size") * F.col("copies")).alias("taken"), F.max("size").alias("longest")).collect()
    assert all(abs(r.taken - r.target) <= r.longest for r in rows)


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.execute(f"{mixing.OP1_SQL} order by doc_id").fetchall()
    assert [tuple(r) for r in mixing.op1_mix(spark, sf).orderBy("doc_id").collect()] == want


def test_mix_is_in_order_of_finish_times(spark, sf):
    """Each part of the merged queue serves the sources in the same shares, and holds the copies that ``mix`` counts."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mixing.mixed(docs).select("doc_id", "source", mixing.n_words().alias("n")).collect()
    counted = {r.doc_id: r.copies for r in mixing.mix(docs).where("copies > 0").collect()}
    assert Counter(r.doc_id for r in rows) == counted
    targets = {r.source: r.target for r in mixing.mix(docs).select("source", "target").distinct().collect()}
    longest, done = max(r.n for r in rows), Counter()
    for i, r in enumerate(rows):
        done[r.source] += r.n
        if i % 50 == 49:
            at = max((done[s] / targets[s] for s in targets))
            assert all(abs(done[s] / targets[s] - at) <= 2 * longest / min(targets.values()) for s in targets)


def test_rows_without_an_id_queue_apart(spark):
    """A third of all rows has no id, another third has one id: every row is still counted, and the budget kept, in any division."""
    docs = spark.range(3000).selectExpr(
        "case when id % 3 = 0 then null when id % 3 = 1 then 7 else id end doc_id", "concat('w', id, repeat(' x', cast(id % 5 as int))) text", "if(id % 2 = 0, 'a', 'b') source"
    )
    total = docs.agg(F.sum(mixing.n_words())).first()[0]
    for parts in (1, 7):
        out = mixing.mix(docs.repartition(parts)).agg(F.count("*").alias("n"), F.sum(F.col("size") * F.col("copies")).alias("taken"), F.sum(F.hash("text").cast("long") * F.col("copies")).alias("which")).first()
        assert out.n == 3000 and total - 15 <= out.taken <= total
        assert parts == 1 or out == first
        first = out
