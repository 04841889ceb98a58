"""Mixing sources to target weights by weighted fair queueing.

Sizes are word counts. Every source gets a target (its weight's share of the budget, at most ``max_repeats`` times its
own size). Its documents queue in shuffled order, up to ``max_repeats`` passes; each copy has a virtual finish time, the
words of its source up to and including it divided by the source's target. All copies of all sources are range-sorted by finish
time; ranges are summed, words run on inside each, and the merged queue ends where the budget is spent, so every source is
served in step with its target. ``mixed`` gives the taken copies in this order, sources interleaved.

Defined results: null and empty texts have size 0 and are never taken; a null source is a source of its own, the
last; rows with a null doc_id, or with one that others have too, queue one by one, apart by their texts; equal rows take part one by one;
a text of any length is one document and counts whole; copies with equal finish times are taken together or not at all; an empty
table gives an empty table; input columns named like an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.session import discard, materialise

WORD = r"[^\x20\x09-\x0D]+"
#: Each source's shuffled queue is summed in this many pieces of equal hash range (three hex digits).
PIECE_DIGITS = 3


def n_words(text: str = "text") -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), budget_share: float = 1.0, max_repeats: int = 3) -> DataFrame:
    """One row per source of ``(source, source_size)``: adds ``target``.

    Sources in code-point order, null last, take ``weights`` in turn. A source's demand is ``cap / weight``; in rising
    order of demand, a source is capped when the level at which it would just be full asks no more than the budget of
    all sources together. The rest share what is left by weight. The windows run over one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.select("source", "source_size", weight.alias("_w"), F.row_number().over(order).alias("_r"))
    ranked = ranked.withColumn("_cap", F.col("source_size") * float(max_repeats)).withColumn("_level", F.col("_cap") / F.col("_w"))
    rising = Window.orderBy("_level", "_r")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    onward = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    filled = ranked.select(
        "*",
        (F.sum("source_size").over(whole) * float(budget_share)).alias("_budget"),
        (F.coalesce(F.sum("_cap").over(before), F.lit(0.0)) + F.col("_level") * F.sum("_w").over(onward)).alias("_asked"),
    ).withColumn("_full", F.col("_asked") <= F.col("_budget"))
    left = F.col("_budget") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(whole), F.lit(0.0))
    open_weight = F.sum(F.when(~F.col("_full"), F.col("_w"))).over(whole)
    return filled.select(
        "source", "source_size", F.when(F.col("_full"), F.col("_cap")).otherwise(left * F.col("_w") / open_weight).alias("target")
    )


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), budget_share: float = 1.0, max_repeats: int = 3) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with ``size``, ``source_size``, ``target`` and ``copies`` (0 to ``max_repeats``).

    Whole documents only. The shuffle is the order of the MD5 of doc_id and text, so reruns agree.
    """
    return _queued(docs, weights, budget_share, max_repeats).drop("_mix_h", "_mix_end")


def _queued(docs: DataFrame, weights: Sequence[float], budget_share: float, max_repeats: int) -> DataFrame:
    """``mix`` with the order ``_mix_h`` of each row in its source's queue and the words up to it in the first pass, ``_mix_end``."""
    kept = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies")]
    sized = docs.select(
        *kept,
        n_words().alias("size"),
        F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))).cast("binary")).alias("_mix_h"),
    ).withColumns({"_mix_source": _source_key(), "_mix_piece": F.substring("_mix_h", 1, PIECE_DIGITS)})
    slim = materialise(sized.select("doc_id", "source", "size", "_mix_h", "_mix_source", "_mix_piece"), "mix-sizes")

    sums = slim.groupBy("source", "_mix_piece").agg(F.sum("size").alias("_mix_sum"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("_mix_sum").alias("source_size")), weights, budget_share, max_repeats)
    in_source = Window.partitionBy("source").orderBy("_mix_piece")
    pieces = sums.withColumn("_mix_before", F.sum("_mix_sum").over(in_source) - F.col("_mix_sum")).alias("p")
    pieces = materialise(
        pieces.join(targets.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source"))).select(
            _source_key("p.source").alias("_mix_source"), "_mix_piece", "_mix_before", "source_size", "target"
        ),
        "mix-pieces",
    )

    def queued(rows: DataFrame) -> DataFrame:
        """Words of the source's queue up to and including each row, in the first pass. Sums and join divide rows alike, so texts move once."""
        own = Window.partitionBy("_mix_source", "_mix_piece").orderBy("_mix_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
        summed = rows.withColumn("_mix_sum", F.sum("size").over(own))
        return summed.join(pieces, ["_mix_source", "_mix_piece"]).withColumn("_mix_end", F.col("_mix_before") + F.col("_mix_sum"))

    copies = queued(slim).where((F.col("size") > 0) & (F.col("target") > 0))
    copies = copies.select("size", F.explode(F.array(*[_finish(F.lit(i)) for i in range(max_repeats)])).alias("at"))
    cut = _spent_at(copies, slim.agg((F.sum("size") * budget_share).alias("b")).first()["b"] or 0)
    taken = sum((F.when(_finish(F.lit(i)) <= cut, 1).otherwise(0) for i in range(max_repeats)), F.lit(0))
    return queued(sized).select(
        *kept, "size", "source_size", "target", "_mix_h", "_mix_end", F.when((F.col("size") > 0) & (F.col("target") > 0), taken).otherwise(0).alias("copies")
    )


def _source_key(source: str = "source") -> Column:
    """A source's name, distinct from the key of null, so that a plain join and a window on it need one shuffle."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit(""))


def _finish(copy: Column) -> Column:
    """Virtual finish time of a row's copy in the pass of that number."""
    return (copy * F.col("source_size") + F.col("_mix_end")).cast("double") / F.col("target")


def _spent_at(copies: DataFrame, budget: float) -> float:
    """The latest finish time up to which all copies (size, at) together stay within ``budget``; equal times go together.

    The range sort puts equal times into one range. Ranges are written with their numbers, which so stay the same when a task runs again.
    """
    ranged = materialise(copies.repartitionByRange("at").withColumn("_range", F.spark_partition_id()), "mix-queue")
    sums = ranged.groupBy("_range").agg(F.sum("size").alias("_sum"))
    before = sums.select("_range", (F.sum("_sum").over(Window.orderBy("_range")) - F.col("_sum")).alias("_before"))
    inner = F.sum("size").over(Window.partitionBy("_range").orderBy("at"))
    spent = ranged.withColumn("_inner", inner).join(before, "_range").where(F.col("_inner") + F.col("_before") <= budget)
    cut = spent.agg(F.max("at")).first()[0]
    discard(ranged)
    return -1.0 if cut is None else cut


def mixed(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), budget_share: float = 1.0, max_repeats: int = 3) -> DataFrame:
    """The mix itself: columns of ``docs``, each document as often as it is taken, range-sorted by finish time."""
    taken = _queued(docs, weights, budget_share, max_repeats).where(F.col("copies") > 0)
    each = taken.withColumn("_mix_copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).withColumn("_mix_at", _finish(F.col("_mix_copy")))
    return each.repartitionByRange("_mix_at", "_mix_h").sortWithinPartitions("_mix_at", "_mix_h").select(*docs.columns)


def op1_mix(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken")
    )


def mix_sql(docs: str, columns: str) -> str:
    """DuckDB text of the mix of table ``docs`` with the default parameters; ``columns`` may use those of table ``q``."""
    return f"""
with sized as (select *, cast(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) as bigint) size,
                      md5(coalesce(cast(doc_id as varchar), '') || ':' || coalesce(text, '')) h from {docs}),
src as (select source, cast(sum(size) as bigint) source_size from sized group by source),
ranked as (select *, row_number() over (order by source nulls last) r, [5.0, 2.0, 1.0][(row_number() over (order by source nulls last) - 1) % 3 + 1]::double w from src),
lev as (select *, source_size * 3.0::double as cap, source_size * 3.0::double / w as lvl, cast(sum(source_size) over () as double) budget from ranked),
ask as (select *, coalesce(sum(cap) over (order by lvl, r rows between unbounded preceding and 1 preceding), 0)
                  + lvl * sum(w) over (order by lvl, r rows between current row and unbounded following) <= budget as capped from lev),
tgt as (select source, source_size, case when capped then cap
          else (budget - coalesce(sum(case when capped then cap end) over (), 0)) * w / sum(case when not capped then w end) over () end target from ask),
q as (select s.*, t.source_size, t.target,
             cast(sum(size) over (partition by s.source order by h, doc_id, size rows unbounded preceding) as bigint) e
      from sized s join tgt t on s.source is not distinct from t.source),
c as (select size, cast(i * source_size + e as double) / target as t from q, range(3) x(i) where size > 0 and target > 0),
m as (select coalesce(max(t), -1) cut from (select t, sum(size) over (order by t) total from c) where total <= (select sum(size) from sized)),
f as (select q.*, case when size > 0 and target > 0 then (e / target <= cut)::int + ((cast(source_size + e as double)) / target <= cut)::int
             + ((cast(2 * source_size + e as double)) / target <= cut)::int else 0 end copies from q, m)
select {columns} from f"""


OP1_SQL = mix_sql("documents", "doc_id, size, source_size, target, cast(size * copies as bigint) as taken")
