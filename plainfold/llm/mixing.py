"""Mixing sources to target weights by a low-discrepancy schedule.

The sources' targets stand one after another on a line. The van der Corput points of base 2, N = 2^k of them, are
mapped through these cumulative weights: point j/N, drawn at step bit-reverse(j), is a slot of the source on whose
stretch it lies. A source's slots are ranked by step; its r-th slot takes the r-th block of equally many words of
its shuffled documents, going round as often as the target asks. One closing slot a source takes the words that are
left (less than a block), so that the words taken are the target, rounded.

Hot sources: no window has a whole source. Documents are summed in buckets of the shuffled order (about
``bucket_rows`` each), slots in runs of steps; only the sums of those meet in one window.

The sources themselves, one row each, are ranked and summed up in one task: some millions of them fit, as their names are
all that's sorted; more would need ranks by ranges.

Defined results: null texts have size 0; a null source is a source of its own, last in order; a repeated id counts
once and rows without id take no part (``one_per_id``); where all sizes are 0, nothing is taken. Other columns
aren't read. The order of a source's documents is that of md5(seed, doc_id), so reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import one_per_id, save, work

WORD = r"[^\x20\x09-\x0D]++"
RUN = 4096  #: steps of the schedule that are ranked together


def targets(sizes: DataFrame, most: int = 3) -> DataFrame:
    """source, source_size, n, weight, target: one row a source. The water level: sources by how soon they're full
    (``most`` times their size over weight); those before the level are full, the others share the rest by weight."""
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    rows = rows.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    rows = rows.withColumn("weight", (F.col("rank") - 1) % 3 + 1).withColumn("full", most * F.col("source_size") / F.col("weight"))
    by = W.orderBy("full", "rank")
    rows = rows.withColumns({
        "before": F.coalesce(most * F.sum("source_size").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        "open": F.sum("weight").over(by.rowsBetween(0, W.unboundedFollowing)),
        "all": F.sum("source_size").over(W.partitionBy()),
    })
    level = (F.col("all") - F.col("before")) / F.col("open")
    rows = rows.withColumn("level", F.max(F.when(level <= F.col("full"), level)).over(W.partitionBy()))
    target = F.least(F.coalesce(F.col("level") * F.col("weight"), F.lit(0.0)), (most * F.col("source_size")).cast("double"))
    return rows.select("source", "rank", "source_size", "n", "weight", target.alias("target"), F.floor(target + 0.5).alias("quota"))


def schedule(sources: DataFrame, block: int, k: int) -> DataFrame:
    """rank (of the source), slot (of the source, from 0), step, low, high: the words of the source's round stream
    that the slot takes."""
    before = F.coalesce(F.sum("quota").over(W.orderBy("rank").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("double")
    total = F.greatest(F.sum("quota").over(W.partitionBy()), F.lit(1)).cast("double")  # nothing to take: no stretch
    n = float(1 << k)
    stretch = sources.select("rank", "quota", F.ceil(before / total * n).alias("a"), F.least(F.ceil((before + F.col("quota")) / total * n), F.lit(int(n))).alias("b"))
    runs = stretch.where("b > a").select("rank", "quota", "a", "b", F.explode(F.expr(f"sequence(a div {RUN}, (b - 1) div {RUN})")).alias("run"))
    points = runs.repartition("rank", "run").select(
        "rank", "quota", F.explode(F.expr(f"sequence(greatest(a, run * {RUN}), least(b, (run + 1) * {RUN}) - 1)")).alias("j")
    )
    step = F.lit(0).cast("long") if k == 0 else F.conv(F.reverse(F.lpad(F.bin("j"), k, "0")), 2, 10).cast("long")
    points = points.select("rank", "quota", step.alias("step")).withColumn("run", F.expr(f"step div {RUN}"))
    base = points.groupBy("rank", "run").count().select(
        "rank", "run", F.coalesce(F.sum("count").over(W.partitionBy("rank").orderBy("run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base")
    )
    slot = F.row_number().over(W.partitionBy("rank", "run").orderBy("step")) - 1 + F.col("base")
    slots = points.join(base.hint("merge"), ["rank", "run"]).select("rank", "quota", slot.alias("slot"), "step")
    closing = stretch.select("rank", "quota", F.greatest(F.col("b") - F.col("a"), F.lit(0)).alias("slot"), (F.lit(int(n)) + F.col("rank")).alias("step"))
    low = F.col("slot") * block
    return slots.unionByName(closing).select("rank", "slot", "step", low.alias("low"), F.least(low + block, F.col("quota")).alias("high")).where("low < high")


def mix(docs: DataFrame, *, block_words: int = 4096, most: int = 3, bucket_rows: int = 4000, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """(documents, mixture). documents: doc_id, size, source_size, target. mixture: step, doc_id, first_word, n_words:
    in order of step, the words that the mix takes; a document stands there once for each block and round that has it."""
    spark = docs.sparkSession
    at = work(spark)
    sizes = one_per_id(docs, "doc_id", "text", "source").select(
        "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(seed), F.col("doc_id").cast("string"))).alias("at"),
    )
    sizes = save(sizes, at, "sizes")
    sources = save(targets(sizes, most), at, "sources")
    total = sources.agg(F.sum("quota")).first()[0] or 0
    k = max(0, math.ceil(math.log2(max(1, total / block_words))))
    block = max(1, -(-total // (1 << k)))
    rows = sizes.join(sources, sizes["source"].eqNullSafe(sources["source"])).select("doc_id", "at", "size", "rank", "n", "source_size", "target", "quota")
    bucket = F.floor(F.conv(F.substring("at", 1, 8), 16, 10).cast("long") * F.ceil(F.col("n") / bucket_rows) / float(1 << 32))
    rows = save(rows.withColumn("bucket", bucket), at, "rows")
    base = rows.groupBy("rank", "bucket").agg(F.sum("size").alias("words")).select(
        "rank", "bucket", F.coalesce(F.sum("words").over(W.partitionBy("rank").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base")
    )
    inside = F.coalesce(F.sum("size").over(W.partitionBy("rank", "bucket").orderBy("at", "doc_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("inside", inside).join(base.hint("merge"), ["rank", "bucket"]).withColumn("offset", F.col("base") + F.col("inside"))
    placed = placed.where("size > 0 and quota > 0").select(
        "doc_id", "rank", "size", F.explode(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda e: struct_of(e))).alias("round"), "quota"
    ).select("doc_id", "rank", F.col("round.a").alias("a"), F.least(F.col("round.a") + F.col("size"), F.col("quota")).alias("b")).where("a < b")
    pieces = placed.select("doc_id", "rank", "a", "b", F.explode(F.expr(f"sequence(a div {block}, (b - 1) div {block})")).alias("slot"))
    taken = pieces.join(schedule(sources, block, k).hint("merge"), ["rank", "slot"]).select(
        "step", "doc_id", (F.greatest("a", "low") - F.col("a")).alias("first_word"), (F.least("b", "high") - F.greatest("a", "low")).alias("n_words")
    )
    return rows.select("doc_id", "size", "source_size", "target"), taken.where("n_words > 0")


def struct_of(e):
    """Where the document's words begin in the source's stream, in round ``e``."""
    return F.struct((e.cast("long") * F.col("source_size") + F.col("offset")).alias("a"))


def mixed(docs: DataFrame, *, steps: bool = False, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken; with ``steps`` also first_step, the first one of the schedule that takes of
    the document (null: none does)."""
    rows, taken = mix(docs, **how)
    taken = taken.groupBy("doc_id").agg(F.sum("n_words").alias("taken"), F.min("step").alias("first_step"))
    out = [*rows.columns, F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), *([F.col("first_step").cast("long")] if steps else [])]
    return rows.join(taken, "doc_id", "left").select(*out)
