"""Connected components by minimum labels and pointer jumping, one written table a round."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import save


def components(links: DataFrame, at: str, name: str) -> DataFrame:
    """id, label: for each id of ``links`` (a, b; a written table), the smallest id that it reaches.

    A round gives each id the smallest label around it, then that label's own label. Grouping pre-aggregates, so an id
    with very many links is no hot key there; the joins on it can be split. Rounds end when no label changes, which the
    round's own job counts: a star takes one, a path of n links about log n."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = save(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumnRenamed("a", "id"), at, f"{name}-0")
    step = 0
    while True:
        step += 1
        near = both.join(label, both["b"] == label["id"]).groupBy("a").agg(F.min("label").alias("near"))
        low = label.join(near, label["id"] == near["a"]).select("id", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        far = label.select(F.col("id").alias("label"), F.col("label").alias("far"))
        new = low.join(far, "label", "left").select("id", F.least("label", "far").alias("label"), "was")
        seen = Observation()  # counted again where a task is, which doesn't matter: any change goes on
        label = save(new.observe(seen, F.count_if(F.col("label") != F.col("was")).alias("changed")).select("id", "label"), at, f"{name}-{step}")
        if not seen.get["changed"]:
            return label


def extended(label: DataFrame, links: DataFrame, at: str, name: str) -> DataFrame:
    """``label`` (id, label) with more links: only the components that these join are gone through again."""
    ends = links
    for c in ("a", "b"):
        own = label.select(F.col("id").alias(c), F.col("label").alias(f"l{c}"))
        ends = ends.join(own, c, "left").withColumn(f"l{c}", F.coalesce(f"l{c}", c))
    joined = save(ends.where("la != lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), at, f"{name}-links")
    merged = components(joined, at, name).select(F.col("id").alias("label"), F.col("label").alias("to"))
    fresh = merged.join(label, "label", "left_anti").select(F.col("label").alias("id"), F.col("to").alias("label"))  # ids without a label so far
    kept = label.join(merged, "label", "left").select("id", F.coalesce("to", "label").alias("label"))
    return save(kept.unionByName(fresh), at, f"{name}-all")
