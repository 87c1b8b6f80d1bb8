"""Documents to a training mix: five stages, each written as Parquet and reread as the next one's documents.

Every stage but the last returns the columns of its input, whatever they are called; what the operators add has other names.
Rows without doc_id name nothing and leave in the first stage. All stages take whole texts, of any length, and give an empty
table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plainfold.llm.common import one_per_id, quoted, save, table, work
from plainfold.llm.decontaminate import decontaminate
from plainfold.llm.line_dedup import line_dedup
from plainfold.llm.mixing import mixed
from plainfold.llm.ngram_join import ngram_join
from plainfold.llm.quality import keep_good


def good_only(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Null and empty texts are scored as empty ones; rows of equal text
    have equal scores, and all rows of an id that is kept stay. Without labels of both kinds nothing can be learned: then
    every document scores 0.5 and stays."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def lines_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a document of smaller id holds go, and a document's own repeated lines stay; a document stays, though it be
    left without text, and null texts become empty. Of rows that repeat an id, one stays."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    kept = line_dedup(docs).select("doc_id", "text")
    rows = one_per_id(docs, "doc_id", *others) if others else one_per_id(docs, "doc_id")
    out = rows.join(kept, "doc_id")
    if "n_chars" in others:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*quoted(docs.columns))


def one_of_a_kind(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by their shingles, the one with the smallest id stays. Texts without words link with nothing."""
    first = ngram_join(docs).where("doc_id = component_id").select(F.col("doc_id").alias("_first"))
    return docs.join(first, docs["doc_id"] == first["_first"], "left_semi")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go. Null and empty texts hold none, null and empty items stand in none."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document that is left. Texts without words have size 0 and give nothing; a null source is
    one of its own. Ties in the shuffled order go to the smaller id."""
    return mixed(docs)


STAGES = [
    ("quality classifier", good_only),
    ("line dedup", lines_once),
    ("n-gram Jaccard join", one_of_a_kind),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources to target weights", to_weights),
]

#: A learned classifier isn't SQL; tests/llm/test_pipeline.py holds the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = work(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = save(stage(spark, docs, sf_dir), at, f"stage{i}")
    return docs
