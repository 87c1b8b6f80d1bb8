"""Every operator and stage: nulls in any column, empty and long texts, ties, repeated rows, and extra columns whose names
the operators use themselves."""

import pytest

import corpus_pipeline
from plainfold.llm import chat, warc
from plainfold.llm.decontaminate import contaminated
from plainfold.llm.line_dedup import line_dedup
from plainfold.llm.mixing import mixed
from plainfold.llm.ngram_join import ngram_join
from plainfold.llm.pii import personal_data, redact
from plainfold.llm.quality import quality
from plainfold.llm.suffix_dedup import suffix_dedup
from plainfold.llm.topk import top_k

CLASH = ["_bad", "_good", "_first", "_row", "id", "size", "h1", "own", "label", "component_id", "score", "spans", "kind", "count", "a.b"]
PROSE = "the river runs past the old mill and on to the town where seven bridges cross it one after another "

DOCS = [
    (1, PROSE, "en", "a", len(PROSE)), (2, PROSE, "en", "a", 7), (2, PROSE, "en", "a", 7), (3, None, None, None, None),
    (4, "", "de", "b", 0), (5, " \n\t\n ", None, "b", 5), (6, "x", "en", None, 1), (7, PROSE * 4000, "en", "a", None),
    (8, "é \u0000😀 " * 20, "fr", "c", 80), (None, PROSE, "en", "a", 1), (None, None, None, None, None), (9, "\n" * 500, "en", "", 500),
]
LABELS = [(1, 1, 0), (2, 0, 0), (3, None, None), (None, 1, 1), (7, 1, None), (8, 0, 0), (8, 0, 0)]
ITEMS = [(1, None), (2, ""), (None, PROSE), (3, "not in any of the documents at all, whatever one may look for here")]


def with_clashes(df):
    for name in CLASH:
        df = df.withColumn(name, df[df.columns[0]].cast("string"))
    return df


@pytest.fixture(scope="module")
def docs(spark):
    return with_clashes(spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string, n_chars long")).repartition(3)


IDS = [1, 2, 3, 4, 5, 6, 7, 8, 9]


@pytest.mark.parametrize("op", [line_dedup, mixed, ngram_join, personal_data, redact, suffix_dedup])
def test_one_row_for_each_id(docs, op):
    assert sorted(r.doc_id for r in op(docs).collect()) == IDS


def test_with_a_second_table(spark, docs):
    labels = with_clashes(spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int"))
    items = with_clashes(spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert sorted(r.doc_id for r in quality(docs, labels).collect()) == IDS
    assert contaminated(docs, items).collect() == []


def test_other_tables(spark, docs):
    pages = with_clashes(docs.selectExpr("doc_id AS page_id", "lang AS url", "text AS html"))
    assert sorted(r.page_id for r in warc.convert(pages).collect()) == IDS
    turns = with_clashes(docs.selectExpr("doc_id AS conv_id", "n_chars AS turn", "lang AS role", "text"))
    assert sorted(r.conv_id for r in chat.read_back(chat.reconstruct(chat.log(turns))).collect()) == [-1, *IDS]
    vectors = with_clashes(docs.selectExpr("doc_id - 1 AS vec_id", "CASE WHEN doc_id < 4 THEN array(1f, 2f) END AS embedding"))
    assert [tuple(r) for r in top_k(vectors).orderBy("rank").collect()] == [(0, 1, 1, 327680), (0, 2, 2, 327680)]


def test_stages(spark, docs, tmp_path):
    spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        got = {r.doc_id for r in out.collect()}
        assert got <= {*IDS, None}, name
        if stage is not corpus_pipeline.to_weights:
            assert out.columns == docs.columns, name
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} <= set(IDS)
