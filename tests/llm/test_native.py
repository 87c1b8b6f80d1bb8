"""Line dedup and mixing against brute force, edges included."""

import pytest

from plainfold.llm import mixing
from plainfold.llm.line_dedup import LineIndex, _in_order, line_dedup

from .test_pipeline import lines_brute, mix_brute

TEXTS = {
    1: "a long enough line\nshort\nA Long Enough Line  ", 2: "\ta long enough line\nshort\n", 3: None, 4: "", 5: "ééééééééééé\nother line here", 6: "ÉÉÉÉÉÉÉÉÉÉÉ\nééééééééééé",
    7: "same\n" * 3000 + "a very common line\n" * 3000, 8: "a very common line\n\n\n", 9: "exactly 10\nexactly 10", 10: "exactly 10\nnine char",
}


@pytest.mark.parametrize("batches, fanout", [(1, 2), (4, 2), (7, 3), (None, 2)])
def test_line_dedup(spark, batches, fanout):
    rows = [(i, t, 1) for i, t in TEXTS.items()] + [(None, "a long enough line", 1), (2, TEXTS[2], 1)]
    got = line_dedup(spark.createDataFrame(rows, "doc_id long, text string, pos int"), batches=batches, fanout=fanout).collect()
    want = lines_brute(TEXTS)
    assert {r.doc_id: r.text for r in got} == want and len(got) == len(want)
    assert {r.doc_id: r.n_lines for r in got} == {i: (t or "").count("\n") + 1 for i, t in TEXTS.items()}


def test_empty_tables(spark):
    assert line_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert mixing.mixed(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []


@pytest.mark.parametrize("block, bucket", [(4096, 4000), (1, 1), (7, 3)])
def test_mixing(spark, block, bucket):
    text = {i: "w " * (i * 37 % 101) for i in range(60)} | {60: None, 61: "", 62: "x\x0by z", 63: "word " * 9000}
    source = {i: (None if i % 11 == 0 else "b" if i < 40 else f"é{i % 4}") for i in text}
    source[5] = "tiny"
    rows = [(i, t, source[i], 1.5) for i, t in text.items()] + [(None, "x", "b", 0.0), (63, text[63], source[63], 1.5)]
    rows = spark.createDataFrame(rows, "doc_id long, text string, source string, target double")
    got = {r.doc_id: (r["size"], r.source_size, round(r.target, 6), r.taken) for r in mixing.mixed(rows, block_words=block, bucket_rows=bucket).collect()}
    assert got == mix_brute(text, source)
    steps = mixing.mix(rows, block_words=block, bucket_rows=bucket)[1].groupBy("step").sum("n_words").collect()
    assert max(r[1] for r in steps) <= max(block, 1) + 1


def test_nothing_to_mix(spark):
    rows = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert sorted(tuple(r) for r in mixing.mixed(rows).collect()) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]


def test_runs_are_merged_without_exchange_or_sort(spark, tmp_path):
    index = LineIndex(spark, str(tmp_path / "index"))
    keys = [spark.range(i * 1000, i * 1000 + 2000).selectExpr("xxhash64(id) AS h1", "xxhash64(1, id) AS h2", "id AS doc_id").groupBy("h1", "h2").agg({"doc_id": "min"}).toDF("h1", "h2", "doc_id") for i in range(5)]
    new = [index.add(k).count() for k in keys[:4]]
    assert new == [2000, 1000, 1000, 1000] and [len(x) for x in index.levels] == [2, 1]
    index.add(keys[4])
    assert [len(x) for x in index.levels] == [1, 0, 1]
    with _in_order(spark):
        text = plan(index.unseen(keys[0]))
        assert text.count("SortMergeJoin") == 2 and text.count("Exchange") == 1 and text.count("Sort [") == 1, text  # both of the batch
        assert text.index("SortMergeJoin") < text.index("Exchange") < text.index("partial_min"), text
        (_, a), (_, b) = index.levels[0][0], index.levels[2][0]
        text = plan(index.merged(a, b))
        assert "SortMergeJoin" in text and "Exchange" not in text and "Sort [" not in text, text
    again = LineIndex.open(spark, str(tmp_path / "index"))
    assert again.unseen(keys[2]).count() == 0 and [len(x) for x in again.levels] == [1, 0, 1]


def test_an_index_is_extended_by_later_calls(spark, tmp_path):
    at, df = str(tmp_path / "kept"), lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    line = "a line that is long enough"
    assert {r.doc_id: r.text for r in line_dedup(df([(5, f"{line}\nx"), (6, line)]), index=at).collect()} == {5: f"{line}\nx", 6: ""}
    assert {r.doc_id: (r.text, r.n_dropped) for r in line_dedup(df([(1, f"{line}\nanother line"), (2, "Another line ")]), index=at).collect()} == {1: ("another line", 1), 2: ("", 1)}
    assert [r.text for r in line_dedup(df([(9, f"another line\n{line}\nnew")]), index=at).collect()] == ["new"]


def test_every_prefix_of_the_schedule_is_near_its_shares(spark):
    """Van der Corput points: in the first m of n slots each source has its share of m, give or take about log2(m)."""
    import math

    rows = [(i, "w " * (50 + i % 90), f"s{i % 13 % 5}") for i in range(3000)]
    rows = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = rows.selectExpr("doc_id", "source", "regexp_count(text, 'w') AS size")
    sources = mixing.targets(sizes)
    total = sum(r.quota for r in sources.collect())
    k = 10
    slots = mixing.schedule(sources, -(-total // (1 << k)), k).where(f"step < {1 << k}").orderBy("step").collect()
    share, count, worst = {r["rank"]: r.quota / total for r in sources.collect()}, {}, 0
    assert [r.step for r in slots] == list(range(len(slots))) or len(slots) >= (1 << k) - len(share)
    for m, r in enumerate(slots, 1):
        count[r["rank"]] = count.get(r["rank"], 0) + 1
        worst = max(worst, *(abs(count.get(s, 0) - (r.step + 1) * share[s]) / (math.log2(m) + 2) for s in share))
    assert worst <= 1, worst
    runs = [r["rank"] for r in slots]
    assert len(set(runs[:16])) == len(share)  # no source waits for another to be done


def test_the_first_step_of_a_document(spark):
    rows = spark.createDataFrame([(i, "w " * (i % 40), f"s{i % 3}") for i in range(300)], "doc_id long, text string, source string")
    for block in (7, 64):
        docs, taken = mixing.mix(rows, block_words=block)
        first = {r.doc_id: r[1] for r in taken.groupBy("doc_id").min("step").collect()}
        got = {r.doc_id: r.first_step for r in mixing.mixed(rows, steps=True, block_words=block).collect()}
        assert got == {r.doc_id: first.get(r.doc_id) for r in docs.collect()}
