import random
import re

import pytest

from plainfold.llm import ngram_join as op
from plainfold.llm.ngram_join import ngram_join


def brute(docs, percent=80):
    sets = {}
    for i, text in docs:
        if i is None:
            continue
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())
    name = {i: i for i in sets}

    def root(x):
        while name[x] != x:
            x = name[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                name[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return words


def corpus(seed):
    rng = random.Random(seed)
    docs, passage = [], [f"p{i}" for i in range(60)]
    for _ in range(12):
        base = [f"v{rng.randrange(400)}" for _ in range(rng.choice([3, 5, 8, 9, 12, 20, 40, 120, 300]))]
        if rng.random() < 0.5:
            base += passage
        for _ in range(rng.randrange(1, 9)):
            docs.append(" ".join(edited(rng, base, rng.randrange(0, 1 + len(base) // 25))))
    docs += ["", None, "  \n", "One two", "one  TWO\n", "a b c d e", "a b c d e"]
    rng.shuffle(docs)
    return list(enumerate(docs)) + [(None, "a b c d e"), (3, docs[3])]


@pytest.mark.parametrize("seed, long, rounds", [(1, 64, 3), (2, 0, 3), (3, 2, 1), (4, 64, 1)])
def test_equals_brute_force(spark, monkeypatch, seed, long, rounds):
    docs = corpus(seed)
    monkeypatch.setattr(op, "LONG", long)
    rows = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, size int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join(rows, rounds=rounds).collect()}
    assert got == brute(docs)


def test_a_chain_of_near_copies_is_one_component(spark):
    rng = random.Random(5)
    base = [f"v{i}" for i in range(100)]
    chain = []
    for i in range(60):
        chain.append((i, " ".join(base)))
        base = edited(rng, base, 1)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join(spark.createDataFrame(chain, "doc_id long, text string")).collect()} == brute(chain)


def test_empty_table(spark):
    assert ngram_join(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_lists_do_not_depend_on_batches():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    key = np.sort(rng.integers(0, 40, 90))
    rows = pa.record_batch({"token": key, "id": np.arange(90), "meta": (key == 5).astype(np.int64)})
    whole = pa.Table.from_batches(op._lists(iter([rows]))).to_pydict()
    for step in (1, 2, 7):
        assert pa.Table.from_batches(op._lists(iter([rows.slice(i, step) for i in range(0, 90, step)]))).to_pydict() == whole


def thue_morse(n, swapped=0):
    return "".join("ab"[(i.bit_count() + swapped) % 2] for i in range(n))


@pytest.mark.parametrize("size", [128, 1024, 4096])
def test_periodic_words_that_cancel_in_sums_of_powers_stay_apart(spark, size):
    docs = [(1, thue_morse(size)), (2, thue_morse(size, 1)), (3, thue_morse(size).upper()), (4, " ".join([thue_morse(size)] * 9)), (5, " ".join([thue_morse(size, 1)] * 9))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs) and got[2] == (1, 2) and got[3] == (1, 1) and got[5] == (1, 5)


@pytest.mark.parametrize("percent", [1, 30, 50, 65, 80, 90, 100])
def test_other_thresholds_equal_brute_force(spark, percent):
    rng = random.Random(percent)
    docs = [" ".join(rng.choice("ab") for _ in range(rng.randrange(0, 9))) for _ in range(60)]
    docs += [" ".join(f"v{j}" for j in range(n)) + tail for n in (4, 5, 6, 7, 8, 9, 11, 14, 19, 24) for tail in ("", " x", " x y", " a b c d e f g")]
    docs = list(enumerate(docs)) + [(i + 1000, t) for i, t in corpus(percent) if i is not None]
    rows = spark.createDataFrame(dict(docs).items(), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join(rows, percent=percent).collect()}
    assert got == brute(list(dict(docs).items()), percent)


def test_a_threshold_out_of_range_is_refused(spark):
    with pytest.raises(ValueError):
        ngram_join(spark.createDataFrame([], "doc_id long, text string"), percent=0)


def test_components_extended_by_more_links(spark, tmp_path):
    from plainfold.llm.components import components, extended

    rng = random.Random(8)
    links = [(a, b) for a, b in ((rng.randrange(300), rng.randrange(300)) for _ in range(220)) if a != b] + [(i, i + 1) for i in range(1000, 1064)] + [(2000, i) for i in range(2001, 2050)]
    name = {i: i for link in links for i in link}

    def root(x):
        return x if name[x] == x else root(name[x])

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        name[y] = x
    want = {i: root(i) for i in name}
    rng.shuffle(links)
    at, label = f"file://{tmp_path}", None
    df = lambda rows, i: spark.createDataFrame(rows, "a long, b long").repartition(3)
    for i, part in enumerate((links[:150], links[150:250], [], links[250:])):
        label = extended(label, df(part, i), at, f"p{i}") if label else components(df(part, i), at, f"p{i}")
    got = {r.id: r.label for r in label.collect()}
    assert got == want and label.count() == len(want)
