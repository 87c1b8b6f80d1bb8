import random
from zlib import crc32

import numpy as np
import pytest

from plainfold.llm.quality import FEATURES, SHAPES, features, fit_pairs, keep_good, matrix, preferences, quality


def corpus(n=400):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 8))) for _ in range(rng.randrange(30, 200))]
        bad = i % 5 == 0
        if bad:
            words = [w.upper() + "!!" for w in words] if i % 2 else [w for w in words for _ in range(15)]
        docs.append((i, " ".join(words), "s"))
        labels.append((i, int(not bad), 0))
    return docs, labels


def test_held_out_accuracy_and_edges(spark):
    docs, labels = corpus()
    more = [(1000, None, "s"), (1001, "", "s"), (1002, "word " * 200_000, "s"), (None, "x", "s"), (3, docs[3][1], "s")]
    d = spark.createDataFrame([(*x, 0.5) for x in docs + more], "doc_id long, text string, source string, score double")
    lab = spark.createDataFrame([*labels, (5000, 1, 0), (None, 1, 0), (7, None, 0), (9, 3, 0), labels[2]], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality(d, lab).collect()}
    assert set(got) == {i for i, *_ in docs} | {1000, 1001, 1002}
    truth = {i: y for i, y, _ in labels}
    out = [i for i in truth if crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in out) for i in truth)
    assert sum(got[i].predicted == truth[i] for i in out) >= 0.95 * len(out)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert got[1000].score == got[1001].score
    assert {r.doc_id: r.score for r in quality(d.repartition(3), lab).collect()} == {i: r.score for i, r in got.items()}
    kept = keep_good(d, lab)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [(r.score, r.predicted) for r in quality(d, lab).collect()] == [(0.5, 1)]
    assert quality(d.limit(0), lab).collect() == []


@pytest.mark.parametrize("text", ["", " \n ", "x", "!!!", "a\nb\nc", "é" * 100_000])
def test_features_are_finite(text):
    assert abs(features(text)).max() < 1e6


def test_weights_equal_an_independent_fit():
    """Bradley-Terry's loss written out pair by pair and descended by its gradient."""
    rng = np.random.default_rng(2)
    z = rng.normal(size=(80, 6))
    y = (z @ [2, -1, 0.5, 0, 0, 1] + rng.normal(size=80) > 0).astype(int)
    good, bad = preferences(y, 3000, 5)
    assert (y[good] == 1).all() and (y[bad] == 0).all()
    d, w = z[good] - z[bad], np.zeros(6)
    for _ in range(6000):
        w -= 0.5 * (-(d * (1 / (1 + np.exp(d @ w)))[:, None]).mean(axis=0) + 0.01 * w)
    assert np.abs(fit_pairs(z, good, bad, 0.01) - w).max() < 1e-4


def test_features_by_hand_and_in_company():
    text = "The cat sat.\nThe CAT sat, 12 | 7 mats!\n\nThe cat sat.\n" + "x" * 41
    n = 14
    got = features(text)
    want = {1: np.log1p(n), 4: 9 / n, 5: 1 / n, 6: 1 / n, 7: 1 / n, 8: 1 / n, 10: 3 / 4, 11: np.log1p(n / 4), 12: 4 / n, 14: 3 / n, 16: 3 / 4, 17: 1 / n, 18: 1}
    size = np.array([len(w) for w in text.split()])
    want |= {2: size.mean(), 15: (size <= 3).mean(), 13: sum(w.isalpha() for w in text.split()) / n, 3: 0}
    for i, x in want.items():
        assert got[i] == pytest.approx(x), i
    assert got[SHAPES:].sum() == pytest.approx(1) and len(got) == FEATURES
    texts = [text, "", "a\nb", " ", text, "é " * 300, "one two\n"]
    buf = [t.encode() for t in texts]
    many = matrix(np.frombuffer(b"".join(buf), np.uint8), np.cumsum([0, *map(len, buf)]))
    assert all((row == features(t)).all() for row, t in zip(many, texts, strict=True))


def test_everything_is_kept_where_nothing_can_be_learned(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (None, "x")], "doc_id long, text string")
    for labels in ([], [(1, 1, 0)], [(1, 0, 0)]):
        kept = keep_good(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
        assert {r.doc_id for r in kept.collect()} == {1, 2}
