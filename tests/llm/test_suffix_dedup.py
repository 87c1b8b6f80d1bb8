import random

import numpy as np
import pytest

from plainfold.llm import suffix_dedup as op
from plainfold.llm.deep_shallow import suffix_order


def brute(docs, length=100):
    seen, out = set(), {}
    for i, text in sorted(docs.items()):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for at in range(len(data) - length + 1):
            x = data[at : at + length]
            if x in seen:
                gone[at : at + length] = True
            seen.add(x)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        out[i] = (len(data), [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2])], data[: len(data)] if not len(edge) else bytes(np.frombuffer(data, np.uint8)[~gone]))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9)))
    texts = [" ".join(word() for _ in range(rng.randrange(0, 120))) for _ in range(25)]
    passages = [" ".join(word() for _ in range(n)) for n in (16, 20, 40, 90)]
    for _ in range(40):
        parts = [" ".join(word() for _ in range(rng.randrange(0, 30))) for _ in range(3)]
        for _ in range(rng.randrange(0, 4)):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(passages))
        texts.append(" ".join(parts))
    texts += [texts[3], texts[3], texts[30], None, "", "a" * 700, "ab" * 300 + "c" + "ab" * 300, "a" * 99, "x" * 100, "x" * 100, "x" * 101]
    texts.append(texts[40][7:] + "!" + texts[41][:-3])
    rng.shuffle(texts)
    return dict(enumerate(texts))


@pytest.mark.parametrize("seed, heavy, hold, piece", [(1, 2000, 1 << 25, 1 << 23), (2, 1, 600, 150), (3, 3, 3000, 1000), (4, 2000, 900, 1 << 23)])
def test_equals_brute_force(spark, monkeypatch, seed, heavy, hold, piece):
    docs = corpus(seed)
    monkeypatch.setattr(op, "HEAVY", heavy)
    monkeypatch.setattr(op, "HOLD", hold)
    monkeypatch.setattr(op, "PIECE", piece)
    for name in ("_first_pass", "_fetch", "_sort_suffixes"):  # the workers import the module anew
        def patched(batches, *a, f=getattr(op, name), hold=hold, piece=piece, heavy=heavy):
            import plainfold.llm.suffix_dedup as mine

            mine.HOLD, mine.PIECE = hold, piece
            return getattr(mine, f.__name__)(batches, *a)
        monkeypatch.setattr(op, name, patched)
        patched.__name__ = name
    rows = [(i, t, "x") for i, t in docs.items()] + [(None, "y" * 300, "x"), (0, docs[0], "x")]
    out = op.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string, kept string").repartition(5)).collect()
    want = brute(docs)
    assert {r.doc_id: (r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in out} == want


def test_empty_table(spark):
    assert op.suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("letters", [b"ab", b"abcdefgh"])
def test_suffix_order_sorts(letters):
    rng = np.random.default_rng(len(letters))
    text = bytes(rng.choice(list(letters), 400).astype(np.uint8)) + b"abab" * 60 + bytes(rng.choice(list(letters), 100).astype(np.uint8)) + b"abab" * 60 + b"a" * 200
    buf = np.frombuffer(text, np.uint8)
    start = rng.permutation(len(buf) - 99)
    group = rng.integers(0, 3, len(start))
    order, number = suffix_order(buf, start, group, 100)
    keys = [(int(group[i]), text[start[i] : start[i] + 100]) for i in order]
    assert keys == sorted(keys)
    assert [a == b for a, b in zip(keys, keys[1:])] == [a == b for a, b in zip(number, number[1:])]
