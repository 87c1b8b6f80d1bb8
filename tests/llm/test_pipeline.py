import hashlib
import math
import re

import numpy as np

import corpus_pipeline
from plainfold.llm.quality import SHAPES, features, held_out, preferences, quality

from .test_ngram_join import brute as near
from .test_quality import corpus

ITEM = "what is the name of the tall tower that stands beside the river in the old capital of this country"


def lines_brute(docs):
    own, out = {}, {}
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\f\r"))
    for i in sorted(docs):
        for x in (docs[i] or "").split("\n"):
            own.setdefault(key(x), i)
    for i, t in docs.items():
        out[i] = "\n".join(x for x in (t or "").split("\n") if len(key(x)) < 10 or own[key(x)] == i)
    return out


def mix_brute(docs, source):
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in docs.items()}
    names = sorted({source[i] for i in docs}, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(size[i] for i in docs if source[i] == s) for s in names}
    weight = {s: n % 3 + 1 for n, s in enumerate(names)}
    target, full = {}, set()
    while True:
        rest = sum(total.values()) - sum(3 * total[s] for s in full)
        w = sum(weight[s] for s in names if s not in full)
        target = {s: 3 * total[s] if s in full else rest * weight[s] / w for s in names}
        over = {s for s in names if s not in full and target[s] > 3 * total[s]}
        if not over:
            break
        full |= over
    out = {}
    for s in names:
        at, quota = 0, int(target[s] + 0.5)
        for i in sorted((i for i in docs if source[i] == s), key=lambda i: (hashlib.md5(f"mix{i}".encode()).hexdigest(), i)):
            taken = sum(max(0, min(quota, e * total[s] + at + size[i]) - (e * total[s] + at)) for e in range(3))
            out[i] = (size[i], total[s], round(target[s], 6), taken)
            at += size[i]
    return out


def test_equals_brute_force(spark, tmp_path):
    docs, labels = corpus(300)
    text = {i: t for i, t, _ in docs}
    source = {i: f"s{i % 7 if i % 3 else 0}" for i in text}
    source[8] = None
    for i in (12, 14, 17):
        text[i] = text[2] + f" tail{i}"
    for i in (21, 23):
        text[i] += " " + ITEM + " " + text[i][::-1]
    for i in (31, 33, 34):
        text[i] += "\nA line that many documents share \n" + text[i][::-1]
    text[37], text[38] = None, ""
    rows = spark.createDataFrame([(i, t, "en", source[i], len(t or "")) for i, t in text.items()] + [(None, "x", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    lab.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    good = {r.doc_id for r in quality(rows, lab).where("predicted = 1").collect()}
    left = lines_brute({i: text[i] for i in good})
    part = near(list(left.items()))
    left = {i: t for i, t in left.items() if part[i][1] == i and ITEM not in (t or "")}
    assert not {12, 14, 17, 21, 23} & set(left)
    got = {r.doc_id: (r["size"], r.source_size, round(r.target, 6), r.taken) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == mix_brute(left, source)


def test_stages_keep_columns(spark, tmp_path):
    rows = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, schema in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, rows, str(tmp_path)).schema.names == rows.columns
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_the_classifier_stage_equals_a_fit_written_out(spark, tmp_path):
    """The first stage against Bradley-Terry's loss descended by its gradient, pair by pair, over features of one text at a time."""
    docs, labels = corpus(150)
    text = {i: t for i, t, _ in docs}
    rows = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in text.items()], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    known = sorted(((y, features(text[i]).astype(np.float32).tobytes(), i) for i, y, _ in labels if not held_out(i)))
    y = np.array([k[0] for k in known])
    x = np.array([np.frombuffer(k[1], np.float32) for k in known]).astype(float)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[SHAPES:] = 3 * math.sqrt((x.std(axis=0)[SHAPES:] ** 2).mean())
    scale[scale < 1e-9] = 1
    z = lambda v: np.clip((v - mean) / scale, -5, 5)
    good, bad = preferences(y, 100_000, 1)
    counts = {}
    for a, b in zip(good.tolist(), bad.tolist(), strict=True):
        counts[a, b] = counts.get((a, b), 0) + 1
    d, n, w = np.array([z(x[a]) - z(x[b]) for a, b in counts]), np.array(list(counts.values())) / len(good), np.zeros(x.shape[1])
    fast = w.copy()
    for step in range(4000):  # accelerated
        p = 1 / (1 + np.exp(np.clip(d @ fast, -30, 30)))
        new = fast - 0.2 * (1e-3 * fast - d.T @ (n * p))
        fast, w = new + step / (step + 3) * (new - w), new
    cut = np.quantile(z(x) @ w, (y == 0).mean())
    margin = {i: float(z(features(t)) @ w - cut) for i, t in text.items()}
    kept = {r.doc_id for r in corpus_pipeline.good_only(spark, rows, str(tmp_path)).collect()}
    assert {i for i, m in margin.items() if m > 1e-2} <= kept <= {i for i, m in margin.items() if m > -1e-2}
    assert 0 < len(kept) < len(text)
