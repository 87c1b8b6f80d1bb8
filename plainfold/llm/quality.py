"""Quality classifier by Bradley-Terry pairwise ranking.

A document's strength is a linear function of features of its whole text: how often each of ``BINS`` hash classes of words
stands in it, and ``SHAPES`` shares and means (lengths, repetition, letters, lines). That a document labelled 1 is preferred
to one labelled 0 has the probability sigmoid(difference of strengths). The weights minimise the logistic loss over
preference pairs, which is a logistic regression on feature differences without intercept. A strength is turned into a
score that is 0.3 at the strength quantile which is the share of label 0 among the rows learned from, so that the
threshold 0.3 parts off as many of them as were labelled 0.

What is learned from is bounded: at most ``rows`` labelled rows (those of least hash of their id), and of these ``pairs``
pairs. All documents are scored. Labels, lang, source and ids are no features. Features are counted by numpy over the bytes
of many texts at once, and pairs are never laid out: gradients are summed up by document.

Defined results: null and empty texts have the features of an empty text and so a score; very long texts are counted whole;
rows without id take no part and repeated ids count once (``one_per_id``); labels that are null or neither 0 nor 1 aren't
learned from; of a document labelled several times, the greatest label counts; without labels of both kinds every score is
0.5, and ``keep_good`` keeps every document that has an id. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, chunks, mix, one_per_id, runs_of_words, word_hash, words

THRESHOLD = 0.3
BINS = 256
SHAPES = 19
FEATURES = SHAPES + BINS
_PIECE = 100  #: words over which repetition is measured


def _bytes(text: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(text.encode())] = True
    return out


_UPPER, _DIGIT, _COMMA, _BANG, _BAR = map(_bytes, ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ",", "!", "|"))
_SYMBOL, _END = _bytes("#$%&*|<>{}[]=\\^~_@"), _bytes(".!?:;\"')")
_LINE = _bytes("\n")
_LETTER = _UPPER | _bytes("abcdefghijklmnopqrstuvwxyz")
_LETTER[128:] = True


def _share_distinct(doc: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """The share of distinct keys of each document; 1 where it has none. A slice has fewer than 2^16 documents."""
    held = np.sort((doc.astype(np.uint64) << np.uint64(48)) | (key >> np.uint64(16)))
    new = np.ones(len(held), bool)
    new[1:] = held[1:] != held[:-1]
    count = np.bincount(doc, minlength=n)
    return np.where(count, np.bincount((held[new] >> np.uint64(48)).astype(np.int64), minlength=n) / np.maximum(count, 1), 1.0)


def matrix(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The features of each text, a row each. Shares and means, so that long and short texts compare."""
    n = len(offs) - 1
    out = np.zeros((n, FEATURES))
    start, end, doc = words(buf, offs, ~SPACE[buf])
    count = np.bincount(doc, minlength=n)
    out[count == 0, 0] = 1
    if not len(start):
        return out
    some = np.maximum(count, 1)
    h, size = word_hash(buf, start, end), end - start

    def sums(of: np.ndarray) -> np.ndarray:
        out = np.zeros(len(buf) + 1, np.int32)
        np.cumsum(of[buf], out=out[1:], dtype=np.int32)
        return out

    def a_word(x: np.ndarray, of: np.ndarray = doc) -> np.ndarray:
        return np.bincount(of, x, minlength=n) / some

    def in_text(of: np.ndarray) -> np.ndarray:
        return held[:, of].sum(axis=1) / some

    held = np.bincount(np.repeat(np.arange(n) << 8, np.diff(offs)) + buf, minlength=n << 8).reshape(n, 256)  # bytes of each text
    first = np.cumsum(count) - count
    piece = (np.arange(len(doc)) - first[doc]) // _PIECE
    upper, letters = sums(_UPPER), sums(_LETTER)
    same = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    line = sums(_LINE)[start]
    new = np.ones(len(doc), bool)
    new[1:] = (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    in_line = np.arange(len(doc)) - np.repeat(begin, np.diff(np.append(begin, len(doc))))
    lines = np.add.reduceat(mix(h + in_line.astype(np.uint64)), begin)
    line_doc, last = doc[begin], np.append(begin[1:], len(doc)) - 1
    n_lines = np.maximum(np.bincount(line_doc, minlength=n), 1)
    four, four_hash = runs_of_words(doc, h, n, 4)

    shapes = [
        np.log1p(count), a_word(size), a_word(same, doc[1:]), _share_distinct(doc, mix(h + piece.astype(np.uint64)), n),
        a_word((upper[end] - upper[start] == size) & (size > 1)), in_text(_BANG), in_text(_SYMBOL), in_text(_BAR),
        _share_distinct(four, four_hash, n), np.bincount(line_doc, _END[buf[end[last] - 1]], minlength=n) / n_lines, np.log1p(count / n_lines),
        a_word(_UPPER[buf[start]]), a_word(letters[end] - letters[start] == size), in_text(_DIGIT), a_word(size <= 3),
        _share_distinct(line_doc, lines, n), in_text(_COMMA), np.bincount(doc, size > 40, minlength=n) > 0,
    ]
    for i, x in enumerate(shapes, 1):
        out[:, i] = np.where(count, x, 0)
    bins = np.bincount(doc * BINS + (h >> np.uint64(56)).astype(np.int64), minlength=n * BINS).reshape(n, BINS)
    out[:, SHAPES:] = bins / some[:, None]
    return out


def features(text: str) -> np.ndarray:
    buf = np.frombuffer(text.encode(), np.uint8)
    return matrix(buf, np.array([0, len(buf)]))[0]


def held_out(doc_id: int) -> bool:
    return crc32(str(doc_id).encode()) % 5 == 0


def scaled(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """A feature's logarithm of odds grows less than linearly: clip to keep single features from deciding."""
    return np.clip((x - mean) / scale, -5, 5)


def preferences(y: np.ndarray, pairs: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows labelled 1 and the rows labelled 0 that they are preferred to."""
    rng = np.random.Generator(np.random.PCG64(seed))
    return rng.choice(np.flatnonzero(y == 1), pairs), rng.choice(np.flatnonzero(y == 0), pairs)


def fit_pairs(z: np.ndarray, good: np.ndarray, bad: np.ndarray, ridge: float, steps: int = 30) -> np.ndarray:
    """Weights of least logistic loss over the pairs, plus ridge; by Newton's method, each step by conjugate gradients."""
    n, m = len(z), len(good)
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        strength = z @ w
        p = 1 / (1 + np.exp(-np.clip(strength[good] - strength[bad], -30, 30)))
        slope = np.bincount(good, p - 1, n) - np.bincount(bad, p - 1, n)
        grad = z.T @ slope / m + ridge * w
        curve = p * (1 - p)

        def bent(v: np.ndarray, curve: np.ndarray = curve) -> np.ndarray:
            t = z @ v
            t = curve * (t[good] - t[bad])
            return z.T @ (np.bincount(good, t, n) - np.bincount(bad, t, n)) / m + ridge * v

        step, rest = np.zeros_like(w), grad.copy()
        along, size = rest.copy(), rest @ rest
        for _ in range(40):
            if size <= 1e-6 * (grad @ grad):
                break
            turned = bent(along)
            far = size / (along @ turned)
            step += far * along
            rest -= far * turned
            was, size = size, rest @ rest
            along = rest + size / was * along
        w -= step
        if np.abs(step).max() < 1e-5:
            break
    return w


def learn(x: np.ndarray, y: np.ndarray, *, pairs: int, seed: int = 1, ridge: float = 1e-3):
    """mean, scale, weights, threshold of the strength and steepness of the score."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    # Hash classes share a scale: rare ones aren't blown up.
    scale[SHAPES:] = 3 * np.sqrt((scale[SHAPES:] ** 2).mean()) if len(scale) > SHAPES else 1
    scale[scale < 1e-9] = 1.0
    z = scaled(x, mean, scale)
    w = fit_pairs(z, *preferences(y, pairs, seed), ridge)
    cut = float(np.quantile((z * w).sum(axis=1), (y == 0).mean()))
    return mean, scale, w, cut


def score(x: np.ndarray, model) -> np.ndarray:
    mean, scale, w, cut = model
    strength = (scaled(x, mean, scale) * w).sum(axis=1) - cut  # row by row, so that a score doesn't hang on the rows beside it
    return 1 / (1 + np.exp(-np.clip(strength + np.log(THRESHOLD / (1 - THRESHOLD)), -30, 30)))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, buf, offs in chunks(batches, "text"):
        x = matrix(buf, offs).astype(np.float32)
        yield pa.record_batch({"label": rows.column("label").cast(pa.int64()), "x": pa.array([r.tobytes() for r in x], pa.binary())})


def _scores(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for rows, buf, offs in chunks(batches, "text"):
        ids = rows.column("doc_id").to_pylist()
        got = score(matrix(buf, offs), model.value) if model.value is not None else np.full(len(ids), 0.5)
        yield pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "held_out": pa.array([held_out(i) for i in ids], pa.bool_()), "score": pa.array(got), "predicted": pa.array((got >= THRESHOLD).astype(np.int32))})


def fit(docs: DataFrame, labels: DataFrame, *, rows: int = 8000, pairs: int = 100_000):
    """The model, or None without labels of both kinds."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("label"))
    known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    got = known.join(docs, "doc_id").select("label", "text").mapInArrow(_features, "label long, x binary").collect()  # at most ``rows``
    got.sort(key=lambda r: (r["label"], bytes(r["x"])))  # rows come in any order
    y = np.array([r["label"] for r in got])
    if len(set(y.tolist())) < 2:
        return None
    return learn(np.array([np.frombuffer(r["x"], np.float32) for r in got]).astype(np.float64), y, pairs=pairs)


def quality(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each document."""
    docs = one_per_id(docs, "doc_id", "text").select("doc_id", F.col("text").cast("binary").alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **how))
    return docs.mapInArrow(lambda b: _scores(b, model), "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The documents, all columns, that are predicted to be good."""
    good = quality(docs, labels, **how).where("predicted = 1").select(F.col("doc_id").alias("_good"))
    return docs.join(good, docs["doc_id"] == good["_good"], "left_semi")
