"""Suffix-array dedup: bytes covered by a string of ``length`` bytes that also starts earlier are removed.

Only suffixes that can match are sorted. Each window of ``length`` bytes picks an anchor, its ``GRAM`` bytes of least
hash (the leftmost of equals): equal windows pick the same one, and neighbouring windows mostly share theirs, so a text
has about one anchor in 33 bytes. The windows that share an anchor are a *span*.

1. Each task sorts the spans of its texts that share an anchor. Of equal spans the earliest stays and the others are
   removed; so a passage that is everywhere leaves a task once.
2. The anchors that are left are dealt out by hash; one that occurs again anywhere makes its spans candidates. Anchors
   that a task has several times are known to, and deal out one row; so no hot anchor gathers more rows than tasks.
3. The candidates' bytes are fetched and dealt out by anchor, and all their windows are sorted as suffixes: shallow by
   multikey quicksort, deep by blind tries (``deep_shallow``). Suffixes with a common prefix of ``length`` bytes are
   equal windows, and all but the earliest are removed. An anchor of more than ``HEAVY`` spans, as at the edge of a
   frequent passage, is taken apart: its windows are sorted within each task first, and then dealt out by their own hash.

Texts longer than ``PIECE`` bytes are cut into overlapping pieces, which changes nothing. Defined results: null and
empty texts have no bytes; a repeated id counts once and rows without id take no part (``one_per_id``); an empty table
gives an empty result. Other columns aren't read. Positions and order are by (doc_id, byte).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, mix, one_per_id, packed, prefix_hash, powers, save, unpacker, work
from .deep_shallow import suffix_order

GRAM = 36
BITS = 24  #: of a position within a piece
PIECE = 1 << 23
HOLD = 1 << 25  #: bytes of text whose spans are sorted together
HEAVY = 2000
REMOVED, KNOWN, SINGLE = 0, 1, 2

ROWS = "kind int, h long, doc_id long, low long, high long"


def anchors(buf: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """hash, document, low, high of each span: its windows start at the bytes low to high of ``buf``."""
    n = len(buf)
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    sums = prefix_hash(buf, False)
    h = mix((sums[GRAM:] - sums[:-GRAM]) * powers(n + 1)[1][: n - GRAM + 1])
    place = np.uint64((1 << BITS) - 1)
    least = (h & ~place) | np.arange(len(h), dtype=np.uint64)
    width, have = length - GRAM + 1, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    pick = (least & place).astype(np.int64)
    end = offs[1:] - length  # the last window of each document
    start = np.arange(len(pick))
    doc = np.searchsorted(offs, start, "right") - 1
    whole = start <= end[np.minimum(doc, len(end) - 1)]
    start, doc, pick = start[whole], doc[whole], pick[whole]
    if not len(start):
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    new = np.ones(len(start), bool)
    new[1:] = (pick[1:] != pick[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return h[pick[first]], doc[first], start[first], start[last]


def earliest(number: np.ndarray, order: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each suffix is the earliest of those with its number; number goes by place in the order."""
    by = np.lexsort((at[order], doc[order], number))
    first = np.ones(len(by), bool)
    first[1:] = number[by][1:] != number[by][:-1]
    out = np.zeros(len(order), bool)
    out[order[by]] = first
    return out


def _merge_spans(buf: np.ndarray, h: np.ndarray, doc: np.ndarray, low: np.ndarray, high: np.ndarray, base: np.ndarray, length: int):
    """For each span, whether an earlier one among these equals it: its first and its last window are the same suffixes."""
    group = _groups(h, high - low)
    n = len(h)
    order, number = suffix_order(buf, np.concatenate([low, high]), np.concatenate([group, group + n]), length)
    by_place = np.empty(2 * n, np.int64)
    by_place[order] = number
    span = _groups(by_place[:n], by_place[n:])
    return ~earliest(np.sort(span), np.argsort(span, kind="stable"), doc, low - base)


def _groups(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    order = np.lexsort((b, a))
    new = np.zeros(len(a), np.int64)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    out = np.empty(len(a), np.int64)
    out[order] = np.cumsum(new)
    return out


def _pieces(batches: Iterator[pa.RecordBatch], length: int):
    """doc ids, where in its document each piece begins, bytes, offsets."""
    for rows, buf, offs in chunks(batches, "text"):
        ids = rows.column("doc_id").to_numpy()
        if len(buf) <= PIECE:
            yield ids, np.zeros(len(ids), np.int64), buf, offs
            continue
        for i, id_ in enumerate(ids):  # chunks leaves a long text alone, or with few others
            for at in range(int(offs[i]), max(int(offs[i]) + 1, int(offs[i + 1]) - length + 1), PIECE):
                part = buf[at : min(int(offs[i + 1]), at + PIECE + length - 1)]
                yield np.array([id_]), np.array([at - int(offs[i])]), part, np.array([0, len(part)])


def _first_pass(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for ids, begin, buf, offs in _pieces(batches, length):
        h, doc, low, high = anchors(buf, offs, length)
        held.append((buf, h, ids[doc], low + size, high + size, size + offs[doc] - begin[doc]))
        size += len(buf)
        if size > HOLD:
            yield _task_rows(held, length)
            held, size = [], 0
    if held:
        yield _task_rows(held, length)


def _task_rows(held: list[tuple], length: int) -> pa.RecordBatch:
    buf, h, doc, low, high, base = (np.concatenate(x) for x in zip(*held, strict=True))
    by = np.argsort(h, kind="stable")
    h, doc, low, high, base = h[by], doc[by], low[by], high[by], base[by]
    kind = np.full(len(h), SINGLE, np.int32)
    twice = _shared(h)
    if len(on := np.flatnonzero(twice)):
        kind[on[_merge_spans(buf, h[on], doc[on], low[on], high[on], base[on], length)]] = REMOVED
    left = np.flatnonzero(kind == SINGLE)  # of an anchor with several spans left, one row is dealt out, marked by -1
    again = np.flatnonzero(_shared(h[left]))
    kind[left[again]] = KNOWN
    gone = np.flatnonzero(kind == REMOVED)
    r_doc, r_low, r_high = _joined(doc[gone], (low - base)[gone], (high - base)[gone])
    stay = np.flatnonzero(kind != REMOVED)
    head = left[again][np.concatenate([[True], h[left[again]][1:] != h[left[again]][:-1]])] if len(again) else left[:0]
    more = {"kind": np.full(len(head), SINGLE, np.int32), "h": h[head].view(np.int64), "doc_id": doc[head], "low": np.full(len(head), -1), "high": np.full(len(head), -1)}
    rows = {"kind": kind[stay], "h": h[stay].view(np.int64), "doc_id": doc[stay], "low": (low - base)[stay], "high": (high - base)[stay]}
    late = {"kind": np.full(len(r_doc), REMOVED, np.int32), "h": np.zeros(len(r_doc), np.int64), "doc_id": r_doc, "low": r_low, "high": r_high}
    return pa.record_batch({c: pa.array(np.concatenate([rows[c], more[c], late[c]])) for c in rows})


def _joined(doc: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of window starts, joined where one begins right after another."""
    by = np.lexsort((low, doc))
    doc, low, high = doc[by], low[by], high[by]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (low[1:] > high[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1 if len(doc) else first
    return doc[first], low[first], high[last]


def _shared(h: np.ndarray) -> np.ndarray:
    out = np.zeros(len(h), bool)
    out[1:] = h[1:] == h[:-1]
    out[:-1] |= out[1:]
    return out


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (kind, h): the single ones only where their anchor occurs again. Marks (low -1) go. Holds one row
    between batches."""
    names, held, last = ["kind", "h", "doc_id", "low", "high"], None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        col = {c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in names}
        if held is not None:
            col = {c: np.concatenate([[held[c]], col[c]]).astype(col[c].dtype) for c in names}
        single = col["kind"] == SINGLE
        same = np.concatenate([[False], (col["h"][1:] == col["h"][:-1]) & single[1:] & single[:-1]])
        if held is None and last is not None and single[0] and col["h"][0] == last:
            same[0] = True
        twice = same.copy()
        twice[:-1] |= same[1:]
        mark = col["low"] < 0
        # A mark stands for an anchor that has other spans: what follows or precedes it is shared as any other.
        out = (~single | twice) & ~mark
        last = col["h"][-1] if single[-1] else None
        held = {c: col[c][-1] for c in names} if single[-1] and not twice[-1] else None
        yield pa.record_batch({c: pa.array(x[out]) for c, x in col.items()})


BYTES = "kind int, key long, doc_id long, low long, high long, bytes binary"


def _fetch(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, spans) to the spans' bytes; the windows of heavy anchors are sorted here and go one by one."""
    unpack = unpacker()
    held: list[tuple] = []
    size = 0
    for batch in batches:
        spans = batch.column("spans")
        offs, flat = spans.offsets.to_numpy(), spans.flatten()
        offs = offs - offs[0]
        h, low, high, heavy = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("h", "low", "high", "heavy"))
        ids, texts = batch.column("doc_id").to_numpy(), batch.column("text")
        cut, at, bytes_ = [], [], 0
        for i, id_ in enumerate(ids):
            text = unpack(texts[i].as_py())
            mine = np.arange(offs[i], offs[i + 1])
            for part in np.array_split(mine, len(mine) // (1 << 14) + 1):
                for x, a, b, many in zip(part.tolist(), low[part].tolist(), high[part].tolist(), heavy[part].tolist(), strict=True):
                    if many:
                        held.append((text[a : b + length], h[x], id_, a))
                        size += b + length - a
                    else:
                        cut.append(text[a : b + length])
                        at.append(x)
                        bytes_ += b + length - a
                if bytes_ > 1 << 22:
                    yield _rows(KNOWN, h[at], ids[np.searchsorted(offs, at, "right") - 1], low[at], high[at], cut)
                    cut, at, bytes_ = [], [], 0
                if size > HOLD // 32:
                    yield from _windows(held, length)
                    held, size = [], 0
        if cut:
            yield _rows(KNOWN, h[at], ids[np.searchsorted(offs, at, "right") - 1], low[at], high[at], cut)
    if held:
        yield from _windows(held, length)


def _rows(kind: int, key: np.ndarray, doc: np.ndarray, low: np.ndarray, high: np.ndarray, cut: list) -> pa.RecordBatch:
    return pa.record_batch({"kind": pa.array(np.full(len(key), kind, np.int32)), "key": pa.array(key), "doc_id": pa.array(doc), "low": pa.array(low), "high": pa.array(high), "bytes": pa.array(cut, pa.binary())})


def _all_windows(buf: np.ndarray, size: np.ndarray, key: np.ndarray, doc: np.ndarray, low: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """key, doc, place in the document, place in the buffer of all windows of the spans, which lie one after another."""
    count = size - length + 1
    of = np.repeat(np.arange(len(size)), count)
    inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return key[of], doc[of], low[of] + inner, (np.cumsum(size) - size)[of] + inner


def _removed(doc: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Window starts as runs."""
    doc, low, high = _joined(doc, at, at)
    return _rows(REMOVED, np.zeros(len(doc), np.int64), doc, low, high, [b""] * len(doc))


def _windows(held: list[tuple], length: int) -> Iterator[pa.RecordBatch]:
    """Of equal windows the earliest, with its bytes and keyed by their hash; the others as removed."""
    buf = np.frombuffer(b"".join(x[0] for x in held), np.uint8)
    size = np.array([len(x[0]) for x in held])
    key, doc, low = (np.array([x[i] for x in held], np.int64) for i in (1, 2, 3))
    key, doc, at, place = _all_windows(buf, size, key, doc, low, length)
    order, number = suffix_order(buf, place, key, length)
    first = earliest(number, order, doc, at)
    yield _removed(doc[~first], at[~first])
    sums = prefix_hash(buf, False)
    data = buf.tobytes()
    on = np.flatnonzero(first)
    h = mix((sums[place[on] + length] - sums[place[on]]) * powers(len(buf) + 1)[1][place[on]]).view(np.int64)
    for i in range(0, len(on), 1 << 14):
        part = on[i : i + (1 << 14)]
        yield _rows(SINGLE, h[i : i + (1 << 14)], doc[part], at[part], at[part], [data[x : x + length] for x in place[part]])


def _sort_suffixes(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (kind, key): all windows that an earlier one with the same key equals, as removed runs."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        gone, live = int(np.searchsorted(kind, REMOVED, "right")), batch.num_rows
        if gone:
            yield batch.slice(0, gone).select(["doc_id", "low", "high"])
        if gone < live:
            held.append(batch.slice(gone))
            size += held[-1].nbytes
        if size > HOLD // 16:  # the arrays of a span's windows take some 35 times its bytes
            rows = _whole(held)
            group = _keys(rows)
            last = int(np.searchsorted(group, group[-1]))  # its other rows may follow
            if last:
                yield _sorted(rows.slice(0, last), group[:last], length)
            held = [rows.slice(last)]
            size = held[0].nbytes
    if held:
        rows = _whole(held)
        yield _sorted(rows, _keys(rows), length)


def _whole(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _keys(rows: pa.RecordBatch) -> np.ndarray:
    """Numbers that rise with kind and key."""
    kind, key = rows.column("kind").to_numpy(), rows.column("key").to_numpy()
    new = np.zeros(len(key), np.int64)
    new[1:] = (kind[1:] != kind[:-1]) | (key[1:] != key[:-1])
    return np.cumsum(new)


def _sorted(rows: pa.RecordBatch, group: np.ndarray, length: int) -> pa.RecordBatch:
    data = rows.column("bytes")
    offs = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
    buf = np.frombuffer(data.buffers()[2], np.uint8)[offs[0] : offs[-1]]
    group, doc, at, place = _all_windows(buf, np.diff(offs), group, rows.column("doc_id").to_numpy(), rows.column("low").to_numpy(), length)
    order, number = suffix_order(buf, place, group, length)
    late = ~earliest(number, order, doc, at)
    return _removed(doc[late], at[late]).select(["doc_id", "low", "high"])


def repeats(docs: DataFrame, at: str, length: int) -> DataFrame:
    """doc_id, low, high: bytes low to high + length - 1 are covered by strings that also start earlier. ``docs``: doc_id
    and text, as bytes."""
    found = docs.mapInArrow(lambda b: _first_pass(b, length), ROWS)
    deal = F.when(F.col("kind") == SINGLE, F.col("h")).otherwise(F.xxhash64("doc_id", "low"))
    found = found.repartition(deal).sortWithinPartitions("kind", "h").mapInArrow(_candidates, ROWS)
    found = save(found, at, "spans")
    spans = found.where(F.col("kind") != REMOVED).select("h", "doc_id", "low", "high")
    heavy = spans.groupBy("h").count().where(F.col("count") > HEAVY).select("h", F.lit(True).alias("heavy"))
    spans = spans.join(heavy, "h", "left").withColumn("heavy", F.coalesce("heavy", F.lit(False)))
    per_doc = spans.groupBy("doc_id").agg(F.collect_list(F.struct("h", "low", "high", "heavy")).alias("spans"))
    texts = docs.mapInArrow(packed, docs.schema)
    cut = texts.join(per_doc, "doc_id").mapInArrow(lambda b: _fetch(b, length), BYTES)
    late = cut.repartition(F.when(F.col("kind") == REMOVED, F.xxhash64("doc_id", "low")).otherwise(F.col("key"))).sortWithinPartitions("kind", "key")
    late = save(late.mapInArrow(lambda b: _sort_suffixes(b, length), "doc_id long, low long, high long"), at, "late")
    return found.where(F.col("kind") == REMOVED).select("doc_id", "low", "high").unionByName(late)


def _keep(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    unpack = unpacker()
    for batch in batches:
        out = {"doc_id": [], "kept": [], "n_bytes": [], "spans": []}
        for id_, text, late in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "late")), strict=True):
            text = unpack(text)
            spans: list[list[int]] = []
            for low, high in sorted((x["low"], x["high"] + length) for x in late or ()):
                if spans and low <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], high)
                else:
                    spans.append([low, high])
            edges = [0, *(x for s in spans for x in s), len(text)]
            out["doc_id"].append(id_)
            out["kept"].append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            out["n_bytes"].append(len(text))
            out["spans"].append([{"start": a, "end": b} for a, b in spans])
        yield pa.record_batch([pa.array(out["doc_id"], pa.int64()), pa.array(out["kept"], pa.binary()), pa.array(out["n_bytes"], pa.int64()), pa.array(out["spans"], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["doc_id", "kept", "n_bytes", "spans"])


def suffix_dedup(docs: DataFrame, *, length: int = 100) -> DataFrame:
    """doc_id, kept (the remaining bytes), n_bytes, spans (removed runs: start, end)."""
    if length < GRAM + 1:
        raise ValueError(f"length must be over {GRAM}")
    at = work(docs.sparkSession)
    docs = one_per_id(docs, "doc_id", "text").select("doc_id", F.col("text").cast("binary").alias("text"))
    late = repeats(docs, at, length).groupBy("doc_id").agg(F.collect_list(F.struct("low", "high")).alias("late"))
    whole = docs.mapInArrow(packed, docs.schema).join(late, "doc_id", "left")
    return whole.mapInArrow(lambda b: _keep(b, length), "doc_id long, kept binary, n_bytes long, spans array<struct<start: long, end: long>>")
