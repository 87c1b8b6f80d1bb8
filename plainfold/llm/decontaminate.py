"""Benchmark decontamination by template canonicalisation.

A text's tokens are its runs of letters and digits (a point or comma between digits belongs to the number). Numbers,
names (capitalised) and units (a fixed list, after a number) become typed slots, everything else its lower-case self. The
first word of a sentence may be a name or not, so texts are read both ways; and once more with numbers written as words
and units told by their place: the word after a number, there and wherever it stands again in the paragraph. Templates are windows of ``window`` canonical
tokens; an item of fewer tokens is one window. Windows with fewer than ``literal`` tokens that aren't slots say too little
and count only where all their tokens are equal; where these are, any window counts, whatever types its tokens have.

Windows of the benchmark, by hash, are joined with those of all documents. Where windows of an item meet a document on one
diagonal (the same distance between their places), the slots are compared: equal slot values of the item must stand
against equal values in the document and different ones against different ones. Where that fails, the diagonal is cut
into its longest runs of a window or more in which it holds. Names that follow one another are one slot, so a name may be
replaced by one of more words. Words put in or left out move the rest to another diagonal: runs on diagonals that are no
further from the next than half of the item, or a window, count together.

A document is contaminated by an item where such runs cover ``share`` of the item's tokens or more, or one run ``least``
tokens. Only where two values have changed places with each other, and not throughout, it is another question: then the
share doesn't count.

The benchmark is held against all documents in blocks of at most ``block`` items and ``block_bytes`` bytes of text (a longer
item is a block of its own), so what is broadcast is bounded. Where there are several blocks, documents are first passed
through a bit table of fixed size of all their windows, and only those that may hold one are gone through again; a bit set
by chance lets a document through and loses none. Defined results: null and empty texts have no windows and match nothing; rows without id take no part and
repeated ids count once (``one_per_id``); empty tables give an empty result. Other columns aren't read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, mix, one_per_id, save, word_hash, words, work

# Units of measure and currency, as they follow a number.
UNITS = """mm cm m km in ft yd mi inch inches foot feet yard yards mile miles metre metres meter meters kilometre kilometres
kilometer kilometers centimetre centimetres centimeter centimeters mg g kg t lb lbs oz gram grams kilogram kilograms ton tons
pound pounds ounce ounces ml l litre litres liter liters gallon gallons cup cups s sec second seconds min minute minutes h hr
hrs hour hours day days week weeks month months year years usd eur gbp dollar dollars euro euros cent cents percent kmh mph kb
mb gb tb hz khz mhz ghz w kw v a c f k degree degrees""".split()

CORE = np.zeros(256, bool)
CORE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
DIGIT = np.zeros(256, bool)
DIGIT[0x30:0x3A] = True
PAUSE = np.zeros(256, bool)
PAUSE[[ord(c) for c in ",()[]{}/"]] = True
UPPER = np.zeros(256, bool)
UPPER[0x41:0x5B] = True
STOP = np.zeros(256, bool)
STOP[[ord(c) for c in ".!?:;\n\r\"|"]] = True
# Numbers written as words.
SPELLED_OUT = """zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen
eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen""".split()
NUMBER, NAME, UNIT, SPELLED = 1, 2, 3, 4
READINGS = 4
_SLOT = mix(np.arange(4, dtype=np.uint64) + np.uint64(0xABCDEF))
_SLOT = np.append(_SLOT, _SLOT[NUMBER])  # a number is one, however it's written
_LISTS: dict[str, np.ndarray] = {}
BITS = 1 << 26  #: of the table of all windows


def _among(word: np.ndarray, names: list[str]) -> np.ndarray:
    """Whether each hash is that of a word of the list."""
    if names[0] not in _LISTS:
        joined = np.frombuffer(" ".join(names).encode(), np.uint8)
        a, b, _ = words(joined, np.array([0, len(joined)]), CORE[joined])
        _LISTS[names[0]] = np.sort(word_hash(joined, a, b))
    known = _LISTS[names[0]]
    return known[np.minimum(np.searchsorted(known, word), len(known) - 1)] == word


class Tokens(NamedTuple):
    doc: np.ndarray
    word: np.ndarray  #: hash
    kind: np.ndarray  #: slot type, 0: none
    wide: np.ndarray  #: type if the names at the starts of sentences count
    full: np.ndarray  #: type if numbers written as words and units by their place count too
    close: np.ndarray  #: whether it follows the token before without a pause


def tokens(buf: np.ndarray, offs: np.ndarray) -> Tokens:
    core, digit = CORE[buf], DIGIT[buf]
    if len(buf) > 2:
        point = (buf[1:-1] == 0x2E) | (buf[1:-1] == 0x2C)
        core[1:-1] |= point & digit[:-2] & digit[2:]
    start, end, doc = words(buf, offs, core)
    word = word_hash(buf, start, end)
    kind = wide = full = np.zeros(len(start), np.int8)
    close = np.zeros(len(start), bool)
    if len(start):
        kind[digit[start]] = NUMBER
        after = np.zeros(len(start), bool)  # a number before it, in the same document
        after[1:] = (kind[:-1] == NUMBER) & (doc[1:] == doc[:-1])
        kind[after & (kind == 0) & _among(word, UNITS)] = UNIT
        stops = np.concatenate([[0], np.cumsum(STOP[buf])])
        inside = np.zeros(len(start), bool)
        inside[1:] = (doc[1:] == doc[:-1]) & (stops[start[1:]] == stops[end[:-1]])
        shouted = np.zeros(len(start), bool)  # in capitals throughout: says nothing
        long = end - start > 1
        shouted[long] = UPPER[buf[start[long] + 1]]
        named = UPPER[buf[start]] & ~shouted & (kind == 0)
        wide = np.where(named, np.int8(NAME), kind)
        kind[named & inside] = NAME
        pauses = np.concatenate([[0], np.cumsum(PAUSE[buf])])
        close[1:] = inside[1:] & (pauses[start[1:]] == pauses[end[:-1]])
        full = wide.copy()
        full[(kind == 0) & _among(word, SPELLED_OUT)] = SPELLED
        number = (full == NUMBER) | (full == SPELLED)
        by_place = np.zeros(len(start), bool)
        by_place[1:] = number[:-1] & close[1:] & (full[1:] == 0)
        lines = np.concatenate([[0], np.cumsum(buf == 0x0A)])[start]
        here = mix(word ^ mix((doc.astype(np.uint64) << np.uint64(32)) + lines.astype(np.uint64)))  # a word of a paragraph
        units = np.unique(here[by_place & (end - start > 3)])
        if len(units):
            by_place |= (units[np.minimum(np.searchsorted(units, here), len(units) - 1)] == here) & (full == 0)
        full[by_place] = UNIT
    return Tokens(doc, word, kind, wide, full, close)


class Reading(NamedTuple):
    """A way to read the tokens of texts."""

    at: np.ndarray  #: the first token of each place, and the end
    doc: np.ndarray
    code: np.ndarray  #: what windows hash
    slot: np.ndarray  #: whether a place is a slot


def readings(t: Tokens) -> list[Reading]:
    """The words themselves; with slots; with capitalised words at the starts of sentences as names too; with numbers
    written as words and units by their place. Names that follow one another are one slot, and so are such numbers."""
    n = len(t.doc)
    out = [Reading(np.arange(n + 1), t.doc, t.word, np.zeros(n, bool))]
    for k in (t.kind, t.wide, t.full):
        head = np.ones(n, bool)
        head[1:] = ~(t.close[1:] & (k[1:] == k[:-1]) & ((k[1:] == NAME) | (k[1:] == SPELLED)))
        at = np.flatnonzero(head)
        out.append(Reading(np.append(at, n), t.doc[at], np.where(k[at] > 0, _SLOT[k[at]], t.word[at]), k[at] > 0))
    return out


def windows(r: int, read: Reading, size: int, literal: int) -> tuple[np.ndarray, np.ndarray]:
    """First place and hash of each window that has enough literal tokens; all are, where the words are read."""
    n = len(read.doc) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    mult = np.uint64(0xD6E8FEB86659FD93)
    code = np.zeros(n, np.uint64)
    for j in range(size):
        code = code * mult + read.code[j : j + n]
    slots = np.concatenate([[0], np.cumsum(read.slot)])
    enough = size - (slots[size:] - slots[:-size]) >= min(literal, size)
    whole = np.flatnonzero((read.doc[:n] == read.doc[size - 1 :]) & enough)
    return whole, mix(code[whole] + np.uint64(size + (r << 32)))


def runs(pairs: list[tuple[bytes, bytes] | None]) -> list[tuple[int, int]]:
    """The longest stretches, as begin and end, in which the pairs of slot values stand one to one; None: no slot."""
    there, back, n, out, a = {}, {}, Counter(), [], 0
    for b, pair in enumerate(pairs):
        if pair is None:
            continue
        x, y = pair
        if there.get(x, y) != y or back.get(y, x) != x:
            out.append((a, b))
            while there.get(x, y) != y or back.get(y, x) != x:
                if old := pairs[a]:
                    n[old] -= 1
                    if not n[old]:
                        del there[old[0]], back[old[1]]
                a += 1
        there[x], back[y] = y, x
        n[pair] += 1
    return [*out, (a, len(pairs))]


class Benchmark:
    """Windows of a block of items: sorted hashes, and for each its item and place; the items' tokens."""

    def __init__(self, rows: list[tuple[int, bytes]], size: int, literal: int):
        self.size, self.literal = size, literal
        self.items: dict[int, tuple[np.ndarray, np.ndarray, list[Reading]]] = {}
        hashes, items, places = [], [], []
        self.sizes: list[set[int]] = [set() for _ in range(READINGS)]
        for item, text in rows:
            buf = np.frombuffer(text, np.uint8)
            seen = tokens(buf, np.array([0, len(buf)]))
            self.items[item] = seen.word, seen.full, readings(seen)
            for r, read in enumerate(self.items[item][2]):
                n = min(size, len(read.doc))
                if n:
                    at, h = windows(r, read, n, literal)
                    hashes.append(h)
                    items += [item] * len(h)
                    places += at.tolist()
                    self.sizes[r].add(n)
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hash, self.item, self.place = h[order], np.array(items, np.int64)[order], np.array(places, np.int64)[order]
        self.low = np.uint64((1 << min(22, (16 * len(h)).bit_length())) - 1)
        self.seen = np.zeros(int(self.low) + 1, bool)  # by their low bits: most windows of documents are none of these
        self.seen[h & self.low] = True


def paths(units: dict[tuple[int, int], tuple[int, int]]) -> Iterator[list[tuple[int, int, int, int]]]:
    """Units (begin in the item and in the text, end in both) that follow one another without a gap in either."""
    ends, done = set(units.values()), set()
    for first in sorted(units):
        if first in ends or first in done:
            continue
        path, at = [], first
        while at in units and at not in done:
            done.add(at)
            path.append((*at, *units[at]))
            at = units[at]
        yield path


def together(found: list[tuple], reach: int) -> list[list[tuple]]:
    """Runs, parted where neighbouring diagonals are more than ``reach`` apart."""
    groups: list[list[tuple]] = []
    for run in sorted(found, key=lambda x: x[:3]):
        if not groups or run[0] - groups[-1][-1][0] > reach:
            groups.append([])
        groups[-1].append(run)
    return groups


def exchanged(pairs: set[tuple[bytes, bytes]]) -> bool:
    """Whether two values have changed places with each other, but not throughout: that is another question."""
    one_to_one = len({x for x, _ in pairs}) == len(pairs) == len({y for _, y in pairs})
    return not one_to_one and any(x != y and (y, x) in pairs for x, y in pairs)


def judged(item: tuple, word: np.ndarray, kind: np.ndarray, reads: list[Reading], diagonals: dict[tuple[int, int], set[int]], size: int, share: float, least: int) -> tuple[int, bool] | None:
    """Tokens of the item covered and whether a slot was replaced, or None where the text doesn't hold it. ``diagonals``: by
    reading and distance, the places of the item at which windows meet."""
    i_word, i_kind, i_reads = item
    units: dict[tuple[int, int], tuple[int, int]] = {}
    for (r, shift), places in diagonals.items():
        covered = np.zeros(len(i_reads[r].doc), bool)
        for p in places:
            covered[p : p + min(size, len(covered))] = True
        on = np.flatnonzero(covered)
        here, there = i_reads[r].at, reads[r].at
        for a, c, b, e in zip(here[on].tolist(), there[on + shift].tolist(), here[on + 1].tolist(), there[on + shift + 1].tolist(), strict=True):
            if e - c > b - a:  # a name before or behind the whole item isn't its own
                if a == 0 and (word[e - b : e] == i_word[:b]).all():
                    c = e - b
                elif b == len(i_word) and (word[c : c + b - a] == i_word[a:]).all():
                    e = c + b - a
            units[a, c] = max(units.get((a, c), (b, e)), (b, e))
    found = []  # diagonal, begin and end in the item, whether a slot was replaced, pairs
    for path in paths(units):
        pairs = [
            (i_word[a:b].tobytes(), word[c:e].tobytes()) if b - a > 1 or e - c > 1 or i_kind[a] or kind[c] else None
            for a, c, b, e in path
        ]
        for x, y in runs(pairs):
            if y - x >= min(size, *(len(read.doc) for read in i_reads)):
                a, c, b = path[x][0], path[x][1], path[y - 1][2]
                found.append((c - a, a, b, {p for p in pairs[x:y] if p}))
    best = None
    for group in together(found, max(size, len(i_word) // 2)):
        covered = np.zeros(len(i_word), bool)
        for _, a, b, _ in group:
            covered[a:b] = True
        pairs = set().union(*(p for *_, p in group))
        n, longest = int(covered.sum()), max(b - a for _, a, b, _ in group)
        if (longest >= least or n >= share * len(i_word) and not exchanged(pairs)) and (best is None or n > best[0]):
            best = n, any(x != y for x, y in pairs)
    return best


def matches(bench: Benchmark, buf: np.ndarray, offs: np.ndarray, share: float, least: int) -> list[tuple[int, int, int, bool]]:
    """document, item, tokens covered, whether a slot was replaced."""
    if not len(bench.hash):
        return []
    seen = tokens(buf, offs)
    word, kind, reads = seen.word, seen.full, readings(seen)
    hits: dict[tuple[int, int], dict[tuple[int, int], set[int]]] = {}
    for r, read in enumerate(reads):
        for size in bench.sizes[r]:
            at, h = windows(r, read, size, bench.literal)
            some = np.flatnonzero(bench.seen[h & bench.low])
            at, h = at[some], h[some]
            low, high = np.searchsorted(bench.hash, h), np.searchsorted(bench.hash, h, "right")
            for i in np.flatnonzero(high > low):
                for j in range(low[i], high[i]):
                    item, place = int(bench.item[j]), int(bench.place[j])
                    if min(bench.size, len(bench.items[item][2][r].doc)) == size:
                        hits.setdefault((int(read.doc[at[i]]), item), {}).setdefault((r, int(at[i]) - place), set()).add(place)
    out = []
    for (d, item), diagonals in hits.items():
        if best := judged(bench.items[item], word, kind, reads, diagonals, bench.size, share, least):
            out.append((d, item, *best))
    return out


FOUND = "doc_id long, item_id long, n_tokens long, replaced boolean"


def _scan(batches: Iterator[pa.RecordBatch], bench, share: float, least: int) -> Iterator[pa.RecordBatch]:
    for rows, buf, offs in chunks(batches, "text"):
        ids = rows.column("doc_id").to_pylist()
        found = matches(bench.value, buf, offs, share, least)
        cols = list(zip(*((ids[d], item, n, r) for d, item, n, r in found), strict=True)) or [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "n_tokens", "replaced"])


def _window_bits(batches: Iterator[pa.RecordBatch], size: int, literal: int) -> Iterator[pa.RecordBatch]:
    """The places in the bit table, and the window's size, of the windows of items."""
    for rows, buf, offs in chunks(batches, "text"):
        for i in range(rows.num_rows):
            part = buf[offs[i] : offs[i + 1]]
            for r, read in enumerate(readings(tokens(part, np.array([0, len(part)])))):
                n = min(size, len(read.doc))
                if n:
                    bit = np.unique(windows(r, read, n, literal)[1] & np.uint64(BITS - 1)).astype(np.int64)
                    yield pa.record_batch({"word": pa.array(bit >> 6), "bit": pa.array(np.int64(1) << (bit & 63)), "size": pa.array(np.full(len(bit), n))})


def _may_hold(batches: Iterator[pa.RecordBatch], table, size: int, literal: int) -> Iterator[pa.RecordBatch]:
    """The documents of which a window has its bit set."""
    words_, sizes = table.value
    for rows, buf, offs in chunks(batches, "text"):
        on = np.zeros(rows.num_rows, bool)
        for r, read in enumerate(readings(tokens(buf, offs))):
            for n in sizes:
                at, h = windows(r, read, n, literal)
                bit = (h & np.uint64(BITS - 1)).astype(np.int64)
                on[read.doc[at[(words_[bit >> 6] >> (bit & 63)) & 1 == 1]]] = True
        yield rows.filter(pa.array(on))


def _blocks(items: DataFrame, block: int, block_bytes: int) -> list[int]:
    """The last id of each block of items, in order. Ids and lengths pass through the driver one by one."""
    out, n, size, last = [], 0, 0, None
    for row in items.select("item_id", F.octet_length("text").alias("size")).orderBy("item_id").toLocalIterator():
        if n and (n == block or size + row["size"] > block_bytes):
            out.append(last)
            n = size = 0
        n, size, last = n + 1, size + row["size"], row["item_id"]
    return [*out, last] if n else out


def contaminated(
    docs: DataFrame, benchmark: DataFrame, *, window: int = 8, literal: int = 4, share: float = 0.5, least: int = 20, block: int = 2000, block_bytes: int = 1 << 23
) -> DataFrame:
    """doc_id, item_id, n_tokens (of the item, covered), replaced (whether a slot differs): a row for each document and
    item that it holds. ``block``, ``block_bytes``: items, and bytes of them, that are broadcast at once."""
    spark = docs.sparkSession
    at = work(spark)
    docs = one_per_id(docs, "doc_id", "text").select("doc_id", F.col("text").cast("binary").alias("text"))
    items = one_per_id(benchmark, "item_id", "text").select("item_id", F.col("text").cast("binary").alias("text")).where("text is not null")
    ends = _blocks(items, block, block_bytes)
    if not ends:
        return spark.createDataFrame([], FOUND)
    if len(ends) > 1:
        bits = items.select("text").mapInArrow(lambda b: _window_bits(b, window, literal), "word long, bit long, size long")
        sizes = [r["size"] for r in bits.select("size").distinct().collect()]  # ``window`` at most
        held = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()  # BITS / 64 rows at most
        words_ = np.zeros(BITS // 64, np.int64)
        words_[held["word"].to_numpy(int)] = held["bits"].to_numpy(np.int64)
        table = spark.sparkContext.broadcast((words_, sizes))
        docs = save(docs.mapInArrow(lambda b: _may_hold(b, table, window, literal), docs.schema), at, "candidates")
    out = []
    for low, high in zip([None, *ends], ends, strict=False):
        part = items.where(F.col("item_id") <= high) if low is None else items.where(F.col("item_id").between(low + 1, high))
        bench = spark.sparkContext.broadcast(Benchmark([(r["item_id"], bytes(r["text"])) for r in part.orderBy("item_id").collect()], window, literal))  # a block
        found = docs.mapInArrow(lambda b, x=bench: _scan(b, x, share, least), FOUND)
        out.append(found if len(ends) == 1 else save(found, at, f"block{len(out)}"))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents, all columns, that hold no item."""
    bad = contaminated(docs, benchmark, **how).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs["doc_id"] == bad["_bad"], "left_anti")


def canonical(text: str) -> list[str]:
    """The canonical tokens, to look at."""
    buf = np.frombuffer(text.encode(), np.uint8)
    kind = tokens(buf, np.array([0, len(buf)])).kind
    found = re.findall(rb"(?:[0-9A-Za-z\x80-\xff]|(?<=[0-9])[.,](?=[0-9]))+", text.encode())
    return [{NUMBER: "<number>", NAME: "<name>", UNIT: "<unit>"}.get(int(k), w.decode().lower()) for k, w in zip(kind, found, strict=True)]
