"""N-gram Jaccard join: size-aware, heavy and light sets treated apart, linked into components.

1. A count-min row (``CELLS`` cells, so of fixed size) over the shingles of all texts orders shingles from rare to
   frequent. Any order gives the same links; this one keeps passages that many documents share out of the prefixes.
2. A text's set becomes its size and the first shingles by that order. Texts of the same words in the same order (by
   128 bits of SHA-256 over the words themselves) are one class, named by the smallest id; from here on only classes are
   joined. Sets under ``smallest`` shingles link only with equal ones and have one list, that of the whole set.
3. Sets of at most ``boundary`` shingles enumerate the 2-subsets of their prefix (two sets that link share two of the
   first |s| - need + 2); larger ones scan the inverted lists of their prefix (they share one of |s| - need + 1). Sets
   just below the boundary also stand in the lists, for partners above it. The boundary is where the subsets enumerated
   begin to cost more than the lists scanned, by the sizes of all sets and the mean list length.
4. A list isn't joined with itself. Each of its sets is compared with the list's hub (smallest id); links that hold are
   merged into components, and only lists that still span several components are gone through again: with other hubs,
   then all pairs of different components. Sets of one component need no comparison, so a group of copies costs as
   many comparisons as it has members. Of other pairs, sizes, places and 512 parity bits a set tell most apart. Lists of frequent shingles are dealt out by salt and their hubs linked by a
   list of hubs.

Comparisons are on the whole texts of both, by 64-bit shingle hashes first; a link is one only if the words themselves
say so. ``percent`` may be 1 to 100. Defined results: null, empty and blank texts have the empty
set and link with nothing; under five words, the whole sequence is the one shingle; a repeated id counts once and rows
without id take no part (``one_per_id``); an empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, mix, one_per_id, packed, save, sequence_digests, shingles, signed, unpacker, work
from .components import components, extended

CELLS = 1 << 18
SALT = 1000  #: sets that a list may have before it is dealt out
LONG = 64  #: members of a list from which its pairs are looked up in the lists that both stand in
LARGEST_SMALL = 200  #: no set above this size is ever small: its subsets would outnumber any list


def _need(size, percent: int):
    """Shingles that a set shares with any partner, at least."""
    return -(-percent * size // 100)


def smallest(percent: int) -> int:
    """The size from which a set can link with another one: with one shingle more, s of s + 1 shared are enough."""
    return 1 << 31 if percent == 100 else -(-percent // (100 - percent))


def _two(percent: int) -> int:
    """The size from which a set shares two shingles with any partner, at least."""
    return 100 // percent + 1


def _sketch(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CELLS, np.int64)
    for _, buf, offs in chunks(batches, "text"):
        total += np.bincount(shingles(buf, offs, k)[1] >> np.uint64(46), minlength=CELLS)
    at = np.flatnonzero(total)
    yield pa.record_batch({"cell": pa.array(at.astype(np.int32)), "n": pa.array(total[at])})


def _sets(batches: Iterator[pa.RecordBatch], counts, k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """doc_id, size, f1, f2, s0 to s7, prefix, salts. The 512 bits of s0 to s7 tell whether an even or odd number of
    shingles fall on each; prefix is long enough for two shared shingles."""
    n = counts.value
    load = int(n.sum()) // CELLS
    for rows, buf, offs in chunks(batches, "text"):
        doc, h = shingles(buf, offs, k)
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
        doc, h = doc[new], h[new]
        size = np.bincount(doc, minlength=rows.num_rows)
        start = np.cumsum(size) - size
        f1, f2 = np.frombuffer(b"".join(sequence_digests(buf, offs)), "<u8").reshape(-1, 2).T
        whole = mix(_sums(mix(h ^ np.uint64(0x1234567)), start, size) + size.astype(np.uint64))
        odd = np.bincount(doc * 512 + (h & np.uint64(511)).astype(np.int64), minlength=512 * len(size)) & 1
        odd = np.packbits(odd.astype(np.uint8).reshape(-1, 512), axis=1).view(np.int64)
        freq = n[(h >> np.uint64(46)).astype(np.int64)]
        order = np.lexsort((h, freq, doc))
        long = np.minimum(size, size - _need(size, percent) + 2)
        few = size < smallest(percent)
        long[few] = np.minimum(size[few], 1)
        rank = np.arange(len(h)) - np.repeat(start, size)
        take = order[rank < np.repeat(long, size)]
        lists = pa.array(np.concatenate([[0], np.cumsum(long)]).astype(np.int32))
        salts = np.maximum(1, (freq[take] - load) // SALT + 1).astype(np.int32)
        token = h[take]
        salts[few[doc[take]]], token[few[doc[take]]] = 1, whole[doc[take]][few[doc[take]]]
        yield pa.record_batch({
            "doc_id": rows.column("doc_id"), "size": pa.array(size.astype(np.int64)), "f1": signed(np.ascontiguousarray(f1)), "f2": signed(np.ascontiguousarray(f2)),
            **{f"s{i}": pa.array(np.ascontiguousarray(odd[:, i])) for i in range(8)},
            "prefix": pa.ListArray.from_arrays(lists, signed(token)), "salts": pa.ListArray.from_arrays(lists, pa.array(salts)),
        })


def _sums(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return sums[start + size] - sums[start]


ODD = [f"s{i}" for i in range(8)]


def _near(a: str, b: str, percent: int) -> Column:
    """Whether a and b may link by size and bits: these differ in as many places as the sets do, at most."""
    na, nb = F.col(f"{a}.size"), F.col(f"{b}.size")
    differ = F.bit_count(F.col(f"{a}.s0").bitwiseXOR(F.col(f"{b}.s0")))
    for c in ODD[1:]:
        differ = differ + F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}")))
    return differ <= na + nb - 2 * F.ceil((na + nb) * percent / (100 + percent) - 1e-9)


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by token, part and id: those whose list has others too (or is dealt out by salt), with the hub, the
    first row of the list. Holds one row between batches, however long a list is."""
    names, held, hub, last = ["token", "id", "meta"], None, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        col = {c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in names}
        if held is not None:
            col = {c: np.concatenate([[held[c]], col[c]]) for c in names}
        token, part = col["token"], col["meta"] & (PARTS - 1)
        first = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (part[1:] != part[:-1])]))
        count = np.diff(np.append(first, len(token)))
        of = np.repeat(np.arange(len(first)), count)
        h_id, h_meta = col["id"][first], col["meta"][first]
        if held is None and last == (token[0], part[0]):
            h_id[0], h_meta[0] = hub
            count[0] += 1
        out = (count[of] > 1) | (part > 0)
        last, hub = (token[-1], part[-1]), (h_id[-1], h_meta[-1])
        held = None if out[-1] else {c: col[c][-1] for c in names}  # a list of one row so far: it may go on
        yield pa.record_batch({c: pa.array(x[out]) for c, x in {**col, "hub": h_id[of], "hub_meta": h_meta[of]}.items()})


# size, place (in the prefix, from 1; 0: a subset; a place too far to tell counts as sooner, which is safe) and part (0: not
# dealt out) of a row, in one number: 31, 20 and 12 bits.
PARTS, PLACES = 1 << 12, 1 << 20


def _meta(size: Column, place: Column, id_: Column, salt: Column) -> Column:
    part = F.when(salt > 1, 1 + F.pmod(F.xxhash64(id_), F.least(salt, F.lit(PARTS - 1)))).otherwise(0)
    return (size * (PARTS * PLACES) + F.least(place, F.lit(PLACES - 1)) * PARTS + part).cast("long")


def _size(meta: str) -> Column:
    return F.shiftright(meta, 32)


def _place(meta: str) -> Column:
    return F.shiftright(meta, 12).bitwiseAND(F.lit(PLACES - 1))


def _fits(a: str, b: str, percent: int) -> Column:
    return 100 * F.least(_size(a), _size(b)) >= percent * F.greatest(_size(a), _size(b))


def _room(a: str, b: str, percent: int) -> Column:
    """Whether a and b, if this is the first shingle that they share, have enough left to link."""
    na, nb = _size(a), _size(b)
    need = F.ceil((na + nb) * percent / (100 + percent) - 1e-9)
    left = (_place(a) == 0) | (_place(b) == 0) | ((na - _place(a) + 1 >= need) & (nb - _place(b) + 1 >= need))
    return _fits(a, b, percent) & left


def boundary(sets: DataFrame, percent: int) -> int:
    """Sets up to this size enumerate subsets, larger ones scan lists."""
    least = max(smallest(percent), _two(percent))
    rows = sets.where(F.col("size").between(least, LARGEST_SMALL))
    n = {r["size"]: r["count"] for r in rows.groupBy("size").count().collect()}  # at most LARGEST_SMALL rows
    tokens = rows.select(F.explode("prefix").alias("token")).agg(F.count("*").alias("all"), F.approx_count_distinct("token").alias("distinct")).first()
    mean = tokens["all"] / max(1, tokens["distinct"])
    best = total = at = 0
    for size in range(least, LARGEST_SMALL + 1):
        p = size - _need(size, percent)
        total += n.get(size, 0) * ((p + 2) * (p + 1) / 2 - (p + 1) * (1 + mean))
        if total < best:
            best, at = total, size
    return at


def _postings(sets: DataFrame, limit: int, percent: int) -> DataFrame:
    """token, id, meta. Sets that may share one shingle only with a partner scan lists, and so do their partners."""
    p = F.col("size") - F.ceil(percent * F.col("size") / 100).cast("long")
    token, salt, id_, size = F.col("at.token"), F.col("at.salt"), F.col("id"), F.col("size")
    zipped = F.arrays_zip(F.col("prefix").alias("token"), F.col("salts").alias("salt"))
    least, two = smallest(percent), _two(percent)
    scans = 100 * size > percent * limit
    if least < two:
        scans = scans | (percent * size <= 100 * (two - 1))
    heavy = sets.where((size >= least) & scans).select("id", "size", F.posexplode(F.slice(zipped, F.lit(1), (p + 1).cast("int"))).alias("place", "at"))
    heavy = heavy.select(token.alias("token"), "id", _meta(size, F.col("place") + 1, id_, salt).alias("meta"))
    equal = sets.where(size < least).select(F.explode("prefix").alias("token"), "id", _meta(size, F.lit(0), id_, F.lit(1)).alias("meta"))
    heavy = heavy.unionByName(equal)
    if not limit:
        return heavy
    subset = lambda x, y: F.struct(F.xxhash64(x["token"], y["token"]).alias("token"), F.least(x["salt"], y["salt"]).alias("salt"))
    pairs = F.flatten(F.transform(zipped, lambda x, i: F.transform(F.slice(zipped, i + 2, F.size("prefix")), lambda y: subset(x, y))))
    light = sets.where(size.between(max(least, two), limit)).select("id", "size", F.explode(pairs).alias("at"))
    return heavy.unionByName(light.select(token.alias("token"), "id", _meta(size, F.lit(0), id_, salt).alias("meta")))


def worded(text: bytes, k: int) -> set[tuple[bytes, ...]]:
    """The shingles as words: what ``shingles`` hashes."""
    w = text.lower().split()
    return set(zip(*(w[j:] for j in range(k)), strict=False)) if len(w) >= k else {tuple(w)} if w else set()


def _compare(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b, their texts ta and tb, packed) that reach the threshold, by hashes and then by words."""
    unpack, kept, room = unpacker(), {}, 0

    def shingled(id_: int, text: bytes) -> np.ndarray:
        nonlocal room
        if id_ not in kept:
            if room > 1 << 24:
                kept.clear()
                room = 0
            buf = np.frombuffer(unpack(text), np.uint8)
            kept[id_] = np.unique(shingles(buf, np.array([0, len(buf)]), k)[1])
            room += kept[id_].nbytes
        return kept[id_]

    for batch in batches:
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        on = np.zeros(len(a), bool)
        for i, (x, y) in enumerate(zip(a, b, strict=True)):
            sx, sy = shingled(x, batch.column("ta")[i].as_py()), shingled(y, batch.column("tb")[i].as_py())
            n = len(np.intersect1d(sx, sy, assume_unique=True))
            if 100 * n >= percent * (len(sx) + len(sy) - n):
                wx, wy = (worded(unpack(batch.column(c)[i].as_py()), k) for c in ("ta", "tb"))
                on[i] = 100 * len(wx & wy) >= percent * len(wx | wy)
        yield pa.record_batch({"a": pa.array(np.array(a, np.int64)[on]), "b": pa.array(np.array(b, np.int64)[on])})


def _links(pairs: DataFrame, bits: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that reach the threshold."""
    x, y = bits.alias("x").hint("merge"), bits.alias("y").hint("merge")
    pairs = pairs.join(x, F.col("a") == F.col("x.id")).join(y, (F.col("b") == F.col("y.id")) & _near("x", "y", percent)).select("a", "b")
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")
    return both.mapInArrow(lambda x: _compare(x, k, percent), "a long, b long")


def ngram_join(docs: DataFrame, *, k: int = 5, percent: int = 80, rounds: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id."""
    if not 1 <= percent <= 100:
        raise ValueError(f"percent must be 1 to 100, not {percent}")
    spark = docs.sparkSession
    at = work(spark)
    docs = one_per_id(docs, "doc_id", "text").select("doc_id", F.col("text").cast("binary").alias("text"))
    cells = docs.select("text").mapInArrow(lambda b: _sketch(b, k), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(CELLS, np.int64)
    counts[cells["cell"].to_numpy(int)] = cells["n"].to_numpy(int)
    counts = spark.sparkContext.broadcast(counts)  # CELLS numbers, whatever the input
    rows = docs.mapInArrow(lambda b: _sets(b, counts, k, percent), f"doc_id long, size long, f1 long, f2 long, {', '.join(f'{c} long' for c in ODD)}, prefix array<long>, salts array<int>")
    rows = save(rows, at, "sets")
    bits = rows.select(F.col("doc_id").alias("id"), "size", *ODD)
    classes = save(rows.where("size > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("id")), at, "classes")
    sets = rows.join(classes.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").withColumnRenamed("doc_id", "id")
    listed = _postings(sets, boundary(rows, percent), percent)
    part = F.col("meta").bitwiseAND(F.lit(PARTS - 1))
    listed = listed.repartition("token", part).sortWithinPartitions("token", part, "id")
    listed = save(listed.mapInArrow(_lists, "token long, id long, meta long, hub long, hub_meta long"), at, "lists")
    texts = docs.mapInArrow(packed, docs.schema).withColumnRenamed("doc_id", "id")
    texts = save(texts.join(listed.select("id").distinct(), "id", "left_semi"), at, "texts")

    hubs = listed.where(part > 0).select("token", F.col("hub").alias("id"), F.col("hub_meta").alias("meta")).distinct()
    tops = hubs.groupBy("token").agg(F.min(F.struct("id", "meta")).alias("top"))
    pairs = listed.select(F.col("hub").alias("a"), F.col("hub_meta").alias("ma"), F.col("id").alias("b"), F.col("meta").alias("mb"))
    pairs = pairs.unionByName(hubs.join(tops, "token").select(F.col("top.id").alias("a"), F.col("top.meta").alias("ma"), F.col("id").alias("b"), F.col("meta").alias("mb")))
    tried = save(pairs.where(F.col("a") != F.col("b")).where(_fits("ma", "mb", percent)).select("a", "b").distinct(), at, "tried0")
    links = save(_links(tried, bits, texts, k, percent), at, "links0")
    label = components(links, at, "part0")

    for step in range(1, rounds + 1):
        # Lists that span several components, and in them the pairs that may still link.
        now = listed.select("token", "id", "meta").join(label, "id", "left").withColumn("label", F.coalesce("label", "id"))
        mixed = now.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("token")
        now = save(now.join(mixed, "token", "left_semi"), at, f"open{step}")
        each = now.groupBy("token", "label").count()
        cross = each.groupBy("token").agg(F.sum("count").alias("n"), F.sum(F.col("count") * F.col("count")).alias("own"))
        size = cross.agg(F.sum("n").alias("rows"), F.sum((F.col("n") * F.col("n") - F.col("own")) / 2).alias("pairs")).first()
        if not size["rows"]:
            break
        if step < rounds and size["pairs"] > 8 * size["rows"]:
            # The sets of a list against one of them, another one in each round, where their components differ.
            pick = now.groupBy("token").agg(F.min(F.struct(F.xxhash64("id", F.lit(step)).alias("turn"), "id", "meta", "label")).alias("hub"))
            pairs = now.join(pick, "token").where(F.col("label") != F.col("hub.label"))
            pairs = pairs.select(F.col("hub.id").alias("x"), F.col("hub.meta").alias("mx"), F.col("id").alias("y"), F.col("meta").alias("my"))
            pairs = pairs.where(_fits("mx", "my", percent))
        else:
            step = rounds
            # Pairs of a list whose components differ: each has one outside the list's largest component at least.
            main = each.groupBy("token").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.sum("count").alias("members"))
            now = save(now.join(main, "token").join(bits, "id"), at, "pairing")
            # A pair of a long list is taken where its first shared list is this one, by the list order of the smaller id.
            shared = now.join(now.where(F.col("members") > LONG).select("id").distinct(), "id", "left_semi")
            shared = shared.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct(_place("meta").alias("place"), "token"))), lambda x: x["token"]).alias("lists"))
            now = now.join(shared, "id", "left").withColumn("lists", F.when(F.col("members") > LONG, F.col("lists")))
            a, b = now.where("label != main").alias("a"), now.alias("b")
            here = (F.col("a.token") == F.col("b.token")) & (F.col("a.label") != F.col("b.label"))
            once = (F.col("b.label") == F.col("b.main")) | (F.col("a.id") < F.col("b.id"))
            ours = F.when(F.col("a.id") < F.col("b.id"), F.array_intersect("a.lists", "b.lists")).otherwise(F.array_intersect("b.lists", "a.lists"))
            first = F.col("a.lists").isNull() | (F.get(ours, 0) == F.col("a.token"))
            pairs = a.join(b.hint("merge"), here & once & _room("a.meta", "b.meta", percent) & _near("a", "b", percent) & first)
            pairs = pairs.select(F.col("a.id").alias("x"), F.col("b.id").alias("y"))
        pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        new = save(pairs.join(tried, ["a", "b"], "left_anti"), at, f"tried{step}")
        tried = tried.unionByName(new)
        label = extended(label, save(_links(new, bits, texts, k, percent), at, f"links{step}"), at, f"part{step}")
        if step == rounds:
            break

    named = classes.join(label, "id", "left").select("f1", "f2", F.coalesce("label", "id").alias("component_id"))
    return rows.select("doc_id", "size", "f1", "f2").join(named, ["f1", "f2"], "left").select(
        "doc_id", F.col("size").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )
