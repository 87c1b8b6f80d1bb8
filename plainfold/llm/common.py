"""What the operators of this subpackage share: ids, work tables, vectorised word hashing."""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1 << 17  #: bytes of text that the vectorised code takes at once, so that its arrays stay in the cache


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _own_folder() -> str:
    root = tempfile.mkdtemp(prefix="plainfold-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root


def work(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share. Where that is unset, it is a temporary one,
    but only if driver and executors are one process: elsewhere each machine would write to its own disk.

    The folder goes when the application ends, by whatever store it lies in; results that are to stay must be written."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = _own_folder()
    out = f"{root.rstrip('/')}/plainfold-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(path)
    store.deleteOnExit(path)
    return out


def save(df: DataFrame, at: str, name: str) -> DataFrame:
    """Write ``df`` as a table of the shared folder and read it back: lineage ends here and survives a lost executor."""
    df.write.parquet(f"{at}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{at}/{name}")


def quoted(names: Iterable[str]) -> list[str]:
    """Column names as they must be written where points or backticks in them would have a meaning."""
    return ["`" + x.replace("`", "``") + "`" for x in names]


def one_per_id(df: DataFrame, key: str, *cols: str) -> DataFrame:
    """The ``key`` and ``cols`` of each row, one row for each key that isn't null.

    Rows without an id name nothing and take no part. Rows that repeat an id count once: the one with the
    greatest ``cols`` stays. The ids are counted first, in a job that reads only them; tables whose ids are
    unique, as they should be, aren't shuffled, and else only the rows of repeated ids are compared."""
    df = df.select(key, *quoted(cols)).where(F.col(key).isNotNull())
    twice = df.groupBy(key).count().where("count > 1").select(key)
    if twice.isEmpty():
        return df
    most = df.join(twice, key, "left_semi").groupBy(key).agg(F.max(F.struct(*quoted(cols) or [F.lit(0)])).alias("_row"))
    return df.join(twice, key, "left_anti").unionByName(most.select(key, *(F.col("_row")[c].alias(c) for c in cols)))


# Words and hashes, vectorised ------------------------------------------------------------------------------------

_RNG = np.random.Generator(np.random.PCG64(7))
_BYTE = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[LOWER]
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_ALL = np.uint64(2**64 - 1)
LONG_WORD = 256
_POW = np.ones(1, np.uint64)
_INVPOW = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INVPOW
    if len(_POW) < n:
        for base, name in ((_BASE, "_POW"), (_INV, "_INVPOW")):
            out = np.full(max(n, CHUNK + 1), base, np.uint64)
            out[0] = 1
            globals()[name] = np.cumprod(out, dtype=np.uint64)
    return _POW, _INVPOW


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(buf: np.ndarray, lower: bool) -> np.ndarray:
    """Sums up to each byte; ``span_hash`` takes differences of them. Periodic words can be built that collide, so what is
    found by these is to be compared as bytes; ``word_hash`` is for what isn't."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[buf] * powers(len(buf) + 1)[0][: len(buf)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start])


def words(buf: np.ndarray, offs: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each maximal run of ``core`` bytes; documents lie at ``offs``."""
    before, after = np.empty_like(core), np.empty_like(core)
    before[:1], before[1:] = False, core[:-1]
    after[-1:], after[:-1] = False, core[1:]
    edge = offs[(offs < len(buf)) & (offs >= 0)]
    before[edge] = False
    after[edge[edge > 0] - 1] = False
    start, end = np.flatnonzero(core & ~before), np.flatnonzero(core & ~after) + 1
    return start, end, np.searchsorted(offs, start, "right") - 1


def word_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the lower-cased bytes of each word. Eight bytes at a time go through the finaliser, so that no sum of
    powers is there for periodic words to cancel; words over ``LONG_WORD`` bytes get a digest of hashlib's."""
    size = end - start
    out = mix(size.astype(np.uint64) * _BASE + np.uint64(1))
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = LOWER[buf]
    eight = np.ndarray((len(buf) + 1,), "<u8", padded.data, strides=(1,))
    at, on = 0, np.flatnonzero(size <= LONG_WORD)
    while len(on):
        left = np.minimum(size[on] - at, 8).astype(np.uint64)
        part = eight[start[on] + at] & (_ALL >> (np.uint64(64) - np.uint64(8) * left))
        out[on] = mix((out[on] ^ part) * _BASE + np.uint64(at))
        at += 8
        on = on[size[on] > at]
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = int.from_bytes(hashlib.blake2b(padded[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def sequence_digests(buf: np.ndarray, offs: np.ndarray) -> list[bytes]:
    """16 bytes of SHA-256 of each document's lower-cased words, one blank between them: equal where the words are."""
    core = ~SPACE[buf]
    low = np.where(core, LOWER[buf], np.uint8(0x20))
    keep = core.copy()
    keep[1:] |= core[:-1]  # the first blank after a word
    edge = offs[1:-1]
    edge = edge[(edge < len(buf)) & (edge > 0)]
    keep[edge] = core[edge]  # none from the document before
    at = np.concatenate([[0], np.cumsum(keep)])
    low = low[keep].tobytes()
    return [hashlib.sha256(low[at[i] : at[j]].rstrip(b" ")).digest()[:16] for i, j in zip(offs[:-1], offs[1:], strict=True)]


def shingles(buf: np.ndarray, offs: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of each run of ``k`` words (lower-cased ASCII); of all words where a document has fewer."""
    start, end, doc = words(buf, offs, ~SPACE[buf])
    return runs_of_words(doc, word_hash(buf, start, end), len(offs) - 1, k)


def runs_of_words(doc: np.ndarray, h: np.ndarray, docs_n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``shingles`` of words given by document and hash; ``docs_n`` documents."""
    mult = np.uint64(0xD6E8FEB86659FD93)
    n = len(h)
    acc = h[: max(0, n - k + 1)].copy()
    for j in range(1, k):
        acc = acc * mult + h[j : n - k + 1 + j] if n >= k else acc
    whole = doc[: len(acc)] == doc[k - 1 :] if n >= k else np.zeros(0, bool)
    docs, hashes = doc[: len(acc)][whole], mix(acc[whole])
    count = np.bincount(doc, minlength=docs_n)
    few = np.flatnonzero((count > 0) & (count < k))
    if len(few):
        first = np.searchsorted(doc, few)
        short = h[first] + count[few].astype(np.uint64)
        for j in range(1, k - 1):
            on = count[few] > j
            short[on] = short[on] * mult + h[first[on] + j]
        docs, hashes = np.concatenate([docs, few]), np.concatenate([hashes, mix(short ^ mult)])
        order = np.argsort(docs, kind="stable")
        docs, hashes = docs[order], hashes[order]
    return docs, hashes


def chunks(batches: Iterator[pa.RecordBatch], text: str, most: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches of about ``most`` bytes of the binary column ``text``: slice, bytes, offsets. Null: empty."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        if not batch.num_rows:
            continue
        if col.null_count:
            col = col.fill_null(b"")
        if pa.types.is_large_binary(col.type):
            col = col.cast(pa.binary())
        offs = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
        data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(col):
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
            yield batch.slice(at, to - at), data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
            at = to


def packed(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches with the binary column ``text`` compressed, which halves what a shuffle of texts writes. Null: empty."""
    import zstandard

    press = zstandard.ZstdCompressor(level=3, write_content_size=True)
    for batch in batches:
        at = batch.schema.get_field_index(text)
        yield batch.set_column(at, text, pa.array([press.compress(x or b"") for x in batch.column(at).to_pylist()], pa.binary()))


def unpacker():
    import zstandard

    return zstandard.ZstdDecompressor().decompress


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
