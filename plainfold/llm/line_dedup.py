"""Line dedup by levelled sorted runs of line hashes.

An index holds the keys of all lines seen, as runs: tables in hash buckets, each sorted by hash, one file a bucket. A batch's
keys (one row for each, so that a frequent line is no hot key) merge-anti-join the runs, which takes no exchange and no sort
on the runs' side; what is left is new, and becomes a run of level 0 that also names the document owning each key. Two runs
of a level are compacted into one of the next, by a merge join of their buckets, again without an exchange. A line stays
where its document owns its key, which is a join on document and key and so has no hot key either.

An index may be kept and extended: ``line_dedup(docs, index=folder)`` drops lines that documents of earlier calls hold, and
adds the keys of its own. A call takes ``batches`` batches, so that each line is joined and rewritten as often at every size;
None makes them of ``batch_bytes`` bytes of text, at most 16, which rewrites each line once for each level that they fill. Each
batch reads the table of line hashes, by ranges of ids, so that files of other ids are skipped where ids rise.

Defined results: a null text is one empty line; keys shorter than ``least`` code points always stay; a repeated id
counts once and rows without id take no part (``one_per_id``); an empty table gives an empty result. Columns other
than id and text aren't read, so their names don't matter. Texts are taken whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import one_per_id, save, work

BLANK = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


KEYS = ("h1", "h2")
#: What the planner is told where runs are joined: that a bucket of one file is read in order; and not to join before keys
#: have been grouped, as then a frequent line's rows would all go to one task.
PLANNING = {
    "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
    "spark.sql.optimizer.excludedRules": "org.apache.spark.sql.catalyst.optimizer.PushDownLeftSemiAntiJoin",
}


@contextmanager
def _in_order(spark: SparkSession) -> Iterator[None]:
    """Plans made within are made so."""
    was = {k: spark.conf.get(k, None) for k in PLANNING}
    for k, v in PLANNING.items():
        spark.conf.set(k, v if not was[k] or v == "true" else f"{was[k]},{v}")
    try:
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class LineIndex:
    """Runs by level below the folder ``at``; ``fanout`` of a level make one of the next, merged two by two. What runs
    there are is appended, if the index is ``kept``, to a small table beside them, a version for each change, so that a later
    call finds them."""

    def __init__(self, spark: SparkSession, at: str, buckets: int | None = None, fanout: int = 2, kept: bool = True):
        self.spark, self.at, self.fanout, self.kept = spark, at, fanout, kept
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[tuple[str, DataFrame]]] = [[]]
        self.version = 0

    @classmethod
    def open(cls, spark: SparkSession, at: str, fanout: int = 2) -> LineIndex:
        """The index that earlier calls left in ``at``, or a new one."""
        from pyspark.errors import AnalysisException

        try:
            rows = spark.read.parquet(f"{at}/runs").collect()  # a row for each run of each version
        except AnalysisException as exc:
            if "PATH_NOT_FOUND" not in str(exc):
                raise
            return cls(spark, at, fanout=fanout)
        last = max(r["version"] for r in rows)
        now = [r for r in rows if r["version"] == last]
        out = cls(spark, at, now[0]["buckets"], fanout)
        out.version = last
        out.levels = [[] for _ in range(1 + max(r["level"] for r in now))]
        for r in sorted(r for r in now if r["run"] is not None):
            out.levels[r["level"]].append((r["run"], out._table(r["run"])))
        return out

    def _table(self, run: str) -> DataFrame:
        """The run as a bucketed table. Its name is needed only until it is resolved."""
        name = f"plainfold_{uuid.uuid4().hex}"
        self.spark.sql(
            f"CREATE TABLE {name} (h1 BIGINT, h2 BIGINT, doc_id BIGINT) USING parquet OPTIONS (path '{self.at}/{run}') "
            f"CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {self.buckets} BUCKETS"
        )
        try:
            return self.spark.table(name)
        finally:
            self.spark.sql(f"DROP TABLE {name}")

    def _write(self, rows: DataFrame, level: int) -> DataFrame:
        run, name = f"run-{uuid.uuid4().hex}", f"plainfold_{uuid.uuid4().hex}"
        with _in_order(self.spark):
            rows.select(*KEYS, "doc_id").write.bucketBy(self.buckets, *KEYS).sortBy(*KEYS).option("path", f"{self.at}/{run}").saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")
        while len(self.levels) <= level:
            self.levels.append([])
        out = self._table(run)
        self.levels[level].append((run, out))
        return out

    def _noted(self) -> None:
        self.version += 1
        rows = [(self.version, self.buckets, level, run) for level, runs in enumerate(self.levels) for run, _ in runs] or [(self.version, self.buckets, 0, None)]
        self.spark.createDataFrame(rows, "version long, buckets int, level int, run string").coalesce(1).write.mode("append").parquet(f"{self.at}/runs")

    def unseen(self, keys: DataFrame) -> DataFrame:
        """Those of the keys (h1, h2, doc_id; one row a key) that no run has."""
        for _, run in (r for level in reversed(self.levels) for r in level):
            keys = keys.join(run.select(*KEYS).hint("merge"), list(KEYS), "left_anti")
        return keys

    def add(self, keys: DataFrame) -> DataFrame:
        """The unseen keys, now a run themselves. Levels that are full are compacted first, so never for nobody."""
        self.compact()
        new = self._write(self.unseen(keys), 0)
        if self.kept:
            self._noted()
        return new

    def compact(self) -> None:
        for level, runs in enumerate(self.levels):  # grows meanwhile
            if len(runs) >= self.fanout:
                self.levels[level] = []
                one, *more = (run for _, run in runs)
                for i, run in enumerate(more, 1):
                    self._write(self.merged(one, run), level + 1)
                    if i < len(more):  # on the way
                        _, one = self.levels[level + 1].pop()

    @staticmethod
    def merged(a: DataFrame, b: DataFrame) -> DataFrame:
        """The rows of two runs, bucket by bucket; no key is in both."""
        both = a.withColumnRenamed("doc_id", "a").join(b.withColumnRenamed("doc_id", "b").hint("merge"), list(KEYS), "full")
        return both.select(*KEYS, F.coalesce("a", "b").alias("doc_id"))


def line_dedup(docs: DataFrame, *, least: int = 10, batches: int | None = 4, batch_bytes: int = 1 << 27, fanout: int = 2, index: str | None = None) -> DataFrame:
    """doc_id, text of the lines kept, n_lines, n_dropped. Batches are ranges of doc_id, in order, so that the
    smallest document owns a key, but for those that an ``index`` of earlier calls has."""
    spark = docs.sparkSession
    at = work(spark)
    docs = one_per_id(docs, "doc_id", "text")
    key = F.btrim(F.col("line"), F.lit(BLANK))
    long = F.length("key") >= least
    keyed = (
        docs.select("doc_id", F.posexplode(lines(F.translate("text", UPPER, LOWER))).alias("pos", "line"))
        .select("doc_id", "pos", key.alias("key"))
        .select("doc_id", "pos", F.when(long, F.xxhash64("key")).alias("h1"), F.when(long, F.xxhash64(F.lit(1), "key")).alias("h2"))
    )
    keyed = save(keyed, at, "lines")
    if batches is None:
        batches = min(16, max(1, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // batch_bytes)))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 10_000)).first()[0] if batches > 1 else []
    cuts = sorted(set(cuts or []))
    runs, owned = LineIndex.open(spark, index, fanout) if index else LineIndex(spark, f"{at}/index", fanout=fanout, kept=False), None
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = keyed.where("h1 is not null")
        part = part if low is None else part.where(F.col("doc_id") > low)
        part = part if high is None else part.where(F.col("doc_id") <= high)
        new = runs.add(part.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id")))
        owned = new if owned is None else owned.unionByName(new)
    stays = F.col("h1").isNull() | F.col("own").isNotNull()
    marks = (
        keyed.join(owned.withColumn("own", F.lit(1)), ["doc_id", "h1", "h2"], "left")
        .groupBy("doc_id")
        .agg(
            F.count("*").alias("n_lines"),
            F.count_if(~stays).alias("n_dropped"),
            F.transform(F.array_sort(F.collect_list(F.struct("pos", stays.alias("stays")))), lambda x: x["stays"]).alias("stays"),
        )
        .withColumn("stays", F.when(F.col("n_dropped") > 0, F.col("stays")))
    )
    kept = F.concat_ws("\n", F.filter(lines(F.col("text")), lambda _, i: F.get(F.col("stays"), i)))
    return docs.join(marks, "doc_id").select(
        "doc_id", F.when(F.col("n_dropped") > 0, kept).otherwise(F.coalesce("text", F.lit(""))).alias("text"), "n_lines", "n_dropped"
    )
