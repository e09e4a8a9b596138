"""What the ten operators share: scratch tables, Arrow batches, word arrays, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given directory, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; a local one only where that is unset and the master is local (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors need a shared folder")
        base = _LOCAL.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="methloom-"))
    return f"{base.rstrip('/')}/methloom-{uuid.uuid4().hex}"


#: Removes a query's shuffle files at its end; else they stay until the driver's garbage collector finds their plan.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    path, conf = scratch(df.sparkSession), df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by ``written`` that nothing reads any more."""
    spark, path = df.sparkSession, getattr(df, "scratch_path", None)
    if path:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def without(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id (null or not) and hash of text no row of ``bad`` (doc_id, tid) has."""
    bad = bad.select(F.col("doc_id").alias("_doc"), F.col("tid").alias("_tid")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_doc"]) & (F.xxhash64(docs["text"]) == bad["_tid"]), "left_anti")


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that ``column`` holds about ``most`` bytes in each (one row at least)."""
    for batch in batches:
        col = batch.column(column)
        if batch.num_rows == 0:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
        part = np.concatenate([[0], np.cumsum(sizes)[:-1]]) // most
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


class WordHashes(dict):
    """XXH64 of words, remembered for as long as there are not too many."""

    most = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.most:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


class Numbers(dict):
    """Number of each word in the order of first sight."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


#: Odd multiplier of the rolling hashes (arithmetic modulo 2**64).
BASE = 0x9E3779B97F4A7C15 | 3
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse for i < n."""
    have = len(_POWERS.get("up", ()))
    if have < n:
        n2 = max(n, 1 << 16, 2 * have)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(n2, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that every bit of a rolling hash depends on all of it."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k words of one sequence; empty if it is shorter."""
    n = len(hashes)
    if n < k:
        return np.empty(0, dtype=np.uint64)
    up, down = powers(n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(hashes * up, out=sums[1:])
    return mixed((sums[k:] - sums[: n - k + 1]) * down[: n - k + 1])


def components(links: DataFrame) -> DataFrame:
    """Distributed union-find: (node, component) for every node of ``links`` (src, dst), component
    the smallest node reachable. Alternates large-star and small-star steps (Kiveris et al. 2014);
    each step's edges are a written table, the driver sees two numbers a round. Self-links and
    repeated links are allowed, nulls are dropped, no links give an empty table."""
    edges = written(
        links.where("src is not null and dst is not null and src <> dst")
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct()
    )
    sign = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = sign(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = written(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = written(small.union(low).distinct())
        discard(edges)
        discard(large)
        edges, after = new, sign(new)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
