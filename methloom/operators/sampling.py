"""Order, limits and samples (O1-O11). Draws go by a hash of the row and a seed, so reruns agree."""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.calls import half_up
from ..sources.scratch import written
from .compare import agreement, classification_metrics, roc_auc, summarise_runs
from .sites import kmer_distribution, site_frequency_aggregate


def _hash(df: DataFrame, seed: int) -> Column:
    """A row's place in random order: not negative, the same for equal rows."""
    return F.xxhash64(F.lit(seed), *df.columns).bitwiseAND((1 << 63) - 1)


def text_order(key: Column, seed: int | Column = 1) -> Column:
    """A place in random order that other engines repeat: 60 bits of the MD5 of seed and key, from 0 to 2**63."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    digits = F.substring(F.md5(F.concat_ws("/", seed.cast("string"), key).cast("binary")), 1, 15)
    return F.conv(digits, 16, 10).cast("long") * 8


def genome_order(df: DataFrame) -> DataFrame:
    """O1: by contig (as text), place, strand."""
    return df.orderBy("contig", "pos", "strand") if "strand" in df.columns else df.orderBy("contig", "pos")


def coordinate_sort(alignments: DataFrame, contigs: DataFrame | None = None, partitions: int | None = None) -> DataFrame:
    """O2: alignments in the order of a contig table (contig, rank; a header's order) or of names, then start."""
    df = alignments
    if contigs is not None:
        df = df.join(contigs.select("contig", F.col("rank").alias("_rank")), "contig", "left").withColumn("_rank", F.coalesce("_rank", F.lit(1 << 30)))
    cols = ["_rank"] if contigs is not None else []
    args = [partitions] if partitions else []
    return df.repartitionByRange(*args, *cols, "contig", "start").sortWithinPartitions(*cols, "contig", "start").drop("_rank")


def sample_n(df: DataFrame, n: int, seed: int = 1, order: Column | None = None) -> DataFrame:
    """O3: n rows (all if fewer), the first in random order (``order``: 0 to 2**63); any n, no task sees all rows."""
    return ranked(df, _hash(df, seed) if order is None else order, most=F.lit(n)).drop("rank")


def shuffle_rows(df: DataFrame, seed: int = 1, *others: DataFrame, order: Column | None = None) -> DataFrame:
    """A full shuffle of one table, or of several together."""
    for o in others:
        df = df.unionByName(o)
    return df.withColumn("_h", _hash(df, seed) if order is None else order).repartitionByRange("_h").sortWithinPartitions("_h").drop("_h")


def out_of_order(df: DataFrame, order: Column) -> DataFrame:
    """``df`` with out_of_order: 1 where a row's ``order`` is below that of the row before it, as partitions and
    their rows stand now, else 0. Rows and their places are written as a table first: evaluated again, ranges would be
    cut at other sampled bounds than those of the table of partitions that has the rows before partitions' first ones."""
    placed = df.withColumn("_o", order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    schema = T.StructType([*placed.schema.fields, T.StructField("_prior", placed.schema["_o"].dataType)])

    def shifted(batches: Iterator) -> Iterator:
        import pyarrow as pa

        last = None
        for b in batches:
            o = b.column("_o")
            if not len(o):
                continue
            last = pa.nulls(1, o.type) if last is None else last
            yield pa.RecordBatch.from_arrays([*b.columns, pa.concat_arrays([last, o])[: len(o)]], names=[*b.schema.names, "_prior"])
            last = o[-1:]

    placed = written(placed.mapInArrow(shifted, schema))
    last = placed.groupBy("_p").agg(F.max_by("_o", "_i").alias("_last"))
    before = last.select(F.col("_p").alias("_q"), F.lag("_last").over(W.orderBy("_p")).alias("_before"))  # a row a partition
    out = placed.join(F.broadcast(before), F.col("_p") == F.col("_q"))
    prior = F.when(F.col("_i").bitwiseAND((1 << 33) - 1) == 0, F.col("_before")).otherwise(F.col("_prior"))
    wrong = F.coalesce((prior > F.col("_o")).cast("int"), F.lit(0))
    return out.withColumn("out_of_order", wrong).drop("_o", "_p", "_i", "_prior", "_q", "_before")


def ranked(df: DataFrame, order: Column, by: tuple[str, ...] = (), most: Column | None = None, bits: int = 10) -> DataFrame:
    """``df`` with rank (from 1) in the order of a number from 0 to 2**63, within each of ``by``; of rows of
    one number the columns decide. Counts of the number's 2**bits ranges first, then ranks within a range:
    no task sees all rows, or all of one of ``by``. With ``most`` (of the columns ``by``) only ranks up to it:
    later ranges are left out before rows are dealt."""
    own = list(df.columns)
    df = df.withColumn("_h", order).withColumn("_b", F.shiftright("_h", 63 - bits))
    sums = df.groupBy(*by, "_b").agg(F.count("*").alias("_n"))  # a row a range
    before = F.sum("_n").over(W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, -1))
    starts = sums.select(*by, "_b", F.coalesce(before, F.lit(0)).alias("_start"))
    if most is not None:
        starts = starts.where(F.col("_start") < most)
    named = [f"_by_{c}" for c in by]
    starts = starts.toDF(*named, "_c", "_start")
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(by, named, strict=True)], F.col("_b") == F.col("_c"))
    near = df.join(starts if by else F.broadcast(starts), same).drop("_c", *named)  # without ``by`` 2**bits rows
    line = W.partitionBy(*by, "_b").orderBy("_h", *own)
    out = near.withColumn("rank", F.col("_start") + F.row_number().over(line)).drop("_h", "_b", "_start")
    return out.where(F.col("rank") <= most) if most is not None else out


def train_valid_split(pos: DataFrame, neg: DataFrame, ratio: float = 0.9, seed: int = 1, order: Column | None = None) -> DataFrame:
    """Positives and negatives in random order with ``split``: exactly round(n ratio) rows train."""
    both = pos.unionByName(neg)
    total = both.agg(F.floor(F.count("*") * ratio + 0.5).alias("_train"))
    out = ranked(both, _hash(both, seed) if order is None else order).crossJoin(F.broadcast(total))
    return out.withColumn("split", F.when(F.col("rank") <= F.col("_train"), "train").otherwise("valid")).drop("rank", "_train")


def split_by_read(df: DataFrame, ratio: float = 0.9, seed: int = 1, key: str = "read_id", order: Column | None = None) -> DataFrame:
    """As O5, but a read's rows stay together: exactly round(reads ratio) reads train."""
    ids = df.select(key).distinct()
    total = ids.agg(F.floor(F.count("*") * ratio + 0.5).alias("_train"))
    placed = ranked(ids, _hash(ids, seed) if order is None else order).crossJoin(F.broadcast(total))
    return df.join(placed.select(key, F.when(F.col("rank") <= F.col("_train"), "train").otherwise("valid").alias("split")), key)


def balance_by_kmer(neg: DataFrame, pos: DataFrame, total: int | None = None, seed: int = 1, floor: bool = False, random_frac: float = 0.5,
                    order: Column | None = None, kmer_order: Column | None = None) -> DataFrame:
    """Negatives chosen to the positives' k-mer shares.

    A k-mer's quota is ceil (or floor) of total times its share. What is missing is filled first from
    k-mers without a quota, evenly, in hash order of k-mers until they give ``random_frac`` of it, then
    from the negatives of any k-mer that were left over. Rows are taken in hash order.

    All is settled on counts by k-mer and hash range, a written table: what is taken of each k-mer (a running sum over
    k-mers by ranges of their hash), which ranges have rows that are left over, and the range in which the last of
    those that are needed lies. Only rows of ranges that give any are dealt, and ranked within their k-mer's range."""
    shares = kmer_distribution(pos)
    if total is None:
        total = pos.count()
    up = F.floor if floor else F.ceil
    quotas = shares.select("kmer", up(F.lit(total) * F.col("share")).alias("quota")).where("quota > 0")
    order = _hash(neg, seed) if order is None else order
    keyed = neg.withColumn("_h", order).withColumn("_b", F.shiftright("_h", 63 - RANGE_BITS))
    counts = written(keyed.groupBy("kmer", "_b").agg(F.count("*").alias("n")))
    sizes = counts.groupBy("kmer").agg(F.sum("n").alias("n")).join(quotas, "kmer", "left")
    own = F.when(F.col("quota").isNotNull(), F.least("n", "quota"))
    first, n_kmers = sizes.agg(F.coalesce(F.sum(own), F.lit(0)), F.count_if(F.col("quota").isNull())).first()
    missing, plan = total - first, sizes.withColumn("_take", F.coalesce(own, F.lit(0)))
    each = (missing // n_kmers if floor else -(-missing // n_kmers)) if n_kmers and missing > 0 else 0
    if each > 0:
        even = F.when(F.col("quota").isNull(), F.least("n", F.lit(each))).otherwise(0)
        kmer_order = F.xxhash64(F.lit(seed), "kmer").bitwiseAND((1 << 63) - 1) if kmer_order is None else kmer_order
        plan = _sums_before(plan.withColumn("_even", even), kmer_order, "_even", "kmer")
        plan = plan.withColumn("_take", F.col("_take") + F.when(F.col("_before") < random_frac * missing, F.col("_even")).otherwise(0))
    start = F.coalesce(F.sum("n").over(W.partitionBy("kmer").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = written(counts.join(plan.select("kmer", "_take"), "kmer").withColumn("_start", start))
    chosen = F.greatest(F.least(F.col("_take") - F.col("_start"), F.col("n")), F.lit(0))
    left = ranges.groupBy("_b").agg(F.sum(chosen).alias("chosen"), F.sum(F.col("n") - chosen).alias("left")).orderBy("_b").collect()  # a row a range
    missing, last = total - sum(r["chosen"] for r in left), -1
    for r in left:
        if missing <= 0:
            break
        last, rest, missing = r["_b"], missing, missing - r["left"]

    def dealt(keep: Column) -> DataFrame:
        """Rows of some ranges with their rank among all of their k-mer, and how many are taken of it."""
        line = W.partitionBy("kmer", "_b").orderBy("_h", *neg.columns)
        near = keyed.join(ranges.where(keep).drop("n"), ["kmer", "_b"])
        return near.withColumn("_rank", F.col("_start") + F.row_number().over(line))

    out = dealt((F.col("_start") < F.col("_take")) | (F.col("_b") <= last))
    taken = F.col("_rank") <= F.col("_take")
    if last < 0:
        return out.where(taken).select(*neg.columns)
    spare = dealt(F.col("_b") == last).where(~taken & (F.col("_b") == last)).select(*neg.columns, "_h")
    finer = F.shiftleft("_h", RANGE_BITS).bitwiseAND((1 << 63) - 1)
    return out.where(taken | (F.col("_b") < last)).select(*neg.columns).unionByName(ranked(spare, finer, most=F.lit(rest)).select(*neg.columns))


#: Ranges of a hash by its first bits.
RANGE_BITS = 10


def _sums_before(df: DataFrame, order: Column, value: str, tie: str, bits: int = RANGE_BITS) -> DataFrame:
    """``df`` with _before: the sum of ``value`` in the rows before each in the order of a number from 0 to 2**63, then
    of ``tie``. Sums of the number's ranges first, then a running sum within each: no task sees all rows."""
    df = df.withColumn("_o", order).withColumn("_p", F.shiftright("_o", 63 - bits))
    before = F.sum("_s").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1))
    starts = df.groupBy("_p").agg(F.sum(value).alias("_s")).select("_p", F.coalesce(before, F.lit(0)).alias("_first"))  # a row a range
    within = F.sum(value).over(W.partitionBy("_p").orderBy("_o", tie).rowsBetween(W.unboundedPreceding, -1))
    out = df.withColumn("_within", F.coalesce(within, F.lit(0))).join(F.broadcast(starts), "_p")
    return out.withColumn("_before", F.col("_first") + F.col("_within")).drop("_o", "_p", "_first", "_within")


def subsample_coverage(reads: DataFrame, coverage: float, genome_size: int, seed: int = 1, length: str | Column = "length") -> DataFrame:
    """Reads kept by ``text_order`` of their id so that their bases come to about coverage times genome size."""
    length = F.col(length) if isinstance(length, str) else length
    bases = reads.agg(F.sum(length).alias("_bases"))
    share = F.least(F.lit(float(coverage * genome_size)) / F.col("_bases"), F.lit(1.0))
    place = text_order(F.col("read_id"), seed) / F.lit(float(1 << 63))
    return reads.crossJoin(F.broadcast(bases)).where(place < share).drop("_bases")


def repeated_metrics(df: DataFrame, sizes: list[int], rounds: int = 5, seed: int = 1, label: str = "is_true", predicted: str = "predicted", score: str = "score", key: str | None = None) -> DataFrame:
    """For each size, ``rounds`` draws of that many rows of each class; mean and sd of the metrics.
    Rounds and sizes are columns of one plan; a ``key`` of rows makes draws that other engines repeat. Each round has its own hash order; counts of hash ranges say
    which ranges the draw needs, and only their rows are dealt."""
    drawn = df.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    order = text_order(F.concat_ws("/", F.col("round").cast("string"), F.col(key).cast("string")), seed) if key else F.xxhash64(F.lit(seed), "round", *df.columns).bitwiseAND((1 << 63) - 1)
    drawn = ranked(drawn, order, by=("round", label), most=F.lit(max(sizes)))
    drawn = drawn.withColumn("size", F.explode(F.array(*map(F.lit, sizes)))).where(F.col("rank") <= F.col("size")).drop("rank")
    runs = classification_metrics(drawn, label, predicted, ["size", "round"]).join(roc_auc(drawn, label, score, ["size", "round"]), ["size", "round"])
    return summarise_runs(runs, [c for c in runs.columns if c not in ("size", "round")], ["size"])


def _subsets(names: list[str], k: int, most: int, seed: int) -> list[tuple[str, ...]]:
    """Up to ``most`` of the k-subsets of names, drawn with a seed."""
    rng = random.Random(f"{seed}/{k}")
    if comb(len(names), k) <= 4 * most:
        every = list(combinations(names, k))
        rng.shuffle(every)
        return every[:most]
    out: set[tuple[str, ...]] = set()
    while len(out) < most:
        out.add(tuple(sorted(rng.sample(names, k))))
    return sorted(out)


RUN_METRICS = ["n_sites", "n_truth", "n_both", "pearson", "r2", "spearman", "spearman_rounded", "rmse"]


def _runs(sites: DataFrame, truth: DataFrame, by: list[str]) -> DataFrame:
    """RUN_METRICS of each run of ``sites`` (by..., site, freq; written once) against the truth (site, freq)."""
    keys, sites = ["contig", "pos", "strand"], written(sites)
    pairs = sites.select(*by, *keys, F.col("freq").alias("x")).join(truth.select(*keys, F.col("freq").alias("y")), keys)
    stats = agreement(pairs, by=by, more={"spearman_rounded": half_up(F.col("y"), 100.0)})
    n = sites.groupBy(*by).agg(F.count("*").alias("n_sites")).crossJoin(F.broadcast(truth.agg(F.count("*").alias("n_truth"))))
    return n.join(stats, by)


def _truth(truth: DataFrame | list[DataFrame]) -> DataFrame:
    """One truth table, or the mean of several by site."""
    if isinstance(truth, DataFrame):
        return truth
    both = reduce(DataFrame.unionByName, [t.select("contig", "pos", "strand", "freq") for t in truth])
    return both.groupBy("contig", "pos", "strand").agg(F.avg("freq").alias("freq"))


def coverage_effect(tables: dict[str, DataFrame], truth: DataFrame | list[DataFrame], most: int = 10, least_cov: int = 1, seed: int = 1) -> DataFrame:
    """For every number k of replicates, up to ``most`` of their k-subsets, drawn with a seed: RUN_METRICS
    of the pooled table against the truth (freq), then mean and sd by k. Subsets are a small table; one
    aggregate by subset and site."""
    truth, names = _truth(truth), sorted(tables)
    rows = [(i, k, n) for k in range(1, len(names) + 1) for i, c in enumerate(_subsets(names, k, most, seed)) for n in c]
    subsets = truth.sparkSession.createDataFrame(rows, "subset int, k int, replicate string")
    tagged = reduce(DataFrame.unionByName, [tables[n].select("contig", "pos", "strand", "coverage", "n_mod").withColumn("replicate", F.lit(n)) for n in names])
    pooled = tagged.join(F.broadcast(subsets), "replicate").groupBy("k", "subset", "contig", "pos", "strand").agg(F.sum("coverage").alias("coverage"), F.sum("n_mod").alias("n_mod"))
    pooled = pooled.where(F.col("coverage") >= least_cov).withColumn("freq", F.col("n_mod") / F.col("coverage"))
    return summarise_runs(_runs(pooled, truth, ["k", "subset"]), RUN_METRICS, ["k"])


def coverage_sweep(calls: DataFrame, truth: DataFrame | list[DataFrame], coverages: list[float], seeds: list[int], genome_size: int,
                   read_length: int = 1, prob: str = "prob_1", mode: str = "count") -> DataFrame:
    """Reads subsampled to each coverage with each seed, their sites by count or aggregate mode held against
    the truth: mean and sd of RUN_METRICS by coverage. Coverage and seed are columns of one plan, whatever the number of
    runs; in aggregate mode they are keys of the windows too. A call's share is compared with the largest one before
    it meets the runs."""
    spark, truth = calls.sparkSession, _truth(truth)
    grid = [(float(c), int(s)) for c in coverages for s in seeds]
    n_reads = calls.agg(F.count_distinct("read_id").alias("_reads"))
    share = F.least(F.col("target") * F.lit(float(genome_size)) / (F.col("_reads") * F.lit(float(read_length))), F.lit(1.0))
    place = lambda s: text_order(F.col("read_id"), s) / F.lit(float(1 << 63))
    runs = spark.createDataFrame(grid, "target double, seed int").crossJoin(n_reads).withColumn("_share", share).drop("_reads")
    best = runs.groupBy().agg(F.max("_share").alias("_most"))
    # A read that no seed gives a place below the largest share is in no run.
    hope = F.least(*[place(s) for s in sorted({s for _, s in grid})], F.lit(2.0))
    near = calls.crossJoin(F.broadcast(best)).where(hope < F.col("_most")).drop("_most")
    kept = near.crossJoin(F.broadcast(runs)).where(place(F.col("seed")) < F.col("_share")).drop("_share")
    if mode == "count":
        sites = kept.groupBy("target", "seed", "contig", "pos", "strand").agg(F.count("*").alias("coverage"), F.count_if(F.col(prob) > 0.5).alias("n_mod"))
    elif mode == "aggregate":
        sites = site_frequency_aggregate(kept, prob=prob, runs=["target", "seed"])
    else:
        raise ValueError(f"unknown mode: {mode}")
    sites = sites.withColumn("freq", F.col("n_mod") / F.col("coverage"))
    return summarise_runs(_runs(sites, truth, ["target", "seed"]), RUN_METRICS, ["target"])
