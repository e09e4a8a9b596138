"""Joins, ranks and choices where one key has most rows."""

import random

import pytest
from pyspark.sql import functions as F

from methloom.operators import joins, sampling, sites, windows
from methloom.sources import scratch, writers

SPAN = "contig string, start long, end long, name string"


def spans(seed, n, hot, prefix):
    rng = random.Random(seed)
    out = [("c1", 5_000 + rng.randrange(40), 5_050 + rng.randrange(40), f"{prefix}{i}") for i in range(hot)]
    return out + [(f"c{rng.randrange(3)}", s := rng.randrange(60_000), s + rng.randrange(0, 3_000), f"{prefix}x{i}") for i in range(n)]


@pytest.mark.parametrize(("hot_a", "hot_b"), [(3000, 3), (3, 3000), (300, 300), (0, 0)])
def test_overlaps_at_one_deep_locus(spark, hot_a, hot_b):
    a, b = spans(1, 150, hot_a, "a"), spans(2, 100, hot_b, "b")
    left, right = spark.createDataFrame(a, SPAN), spark.createDataFrame(b, SPAN).withColumnRenamed("name", "other")
    want = sorted((x[3], y[3]) for x in a for y in b if x[0] == y[0] and x[1] < y[2] and y[1] < x[2])
    for most in (100, 10_000_000):
        got = joins.overlap_join(left, right, 1_000, most)
        assert sorted((r.name, r.other) for r in got.select("name", "other").collect()) == want
        assert set(got.columns) == {"contig", "start", "end", "name", "r_start", "r_end", "other"}


def test_overlaps_of_long_and_short_intervals(spark):
    """Every pair once, whatever the levels of its two; a row is dealt to few bins, however long it is."""
    rng = random.Random(5)
    some = lambda n, p, most: [(f"c{rng.randrange(2)}", s := rng.randrange(3_000_000), s + int(10 ** rng.uniform(0, most)), f"{p}{i}") for i in range(n)]
    whole = [("c0", 0, 1 << 40, "whole")]
    for a, b in ((some(200, "a", 7) + whole, some(200, "b", 7) + whole), (some(100, "a", 7) + whole, some(300, "b", 0)), (some(300, "a", 0), some(100, "b", 6) + whole), (whole, [])):
        left, right = spark.createDataFrame(a, SPAN), spark.createDataFrame(b, SPAN).withColumnRenamed("name", "other")
        want = sorted((x[3], y[3]) for x in a for y in b if x[0] == y[0] and x[1] < y[2] and y[1] < x[2])
        for most in (60, 10_000_000):
            assert sorted((r.name, r.other) for r in joins.overlap_join(left, right, 10, most).collect()) == want


def test_rows_with_maps(spark):
    left = spark.createDataFrame(spans(1, 0, 30, "a"), SPAN).withColumn("tags", F.create_map(F.lit("k"), F.col("name")))
    right = spark.createDataFrame(spans(2, 0, 2, "b"), SPAN).drop("name")
    assert joins.overlap_join(left, right, 1_000, 10).count() == joins.overlap_join(left, right, 1_000).count() == 60


def test_a_deep_bin_is_cut_evenly(spark, monkeypatch):
    left = spark.createDataFrame(spans(1, 50, 20_000, "a"), SPAN)
    right = spark.createDataFrame(spans(2, 50, 2, "b"), SPAN)
    bins = lambda df: df.withColumn("_bin", F.floor(F.col("start") / 1_000))
    heavy = joins._heavy_bins(bins(left), bins(right), 1_000)
    assert [(r.contig, r["_bin"], r["_parts_a"], r["_parts_b"]) for r in heavy.collect()] == [("c1", 5, 20 + (bins(left).where("contig = 'c1' and _bin = 5").count() > 20_000), 1)]
    pairs = joins.overlap_join(left, right.select("contig", "start", "end"), 1_000, 1_000)
    assert "_in_a" in pairs._jdf.queryExecution().analyzed().toString()
    parts = left.where("contig = 'c1' and start < 6000").select(F.pmod(F.xxhash64(*left.columns, F.lit(5).cast("bigint")), F.lit(20)).alias("p")).groupBy("p").count().toPandas()["count"]
    assert len(parts) == 20 and parts.max() < 2 * parts.median()
    # A bin with rows of one side only is left whole; more heavy bins than may be broadcast are joined.
    assert joins._heavy_bins(bins(left), bins(right.where("contig = 'none'")), 1_000) is None
    monkeypatch.setattr(joins, "MOST_HEAVY", 0)
    assert joins.overlap_join(left, right.select("contig", "start", "end"), 1_000, 1_000).count() == pairs.count()


@pytest.fixture
def ranges_apart(spark):
    """Small ranges stay partitions of their own."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_shuffled_rows_of_sampled_ranges_are_in_order(spark, ranges_apart):
    df = spark.range(40_000).select("id", (F.col("id") / 7).alias("x"), F.lit("text").alias("s"))
    for seed in range(4):
        order = sampling.text_order(F.col("id").cast("string"), seed)
        got = sampling.out_of_order(sampling.shuffle_rows(df, order=order), order).agg(F.count("*").alias("n"), F.sum("x").alias("x"), F.sum("out_of_order").alias("bad"))
        row = got.first()
        assert (row.n, row.bad) == (40_000, 0) and row.x == pytest.approx(40_000 * 39_999 / 14)


def test_contigs_merged_over_sampled_ranges_are_in_order(spark, ranges_apart, tmp_path):
    names = ["c2", "c1", "c3"]
    df = spark.range(60_000).select(F.get(F.array(*map(F.lit, names)), (F.col("id") % 3).cast("int")).alias("contig"), F.xxhash64("id").alias("pos"), (F.col("id") % 7).alias("coverage"))
    writers.write_by_contig(df, f"file://{tmp_path}/sites")
    ranks = spark.createDataFrame([(c, i) for i, c in enumerate(names)], "contig string, rank int")
    for _ in range(4):
        merged = writers.merged_by_contig(spark, f"file://{tmp_path}/sites", ranks)
        got = sampling.out_of_order(merged, F.struct(F.array_position(F.array(*map(F.lit, names)), F.col("contig")), "pos"))
        assert tuple(got.agg(F.count("*"), F.sum("coverage"), F.sum("out_of_order")).first()) == (60_000, sum(i % 7 for i in range(60_000)), 0)


def test_rows_out_of_order_are_counted(spark):
    """Within partitions and at their seams, as rows stand; a null is never out of order, nor the row after it."""
    places = [5, 3, 4, None, 1, 0, 2, 7, 6, None, 8, 8]
    df = spark.createDataFrame(spark.sparkContext.parallelize([(i, x) for i, x in enumerate(places)], 3), "i int, x int")
    assert df.select(F.spark_partition_id()).distinct().count() == 3
    got = {r.i: r.out_of_order for r in sampling.out_of_order(df, F.col("x")).collect()}
    assert got == {i: int(i > 0 and None not in (x, places[i - 1]) and x < places[i - 1]) for i, x in enumerate(places)}


def test_ranks_within_groups(spark):
    rng = random.Random(4)
    rows = [(None if i % 50 == 0 else "big" if i % 5 else f"g{i % 3}", None if i % 97 == 0 else rng.randrange(400) / 7) for i in range(6_000)]
    got = {(r.g, r.x): (r.n, r["rank"]) for r in windows.average_rank(spark.createDataFrame(rows, "g string, x double"), "x", ["g"]).collect()}
    for g in {g for g, _ in rows}:
        xs = sorted((x for h, x in rows if h == g), key=lambda x: (x is not None, x or 0))
        places = {}
        for i, x in enumerate(xs):
            places.setdefault(x, []).append(i + 1)
        for x, at in places.items():
            assert got[g, x] == (len(at), sum(at) / len(at))
    # Each row of the plan's windows is of a range, or of the ranges of a group.
    plan = windows.average_rank(spark.createDataFrame(rows, "g string, x double"), "x", ["g"])._jdf.queryExecution().optimizedPlan().toString()
    assert all("_p" in line for line in plan.splitlines() if "Window [" in line)


def balanced(neg, pos, total, seed_order, kmer_order, frac, floor):
    up = (lambda x: int(x // 1)) if floor else (lambda x: -int(-x // 1))
    shares = {k: sum(p == k for p in pos) / len(pos) for k in set(pos)}
    quota = {k: q for k, s in shares.items() if (q := up(total * s)) > 0}
    by = {}
    for h, k, i in sorted((seed_order(i), k, i) for k, i in neg):
        by.setdefault(k, []).append((h, i))
    take = {k: min(len(v), quota[k]) if k in quota else 0 for k, v in by.items()}
    missing, free = total - sum(take.values()), [k for k in by if k not in quota]
    if free and missing > 0:
        each, given = (missing // len(free) if floor else -(-missing // len(free))), 0
        for k in sorted(free, key=lambda k: (kmer_order(k), k)):
            if given < frac * missing:
                take[k] = min(len(by[k]), each)
            given += min(len(by[k]), each)
    out = [i for k, v in by.items() for _, i in v[: take[k]]]
    rest = sorted(x for k, v in by.items() for x in v[take[k] :])
    return sorted(out + [i for _, i in rest[: max(0, total - len(out))]])


@pytest.mark.parametrize(("total", "frac", "floor"), [(None, 0.5, False), (900, 0.5, True), (900, 0.0, False), (1_700, 0.9, False), (5_000, 0.5, False), (10, 0.5, True)])
def test_balanced_kmers_with_a_hot_one(spark, total, frac, floor):
    rng = random.Random(9)
    kmer = lambda: "HOT" if rng.random() < 0.35 else f"k{int(rng.random() ** 3 * 300)}"
    neg, pos = [(kmer(), i) for i in range(2_000)], [kmer() for _ in range(700)]
    pos = [p for p in pos if hash(p) and p[-1] not in "13"]
    place = {i: rng.getrandbits(63) if i % 3 else rng.getrandbits(50) for _, i in neg}
    kplace = {k: rng.getrandbits(63) for k in {k for k, _ in neg}}
    df = spark.createDataFrame([(k, i, place[i], kplace[k]) for k, i in neg], "kmer string, i long, o long, ko long")
    kmers = spark.createDataFrame([(p,) for p in pos], "kmer string")
    lookup = F.create_map(*[F.lit(x) for k, v in kplace.items() for x in (k, v)])
    got = sampling.balance_by_kmer(df, kmers, total, floor=floor, random_frac=frac, order=F.col("o"), kmer_order=lookup[F.col("kmer")])
    assert sorted(r.i for r in got.collect()) == balanced(neg, pos, total or len(pos), place.get, kplace.get, frac, floor)
    assert got.columns == df.columns


def test_balanced_kmers_with_none(spark):
    df = spark.createDataFrame([("a", 1)], "kmer string, i long")
    assert sampling.balance_by_kmer(df.limit(0), df).count() == 0
    assert sampling.balance_by_kmer(df, df.limit(0)).count() == 0


def test_aggregate_mode_by_haplotype_and_run(spark):
    """Each haplotype and run has the rows that it has alone."""
    rng = random.Random(2)
    rows = [("c", rng.randrange(30) * 2, "+", rng.random(), rng.randrange(4), f"r{rng.randrange(2)}") for _ in range(900)]
    df = spark.createDataFrame(rows, "contig string, pos long, strand string, prob_1 double, hap int, run string")
    options = {"min_cov": 8, "prob_cf": 0.4, "bins": 10}
    key = lambda r: (r.pos, r.coverage, r.n_mod, round(r.freq, 9))
    for discrete in (True, False):
        whole = sites.site_frequency_aggregate(df, by_hap=True, runs=["run"], discrete=discrete, **options).collect()
        for run in ("r0", "r1"):
            for hap in (None, 1, 2):
                some = df.where((F.col("run") == run) & (F.lit(hap is None) | (F.col("hap") == (hap or 0))))
                alone = sites.site_frequency_aggregate(some, discrete=discrete, **options).collect()
                assert sorted(key(r) for r in whole if r.run == run and r.hap == hap) == sorted(map(key, alone)) and alone
    no_amb = {r.pos: r for r in sites.site_frequency_aggregate(df, min_cov=10**6, prob_cf=0.4, no_amb_cov=True).collect()}
    for pos, r in no_amb.items():
        p = [x[3] for x in rows if x[1] == pos and abs(2 * x[3] - 1) >= 0.4]
        assert (r.coverage, r.n_mod) == (len(p), sum(x > 0.5 for x in p))


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

    class Session:
        def __init__(self, **conf):
            self.conf = Conf({k.replace("_", "."): v for k, v in conf.items()})

    with pytest.raises(ValueError):
        scratch.scratch(Session(spark_master="spark://host:7077"))
    assert scratch.scratch(Session(spark_master="local[2]")).startswith("file://")
    s = Session(spark_master="spark://host:7077")
    s.conf["spark.checkpoint.dir"] = "hdfs://shared/x/"
    assert scratch.scratch(s).startswith("hdfs://shared/x/methloom-")
