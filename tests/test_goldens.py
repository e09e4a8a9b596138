"""Hand-made reads: reverse strand, indels, clips, tags, motifs at the ends."""

import random

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from methloom.functions import calls as X
from methloom.functions import cigar as C
from methloom.functions import modtags as M
from methloom.functions import sequence as Q
from methloom.functions import signal as S
from methloom.operators import filters, joins, reads, sampling, scoring, sites, windows
from methloom.sources import readers, writers


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_reverse_complement_twice_is_identity_and_unknown_letters_are_n(spark):
    r = one(spark, a=Q.reverse_complement(Q.reverse_complement(F.lit("ACGTRYSWKMBDHVN"))), b=Q.reverse_complement(F.lit("AC-X")))
    assert (r.a, r.b) == ("ACGTRYSWKMBDHVN", "NNGT")


def test_overlapping_motifs_and_ends(spark):
    assert list(one(spark, h=Q.motif_hits(F.lit("AAAA"), ["AA"])).h) == [0, 1, 2]
    assert list(one(spark, h=Q.motif_hits(F.lit("CGTTCG"), ["CG"])).h) == [0, 4]
    assert list(one(spark, h=Q.motif_hits(F.lit("C"), ["CG"])).h) == []
    assert Q.expand_motifs("CHG") == ["CAG", "CCG", "CTG"]
    with pytest.raises(ValueError):
        Q.expand_motifs("CG,CHG")


def test_frames_and_normalisation(spark):
    codes = F.array(*map(F.lit, [0, 63, 64, 127, 128, 191, 192, 255]))
    assert list(one(spark, f=S.frames(codes)).f) == [0, 63, 64, 190, 192, 444, 448, 952]
    flat = F.array(F.lit(5), F.lit(5))
    for method in ("zscore", "min-max", "mad"):
        assert list(one(spark, n=S.normalised(flat, method)).n) == [0.0, 0.0]
    assert list(one(spark, n=S.normalised(F.array(F.lit(1), F.lit(3)), "zscore")).n) == [-1.0, 1.0]


def test_cigar_walk(spark):
    b = C.blocks(C.parse(F.lit("2S3=1I2X2D1=1H")))
    r = one(spark, p=F.transform(F.sequence(F.lit(0), F.lit(8)), lambda q: C.to_reference(b, q)), n=C.reference_length(C.parse(F.lit("2S3=1I2X2D1=1H"))), i=C.identity(C.parse(F.lit("2S3=1I2X2D1=1H"))))
    assert list(r.p) == [None, None, 0, 1, 2, None, 3, 4, 7]
    assert r.n == 8
    assert r.i == pytest.approx(4 / 9)


def test_map_codes_insertion_mismatch_deletion(spark):
    walk = C.blocks(C.parse(F.lit("2=1I2=1D2=")))
    seq, ref = F.lit("ACTGTAA"), F.lit("ACGCTAA")  # read: AC T GT AA; reference: AC GC T AA
    codes = C.map_codes(walk, F.lit(3), 4, F.lit(7), seq, ref)
    assert list(one(spark, c=codes).c) == [1, 0, 0, 1, 0, 4, 2, 0, 1]


def test_tags_round_trip(spark):
    seq = F.lit("ACGTCCGCG")
    locs = F.array(F.lit(1), F.lit(5), F.lit(7))
    skips = M.encode_skips(locs, seq)
    mm = M.mm_text(skips)
    ml = F.array(F.lit(0), F.lit(128), F.lit(255))
    r = one(spark, mm=mm, f=M.decode(mm, ml, seq, F.lit(False)), r=M.decode(mm, ml, seq, F.lit(True)), bad=M.encode_skips(F.array(F.lit(0)), seq))
    assert r.mm == "C+m?,0,1,0;"
    assert [c.loc for c in r.f] == [1, 5, 7] and [c.loc for c in r.r] == [7, 3, 1]
    assert [c.prob for c in r.f] == [0.0, 0.500001, 0.996095]
    assert r.bad is None
    plain = one(spark, c=M.decode(F.lit("A+a,1;C+m,0,1,0;"), ml, seq, F.lit(False)), short=M.decode(mm, F.array(F.lit(1)), seq, F.lit(False)), far=M.decode(F.lit("C+m,9;"), F.array(F.lit(1)), seq, F.lit(False)))
    assert [c.loc for c in plain.c] == [1, 5, 7]
    assert plain.short == [] and plain.far == []


def test_bytes_of_probabilities(spark):
    rows = spark.range(256).select("id", M.probability_byte(M.byte_probability(F.col("id"))).alias("b")).collect()
    assert all(r.id == r.b for r in rows)


def test_bisulfite_projection(spark):
    r = one(spark, f=X.bisulfite(F.lit("ACGCGCG"), F.array(F.lit(1), F.lit(3)), F.array(F.lit(3)), F.lit(False)),
            r=X.bisulfite(F.lit("ACGCG"), F.array(F.lit(1)), F.array(F.lit(1)), F.lit(True)))
    assert r.f == "ACGTGNG"
    assert r.r == "ACACN"


def test_fold_drops_reverse_zero(spark):
    df = spark.createDataFrame([("c", 0, "-"), ("c", 1, "-"), ("c", 0, "+")], "contig string, pos long, strand string")
    assert sorted(tuple(r) for r in sites.fold_strands(df).collect()) == [("c", 0, "+"), ("c", 0, "+")]


def test_merge_one_strand_bisulfite(spark):
    df = spark.createDataFrame([("c", 5, "+", 3, 1), ("c", 9, "-", 0, 2), ("c", 20, "+", 0, 0)], "contig string, pos long, strand string, met long, unmet long")
    got = sorted(tuple(r) for r in sites.merge_strands(df, "bisulfite").collect())
    assert got == [("c", 5, 4, 3, 0.75), ("c", 8, 2, 0, 0.0)]


def test_count_mode_with_ambiguous_calls(spark):
    df = spark.createDataFrame([("c", 1, "+", p) for p in (0.9, 0.8, 0.1, 0.55)], "contig string, pos long, strand string, prob_1 double")
    r = sites.site_frequency_count(df, 0.2).first()
    assert (r.coverage, r.n_mod) == (4, 2.67) and r.freq == pytest.approx(2 / 3)
    r = sites.site_frequency_count(df, 0.2, no_amb_cov=True).first()
    assert (r.coverage, r.n_mod) == (3, 2.0)


def test_neighbour_windows_edges_and_close(spark):
    df = spark.createDataFrame([("c", "+", p, 4, [1.0, 0.0]) for p in (10, 12, 20)], "contig string, strand string, pos long, coverage long, hist array<double>")
    got = {r.pos: r for r in windows.neighbour_windows(df, 3, bins=2).collect()}
    assert list(got[10].offsets) == [1000, 0, 2] and list(got[20].offsets) == [8, 0, 1000]
    assert got[10].hists == [[0.0, 0.0], [1.0, 0.0], [1.0, 0.0]]
    close = {r.pos: list(r.offsets) for r in windows.neighbour_windows(df, 3, only_close=True, bins=2).collect()}
    assert close == {10: [0, 0, 1], 12: [0, 1, 0], 20: [1, 0, 0]}


def test_contig_chunks_do_not_cut_a_motif(spark):
    df = spark.createDataFrame([("c", 0, "AAAACGAAAA"[:8]), ("c", 5, "GAAAA")], "contig string, chunk_start long, seq string")
    assert sorted(tuple(r) for r in windows.contig_chunks(df, 5).collect()) == [("c", 0, 6), ("c", 6, 10)]


def test_sam_round_trip(spark, tmp_path):
    sam = tmp_path / "a.sam"
    line = "r1\t16\tchr1\t11\t60\t2S3=\t*\t0\t0\tACGTA\tIIIII\tfi:B:C,1,2,3,4,5\tHP:i:2\tMM:Z:C+m?,0;\tML:B:C,200"
    sam.write_text(f"@HD\tVN:1.6\n{line}\nr2\t4\t*\t0\t0\t*\t*\t0\t0\tAC\t*\n")
    df = readers.read_alignments(spark, str(sam))
    r = {x.read_id: x for x in df.collect()}
    assert (r["r1"].start, r["r1"].hap, list(r["r1"].fi), list(r["r1"].ml), r["r1"].ref_end) == (10, 2, [1, 2, 3, 4, 5], [200], 13)
    assert r["r2"].contig is None and r["r2"].ml == [] and r["r2"].fn == 0
    writers.write_alignments(df, ["@HD\tVN:1.6"], str(tmp_path / "out"))
    text = [x for p in sorted((tmp_path / "out").glob("part*")) for x in p.read_text().splitlines()]
    assert text[:2] == ["@HD\tVN:1.6", "@PG\tID:methloom\tPN:methloom"]
    back = {x.read_id: x for x in readers.read_alignments(spark, str(tmp_path / "out")).collect()}
    assert back["r1"].tags == r["r1"].tags and back["r1"].cigar == r["r1"].cigar
    writers.alignments_to_fastq(df.where("read_id = 'r1'"), str(tmp_path / "fq"), tags=["HP"])
    fq = readers.read_fastq(spark, str(tmp_path / "fq")).first()
    assert tuple(fq) == ("r1", "HP:i:2", "TACGT", "IIIII")


def test_text_tables(spark, tmp_path):
    calls = spark.createDataFrame([("chr1", 5, "+", "m/1/ccs", 3, "4,6", 0.25, 0.75, 1, "ACGTA")], readers.CALLS)
    writers.write_calls(calls, str(tmp_path / "calls"), gzip=True)
    r = readers.read_calls(spark, str(tmp_path / "calls")).first()
    assert (r.pos, r.depth_f, r.depth_r, r.prob_1) == (5, 4, 6, 0.75)
    freq = sites.site_frequency(calls)
    writers.write_site_freq(freq, str(tmp_path / "freq"))
    assert readers.read_site_freq(spark, str(tmp_path / "freq")).first().freq == 1.0
    writers.write_bedmethyl(freq, str(tmp_path / "bed"))
    assert readers.read_bedmethyl(spark, str(tmp_path / "bed")).first().freq == 1.0
    (tmp_path / "bs.txt").write_text("chr1\t5\t+\t3\t1\tCG\tCGA\nchr1\t9\t-\t0\t0\tCG\tCGA\n")
    assert [x.freq for x in readers.read_bs_report(spark, str(tmp_path / "bs.txt")).orderBy("pos").collect()] == [0.75, 0.0]
    writers.write_by_hap(calls.withColumn("hap", F.lit(1)), str(tmp_path / "hap"))
    assert [p.name for p in (tmp_path / "hap").glob("hap=*")] == ["hap=1"]
    writers.write_by_contig(calls, str(tmp_path / "contig"))
    assert spark.read.parquet(str(tmp_path / "contig")).count() == 1


def test_features_with_dots(spark, tmp_path):
    side = ["ACG", "3", "1,2,3", ".", "4,5,6", ".", ".", "."]
    (tmp_path / "f.tsv").write_text("\t".join(["chr1", "7", "+", "r", "2", *side, *side, "1"]) + "\n")
    r = readers.read_features(spark, str(tmp_path / "f.tsv")).first()
    assert (r.pos, r.f_ipd, r.f_ipd_sd, r.r_pass, r.label) == (7, [1.0, 2.0, 3.0], None, 3, 1)
    (tmp_path / "w.tsv").write_text("chr1\t7\t+\t0,2\t0.5,0.5;1,0\t4,5\t0.5\n")
    assert readers.read_window_features(spark, str(tmp_path / "w.tsv")).first().hists == [[0.5, 0.5], [1.0, 0.0]]


def test_reference_chunks(spark, tmp_path):
    (tmp_path / "r.fa").write_text(">c1 first contig\nacgt\nACG\n>c2\nCG\n")
    ref = readers.read_reference(spark, str(tmp_path / "r.fa"), chunk_len=4, overlap=1)
    assert sorted(tuple(r) for r in ref.collect()) == [("c1", 0, "ACGTA"), ("c1", 4, "ACG"), ("c2", 0, "CG")]
    assert {r.contig: r.length for r in readers.contig_lengths(ref).collect()} == {"c1": 7, "c2": 2}
    got = sorted(tuple(r) for r in joins.reference_sites(ref, ["CG"]).collect())
    assert got == [("c1", 1, "+"), ("c1", 2, "-"), ("c1", 5, "+"), ("c1", 6, "-"), ("c2", 0, "+"), ("c2", 1, "-")]
    assert {r.contig for r in readers.read_contig_names(spark, str(tmp_path / "r.fa")).collect()} == {"c1", "c2"}
    assert {r.contig for r in readers.read_contig_names(spark, "a, b").collect()} == {"a", "b"}


def test_keys_and_haplotypes(spark, tmp_path):
    (tmp_path / "h.tsv").write_text("#read\thap\tps\tchr\nr1\tH1\t1\tchr1\nr2\tnone\t1\tchr1\n")
    assert [tuple(r) for r in readers.read_haplotypes(spark, str(tmp_path / "h.tsv")).collect()] == [("r1", "HP1")]
    assert {r.read_id for r in readers.read_keys(spark, "a,b,a").collect()} == {"a", "b"}
    bad = spark.createDataFrame([("r", "HP1"), ("r", "HP2")], "read_id string, hap string")
    with pytest.raises(ValueError):
        joins.assert_unique_haplotype(bad)


def test_observed_counters(spark):
    df = spark.createDataFrame([(1, 1), (0, 2)], "label int, hap int")
    out, watch = reads.observed(df)
    out.write.format("noop").mode("overwrite").save()
    assert watch.get == {"n_calls": 2, "n_modified": 1, "n_hap1": 1, "n_hap2": 1}


def test_balance_quotas(spark):
    pos = spark.createDataFrame([("A",)] * 6 + [("B",)] * 3 + [("C",)], "kmer string")
    neg = spark.createDataFrame([("A", i) for i in range(10)] + [("B", i) for i in range(2)] + [("D", i) for i in range(9)], "kmer string, i int")
    got = sampling.balance_by_kmer(neg, pos, seed=3)
    counts = {r.kmer: r["count"] for r in got.groupBy("kmer").count().collect()}
    assert got.count() == 10 and counts["A"] == 6 and counts["B"] == 2 and counts["D"] == 2
    assert got.distinct().count() == 10


def test_splits_keep_counts_and_reads_apart(spark):
    df = spark.createDataFrame([(f"r{i // 3}", i) for i in range(100)], "read_id string, i int")
    got = {r.split: r["count"] for r in sampling.train_valid_split(df.where("i < 50"), df.where("i >= 50"), 0.8).groupBy("split").count().collect()}
    assert got == {"train": 80, "valid": 20}
    both = sampling.split_by_read(df, 0.8).groupBy("read_id").agg(F.count_distinct("split").alias("n"))
    assert both.where("n > 1").count() == 0
    assert sampling.sample_n(df, 1000).count() == 100 and sampling.sample_n(df, 7).count() == 7


def test_filters_of_lists(spark):
    df = spark.createDataFrame([([1, 5],), ([1, 1],), ([],)], "depths array<int>")
    assert filters.filter_mean_depth(df, 3).count() == 1


def test_scores_to_calls_and_pushed_scores(spark):
    r = one(spark, c=X.call_of_scores(F.lit(1.0), F.lit(3.0), F.lit("AACCGTTGA")), u=X.pushed(F.lit(0.7), F.lit(10)), d=X.pushed(F.lit(0.3), F.lit(5)), m=X.pushed(F.lit(0.5), F.lit(3)))
    assert (r.c.prob_0, r.c.prob_1, r.c.label, r.c.kmer) == (0.25, 0.75, 1, "CCGTT")
    assert (r.u.n_mod, r.d.n_mod, r.m.n_mod) == (7.0, 1.0, 1.5)


def test_refilled_tags(spark):
    tags = F.create_map(F.lit("MM"), F.lit("Z:C+m,1;"), F.lit("fi"), F.lit("B:C,1"), F.lit("RG"), F.lit("Z:a"))
    new = M.refill_tags(tags, F.lit("C+m?,0;"), F.array(F.lit(7)))
    kept = M.refill_tags(tags, F.lit(None).cast("string"), F.array(F.lit(7)), drop_pulse=False)
    r = one(spark, new=new, kept=kept)
    assert r.new == {"RG": "Z:a", "MM": "Z:C+m?,0;", "ML": "B:C,7"} and r.kept == {"RG": "Z:a", "fi": "B:C,1"}


def test_features_of_forward_and_reverse_reads(spark):
    # 2 clipped, 6 matched, a base put in, 3 matched; the CG at 5 of the sequenced read
    seq = "TTACACGTATAC"
    rows = [("f", 0, "c", 100, "2S6=1I3=", seq), ("r", 16, "c", 100, "2S6=1I3=", seq)]
    df = spark.createDataFrame(rows, "read_id string, flag int, contig string, start long, cigar string, seq string")
    got = {r.read_id: r for r in sites.extract_features(df, ["CG"], seq_len=5).collect()}
    assert (got["f"].loc, got["f"].pos, got["f"].strand, got["f"].f_kmer, got["f"].r_kmer) == (5, 103, "+", "CACGT", "TACGT")
    # on the reverse read the sequenced read is the reverse complement, its CG is at 5 and lies on base 6 of the alignment
    assert (got["r"].loc, got["r"].pos, got["r"].strand, got["r"].f_kmer) == (5, 104, "-", "TACGT")


def test_reference_and_reads_over_many_blocks(spark, tmp_path):
    """Contigs and records that lie across the blocks of a file come back whole."""
    rng = random.Random(3)
    contigs = {f"c{k}": "".join(rng.choice("acgtN") for _ in range(n)) for k, n in enumerate((1, 700, 3000, 64))}
    wrapped = lambda s, n: "\n".join(s[i : i + n] for i in range(0, len(s), n))
    (tmp_path / "r.fa").write_text("".join(f">{name} text\n{wrapped(s, 61)}\n" for name, s in contigs.items()))
    reads = [(f"r{i}", "".join(rng.choice("ACGT") for _ in range(rng.randrange(1, 90)))) for i in range(60)]
    (tmp_path / "r.fq").write_text("".join(f"@{n} c{n}\n{s}\n+\n{'@' * len(s)}\n" for n, s in reads))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = {(r.contig, r.chunk_start): r.seq for r in readers.read_reference(spark, str(tmp_path / "r.fa"), 100, 7).collect()}
        assert got == {(n, k): s.upper()[k : k + 107] for n, s in contigs.items() for k in range(0, len(s), 100)}
        back = readers.read_fastq(spark, str(tmp_path / "r.fq")).collect()
        assert sorted((r.read_id, r.comment, r.seq, r.qual) for r in back) == sorted((n, f"c{n}", s, "@" * len(s)) for n, s in reads)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def test_window_chunks_are_seamless(spark):
    rng = random.Random(4)
    rows = [(c, p, s, rng.randrange(3, 9), [float(rng.randrange(5)) for _ in range(20)]) for c in ("a", "b") for s in "+-" for p in sorted(rng.sample(range(0, 5_000_000, 1000), 60))]
    df = spark.createDataFrame(rows, "contig string, pos long, strand string, coverage int, hist array<double>")
    for only_close in (False, True):
        whole = {tuple(r[:3]): (r.offsets, r.hists) for r in windows.neighbour_windows(df, only_close=only_close).collect()}
        cut = {tuple(r[:3]): (r.offsets, r.hists) for r in windows.neighbour_windows(df, only_close=only_close, chunk=7).collect()}
        assert whole == cut and len(cut) == 240
    sites_ = df.select("contig", "pos", F.col("coverage").alias("n"), F.lit(1).alias("x")).where("strand = '+'")
    smooth = lambda w: {(r.contig, r.pos): r.level for r in windows.smooth_sites(sites_, 300_000, w).collect()}
    assert smooth(200_000) == smooth(10**9)
    keyed = df.select("contig", "strand", "pos")
    gaps = lambda w: {tuple(r[:3]): r.gap for r in windows.position_gaps(keyed, ["contig", "strand"], width=w).collect()}
    islands = lambda w: {tuple(r[:3]): r.island for r in windows.assign_islands(keyed, ["contig", "strand"], gap=60_000, width=w).collect()}
    assert gaps(50_000) == gaps(10**9) and islands(50_000) == islands(None)


def test_layouts_and_lookups(spark, tmp_path):
    """The older site-frequency layouts, features and read calls written and read, FASTA of mapped reads."""
    (tmp_path / "v10.tsv").write_text("chr1\t5\t+\t1.5\t2.5\t3\t1\t4\t0.75\tCGA\n")
    (tmp_path / "o11.tsv").write_text("chr1\t5\t-\t77\t1.5\t2.5\t3\t1\t4\t0.75\t.\n")
    old, offset = (readers.read_site_freq(spark, str(tmp_path / f), k).first() for f, k in (("v10.tsv", "v10"), ("o11.tsv", "offset11")))
    assert (old.pos, old.p1_sum, old.coverage, old.kmer) == (5, 2.5, 4, "CGA") and (offset.pos_in_strand, offset.freq, offset.kmer) == (77, 0.75, None)
    side = {c: v for c, v in zip(readers.STRAND_FIELDS, ("ACG", 3, [1.0, 2.0], None, [4.0], None, [0.5], None), strict=True)}
    kinds = dict(zip(readers.STRAND_FIELDS, ("string", "int", *["array<double>"] * 6), strict=True))
    schema = "contig string, pos long, strand string, read_id string, loc int, " + ", ".join(f"{s}{c} {kinds[c]}" for s in ("f_", "r_") for c in side) + ", label int"
    features = spark.createDataFrame([("chr1", 7, "+", "r", 2, *side.values(), *side.values(), 1)], schema)
    writers.write_features(features, str(tmp_path / "features"), gzip=True)
    assert readers.read_features(spark, str(tmp_path / "features")).collect() == features.collect()
    lists = spark.createDataFrame([(f"r{k}", [(k, 0.5)]) for k in range(20)], "read_id string, calls array<struct<loc:int,prob:double>>")
    writers.write_read_calls(lists, str(tmp_path / "lists"))
    assert sorted(spark.read.parquet(str(tmp_path / "lists")).collect()) == sorted(lists.collect())
    assert [r.calls[0].loc for r in spark.read.parquet(str(tmp_path / "lists")).where("read_id = 'r7'").collect()] == [7]
    reads_ = spark.createDataFrame([("a", 0, "ACG"), ("b", 16, "AAC"), ("c", 4, "TTT"), ("d", 256, "TTT")], "read_id string, flag int, seq string")
    writers.alignments_to_fasta(reads_, str(tmp_path / "fa"), str(tmp_path / "ids"))
    assert sorted(r.seq for r in readers.read_reference(spark, str(tmp_path / "fa")).collect()) == ["ACG", "GTT"]
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "ids")).collect()) == ["a", "b"]


def test_sql_hooks_and_regressor(spark):
    scoring.register_hooks(spark)
    assert [r.loc for r in spark.sql("select loc from motif_sites('CGACG', 'CG') order by loc").collect()] == [0, 3]
    v = [0.5, -1.0, 0.25, 2.0]
    want = float(scoring.Linear()(np.array([v]))[0])
    assert spark.createDataFrame([(v,)], "v array<double>").selectExpr("site_score(v) as s").first().s == pytest.approx(want)
    rows = [([abs(k) for k in range(-5, 6)], [[float(i % 7 == b) for b in range(4)] for _ in range(11)], (i % 7) / 7) for i in range(140)]
    df = spark.createDataFrame(rows, "offsets array<long>, hists array<array<double>>, freq double")
    model = scoring.fit_regressor(df, rounds=5)
    flat = [float(x) for x in rows[3][0]] + [x for h in rows[3][1] for x in h]
    assert model.predict(Vectors.dense(flat)) == pytest.approx(rows[3][2], abs=0.15)
