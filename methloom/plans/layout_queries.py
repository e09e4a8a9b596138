"""Queries that write a layout, read it again and compare every row; and expressions and frames that no other query has."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calls as X
from ..functions import sequence as Q
from ..operators import filters, joins, sampling, sites, windows
from ..sources import readers, writers
from . import fixtures as fx
from .alignment_queries import CHUNK, FITTING, RC, REV, A, R, _aligned, _kinetics, _reference, _thousandths, _window
from .call_queries import C, S, _freq
from .registry import query

HAP = "(doc_id % 3)::int"
FORWARD = f"(case when {REV} then {RC.format(s='seq')} else seq end)"


def _recorded(spark, d):
    """Alignments as a file of alignments has them, with tags as text."""
    df = _kinetics(_aligned(spark, d)).withColumn("hap", (F.col("doc_id") % 3).cast("int"))
    codes = F.concat(F.lit("B:C,"), F.array_join(F.transform("fi", lambda x: x.cast("string")), ","))
    tags = F.map_from_arrays(F.array(F.lit("fi"), F.lit("HP")), F.array(codes, F.concat(F.lit("i:"), F.col("hap").cast("string"))))
    none = {c: F.lit(None).cast(t) for c, t in (("mate_contig", "string"), ("mate_start", "long"), ("tlen", "long"), ("qual", "string"))}
    return df.withColumns({"tags": tags, **none})


@query(f"""select read_id, flag::int as flag, contig, start, mapq::int as mapq, cigar, {FORWARD} as seq, ref_end, {HAP} as hap,
    array_to_string(list_transform(range(0, length(seq)), lambda i: cast((doc_id * 31 + i * 17) % 256 as varchar)), ',') as fi from {A}""")
def s1_alignments(spark, d):
    """Alignments and tags written as text and read again."""
    path = fx.scratch(spark)
    writers.write_alignments(_recorded(spark, d), ["@HD\tVN:1.6"], path)
    got = readers.read_alignments(spark, path)
    return got.select("read_id", "flag", "contig", "start", "mapq", writers._cigar_text(F.col("cigar")).alias("cigar"), "seq", "ref_end", "hap", F.array_join(F.transform("fi", lambda x: x.cast("string")), ",").alias("fi"))


MAPPED = f"(select read_id, seq from {A} where (flag & 2308) = 0) m"


def _fasta(spark, d):
    path = fx.scratch(spark)
    writers.alignments_to_fasta(_recorded(spark, d), f"{path}/fa", f"{path}/ids")
    return path


@query(f"select read_id as contig, k as chunk_start, substring(seq, (k + 1)::int, {CHUNK + 2}) as seq from (select *, unnest(range(0, length(seq), {CHUNK})) as k from {MAPPED}) q")
def s3_reference_chunks(spark, d):
    """Mapped reads as FASTA, a line each, read as chunks of a reference."""
    return readers.read_reference(spark, f"{_fasta(spark, d)}/fa", CHUNK, 2)


@query(f"select read_id as contig, length(seq)::bigint as length from {MAPPED}")
def s4_contig_lengths(spark, d):
    path = _fasta(spark, d)
    lengths = readers.contig_lengths(readers.read_reference(spark, f"{path}/fa", 1000, 10))
    return lengths.join(readers.read_contig_names(spark, f"{path}/fa/"), "contig", "left_semi")


@query(f"""with {FITTING} select contig, start + (case when q < 15 then q - 5 when q < 25 then q - 7 else q - 4 end) as pos, case when {REV} then '-' else '+' end as strand, read_id, i::int as loc,
    substring(seq, i - 9, 21) as f_kmer, 7 as f_pass, {_window(0, "i")} as f_ipd, {_window(3, "(n - 2 - i)")} as r_pw, 1 as label from p where q >= 5 and q not in (15, 16)""")
def s5_features(spark, d):
    """Features of both strands written as text with lists, missing values as dots, and read again."""
    got = sites.extract_features(filters.filter_alignments(_kinetics(_aligned(spark, d))), ["CG"]).where("pos >= 0")
    none = F.lit(None).cast("string")
    sides = [[F.col(f"{s}_kmer"), F.lit(7).alias(f"{s}_pass"), F.col(f"{s}_ipd"), none.alias(f"{s}_ipd_sd"), F.col(f"{s}_pw"), none.alias(f"{s}_pw_sd"), none.alias(f"{s}_sn"), none.alias(f"{s}_map")] for s in "fr"]
    path = fx.scratch(spark)
    writers.write_features(got.select("contig", "pos", "strand", "read_id", "loc", *sides[0], *sides[1], "label"), path, gzip=True)
    back = readers.read_features(spark, path)
    return back.select("contig", "pos", "strand", "read_id", "loc", "f_kmer", "f_pass", _thousandths("f_ipd").alias("f_ipd"), _thousandths("r_pw").alias("r_pw"), "label")


@query(f"select contig, pos, strand, coverage, n_mod as met, floor(n_mod / coverage::double * 1e6 + 0.5) / 1e6 as freq from {S}")
def s9_bisulfite_report(spark, d):
    path = fx.scratch(spark)
    df = fx.sitefreq(spark, d).select("contig", "pos", "strand", F.col("n_mod").alias("met"), (F.col("coverage") - F.col("n_mod")).alias("unmet"), F.lit("CG").alias("motif"), F.lit("CGA").alias("context"))
    writers.write_features(df, path)
    return readers.read_bs_report(spark, path).select("contig", "pos", "strand", "coverage", "met", X.half_up(F.col("freq"), 1e6).alias("freq"))


@query(f"select read_id, 'HP:i:' || cast({HAP} as varchar) as comment, seq, repeat('!', length(seq)) as qual from {A}")
def s10_fastq(spark, d):
    """Alignments as FASTQ in sequenced orientation, and back."""
    path = fx.scratch(spark)
    writers.alignments_to_fastq(_recorded(spark, d), path, ["HP"])
    return readers.read_fastq(spark, path)


@query(f"select distinct read_id, case when hap = 1 then 'HP1' else 'HP2' end as hap from {C} where hap in (1, 2)")
def s11_haplotype_lists(spark, d):
    path = fx.scratch(spark)
    names = F.when(F.col("hap") == 1, "H1").when(F.col("hap") == 2, "H2").otherwise("none")
    fx.calls(spark, d).select(F.col("read_id").alias("read"), names.alias("haplotype"), F.lit("1").alias("phase_set"), "contig").write.options(sep="\t", header="true").csv(path)
    return readers.read_haplotypes(spark, path)


@query(f"select contig, pos from {S} where coverage >= 6 group by 1, 2")
def s11_position_lists(spark, d):
    path = fx.scratch(spark)
    fx.sitefreq(spark, d).where("coverage >= 6").select("contig", "pos").write.options(sep="\t").csv(path)
    return readers.read_keys(spark, path, "contig string, pos long")


@query(f"select contig, pos, strand, coverage::int as near, 2 as n_offsets, p0_sum + 2 * p1_sum as weight, n_mod / coverage::double as label from {S}")
def s12_window_features(spark, d):
    """Windows written with lists of lists, and read again."""
    path = fx.scratch(spark)
    joined = lambda *c: F.concat_ws(",", *[F.col(x).cast("string") for x in c])
    df = _freq(fx.sitefreq(spark, d)).select("contig", "pos", "strand", joined("coverage", "n_mod").alias("offsets"), F.concat_ws(";", joined("p0_sum", "p1_sum"), joined("p1_sum")).alias("hists"), joined("coverage").alias("coverages"), F.col("freq").alias("label"))
    writers.write_features(df, path)
    got = readers.read_window_features(spark, path)
    weight = F.col("hists")[0][0] + F.col("hists")[0][1] + F.col("hists")[1][0]
    return got.select("contig", "pos", "strand", F.col("offsets")[0].alias("near"), F.size("offsets").alias("n_offsets"), weight.alias("weight"), "label")


HAP_ROWS = f"select cast(hap as varchar) as hap, contig, pos, strand, count(*) as coverage from {C} where hap in (1, 2) group by 1, 2, 3, 4 union all select 'all', contig, pos, strand, count(*) from {C} group by 2, 3, 4"


@query(HAP_ROWS)
def k5_by_haplotype(spark, d):
    """Frequencies written to a folder a haplotype, read from the folders."""
    path = fx.scratch(spark)
    writers.write_by_hap(sites.site_frequency_count(fx.calls(spark, d), by_hap=True), path)
    return spark.read.parquet(path).select(F.col("hap").cast("string").alias("hap"), "contig", "pos", "strand", "coverage")


@query(f"select count(*) as n, sum(coverage)::bigint as coverage, 0::bigint as n_out_of_order from {S}")
def k6_merged_contigs(spark, d):
    """Sites written to a folder a contig and merged in the order of a header, not of names."""
    path, order = fx.scratch(spark), ["chr4", "chr1", "chr5", "chr3", "chr2"]
    writers.write_by_contig(fx.sitefreq(spark, d), path)
    ranks = spark.createDataFrame([(c, i) for i, c in enumerate(order)], "contig string, rank int")
    got = sampling.out_of_order(writers.merged_by_contig(spark, path, ranks), F.struct(F.array_position(F.array(*map(F.lit, order)), F.col("contig")), "pos", "strand"))
    return got.agg(F.count("*").alias("n"), F.sum("coverage").alias("coverage"), F.sum("out_of_order").alias("n_out_of_order"))


@query(f"select read_id, string_agg(cast(ml as varchar), ',' order by read_loc, ml) as mls from {C} where read_id in (select read_id from {C} where pos % 5 = 0) group by read_id")
def k9_looked_up_reads(spark, d):
    """Call lists of reads, sorted by read for lookup; the lists of some reads."""
    path, calls = fx.scratch(spark), fx.calls(spark, d)
    lists = calls.groupBy("read_id").agg(F.array_sort(F.collect_list(F.struct("read_loc", "ml"))).alias("calls"))
    writers.write_read_calls(lists, path)
    some = joins.restrict_reads(spark.read.parquet(path), calls.where("pos % 5 = 0"))
    return some.select("read_id", F.array_join(F.transform("calls", lambda c: c["ml"].cast("string")), ",").alias("mls"))


@query(f"""select contig, pos, read_id, read_loc, floor((1 - b) * 1e6 + 0.5) / 1e6 as prob_0, b as prob_1, case when y > x then 1 else 0 end as label, substring(kmer, 3, 5) as kmer
  from (select *, floor(y / (x + y) * 1e6 + 0.5) / 1e6 as b from (select *, depth + 0.5e0 as x, ml + 0.25e0 as y, 'ACGT' || substring(read_id || 'ACGTA', 4, 5) as kmer from {C}) q) q""")
def x16_calls_of_scores(spark, d):
    df = fx.calls(spark, d).withColumn("kmer", F.concat(F.lit("ACGT"), F.substring(F.concat("read_id", F.lit("ACGTA")), 4, 5)))
    got = df.select("contig", "pos", "read_id", "read_loc", X.call_of_scores(F.col("depth") + 0.5, F.col("ml") + 0.25, F.col("kmer")).alias("c"))
    return got.select("contig", "pos", "read_id", "read_loc", "c.*")


@query(f"""select read_id, back, array_to_string(list_transform(range(1, length(seq) + 1), lambda i: case when at(i) >= 1 and substring(seq, at(i)::int, 2) = 'CG' and (at(i) - 1) % 3 = 1 then (case when back then 'A' else 'T' end)
      when at(i) >= 1 and substring(seq, at(i)::int, 2) = 'CG' and (at(i) - 1) % 3 = 0 then 'N' else substring(seq, i::int, 1) end), '') as projected
  from (select read_id, seq, doc_id % 2 = 1 as back from {R}) q""".replace("at(i)", "(i - case when back then 1 else 0 end)"))
def x23_bisulfite_projection(spark, d):
    """Of a read's CG sites two thirds are called, half of those as unmodified; projected on the read's own text."""
    df = fx.reads(spark, d).withColumn("back", F.col("doc_id") % 2 == 1).withColumn("_h", Q.motif_hits("seq", ["CG"]))
    called, bare = F.filter("_h", lambda i: i % 3 != 0), F.filter("_h", lambda i: i % 3 == 1)
    return df.select("read_id", "back", X.bisulfite(F.col("seq"), called, bare, F.col("back")).alias("projected"))


@query(f"""with e as (select read_id as contig, seq, unnest(range(0, length(seq), {CHUNK})) as edge from {R} where length(seq) > 0),
  m as (select contig, length(seq) as n, edge + case when edge > 0 and substring(seq, edge::int, 2) = 'CG' then 1 else 0 end as start from e)
  select contig, start, stop as "end" from (select contig, start, coalesce(lead(start) over (partition by contig order by start), n)::bigint as stop from m) q where start < stop""")
def w8_contig_chunks(spark, d):
    return windows.contig_chunks(_reference(spark, d), CHUNK)
