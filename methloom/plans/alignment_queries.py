"""Queries over alignments and reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calls as X
from ..functions import cigar as C
from ..functions import modtags as M
from ..functions import walks as V
from ..functions import sequence as Q
from ..functions import signal as S
from ..operators import filters, joins, sampling, sites
from . import fixtures as fx
from .fixtures import D_ALIGNMENTS, D_READS
from .registry import query

A, R = f"({D_ALIGNMENTS}) a", f"({D_READS}) r"
REV = "(flag & 16) <> 0"
RC = "reverse(translate({s}, 'ACGT', 'TGCA'))"
SAMP = lambda *c: [F.col(x) for x in c]


def _text(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def _kinetics(df, cut: bool = False):
    """Kinetics of the fixture; with ``cut`` every third read lacks a value."""
    n = F.length("seq") - (F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0) if cut else F.lit(0))
    code = lambda k: lambda i: ((F.col("doc_id") * 31 + i * 17 + k * 5) % 256).cast("int")
    for k, name in enumerate(("fi", "ri", "fp", "rp")):
        df = df.withColumn(name, F.transform(F.sequence(F.lit(0), n - 1), code(k)))
    return df


def _aligned(spark, d):
    """Alignments whose seq is in alignment order (the fixture's is as sequenced)."""
    df = fx.alignments(spark, d)
    reverse = F.col("flag").bitwiseAND(16) != 0
    return df.withColumn("seq", F.when(reverse, Q.reverse_complement("seq")).otherwise(F.col("seq")))


@query(f"select read_id, contig, start, flag, mapq from {A} where (flag & 1284) = 0 and (flag & 2048) = 0 and mapq >= 10 and (length(seq) - 7) / (length(seq) - 2)::double >= 0.95e0")
def f1_filtered_alignments(spark, d):
    return filters.filter_alignments(fx.alignments(spark, d), 10, 0.95, keep_supplementary=False).select("read_id", "contig", "start", "flag", "mapq")


@query(f"select read_id, flag from {A} where flag in (0, 16) and mapq >= 5 and contig in ('chr1', 'chr2')")
def f2_primary_alignments(spark, d):
    return filters.filter_primary(fx.alignments(spark, d), 5, ["chr1", "chr2"]).select("read_id", "flag")


@query(f"select read_id, flag from {A} where (flag & (4 | 256 | 512 | 1024 | 2048)) = 0 and mapq >= 0")
def f3_qcfail_variant(spark, d):
    return filters.filter_alignments(fx.alignments(spark, d), 0, keep_supplementary=False, drop_qcfail=True).select("read_id", "flag")


@query(f"select read_id from {A} where doc_id % 3 <> 0")
def f4_complete_kinetics(spark, d):
    return filters.filter_complete_kinetics(_kinetics(fx.alignments(spark, d), cut=True)).select("read_id")


@query(f"select read_id, count(*) as n from (select read_id, length(seq) as n, unnest(range(0, length(seq))) as loc from {A}) x where loc between 10 and n - 11 and n - 2 - loc between 10 and n - 11 group by read_id")
def f5_window_fits(spark, d):
    df = fx.alignments(spark, d).select("read_id", F.length("seq").alias("n"), F.explode(F.sequence(F.lit(0), F.length("seq") - 1)).alias("loc"))
    return df.where(filters.window_fits(F.col("loc"), F.col("n"), 10, 1)).groupBy("read_id").agg(F.count("*").alias("n"))


@query(f"select read_id, length(seq)::bigint - 5 as n from {A}")
def f6_outside_clips(spark, d):
    df = fx.alignments(spark, d).withColumn("cigar", C.parse(F.col("cigar")))
    df = df.select("read_id", "cigar", "flag", F.length("seq").alias("n"), F.explode(F.sequence(F.lit(0), F.length("seq") - 1)).alias("loc"))
    ok = filters.outside_clips(F.col("loc"), F.col("n"), F.col("cigar"), F.col("flag").bitwiseAND(16) != 0)
    return df.where(ok).groupBy("read_id").agg(F.count("*").alias("n"))


@query(f"select read_id, length(seq)::bigint - 7 - 2 * 3 as n from {A}")
def f11_clipped_pairs(spark, d):
    df = fx.alignments(spark, d).select("read_id", V.walk(C.parse(F.col("cigar"))).alias("b"), F.sequence(F.lit(0), F.length("seq") - 1).alias("q"))
    return df.select("read_id", F.size(V.inner_places(F.col("b"), F.col("q"), 3, aligned=True)).cast("long").alias("n")).where("n > 0")


@query(f"select read_id, start, ref_end from {A} where contig = 'chr2' and ref_end > 1000 and start < 3000")
def f12_region(spark, d):
    return filters.filter_region(fx.alignments(spark, d), "chr2:1000-3000").select("read_id", "start", "ref_end")


@query(f"select read_id, length(seq) as n from {A} where length(seq) >= 300")
def f13_long_sequences(spark, d):
    return filters.filter_kmer_length(fx.alignments(spark, d), 300, "seq").select("read_id", F.length("seq").alias("n"))


@query(f"select read_id, {RC.format(s='seq')} as rc from {R}")
def x1_reverse_complement(spark, d):
    return fx.reads(spark, d).select("read_id", Q.reverse_complement("seq").alias("rc"))


@query(f"select read_id, array_to_string(list_filter(range(0, greatest(length(seq) - 2, 0)), lambda i: substring(seq, i + 1, 3) in ('CAA', 'CAC', 'CAG', 'CAT')), ',') as hits from {R}")
def x3_motif_hits(spark, d):
    return fx.reads(spark, d).select("read_id", _text(Q.motif_hits("seq", Q.expand_motifs("CAN"))).alias("hits"))


@query(f"select read_id, translate(seq, 'ACGT', '0123') as codes from {R}")
def x4_base_codes(spark, d):
    return fx.reads(spark, d).select("read_id", F.array_join(F.transform(Q.base_codes("seq"), lambda x: x.cast("string")), "").alias("codes"))


FRAMES = "(select read_id, list_transform(range(0, length(seq)), lambda i: (doc_id * 31 + i * 17) % 256) as c from {a})".format(a=A)
FRAME = "(case when c < 64 then c when c < 128 then 64 + (c - 64) * 2 when c < 192 then 192 + (c - 128) * 4 else 448 + (c - 192) * 8 end)"


@query(f"select read_id, sum({FRAME})::bigint as total, max({FRAME})::int as most from (select read_id, unnest(c) as c from {FRAMES} f) u group by read_id")
def x5_frames(spark, d):
    df = _kinetics(fx.alignments(spark, d)).withColumn("f", S.frames(F.col("fi")))
    return df.select("read_id", F.aggregate("f", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), F.array_max("f").alias("most"))


NORM = "floor(floor(({x}) * 1e6 + 0.5) / 1e6 * 1e3 + 0.5) / 1e3"


@query(f"""with u as (select read_id, i, {FRAME}::double as x from (select read_id, unnest(range(0, len(c))) as i, unnest(c) as c from {FRAMES} f) v),
  s as (select read_id, avg(x) as m, stddev_pop(x) as sd, min(x) as lo, max(x) as hi, median(x) as med from u group by read_id),
  k as (select u.read_id, median(abs(u.x - s.med)) / 0.6744897501960817e0 as mad from u join s using (read_id) group by u.read_id)
  select read_id, {NORM.format(x='(x - m) / sd')} as zscore, {NORM.format(x='(x - lo) / (hi - lo)')} as min_max, {NORM.format(x='(x - lo) / m')} as min_mean, {NORM.format(x='(x - med) / mad')} as mad
  from u join s using (read_id) join k using (read_id) where i = 10""")
def x6_normalised(spark, d):
    df = _kinetics(fx.alignments(spark, d)).withColumn("f", S.frames(F.col("fi")))
    pick = lambda m: X.half_up(F.get(S.normalised(F.col("f"), m), F.lit(10)), 1e3)
    return df.select("read_id", pick("zscore").alias("zscore"), pick("min-max").alias("min_max"), pick("min-mean").alias("min_mean"), pick("mad").alias("mad"))


@query(f"select read_id, floor((length(seq) - 7) / (length(seq) - 2)::double * 1e6 + 0.5) / 1e6 as identity, length(seq) - 4 as ref_length from {A}")
def x9_identity(spark, d):
    ops = C.parse(F.col("cigar"))
    return fx.alignments(spark, d).select("read_id", X.half_up(C.identity(ops), 1e6).alias("identity"), C.reference_length(ops).alias("ref_length"))


@query(f"""select read_id, sum(case when q < 5 or q in (15, 16) then 0 when q < 15 then q - 5 when q < 25 then q - 7 else q - 4 end)::bigint as total,
    count(*) filter (where q < 5 or q in (15, 16)) as unaligned from (select read_id, unnest(range(0, length(seq))) as q from {A}) x group by read_id""")
def x10_query_to_reference(spark, d):
    df = fx.alignments(spark, d).select("read_id", V.walk(C.parse(F.col("cigar"))).alias("b"), F.sequence(F.lit(0), F.length("seq") - 1).alias("q"))
    r = F.explode(V.to_references(F.col("b"), F.col("q")))
    return df.select("read_id", r.alias("r")).groupBy("read_id").agg(F.sum(F.coalesce("r", F.lit(0))).alias("total"), F.count_if(F.col("r").isNull()).alias("unaligned"))


@query(f"select read_id, substring(seq, (length(seq) - 21) // 2 + 1, 21) as kmer from {A}")
def x17_shrunk_kmers(spark, d):
    return fx.alignments(spark, d).select("read_id", X.shrink(F.col("seq"), 21, text=True).alias("kmer"))


#: Sites of filtered alignments with a window of 21 on both strands, and their read's frames; q: place in the alignment.
FITTING = f"""a as (select * from {A} where (flag & 1284) = 0 and mapq >= 1),
  k as (select *, length(seq)::int as n, {", ".join(f"list_transform(range(0, length(seq)), lambda j: {FRAME.replace('c ', 'cc ').replace('(c -', '(cc -')}::double) as x{k}".replace("cc", f"((doc_id * 31 + j * 17 + {k * 5}) % 256)") for k in range(4))} from a),
  m as (select *, {", ".join(f"list_avg(x{k}) as m{k}, list_aggregate(x{k}, 'stddev_pop') as s{k}" for k in range(4))} from k),
  h as (select *, unnest(list_filter(range(0, n - 1), lambda i: substring(seq, i + 1, 2) = 'CG')) as i from m),
  p as (select *, case when {REV} then n - 1 - i else i end as q from h where i between 10 and n - 11 and n - 2 - i between 10 and n - 11)"""


def _window(k: int, centre: str) -> str:
    """A normalised window in thousandths, as text."""
    value = f"floor(floor((x - m{k}) / s{k} * 1e6 + 0.5) / 1e6 * 1e3 + 0.5)"
    return f"array_to_string(list_transform(x{k}[{centre} - 9:{centre} + 11], lambda x: cast(cast({value} as bigint) as varchar)), ',')"


def _thousandths(c):
    return F.array_join(F.transform(c, lambda x: F.floor(x * 1e3 + 0.5).cast("string")), ",")


@query(f"""with {FITTING}
  select contig, case when q < 5 or q in (15, 16) then -1 else start + (case when q < 15 then q - 5 when q < 25 then q - 7 else q - 4 end) end as pos,
    case when {REV} then '-' else '+' end as strand, read_id, i::int as loc, substring(seq, i - 9, 21) as f_kmer, {RC.format(s='substring(seq, i - 8, 21)')} as r_kmer,
    {_window(0, "i")} as f_ipd, {_window(1, "(n - 2 - i)")} as r_ipd, {_window(2, "i")} as f_pw, {_window(3, "(n - 2 - i)")} as r_pw from p where q >= 5""")
def a1_extracted_features(spark, d):
    """Place, k-mers and all of each kinetics window, in thousandths."""
    got = sites.extract_features(filters.filter_alignments(_kinetics(_aligned(spark, d))), ["CG"])
    return got.select("contig", "pos", "strand", "read_id", "loc", "f_kmer", "r_kmer", *[_thousandths(c).alias(c) for c in ("f_ipd", "r_ipd", "f_pw", "r_pw")])


def _tagged(spark, d):
    """Alignments with MM and ML of a call on every CG: byte (31 doc_id + 17 place) mod 256."""
    df = _aligned(spark, d).withColumn("_f", joins.forward_sequence(_aligned(spark, d)))
    hits = Q.motif_hits("_f", ["CG"])
    df = df.withColumn("_h", hits).withColumn("mm", M.mm_text(M.encode_skips(F.col("_h"), F.col("_f"))))
    return df.withColumn("ml", F.transform("_h", lambda i: ((F.col("doc_id") * 31 + i * 17) % 256).cast("int"))).withColumn("hap", (F.col("doc_id") % 3).cast("int"))


PROJECTED = f"""(with h as (select *, length(seq) as n, unnest(list_filter(range(0, length(seq) - 1), lambda i: substring(seq, i + 1, 2) = 'CG')) as i from {A}),
  p as (select *, case when {REV} then n - 1 - i else i end as q from h)
  select read_id, contig, start + (case when q < 15 then q - 5 when q < 25 then q - 7 else q - 4 end) as pos, case when {REV} then '-' else '+' end as strand,
    ((doc_id * 31 + i * 17) % 256)::int as ml, (doc_id % 3)::int as hap from p where not (q < 5 or q in (15, 16)))"""


@query(f"select * from {PROJECTED} p")
def j13_projected_calls(spark, d):
    got = joins.project_calls(_tagged(spark, d))
    return got.select("read_id", "contig", "pos", "strand", M.probability_byte(F.col("prob")).alias("ml"), "hap")


#: A CIGAR of as many repeats as the read's number gives, with every kind of operation.
MIXED = "'3S' || repeat('7=2I1X3D', (doc_id % 5 + 1)::int) || cast(length(seq) - 3 - 10 * (doc_id % 5 + 1) as varchar) || '='"
MIXED_AT = """(case when q < 3 then null when q - 3 >= 10 * (doc_id % 5 + 1) then 11 * (doc_id % 5 + 1) + q - 3 - 10 * (doc_id % 5 + 1)
    when (q - 3) % 10 < 7 then (q - 3) // 10 * 11 + (q - 3) % 10 when (q - 3) % 10 = 9 then (q - 3) // 10 * 11 + 7 end)"""


def _mixed(df):
    k = (F.col("doc_id") % 5 + 1).cast("int")
    return df.withColumn("cigar", F.concat(F.lit("3S"), F.repeat(F.lit("7=2I1X3D"), k), (F.length("seq") - 3 - 10 * k).cast("string"), F.lit("=")))


@query(f"select read_id, cigar, sum(coalesce(r, 0))::bigint as total, count(*) filter (where r is null) as unaligned from (select read_id, {MIXED} as cigar, {MIXED_AT} as r from (select *, unnest(range(0, length(seq))) as q from {A}) x) y group by read_id, cigar")
def x10_mixed_cigars(spark, d):
    df = _mixed(fx.alignments(spark, d)).withColumn("b", V.walk(C.parse(F.col("cigar"))))
    r = V.to_references(F.col("b"), F.sequence(F.lit(0), F.length("seq") - 1))
    return df.select("read_id", "cigar", F.explode(r).alias("r")).groupBy("read_id", "cigar").agg(F.sum(F.coalesce("r", F.lit(0))).alias("total"), F.count_if(F.col("r").isNull()).alias("unaligned"))


@query(f"""with h as (select *, length(seq) as n, unnest(list_filter(range(0, length(seq) - 1), lambda i: substring(seq, i + 1, 2) = 'CG')) as i from {A}),
  p as (select *, case when {REV} then n - 1 - i else i end as q from h)
  select read_id, contig, start + {MIXED_AT} as pos, case when {REV} then '-' else '+' end as strand, ((doc_id * 31 + i * 17) % 256)::int as ml, (doc_id % 3)::int as hap from p where {MIXED_AT} is not null""")
def j13_projected_mixed_cigars(spark, d):
    got = joins.project_calls(_mixed(_tagged(spark, d)))
    return got.select("read_id", "contig", "pos", "strand", M.probability_byte(F.col("prob")).alias("ml"), "hap")


CHUNK = 200


def _reference(spark, d, overlap: int = 2):
    """Reads as contigs, in overlapping chunks."""
    df = fx.reads(spark, d).where("length(seq) > 0").select(F.col("read_id").alias("contig"), "seq")
    starts = F.sequence(F.lit(0).cast("long"), F.length("seq").cast("long") - 1, F.lit(CHUNK).cast("long"))
    chunks = df.select("contig", "seq", F.explode(starts).alias("chunk_start"))
    return chunks.select("contig", "chunk_start", F.substr("seq", (F.col("chunk_start") + 1).cast("int"), F.lit(CHUNK + overlap)).alias("seq"))


REFSITES = f"""(select read_id as contig, unnest(list_filter(range(0, greatest(length(seq) - 2, 0)), lambda i: substring(seq, i + 1, 3) = 'CAG')) as pos, '+' as strand from {R}
  union all select read_id, 2 + unnest(list_filter(range(0, greatest(length(seq) - 2, 0)), lambda i: substring(seq, i + 1, 3) = 'CTG')), '-' from {R})"""


@query(f"select contig, pos, strand from {REFSITES} s")
def j15_reference_sites(spark, d):
    return joins.reference_sites(_reference(spark, d), ["CAG"])


@query(f"""select s.contig, s.pos, s.strand from {REFSITES} s where s.pos % 3 = 0""")
def j5_sites_on_motif(spark, d):
    # every third place of every contig, on both strands
    sites_ = fx.reads(spark, d).where("length(seq) > 0").select(F.col("read_id").alias("contig"), F.explode(F.sequence(F.lit(0).cast("long"), F.length("seq").cast("long") - 1, F.lit(3).cast("long"))).alias("pos"))
    sites_ = sites_.select("contig", "pos", F.explode(F.array(F.lit("+"), F.lit("-"))).alias("strand"))
    return joins.restrict_to_ref_motif(sites_, _reference(spark, d), ["CAG"])


MOTIFS = "(select 'chr' || (k % 5 + 1)::varchar as contig, k * 7 as pos, case when k % 2 = 0 then '+' else '-' end as strand from (select unnest(range(0, 1000)) as k) u)"


@query(f"""with c as (select * from {PROJECTED} p), s as (select * from {MOTIFS} m),
  f as (select a.read_id, a.contig, s.pos, s.strand, (a.doc_id % 3)::int as hap from {A} join s on s.contig = a.contig and s.pos >= a.start and s.pos < a.start + length(a.seq) - 4
        and s.strand = (case when (a.flag & 16) <> 0 then '-' else '+' end))
  select read_id, contig, pos, strand, ml, hap from c union all
  select read_id, contig, pos, strand, 0 as ml, hap from f where not exists (select 1 from c where c.read_id = f.read_id and c.contig = f.contig and c.pos = f.pos)""")
def j6_filled_sites(spark, d):
    df = _tagged(spark, d)
    motifs = spark.range(1000).select(F.concat(F.lit("chr"), (F.col("id") % 5 + 1).cast("string")).alias("contig"), (F.col("id") * 7).alias("pos"), F.when(F.col("id") % 2 == 0, "+").otherwise("-").alias("strand"))
    got = joins.fill_reference_sites(df, motifs, joins.project_calls(df), 500)
    return got.select("read_id", "contig", "pos", "strand", M.probability_byte(F.col("prob")).alias("ml"), "hap")


@query(f"""with s as (select read_id, contig, strand, min(pos) as start, max(pos) + 1 as "end" from {PROJECTED} p group by read_id, contig, strand)
  select a.read_id, a.contig, a.start, s.start as r_start, s."end" as r_end from {A} join s on a.read_id = s.read_id and a.contig = s.contig and a.start < s."end" and s.start < a.ref_end""")
def j10_span_calls(spark, d):
    spans = joins.project_calls(_tagged(spark, d)).groupBy("read_id", "contig", "strand").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"))
    spans = spans.withColumn("read_id", X.without_suffix(F.col("read_id")))
    return joins.attach_span_calls(fx.alignments(spark, d), spans).select("read_id", "contig", "start", "r_start", "r_end")


@query(f"""with x as (select a.read_id, a.flag, a.start % greatest(length(r.seq) - length(a.seq) + 5, 1) as s0, a.seq as aseq, r.seq as rseq, length(a.seq) - 4 as n from {A} join {R} on a.doc_id = r.doc_id)
  select read_id, case when {REV} then {RC.format(s='substring(rseq, s0 + 1, n)')} else substring(rseq, s0 + 1, n) end as ref_seq from x""")
def j14_reference_slices(spark, d):
    # a read is aligned to its own text as a contig, from its start taken into that contig
    df = fx.alignments(spark, d).join(fx.reads(spark, d).select("doc_id", F.length("seq").alias("_n")), "doc_id")
    df = df.withColumn("contig", F.col("read_id")).withColumn("start", F.col("start") % F.greatest(F.col("_n") - F.length("seq") + 5, F.lit(1)))
    return joins.attach_ref_slice(df, _reference(spark, d), CHUNK).select("read_id", "ref_seq")


#: Reference offset of alignment place {q}, null where it is not aligned.
PLACED = "(case when {q} < 5 or {q} in (15, 16) then null when {q} < 15 then {q} - 5 when {q} < 25 then {q} - 7 else {q} - 4 end)"
#: The same in read direction, for read place {j}.
TURNED = "(case when " + REV + " then n - 5 - " + PLACED.format(q="(n - 1 - {j})") + " else " + PLACED.format(q="{j}") + " end)"
CODE = f"""(case when (case when {REV} then n - 1 - j else j end) < 5 then 1 when {TURNED.format(j='j')} is null then 1
    else (case when substring(seq, (j + 1)::int, 1) <> substring(ref_seq, ({TURNED.format(j='j')} + 1)::int, 1) then 4 else 0 end)
       + (case when j > (case when {REV} then 0 else 5 end) and {TURNED.format(j='(j - 1)')} is not null and {TURNED.format(j='j')} <> {TURNED.format(j='(j - 1)')} + 1 then 2 else 0 end) end)"""
MAPPED = f"""x as (select a.*, length(a.seq)::int as n, a.start % greatest(length(r.seq) - length(a.seq) + 5, 1) as s0, r.seq as rseq from {A} join {R} on a.doc_id = r.doc_id where (a.flag & 1284) = 0 and a.mapq >= 1),
  y as (select *, case when {REV} then {RC.format(s='substring(rseq, s0 + 1, n - 4)')} else substring(rseq, s0 + 1, n - 4) end as ref_seq from x),
  c as (select *, list_transform(range(0, n), lambda j: {CODE}) as codes from y),
  h as (select *, unnest(list_filter(range(0, n - 1), lambda i: substring(seq, i + 1, 2) = 'CG')) as i from c),
  p as (select *, case when {REV} then n - 1 - i else i end as q from h where i between 10 and n - 11 and n - 2 - i between 10 and n - 11)"""


@query(f"""with {MAPPED} select read_id, i::int as loc, case when q in (15, 16) then -1 else s0 + {PLACED.format(q='q')} end as pos,
    array_to_string(list_transform(codes[i - 9:i + 11], lambda c: cast(c as varchar)), '') as f_map, reverse(array_to_string(list_transform(codes[i - 8:i + 12], lambda c: cast(c as varchar)), '')) as r_map from p where q >= 5""")
def a1_features_with_maps(spark, d):
    """Map codes of both windows; a read is aligned to its own text as a contig."""
    df = filters.filter_alignments(_aligned(spark, d)).join(fx.reads(spark, d).select("doc_id", F.length("seq").alias("_n")), "doc_id")
    df = df.withColumn("contig", F.col("read_id")).withColumn("start", F.col("start") % F.greatest(F.col("_n") - F.length("seq") + 5, F.lit(1)))
    got = sites.extract_features(joins.attach_ref_slice(df, _reference(spark, d), CHUNK), ["CG"], maps=True)
    digits = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), "").alias(c)
    return got.select("read_id", "loc", "pos", digits("f_map"), digits("r_map"))


@query(f"""with k as (select substring(seq, i + 1, 5) as kmer from (select seq, unnest(range(0, greatest(length(seq) - 4, 0))) as i from {R}) u), n as (select kmer, count(*) as n from k group by kmer)
  select kmer, n, floor(n / (sum(n) over ())::double * 1e9 + 0.5) / 1e9 as share from n""")
def a22_kmer_distribution(spark, d):
    df = fx.reads(spark, d).where("length(seq) >= 5").select("seq", F.explode(F.sequence(F.lit(0), F.length("seq") - 5)).alias("i")).select(F.substr("seq", F.col("i") + 1, F.lit(5)).alias("kmer"))
    return sites.kmer_distribution(df).withColumn("share", X.half_up(F.col("share"), 1e9))


@query(f"select count(*) as n, sum(start)::bigint as total, 0::bigint as n_out_of_order from {A}")
def o2_sorted_alignments(spark, d):
    """All alignments come back, in the order of contig and start."""
    got = sampling.out_of_order(sampling.coordinate_sort(fx.alignments(spark, d)), F.struct("contig", "start"))
    return got.agg(F.count("*").alias("n"), F.sum("start").alias("total"), F.sum("out_of_order").alias("n_out_of_order"))


@query(f"""with f as (select *, list_filter(range(0, length(seq)), lambda i: substring(seq, i + 1, 1) = 'C') as cs from {A} where (flag & 1284) = 0 and mapq >= 1),
  o as (select *, list_filter(range(1, len(cs) + 1), lambda k: substring(seq, cs[k] + 1, 2) = 'CG') as o from f)
  select read_id, contig, case when len(o) > 0 then 'Z:C+m?,' || array_to_string(list_transform(range(1, len(o) + 1), lambda j: cast(o[j] - (case when j = 1 then 0 else o[j - 1] end) - 1 as varchar)), ',') || ';' end as mm,
    case when len(o) > 0 then 'B:C,' || array_to_string(list_transform(o, lambda k: cast((doc_id * 31 + cs[k] * 17) % 256 as varchar)), ',') end as ml, null::varchar as fi from o""")
def j4_attached_tags(spark, d):
    """Tags attached from call lists: the text of every read's."""
    df = filters.filter_alignments(_tagged(spark, d))
    lists = df.where("size(_h) > 0").select("read_id", F.zip_with("_h", "ml", lambda h, b: F.struct(h.alias("loc"), M.byte_probability(b).alias("prob"))).alias("calls"))
    bare = df.select("read_id", "flag", "contig", "seq", F.create_map(F.lit("fi"), F.lit("B:C,1")).alias("tags"))
    got = joins.attach_mod_tags(bare, lists)
    return got.select("read_id", "contig", *[F.try_element_at("tags", F.lit(t)).alias(t.lower()) for t in ("MM", "ML", "fi")])
