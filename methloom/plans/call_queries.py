"""Queries over calls, site frequencies and labelled calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calls as X
from ..functions import modtags as M
from ..operators import compare, filters, joins, reads, sampling, sets, sites, windows
from ..sources import readers, writers
from . import fixtures as fx
from .fixtures import CALLS, LABELLED, SITEFREQ, TRUTH
from .registry import query

C, T, S, L = f"({CALLS}) c", f"({TRUTH}) t", f"({SITEFREQ}) s", f"({LABELLED}) l"
SITE = ["contig", "pos", "strand"]
R6 = lambda c: X.half_up(c, 1e6)
#: One call a (read, place), ties by every column: the order that stands for file order here.
ORDER = ["contig", "pos", "strand", "prob_1", "depth", "hap"]


def _freq(df):
    return df.withColumn("freq", F.col("n_mod") / F.col("coverage"))


def _truth(spark, d):
    return fx.truth(spark, d).withColumn("freq", F.col("pct") / 100.0)


@query(f"select contig, pos, strand, read_id, read_loc, cast(depth as varchar) || ',' || cast(depth % 7 as varchar) as depth, prob_0, prob_1, label, 'CG' as kmer, depth as depth_f, depth % 7 as depth_r from {C}")
def s6_calls(spark, d):
    """Calls written as text and read again."""
    path = fx.scratch(spark)
    both = F.concat_ws(",", F.col("depth").cast("string"), (F.col("depth") % 7).cast("string"))
    writers.write_calls(fx.calls(spark, d).withColumn("depth", both).withColumn("kmer", F.lit("CG")), path, gzip=True)
    return readers.read_calls(spark, path)


@query(f"select contig, pos, strand, coverage, pct, pct / 100e0 as freq from (select contig, pos, strand, coverage, cast(floor(n_mod / coverage::double * 100 + 0.001 + 0.5) as int) as pct from {S}) b")
def s8_truth(spark, d):
    """Site frequencies written as bedMethyl and read again."""
    path = fx.scratch(spark)
    writers.write_bedmethyl(fx.sitefreq(spark, d), path)
    return readers.read_bedmethyl(spark, path).select("contig", "pos", "strand", "coverage", "pct", "freq")


@query(f"""select contig, pos, strand, floor(p1_sum * 1e3 + 0.5) / 1e3 as p1_sum, n_mod, coverage - n_mod as n_unmod, coverage, floor((n_mod / coverage::double + 1e-6) * 1e4 + 0.5) / 1e4 as freq from {S}""")
def s7_site_frequencies(spark, d):
    """Site frequencies written as text and read again."""
    path = fx.scratch(spark)
    df = fx.sitefreq(spark, d).withColumn("n_unmod", F.col("coverage") - F.col("n_mod")).withColumn("kmer", F.lit("CG"))
    writers.write_site_freq(df, path)
    return readers.read_site_freq(spark, path).select("contig", "pos", "strand", X.half_up(F.col("p1_sum"), 1e3).alias("p1_sum"), "n_mod", "n_unmod", "coverage", "freq")


@query(f"""select contig, pos as start, pos + 1 as "end", '.' as name, coverage as score, strand, pos as thick_start, pos + 1 as thick_end,
    '0,0,0' as rgb, coverage, cast(floor(n_mod / coverage::double * 100 + 0.001 + 0.5) as int) as pct from {S}""")
def k4_bedmethyl(spark, d):
    return writers.bedmethyl_rows(fx.sitefreq(spark, d))


@query(f"select * from {C} where abs(prob_0 - prob_1) >= 0.3")
def f7_confident_calls(spark, d):
    return filters.filter_calls(fx.calls(spark, d), 0.3)


@query(f"select contig, pos, depth from {C} where pos <> -1 and l2 = 1".replace("l2 = 1", "depth % 2 = 1"))
def f8_both_strand_calls(spark, d):
    # a depth of both strands has a comma: odd depths stand for those
    df = fx.calls(spark, d).withColumn("_d", F.col("depth"))
    df = df.withColumn("depth", F.when(F.col("_d") % 2 == 1, F.concat_ws(",", "_d", "_d")).otherwise(F.col("_d").cast("string")))
    return filters.filter_calls(df, rm_1strand=True).select("contig", "pos", F.col("_d").alias("depth"))


@query(f"select contig, pos, read_id, read_loc, prob_1 from {C} where contig in ('chr1', 'chr3')")
def f9_contigs(spark, d):
    return filters.filter_contigs(fx.calls(spark, d), "chr", ["chr1", "chr3"]).select("contig", "pos", "read_id", "read_loc", "prob_1")


@query(f"select contig, pos, strand, coverage, n_mod from {S} where coverage >= 4")
def f10_covered_sites(spark, d):
    return filters.filter_coverage(fx.sitefreq(spark, d), 4).select(*SITE, "coverage", "n_mod")


@query(f"select ml, case when ml = 0 then 0 else 1 end as above, least(cast(floor((ml / 256e0) * 256) as int), 255) as byte, count(*) as n from {C} group by ml")
def x15_probability_bytes(spark, d):
    df = fx.calls(spark, d)
    p = M.byte_probability(F.col("ml"))
    return df.select("ml", (p > F.col("ml") / 256.0).cast("int").alias("above"), M.probability_byte(p).alias("byte")).groupBy("ml", "above", "byte").agg(F.count("*").alias("n"))


@query(f"""select contig, pos, strand, cast(floor(n_mod / coverage::double * 100 + 0.001 + 0.5) as int) as pct from {S}""")
def x18_percent(spark, d):
    return fx.sitefreq(spark, d).select(*SITE, X.percent(F.col("n_mod") / F.col("coverage")).alias("pct"))


@query(f"""with f as (select contig, pos, strand, coverage, n_mod / coverage::double as freq from {S}),
 m as (select *, case when freq > 0.66e0 then ceil(freq * coverage) when freq <= 0.33e0 then floor(freq * coverage)
   else floor(freq * coverage * 100 + 0.5) / 100 end as mod_reads from f)
 select contig, pos, strand, mod_reads::double as n_mod, coverage - mod_reads as n_unmod,
   floor(case when mod_reads = 0 then 0e0 else mod_reads / coverage end * 1e6 + 0.5) / 1e6 as score from m""")
def x19_pushed_scores(spark, d):
    df = _freq(fx.sitefreq(spark, d)).withColumn("x", X.pushed(F.col("freq"), F.col("coverage")))
    return df.select(*SITE, "x.n_mod", "x.n_unmod", R6(F.col("x.score")).alias("score"))


@query(f"select split_part(read_id, '/', 2) as molecule, regexp_replace(read_id, '/ccs$', '') as short_id, count(*) as n from {C} group by 1, 2")
def x20_molecules(spark, d):
    df = fx.calls(spark, d).select(X.molecule(F.col("read_id")).alias("molecule"), X.without_suffix(F.col("read_id")).alias("short_id"))
    return df.groupBy("molecule", "short_id").agg(F.count("*").alias("n"))


@query(f"select contig, case when strand = '-' then pos - 1 else pos end as site, count(*) as n from {C} group by 1, 2")
def x21_folded_sites(spark, d):
    return fx.calls(spark, d).select("contig", X.folded(F.col("pos"), F.col("strand")).alias("site")).groupBy("contig", "site").agg(F.count("*").alias("n"))


@query(f"select depth, depth + 3 as deepest, count(*) as n from {C} group by depth")
def x22_deepest(spark, d):
    df = fx.calls(spark, d).select("depth", X.deepest(F.concat_ws(",", "depth", F.col("depth") + 3)).alias("deepest"))
    return df.groupBy("depth", "deepest").agg(F.count("*").alias("n"))


HAPS = f"(select read_id, max(hap) as hap from {C} group by read_id) h"


def _haps(df):
    return df.groupBy("read_id").agg(F.max("hap").alias("hap"))


@query(f"""select c.* from {C} where read_id in (select read_id from {HAPS} where hap > 0)
    and read_id not in (select read_id from {HAPS} where hap = 2)""")
def j1_restricted_reads(spark, d):
    df = fx.calls(spark, d)
    haps = _haps(df)
    return joins.restrict_reads(df, haps.where("hap > 0"), haps.where("hap = 2"))


@query(f"select c.* from {C} where exists (select 1 from {T} where t.contig = c.contig and t.pos = c.pos and t.pct >= 95)")
def j2_restricted_positions(spark, d):
    return joins.restrict_positions(fx.calls(spark, d), fx.truth(spark, d).where("pct >= 95"))


@query(f"""select c.contig, c.pos, c.read_id, c.read_loc, c.prob_1, 1 as label from {C}
    where exists (select 1 from {T} where t.contig = c.contig and t.pos = c.pos and t.pct >= 95)""")
def j3_relabelled(spark, d):
    df = joins.relabel_at(fx.calls(spark, d), fx.truth(spark, d).where("pct >= 95"), 1)
    return df.select("contig", "pos", "read_id", "read_loc", "prob_1", "label")


@query(f"""select c.contig, c.pos, c.strand, c.read_id, c.read_loc, c.prob_1, coalesce(h.hap_name, 'unknown') as haplotype
    from {C} left join (select read_id, 'HP' || cast(hap as string) as hap_name from {HAPS} where hap > 0) h on c.read_id = h.read_id""")
def j7_phased_calls(spark, d):
    df = fx.calls(spark, d)
    haps = _haps(df).where("hap > 0").select("read_id", F.concat(F.lit("HP"), F.col("hap").cast("string")).alias("hap"))
    return joins.phase_calls(df, haps).select(*SITE, "read_id", "read_loc", "prob_1", "haplotype")


@query(f"select read_id, count(distinct hap) as n_haps from {C} where hap > 0 group by read_id having count(distinct hap) > 1")
def j8_haplotype_conflicts(spark, d):
    return joins.haplotype_conflicts(fx.calls(spark, d).where("hap > 0"))


@query(f"""with k as (select distinct contig, pos from {T} where pct >= 99),
 r as (select contig, read_id, min(pos) as start, max(pos) + 1 as "end" from {C} group by contig, read_id)
 select r.contig, r.read_id, r.start, r."end", k.pos as r_start from r join k on r.contig = k.contig and r.start < k.pos + 1 and k.pos < r."end" """)
def j9_overlaps(spark, d):
    r = fx.calls(spark, d).groupBy("contig", "read_id").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"))
    k = fx.truth(spark, d).where("pct >= 99").select("contig", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end")).distinct()
    return joins.overlap_join(r, k, 500).select("contig", "read_id", "start", "end", "r_start")


@query(f"""select s.contig, s.pos, s.strand, floor(s.n_mod / s.coverage::double * 1e6 + 0.5) / 1e6 as freq, t.pct / 100e0 as freq_b
    from {S} join {T} on s.contig = t.contig and s.pos = t.pos and s.strand = t.strand""")
def j11_paired_sites(spark, d):
    got = joins.pair_sites(_freq(fx.sitefreq(spark, d)), _truth(spark, d), SITE, ["freq"])
    return got.select(*SITE, R6(F.col("freq")).alias("freq"), "freq_b")


@query(f"""with k as (select distinct contig, pos, split_part(read_id, '/', 2) as molecule from {C} where strand = '+' and depth >= 40),
 b as (select contig, pos, molecule from k union select contig, pos + 1, molecule from k)
 select c.contig, c.pos, split_part(c.read_id, '/', 2) as molecule, c.prob_1 from {C}
 where exists (select 1 from b where b.contig = c.contig and b.pos = c.pos and b.molecule = split_part(c.read_id, '/', 2))""")
def j12_restricted_samples(spark, d):
    df = fx.calls(spark, d).withColumn("molecule", X.molecule(F.col("read_id")))
    got = joins.restrict_samples(df, df.where("strand = '+' and depth >= 40"))
    return got.select("contig", "pos", "molecule", "prob_1")


@query(f"""select contig, pos, strand, sum(prob_0) as p0_sum, sum(prob_1) as p1_sum, cast(sum(label) as bigint) as n_mod,
    cast(sum(1 - label) as bigint) as n_unmod, count(*) as coverage, floor(sum(label) / count(*)::double * 1e6 + 0.5) / 1e6 as freq
    from {C} where abs(prob_0 - prob_1) >= 0.1 group by contig, pos, strand""")
def a2_site_frequency(spark, d):
    got = sites.site_frequency(filters.filter_calls(fx.calls(spark, d), 0.1))
    return got.withColumn("freq", R6(F.col("freq")))


@query(f"""select contig, pos, first(strand order by read_id, read_loc, strand) as strand, sum(prob_1) as p1_sum, cast(sum(label) as bigint) as n_mod, count(*) as coverage
    from (select * replace (case when depth % 2 = 0 then '+' else '-' end as strand) from {C}) s group by contig, pos""")
def a3_site_frequency_unstranded(spark, d):
    # strands by depth, so that a place has calls of both
    df = fx.calls(spark, d).withColumn("strand", F.when(F.col("depth") % 2 == 0, "+").otherwise("-"))
    return sites.site_frequency(df, by_strand=False).select("contig", "pos", "strand", "p1_sum", "n_mod", "coverage")


COUNTED = """select contig, pos, strand{hap}, count(*) as coverage,
    case when count(*) = count(*) filter (where k) then (count(*) filter (where k and prob_1 > 0.5e0))::double
      else floor(count(*) * (case when count(*) filter (where k) > 0 then (count(*) filter (where k and prob_1 > 0.5e0))::double / (count(*) filter (where k)) else 0e0 end) * 100 + 0.5) / 100 end as n_mod,
    floor((case when count(*) filter (where k) > 0 then (count(*) filter (where k and prob_1 > 0.5e0))::double / (count(*) filter (where k)) else 0e0 end) * 1e6 + 0.5) / 1e6 as freq
    from (select *, abs(2 * prob_1 - 1) >= 0.25e0 as k from {calls}) x group by contig, pos, strand{group}"""


@query(COUNTED.format(hap="", group="", calls=C))
def a4_site_frequency_count(spark, d):
    return sites.site_frequency_count(fx.calls(spark, d), 0.25).withColumn("freq", R6(F.col("freq")))


@query(COUNTED.format(hap=", cast(null as int) as hap", group="", calls=C) + " union all " + COUNTED.format(hap=", hap", group=", hap", calls=f"(select * from {C} where hap in (1, 2)) c"))
def a5_site_frequency_by_hap(spark, d):
    return sites.site_frequency_count(fx.calls(spark, d), 0.25, by_hap=True).withColumn("freq", R6(F.col("freq")))


@query(f"""select contig, case when strand = '-' then pos - 1 else pos end as pos, '+' as strand, count(*) as coverage,
    cast(sum(case when prob_1 > 0.5e0 then 1 else 0 end) as double) as n_mod, floor(sum(case when prob_1 > 0.5e0 then 1 else 0 end) / count(*)::double * 1e6 + 0.5) / 1e6 as freq
    from {C} where not (strand = '-' and pos = 0) group by 1, 2""")
def a6_combined_strands(spark, d):
    return sites.site_frequency_count(sites.fold_strands(fx.calls(spark, d))).withColumn("freq", R6(F.col("freq")))


FOLDED_CALLS = f"(select contig, case when strand = '-' then pos - 1 else pos end as pos, '+' as strand, prob_1, hap from {C} where not (strand = '-' and pos = 0))"
HIST = f"""(select contig, pos, strand, count(*) as coverage, list_transform(range(0, 20), lambda k: list_count(list_filter(list(least(floor(prob_1 * 20), 19)), lambda b: b = k))::double) as h
    from (select contig, case when strand = '-' then pos - 1 else pos end as pos, '+' as strand, prob_1 from {C}) f group by 1, 2, 3 having count(*) >= 4)"""


#: The same with unit length and 6 decimals.
UNIT = f"(select contig, pos, strand, coverage, list_transform(h, lambda x: floor(x / sqrt(list_sum(list_transform(h, lambda y: y * y))) * 1e6 + 0.5) / 1e6) as h from {HIST} g0)"


@query(f"""select contig, pos, strand, coverage, array_to_string(list_transform(h, lambda x: cast(cast(floor(x / sqrt(list_sum(list_transform(h, lambda y: y * y))) * 1e4 + 0.5) as int) as varchar)), ',') as hist
    from {HIST} g""")
def a7_site_histogram(spark, d):
    got = sites.site_histogram(sites.fold_strands(fx.calls(spark, d)))
    text = F.array_join(F.transform("hist", lambda x: F.floor(x * 1e4 + 0.5).cast("int").cast("string")), ",")
    return got.select(*SITE, "coverage", text.alias("hist"))


@query(f"""with s as (select contig, pos, strand, coverage, list_sum(list_transform(range(0, 20), lambda k: (k + 1) * h[k + 1])) as t from {UNIT} g), w as (
    select *, {" + ".join(f"{d + 6} * coalesce({'lag' if d < 0 else 'lead'}(t, {abs(d)}) over o, 0)" for d in range(-5, 6))} as weight, count(*) over b as nb, count(*) over a as na, first_value(pos) over z - 1000 as low, last_value(pos) over z + 1000 as high,
      list(pos) over n as near from s
    window b as (partition by contig, strand order by pos rows between 5 preceding and 1 preceding), a as (partition by contig, strand order by pos rows between 1 following and 5 following),
      o as (partition by contig, strand order by pos), z as (partition by contig, strand order by pos rows between unbounded preceding and unbounded following), n as (partition by contig, strand order by pos rows between 5 preceding and 5 following))
  select contig, pos, strand, coverage, array_to_string(list_transform(list_concat(list_concat(list_transform(range(0, 5 - nb), lambda i: low), near), list_transform(range(0, 5 - na), lambda i: high)), lambda p: cast(abs(p - pos) as varchar)), ',') as offsets,
    floor(weight * 1e3 + 0.5) / 1e3 as weight
  from w""")
def w1_neighbour_windows(spark, d):
    got = windows.neighbour_windows(sites.site_histogram(sites.fold_strands(fx.calls(spark, d))))
    total = lambda a, of: F.aggregate(F.transform(a, of), F.lit(0.0), lambda s, x: s + x)
    weight = total("hists", lambda h, j: (j + 1) * total(h, lambda x, k: (k + 1) * x))
    return got.select(*SITE, "coverage", F.array_join(F.transform("offsets", lambda x: x.cast("string")), ",").alias("offsets"), X.half_up(weight, 1e3).alias("weight"))


@query(f"""with h as (select contig, pos, strand, coverage, list_sum(list_transform(range(0, 20), lambda k: (k + 0.5e0) / 20 * h[k + 1])) / list_sum(h) as score from {UNIT} g),
  m as (select *, floor(score * 1e6 + 0.5) / 1e6 as sc from h),
  x as (select *, case when sc > 0.66e0 then ceil(sc * coverage) when sc <= 0.33e0 then floor(sc * coverage) else floor(sc * coverage * 100 + 0.5) / 100 end as mod_reads from m),
  low as (select contig, pos, '+' as strand, count(*) as coverage, cast(sum(case when prob_1 > 0.5e0 then 1 else 0 end) as double) as n_mod from (select contig, case when strand = '-' then pos - 1 else pos end as pos, prob_1 from {C}) f group by 1, 2 having count(*) < 4)
  select contig, pos, strand, coverage, n_mod, floor(n_mod / coverage * 1e4 + 0.5) / 1e4 as freq from low
  union all select contig, pos, strand, coverage, mod_reads::double, floor((case when mod_reads = 0 then 0e0 else mod_reads / coverage end) * 1e4 + 0.5) / 1e4 from x""")
def a8_site_frequency_aggregate(spark, d):
    got = sites.site_frequency_aggregate(sites.fold_strands(fx.calls(spark, d)))
    return got.withColumn("freq", X.half_up(F.col("freq"), 1e4))


def routed(calls: str, keys: str, kept: str = "true", least: int = 4) -> str:
    """SQL of aggregate mode with the centre's scorer: ({keys} site, coverage, n_mod, freq) of ``calls``."""
    return f"""with n as (select {keys} contig, pos, strand, count(*) as coverage, count(*) filter (where {kept}) as n_kept, count(*) filter (where {kept} and prob_1 > 0.5e0) as n,
      list_transform(range(0, 20), lambda k: list_count(list_filter(list(least(floor(prob_1 * 20), 19)), lambda b: b = k))::double) as h from {calls} group by all),
    low as (select *, case when n_kept > 0 then n / n_kept::double else 0e0 end as freq from n where coverage < {least}),
    u as (select *, list_transform(h, lambda x: floor(x / sqrt(list_sum(list_transform(h, lambda y: y * y))) * 1e6 + 0.5) / 1e6) as w from n where coverage >= {least}),
    m as (select *, floor(list_sum(list_transform(range(0, 20), lambda k: (k + 0.5e0) / 20 * w[k + 1])) / list_sum(w) * 1e6 + 0.5) / 1e6 as sc from u),
    x as (select *, (case when sc > 0.66e0 then ceil(sc * coverage) when sc <= 0.33e0 then floor(sc * coverage) else floor(sc * coverage * 100 + 0.5) / 100 end)::double as mod_reads from m)
    select {keys} contig, pos, strand, coverage, case when n_kept = coverage then n::double else floor(coverage * freq * 100 + 0.5) / 100 end as n_mod, freq from low
    union all select {keys} contig, pos, strand, coverage, mod_reads, case when mod_reads = 0 then 0e0 else mod_reads / coverage end from x"""


HAP_SETS = f"(select *, cast(null as int) as set from {FOLDED_CALLS} f union all select *, hap as set from {FOLDED_CALLS} f where hap in (1, 2)) c"


@query(f"select contig, pos, strand, set as hap, coverage, n_mod, floor(freq * 1e4 + 0.5) / 1e4 as freq from ({routed(HAP_SETS, 'set,', 'abs(2 * prob_1 - 1) >= 0.25e0', 3)}) r")
def a8_aggregate_by_hap(spark, d):
    """All calls and each haplotype, low sites with a cutoff of probabilities."""
    got = sites.site_frequency_aggregate(sites.fold_strands(fx.calls(spark, d)), min_cov=3, prob_cf=0.25, by_hap=True)
    return got.withColumn("freq", X.half_up(F.col("freq"), 1e4))


ONE = f"(select * from (select *, row_number() over (partition by read_id, read_loc order by contig, pos, strand, prob_1, depth, hap) as rn from {C}) q where rn = 1)"


@query(f"select read_id, array_to_string(list(cast(read_loc as varchar) || ':' || cast(cast(prob_1 * 256 as int) as varchar) order by read_loc), ',') as calls from {ONE} o group by read_id")
def a9_read_calls(spark, d):
    got = reads.collect_read_calls(fx.calls(spark, d), ORDER)
    text = F.transform("calls", lambda c: F.concat_ws(":", c["loc"].cast("string"), (c["prob"] * 256).cast("int").cast("string")))
    return got.select("read_id", F.array_join(text, ",").alias("calls"))


@query(f"""with i as (select *, sum(n) over (partition by contig, strand, read_id order by pos rows unbounded preceding) as island from
    (select *, case when pos - lag(pos) over (partition by contig, strand, read_id order by pos) < 3000 then 0 else 1 end as n from {C}) a)
  select contig, strand, read_id, min(pos) as start, max(pos) + 1 as "end", count(*) filter (where prob_1 - prob_0 > 0.1e0) as n_met, count(*) filter (where prob_0 - prob_1 > 0.1e0) as n_unmet,
    coalesce(sum(pos) filter (where prob_1 - prob_0 > 0.1e0), 0)::bigint as met_pos from i group by contig, strand, read_id, island""")
def a10_span_records(spark, d):
    got = reads.span_records(fx.calls(spark, d), 0.1, 3000)
    total = F.aggregate("met_pos", F.lit(0).cast("long"), lambda s, x: s + x)
    return got.select("contig", "strand", "read_id", "start", "end", F.size("met_delta").cast("long").alias("n_met"), F.size("unmet_delta").cast("long").alias("n_unmet"), total.alias("met_pos"))


@query(f"""select read_id, contig, pos, delta from (select read_id, contig, pos, prob_1 - prob_0 as delta,
    row_number() over (partition by read_id, contig, pos order by abs(prob_1 - prob_0) desc, prob_1 - prob_0 desc) as rn from {C}) x where rn = 1""")
def a11_strongest_call(spark, d):
    df = fx.calls(spark, d).select("read_id", "contig", "pos", (F.col("prob_1") - F.col("prob_0")).alias("delta"))
    return reads.strongest_call(df)


@query(f"""select contig, pos, strand, sum(prob_0) as p0_sum, sum(prob_1) as p1_sum, cast(sum(label) as bigint) as n_mod, cast(sum(1 - label) as bigint) as n_unmod, count(*) as coverage,
    floor(sum(label) / count(*)::double * 1e6 + 0.5) / 1e6 as freq from {C} group by contig, pos, strand""")
def a12_combined_tables(spark, d):
    df = fx.calls(spark, d)
    return sites.combine_site_freq([sites.site_frequency(df.where(F.col("hap") == h)) for h in (0, 1, 2)]).withColumn("freq", R6(F.col("freq")))


@query(f"""select contig, case when strand = '-' then pos - 1 else pos end as pos, cast(sum(coverage) as bigint) as coverage, cast(sum(n_mod) as bigint) as n_mod,
    floor(sum(n_mod) / sum(coverage)::double * 1e6 + 0.5) / 1e6 as freq from {S} group by 1, 2""")
def a13_merged_strands(spark, d):
    return sites.merge_strands(fx.sitefreq(spark, d)).withColumn("freq", R6(F.col("freq")))


@query(f"select contig, pos, strand, avg(pct) as pct, count(*) as n_tables from (select contig, pos, strand, pct from {T} union all select contig, pos, strand, coverage as pct from {T}) u group by contig, pos, strand")
def a14_average_truth(spark, d):
    t = fx.truth(spark, d)
    return sites.average_truth([t.select(*SITE, "pct"), t.select(*SITE, F.col("coverage").cast("long").alias("pct"))])


@query(f"select avg(coverage) as mean_coverage, count(*) as n_sites, count(*) filter (where coverage >= 5) as n_covered from {S}")
def a15_coverage_summary(spark, d):
    return sites.coverage_summary(fx.sitefreq(spark, d), 5)


AGREE = """with a as (select contig, pos, strand, n_mod / coverage::double as freq from {s} where coverage >= 2),
  b as (select contig, pos, strand, pct / 100e0 as freq from {t} where coverage >= 3),
  p as (select a.freq as x, b.freq as y, {y} as v from a join b using (contig, pos, strand)),
  r as (select *, rank() over (order by x) + (count(*) over (partition by x) - 1) / 2e0 as rx, rank() over (order by v) + (count(*) over (partition by v) - 1) / 2e0 as ry from p)
  select (select count(*) from a) as n_a, (select count(*) from b) as n_b, count(*) as n_both, floor(corr(x, y) * 1e6 + 0.5) / 1e6 as pearson,
    floor(corr(rx, ry) * 1e6 + 0.5) / 1e6 as spearman, floor(sqrt(avg((x - y) * (x - y))) * 1e6 + 0.5) / 1e6 as rmse, floor(corr(x, y) * corr(x, y) * 1e6 + 0.5) / 1e6 as r2 from r"""


def _agree(spark, d, **options):
    got = compare.compare_sites(_freq(fx.sitefreq(spark, d)), _truth(spark, d), SITE, "freq", 2, 3, **options)
    return got.select("n_a", "n_b", "n_both", *[R6(F.col(c)).alias(c) for c in ("pearson", "spearman", "rmse", "r2")])


@query(AGREE.format(s=S, t=T, y="b.freq"))
def a16_agreement(spark, d):
    return _agree(spark, d)


@query(AGREE.format(s=S, t=T, y="floor(b.freq * 100 + 0.5) / 100"))
def a17_agreement_rounded(spark, d):
    return _agree(spark, d, round_b=True)


@query(f"""with r as (select contig, hap, avg(prob_1) as level, count(*)::double as n from {C} group by contig, hap)
  select contig, count(*) as n_runs, floor(avg(level) * 1e6 + 0.5) / 1e6 as level_mean, floor(stddev_pop(level) * 1e6 + 0.5) / 1e6 as level_sd, floor(avg(n) * 1e3 + 0.5) / 1e3 as n_mean, floor(stddev_pop(n) * 1e3 + 0.5) / 1e3 as n_sd from r group by contig""")
def a18_run_summary(spark, d):
    runs = fx.calls(spark, d).groupBy("contig", "hap").agg(F.avg("prob_1").alias("level"), F.count("*").cast("double").alias("n"))
    got = compare.summarise_runs(runs, ["level", "n"], ["contig"])
    return got.select("contig", "n_runs", *[X.half_up(F.col(c), k).alias(c) for c, k in (("level_mean", 1e6), ("level_sd", 1e6), ("n_mean", 1e3), ("n_sd", 1e3))])


@query(f"""with k as (select count(*) filter (where is_true = 1 and predicted = 1) as tp, count(*) filter (where is_true = 1 and predicted = 0) as fn,
    count(*) filter (where is_true = 0 and predicted = 0) as tn, count(*) filter (where is_true = 0 and predicted = 1) as fp from {L})
  select tp, fn, tn, fp, """ + ", ".join(f"floor(({a})::double / ({b}) * 1e6 + 0.5) / 1e6 as {n}" for a, b, n in (
    ("tp + tn", "tp + tn + fp + fn", "accuracy"), ("tp", "tp + fn", "recall"), ("tn", "tn + fp", "specificity"), ("tp", "tp + fp", "precision"),
    ("fp", "fp + tn", "fall_out"), ("fn", "tp + fn", "miss_rate"), ("fp", "tp + fp", "fdr"), ("tn", "tn + fn", "npv"))) + " from k")
def a19_classification_metrics(spark, d):
    got = compare.classification_metrics(fx.labelled(spark, d))
    return got.select("tp", "fn", "tn", "fp", *[R6(F.col(c)).alias(c) for c in got.columns[4:]])


@query(f"""with r as (select *, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2e0 as rk from {L})
  select floor((sum(rk) filter (where is_true = 1) - sum(is_true) * (sum(is_true) + 1) / 2e0) / (sum(is_true)::double * sum(1 - is_true)) * 1e9 + 0.5) / 1e9 as auc from r""")
def a20_roc_auc(spark, d):
    return compare.roc_auc(fx.labelled(spark, d)).select(X.half_up(F.col("auc"), 1e9).alias("auc"))


@query(f"""with k as (select contig, case when strand = '-' then pos - 1 else pos end as site, split_part(read_id, '/', 2) as molecule, read_loc, pos, prob_1 from {C})
  select contig, site, molecule, first(pos order by read_loc, pos, prob_1) as pos, first(read_loc order by read_loc, pos, prob_1) as read_loc, first(prob_1 order by read_loc, pos, prob_1) as prob_1, count(*) as n_calls
  from k group by contig, site, molecule""")
def a21_deduped_calls(spark, d):
    return reads.dedupe_calls(fx.calls(spark, d)).select("contig", "site", "molecule", "pos", "read_loc", "prob_1", "n_calls")


@query(f"select hap, count(*) as n_calls, count(distinct read_id) as n_reads from {C} group by hap")
def a23_run_counters(spark, d):
    return reads.run_counters(fx.calls(spark, d))


@query(f"select count(distinct split_part(read_id, '/', 2)) as n_molecules from {C}")
def a24_count_reads(spark, d):
    return reads.count_reads(fx.calls(spark, d))


@query(f"select contig, case when strand = '-' then pos - 1 else pos end as pos, cast(sum(coverage) as bigint) as n, cast(sum(n_mod) as bigint) as x from {S} group by 1, 2 having sum(coverage) >= 2")
def a25_dmr_input(spark, d):
    return sites.dmr_input(fx.sitefreq(spark, d), 2)


@query(f"""select contig, strand, read_id, pos, cast(sum(n) over (partition by read_id, contig, strand order by pos rows unbounded preceding) as bigint) as island from
    (select distinct contig, strand, read_id, pos, case when pos - lag(pos) over (partition by read_id, contig, strand order by pos) < 3000 then 0 else 1 end as n from (select distinct contig, strand, read_id, pos from {C}) u) a""")
def w2_islands(spark, d):
    df = fx.calls(spark, d).select("contig", "strand", "read_id", "pos").distinct()
    return windows.assign_islands(df, ["read_id", "contig", "strand"], "pos", 3000)


@query(f"select contig, pos, strand, read_id, read_loc, depth, ml, prob_0, prob_1, label, hap from {ONE} o")
def w3_first_calls(spark, d):
    return sites.first_rows(fx.calls(spark, d), ["read_id", "read_loc"], ORDER)


@query(f"select contig, strand, pos, pos - lag(pos) over (partition by contig, strand order by pos) as gap from (select distinct contig, strand, pos from {C}) u")
def w4_position_gaps(spark, d):
    return windows.position_gaps(fx.calls(spark, d).select("contig", "strand", "pos").distinct(), ["contig", "strand"])


@query(f"select score, count(*) as n, min(rk) as rank from (select score, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2e0 as rk from {L}) r group by score")
def w5_average_rank(spark, d):
    return windows.average_rank(fx.labelled(spark, d), "score")


FOLDED = f"(select contig, case when strand = '-' then pos - 1 else pos end as pos, cast(sum(coverage) as bigint) as n, cast(sum(n_mod) as bigint) as x from {S} group by 1, 2)"


@query(f"""with l as (select 'all' as grp, score from {L} union all select event_type, (cast(round(value * 100) as bigint) % 256) / 256e0 from events)
  select grp, score, count(*) as n, min(rk) as rank from (select *, rank() over (partition by grp order by score) + (count(*) over (partition by grp, score) - 1) / 2e0 as rk from l) q group by grp, score""")
def w5_average_rank_by_group(spark, d):
    """Ranks within groups, one of them of all rows."""
    scores = fx.labelled(spark, d).join(fx.events(spark, d).select("event_id", "event_type"), "event_id")
    both = scores.select(F.explode(F.array(F.lit("all"), "event_type")).alias("grp"), "score")
    return windows.average_rank(both, "score", ["grp"])


@query(f"""select contig, pos, n, x, cast(sum(n) over w as bigint) as smooth_n, cast(sum(x) over w as bigint) as smooth_x, floor(sum(x) over w / (sum(n) over w)::double * 1e6 + 0.5) / 1e6 as level
    from {FOLDED} f window w as (partition by contig order by pos range between 250 preceding and 250 following)""")
def w6_smoothed_sites(spark, d):
    return windows.smooth_sites(sites.dmr_input(fx.sitefreq(spark, d))).withColumn("level", R6(F.col("level")))


@query(f"""with t as (select contig, pos, (x >= 2 and x * 2 > n) as sig from {FOLDED} f),
  i as (select contig, pos, sum(nw) over (partition by contig order by pos rows unbounded preceding) as island from (select *, case when pos - lag(pos) over (partition by contig order by pos) < 40 then 0 else 1 end as nw from t where sig) a),
  s as (select contig, island, min(pos) as start, max(pos) + 1 as "end", count(*) as n_significant from i group by contig, island)
  select s.contig, s.start, s."end", s."end" - s.start as length, count(*) as n_sites, s.n_significant from s join t on t.contig = s.contig and t.pos >= s.start and t.pos < s."end"
  group by s.contig, s.island, s.start, s."end", s.n_significant having s."end" - s.start >= 50 and count(*) >= 5 and s.n_significant >= 0.3 * count(*)""")
def w7_regions(spark, d):
    t = sites.dmr_input(fx.sitefreq(spark, d)).withColumn("significant", (F.col("x") >= 2) & (F.col("x") * 2 > F.col("n")))
    return windows.call_regions(t, 40, 50, 5, 0.3)


@query(f"select contig, pos, strand, coverage, n_mod from {S} order by contig, pos, strand")
def o1_genome_order(spark, d):
    return sampling.genome_order(fx.sitefreq(spark, d).select(*SITE, "coverage", "n_mod"))


def drawn(seed: int, *parts: str) -> str:
    """SQL of ``text_order``, over 8."""
    key = " || '/' || ".join(f"cast({p} as varchar)" for p in parts)
    return f"cast('0x' || substr(md5('{seed}/' || {key}), 1, 15) as bigint)"


def _drawn(*parts: str):
    return F.concat_ws("/", *[F.col(p).cast("string") for p in parts])


KEY = ("read_id", "read_loc", "pos")
ROW = "contig, pos, strand, read_id, read_loc, depth, ml, prob_0, prob_1, label, hap"


@query(f"select count(*) as n, sum(prob_1) as total, 0::bigint as n_out_of_order from {C}")
def o4_shuffled_rows(spark, d):
    """All rows come back, in the order of their draws."""
    order = sampling.text_order(_drawn(*KEY), 7)
    got = sampling.out_of_order(sampling.shuffle_rows(fx.calls(spark, d), order=order), order)
    return got.agg(F.count("*").alias("n"), F.sum("prob_1").alias("total"), F.sum("out_of_order").alias("n_out_of_order"))


@query(f"select {ROW} from (select *, row_number() over (order by {drawn(1, *KEY)}, {ROW}) as rn from {C}) q where rn <= 1000")
def o3_sample_n(spark, d):
    return sampling.sample_n(fx.calls(spark, d), 1000, order=sampling.text_order(_drawn(*KEY)))


@query(f"select {ROW}, case when rn <= floor(n * 0.9e0 + 0.5) then 'train' else 'valid' end as split from (select *, row_number() over (order by {drawn(1, *KEY)}, {ROW}) as rn, count(*) over () as n from {C}) q")
def o5_train_valid_split(spark, d):
    df = fx.calls(spark, d)
    return sampling.train_valid_split(df.where("label = 1"), df.where("label = 0"), order=sampling.text_order(_drawn(*KEY)))


@query(f"""with r as (select read_id, row_number() over (order by {drawn(1, "read_id")}, read_id) as rn, count(*) over () as n from (select distinct read_id from {C}) u)
  select c.read_id, count(*) as n, case when min(rn) <= floor(min(r.n) * 0.9e0 + 0.5) then 'train' else 'valid' end as split from {C} join r on c.read_id = r.read_id group by c.read_id""")
def o6_split_by_read(spark, d):
    got = sampling.split_by_read(fx.calls(spark, d), order=sampling.text_order(F.col("read_id")))
    return got.groupBy("read_id", "split").agg(F.count("*").alias("n"))


@query(f"select read_id, seq, doc_id, contig, start, flag, mapq, cigar, ref_end from ({fx.D_ALIGNMENTS}) a")
def o2_coordinate_sort(spark, d):
    return sampling.coordinate_sort(fx.alignments(spark, d)).select("read_id", "seq", "doc_id", "contig", "start", "flag", "mapq", "cigar", "ref_end")


@query(f"""with c as (select *, 'K' || cast(pos % 13 as varchar) as kmer, {drawn(1, *KEY)} as h from {C}), neg as (select * from c where label = 0 and pos % 3 > 0),
  pos as (select kmer, count(*) as n from c where label = 1 and depth > 30 and pos % 13 < 9 group by kmer), total as (select sum(n)::bigint as total from pos),
  quotas as (select kmer, ceil(total * (n / total::double)) as quota from pos, total),
  sizes as (select kmer, n, quota from (select kmer, count(*) as n from neg group by kmer) s left join quotas using (kmer)),
  first as (select total - coalesce(sum(least(n, quota)) filter (where quota is not null), 0) as missing, count(*) filter (where quota is null) as n_kmers from sizes, total group by total),
  even as (select kmer, n, quota, missing, case when quota is null then least(n, case when n_kmers > 0 and missing > 0 then ceil(missing / n_kmers::double) else 0 end) else 0 end as even, {drawn(1, 'kmer')} as kh from sizes, first),
  run as (select *, coalesce(sum(even) over (order by kh, kmer rows between unbounded preceding and 1 preceding), 0) as before from even),
  plan as (select kmer, (case when quota is null then 0 else least(n, quota) end) + case when before < 0.5e0 * missing then even else 0 end as take from run),
  ranks as (select neg.*, take, row_number() over (partition by kmer order by h, {ROW}) as rn from neg join plan using (kmer)),
  rest as (select *, row_number() over (order by h, {ROW}) as r2 from ranks where rn > take)
  select {ROW}, kmer from ranks where rn <= take union all select {ROW}, kmer from rest where r2 <= (select total - (select sum(take) from plan) from total)""")
def o7_balanced_negatives(spark, d):
    df = fx.calls(spark, d).withColumn("kmer", F.concat(F.lit("K"), (F.col("pos") % 13).cast("string")))
    return sampling.balance_by_kmer(
        df.where("label = 0 and pos % 3 > 0"), df.where("label = 1 and depth > 30 and pos % 13 < 9"),
        order=sampling.text_order(_drawn(*KEY)), kmer_order=sampling.text_order(F.col("kmer")),
    )


@query(f"select doc_id, read_id, seq, length from (select *, length(seq) as length, sum(length(seq)) over () as bases from ({fx.D_READS}) r) q where {drawn(1, 'read_id')} * 8 / 9223372036854775808e0 < least(40000e0 / bases, 1e0)")
def o8_subsampled_reads(spark, d):
    return sampling.subsample_coverage(fx.reads(spark, d).withColumn("length", F.length("seq")), 2.0, 20_000)


def _rounded(df, by: list[str], metrics: list[str]):
    return df.select(*by, "n_runs", *[X.half_up(F.col(f"{m}_{s}"), 1e5).alias(f"{m}_{s}") for m in metrics for s in ("mean", "sd")])


def _means(metrics: list[str]) -> str:
    return ", ".join(f"floor({f}({m}) * 1e5 + 0.5) / 1e5 as {m}_{s}" for m in metrics for s, f in (("mean", "avg"), ("sd", "stddev_pop")))


DRAWS = ["tp", "accuracy", "recall", "precision", "fall_out", "auc"]


@query(f"""with q as (select l.*, r.round, row_number() over (partition by r.round, is_true order by {drawn(1, 'r.round', 'event_id')}, event_id) as rn from {L} cross join (select unnest([1, 2, 3, 4, 5]) as round) r),
  s as (select q.*, z.size from q join (select unnest([100, 1000]) as size) z on rn <= z.size),
  k as (select *, rank() over (partition by size, round order by score) + (count(*) over (partition by size, round, score) - 1) / 2e0 as rk from s),
  n as (select size, round, count(*) filter (where is_true = 1) as p, count(*) filter (where is_true = 0) as q, count(*) filter (where is_true = 1 and predicted = 1) as tp,
    count(*) filter (where is_true = 0 and predicted = 1) as fp, sum(case when is_true = 1 then rk else 0 end) as rks from k group by size, round),
  m as (select size, round, tp, (tp + q - fp) / (p + q)::double as accuracy, tp / p::double as recall, tp / (tp + fp)::double as precision, fp / q::double as fall_out, (rks - p * (p + 1) / 2e0) / (p * q) as auc from n)
  select size, count(*) as n_runs, {_means(DRAWS)} from m group by size""")
def o9_repeated_metrics(spark, d):
    return _rounded(sampling.repeated_metrics(fx.labelled(spark, d), [100, 1000], key="event_id"), ["size"], DRAWS)


def _runs(by: str, group: str) -> str:
    """SQL of RUN_METRICS, from sites s ({by}, site, freq) and the truth t, and their summary by ``group``."""
    return f"""p as (select {by}, s.freq as x, t.freq as y, floor(t.freq * 100 + 0.5) / 100 as v from s join t using (contig, pos, strand)),
  r as (select *, {", ".join(f"rank() over (partition by {by} order by {c}) + (count(*) over (partition by {by}, {c}) - 1) / 2e0 as r{c}" for c in "xyv")} from p),
  m as (select {by}, count(*) as n_both, corr(x, y) as pearson, corr(x, y) * corr(x, y) as r2, corr(rx, ry) as spearman, corr(rx, rv) as spearman_rounded, sqrt(avg((x - y) * (x - y))) as rmse from r group by {by}),
  n as (select {by}, count(*) as n_sites, (select count(*) from t) as n_truth from s group by {by})
  select {group}, count(*) as n_runs, {_means(sampling.RUN_METRICS)} from m join n using ({by}) group by {group}"""


TRUE = f"t as (select contig, pos, strand, pct / 100e0 as freq from {T})"


@query(f"""with {TRUE}, u as (select * from (values (1, 0, 0), (1, 1, 1), (1, 2, 2), (2, 3, 0), (2, 3, 1), (2, 4, 0), (2, 4, 2), (2, 5, 1), (2, 5, 2), (3, 6, 0), (3, 6, 1), (3, 6, 2)) v(k, subset, hap)),
  s as (select k, subset, contig, pos, strand, count(*) filter (where prob_1 > 0.5) / count(*)::double as freq from {C} join u using (hap) group by 1, 2, 3, 4, 5), {_runs("k, subset", "k")}""")
def o10_coverage_effect(spark, d):
    df = fx.calls(spark, d)
    tables = {f"rep{h}": sites.site_frequency_count(df.where(F.col("hap") == h)) for h in (0, 1, 2)}
    return _rounded(sampling.coverage_effect(tables, _truth(spark, d)), ["k"], sampling.RUN_METRICS)


@query(f"""with {TRUE}, g as (select a.target, b.seed from (select unnest([1e0, 2e0]) as target) a cross join (select unnest([1, 2, 3]) as seed) b),
  c2 as (select c.*, (select count(distinct read_id) from {C}) as reads from {C}),
  s as (select target, seed, contig, pos, strand, count(*) filter (where prob_1 > 0.5) / count(*)::double as freq from c2 cross join g
    where {drawn(0, 'read_id').replace("'0/' || ", "cast(seed as varchar) || '/' || ")} * 8 / 9223372036854775808e0 < least(target * 5000e0 / reads, 1e0) group by 1, 2, 3, 4, 5), {_runs("target, seed", "target")}""")
def o11_coverage_sweep(spark, d):
    return _rounded(sampling.coverage_sweep(fx.calls(spark, d), _truth(spark, d), [1.0, 2.0], [1, 2, 3], 5000), ["target"], sampling.RUN_METRICS)


@query(f"""with {TRUE}, g as (select a.target, b.seed from (select unnest([1e0, 2e0]) as target) a cross join (select unnest([1, 2]) as seed) b),
  c2 as (select c.*, (select count(distinct read_id) from {C}) as reads from {C}),
  d as (select * from c2 cross join g where {drawn(0, 'read_id').replace("'0/' || ", "cast(seed as varchar) || '/' || ")} * 8 / 9223372036854775808e0 < least(target * 20000e0 / reads, 1e0)),
  a as ({routed("d", "target, seed,")}), s as (select target, seed, contig, pos, strand, n_mod / coverage as freq from a), {_runs("target, seed", "target")}""")
def o11_coverage_sweep_aggregate(spark, d):
    got = sampling.coverage_sweep(fx.calls(spark, d), _truth(spark, d), [1.0, 2.0], [1, 2], 20_000, mode="aggregate")
    return _rounded(got, ["target"], sampling.RUN_METRICS)


@query(f"select contig, pos, strand, read_id, prob_1, hap from {C}")
def u1_union(spark, d):
    df = fx.calls(spark, d).select(*SITE, "read_id", "prob_1", "hap")
    return joins.union_all([df.where(F.col("hap") == h) for h in (0, 1, 2)])


@query(f"select contig, pos, strand from {C} group by contig, pos, strand having count(*) filter (where hap = 0) >= 1 and count(*) filter (where hap = 1) >= 1 and count(*) filter (where hap = 2) >= 1")
def u2_common_sites(spark, d):
    df = fx.calls(spark, d)
    return sets.common_sites([df.where(F.col("hap") == h).groupBy(*SITE).agg(F.count("*").alias("coverage")) for h in (0, 1, 2)], SITE)


@query(f"select count(*) as n_removed from {S} where not exists (select 1 from {T} where t.contig = s.contig and t.pos = s.pos and t.strand = s.strand)")
def u3_removed_sites(spark, d):
    return sets.remove_unlisted(fx.sitefreq(spark, d), fx.truth(spark, d), SITE)[1]


@query(f"select contig, pos, strand, coverage, n_mod from {S} where exists (select 1 from {T} where t.contig = s.contig and t.pos = s.pos and t.strand = s.strand)")
def u3_kept_sites(spark, d):
    return sets.remove_unlisted(fx.sitefreq(spark, d), fx.truth(spark, d), SITE)[0].select(*SITE, "coverage", "n_mod")


@query(f"select distinct contig from {C} order by contig")
def u4_contigs(spark, d):
    return sets.contig_names(fx.calls(spark, d))


@query(f"""with k as (select distinct contig, case when strand = '-' then pos - 1 else pos end as site, split_part(read_id, '/', 2) as molecule from {C})
  select contig, site as pos, molecule from k union select contig, site + 1, molecule from k""")
def u5_sample_ids(spark, d):
    return sets.sample_ids(fx.calls(spark, d))
