"""Site features and frequencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import calls as X
from ..functions import cigar as C
from ..functions.binding import let
from ..functions.gather import KINETICS, Plan, site_windows
from ..sources.scratch import written
from .filters import REVERSE, unclipped, with_cigar
from .joins import union_all
from .scoring import score_windows
from .windows import neighbour_windows

SITE = ["contig", "pos", "strand"]


def extract_features(alignments: DataFrame, motifs: list[str], mod_loc: int = 0, seq_len: int = 21, norm: str = "zscore",
                     skip_unmapped: bool = True, label: int = 1, maps: bool = False) -> DataFrame:
    """A1: one row a motif site of a read: locus, and for each strand the k-mer, passes, IPD and pulse
    width windows. seq is in alignment order; filter the alignments first. All reads of a batch are one line of
    bases, windows are cut from it by index arithmetic, in one pass over Arrow batches; nothing is shuffled. With
    ``maps`` the alignments carry ref_seq (``attach_ref_slice``) and rows the map codes of both windows."""
    df = with_cigar(alignments)
    kinds = dict(df.dtypes)
    reverse = F.col("flag").bitwiseAND(REVERSE) != 0
    kinetics = set(KINETICS) <= set(kinds)
    passing = ["contig", "strand", "read_id", *(c for c in ("fn", "rn", "sn") if c in kinds)]
    first, last = unclipped(F.length("seq"), F.col("cigar"), reverse)
    reads = df.select(
        *(c for c in passing if c != "strand"), F.when(reverse, "-").otherwise("+").alias("strand"), "start", "seq", "cigar", F.coalesce(reverse, F.lit(False)).alias("reverse"),
        first.cast("int").alias("first"), last.cast("int").alias("last"), *(KINETICS if kinetics else ()),
        *(["ref_seq", C.reference_length(F.col("cigar")).alias("ref_length")] if maps else []),
    )
    windows = {f"{s}_{v}": "array<double>" for s, v in (("f", "ipd"), ("f", "pw"), ("r", "ipd"), ("r", "pw"))} if kinetics else {}
    fields = {"pos": "bigint", "loc": "int", "f_kmer": "string", "r_kmer": "string"} | windows | ({"f_map": "array<int>", "r_map": "array<int>"} if maps else {})
    plan = Plan(motifs, mod_loc, seq_len, norm, skip_unmapped, kinetics, maps, passing)
    schema = ", ".join(f"{c} {t}" for c, t in (fields | {c: kinds.get(c, "string") for c in passing}).items())
    rows = reads.mapInArrow(site_windows(plan), schema)
    own = [c for c in fields if c not in ("pos", "loc")]
    return rows.select("contig", F.col("pos").cast(kinds["start"]), "strand", "read_id", "loc", *own, *passing[3:], F.lit(label).alias("label"))


def site_frequency(calls: DataFrame, by_strand: bool = True) -> DataFrame:
    """A2, A3: sums, counts and frequency of each site of filtered calls; the k-mer of the first call in
    read order. Without strand the first call's strand is kept. Partial sums meet one shuffle."""
    keys = SITE if by_strand else SITE[:2]
    first = F.struct("read_id", "read_loc")
    aggs = [
        F.sum("prob_0").alias("p0_sum"), F.sum("prob_1").alias("p1_sum"), F.sum(F.col("label").cast("long")).alias("n_mod"),
        F.sum(1 - F.col("label").cast("long")).alias("n_unmod"), F.count("*").alias("coverage"),
    ]
    if not by_strand:
        aggs.append(F.min_by("strand", F.struct("read_id", "read_loc", "strand")).alias("strand"))
    if "kmer" in calls.columns:
        aggs.append(F.min_by("kmer", first).alias("kmer"))
    return calls.groupBy(*keys).agg(*aggs).withColumn("freq", F.col("n_mod") / F.col("coverage"))


def site_frequency_count(calls: DataFrame, prob_cf: float = 0.0, no_amb_cov: bool = False, by_hap: bool = False, prob: str = "prob_1") -> DataFrame:
    """A4, A5: coverage, modified count and frequency by counting calls above 0.5.

    Ambiguous calls (abs(2 p - 1) < cutoff) do not count; coverage is of the others with ``no_amb_cov``,
    else of all calls, and then a site with ambiguous calls has round(coverage * freq, 2) modified. By
    haplotype: rows of all calls (hap null) and of haplotypes 1 and 2, in one pass."""
    got, keys = _site_counts(calls, SITE, prob_cf, by_hap, prob)
    return _counted(got, keys, no_amb_cov)


def _site_counts(calls: DataFrame, keys: list[str], prob_cf: float, by_hap: bool, prob: str, bins: int = 0) -> tuple[DataFrame, list[str]]:
    """Counts of all, of kept and of modified calls of each site, and with ``bins`` of each bin of probabilities; by
    haplotype also of haplotypes 1 and 2, in the same pass; and what a row is of."""
    kept = F.abs(2 * F.col(prob) - 1) >= prob_cf
    df = calls.withColumn("_kept", kept.cast("long")).withColumn("_mod", (kept & (F.col(prob) > 0.5)).cast("long"))
    bin_ = F.least(F.floor(F.col(prob) * bins), F.lit(bins - 1))
    aggs = [F.sum("_kept").alias("n_kept"), F.sum("_mod").alias("n"), F.count("*").alias("n_all"), *[F.count_if(bin_ == k).alias(f"_{k}") for k in range(bins)]]
    if not by_hap:
        return df.groupBy(*keys).agg(*aggs), keys
    df = df.withColumn("hap", F.when(F.col("hap").isin(1, 2), F.col("hap")))
    sets = df.groupingSets([[F.col(c) for c in keys], [F.col(c) for c in [*keys, "hap"]]], *keys, "hap").agg(*aggs, F.grouping("hap").alias("_all"))
    return sets.where("_all = 1 or hap is not null").drop("_all"), [*keys, "hap"]


def _counted(got: DataFrame, keys: list[str], no_amb_cov: bool) -> DataFrame:
    """Coverage, modified count and frequency from a site's counts."""
    freq = F.when(F.col("n_kept") > 0, F.col("n") / F.col("n_kept")).otherwise(0.0)
    mod = F.col("n").cast("double")
    if not no_amb_cov:
        mod = F.when(F.col("n_kept") == F.col("n_all"), mod).otherwise(X.half_up(F.col("n_all") * freq, 100.0))
    return got.select(*keys, F.col("n_kept" if no_amb_cov else "n_all").alias("coverage"), mod.alias("n_mod"), freq.alias("freq"))


def _unit(bins: int) -> Column:
    """The histogram of unit length (6 decimals) of bin counts."""
    hist = F.array(*[F.col(f"_{k}").cast("double") for k in range(bins)])

    def scaled(h: Column) -> Column:
        return let(F.sqrt(F.aggregate(h, F.lit(0.0), lambda s, x: s + x * x)), lambda norm: F.transform(h, lambda x: X.half_up(x / norm, 1e6)))

    return let(hist, scaled)


def fold_strands(df: DataFrame) -> DataFrame:
    """Reverse-strand rows at their forward partner's place, as forward; those at 0 are dropped."""
    df = df.where("not (strand = '-' and pos = 0)")
    return df.withColumn("pos", X.folded(F.col("pos"), F.col("strand"))).withColumn("strand", F.lit("+"))


def site_histogram(calls: DataFrame, bins: int = 20, min_cov: int = 4, keys: list[str] | None = None, prob: str = "prob_1") -> DataFrame:
    """Histogram of a site's probabilities, of unit length (6 decimals), for sites of enough calls."""
    got, keys = _site_counts(calls, keys or SITE, 0.0, False, prob, bins)
    return got.where(F.col("n_all") >= min_cov).select(*keys, F.col("n_all").alias("coverage"), _unit(bins).alias("hist"))


def site_frequency_aggregate(calls: DataFrame, scorer=None, bins: int = 20, min_cov: int = 4, seq_len: int = 11, prob: str = "prob_1", prob_cf: float = 0.0,
                             no_amb_cov: bool = False, by_hap: bool = False, discrete: bool = True, only_close: bool = False, runs: list[str] | None = None) -> DataFrame:
    """Sites below ``min_cov`` calls by counting (with the cutoff of ``site_frequency_count``), the others by a model
    over their neighbour windows; low sites are no neighbours. Scores are pushed to the ends (X19) or, unless
    ``discrete``, give round(coverage * score, 2) modified.

    By haplotype: rows of all calls (hap null) and of haplotypes 1 and 2, each routed by its own coverage, with
    neighbours of its own. ``runs``: columns whose values are tables of their own. Calls are shuffled once: the counts
    of all sets are a written table, from which both routes start."""
    counts, keys = _site_counts(calls, [*(runs or []), *SITE], prob_cf, by_hap, prob, bins)
    counts = written(counts)
    low = _counted(counts.where(F.col("n_all") < min_cov), keys, no_amb_cov)
    high = counts.where(F.col("n_all") >= min_cov).select(*keys, F.col("n_all").alias("coverage"), _unit(bins).alias("hist"))
    scored = score_windows(neighbour_windows(high, seq_len, only_close, bins, runs=runs), scorer)
    if discrete:
        scored = scored.withColumn("x", X.pushed(F.col("score"), F.col("coverage"))).withColumns({"n_mod": F.col("x.n_mod"), "freq": F.col("x.score")})
    else:
        scored = scored.withColumns({"n_mod": X.half_up(F.col("coverage") * F.col("score"), 100.0), "freq": F.col("score")})
    return low.unionByName(scored.select(*keys, "coverage", F.col("n_mod").cast("double").alias("n_mod"), F.col("freq").cast("double").alias("freq")))


def combine_site_freq(dfs: list[DataFrame]) -> DataFrame:
    """Tables of one layout added up."""
    sums = [F.sum(c).alias(c) for c in ("p0_sum", "p1_sum", "n_mod", "n_unmod", "coverage")]
    return union_all(dfs).groupBy(*SITE).agg(*sums).withColumn("freq", F.col("n_mod") / F.col("coverage"))


def merge_strands(df: DataFrame, layout: str = "counts") -> DataFrame:
    """The strands of a table merged at the forward place. ``counts`` adds coverage and n_mod;
    ``bedmethyl`` weighs freq by coverage; ``bisulfite`` adds met and unmet. No coverage: no site."""
    at = df.withColumn("pos", X.folded(F.col("pos"), F.col("strand"))).groupBy("contig", "pos")
    if layout == "counts":
        out = at.agg(F.sum("coverage").alias("coverage"), F.sum("n_mod").alias("n_mod"))
    elif layout == "bedmethyl":
        out = at.agg(F.sum("coverage").alias("coverage"), F.sum(F.col("coverage") * F.col("freq")).alias("n_mod"))
    elif layout == "bisulfite":
        out = at.agg(F.sum(F.col("met") + F.col("unmet")).alias("coverage"), F.sum("met").alias("n_mod"))
    else:
        raise ValueError(f"unknown layout: {layout}")
    return out.where("coverage > 0").withColumn("freq", F.col("n_mod") / F.col("coverage"))


def average_truth(dfs: list[DataFrame], value: str = "pct") -> DataFrame:
    """Mean of several tables at each site."""
    return union_all(dfs).groupBy(*SITE).agg(F.avg(value).alias(value), F.count("*").alias("n_tables"))


def coverage_summary(df: DataFrame, least: int) -> DataFrame:
    """Mean coverage of all sites, number of sites, number from a coverage on."""
    return df.agg(F.avg("coverage").alias("mean_coverage"), F.count("*").alias("n_sites"), F.count_if(F.col("coverage") >= least).alias("n_covered"))


def kmer_distribution(df: DataFrame) -> DataFrame:
    """Count and share of each k-mer; the total is one row."""
    counts = df.groupBy("kmer").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("kmer", "n", (F.col("n") / F.col("total")).alias("share"))


def dmr_input(df: DataFrame, least: int = 1, fold: bool = True, is_percent: bool = False) -> DataFrame:
    """(contig, pos, n, x): coverage and modified count of each site, strands added up or kept
    apart, from a coverage on. With a frequency in percent (or as a fraction) x is rounded from it."""
    mod = F.col("n_mod") if "n_mod" in df.columns else F.floor(F.col("coverage") * F.col("freq") / (100.0 if is_percent else 1.0) + 0.5).cast("long")
    at = df.withColumn("_x", mod)
    if fold:
        at = at.withColumn("pos", X.folded(F.col("pos"), F.col("strand"))).groupBy("contig", "pos").agg(F.sum("coverage").alias("n"), F.sum("_x").alias("x"))
    else:
        at = at.select("contig", "pos", F.col("coverage").alias("n"), F.col("_x").alias("x"))
    return at.where(F.col("n") >= least)


def first_rows(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in a total order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
