"""Filters (F1-F13). Plain predicates first, so that they reach the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cigar as C

# Alignment flag bits.
REVERSE, UNMAPPED, SECONDARY, QCFAIL, DUPLICATE, SUPPLEMENTARY = 16, 4, 256, 512, 1024, 2048


def _unset(mask: int) -> Column:
    return F.col("flag").bitwiseAND(mask) == 0


def with_cigar(df: DataFrame) -> DataFrame:
    """``df`` with its CIGAR as an array, if it is text."""
    return df.withColumn("cigar", C.parse(F.col("cigar"))) if dict(df.dtypes)["cigar"] == "string" else df


def filter_alignments(df: DataFrame, mapq: int = 1, identity: float = 0.0, keep_supplementary: bool = True, drop_qcfail: bool = False) -> DataFrame:
    """no unmapped, secondary or duplicate alignments (optionally no supplementary and
    quality-failed ones), mapping quality and identity from given values."""
    mask = UNMAPPED | SECONDARY | DUPLICATE | (0 if keep_supplementary else SUPPLEMENTARY) | (QCFAIL if drop_qcfail else 0)
    out = df.where(_unset(mask) & (F.col("mapq") >= mapq))
    return out.where(C.identity(with_cigar(out)["cigar"] if dict(df.dtypes)["cigar"] != "string" else C.parse(F.col("cigar"))) >= identity) if identity > 0 else out


def filter_primary(df: DataFrame, mapq: int = 0, contigs: list[str] | None = None) -> DataFrame:
    """flag 0 or 16, mapping quality, contigs."""
    out = df.where(F.col("flag").isin(0, REVERSE) & (F.col("mapq") >= mapq))
    return out.where(F.col("contig").isin(contigs)) if contigs else out


def filter_complete_kinetics(df: DataFrame) -> DataFrame:
    """reads whose four kinetics arrays are as long as their sequence."""
    for c in ("fi", "ri", "fp", "rp"):
        df = df.where(F.size(c) == F.length("seq"))
    return df


def window_fits(loc: Column, length: Column, flank: int, span: int = 1) -> Column:
    """the window around a site is inside the read on both strands (span: motif offset between them)."""
    return loc.between(flank, length - flank - 1) & (length - 1 - loc - span).between(flank, length - flank - 1)


def unclipped(length: Column, ops: Column, reverse: Column) -> tuple[Column, Column]:
    """First place in sequenced orientation that isn't soft-clipped, and the first one after those."""
    left, right = C.clip(ops), C.clip(ops, end=True)
    return F.when(reverse, right).otherwise(left), length - F.when(reverse, left).otherwise(right)


def outside_clips(loc: Column, length: Column, ops: Column, reverse: Column) -> Column:
    """a place in sequenced orientation that isn't soft-clipped."""
    first, last = unclipped(length, ops, reverse)
    return (loc >= first) & (loc < last)


def filter_calls(df: DataFrame, prob_cf: float = 0.0, rm_1strand: bool = False) -> DataFrame:
    """Drop unplaced calls, calls with abs(prob_0 - prob_1) below the cutoff and, if asked for,
    calls whose depth is of one strand."""
    if "pos" in df.columns:
        df = df.where(F.col("pos") != -1)
    if prob_cf > 0:
        df = df.where(F.abs(F.col("prob_0") - F.col("prob_1")) >= prob_cf)
    return df.where(F.instr(F.col("depth").cast("string"), ",") > 0) if rm_1strand else df


def filter_contigs(df: DataFrame, prefix: str | None = None, names: list[str] | None = None) -> DataFrame:
    """F9."""
    if prefix:
        df = df.where(F.col("contig").startswith(prefix))
    return df.where(F.col("contig").isin(names)) if names else df


def filter_coverage(df: DataFrame, least: int, column: str = "coverage") -> DataFrame:
    """F10 for a coverage column; for both strands' depths use ``depth_f`` and ``depth_r`` in turn."""
    return df.where(F.col(column) >= least)


def filter_mean_depth(df: DataFrame, least: float, column: str = "depths") -> DataFrame:
    """F10 for an array of depths: their mean."""
    total = F.aggregate(column, F.lit(0.0), lambda s, x: s + x)
    return df.where((F.size(column) > 0) & (total / F.size(column) >= least))


def clipped_pairs(blocks: Column, query: Column, n: int, matches_only: bool = True) -> Column:
    """true for a query place that isn't among the first or last n aligned pairs; for the places of whole reads take
    ``walks.inner_places``, which doesn't walk the blocks for each of them."""
    rank = C.pair_rank(blocks, query, matches_only)
    return (rank >= n) & (rank < C.pair_count(blocks, matches_only) - n)


def filter_region(df: DataFrame, region: str) -> DataFrame:
    """rows that overlap ``contig``, ``contig:start`` or ``contig:start-end`` (0-based, half open);
    a row ends at ref_end, or after its pos."""
    contig, _, span = region.rpartition(":") if ":" in region else (region, "", "")
    df = df.where(F.col("contig") == contig)
    if not span:
        return df
    start, _, end = span.partition("-")
    low, high = ("start", F.col("ref_end")) if "ref_end" in df.columns else ("pos", F.col("pos") + 1)
    df = df.where(high > int(start.replace(",", "")))
    return df.where(F.col(low) < int(end.replace(",", ""))) if end else df


def filter_kmer_length(df: DataFrame, k: int, column: str = "kmer") -> DataFrame:
    """F13."""
    return df.where(F.length(column) >= k)
