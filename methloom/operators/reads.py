"""Read-level gathering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import calls as X
from .sites import first_rows
from .windows import assign_islands


def collect_read_calls(calls: DataFrame, order: list | None = None, prob: str = "prob_1") -> DataFrame:
    """(read_id, calls) with one (loc, prob) a place, the first in order, sorted by place. A read's
    calls are bounded by its length."""
    one = first_rows(calls, ["read_id", "read_loc"], order or ["contig", "pos", "strand", prob])
    return one.groupBy("read_id").agg(F.array_sort(F.collect_list(F.struct(F.col("read_loc").alias("loc"), F.col(prob).alias("prob")))).alias("calls"))


def span_records(calls: DataFrame, threshold: float = 0.0, gap: int = 300_000) -> DataFrame:
    """A10: one row a read's island: contig, start, end, strand, read_id and the places and differences
    (prob_1 - prob_0) of its methylated and unmethylated calls above a threshold."""
    islands = assign_islands(calls, ["contig", "strand", "read_id"], "pos", gap).withColumn("d", F.col("prob_1") - F.col("prob_0"))
    one = lambda when: F.array_sort(F.collect_list(F.when(when, F.struct("pos", "d"))))
    got = islands.groupBy("contig", "strand", "read_id", "island").agg(
        F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"), one(F.col("d") > threshold).alias("met"), one(F.col("d") < -threshold).alias("unmet")
    )
    part = lambda c, f: F.transform(c, lambda s: s[f]).alias(f"{c}_{'pos' if f == 'pos' else 'delta'}")
    return got.select("contig", "start", "end", "strand", "read_id", part("met", "d"), part("unmet", "d"), part("met", "pos"), part("unmet", "pos"))


def strongest_call(df: DataFrame, keys: list[str] | None = None, value: str = "delta") -> DataFrame:
    """The row of the largest abs(value) of each (read, site); of equal ones the larger value."""
    keys = keys or ["read_id", "contig", "pos"]
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(F.abs(value), F.col(value))).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best.{c}").alias(c) for c in rest])


def dedupe_calls(calls: DataFrame, order: list | None = None) -> DataFrame:
    """The first call of each (contig, folded place, molecule), with how many there were."""
    keys = ["contig", "site", "molecule"]
    df = calls.withColumn("site", X.folded(F.col("pos"), F.col("strand"))).withColumn("molecule", X.molecule(F.col("read_id")))
    first = F.min_by(F.struct("pos", "strand", "read_loc", "prob_1", "label"), F.struct(*(order or ["read_loc", "pos", "prob_1"]))).alias("f")
    return df.groupBy(*keys).agg(first, F.count("*").alias("n_calls")).select(*keys, "f.pos", "f.strand", "f.read_loc", "f.prob_1", "f.label", "n_calls")


def observed(calls: DataFrame, name: str = "calls") -> tuple[DataFrame, Observation]:
    """``calls`` with counters that fill while a job runs over them: rows, modified, by haplotype."""
    watch = Observation(name)
    hap = [F.count_if(F.col("hap") == h).alias(f"n_hap{h}") for h in (1, 2)] if "hap" in calls.columns else []
    return calls.observe(watch, F.count("*").alias("n_calls"), F.count_if(F.col("label") == 1).alias("n_modified"), *hap), watch


def run_counters(calls: DataFrame) -> DataFrame:
    """Calls and reads of each haplotype, as a table."""
    return calls.groupBy("hap").agg(F.count("*").alias("n_calls"), F.count_distinct("read_id").alias("n_reads"))


def count_reads(calls: DataFrame, exact: bool = True) -> DataFrame:
    """Number of distinct molecules."""
    f = F.count_distinct if exact else F.approx_count_distinct
    return calls.agg(f(X.molecule(F.col("read_id"))).alias("n_molecules"))
