"""Column expressions over calls and site values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let_all


def half_up(x: Column, scale: float) -> Column:
    """x to 1/scale, halves up: the same in every engine."""
    return F.floor(x * scale + 0.5) / scale


def call_of_scores(p0: Column, p1: Column, kmer: Column) -> Column:
    """Struct of prob_0, prob_1 (normalised, 6 decimals), label and the five middle letters of the k-mer."""
    one = half_up(p1 / (p0 + p1), 1e6)
    middle = F.floor(F.length(kmer) / 2).cast("int")
    return F.struct(
        half_up(1 - one, 1e6).alias("prob_0"), one.alias("prob_1"), (p1 > p0).cast("int").alias("label"),
        F.substr(kmer, F.greatest(middle - 1, F.lit(1)), F.lit(5)).alias("kmer"),
    )


def shrink(values: Column, k: int, text: bool = False) -> Column:
    """The k middle letters or elements, null if there are fewer."""
    n = F.length(values) if text else F.size(values)
    start = F.floor((n - k) / 2).cast("int") + 1
    cut = F.substr(values, start, F.lit(k)) if text else F.slice(values, start, k)
    return F.when(n >= k, cut)


def percent(freq: Column) -> Column:
    """Whole percent as bedMethyl has it."""
    return F.floor(freq * 100 + 0.001 + 0.5).cast("int")


def pushed(score: Column, coverage: Column) -> Column:
    """Modified reads, unmodified reads and score, pushed to the ends: above 0.66 the count goes up to
    a whole read, to 0.33 down, between it has two decimals."""
    mod = F.when(score > 0.66, F.ceil(score * coverage).cast("double")).when(score <= 0.33, F.floor(score * coverage).cast("double")).otherwise(half_up(score * coverage, 100.0))
    return F.struct(mod.alias("n_mod"), (coverage - mod).alias("n_unmod"), F.when(mod == 0, 0.0).otherwise(mod / coverage).alias("score"))


def molecule(read_id: Column) -> Column:
    """Second field between slashes."""
    return F.split_part(read_id, F.lit("/"), F.lit(2))


def without_suffix(read_id: Column, suffix: str = "/ccs") -> Column:
    return F.regexp_replace(read_id, f"{suffix}$", "")


def folded(pos: Column, strand: Column) -> Column:
    """Place of a site's forward partner."""
    return F.when(strand == "-", pos - 1).otherwise(pos)


def deepest(depths: Column) -> Column:
    """Largest of a comma list of depths."""
    return F.array_max(F.transform(F.split(depths, ","), lambda x: x.cast("int")))


def bisulfite(ref: Column, called: Column, unmodified: Column, reverse: Column) -> Column:
    """Reference slice in which a CG's base (C, or G on reverse reads) is N if the site is not called as
    modified, T (A on reverse reads) if it is called unmodified, and itself if modified."""
    def projected(v: Column) -> Column:
        ref, back = v["ref"], v["reverse"]
        at = lambda i: F.when(back, i - 1).otherwise(i)  # noqa: E731  the site of letter i
        is_site = lambda i: (at(i) >= 0) & (F.substr(ref, at(i) + 1, F.lit(2)) == "CG")
        new = lambda i: (
            F.when(F.array_contains(v["unmodified"], at(i)), F.when(back, "A").otherwise("T"))
            .when(is_site(i) & ~F.array_contains(v["called"], at(i)), "N").otherwise(F.substr(ref, i + 1, F.lit(1)))
        )
        places = F.when(F.length(ref) > 0, F.sequence(F.lit(0), F.length(ref) - 1)).otherwise(F.array().cast("array<int>"))
        return F.array_join(F.transform(places, new), "")

    return let_all(projected, ref=ref, called=called, unmodified=unmodified, reverse=reverse)
