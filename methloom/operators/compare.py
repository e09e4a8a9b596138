"""Agreement and classification metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calls import half_up
from ..sources.scratch import written
from .joins import pair_sites
from .windows import average_rank


def agreement(pairs: DataFrame, x: str = "x", y: str = "y", by: list[str] | None = None, ranked_y: Column | None = None, more: dict[str, Column] | None = None) -> DataFrame:
    """(by..., n_both, pearson, r2, spearman, rmse) of pairs of values; zeros below two pairs. ``ranked_y``: what
    of y is ranked; ``more``: names of further rank correlations and what of y they rank. Equal pairs are counted
    first, as a written table: frequencies of 0 and 1 are most sites, and one row each from there on."""
    by = by or []
    ranked = {"spearman": F.col(y) if ranked_y is None else ranked_y} | (more or {})
    own = pairs.select(*by, F.col(x).alias("x"), F.col(y).alias("y"), *[c.alias(f"v_{k}") for k, c in ranked.items()])
    values = [f"v_{k}" for k in ranked]
    counted = written(own.groupBy(*by, "x", "y", *values).agg(F.count("*").alias("n")))
    ranks = [average_rank(counted, c, by, count="n").select(*by, c, F.col("rank").alias(f"r{c}")) for c in ("x", *values)]
    for c, rank in zip(("x", *values), ranks, strict=True):
        counted = counted.join(rank, [*by, c])
    columns = ["x", "y", "rx", *(f"r{v}" for v in values)]
    means = counted.groupBy(*by).agg(*[(F.sum(F.col("n") * F.col(c)) / F.sum("n")).alias(f"_{c}") for c in columns])
    centred = counted.join(means, by) if by else counted.crossJoin(F.broadcast(means))  # one row

    def correlation(a: str, b: str) -> Column:
        u, v, n = F.col(a) - F.col(f"_{a}"), F.col(b) - F.col(f"_{b}"), F.col("n")
        spread = F.sqrt(F.sum(n * u * u) * F.sum(n * v * v))
        return F.when(spread > 0, F.sum(n * u * v) / spread)

    d, total = F.col("x") - F.col("y"), F.coalesce(F.sum("n"), F.lit(0))
    zero = lambda c: F.when(total > 1, F.coalesce(c, F.lit(0.0))).otherwise(0.0)
    out = centred.groupBy(*by).agg(
        total.alias("n_both"), zero(correlation("x", "y")).alias("pearson"), *[zero(correlation("rx", f"rv_{k}")).alias(k) for k in ranked],
        zero(F.sqrt(F.sum(F.col("n") * d * d) / F.sum("n"))).alias("rmse"),
    )
    return out.withColumn("r2", F.col("pearson") * F.col("pearson"))


def compare_sites(a: DataFrame, b: DataFrame, keys: list[str], value: str = "freq", cov_cf_a: int = 0, cov_cf_b: int = 0, round_b: bool = False) -> DataFrame:
    """One row: n_a, n_b, n_both, pearson, r2, spearman, rmse of two tables' sites from a
    coverage on; zeros below two common sites. ``round_b`` rounds b's values to 2 decimals before ranking."""
    a, b = a.where(F.col("coverage") >= cov_cf_a), b.where(F.col("coverage") >= cov_cf_b)
    pairs = pair_sites(a, b, keys, [value])
    stats = agreement(pairs, value, f"{value}_b", ranked_y=half_up(F.col(f"{value}_b"), 100.0) if round_b else None)
    return a.agg(F.count("*").alias("n_a")).crossJoin(b.agg(F.count("*").alias("n_b"))).crossJoin(stats)  # one row each


def summarise_runs(df: DataFrame, metrics: list[str], by: list[str] | None = None) -> DataFrame:
    """Mean and population standard deviation of metrics over runs."""
    aggs = [f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("sd", F.stddev_pop))]
    return df.groupBy(*(by or [])).agg(F.count("*").alias("n_runs"), *aggs)


def classification_metrics(df: DataFrame, label: str = "is_true", predicted: str = "predicted", by: list[str] | None = None) -> DataFrame:
    """The confusion table and its rates; a zero denominator gives 0."""
    t, p = F.col(label) == 1, F.col(predicted) == 1
    counts = df.groupBy(*(by or [])).agg(F.count_if(t & p).alias("tp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"), F.count_if(~t & p).alias("fp"))
    rate = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    tp, fn, tn, fp = (F.col(c) for c in ("tp", "fn", "tn", "fp"))
    return counts.select(
        *(by or []), "tp", "fn", "tn", "fp", rate(tp + tn, tp + tn + fp + fn).alias("accuracy"), rate(tp, tp + fn).alias("recall"),
        rate(tn, tn + fp).alias("specificity"), rate(tp, tp + fp).alias("precision"), rate(fp, fp + tn).alias("fall_out"),
        rate(fn, tp + fn).alias("miss_rate"), rate(fp, tp + fp).alias("fdr"), rate(tn, tn + fn).alias("npv"),
    )


def roc_auc(df: DataFrame, label: str = "is_true", score: str = "score", by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve by rank sums, exact with ties; 0 if a class is empty."""
    by = by or []
    counts = df.groupBy(*by, score).agg(F.sum((F.col(label) == 1).cast("long")).alias("pos"), F.count("*").alias("n"))
    ranks = average_rank(df, score, by).select(*by, score, "rank")
    out = counts.join(ranks, [*by, score]).groupBy(*by).agg(F.sum(F.col("pos") * F.col("rank")).alias("s"), F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"))
    return out.select(*by, F.when((F.col("p") > 0) & (F.col("q") > 0), (F.col("s") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))).otherwise(0.0).alias("auc"))
