"""Set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import calls as X


def common_sites(dfs: list[DataFrame], keys: list[str], least: int = 1) -> DataFrame:
    """Keys that every table has at a coverage: one aggregate over the tagged union."""
    tagged = None
    for i, df in enumerate(dfs):
        own = df.where(F.col("coverage") >= least).select(*keys).withColumn("_src", F.lit(i))
        tagged = own if tagged is None else tagged.unionByName(own)
    return tagged.groupBy(*keys).agg(F.count_distinct("_src").alias("_n")).where(F.col("_n") == len(dfs)).select(*keys)


def remove_unlisted(df: DataFrame, listed: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose keys are listed, and a one-row table of how many were removed."""
    keys_only = listed.select(*keys).distinct()
    return df.join(keys_only, keys, "left_semi"), df.join(keys_only, keys, "left_anti").agg(F.count("*").alias("n_removed"))


def contig_names(df: DataFrame) -> DataFrame:
    """U4."""
    return df.select("contig").distinct().orderBy("contig")


def sample_ids(calls: DataFrame) -> DataFrame:
    """(contig, pos, molecule) for both strands of each called site."""
    site = X.folded(F.col("pos"), F.col("strand"))
    return calls.select("contig", F.explode(F.array(site, site + 1)).alias("pos"), X.molecule(F.col("read_id")).alias("molecule")).distinct()
