"""Frames (W1-W8)."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .joins import overlap_join


#: Positions of a bin: what one task orders of a contig, with the rows next to it.
BIN = 1_000_000


def _starts(df: DataFrame, keys: list[str], value: Column, name: str, *more: Column) -> DataFrame:
    """(keys, _bin, name): the sum of ``value`` in the bins before each; a row a bin. ``more`` are further aggregates."""
    sums = df.groupBy(*keys, "_bin").agg(F.sum(value).alias("_sum"), *more)
    before = F.sum("_sum").over(W.partitionBy(*keys).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1))
    return sums.withColumn(name, F.coalesce(before, F.lit(0))).drop("_sum")


def _by_bin(df: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with their bin's row of a small table."""
    named = {c: f"_of_{c}" for c in (*keys, "_bin")}
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(n)) for c, n in named.items()])
    return df.join(table.withColumnsRenamed(named), same).drop(*named.values())


def neighbour_windows(sites: DataFrame, seq_len: int = 11, only_close: bool = False, bins: int = 20, chunk: int = 100_000, runs: list[str] | None = None) -> DataFrame:
    """For each site (contig, pos, strand[, hap], coverage, hist) the histograms of the seq_len sites
    around it and their distances; beyond the first and last site histograms are zeros and places are
    1000 away from them. ``only_close``: instead of a distance whether the place before is exactly 2 away. ``runs``:
    more columns whose values have windows of their own.

    Sites are numbered along their contig by counts of bins and dealt in chunks of ``chunk`` sites, with
    copies of those next to a chunk's ends, so frames are the same as over the whole contig."""
    keys = [*(runs or []), *(c for c in ("contig", "strand", "hap") if c in sites.columns)]
    pad = seq_len // 2
    if chunk <= pad:
        raise ValueError("a chunk has more sites than half a window")
    df = sites.withColumn("_bin", F.floor(F.col("pos") / BIN))
    ends = F.min("pos").alias("_min"), F.max("pos").alias("_max")
    whole = W.partitionBy(*keys)
    starts = _starts(df, keys, F.lit(1), "_start", *ends).withColumn("_low", F.min("_min").over(whole) - 1000).withColumn("_high", F.max("_max").over(whole) + 1000)
    numbered = _by_bin(df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys, "_bin").orderBy("pos"))), starts.drop("_min", "_max"), keys)
    rank = F.col("_start") + F.col("_rank") - 1
    own, at = F.floor(rank / chunk), rank % chunk
    homes = F.array_compact(F.array(own, F.when(at <= pad, own - 1), F.when(at >= chunk - pad - 1, own + 1)))
    df = numbered.withColumn("_own", own).withColumn("_chunk", F.explode(homes))
    line = W.partitionBy(*keys, "_chunk").orderBy("pos")
    near = line.rowsBetween(-pad, pad)
    before, after = line.rowsBetween(-pad, -1), line.rowsBetween(1, pad)
    zeros = F.array_repeat(F.lit(0.0), bins)
    df = df.withColumns({
        "_near": F.collect_list(F.struct("pos", "hist")).over(near), "_b": F.count("*").over(before), "_a": F.count("*").over(after),
        "_prior": F.lag("pos", pad + 1).over(line),
    }).where("_chunk = _own")
    left, right = F.greatest(pad - F.col("_b"), F.lit(0)).cast("int"), F.greatest(pad - F.col("_a"), F.lit(0)).cast("int")
    hists = F.concat(F.array_repeat(zeros, left), F.transform("_near", lambda s: s["hist"]), F.array_repeat(zeros, right))
    places = F.concat(F.array_repeat(F.col("_low"), left), F.transform("_near", lambda s: s["pos"]), F.array_repeat(F.col("_high"), right))
    if only_close:
        prior = F.concat(F.array(F.coalesce("_prior", F.col("_low"))), F.slice(places, 1, seq_len - 1))
        offsets = F.zip_with(places, prior, lambda p, q: (p - q == 2).cast("long"))
    else:
        offsets = F.transform(places, lambda p: F.abs(p - F.col("pos")).cast("long"))
    return df.select(*sites.columns, offsets.alias("offsets"), hists.alias("hists"))


def assign_islands(df: DataFrame, keys: list[str], pos: str = "pos", gap: int = 300_000, width: int | None = None) -> DataFrame:
    """Number of a row's island among its keys: a new one where the gap before is ``gap`` or more.
    With ``width`` keys are cut into bins of so many positions, for keys with more rows than a task should order."""
    if width:
        placed = position_gaps(df, keys, pos, width).withColumn("_bin", F.floor(F.col(pos) / width))
        placed = placed.withColumn("_new", F.coalesce((F.col("gap") >= gap).cast("int"), F.lit(1))).drop("gap")
        line = W.partitionBy(*keys, "_bin").orderBy(pos)
        within = placed.withColumn("_within", F.sum("_new").over(line))
        numbered = _by_bin(within, _starts(placed, keys, F.col("_new"), "_start"), keys)
        return numbered.withColumn("island", F.col("_start") + F.col("_within")).drop("_bin", "_new", "_within", "_start")
    line = W.partitionBy(*keys).orderBy(pos)
    new = F.coalesce((F.col(pos) - F.lag(pos).over(line) >= gap).cast("int"), F.lit(1))
    return df.withColumn("_new", new).withColumn("island", F.sum("_new").over(line)).drop("_new")


def position_gaps(df: DataFrame, keys: list[str], pos: str = "pos", width: int = BIN) -> DataFrame:
    """Distance to the place before, null for the first. Keys are cut into bins of ``width`` positions;
    a bin's first row takes the last place of the bins before from a table of bins."""
    binned = df.withColumn("_bin", F.floor(F.col(pos) / width))
    last = binned.groupBy(*keys, "_bin").agg(F.max(pos).alias("_last"))
    last = last.withColumn("_before", F.lag("_last").over(W.partitionBy(*keys).orderBy("_bin"))).drop("_last")
    prior = binned.withColumn("_prior", F.lag(pos).over(W.partitionBy(*keys, "_bin").orderBy(pos)))
    return _by_bin(prior, last, keys).withColumn("gap", F.col(pos) - F.coalesce("_prior", "_before")).drop("_bin", "_prior", "_before")


def average_rank(df: DataFrame, column: str, by: list[str] | None = None, buckets: int = 64, count: str | None = None) -> DataFrame:
    """(by..., column, n, rank): the average rank of each distinct value among all rows.

    Counts are summed by value, and values are dealt to ranges by approximate percentiles of all values, a row that
    is broadcast. A range starts from the sum of those before it, and values are ordered within a range: a running
    sum with no task that sees all values, or all of a group of ``by``, which ranks within groups. ``count`` names a
    column that says how many rows a row stands for."""
    by = by or []
    counts = df.groupBy(*by, column).agg((F.sum(count) if count else F.count("*")).alias("n"))
    bounds = counts.agg(F.percentile_approx(column, [i / buckets for i in range(1, buckets)], 10_000).alias("b"))
    placed = counts.crossJoin(F.broadcast(bounds)).withColumn("_p", F.size(F.filter("b", lambda x: x <= F.col(column)))).drop("b")
    sums = placed.groupBy(*by, "_p").agg(F.sum("n").alias("s"))  # a row a range of a group
    before = F.sum("s").over(W.partitionBy(*by).orderBy("_p").rowsBetween(W.unboundedPreceding, -1))
    named = {c: f"_of_{c}" for c in (*by, "_p")}
    starts = sums.select(*by, "_p", F.coalesce(before, F.lit(0)).alias("_start")).withColumnsRenamed(named)
    line = W.partitionBy(*by, "_p").orderBy(column).rowsBetween(W.unboundedPreceding, -1)
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(n)) for c, n in named.items()])
    ranked = placed.withColumn("_before", F.coalesce(F.sum("n").over(line), F.lit(0))).join(starts if by else F.broadcast(starts), same)
    return ranked.select(*by, column, "n", (F.col("_start") + F.col("_before") + (F.col("n") + 1) / 2).alias("rank"))


def smooth_sites(df: DataFrame, span: int = 500, width: int = BIN, more: list[str] | None = None) -> DataFrame:
    """(n, x) sites with the level sum(x) / sum(n) over span/2 on either side. Contigs are cut into bins of
    ``width`` positions; a bin has copies of the sites within span/2 of it. ``more``: other columns to sum alike."""
    keys, half = [c for c in ("contig", "group") if c in df.columns], span // 2
    bin_of = lambda c: F.floor(c / width)
    dealt = df.withColumn("_bin", F.explode(F.sequence(bin_of(F.col("pos") - half), bin_of(F.col("pos") + half))))
    near = W.partitionBy(*keys, "_bin").orderBy("pos").rangeBetween(-half, half)
    out = dealt.withColumns({f"smooth_{c}": F.sum(c).over(near) for c in ("n", "x", *(more or []))})
    return out.where(F.col("_bin") == bin_of(F.col("pos"))).drop("_bin").withColumn("level", F.col("smooth_x") / F.col("smooth_n"))


def call_regions(tests: DataFrame, dis_merge: int = 1500, minlen: int = 100, min_sites: int = 15, pct_sig: float = 0.5) -> DataFrame:
    """Regions of tested sites (contig, pos, significant): from the first to the last significant
    site of an island (gaps below dis_merge), long enough, with enough sites and share of significant ones."""
    islands = assign_islands(tests.where("significant").select("contig", "pos"), ["contig"], "pos", dis_merge, BIN)
    spans = islands.groupBy("contig", "island").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"), F.count("*").alias("n_significant"))
    tested = tests.select("contig", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"))
    n = overlap_join(spans, tested).groupBy("contig", "island", "start", "end", "n_significant").agg(F.count("*").alias("n_sites"))
    out = n.withColumn("length", F.col("end") - F.col("start"))
    keep = (F.col("length") >= minlen) & (F.col("n_sites") >= min_sites) & (F.col("n_significant") >= pct_sig * F.col("n_sites"))
    return out.where(keep).select("contig", "start", "end", "length", "n_sites", "n_significant")


def contig_chunks(reference: DataFrame, chunk_len: int = 500_000, motif: str = "CG") -> DataFrame:
    """(contig, start, end) of fixed chunks, an edge moved one up where it would cut the motif.
    reference: contig, chunk_start, seq, where a chunk's text reaches a base beyond its length."""
    ends = reference.groupBy("contig").agg(F.max(F.col("chunk_start") + F.length("seq")).alias("length"))
    edges = ends.select("contig", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)).cast("long"), F.lit(chunk_len).cast("long"))).alias("edge"))
    around = reference.select(
        "contig", (F.col("chunk_start") + F.length("seq")).alias("stop"), "chunk_start", "seq",
        F.explode(F.sequence((F.col("chunk_start") / chunk_len).cast("long"), ((F.col("chunk_start") + F.length("seq")) / chunk_len).cast("long"))).alias("k"),
    ).withColumn("edge", F.col("k") * chunk_len)
    cut = around.where((F.col("edge") > F.col("chunk_start")) & (F.col("edge") < F.col("stop"))).where(
        F.substr("seq", (F.col("edge") - F.col("chunk_start")).cast("int"), F.lit(len(motif))) == motif
    ).select("contig", "edge").distinct().withColumn("_cut", F.lit(1))
    moved = edges.join(cut, ["contig", "edge"], "left").withColumn("start", F.col("edge") + F.coalesce("_cut", F.lit(0)))
    line = W.partitionBy("contig").orderBy("edge")
    return moved.withColumn("end", F.coalesce(F.lead("start").over(line), F.col("length"))).where("start < end").select("contig", "start", "end")
