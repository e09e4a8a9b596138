"""Writers (K1-K9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calls as X
from ..functions.cigar import MATCHES
from ..functions.sequence import reverse_complement
from ..operators.filters import REVERSE

CALL_COLUMNS = ["contig", "pos", "strand", "read_id", "read_loc", "depth", "prob_0", "prob_1", "label", "kmer"]
FREQ_COLUMNS = ["contig", "pos", "pos_end", "strand", "p0_sum", "p1_sum", "n_mod", "n_unmod", "coverage", "freq", "kmer"]


def _text(df: DataFrame) -> DataFrame:
    """All columns as text: arrays joined by commas, null as a dot."""
    cell = lambda c, t: F.array_join(F.transform(c, lambda x: x.cast("string")), ",", ".") if t.startswith("array") else F.col(c).cast("string")
    return df.select(*[F.coalesce(cell(c, t), F.lit(".")).alias(c) for c, t in df.dtypes])


def _write(df: DataFrame, path: str, fmt: str, gzip: bool) -> None:
    if fmt == "parquet":
        df.write.parquet(path)
    else:
        _text(df).write.options(sep="\t", quote="", escapeQuotes="false", emptyValue="").option("compression", "gzip" if gzip else "none").csv(path)


def write_features(df: DataFrame, path: str, fmt: str = "tsv", gzip: bool = False) -> None:
    """K1: features as TSV (lists joined by commas) or parquet."""
    _write(df, path, fmt, gzip)


def write_calls(df: DataFrame, path: str, fmt: str = "tsv", gzip: bool = False) -> None:
    """K2."""
    _write(df.select(*CALL_COLUMNS), path, fmt, gzip)


def site_freq_rows(df: DataFrame) -> DataFrame:
    """The text layout: sums with 3 decimals, frequency with 4 (a millionth added)."""
    return df.where("coverage > 0").select(
        "contig", "pos", (F.col("pos") + 1).alias("pos_end"), "strand", F.format_string("%.3f", "p0_sum").alias("p0_sum"),
        F.format_string("%.3f", "p1_sum").alias("p1_sum"), "n_mod", "n_unmod", "coverage",
        F.format_string("%.4f", F.col("n_mod") / F.col("coverage") + 1e-6).alias("freq"), "kmer",
    )


def write_site_freq(df: DataFrame, path: str, fmt: str = "tsv", sort: bool = True, gzip: bool = False) -> None:
    """K3: site frequencies; with ``sort`` the files are in genome order, each within its range."""
    if sort:
        df = df.repartitionByRange("contig", "pos", "strand").sortWithinPartitions("contig", "pos", "strand")
    if fmt == "bed":
        write_bedmethyl(df, path, gzip)
    else:
        _write(site_freq_rows(df) if fmt == "tsv" else df, path, fmt, gzip)


def bedmethyl_rows(df: DataFrame) -> DataFrame:
    """K4: the 11 columns of bedMethyl, with whole percent."""
    return df.where("coverage > 0").select(
        "contig", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), F.lit(".").alias("name"), F.col("coverage").cast("long").alias("score"),
        "strand", F.col("pos").alias("thick_start"), (F.col("pos") + 1).alias("thick_end"), F.lit("0,0,0").alias("rgb"),
        F.col("coverage").cast("long").alias("coverage"), X.percent(F.col("n_mod") / F.col("coverage")).alias("pct"),
    )


def write_bedmethyl(df: DataFrame, path: str, gzip: bool = False) -> None:
    _write(bedmethyl_rows(df), path, "tsv", gzip)


def write_by_hap(df: DataFrame, path: str) -> None:
    """K5: one folder a haplotype: ``all`` for rows of all calls (null), 0 for unphased calls; a haplotype
    without rows has none."""
    df.withColumn("hap", F.coalesce(F.col("hap").cast("string"), F.lit("all"))).write.partitionBy("hap").parquet(path)


def write_by_contig(df: DataFrame, path: str) -> None:
    """K6: one folder a contig; ``merged_by_contig`` merges them."""
    df.write.partitionBy("contig").parquet(path)


def merged_by_contig(spark: SparkSession, path: str, contigs: DataFrame | None = None) -> DataFrame:
    """K6: the folders of ``write_by_contig`` as one table in the order of a contig table (contig, rank; those that it
    lacks come last) or of names, then place and strand; files that are written of it are in that order."""
    schema = dict(spark.read.parquet(path).dtypes)
    df = spark.read.schema(", ".join(f"`{c}` {'string' if c == 'contig' else t}" for c, t in schema.items())).parquet(path)
    cols = ["contig", "pos", *(["strand"] if "strand" in schema else [])]
    if contigs is not None:
        df = df.join(contigs.select("contig", F.col("rank").alias("_rank")), "contig", "left").withColumn("_rank", F.coalesce("_rank", F.lit(1 << 30)))
        cols = ["_rank", *cols]
    return df.repartitionByRange(*cols).sortWithinPartitions(*cols).drop("_rank")


def _cigar_text(cigar: Column) -> Column:
    text = F.array_join(F.transform(cigar, lambda o: F.concat(o["len"].cast("string"), o["op"])), "")
    return F.when(text == "", "*").otherwise(text)


def sam_rows(df: DataFrame) -> DataFrame:
    """One SAM line an alignment, tags in name order."""
    tags = F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))
    cigar = _cigar_text(F.col("cigar")) if dict(df.dtypes)["cigar"] != "string" else F.col("cigar")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    one = lambda c: (F.coalesce(F.col(c), F.lit(-1)) + 1).cast("string")
    fields = ["read_id", number("flag"), F.coalesce("contig", F.lit("*")), one("start"), number("mapq"), cigar,
              F.coalesce("mate_contig", F.lit("*")), one("mate_start"), number("tlen"), "seq", F.coalesce("qual", F.lit("*"))]
    line = F.concat_ws("\t", *fields)
    return df.select(F.when(F.size(tags) > 0, F.concat_ws("\t", line, F.array_join(tags, "\t"))).otherwise(line).alias("value"))


def write_alignments(df: DataFrame, header: list[str], path: str, program: str = "methloom", fmt: str = "sam") -> None:
    """K7: SAM text (header lines and a PG line first) or parquet. The header is the first partition of the
    written table, the alignments' partitions follow in their order."""
    if fmt == "parquet":
        df.write.parquet(path)
        return
    lines = [*header, f"@PG\tID:{program}\tPN:{program}"]
    head = df.sparkSession.createDataFrame([(x,) for x in lines], "value string").coalesce(1)
    head.union(sam_rows(df)).write.text(path)


def alignments_to_fastq(df: DataFrame, path: str, tags: list[str] | None = None) -> None:
    """K8: reads in sequenced orientation, the named tags (all by default) as comment."""
    fastq_rows(df, tags).write.text(path)


def fastq_rows(df: DataFrame, tags: list[str] | None = None) -> DataFrame:
    reverse = F.col("flag").bitwiseAND(REVERSE) != 0
    entries = F.array_sort(F.map_entries("tags"))
    if tags is not None:
        entries = F.filter(entries, lambda e: e["key"].isin(tags))
    comment = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(":"), e["value"])), "\t")
    head = F.when(comment == "", F.concat(F.lit("@"), "read_id")).otherwise(F.concat(F.lit("@"), "read_id", F.lit(" "), comment))
    qual = F.when(F.coalesce("qual", F.lit("*")) == "*", F.repeat(F.lit("!"), F.length("seq"))).otherwise(F.when(reverse, F.reverse("qual")).otherwise(F.col("qual")))
    return df.select(F.concat_ws("\n", head, F.when(reverse, reverse_complement("seq")).otherwise(F.col("seq")), F.lit("+"), qual).alias("value"))


def alignments_to_fasta(df: DataFrame, path: str, ids_path: str | None = None) -> None:
    """K8: mapped primary reads as FASTA, and their names."""
    mapped = df.where(F.col("flag").bitwiseAND(4 | 256 | 2048) == 0)
    reverse = F.col("flag").bitwiseAND(REVERSE) != 0
    seq = F.when(reverse, reverse_complement("seq")).otherwise(F.col("seq"))
    mapped.select(F.concat_ws("\n", F.concat(F.lit(">"), "read_id"), seq).alias("value")).write.text(path)
    if ids_path:
        mapped.select("read_id").distinct().write.text(ids_path)


def write_read_calls(df: DataFrame, path: str | None = None, table: str | None = None, buckets: int = 64) -> None:
    """K9: per-read call lists for lookup by read: a bucketed table, or files sorted by read."""
    if table:
        df.write.bucketBy(buckets, "read_id").sortBy("read_id").saveAsTable(table)
    else:
        df.repartitionByRange("read_id").sortWithinPartitions("read_id").write.parquet(path)


def mean_identity_length(df: DataFrame) -> DataFrame:
    """Reads, bases and matched bases of a set of alignments, as a run's summary."""
    matched = F.aggregate("cigar", F.lit(0), lambda s, o: s + F.when(o["op"].isin(*MATCHES), o["len"]).otherwise(0))
    return df.agg(F.count("*").alias("n_reads"), F.sum(F.length("seq")).alias("n_bases"), F.sum(matched).alias("n_matched"))
