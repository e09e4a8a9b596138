"""Readers (S1-S12). Every layout has an explicit schema; ``.`` is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import cigar as C

Paths = str | list[str]
CALLS = "contig string, pos long, strand string, read_id string, read_loc int, depth string, prob_0 double, prob_1 double, label int, kmer string"
SITE_FREQ = {
    "v11": "contig string, pos long, pos_end long, strand string, p0_sum double, p1_sum double, n_mod long, n_unmod long, coverage long, freq double, kmer string",
    "v10": "contig string, pos long, strand string, p0_sum double, p1_sum double, n_mod long, n_unmod long, coverage long, freq double, kmer string",
    "offset11": "contig string, pos long, strand string, pos_in_strand long, p0_sum double, p1_sum double, n_mod long, n_unmod long, coverage long, freq double, kmer string",
}
BEDMETHYL = "contig string, pos long, pos_end long, name string, score int, strand string, thick_start long, thick_end long, rgb string, coverage long, pct int"
BISULFITE = "contig string, pos long, strand string, met long, unmet long, motif string, context string"
STRAND_FIELDS = ["kmer", "pass", "ipd", "ipd_sd", "pw", "pw_sd", "sn", "map"]


def _tsv(spark: SparkSession, path: Paths, schema: str, **options) -> DataFrame:
    return spark.read.options(sep="\t", nullValue=".", quote="", **options).schema(schema).csv(path)


def _ints(c: Column, kind: str = "int") -> Column:
    """A tag array such as C,1,2,3 without its type letter."""
    return F.transform(F.filter(F.split(c, ","), lambda x: x.rlike(r"^-?[0-9]")), lambda x: x.cast(kind))


def read_alignments(spark: SparkSession, path: Paths) -> DataFrame:
    """SAM text or parquet as alignments: 11 fields, typed optional tags (absent arrays are empty,
    absent numbers 0) and all tags as a map NAME -> TYPE:VALUE. start is 0-based."""
    first = path if isinstance(path, str) else path[0]
    if ".parquet" in first:
        return spark.read.parquet(*([path] if isinstance(path, str) else path))
    lines = spark.read.text(path).where(~F.col("value").startswith("@") & (F.col("value") != ""))
    f = F.split("value", "\t")
    tag_list = F.filter(F.slice(f, 12, F.greatest(F.size(f) - 11, F.lit(0))), lambda t: F.length(t) >= 5)
    entries = F.transform(tag_list, lambda t: F.struct(F.substr(t, F.lit(1), F.lit(2)).alias("key"), F.substr(t, F.lit(4)).alias("value")))
    df = lines.select(
        f[0].alias("read_id"), f[1].cast("int").alias("flag"), F.nullif(f[2], F.lit("*")).alias("contig"), (f[3].cast("long") - 1).alias("start"),
        f[4].cast("int").alias("mapq"), C.parse(f[5]).alias("cigar"), f[6].alias("mate_contig"), (f[7].cast("long") - 1).alias("mate_start"),
        f[8].cast("long").alias("tlen"), f[9].alias("seq"), f[10].alias("qual"), F.map_from_entries(entries).alias("tags"),
    )
    value = lambda name: F.substr(F.try_element_at(F.col("tags"), F.lit(name)), F.lit(3))
    array = lambda name, kind: F.coalesce(_ints(value(name), kind), F.array().cast(f"array<{kind}>"))
    return df.withColumns({
        **{t: array(t, "int") for t in ("fi", "ri", "fp", "rp")}, "sn": array("sn", "double"),
        **{t: F.coalesce(value(t).cast("int"), F.lit(0)) for t in ("fn", "rn")}, "hap": F.coalesce(value("HP").try_cast("int"), F.lit(0)),
        "mm": value("MM"), "ml": array("ML", "int"), "ref_end": F.col("start") + C.reference_length(F.col("cigar")),
    })


def _lines(spark: SparkSession, path: Paths) -> DataFrame:
    """(value, file, block, id) of every line: a file's blocks are in the order of ``block``, a block's lines in that of ``id``."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))


def read_reference(spark: SparkSession, path: Paths, chunk_len: int = 100_000, overlap: int = 32) -> DataFrame:
    """S3: FASTA as upper-case chunks (contig, chunk_start, seq) of chunk_len bases and an overlap.

    A line's place in its contig is a running sum within its block of the file and, from a table of blocks,
    the bases before that; lines meet in chunks, so no contig is one row or one task."""
    lines = _lines(spark, path).withColumn("head", F.col("value").startswith(">"))
    name = F.when(F.col("head"), F.split_part(F.trim(F.substr("value", F.lit(2))), F.lit(" "), F.lit(1)))
    bases = F.when(F.col("head"), "").otherwise(F.upper(F.regexp_replace("value", r"\s", "")))
    block = W.partitionBy("file", "block").orderBy("id").rowsBetween(W.unboundedPreceding, 0)
    lines = lines.select("file", "block", "id", name.alias("name"), bases.alias("bases")).withColumn("run", F.sum(F.length("bases")).over(block))
    lines = lines.withColumn("from", F.max(F.when(F.col("name").isNotNull(), F.col("run"))).over(block)).withColumn("contig", F.last("name", ignorenulls=True).over(block))
    # At a block's end: the contig, and its bases since its header or the block's beginning.
    ends = lines.groupBy("file", "block").agg(F.max_by("contig", "id").alias("contig"), (F.max("run") - F.coalesce(F.max("from"), F.lit(0))).alias("tail"))
    files = W.partitionBy("file").orderBy("block")
    ends = ends.withColumn("part", F.sum(F.col("contig").isNotNull().cast("int")).over(files))
    ends = ends.withColumn("length", F.sum("tail").over(W.partitionBy("file", "part").orderBy("block"))).withColumn("last", F.last("contig", ignorenulls=True).over(files))
    before = ends.select(F.col("file").alias("_file"), F.col("block").alias("_block"), F.lag("length", 1, 0).over(files).alias("carry"), F.lag("last").over(files).alias("prior"))
    placed = lines.where("bases <> ''").join(before, (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")))
    start = F.col("run") - F.length("bases") + F.when(F.col("contig").isNull(), F.col("carry")).otherwise(-F.col("from"))
    placed = placed.select(F.coalesce("contig", "prior").alias("contig"), start.alias("at"), "bases").where("contig is not null")
    stop = F.col("at") + F.length("bases")
    first, last = F.greatest(F.floor((F.col("at") - overlap) / chunk_len), F.lit(0)), F.floor((stop - 1) / chunk_len)

    def cut(k: Column) -> Column:
        """What a line has of chunk k. Bytes are cut out in constant time, characters by walking from the line's start."""
        low, high = F.greatest(F.col("at"), k * chunk_len), F.least(stop, k * chunk_len + chunk_len + overlap)
        bases = F.substring(F.col("_bytes"), (low - F.col("at") + 1).cast("int"), (high - low).cast("int"))
        return F.struct((k * chunk_len).alias("chunk_start"), F.struct(low.alias("at"), bases.cast("string").alias("bases")).alias("part"))

    parts = placed.withColumn("_bytes", F.col("bases").cast("binary")).select("contig", F.explode(F.transform(F.sequence(first, last), cut)).alias("c"))
    got = parts.groupBy("contig", "c.chunk_start").agg(F.array_sort(F.collect_list("c.part")).alias("parts"))
    return got.select("contig", "chunk_start", F.array_join(F.transform("parts", lambda x: x["bases"]), "").alias("seq"))


def contig_lengths(reference: DataFrame) -> DataFrame:
    """S4."""
    return reference.groupBy("contig").agg(F.max(F.col("chunk_start") + F.length("seq")).alias("length"))


def read_contig_names(spark: SparkSession, source: str) -> DataFrame:
    """Names from a comma list, or from a file that is FASTA or has a name a line."""
    if "/" not in source and not source.endswith((".fa", ".fasta", ".txt", ".list")):
        return spark.createDataFrame([(x.strip(),) for x in source.split(",") if x.strip()], "contig string").distinct()
    lines = spark.read.text(source).where(F.trim("value") != "")
    fasta = lines.agg(F.coalesce(F.bool_or(F.col("value").startswith(">")), F.lit(False)).alias("fasta"))
    named = lines.crossJoin(F.broadcast(fasta)).where(~F.col("fasta") | F.col("value").startswith(">"))
    return named.select(F.split_part(F.regexp_replace("value", "^>", ""), F.lit(" "), F.lit(1)).alias("contig")).distinct()


def _numbers(c: str) -> Column:
    return F.transform(F.split(c, ","), lambda x: x.try_cast("double")).alias(c)


def read_features(spark: SparkSession, path: Paths, strands: int = 2) -> DataFrame:
    """22-column (both strands) or 14-column feature tables with lists as arrays."""
    sides = ["f_", "r_"] if strands == 2 else [""]
    names = ["contig", "pos", "strand", "read_id", "loc", *[s + c for s in sides for c in STRAND_FIELDS], "label"]
    df = _tsv(spark, path, ", ".join(f"`{n}` string" for n in names))
    lists = {s + c for s in sides for c in STRAND_FIELDS if c not in ("kmer", "pass")}
    kinds = {"pos": "long", "loc": "int", "label": "int"} | {f"{s}pass": "int" for s in sides}
    return df.select(*[_numbers(n) if n in lists else F.col(n).try_cast(kinds.get(n, "string")).alias(n) for n in names])


def read_calls(spark: SparkSession, paths: Paths, name_contains: str | None = None) -> DataFrame:
    """Per-read calls from files or folders (gzip too), with depths of the strands."""
    options = {"pathGlobFilter": f"*{name_contains}*"} if name_contains else {}
    df = _tsv(spark, paths, CALLS, recursiveFileLookup="true", **options)
    part = lambda i: F.get(F.split("depth", ","), F.lit(i)).try_cast("int")
    return df.withColumn("depth_f", part(0)).withColumn("depth_r", part(1))


def read_site_freq(spark: SparkSession, path: Paths, layout: str = "v11") -> DataFrame:
    """Site frequencies in a named layout: v11, v10 or offset11."""
    return _tsv(spark, path, SITE_FREQ[layout])


def read_bedmethyl(spark: SparkSession, path: Paths) -> DataFrame:
    """Coverage and freq = percent / 100."""
    return _tsv(spark, path, BEDMETHYL).withColumn("freq", F.col("pct") / 100.0)


def read_bs_report(spark: SparkSession, path: Paths) -> DataFrame:
    """Strand-resolved bisulfite report; freq is 0 without coverage."""
    df = _tsv(spark, path, BISULFITE).withColumn("coverage", F.col("met") + F.col("unmet"))
    return df.withColumn("freq", F.when(F.col("coverage") > 0, F.col("met") / F.col("coverage")).otherwise(0.0))


def read_fastq(spark: SparkSession, path: Paths) -> DataFrame:
    """(read_id, comment, seq, qual) of four-line records. A line's number in its file is its place in its
    block and, from a table of blocks, the lines before that; lines are then pivoted by record."""
    lines = _lines(spark, path)
    blocks = lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select(F.col("file").alias("_file"), F.col("block").alias("_block"), (before - F.col("first")).alias("shift"))
    numbered = lines.join(starts, (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block"))).withColumn("line", F.col("id") + F.col("shift"))
    pick = lambda k: F.max(F.when(F.col("line") % 4 == k, F.col("value")))
    records = numbered.groupBy("file", F.floor(F.col("line") / 4).alias("record"))
    got = records.agg(pick(0).alias("head"), pick(1).alias("seq"), pick(3).alias("qual")).where(F.col("head").startswith("@"))
    name = F.split_part(F.substr("head", F.lit(2)), F.lit(" "), F.lit(1))
    return got.select(name.alias("read_id"), F.substr("head", F.length(name) + 3).alias("comment"), "seq", "qual")


def read_keys(spark: SparkSession, source: str, columns: str = "read_id string", header: bool = False) -> DataFrame:
    """Distinct keys of a comma string (one column) or of a tab-separated file."""
    if "/" not in source and "," in source:
        return spark.createDataFrame([(x.strip(),) for x in source.split(",") if x.strip()], columns).distinct()
    return _tsv(spark, source, columns, header=str(header).lower(), enforceSchema="true").distinct()


def read_haplotypes(spark: SparkSession, path: str) -> DataFrame:
    """Read list with a header: read, haplotype (H1, H2, none), unused, contig."""
    df = read_keys(spark, path, "read_id string, haplotype string, phase_set string, contig string", header=True)
    return df.where(F.col("haplotype").isin("H1", "H2")).select("read_id", F.concat(F.lit("HP"), F.substr("haplotype", F.lit(2))).alias("hap")).distinct()


def read_window_features(spark: SparkSession, path: Paths) -> DataFrame:
    """Neighbour-window features: offsets, histograms (lists joined by semicolons), coverages."""
    df = _tsv(spark, path, "contig string, pos long, strand string, offsets string, hists string, coverages string, label double")
    ints = lambda c: F.transform(F.split(c, ","), lambda x: x.try_cast("int")).alias(c)
    hists = F.transform(F.split("hists", ";"), lambda h: F.transform(F.split(h, ","), lambda x: x.try_cast("double")))
    return df.select("contig", "pos", "strand", ints("offsets"), hists.alias("hists"), ints("coverages"), "label")
