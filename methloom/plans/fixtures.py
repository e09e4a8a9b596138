"""Fixtures derived from the driver's tables, one SQL text where both engines read it alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch  # noqa: F401

CALLS = """
select 'chr' || cast(l_suppkey % 5 + 1 as string) as contig,
       l_partkey * 7 + (case when l_linestatus = 'O' then 0 else 1 end) as pos,
       case when l_linestatus = 'O' then '+' else '-' end as strand,
       'm1/' || cast(l_orderkey as string) || '/ccs' as read_id,
       l_linenumber * 30 as read_loc, cast(l_quantity as int) as depth,
       cast(round(l_extendedprice * 100) as bigint) % 256 as ml,
       1 - (cast(round(l_extendedprice * 100) as bigint) % 256) / 256e0 as prob_0,
       (cast(round(l_extendedprice * 100) as bigint) % 256) / 256e0 as prob_1,
       case when cast(round(l_extendedprice * 100) as bigint) % 256 > 128 then 1 else 0 end as label,
       case l_returnflag when 'A' then 1 when 'R' then 2 else 0 end as hap
from lineitem"""

TRUTH = """
select 'chr' || cast(r_regionkey + 1 as string) as contig, p_partkey * 7 as pos, '+' as strand,
       p_size as coverage, cast(round(p_retailprice * 100) as bigint) % 101 as pct
from part cross join region"""

LABELLED = """
select event_id, case when event_type in ('purchase', 'signup') then 1 else 0 end as is_true,
       (cast(round(value * 100) as bigint) % 256) / 256e0 as score,
       case when cast(round(value * 100) as bigint) % 256 > 128 then 1 else 0 end as predicted
from events"""

SITEFREQ = f"""
select contig, pos, strand, count(*) as coverage, cast(sum(label) as bigint) as n_mod,
       sum(prob_0) as p0_sum, sum(prob_1) as p1_sum from ({CALLS}) c group by contig, pos, strand"""

READS = """
select doc_id, 'm1/' || cast(doc_id as string) || '/ccs' as read_id,
       upper(regexp_replace(text, '[^acgtACGT]', ''{flag})) as seq
from documents"""

ALIGNMENTS = """
select read_id, seq, doc_id, 'chr' || cast(doc_id % 5 + 1 as string) as contig,
       (doc_id * 37) % 5000 as start,
       (case when doc_id % 2 = 0 then 16 else 0 end) + (case when doc_id % 11 = 0 then 2048 else 0 end)
     + (case when doc_id % 13 = 0 then 256 else 0 end) + (case when doc_id % 17 = 0 then 1024 else 0 end)
     + (case when doc_id % 19 = 0 then 4 else 0 end) as flag,
       doc_id % 61 as mapq, '5S10=2I8=3D' || cast(length(seq) - 25 as string) || '=' as cigar,
       (doc_id * 37) % 5000 + length(seq) - 4 as ref_end
from ({reads}) r where length(seq) > 60"""

#: The same for DuckDB.
D_READS = READS.format(flag=", 'g'")
D_ALIGNMENTS = ALIGNMENTS.format(reads=D_READS)


def _sql(spark: SparkSession, sf_dir: str, text: str, *tables: str) -> DataFrame:
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    for t in tables:
        text = text.replace(f" {t}", f" {{{t}}}")
    return spark.sql(text, **frames)


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, CALLS, "lineitem")


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, TRUTH, "part", "region")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, LABELLED, "events")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(
        "doc_id", F.expr("'m1/' || cast(doc_id as string) || '/ccs'").alias("read_id"),
        F.upper(F.regexp_replace("text", "[^acgtACGT]", "")).alias("seq"),
    )


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = ALIGNMENTS.replace("({reads}) r", "{reads}")
    return spark.sql(text, reads=reads(spark, sf_dir))


def sitefreq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls(spark, sf_dir).groupBy("contig", "pos", "strand").agg(
        F.count("*").alias("coverage"), F.sum("label").cast("long").alias("n_mod"),
        F.sum("prob_0").alias("p0_sum"), F.sum("prob_1").alias("p1_sum"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
