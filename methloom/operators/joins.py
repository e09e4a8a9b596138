"""Joins (J1-J15)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import calls as X
from ..functions import cigar as C
from ..functions import modtags as M
from ..functions import walks as V
from ..functions.gather import placed_calls
from ..functions.sequence import motif_hits, reverse_complement
from ..sources.scratch import written
from .filters import REVERSE, with_cigar


def restrict_reads(df: DataFrame, include: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """Reads (read_id) of one list, and not of another. Spark broadcasts a list that is small."""
    if include is not None:
        df = df.join(include.select("read_id"), "read_id", "left_semi")
    return df.join(exclude.select("read_id"), "read_id", "left_anti") if exclude is not None else df


def restrict_positions(df: DataFrame, positions: DataFrame) -> DataFrame:
    """Rows at listed (contig, pos)."""
    return df.join(positions.select("contig", "pos"), ["contig", "pos"], "left_semi")


def relabel_at(df: DataFrame, positions: DataFrame, label: int) -> DataFrame:
    """Rows at listed places, with a new label."""
    return restrict_positions(df, positions).withColumn("label", F.lit(label))


def forward_sequence(df: DataFrame):
    """The read as it was sequenced: seq is in alignment order, as alignments have it."""
    return F.when(F.col("flag").bitwiseAND(REVERSE) != 0, reverse_complement("seq")).otherwise(F.col("seq"))


def attach_mod_tags(alignments: DataFrame, read_calls: DataFrame, drop_pulse: bool = True, suffix: str = "?") -> DataFrame:
    """Alignments (tags: map) with MM and ML of their read's calls (``collect_read_calls``); reads
    without calls keep their other tags, reads with a call that is not on a C are dropped."""
    joined = alignments.join(read_calls.select("read_id", "calls"), "read_id", "left")
    skips = M.encode_skips(F.transform("calls", lambda c: c["loc"]), F.col("_forward"))
    ml = F.transform("calls", lambda c: M.probability_byte(c["prob"]))
    out = joined.withColumn("_forward", forward_sequence(joined)).withColumn("_mm", M.mm_text(skips, suffix=suffix))
    out = out.where(F.col("calls").isNull() | F.col("_mm").isNotNull())
    return out.withColumn("tags", M.refill_tags(F.col("tags"), F.col("_mm"), ml, drop_pulse)).drop("calls", "_forward", "_mm")


def reference_sites(reference: DataFrame, motifs: list[str], mod_loc: int = 0, both: bool = True) -> DataFrame:
    """(contig, pos, strand) of motif sites; reference: overlapping chunks (contig, chunk_start, seq).
    Places on the reverse strand are given in forward coordinates."""
    n = F.length("seq")
    forward = reference.select("contig", F.lit("+").alias("strand"), F.explode(motif_hits("seq", motifs, mod_loc)).alias("loc"), "chunk_start")
    sites = forward.select("contig", (F.col("chunk_start") + F.col("loc")).alias("pos"), "strand")
    if both:
        back = reference.select("contig", F.lit("-").alias("strand"), (F.col("chunk_start") + n - 1).alias("last"),
                                F.explode(motif_hits(reverse_complement("seq"), motifs, mod_loc)).alias("loc"))
        sites = sites.union(back.select("contig", (F.col("last") - F.col("loc")).alias("pos"), "strand"))
    return sites.distinct()


def restrict_to_ref_motif(sites: DataFrame, reference: DataFrame, motifs: list[str], mod_loc: int = 0) -> DataFrame:
    """Sites under which the reference has a motif on their strand."""
    return sites.join(reference_sites(reference, motifs, mod_loc), ["contig", "pos", "strand"], "left_semi")


#: Heavy bins that are broadcast; a table of more is joined as Spark sees fit.
MOST_HEAVY = 50_000


def _heavy_bins(a: DataFrame, b: DataFrame, most: int) -> DataFrame | None:
    """(contig, _bin, _parts_a, _parts_b) of the bins in which a side has more than ``most`` rows (a row that has ``_n``
    stands for as many): into how many parts to cut each side. None if there are none."""
    n = lambda df: F.col("_n") if "_n" in df.columns else F.lit(1)
    one = lambda df, x, y: df.select("contig", "_bin", (x * n(df)).alias("x"), (y * n(df)).alias("y"))
    counts = one(a, 1, 0).unionByName(one(b, 0, 1)).groupBy("contig", "_bin").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    # A bin with rows of one side only has no pairs.
    heavy = counts.where((F.greatest("x", "y") > most) & (F.least("x", "y") > 0))
    heavy = heavy.select("contig", "_bin", *[F.greatest(F.ceil(F.col(c) / most), F.lit(1)).cast("int").alias(f"_parts_{s}") for c, s in (("x", "a"), ("y", "b"))])
    rows = heavy.limit(MOST_HEAVY + 1).collect()
    if not rows:
        return None
    return heavy if len(rows) > MOST_HEAVY else F.broadcast(a.sparkSession.createDataFrame(rows, heavy.schema))


def _shifted(places: Column, levels: Column) -> Column:
    """Bins by level: each is four of the level below."""
    return F.call_function("shiftright", places, 2 * levels)


def _dealt(df: DataFrame, own: Column, others: Column) -> DataFrame:
    """``df`` (_first, _last: bins of level _at) once for each bin that it touches at its own level and at those of
    ``others``, kinds of bins as 2 * level + 1 or 0; _bin names bin and kind."""
    df = df.withColumn("_kind", F.explode(F.concat(own, others)))
    up = F.shiftright("_kind", 1) - F.col("_at")
    df = df.withColumn("_bin", F.explode(F.sequence(*[_shifted(F.col(c), up) * 64 + F.col("_kind") for c in ("_first", "_last")], F.lit(64).cast("long"))))
    return df.drop("_first", "_last", "_at", "_level", "_kind")


def overlap_join(left: DataFrame, right: DataFrame, width: int = 10_000, most: int = 200_000) -> DataFrame:
    """Pairs of intervals (contig, start, end; half open) that overlap, right's as r_start and r_end.

    Intervals are dealt to bins of ``width``, long ones to bins of a level of four times, 16 times ... as much, so that
    each touches at most five of its level. A pair meets at the higher level of its two, to which the other one is dealt,
    too, and is given in the first bin that both touch, so no distinct is needed and no contig is one task. Counts by
    bin come first, a written table; they tell which levels there are and which bins are deep: one in which a side has more than ``most``
    rows is cut, each side into parts by a hash of its rows, and each part meets the other side's parts, of which
    it gets copies: a deep locus is many tasks. Rows that are equal in every column stay together."""
    base = lambda c: (c / width).cast("long")

    def placed(df: DataFrame) -> DataFrame:
        df = df.withColumns({"_first": base(F.col("start")), "_last": base(F.greatest(F.col("end") - 1, F.col("start")))})
        # Half of the bits of the distance, less one: 1 to 3 bins of the level between the ends.
        return df.withColumns({"_level": F.shiftright(F.length(F.bin(F.col("_last") - F.col("_first"))) - 1, 1), "_at": F.lit(0)})

    def counted(df: DataFrame, side: str) -> DataFrame:
        bins = F.explode(F.sequence(*[_shifted(F.col(c), F.col("_level")) for c in ("_first", "_last")]))
        return placed(df).select("contig", "_level", bins.alias("_first")).groupBy("contig", "_level", "_first").agg(F.count("*").alias("_n")).withColumn("_side", F.lit(side))

    counts = written(counted(left, "a").unionByName(counted(right, "b")))
    found = counts.select("_side", "_level").distinct().collect()  # a row a level
    levels = {s: sorted(r["_level"] for r in found if r["_side"] == s) for s in "ab"}
    kinds = lambda side, k: F.array(*[F.lit(2 * m + k) for m in levels[side]]).cast("array<int>")
    # Even kinds are those of pairs whose left interval has the higher level or the same, odd ones of the others.
    own = lambda k, least: F.filter(F.array(2 * F.col("_level") + k), lambda c: c >= 2 * least + k)
    deal_a = lambda df: _dealt(df, own(0, min(levels["b"], default=64)), F.filter(kinds("b", 1), lambda c: c > 2 * F.col("_level") + 1))
    deal_b = lambda df: _dealt(df, own(1, min(levels["a"], default=64) + 1), F.filter(kinds("a", 0), lambda c: c >= 2 * F.col("_level")))
    counts = counts.withColumns({"_last": F.col("_first"), "_at": F.col("_level")})
    a, b = deal_a(placed(left)), deal_b(placed(right)).withColumnsRenamed({"start": "r_start", "end": "r_end"})
    keys = ["contig", "_bin"]
    if (heavy := _heavy_bins(deal_a(counts.where("_side = 'a'")), deal_b(counts.where("_side = 'b'")), most)) is not None:
        def cut(df: DataFrame, own: str, other: str) -> DataFrame:
            hashed = [c for c, t in df.dtypes if "map<" not in t]  # Spark hashes no maps
            place = F.pmod(F.xxhash64(*hashed), F.coalesce(F.col(f"_parts_{own}"), F.lit(1))).cast("int")
            copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(f"_parts_{other}"), F.lit(1)) - 1))
            dealt = df.join(heavy, keys, "left").withColumn(f"_in_{own}", place).withColumn(f"_in_{other}", copies)
            return dealt.drop("_parts_a", "_parts_b")

        a, b, keys = cut(a, "a", "b"), cut(b, "b", "a"), [*keys, "_in_a", "_in_b"]
    pairs = a.join(b, keys).where((F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end")))
    level = F.shiftright(F.col("_bin").bitwiseAND(63), 1)
    return pairs.where(F.shiftright("_bin", 6) == _shifted(base(F.greatest("start", "r_start")), level)).drop("_bin", "_in_a", "_in_b")


def project_calls(alignments: DataFrame, base_clip: int = 0, matches_only: bool = True) -> DataFrame:
    """(read_id, contig, pos, strand, prob, hap) of every decoded call on a matched base: MM/ML
    through the CIGAR, in one pass over Arrow batches. No shuffle."""
    df = with_cigar(alignments)
    reverse = F.col("flag").bitwiseAND(REVERSE) != 0
    reads = df.select(
        "read_id", "contig", "start", F.when(reverse, "-").otherwise("+").alias("strand"), F.coalesce("hap", F.lit(0)).alias("hap"),
        placed_calls(F.col("cigar"), M.skips(F.col("mm")), F.col("ml"), F.col("seq"), reverse).alias("calls"), *([V.walk(F.col("cigar")).alias("blocks")] if base_clip else []),
    )
    kept, of_read = ["read_id", "contig", "start", "strand", "hap"], F.col("calls")
    if base_clip:
        inner = V.inner_places(F.col("blocks"), F.transform("calls", lambda c: c["loc"]), base_clip, matches_only)
        reads, of_read = reads.withColumn("inner", inner), F.transform("inner", lambda i: F.get("calls", i))
    # The filter keeps Spark from testing the array's size before the function that makes it has run.
    calls = reads.select(*kept, F.explode(F.filter(of_read, lambda c: c["offset"].isNotNull())).alias("call"))
    placed = calls.withColumn("offset", F.col("call.offset"))
    return placed.select("read_id", "contig", (F.col("start") + F.col("offset")).alias("pos"), "strand", F.col("call.prob").alias("prob"), "hap")


def fill_reference_sites(alignments: DataFrame, ref_sites: DataFrame, calls: DataFrame, width: int = 10_000) -> DataFrame:
    """``calls`` and, with probability 0, the motif sites of the read's strand that a read covers
    without a call (over deletions and skips, too)."""
    df = with_cigar(alignments)
    spans = df.select(
        "read_id", "contig", "start", (F.col("start") + C.reference_length(F.col("cigar"))).alias("end"),
        F.when(F.col("flag").bitwiseAND(REVERSE) != 0, "-").otherwise("+").alias("strand"), F.coalesce("hap", F.lit(0)).alias("hap"),
    )
    sites = ref_sites.select("contig", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), F.col("strand").alias("_strand"))
    covered = overlap_join(spans, sites, width).where("strand = _strand")
    covered = covered.select("read_id", "contig", F.col("r_start").alias("pos"), "strand", F.lit(0.0).alias("prob"), "hap")
    return calls.unionByName(covered.join(calls.select("read_id", "contig", "pos"), ["read_id", "contig", "pos"], "left_anti"))


def phase_calls(calls: DataFrame, read_haps: DataFrame) -> DataFrame:
    """Calls with their read's haplotype, ``unknown`` without one."""
    return calls.join(read_haps.select("read_id", F.col("hap").alias("haplotype")), "read_id", "left").withColumn("haplotype", F.coalesce("haplotype", F.lit("unknown")))


def haplotype_conflicts(read_haps: DataFrame) -> DataFrame:
    """Reads listed under more than one haplotype, with how many."""
    return read_haps.groupBy("read_id").agg(F.count_distinct("hap").alias("n_haps")).where("n_haps > 1")


def assert_unique_haplotype(read_haps: DataFrame) -> DataFrame:
    """``read_haps`` if no read is under two haplotypes."""
    if (bad := haplotype_conflicts(read_haps).head()) is not None:
        raise ValueError(f"read {bad['read_id']} is in more than one haplotype")
    return read_haps


def attach_span_calls(alignments: DataFrame, spans: DataFrame, match_strand: bool = True, suffix: str = "/ccs") -> DataFrame:
    """Span records (contig, start, end, strand, read_id, ...) with the alignments of their read
    that they overlap; read names count without the suffix."""
    key = lambda df: df.withColumn("_read", X.without_suffix(F.col("read_id"), suffix))
    a = key(alignments).withColumn("_strand", F.when(F.col("flag").bitwiseAND(REVERSE) != 0, "-").otherwise("+"))
    b = key(spans).drop("read_id").withColumnsRenamed({"start": "r_start", "end": "r_end", "strand": "r_strand"})
    out = a.join(b, ["_read", "contig"]).where((F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("ref_end")))
    return (out.where("_strand = r_strand") if match_strand else out).drop("_read", "_strand")


def pair_sites(a: DataFrame, b: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Sites of two tables, with a's values as they are and b's under ``_b``."""
    return a.select(*keys, *values).join(b.select(*keys, *[F.col(v).alias(f"{v}_b") for v in values]), keys)


def restrict_samples(df: DataFrame, samples: DataFrame, both_strands: bool = True) -> DataFrame:
    """Calls at sample sites (contig, pos, molecule); with both strands a call at the next place
    counts, too. One semi join on exploded keys, not an OR."""
    keys = samples.select("contig", "pos", "molecule")
    if both_strands:
        keys = keys.select("contig", F.explode(F.array(F.col("pos"), F.col("pos") + 1)).alias("pos"), "molecule").distinct()
    return df.join(keys, ["contig", "pos", "molecule"], "left_semi")


def attach_ref_slice(alignments: DataFrame, reference: DataFrame, chunk_len: int) -> DataFrame:
    """Alignments with ref_seq, the reference under them in read direction. reference: chunks of
    ``chunk_len`` (contig, chunk_start, seq, which may overlap); only those that a read spans move."""
    df = with_cigar(alignments)
    ends = df.withColumn("ref_end", F.col("start") + C.reference_length(F.col("cigar")))
    wanted = ends.select(
        "read_id", "contig", "start", "ref_end", "flag",
        F.explode(F.sequence((F.col("start") / chunk_len).cast("long"), (F.greatest(F.col("ref_end") - 1, F.col("start")) / chunk_len).cast("long"))).alias("_chunk"),
    )
    chunks = reference.select("contig", (F.col("chunk_start") / chunk_len).cast("long").alias("_chunk"), F.substring("seq", 1, chunk_len).alias("_seq"))
    got = wanted.join(chunks, ["contig", "_chunk"]).groupBy("read_id", "contig", "start", "ref_end", "flag").agg(
        F.array_sort(F.collect_list(F.struct("_chunk", "_seq"))).alias("_parts")
    )
    whole = F.array_join(F.transform("_parts", lambda p: p["_seq"]), "")
    first = F.col("_parts")[0]["_chunk"] * chunk_len
    cut = F.substr(whole, (F.col("start") - first + 1).cast("int"), (F.col("ref_end") - F.col("start")).cast("int"))
    cut = F.when(F.col("flag").bitwiseAND(REVERSE) != 0, reverse_complement(cut)).otherwise(cut)
    keys = ["read_id", "contig", "start", "ref_end", "flag"]
    return ends.join(got.select(*keys, cut.alias("ref_seq")), keys, "left")


def union_all(dfs: list[DataFrame]) -> DataFrame:
    """Inputs of one layout as one."""
    return reduce(DataFrame.unionByName, dfs)
