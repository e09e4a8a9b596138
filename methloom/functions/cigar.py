"""Column expressions over CIGAR arrays: parsing, identity, coordinates, map codes.

A CIGAR is ``ARRAY<STRUCT<op:STRING,len:INT>>``. Lookups walk the operations, never the bases.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let, let_all

MATCHES = ("M", "=", "X")


def parse(text: Column) -> Column:
    """Text such as 5S10=2I to an array of operations; ``*`` and null are empty."""
    ops = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\d+)([MIDNSHP=XB])"), F.lit(0))
    return F.transform(ops, lambda x: F.struct(F.substr(x, F.length(x), F.lit(1)).alias("op"), F.substr(x, F.lit(1), F.length(x) - 1).cast("int").alias("len")))


def _sum(ops: Column, keep) -> Column:
    return F.aggregate(ops, F.lit(0), lambda s, o: s + F.when(keep(o["op"]), o["len"]).otherwise(0))


def identity(ops: Column) -> Column:
    """Share of M and = among all operations but clips; 0 if there are none."""
    whole = _sum(ops, lambda op: ~op.isin("S", "H"))
    return F.when(whole > 0, _sum(ops, lambda op: op.isin("M", "=")) / whole).otherwise(0.0)


def reference_length(ops: Column) -> Column:
    return _sum(ops, lambda op: op.isin("M", "=", "X", "D", "N"))


def clip(ops: Column, end: bool = False) -> Column:
    """Soft-clipped bases at the start (or end) of the alignment."""
    solid = F.filter(ops, lambda o: o["op"] != "H")
    edge = F.try_element_at(solid, F.lit(-1 if end else 1))
    return F.coalesce(F.when(edge["op"] == "S", edge["len"]), F.lit(0))


def blocks(ops: Column) -> Column:
    """Each operation with the query and reference places where it begins, in alignment order; clips
    and insertions advance the query, deletions and skips the reference."""
    start = F.struct(F.lit(0).alias("q"), F.lit(0).alias("r"), F.array().cast("array<struct<op:string,len:int,q:int,r:int>>").alias("out"))

    def step(s, o):
        q = F.when(o["op"].isin("M", "=", "X", "I", "S"), o["len"]).otherwise(0)
        r = F.when(o["op"].isin("M", "=", "X", "D", "N"), o["len"]).otherwise(0)
        here = F.struct(o["op"].alias("op"), o["len"].alias("len"), s["q"].alias("q"), s["r"].alias("r"))
        return F.struct((s["q"] + q).alias("q"), (s["r"] + r).alias("r"), F.array_append(s["out"], here).alias("out"))

    return F.aggregate(ops, start, step, lambda s: s["out"])


def to_reference(blocks_: Column, query: Column) -> Column:
    """Offset on the reference of a query place (alignment order), null where it is not aligned."""
    hit = F.filter(blocks_, lambda b: b["op"].isin(*MATCHES) & (query >= b["q"]) & (query < b["q"] + b["len"]))
    return let(F.try_element_at(hit, F.lit(1)), lambda b: b["r"] + query - b["q"])


def alignment_place(read_loc: Column, length: Column, reverse: Column) -> Column:
    """Place in alignment order of a place in the sequenced (forward) orientation."""
    return F.when(reverse, length - 1 - read_loc).otherwise(read_loc)


def pair_rank(blocks_: Column, query: Column, matches_only: bool = True) -> Column:
    """How many aligned pairs come before a query place: of matched bases only, or of all pairs
    (inserted, clipped, deleted and skipped bases too)."""
    pairs = lambda b: (F.lit(1) if not matches_only else F.when(b["op"].isin(*MATCHES), 1).otherwise(0))
    of = lambda b: F.when(b["op"].isin("H", "P"), 0).otherwise(b["len"]) * pairs(b)

    def before(b):
        moves = b["op"].isin("M", "=", "X", "I", "S")
        inside = F.when(moves & (query < b["q"] + b["len"]), query - b["q"]).otherwise(b["len"])
        return F.when(b["q"] > query, 0).when(moves, F.least(inside, b["len"]) * pairs(b)).when(b["q"] <= query, of(b)).otherwise(0)

    return F.aggregate(blocks_, F.lit(0), lambda s, b: s + F.greatest(before(b), F.lit(0)))


def pair_count(blocks_: Column, matches_only: bool = True) -> Column:
    return F.aggregate(blocks_, F.lit(0), lambda s, b: s + F.when(b["op"].isin(*MATCHES) if matches_only else ~b["op"].isin("H", "P"), b["len"]).otherwise(0))


def map_code(at: Callable[[Column], Column], q: Column, seq: Column, ref: Column) -> Column:
    """Code of one query place: 1 inserted, 4 mismatch, and 2 more (or alone) after a deletion.

    ``at`` gives a query place's reference offset in read direction, q counts from the first unclipped
    base, seq and ref are the unclipped read and the reference slice in read direction."""
    def code(v: Column) -> Column:
        r, prior = v["r"], v["prior"]
        differs = F.upper(F.substr(seq, q + 1, F.lit(1))) != F.upper(F.substr(ref, r + 1, F.lit(1)))
        jump = (q > 0) & prior.isNotNull() & (r != prior + 1)
        return F.when(r.isNull(), 1).otherwise(F.when(differs, 4).otherwise(0) + F.when(jump, 2).otherwise(0))

    return let_all(code, r=at(q), prior=at(q - 1))


def map_codes(read_blocks: Column, centre: Column, flank: int, length: Column, seq: Column, ref: Column, flip: bool = False, offsets: bool = False) -> Column:
    """Codes of the places within ``flank`` of ``centre``; 1 beyond the read's aligned part. ``read_blocks``
    are in read direction without clips, or with ``offsets`` the reference offsets of all places."""
    places = F.sequence(centre - flank, centre + flank)
    at = lambda b: lambda q: F.when(q >= 0, F.get(b, F.greatest(q, F.lit(0)))) if offsets else to_reference(b, q)
    code = lambda q, b, s, r: F.when((q < 0) | (q >= length), 1).otherwise(map_code(at(b), q, s, r))
    codes = let_all(lambda v: F.transform(places, lambda q: code(q, v["b"], v["s"], v["r"])), b=read_blocks, s=seq, r=ref)
    return F.reverse(codes) if flip else codes
