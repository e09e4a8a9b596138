"""Column expressions over base-modification tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let
from .walks import places_of, skips_of


#: Probability of a byte: byte / 256 with a millionth added, 6 decimals as Python rounds them; 0 is 0.
PROBABILITIES = [round(b / 256 + 1e-6, 6) if b else 0.0 for b in range(256)]


def byte_probability(ml: Column) -> Column:
    """Probability of a byte, null beyond 255."""
    return F.get(F.array(*map(F.lit, PROBABILITIES)), ml.cast("int"))


def probability_byte(p: Column) -> Column:
    """floor(256 p), at most 255."""
    return F.least(F.floor(p * 256), F.lit(255)).cast("int")


def skips(mm: Column, base: str = "C", code: str = "m") -> Column:
    """Skips of the modified bases by an MM tag; null if the tag has no such part."""
    part = F.nullif(F.regexp_extract(mm, rf"(?:^|;){base}\+{code}[?.]?,([0-9,]+)", 1), F.lit(""))
    return F.split(part, ",").cast("array<int>")


def decode(mm: Column, ml: Column, forward_seq: Column, reverse: Column, base: str = "C", code: str = "m") -> Column:
    """(loc, prob) of each call, loc in alignment order. No calls if the tags differ in length or an
    ordinal is beyond the read's bases. Not within a lambda."""
    length = F.length(forward_seq)
    call = lambda i, b: F.struct(F.when(reverse, length - 1 - i).otherwise(i).alias("loc"), byte_probability(b).alias("prob"))
    none = F.array().cast("array<struct<loc:int,prob:double>>")
    calls = lambda places: F.when(F.size(places) == F.size(ml), F.zip_with(places, ml, call)).otherwise(none)
    return let(places_of(skips(mm, base, code), forward_seq, base), calls)


def encode_skips(locs: Column, forward_seq: Column, base: str = "C") -> Column:
    """Skips of an MM tag for ascending places in sequenced orientation; null if one is not that base.
    Not within a lambda."""
    return skips_of(locs, forward_seq, base)


def mm_text(skips: Column, base: str = "C", code: str = "m", suffix: str = "?") -> Column:
    text = F.array_join(F.transform(skips, lambda x: x.cast("string")), ",")
    return F.when(skips.isNotNull(), F.concat(F.lit(f"{base}+{code}{suffix},"), text, F.lit(";")))


def refill_tags(tags: Column, mm: Column, ml: Column, drop_pulse: bool = True) -> Column:
    """A tag map without MM and ML (and pulse arrays), with the new ones where there are any."""
    old = ["MM", "ML", *(["fi", "fp", "ri", "rp"] if drop_pulse else [])]
    kept = F.map_filter(tags, lambda k, v: ~k.isin(old))
    new = F.create_map(F.lit("MM"), F.concat(F.lit("Z:"), mm), F.lit("ML"), F.concat(F.lit("B:C,"), F.array_join(F.transform(ml, lambda x: x.cast("string")), ",")))
    return F.when(mm.isNull(), kept).otherwise(F.map_concat(kept, new))
