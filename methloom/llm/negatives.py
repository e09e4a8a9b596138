"""Hard-negative mining by products of residues.

Scores are inner products of whole numbers, exact. Components are taken modulo a few primes below 1,024,
as residues around zero, whose products over 64 components stay below 2**24, so that a float32 matrix
product of residues is exact. The score modulo the product of the primes, and with its sign, comes back
from its residues by mixed-radix digits (Chinese remaindering).

Anchors meet all rows in units of some anchors and some rows, which Spark deals by hash; a unit holds no
more than its tile. A first pass keeps each anchor's best rows of its own label, a second one the best
rows of other labels within the window of scores that each of those positives sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, written

#: Components multiplied before residues are reduced, and anchors and rows multiplied at a time.
DEPTH, ANCHORS, ROWS = 64, 256, 4096
LOWEST = np.iinfo(np.int64).min


def _primes() -> list[int]:
    """The largest primes whose residues around zero have exact float32 sums of DEPTH products, downwards,
    until their product exceeds 2**64."""
    out: list[int] = []
    p = 2 * int(((1 << 24) / DEPTH) ** 0.5) - 1
    while prod(out) <= 1 << 64:
        if all(p % q for q in range(3, int(p**0.5) + 1, 2)):
            out.append(p)
        p -= 2
    return out


PRIMES = _primes()


def _around(x: np.ndarray, p: int) -> np.ndarray:
    """Residues from -(p-1)/2 to (p-1)/2."""
    return (x + p // 2) % p - p // 2


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products [n, m] of whole numbers [n, k] and [m, k] (int64), each below 2**63."""
    n, k = a.shape
    if not (n and len(b) and k):
        return np.zeros((n, len(b)), dtype=np.int64)
    bound = k * int(np.abs(a).max()) * int(np.abs(b).max())
    digits: list[np.ndarray] = []
    out, weight = np.zeros((n, len(b)), dtype=np.int64), 1
    for i, p in enumerate(PRIMES):
        u, v = _around(a, p).astype(np.float32), _around(b, p).astype(np.float32).T
        digit = np.zeros((n, len(b)), dtype=np.int32)
        for d in range(0, k, DEPTH):
            digit = _around(digit + (u[:, d : d + DEPTH] @ v[d : d + DEPTH]).astype(np.int32), p)
        for j in range(i):
            digit = _around((digit - digits[j]) * np.int32(pow(PRIMES[j], -1, p)), p)
        digits.append(digit)
        # The last places may pass 2**64 and wrap; the score itself does not.
        out += digit.astype(np.int64) * np.array([weight & ((1 << 64) - 1)], dtype=np.uint64).astype(np.int64)
        weight *= p
        if weight > 2 * bound:
            break
    return out


def _share(score: Column, percent: int, up: bool) -> Column:
    """``percent`` of a whole number, rounded up or down, without leaving 64 bits."""
    rest = F.pmod(score, F.lit(100))
    whole = F.call_function("div", score - rest, F.lit(100))
    return whole * percent + F.call_function("div", rest * percent + (99 if up else 0), F.lit(100))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Scaled components as whole numbers; all lists have one length."""
    flat = np.concatenate([np.asarray(c.flatten(), dtype=np.float64) for c in column.chunks]) if column.num_chunks else np.empty(0)
    return np.floor(flat * 256.0).astype(np.int64).reshape(len(column), len(flat) // max(len(column), 1))


def _tile(table: pa.Table):
    """A unit's rows in the order of their id, and its anchors, both in slices."""
    row = np.asarray(table["is_anchor"]) == 0
    rows, anchors = table.filter(pa.array(row)), table.filter(pa.array(~row))
    rows = rows.take(pa.array(np.lexsort((np.asarray(rows["akey"]), np.asarray(rows["vec_id"])))))
    for i in range(0, len(anchors), ANCHORS):
        some = anchors.slice(i, ANCHORS)
        a = _matrix(some["embedding"])
        for j in range(0, len(rows), ROWS):
            near = rows.slice(j, ROWS)
            ids = [np.asarray(t[c]) for t in (some, near) for c in ("vec_id", "label")]
            yield some, *ids, exact_scores(a, _matrix(near["embedding"]))


def _best(most: int):
    """Of each anchor of a unit the first rows of its label."""

    def run(table: pa.Table) -> pa.Table:
        out = [[], [], [], []]
        for some, a_id, a_label, b_id, b_label, scores in _tile(table):
            key = np.where((a_label[:, None] == b_label) & (a_id[:, None] != b_id), scores, LOWEST)
            line = np.arange(len(a_id))
            for _ in range(min(most, len(b_id))):
                at = key.argmax(axis=1)  # of equal scores the first, that is the smallest id
                got = key[line, at]
                ok = got != LOWEST
                for o, x in zip(out, (a_id[ok], np.asarray(some["akey"])[ok], b_id[at][ok], got[ok]), strict=True):
                    o.append(x)
                key[line, at] = LOWEST
        return pa.table([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in out], names=["vec_id", "akey", "positive_id", "positive_score"])

    return run


def _within(most: int):
    """Of each anchor and positive of a unit the first rows of other labels in the window of scores."""

    def run(table: pa.Table) -> pa.Table:
        out = [[], [], [], [], []]
        for some, a_id, a_label, b_id, b_label, scores in _tile(table):
            lists = some["window"].combine_chunks()
            first, flat = np.asarray(lists.offsets), lists.values
            low, high, place = (np.asarray(flat.field(c)) for c in ("low", "high", "place"))
            of = np.repeat(np.arange(len(a_id)), np.diff(first))
            low, high, place = low[first[0] : first[-1]], high[first[0] : first[-1]], place[first[0] : first[-1]]
            least, greatest = np.full(len(a_id), np.iinfo(np.int64).max), np.full(len(a_id), LOWEST)
            np.minimum.at(least, of, low)
            np.maximum.at(greatest, of, high)
            x, y = np.nonzero((a_label[:, None] != b_label) & (a_id[:, None] != b_id) & (scores >= least[:, None]) & (scores <= greatest[:, None]))
            s = scores[x, y]
            order = np.lexsort((y, -s, x))
            x, y, s = x[order], y[order], s[order]
            ends, falling, keys = np.searchsorted(x, np.arange(len(a_id) + 1)), -s, np.asarray(some["akey"])
            for i, lo, hi, p in zip(of, low, high, place, strict=True):
                # Scores descend: those in the window are one stretch.
                near = falling[ends[i] : ends[i + 1]]
                begin, stop = np.searchsorted(near, -hi, "left"), np.searchsorted(near, -lo, "right")
                got = np.arange(ends[i] + begin, ends[i] + min(max(begin, stop), begin + most))
                for o, v in zip(out, (np.full(len(got), a_id[i]), np.full(len(got), keys[i]), np.full(len(got), p), b_id[y[got]], s[got]), strict=True):
                    o.append(v)
        return pa.table([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in out], names=["vec_id", "akey", "place", "negative_id", "negative_score"])

    return run


def mine(vectors: DataFrame, anchors: str = "vec_id % 50 = 0", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
         unit: tuple[int, int] = (2048, 8192)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for the anchors among
    ``vectors`` (vec_id long, label, embedding) and each of their ``positives`` best rows of the same label the
    ``negatives`` best rows of other labels whose score is from ``low`` to ``high`` percent of the positive's.

    A score is the inner product of floor(256 x) of the components, exact; higher ones come first, then smaller
    vec_id. Rows meet rows of their own length. Rows with a null id, label, vector or component, or with one that is not
    finite, take no part, nor do those whose scores might pass 2**62 (components above some 2**20 at 64
    components). Equal rows count once; rows of one vec_id that differ are rows of their own, but none is
    an anchor's other row. Other columns are not read. Every anchor meets every row: units have at most about
    ``unit`` anchors and rows, each of which is sent once to every unit of the other side."""
    number = F.col("embedding").cast("array<double>")
    most = F.sqrt(F.lit(2.0**62) / F.greatest(F.size("embedding"), F.lit(1))) / 256
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < most))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), number.alias("embedding"))
    rows = rows.where("vec_id is not null and label is not null and embedding is not null").where(sound).distinct()
    rows = written(rows.withColumn("akey", F.xxhash64("vec_id", "label", "embedding")))
    chosen = rows.where(anchors)
    n_a, n_r = max(1, -(-chosen.count() // unit[0])), max(1, -(-rows.count() // unit[1]))
    own, columns = lambda n: F.pmod("akey", F.lit(n)).cast("int"), ["is_anchor", "vec_id", "akey", "label", "embedding", "window"]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    window = "array<struct<low:bigint,high:bigint,place:bigint>>"

    def units(some: DataFrame) -> DataFrame:
        a = some.withColumn("is_anchor", F.lit(1)).withColumn("_a", own(n_a)).withColumn("_r", every(n_r))
        r = rows.withColumns({"is_anchor": F.lit(0), "window": F.lit(None).cast(window), "_r": own(n_r)}).withColumn("_a", every(n_a))
        both = a.select("_a", "_r", *columns).unionByName(r.select("_a", "_r", *columns)).withColumn("_k", F.size("embedding"))
        return both.repartition(min(n_a * n_r, 20_000), "_a", "_r", "_k").groupBy("_a", "_r", "_k")

    best = units(chosen.withColumn("window", F.lit(None).cast(window))).applyInArrow(_best(positives), "vec_id bigint, akey bigint, positive_id bigint, positive_score bigint")
    line = W.partitionBy("vec_id", "akey").orderBy(F.desc("positive_score"), "positive_id")
    best = written(best.withColumn("place", F.row_number().over(line).cast("long")).where(F.col("place") <= positives))
    bounds = F.struct(_share(F.col("positive_score"), low, True).alias("low"), _share(F.col("positive_score"), high, False).alias("high"), "place")
    windows = best.groupBy("vec_id", "akey").agg(F.collect_list(bounds).cast(window).alias("window"))
    found = units(chosen.join(windows, ["vec_id", "akey"])).applyInArrow(_within(negatives), "vec_id bigint, akey bigint, place bigint, negative_id bigint, negative_score bigint")
    line = W.partitionBy("vec_id", "akey", "place").orderBy(F.desc("negative_score"), "negative_id")
    found = found.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= negatives)
    out = written(found.join(best, ["vec_id", "akey", "place"]).select(F.col("vec_id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    discard(best)
    discard(rows)
    return out
