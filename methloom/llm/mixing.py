"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Every source's documents are dealt to shards by a hash of doc_id and stand there in a seeded
order, end to end, as one line of tokens cut into blocks of equal size. Blocks are apportioned to
sources by the highest quotients target / (2 s + 1), each source's blocks to its shards likewise
by shard size; a shard then takes its quota of blocks, whole rounds first and the rest spread
evenly over its line from a seeded place. A document takes as many tokens as it has in the chosen blocks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)


def targets(sizes: list[float], weights: list[float], share: float = 1.5, most: float = 2.0) -> np.ndarray:
    """``share`` of all sizes by weight; a target stops at ``most`` times its size, the excess goes to
    the others by weight, again until none is above."""
    size, weight = np.array(sizes, dtype=float), np.array(weights, dtype=float)
    out, free = np.zeros(len(size)), size > 0
    left = share * size.sum()
    while free.any():
        want = np.where(free, left * weight / weight[free].sum(), 0)
        full = free & (want > most * size)
        if not full.any():
            out[free] = want[free]
            break
        out[full] = most * size[full]
        left -= out[full].sum()
        free &= ~full
    return out


def sainte_lague(votes: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Seats by the highest quotients votes / (2 s + 1), none above ``most``; equal quotients go by
    position. The divisor is found by bisection, the last few seats one by one, so the time does
    not depend on the number of seats."""
    votes, most = np.asarray(votes, dtype=float), np.asarray(most, dtype=np.int64)
    seats = min(int(seats), int(most[votes > 0].sum()))
    got = np.zeros(len(votes), dtype=np.int64)
    if seats <= 0:
        return got
    at = lambda d: np.minimum(np.floor(votes / d + 0.5).astype(np.int64), most)
    low, high = votes[votes > 0].min() / (2 * seats + 2), votes.max() * 4
    for _ in range(200):
        mid = (low * high) ** 0.5
        if at(mid).sum() > seats:
            low = mid
        else:
            high = mid
    got = at(high)
    while got.sum() < seats:
        quotient = np.where(got < most, votes / (2 * got + 1), -1)
        got[int(quotient.argmax())] += 1
    return got


def least_points(rows: DataFrame, measure: Callable[[Column], Column], spans: dict[int, tuple[float, float, int]], ways: int = 64) -> dict[int, tuple[float, float, int]]:
    """For each k of ``spans`` (k: low, high, goal) the ends (low, high) of the search and what is left of goal at high.

    The sum of ``measure`` over the rows of k falls as its point grows, is goal or more at low and at most goal at high.
    A search ends where the sum at high is goal (low is high then), or where no double lies between. A round is one
    aggregate with at most ``ways`` sums a k; the driver sees these alone."""
    ends, left = {k: span[:2] for k, span in spans.items()}, {k: span[2] for k, span in spans.items()}
    while True:
        points = {}
        for k, (low, high) in ends.items():
            spread = np.geomspace if low > 0 and high > 2 * low else np.linspace
            inside = np.unique(spread(low, high, ways + 2))
            points[k] = inside[(inside > low) & (inside < high)].tolist() if left[k] else []
        asked = [(k, p) for k, p in points.items() if p]
        if not asked:
            return {k: (high if not left[k] else low, high, left[k]) for k, (low, high) in ends.items()}
        asked = rows.sparkSession.createDataFrame(asked, "k int, points array<double>")
        each = rows.join(asked, "k").select("*", F.posexplode("points").alias("i", "point"))
        sums = each.groupBy("k", "i").agg(F.sum(measure(F.col("point"))).alias("n")).collect()
        for k, i, n in sorted(sums, key=lambda r: (r["k"], r["i"])):
            low, high = ends[k]
            point, goal = points[k][i], spans[k][2]
            if n > goal:
                ends[k] = (point, high)
            elif point < high:
                ends[k], left[k] = (low, point), goal - n


def quotas(shards: DataFrame, seats: dict[int, int], most: int) -> DataFrame:
    """``shards`` (k, shard, tokens, blocks) with their quota of the ``seats`` of k, by the highest quotients
    tokens / (2 s + 1), none above ``most`` times its blocks; equal quotients go by shard number.

    The divisor of each k is searched by aggregates over its shards, and so is the last shard that gets one of the seats
    left between equal quotients. The driver holds a row a source."""
    at = lambda d: F.least(F.floor(F.col("tokens") / d + 0.5), F.col("blocks") * most)
    tops = {r["k"]: r for r in shards.groupBy("k").agg(F.max("tokens").alias("tokens"), F.max("shard").alias("shard")).collect()}
    found = least_points(shards, at, {k: (1 / (2 * n + 2), max(4.0 * tops[k]["tokens"], 1.0), n) for k, n in seats.items()})
    local = lambda rows, schema: shards.sparkSession.createDataFrame(rows, schema)
    ends = local([(k, low, high) for k, (low, high, _) in found.items()], "k int, low double, high double")
    marked = shards.join(ends, "k").withColumn("tie", at(F.col("low")) > at(F.col("high")))
    # A tie's shard gets a seat if its number is below the source's mark.
    below = lambda p: (F.col("shard") + p < F.col("n")).cast("int")
    n = {k: tops[k]["shard"] + 1 for k in found}
    counted = local(list(n.items()), "k int, n int")
    ties = least_points(marked.where("tie").join(counted, "k"), below, {k: (-1.0, float(n[k]), left) for k, (_, _, left) in found.items() if left})
    marks = local([(k, float(n[k] - ties[k][1]) if k in ties else 0.0) for k in found], "k int, mark double")
    extra = (F.col("tie") & (F.col("shard") < F.col("mark"))).cast("int")
    return marked.join(marks, "k").select(*shards.columns, (at(F.col("high")) + extra).alias("quota"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0,
        block: int = 32, shard_docs: int = 20_000, seed: int = 1, whole: bool = False) -> DataFrame:
    """One row a document: doc_id, size, source, source_size, target, taken; with ``whole`` all its columns,
    too (of equal names the mixture's count).

    Sources go by code point, null last (a source of its own), and take ``weights`` in turn. A null
    or empty text has size 0 and takes 0. Equal doc_ids are ordered by a hash of their text; fully
    equal rows share one place and are interchangeable; texts of any length are counted whole. The driver's table
    holds a row a source, the mixture's own table; the table of shards (``shard_docs`` documents each) stays distributed.
    Other columns are ignored."""
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if whole else []
    base = docs.select(
        "doc_id", "source", F.xxhash64("text").alias("_t"), *row,
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    spark = docs.sparkSession
    n_shards = max(8, -(-base.count() // shard_docs))
    base = base.withColumn("shard", F.pmod(F.xxhash64("doc_id", "_t", F.lit(seed)), F.lit(n_shards)).cast("int"))
    # One key without nulls, so that places and quotas meet in one shuffle.
    base = base.withColumn("line", F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"), "shard"))
    shards = written(base.groupBy("line").agg(F.sum("size").alias("tokens")).withColumn("blocks", F.ceil(F.col("tokens") / block)))
    mixed = ("doc_id", "size", "source", "source_size", "target", "taken")
    kept = [F.col("_row")[c].alias(c) for c in docs.columns if c not in mixed] if whole else []
    sums = shards.groupBy("line.none", "line.name").agg(F.sum("tokens").alias("tokens"), F.sum("blocks").alias("blocks")).collect()
    if not sums:
        return base.select("doc_id", "size", "source", F.lit(0).cast("long").alias("source_size"),
                           F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("taken"), *kept)
    # Strings compare by code point; weights count the sources from the first.
    sums.sort(key=lambda r: (r["none"], r["name"]))
    sizes, blocks = (np.array([r[c] for r in sums], dtype=np.int64) for c in ("tokens", "blocks"))
    goal = targets(sizes.tolist(), [weights[k % len(weights)] for k in range(len(sums))], share, most)
    caps = blocks * int(most)
    # Targets in blocks as full as the source's own are on average (the last of a shard is cut short).
    votes = goal * blocks / np.maximum(sizes, 1)
    seats = sainte_lague(votes, round(votes.sum()), caps)
    table = spark.createDataFrame(
        [(k, r["none"], r["name"], int(sizes[k]), float(goal[k])) for k, r in enumerate(sums)],
        "k int, none boolean, name string, source_size long, target double",
    )
    numbered = shards.select("line", "line.*", "tokens", "blocks").join(table, ["none", "name"]).drop("none", "name")
    plan = quotas(numbered, {k: int(n) for k, n in enumerate(seats)}, int(most)).drop("k", "shard", "tokens")
    # Place of each document on its shard's line; a shard holds about shard_docs documents of all sources.
    line = W.partitionBy("line").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id", "_t", "size")
    placed = base.withColumn("stop", F.sum("size").over(line.rowsBetween(W.unboundedPreceding, 0)))
    placed = placed.withColumn("start", F.col("stop") - F.col("size"))
    joined = placed.join(plan, "line")
    chosen = _chosen_tokens(F.col("start"), F.col("stop"), block, seed)
    rounds = F.floor(F.col("quota") / F.greatest("blocks", F.lit(1)))
    return joined.select(
        "doc_id", "size", "source", "source_size", "target",
        F.when(F.col("size") == 0, F.lit(0)).otherwise(rounds * F.col("size") + chosen).cast("long").alias("taken"), *kept,
    )


def _chosen_tokens(start, stop, block: int, seed: int):
    """Tokens of [start, stop) that lie in the blocks which the shard's rest (quota mod blocks) chooses.

    Block i is chosen where the walk of a seeded offset spreads the rest evenly over the shard:
    floor((i + c + 1) r / n) > floor((i + c) r / n), which holds for exactly r of any n blocks in a
    row. Summed in closed form, so a long document costs no more than a short one."""
    n, r = F.greatest(F.col("blocks"), F.lit(1)), F.pmod(F.col("quota"), F.greatest(F.col("blocks"), F.lit(1)))
    c = F.pmod(F.xxhash64("source", "shard", F.lit(seed)), n)
    upto = lambda i: F.expr("0L") + F.floor((i + c) * r / n)  # noqa: E731  chosen among blocks below i, plus a constant
    before = lambda x: (  # noqa: E731  chosen tokens below place x
        upto(F.floor(x / block)) * block
        + (upto(F.floor(x / block) + 1) - upto(F.floor(x / block))) * (x - F.floor(x / block) * block)
    )
    return before(stop) - before(start)
