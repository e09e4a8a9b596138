"""Fuzzy line dedup by MinHash, in DataFrame operations alone.

A line is the set of its runs of ``SHINGLE`` characters (UTF-16 units, so that a run is cut out in
constant time). Each band has a permutation of the runs' hashes of its own; a band's values are the
hashes nearest, in it, to random points. All runs of a line take part, so a run's repeats change
nothing and lines of equal sets have equal values, whatever their lengths. Lines that agree in a
band, and in enough of a sketch of their values, are candidates; the exact Jaccard similarity decides.

A bucket is not compared pair by pair. Its members first meet a representative, whose row then leaves
the bucket, so small buckets are done. Where several components are left, the lines outside of a
bucket's largest component are compared with that by a semi-join on the exact similarity (one row a
line, however many partners it has there), and the few that find none with the others outside of it by a
join on the exact similarity, which gives links between different components only. Maps of the sets' parities, which
refuse no similar pair, tell first which lines need their sets there. What can be lost:
pairs that share no band, pairs whose sketches agree in fewer than ALIKE places (below 0.003 of those wanted).
Sets are 32-bit hashes, so a false match of two runs is possible, too.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, discard, written

SHINGLE = 6
BANDS, ROWS = 6, 4
SIMILARITY = 0.8
#: Of the 16 values in a line's sketch so many agree before two lines are compared.
ALIKE = 9
#: Lines of more runs than this are compared by rows of runs, others by arrays of runs.
LONG = 20_000
#: Words of 64 bits in the map of a set's parities.
WORDS = 16
#: Texts of so few pairs are picked out by a broadcast of the pairs, before they are dealt.
FEW = 10_000


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, tid, line_no, line, lid) of every line that isn't blank. tid tells texts of one doc_id apart."""
    split = docs.select("doc_id", F.xxhash64("text").alias("tid"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return split.where(F.trim("line") != "").withColumn("lid", F.xxhash64("line"))


def _count(u: Column) -> Column:
    """Number of runs of a line in UTF-16, 1 for short lines."""
    return F.greatest(F.floor(F.octet_length(u) / 2).cast("int") - (SHINGLE - 1), F.lit(1))


def _run(u: Column, i: Column) -> Column:
    return F.substring(u, 2 * i + 1, F.lit(2 * SHINGLE))


def _exploded(lines: DataFrame, *columns: str) -> DataFrame:
    """(columns, u, i): a row for each run of ``line``."""
    u = lines.withColumn("u", F.encode("line", "UTF-16BE"))
    return u.select(*columns, "u", F.explode(F.sequence(F.lit(0), _count(F.col("u")) - 1)).alias("i"))


def run_set(line: Column) -> Column:
    """The distinct hashes of a line's runs. The outer lambda binds the encoded line, which would else be made for each run.
    Lambdas are not compiled: positions come as they are used, and what can be done outside of them is."""
    one = lambda u: F.transform(F.sequence(F.lit(1), 2 * _count(u) - 1, F.lit(2)), lambda at: F.hash(F.substring(u, at, F.lit(2 * SHINGLE))))
    return F.array_distinct(F.get(F.transform(F.array(F.encode(line, "UTF-16BE")), one), F.lit(0)))


def alike(a: Column, b: Column, similarity: float) -> Column:
    """Have two sets (arrays) a Jaccard similarity of ``similarity`` or more? In whole numbers, sizes first."""
    p, q = round(similarity * 10**6), 10**6
    x, y = F.size(a).cast("long"), F.size(b).cast("long")
    return (F.least(x, y) * q >= F.greatest(x, y) * p) & (F.size(F.array_intersect(a, b)) * F.lit(p + q).cast("long") >= (x + y) * p)


def band_keys(lines: DataFrame) -> DataFrame:
    """(lid, sketch, keys) of every distinct line: a key for each band. Equal lines meet in the partial aggregate. A row
    holds four runs, so the aggregate looks a line up once for them (a line's last run may come again)."""
    rng = random.Random(6)
    low, places = (1 << 31) - 1, range(4)
    u = lines.withColumn("u", F.encode("line", "UTF-16BE")).withColumn("m", _count(F.col("u")))
    rows = u.select("lid", "u", "m", F.explode(F.sequence(F.lit(0), F.col("m") - 1, F.lit(len(places)))).alias("i"))
    hashed = lambda j: F.hash(_run(F.col("u"), F.least(F.col("i") + j, F.col("m") - 1))).bitwiseAND(low).cast("long")
    runs = rows.select("lid", *[hashed(j).alias(f"h{j}") for j in places])
    # A product with an odd number modulo 2**31 permutes the hashes, for each band in another way.
    factors = [rng.getrandbits(31) | 1 for _ in range(BANDS)]
    mixed = runs.select("lid", *[(F.col(f"h{j}") * F.lit(f)).bitwiseAND(low).cast("int").alias(f"b{b}_{j}") for b, f in enumerate(factors) for j in places])
    nearest = lambda k, seed: F.min(F.least(*[F.col(f"b{k // ROWS}_{j}").bitwiseXOR(F.lit(seed)) for j in places]))
    mins = mixed.groupBy("lid").agg(*[nearest(k, rng.getrandbits(31)).alias(f"m{k}") for k in range(BANDS * ROWS)])
    keys = [F.xxhash64(F.lit(b), *[f"m{b * ROWS + r}" for r in range(ROWS)]) for b in range(BANDS)]
    nibble = lambda k: F.shiftleft(F.shiftright(f"m{k}", 12).bitwiseAND(15).cast("long"), 4 * k)
    sketch = reduce(lambda a, b: a.bitwiseOR(b), map(nibble, range(16)))
    return mins.select("lid", sketch.alias("sketch"), F.array(*keys).alias("keys"))


def _promising(a: Column, b: Column) -> Column:
    """Do two sketches (four bits of 16 values each) agree in ALIKE places? Two lines of the similarity
    wanted do with a probability above 0.997, unrelated ones that share a band hardly ever."""
    x = a.bitwiseXOR(b)
    apart = x.bitwiseOR(F.shiftright(x, 1)).bitwiseOR(F.shiftright(x, 2)).bitwiseOR(F.shiftright(x, 3)).bitwiseAND(F.lit(0x1111111111111111))
    return F.bit_count(apart) <= 16 - ALIKE


def met(lines: DataFrame) -> DataFrame:
    """(key, lid, sketch, rep, rep_sketch) of the keys that more than one of ``lines`` (lid, sketch, keys) has.
    A bucket's smallest lid is its representative. Buckets are counted by partial aggregates and their rows
    meet one row each, so a bucket of any size is many tasks' work."""
    each = lines.select("lid", "sketch", F.explode("keys").alias("key")).repartition("key")
    buckets = each.groupBy("key").agg(F.count("*").alias("n"), F.min("lid").alias("rep"), F.min_by("sketch", "lid").alias("rep_sketch"))
    return written(each.join(buckets.where("n > 1").drop("n").hint("shuffle_hash"), "key"))


def _open(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """``rows`` (key, lid, sketch) with their component and their bucket's largest one (main), of the buckets
    that are not all of one."""
    labelled = rows.join(comps, rows["lid"] == comps["node"], "left").select("key", "lid", "sketch", F.coalesce("component", "lid").alias("component"))
    labelled = written(labelled)
    parts = labelled.groupBy("key", "component").agg(F.count("*").alias("n"))
    mains = parts.groupBy("key").agg(F.count("*").alias("k"), F.max_by("component", F.struct("n", "component")).alias("main"))
    out = written(labelled.join(mains.where("k > 1").drop("k"), "key"))
    discard(labelled)
    return out


def _maps(rows: DataFrame) -> DataFrame:
    """(lid, size, w0, w1, ...) of the sets (runs) of ``rows``: a bit tells if an odd number of a set's members
    fall on it. So two maps differ in no more bits than their sets in members."""
    # An inner explode would put a filter on the sets below their join, where they are made for all texts.
    each = rows.select("lid", F.explode_outer("runs").alias("run")).where("run is not null").select("lid", F.xxhash64("run").alias("h"))
    bits = each.select("lid", F.shiftright("h", 6).bitwiseAND(WORDS - 1).alias("w"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit"))
    word = lambda k: F.bit_xor(F.when(F.col("w") == k, F.col("bit")).otherwise(F.lit(0).cast("long")))
    return bits.groupBy("lid").agg(F.count("*").alias("size"), *[word(k).alias(f"w{k}") for k in range(WORDS)])


def _maybe(similarity: float) -> Column:
    """Can the sets of two rows x and y (size and map) have that Jaccard similarity? No pair that has it is refused."""
    p, q = round(similarity * 10**6), 10**6
    a, b = F.col("x.size"), F.col("y.size")
    apart = reduce(lambda m, n: m + n, [F.bit_count(F.col(f"x.w{k}").bitwiseXOR(F.col(f"y.w{k}"))) for k in range(WORDS)]).cast("long")
    return (F.least(a, b) * q >= F.greatest(a, b) * p) & (apart * F.lit(p + q).cast("long") <= (a + b) * (q - p))


def _classed(rows: DataFrame, similarity: float, near: bool, size: Column | None = None) -> DataFrame:
    """``rows`` with the class of their number of ``runs`` (or ``size``), two steps of 1/similarity wide; with
    ``near`` a row for each class (one or two) in which sets of that similarity can be."""
    place = F.log(F.size("runs") if size is None else size) / max(-math.log(similarity), 0.01)
    at = lambda d: F.floor((place + d) / 2).cast("int")
    # A hair more than a step, so that rounding hides no class.
    return rows.withColumn("size_class", F.explode(F.array_distinct(F.array(at(-1.001), at(1.001)))) if near else at(0))


def _rest(left: DataFrame, sets: Callable[[DataFrame], DataFrame], long: DataFrame | None, similar: Callable[[DataFrame], DataFrame], promising, similarity: float) -> list[DataFrame]:
    """Tables (src, dst) of the links that are left in buckets of several components. ``left`` has key, lid,
    sketch, component, main.

    A bucket's largest component (main) is its home. A line away from it is compared with the home's lines of all
    open buckets at once, so a line's map moves once or twice, whatever the number of its buckets. Lines
    whose numbers of runs are too far apart never meet. Maps of the sets' parities, made once into a table, tell
    which lines can have a partner at all; only their sets are moved and compared."""
    rows = left
    maps = written(_maps(sets(left.select("lid").distinct())))
    x, y = F.col("x.sketch"), F.col("y.sketch")
    sized = F.col("x.size_class") == F.col("y.size_class")
    maybe = sized & promising(x, y) & _maybe(similarity)
    exact = sized & promising(x, y) & alike(F.col("x.runs"), F.col("y.runs"), similarity)

    def closest(a: DataFrame, b: DataFrame, on: Column) -> tuple[DataFrame, DataFrame]:
        """The rows of ``a`` (by classes of near sizes) and of ``b`` that can have a partner in the other, with their sets."""
        near = _classed(a.join(maps, "lid"), similarity, True, F.col("size"))
        own = _classed(b.join(maps, "lid"), similarity, False, F.col("size"))
        kept = written(near.alias("x").join(own.alias("y"), on & maybe, "left_semi").select(*a.columns, "size_class"))
        others = written(own.alias("y").join(near.alias("x"), on & maybe, "left_semi").select(*b.columns, "size_class"))
        made = written(sets(kept.select("lid").union(others.select("lid")).distinct()))
        scrap.extend([kept, others, made])
        return kept.join(made, "lid").alias("x"), others.join(made, "lid").alias("y")

    scrap: list[DataFrame] = []
    away, home = rows.where("component <> main"), rows.where("component = main")
    same = F.col("x.main") == F.col("y.main")
    faces, homes = closest(away.select("lid", "sketch", "main").distinct(), home.select("lid", "sketch", "main").distinct(), same)
    found = written(faces.join(homes, same & exact, "left_semi").select("lid", "main").distinct())
    # Lines without a partner at home, with the others that are away in their buckets.
    lone = written(away.join(found, ["lid", "main"], "left_anti").select("key", "lid", "sketch", "component"))
    others = away.join(lone.select("key").distinct(), "key", "left_semi").select("key", "lid", "sketch", "component")
    differ = (F.col("x.key") == F.col("y.key")) & (F.col("x.component") != F.col("y.component"))
    singles, partners = closest(lone, others, differ)
    met_ = written(singles.join(partners, differ & exact).select(F.col("x.lid").alias("src"), F.col("y.lid").alias("dst")).distinct())
    out = [found.select(F.col("lid").alias("src"), F.col("main").alias("dst")), met_]
    if long is not None:
        pairs = rows.join(long, "lid", "left_semi").alias("x").join(rows.alias("y"), differ & promising(x, y))
        pairs = pairs.select(F.least("x.lid", "y.lid").alias("a"), F.greatest("x.lid", "y.lid").alias("b")).distinct()
        out.append(written(similar(pairs)))
    for df in [lone, maps, *scrap]:
        discard(df)
    return out


def dealt_to(pairs: int) -> int:
    """Tasks for so many pairs of texts: about 2,000 pairs each, more of them beyond 20,000 tasks."""
    return min(1 + pairs // 2000, 20_000)


def grouped(members: DataFrame, similar: Callable[[DataFrame], DataFrame], sets: Callable[[DataFrame], DataFrame],
            similarity: float, promising=_promising, long: DataFrame | None = None) -> DataFrame:
    """(node, component) of the lids of ``members`` (as ``met`` gives them) that are similar to another of their buckets.

    ``similar`` gives the links (src, dst) among pairs (a, b); ``sets`` adds their sets (runs) to rows of
    lids, null for those of ``long``, which ``similar`` compares."""
    others = members.where("lid <> rep")
    pairs = others.where(promising(F.col("sketch"), F.col("rep_sketch")))
    found = written(similar(pairs.select(F.col("rep").alias("a"), F.col("lid").alias("b")).distinct()))
    comps = components(found)
    # A representative has met its whole bucket, and a bucket of two lines is done.
    left = _open(others.select("key", "lid", "sketch"), comps)
    if not left.isEmpty():
        rest = _rest(left, sets, long, similar, promising, similarity)
        comps = components(reduce(DataFrame.union, rest, found))
        for df in rest:
            discard(df)
    discard(left)
    discard(found)
    return comps


def similar_lines(lines: DataFrame, similarity: float = SIMILARITY, long: int = LONG) -> DataFrame:
    """(node, component): the distinct lines (lid) that have a similar one."""
    members = met(band_keys(lines))
    wanted = members.select("lid").distinct()
    texts = written(lines.select("lid", "line").join(wanted, "lid", "left_semi").groupBy("lid").agg(F.min("line").alias("line")))
    is_long = F.length("line") > long
    any_long = not texts.where(is_long).isEmpty()

    def similar(pairs: DataFrame) -> DataFrame:
        pairs = written(pairs)
        count = pairs.count()
        n, own = dealt_to(count), texts
        if count <= FEW:
            own = texts.join(F.broadcast(pairs.select(F.explode(F.array("a", "b")).alias("lid"))), "lid", "left_semi")
        a = own.select(F.col("lid").alias("a"), F.col("line").alias("line_a"))
        b = own.select(F.col("lid").alias("b"), F.col("line").alias("line_b"))
        both = pairs.join(a, "a").repartition(n, "b").join(b, "b")
        long_pair = (F.length("line_a") > long) | (F.length("line_b") > long)
        short = both.where(~long_pair) if any_long else both
        links = short.where(alike(run_set(F.col("line_a")), run_set(F.col("line_b")), similarity)).select(F.col("a").alias("src"), F.col("b").alias("dst"))
        return links.union(_by_rows(both.where(long_pair), similarity)) if any_long else links

    def sets(rows: DataFrame) -> DataFrame:
        return rows.join(texts, "lid").select(*rows.columns, F.when(~is_long, run_set(F.col("line"))).alias("runs"))

    comps = grouped(members, similar, sets, similarity, long=texts.where(is_long).select("lid") if any_long else None)
    discard(members)
    discard(texts)
    return comps


def _by_rows(both: DataFrame, similarity: float) -> DataFrame:
    """The links (src, dst) among pairs (a, b, line_a, line_b) of long lines: runs become rows of the
    pair, counted by run and then by pair, so no array holds a long line's runs."""
    side = lambda k, line: F.struct(F.lit(k).alias("side"), F.col(line).alias("line"))
    sides = both.select("a", "b", F.explode(F.array(side(1, "line_a"), side(2, "line_b"))).alias("s")).select("a", "b", "s.side", "s.line")
    runs = _exploded(sides, "a", "b", "side").select("a", "b", "side", F.xxhash64(_run(F.col("u"), F.col("i"))).alias("h"))
    union = runs.groupBy("a", "b", "h").agg(F.bit_or("side").alias("side"))
    found = union.groupBy("a", "b").agg(F.count("*").alias("any"), F.count_if(F.col("side") == 3).alias("both"))
    p, q = round(similarity * 10**6), 10**6
    return found.where(F.col("both") * q >= F.col("any") * p).select(F.col("a").alias("src"), F.col("b").alias("dst"))


def duplicate_lines(docs: DataFrame, similarity: float = SIMILARITY, **parameters) -> DataFrame:
    """(doc_id, tid, removed): the numbers of the lines to remove, of each document that has any.

    Of each component of equal or similar lines the first place (by doc_id, text hash, line number;
    null ids last) stays. Blank lines are never removed. Lines shorter than a run of characters have
    one, themselves; lines of any length count whole. Rows equal in doc_id and text are one document;
    null texts have no lines."""
    lines = lines_of(docs)
    comps = similar_lines(lines, similarity, **parameters)
    places = written(lines.select("doc_id", "tid", "line_no", "lid"))
    # Most lines stand once and are like no other: only the rest is dealt and ordered.
    repeated = places.groupBy("lid").agg(F.count("*").alias("n")).where("n > 1").select("lid")
    labels = repeated.join(comps, repeated["lid"] == comps["node"], "full").select(F.coalesce("lid", "node").alias("lid"), F.coalesce("component", "lid").alias("component"))
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "tid", "line_no")
    found = written(places.join(labels, "lid").select("component", place.alias("place")))
    discard(places)
    # Repeated rows are the same place, so places are not counted.
    keepers = found.groupBy("component").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first <> last")
    gone = found.join(keepers, "component").where("place <> first")
    return gone.groupBy("place.doc_id", "place.tid").agg(F.array_sort(F.collect_set("place.line_no")).alias("removed"))


def decisions(docs: DataFrame, similarity: float = SIMILARITY, **parameters) -> DataFrame:
    """One row a row of ``docs``: doc_id, n_lines, n_removed, removed (line numbers from 0, ascending).

    A null text has no lines, an empty one a single blank line. Other columns are ignored; an empty
    table gives no rows."""
    breaks = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    heads = docs.select("doc_id", F.xxhash64("text").alias("tid"), F.coalesce(breaks + 1, F.lit(0)).cast("long").alias("n_lines"))
    gone = duplicate_lines(docs, similarity, **parameters).withColumnsRenamed({"doc_id": "_doc", "tid": "_tid"})
    on = heads["doc_id"].eqNullSafe(gone["_doc"]) & (heads["tid"] == gone["_tid"])
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return heads.join(gone, on, "left").select(
        "doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed")
    )


def without_duplicates(docs: DataFrame, similarity: float = SIMILARITY, **parameters) -> DataFrame:
    """``docs`` with the text's duplicate lines removed (and n_chars, where there is one, counted anew).
    Other columns pass as they are, whatever their names."""
    gone = duplicate_lines(docs, similarity, **parameters)
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64("text").alias("t"))
    on = keyed["row"]["doc_id"].eqNullSafe(gone["doc_id"]) & (keyed["t"] == gone["tid"])
    joined = keyed.join(gone, on, "left").select("row", "removed")
    kept = F.array_join(F.filter(F.split(F.col("row")["text"], "\n"), lambda x, i: ~F.array_contains("removed", i)), "\n")
    new = {"text": F.when(F.col("removed").isNull(), F.col("row")["text"]).otherwise(kept)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("removed").isNull(), F.col("row")["n_chars"]).otherwise(F.length(new["text"]).cast("long"))
    return joined.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
