"""Running sums and lookups along reads, for which Spark's array functions take quadratic time: Arrow
batches in, Arrow batches out, all reads of a batch at once. Not for use within a lambda."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

QUERY, REFERENCE, BOTH = ("M", "=", "X", "I", "S"), ("M", "=", "X", "D", "N"), ("M", "=", "X")
BLOCKS = "array<struct<op:string,len:int,q:int,r:int>>"


def sizes(a: pa.Array) -> np.ndarray:
    """Length of each list, 0 for null."""
    return np.asarray(pc.fill_null(pc.list_value_length(a), 0), dtype=np.int64)


def ints(a: pa.Array) -> np.ndarray:
    """Whole numbers, 0 for null."""
    return np.asarray(pc.fill_null(a, 0), dtype=np.int64)


def _lists(values: pa.Array, sizes: np.ndarray, null) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values, mask=pa.array(null, pa.bool_()))


def before(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of the values before each one in its list."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[:-1] - np.repeat(total[np.cumsum(sizes) - sizes], sizes)


def _bases(seq: pa.Array, base: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of a base in all reads end to end, and each read's start and length."""
    seq = pc.fill_null(seq, "").cast(pa.binary())
    sizes = np.asarray(pc.binary_length(seq), dtype=np.int64)
    data = np.frombuffer(b"".join(seq.to_pylist()), np.uint8)
    return np.flatnonzero(data == ord(base)), np.cumsum(sizes) - sizes, sizes


def blocks_of(ops: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Number of operations of each read, and of all reads' operations one after another the kind, the length and
    the query and reference places where they begin."""
    n, flat = sizes(ops), ops.flatten()
    op, length = flat.field("op"), ints(flat.field("len"))
    moves = lambda kinds: before(np.where(np.asarray(pc.is_in(op, pa.array(kinds))), length, 0), n)
    return n, op, length, moves(QUERY), moves(REFERENCE)


def offsets_of(n: np.ndarray, op: pa.Array, length: np.ndarray, q: np.ndarray, r: np.ndarray, row: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Reference offsets of query places of the reads ``row``, and whether they are aligned (0 where not); the
    rest as ``blocks_of`` gives it."""
    match = np.asarray(pc.is_in(op, pa.array(BOTH)))
    # Reads one after another on one line, so that a single search serves them all; of blocks that
    # begin at one place the last one is the one that has it.
    line, first = np.arange(len(n)) << 33, np.cumsum(n) - n
    at = np.searchsorted(q + np.repeat(line, n), places + line[row], "right") - 1
    inside = (at >= first[row]) & (places >= 0)
    at = np.where(inside, at, 0)
    if not len(q):
        return np.zeros(len(places), dtype=np.int64), np.zeros(len(places), dtype=bool)
    inside &= match[at] & (places < q[at] + length[at])
    return np.where(inside, r[at] + places - q[at], 0), inside


def walk(ops: Column) -> Column:
    """Each operation with the query and reference places where it begins; see ``cigar.blocks``."""

    @F.arrow_udf(BLOCKS)
    def cigar_walk(ops: pa.Array) -> pa.Array:
        n, op, length, q, r = blocks_of(ops)
        out = [op, *(pa.array(x, pa.int32()) for x in (length, q, r))]
        return _lists(pa.StructArray.from_arrays(out, ["op", "len", "q", "r"]), n, ops.is_null())

    return cigar_walk(ops)


def to_references(blocks: Column, queries: Column) -> Column:
    """Reference offsets of an array of query places (in any order), null where they are not aligned."""

    @F.arrow_udf("array<int>")
    def reference_offsets(blocks: pa.Array, queries: pa.Array) -> pa.Array:
        m, flat = sizes(queries), blocks.flatten()
        moves = (ints(flat.field(c)) for c in ("len", "q", "r"))
        row = np.repeat(np.arange(len(m)), m)
        offsets, inside = offsets_of(sizes(blocks), flat.field("op"), *moves, row, ints(queries.flatten()))
        return _lists(pa.array(offsets, pa.int32(), mask=~inside), m, queries.is_null())

    return reference_offsets(blocks, queries)


def _inner(blocks: pa.Array, queries: pa.Array, n: int, matches_only: bool, aligned: bool) -> pa.Array:
    k, flat, m = sizes(blocks), blocks.flatten(), sizes(queries)
    op, (length, q, r) = flat.field("op"), (ints(flat.field(c)) for c in ("len", "q", "r"))
    counted = np.asarray(pc.is_in(op, pa.array(BOTH)) if matches_only else pc.invert(pc.is_in(op, pa.array(["H", "P"]))))
    pairs, row, places = np.where(counted, length, 0), np.repeat(np.arange(len(m)), m), ints(queries.flatten())
    ok = np.asarray(queries.flatten().is_valid())
    if len(q):
        line, first = np.arange(len(k)) << 33, np.cumsum(k) - k
        at = np.searchsorted(q + np.repeat(line, k), places + line[row], "right") - 1
        known = at >= first[row]
        at = np.where(known, at, 0)
        # Of the block that a place is in, pairs up to the place; of a deletion or skip before it, all.
        moves = np.asarray(pc.is_in(op, pa.array(QUERY)))[at]
        here = np.where(counted[at], np.where(moves, np.clip(places - q[at], 0, length[at]), length[at]), 0)
        rank = np.where(known, before(pairs, k)[at] + here, 0)
        total = np.bincount(np.repeat(np.arange(len(k)), k), pairs, len(k)).astype(np.int64)
        ok &= (rank >= n) & (rank < total[row] - n)
        if aligned:
            ok &= offsets_of(k, op, length, q, r, row, places)[1]
    else:
        ok[:] = False
    index = np.arange(len(places)) - np.repeat(np.cumsum(m) - m, m)
    null = pc.or_(queries.is_null(), blocks.is_null())
    return _lists(pa.array(index[ok], pa.int32()), np.bincount(row[ok], minlength=len(m)), null)


def inner_places(blocks: Column, queries: Column, n: int, matches_only: bool = True, aligned: bool = False) -> Column:
    """Which of an array of query places (their indices, from 0) aren't among the first or last n aligned pairs, and
    with ``aligned`` are aligned themselves; see ``filters.clipped_pairs``. About a million places at a time."""

    @F.arrow_udf("array<int>")
    def unclipped_places(blocks: pa.Array, queries: pa.Array) -> pa.Array:
        ends = np.cumsum(sizes(queries))
        cuts = [0, *(np.flatnonzero(np.diff(ends >> 20)) + 1).tolist(), len(ends)]
        return pa.concat_arrays([_inner(blocks[a:z], queries[a:z], n, matches_only, aligned) for a, z in zip(cuts, cuts[1:], strict=False)])

    return unclipped_places(blocks, queries)


def skips_of(locs: Column, seq: Column, base: str) -> Column:
    """How many of a base are skipped before each of the ascending places; null if one is not that base, or without places."""

    @F.arrow_udf("array<int>")
    def base_skips(locs: pa.Array, seq: pa.Array) -> pa.Array:
        n, places = sizes(locs), ints(locs.flatten())
        hits, start, size = _bases(seq, base)
        row = np.repeat(np.arange(len(n)), n)
        at = np.searchsorted(hits, places + start[row])
        sound = (places >= 0) & (places < size[row])
        sound &= hits[np.minimum(at, len(hits) - 1)] == places + start[row] if len(hits) else False
        ordinal = at - np.searchsorted(hits, start)[row]
        prior = np.concatenate([[-1], ordinal[:-1]])
        prior[(np.cumsum(n) - n)[n > 0]] = -1
        bad = (np.bincount(row, ~sound, len(n)) > 0) | (n == 0)
        return _lists(pa.array(ordinal - prior - 1, pa.int32()), n, bad)

    return base_skips(locs, seq)


def places_of(skips: Column, seq: Column, base: str) -> Column:
    """Places of a base by skips; null if they go beyond the read's bases."""

    @F.arrow_udf("array<int>")
    def base_places(skips: pa.Array, seq: pa.Array) -> pa.Array:
        n, value = sizes(skips), ints(skips.flatten())
        hits, start, size = _bases(seq, base)
        row, low = np.repeat(np.arange(len(n)), n), np.searchsorted(hits, start)
        ordinal = before(value + 1, n) + value
        beyond = ordinal >= (np.searchsorted(hits, start + size) - low)[row]
        at = np.where(beyond, 0, low[row] + ordinal)
        places = hits[at] - start[row] if len(hits) else np.zeros(len(value), dtype=np.int64)
        bad = np.asarray(skips.is_null()) | (np.bincount(row, beyond, len(n)) > 0)
        return _lists(pa.array(places, pa.int32()), n, bad)

    return base_places(skips, seq)
