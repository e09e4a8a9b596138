"""Windows around motif sites of reads (the inner part of A1): sequences, kinetics and map codes of all reads of
an Arrow batch as flat arrays, cut by index arithmetic."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import walks as V
from .modtags import PROBABILITIES
from .sequence import COMPLEMENTS, LETTERS
from .signal import MAD_SCALE

#: Bases of reads that are gathered at a time (one read at least).
BASES = 1 << 20
KINETICS = ("fi", "ri", "fp", "rp")


def _byte_table() -> np.ndarray:
    """The complement of every byte, N for those that are no letters of bases."""
    out = np.full(256, ord("N"), dtype=np.uint8)
    out[np.frombuffer(LETTERS.encode(), np.uint8)] = np.frombuffer(COMPLEMENTS.encode(), np.uint8)
    return out


def _frame_table() -> np.ndarray:
    """Frames of the 256 codes, see ``signal.frames``."""
    code = np.arange(256)
    step = 1 << (code // 64)
    return ((step - 1) * 64 + (code % 64) * step).astype(np.float64)


COMPLEMENT, FRAMES = _byte_table(), _frame_table()


@dataclass(frozen=True)
class Plan:
    """What is cut: motifs and the place of the modified base in them, length of windows, normalisation,
    whether sites in clips are left out, whether there are kinetics and map codes, columns that pass through."""

    motifs: list[str]
    mod_loc: int
    seq_len: int
    norm: str
    skip_unmapped: bool
    kinetics: bool
    maps: bool
    passing: list[str] = field(default_factory=list)


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, each one's start, and its size; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return flat[at[0] : at[-1]], at[:-1] - at[0], np.diff(at)


def _row(sizes: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(sizes)), sizes)


def normalised(flat: np.ndarray, sizes: np.ndarray, method: str) -> np.ndarray:
    """``signal.normalised`` of many arrays, one after another."""
    n, row, start = len(sizes), _row(sizes), np.cumsum(sizes) - sizes
    full = np.flatnonzero(sizes)
    least = lambda x, f=np.minimum: np.bincount(full, f.reduceat(x, start[full]), n) if len(full) else np.zeros(n)
    mean = lambda x: np.bincount(row, x, n) / np.maximum(sizes, 1)

    def median(x: np.ndarray) -> np.ndarray:
        if not len(full):
            return np.zeros(n)
        s = x[np.lexsort((x, row))]
        return np.bincount(full, (s[start[full] + (sizes[full] - 1) // 2] + s[start[full] + sizes[full] // 2]) / 2, n)

    if method == "none":
        shift, scale = np.zeros(n), np.ones(n)
    elif method == "zscore":
        shift = mean(flat)
        scale = np.sqrt(mean((flat - shift[row]) ** 2))
    elif method == "min-max":
        shift = least(flat)
        scale = least(flat, np.maximum) - shift
    elif method == "min-mean":
        shift, scale = least(flat), mean(flat)
    elif method == "mad":
        shift = median(flat)
        scale = median(np.abs(flat - shift[row])) / MAD_SCALE
    else:
        raise ValueError(f"unknown normalisation: {method}")
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.floor((flat - shift[row]) / scale[row] * 1e6 + 0.5) / 1e6
    return np.where(scale[row] == 0, 0.0, out)


def _hits(seq: np.ndarray, end: np.ndarray, motifs: list[str]) -> np.ndarray:
    """Where a motif begins, in reads that end at ``end`` (a value for each base)."""
    k = len(motifs[0])
    if len(seq) < k:
        return np.empty(0, np.int64)
    found = np.zeros(len(seq) - k + 1, dtype=bool)
    for motif in motifs:
        same = np.ones(len(found), dtype=bool)
        for j, letter in enumerate(motif.encode()):
            same &= seq[j : j + len(found)] == letter
        found |= same
    at = np.flatnonzero(found)
    return at[at + k <= end[at]]


def read_hits(seq: pa.Array, motifs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Row and place of every hit in a column of sequences."""
    data, start, n = _texts(seq)
    row = _row(n)
    at = _hits(data, (start + n)[row], motifs)
    return row[at], at - start[row[at]]


def placed_calls(ops: Column, skips: Column, ml: Column, seq: Column, reverse: Column, base: str = "C") -> Column:
    """(loc, prob, offset) of each call of a read on an aligned base, from its CIGAR, skips, bytes and sequence, loc and
    sequence in alignment order: ``modtags.decode`` and ``walks.to_references`` in one pass over a batch. No calls
    where skips and bytes differ in number or go beyond the read's bases."""
    other = int(COMPLEMENT[ord(base)])

    @F.arrow_udf("array<struct<loc:int,prob:double,offset:int>>")
    def calls(ops: pa.Array, skips: pa.Array, ml: pa.Array, seq: pa.Array, reverse: pa.Array) -> pa.Array:
        n, m, value = V.sizes(skips), V.sizes(ml), V.ints(skips.flatten())
        sound = ~np.asarray(skips.is_null()) & (n == m)
        data, start, size = _texts(seq)
        back = np.asarray(pc.fill_null(reverse, False))
        hits = np.flatnonzero(data == np.where(back, other, ord(base))[_row(size)])
        low, high = np.searchsorted(hits, start), np.searchsorted(hits, start + size)
        row = _row(n)
        ordinal = V.before(value + 1, n) + value
        beyond = ordinal >= (high - low)[row]
        sound &= np.bincount(row, beyond, len(n)) == 0
        # Bases are counted as the read was sequenced, on reverse reads from the end.
        at = np.where(sound[row], np.where(back[row], high[row] - 1 - ordinal, low[row] + ordinal), 0)
        loc = hits[at] - start[row] if len(hits) else np.zeros(len(row), dtype=np.int64)
        offset, aligned = V.offsets_of(*V.blocks_of(ops), row, loc)
        keep = np.flatnonzero(aligned & sound[row])
        byte = V.ints(ml.flatten())[((np.cumsum(m) - m)[row] + np.arange(len(row)) - (np.cumsum(n) - n)[row])[keep]] if len(keep) else np.empty(0, np.int64)
        known = (byte >= 0) & (byte < 256)
        fields = [pa.array(loc[keep], pa.int32()), pa.array(np.array(PROBABILITIES)[np.where(known, byte, 0)], pa.float64(), mask=~known), pa.array(offset[keep], pa.int32())]
        counts = np.bincount(row[keep], minlength=len(n))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.StructArray.from_arrays(fields, ["loc", "prob", "offset"]))

    return calls(ops, skips, ml, seq, reverse)


def _ragged(values: np.ndarray, inside: np.ndarray, null: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Rows of a matrix as lists of those that are inside."""
    sizes = np.where(null, 0, inside.sum(axis=1))
    flat = values[inside & ~null[:, None]]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat, kind), mask=pa.array(null, pa.bool_()))


def _map_codes(batch: pa.RecordBatch, seq: np.ndarray, start: np.ndarray, n: np.ndarray, reverse: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """A code for each base in read direction, see ``cigar.map_code``; ``offset``: reference offsets of all bases
    in read direction, -1 where there is none. Bases in clips are 1."""
    ref, ref_start, ref_size = _texts(batch.column("ref_seq"))
    known = ~np.asarray(batch.column("ref_seq").is_null())
    row = _row(n)
    place = np.arange(len(seq)) - start[row]
    first, last = (V.ints(batch.column(c))[row] for c in ("first", "last"))
    upper = lambda x: np.where((x >= ord("a")) & (x <= ord("z")), x - 32, x)
    has = (offset >= 0) & (offset < ref_size[row])
    under = ref[np.where(has, ref_start[row] + offset, 0)] if len(ref) else np.zeros(len(seq), np.uint8)
    differs = known[row] & (offset >= 0) & (~has | (upper(under) != upper(seq)))
    prior = np.concatenate([[-1], offset[:-1]]) if len(offset) else offset
    jump = (place > first) & (prior >= 0) & (offset != prior + 1)
    code = np.where(offset < 0, 1, np.where(differs, 4, 0) + np.where(jump, 2, 0))
    return np.where((place < first) | (place >= last), 1, code)


def _sites(batch: pa.RecordBatch, plan: Plan) -> pa.RecordBatch:
    """A row for each site of a batch of reads."""
    flank = (plan.seq_len - 1) // 2
    shift = len(plan.motifs[0]) - 1 - 2 * plan.mod_loc
    data, start, n = _texts(batch.column("seq"))
    reverse = np.asarray(pc.fill_null(batch.column("reverse"), False))
    row = _row(n)
    end = (start + n)[row]
    mirrored = start[row] + end - 1 - np.arange(len(data))
    seq = np.where(reverse[row], COMPLEMENT[data[mirrored]], data)
    at = _hits(seq, end, plan.motifs) + plan.mod_loc
    of = row[at - plan.mod_loc] if len(at) else np.empty(0, np.int64)
    loc = at - start[of]
    other = n[of] - 1 - loc - shift
    keep = (loc >= flank) & (loc < n[of] - flank) & (other >= flank) & (other < n[of] - flank)
    if plan.skip_unmapped:
        keep &= (loc >= V.ints(batch.column("first"))[of]) & (loc < V.ints(batch.column("last"))[of])
    of, loc, other = of[keep], loc[keep], other[keep]
    window = np.arange(-flank, plan.seq_len - flank)

    ops = V.blocks_of(batch.column("cigar"))
    offset, aligned = V.offsets_of(*ops, of, np.where(reverse[of], n[of] - 1 - loc, loc))
    begin = batch.column("start").take(pa.array(of)).cast(pa.int64())
    pos = pc.if_else(pa.array(aligned), pc.add(begin, pa.array(offset, pa.int64())), pa.scalar(None, pa.int64()))

    def kmers(places: np.ndarray, table: np.ndarray) -> pa.Array:
        text = np.ascontiguousarray(table[seq[places]])
        ends = np.arange(len(places) + 1, dtype=np.int32) * plan.seq_len
        return pa.StringArray.from_buffers(len(places), pa.py_buffer(ends), pa.py_buffer(text))

    same = np.arange(256, dtype=np.uint8)
    own = (start[of] + loc)[:, None] + window
    # The other strand's window, whose places run down along this one's.
    flipped = (start[of] + n[of] - 1 - other)[:, None] - window
    out = {"pos": pc.fill_null(pos, -1), "loc": pa.array(loc, pa.int32()), "f_kmer": kmers(own, same), "r_kmer": kmers(flipped, COMPLEMENT)}
    if plan.kinetics:
        for name, column, place in (("f_ipd", "fi", loc), ("f_pw", "fp", loc), ("r_ipd", "ri", other), ("r_pw", "rp", other)):
            lists = batch.column(column)
            size = V.sizes(lists)
            flat = normalised(FRAMES[V.ints(lists.flatten()) & 255], size, plan.norm)
            places = place[:, None] + window
            inside = (places >= 0) & (places < size[of][:, None])
            values = flat[np.where(inside, (np.cumsum(size) - size)[of][:, None] + places, 0)] if len(flat) else np.zeros(places.shape)
            out[name] = _ragged(values, inside, np.asarray(lists.is_null())[of], pa.float64())
    if plan.maps:
        place = np.arange(len(seq)) - start[row]
        every, aligned = V.offsets_of(*ops, row, np.where(reverse[row], n[row] - 1 - place, place))
        every = np.where(aligned, np.where(reverse[row], V.ints(batch.column("ref_length"))[row] - 1 - every, every), -1)
        codes = _map_codes(batch, seq, start, n, reverse, every)
        null = np.zeros(len(of), dtype=bool)
        for name, centre, step in (("f_map", loc, window), ("r_map", loc + shift, -window)):
            places = centre[:, None] + step
            inside = (places >= 0) & (places < n[of][:, None])
            values = np.where(inside, codes[np.where(inside, start[of][:, None] + places, 0)] if len(codes) else 1, 1)
            out[name] = _ragged(values, np.ones_like(inside), null, pa.int32())
    index = pa.array(of)
    out |= {c: batch.column(c).take(index) for c in plan.passing}
    return pa.RecordBatch.from_pydict(out)


def site_windows(plan: Plan):
    """A function for ``mapInArrow``: reads in, sites out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = (np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column("seq")), 0), dtype=np.int64))) // BASES
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows] if batch.num_rows else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield _sites(batch.slice(a, b - a), plan)

    return run
