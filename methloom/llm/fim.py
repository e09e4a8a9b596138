"""Fill-in-middle transformation by displacement scatter.

A batch's texts are one line of bytes. Each document is cut into prefix, middle and suffix, and every
segment moves by one displacement to its place in the output. The displacements' differences stand
where segments begin; their running sum gives every byte its shift, and one numpy scatter writes the
batch. Restoring finds the three marks, sets up the displacements of the way back and gathers. Running
sums are taken a slice at a time, so that memory is a few times the batch, whatever a text's length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces

# The marks before prefix, suffix and middle.
MARKS = {"prefix": b"<P>", "suffix": b"<S>", "middle": b"<M>"}
_LETTERS = np.frombuffer(b"PSM", np.uint8)
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Bytes whose shifts are summed at a time.
SLICE = 1 << 20


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column one after another, and where each text begins (and the last one ends)."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return flat[at[0] : at[-1]], at - at[0]


def _strings(data: np.ndarray, starts: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """The reverse of ``_bytes``."""
    buffers = [pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(data)]
    out = pa.LargeStringArray.from_buffers(len(starts) - 1, *buffers)
    if null is not None and null.any():
        out = pc.if_else(pa.array(null), pa.scalar(None, pa.large_string()), out)
    return out.cast(pa.string())


def _shifts(total: int, at: np.ndarray, shift: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(a, b, places + shifts) for slices of ``total`` places: from at[i] on places shift by shift[i]; of
    segments that begin at one place the last one has it. ``at`` ascends."""
    delta, carry = np.diff(shift, prepend=0), 0
    for a in range(0, total, SLICE):
        b = min(a + SLICE, total)
        low, high = np.searchsorted(at, (a, b))
        steps = np.zeros(b - a, dtype=np.int64)
        np.add.at(steps, at[low:high] - a, delta[low:high])
        moved = np.cumsum(steps) + carry
        carry = int(moved[-1])
        yield a, b, moved + np.arange(a, b)


def _marks(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and row of every mark that stands within one text."""
    if len(data) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.flatnonzero(data[:-2] == ord("<"))
    at = at[(data[at + 2] == ord(">")) & np.isin(data[at + 1], _LETTERS)]
    row = np.searchsorted(starts, at, "right") - 1
    inside = at + 3 <= starts[row + 1]
    return at[inside], row[inside]


def _draws(ids: list, seed: int) -> np.ndarray:
    """Four unsigned numbers for each document, from the SHA-256 of seed and id."""
    digests = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(digests, ">u4").reshape(-1, 4).astype(np.int64)


def _cut(data: np.ndarray, starts: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of lines of each text, and the bytes where its prefix and its middle end."""
    begin, end = starts[:-1], starts[1:]
    breaks = np.flatnonzero(data == ord("\n"))
    first = np.searchsorted(breaks, begin)
    whole = np.searchsorted(breaks, end) - first  # lines that a line feed ends
    n = whole + ((end > begin) & (data[np.maximum(end - 1, 0)] != ord("\n")) if len(data) else 0)
    cuts = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)

    def place(k: np.ndarray) -> np.ndarray:
        if not len(breaks):
            return np.where(k > 0, end, begin)
        after = breaks[np.clip(first + k - 1, 0, len(breaks) - 1)] + 1
        return np.where(k == 0, begin, np.where(k <= whole, after, end))

    return n, place(cuts[:, 0]), place(cuts[:, 1])


def transform(docs: DataFrame, seed: int = 7, fim_percent: int = 100, spm_percent: int = 50) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output), a row for each of ``docs`` (doc_id, text).

    Texts are cut between lines; the cuts and the form come from a hash of seed and doc_id. A null text is
    empty; an empty one, one with a mark in it and those that the draw leaves are ``plain``: output is the
    text, lengths are null. A null doc_id draws as an empty one; repeated rows come out alike; other columns
    are not read. Nothing is shuffled; a task holds a few times one batch or one text."""
    ids = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            data, starts = _bytes(batch.column("text"))
            begin, end = starts[:-1], starts[1:]
            h = _draws(batch.column("doc_id").to_pylist(), seed)
            n, c1, c2 = _cut(data, starts, h)
            plain = (begin == end) | (h[:, 2] % 100 >= fim_percent)
            plain[_marks(data, starts)[1]] = True
            spm = ~plain & (h[:, 3] % 100 < spm_percent)
            prefix, middle, suffix = c1 - begin, c2 - c1, end - c2
            outs = np.concatenate([[0], np.cumsum(end - begin + np.where(plain, 0, 9))])
            o = outs[:-1]
            # Where each segment's text begins in the output.
            to_prefix, to_suffix = o + np.where(spm, 6 + suffix, 3), o + np.where(spm, 3, 6 + prefix)
            to = np.stack([to_prefix, o + prefix + suffix + 9, to_suffix], axis=1)
            at = np.stack([begin, c1, c2], axis=1)
            shift = np.where(plain[:, None], (o - begin)[:, None], to - at)
            out = np.empty(outs[-1], dtype=np.uint8)
            for a, b, where in _shifts(len(data), at.ravel(), shift.ravel()):
                out[where] = data[a:b]
            for name, k in (("prefix", 0), ("middle", 1), ("suffix", 2)):
                out[to[~plain, k][:, None] - 3 + np.arange(3)] = np.frombuffer(MARKS[name], np.uint8)
            chars = lambda a, b: [None if p else int(np.count_nonzero((data[i:j] & 0xC0) != 0x80)) for i, j, p in zip(a, b, plain, strict=True)]  # noqa: E731, B023
            form = np.where(plain, PLAIN, np.where(spm, SPM, PSM))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(form.tolist(), pa.string()), pa.array(chars(begin, c1), pa.int64()),
                 pa.array(chars(c1, c2), pa.int64()), _strings(out, outs)],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    schema = f"doc_id {ids}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that ``transform`` was given, from its output and form alone; null if they do not agree
    (not one of each mark, marks in another order, an unknown or null form) or output is null."""

    @F.arrow_udf("string")
    def fim_restored(output: pa.Array, form: pa.Array) -> pa.Array:
        data, starts = _bytes(output)
        begin, end = starts[:-1], starts[1:]
        kinds = np.asarray(pc.fill_null(form, ""), dtype=object)
        plain, spm, psm = kinds == PLAIN, kinds == SPM, kinds == PSM
        at, row = _marks(data, starts)
        moved = ~plain[row]
        at, row = at[moved], row[moved]
        count = np.bincount(row, minlength=len(begin))
        good = (spm | psm) & (count == 3)
        at = at[good[row]].reshape(-1, 3)
        order = np.array([b"PSM".index(x) for x in b"SPM"])
        letters = data[at + 1] if len(at) else np.empty((0, 3), np.uint8)
        want = np.where(spm[good][:, None], _LETTERS[order], _LETTERS)
        right = (letters == want).all(axis=1) & (at[:, 0] == begin[good])
        good[np.flatnonzero(good)[~right]] = False
        a = np.zeros((len(begin), 3), dtype=np.int64)
        a[good] = at[right]
        # Segments as they stand in the output, first, second and middle.
        first, second, middle = a[:, 1] - a[:, 0] - 3, a[:, 2] - a[:, 1] - 3, end - a[:, 2] - 3
        prefix, suffix = np.where(spm, second, first), np.where(spm, first, second)
        size = np.where(good, first + second + middle, np.where(plain, end - begin, 0))
        outs = np.concatenate([[0], np.cumsum(size)])
        o = outs[:-1]
        source = np.stack([np.where(spm, a[:, 1], a[:, 0]) + 3, a[:, 2] + 3, np.where(spm, a[:, 0], a[:, 1]) + 3], axis=1)
        to = np.stack([o, o + prefix, o + prefix + middle], axis=1)
        to = np.where(good[:, None], to, o[:, None])
        shift = np.where(good[:, None], source - to, (begin - o)[:, None])
        out = np.empty(outs[-1], dtype=np.uint8)
        for x, y, where in _shifts(len(out), to.ravel(), shift.ravel()):
            out[x:y] = data[where]
        return _strings(out, outs, ~(good | plain) | np.asarray(output.is_null()))

    return fim_restored(output, form)
