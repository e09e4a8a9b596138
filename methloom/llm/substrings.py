"""Repeated passages by relative Lempel-Ziv parsing against indexed reference blocks.

Documents are dealt to blocks by a hash. Every block is a reference for all others, and for itself:

1. A block's index are the hashes of all its runs of ``window`` words; the indexes of all blocks meet by
   hash range. There each entry learns one reference block in which the same words start: the one
   before it among the blocks that have them (of the first, the last), so that a passage that all blocks
   share is looked for in each of them about as often; or its own, if they start there twice only.
2. A document's stretches of such entries go, word for word and equal ones of a block once, to the
   reference blocks named in them.
3. The reference block parses a stretch greedily: a factor begins with the first window that it has and
   is extended, word by word, along one place of its own text for as long as that goes on alike. Where
   a factor ends, the windows across the boundary are looked up like any others, so the next factor may
   begin before it and no words are lost at the seam. Words are compared, hashes only name places.
4. Back at the document, of all blocks' factors the one that reaches furthest is taken, again and again.
   All factors have ``window`` words or more; what they cover are the duplicate spans.

Texts move once for all four steps (Spark reuses the exchange), indexes once at 8 bytes a word.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, rolling

WINDOW = 35
SPANS = "array<struct<start:int,length:int,ref_doc_id:long,ref_start:int,ref_block:int>>"
RESULT = f"doc_id long, n_words long, n_removed long, kept_sha256 string, spans {SPANS}, kept_text string"
FACTORS = "block int, did long, start int, length int, ref_doc_id long, ref_start int, ref_block int"


class Block:
    """A block's documents in a fixed order: their words, and the hashes of all windows, end to end."""

    def __init__(self, t: pa.Table, window: int, hashed: bool = True):
        t = t.take(pa.array(np.argsort(np.asarray(t.column("did")), kind="stable")))
        self.doc_id, self.did, self.window, self.seen = t.column("doc_id"), t.column("did").to_pylist(), window, WordHashes()
        self.words = [(x or b"").split() for x in t.column("text").to_pylist()]
        if hashed:
            self.hashes = [self.seen.of(w) for w in self.words]
            windows = [rolling(h, window) for h in self.hashes]
            self.sizes = [len(w) for w in windows]
            self.windows = np.concatenate(windows) if windows else np.empty(0, np.uint64)


def _ranges(sorted_hashes: np.ndarray, n: int) -> np.ndarray:
    """Bounds of the n equal hash ranges in a sorted array."""
    edges = np.array([(i << 64) // n for i in range(1, n)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(sorted_hashes, edges), [len(sorted_hashes)]]).astype(np.int64)


def _alike(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common beginning of two arrays."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        differ = np.flatnonzero(a[at : min(at + step, n)] != b[at : min(at + step, n)])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, step * 4
    return n


class Reference:
    """A block as reference: where its windows start first, and where next after that."""

    def __init__(self, block: Block):
        self.block = block
        order = np.argsort(block.windows, kind="stable")
        h = block.windows[order]
        new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.empty(0, bool)
        first = np.flatnonzero(new)
        again = np.minimum(first + 1, max(len(h) - 1, 0))
        self.hashes, self.first, self.again = h[first], order[first], order[again]
        self.ends = np.cumsum(block.sizes)  # windows up to each document's last

    def place(self, at: int) -> tuple[int, int]:
        """Document and word at which a window starts."""
        doc = int(np.searchsorted(self.ends, at, "right"))
        return doc, at - int(self.ends[doc]) + self.block.sizes[doc]

    def factors(self, words: list[bytes], own: int | None):
        """(start, length, document, word) of the greedy parse of a stretch of words; ``own`` is the
        place of its first window, if it stands in this block itself."""
        window, hashes = self.block.window, self.block.seen.of(words)
        wanted = rolling(hashes, window)
        at = np.minimum(np.searchsorted(self.hashes, wanted), max(len(self.hashes) - 1, 0))
        has = self.hashes[at] == wanted if len(self.hashes) else np.zeros(len(wanted), bool)
        place = self.first[at] if len(self.hashes) else at
        if own is not None:
            place = np.where(place == own + np.arange(len(wanted)), self.again[at], place)
            has &= place != own + np.arange(len(wanted))
        starts, end, k = np.flatnonzero(has), 0, 0
        while True:
            k = int(np.searchsorted(starts, max(end - window + 1, 0))) if end else k
            while k < len(starts):
                i = int(starts[k])
                doc, word = self.place(int(place[i]))
                n = _alike(hashes[i:], self.block.hashes[doc][word:])
                if n >= window and words[i : i + n] == self.block.words[doc][word : word + n] and i + n > end:
                    break
                k += 1
            else:
                return
            yield i, n, doc, word
            end = i + n


def parse(docs: DataFrame, window: int = WINDOW, block_bytes: int = 8 << 20, range_words: int = 2_000_000,
          with_text: bool = True) -> DataFrame:
    """One row a row of ``docs``: doc_id, n_words, n_removed, kept_sha256, spans (the factors, by place,
    each with the place of the same words in its reference), kept_text (null unless ``with_text``).

    A word is removed if a run of ``window`` words over it also starts anywhere else, in the same
    document or another; all runs are judged on the input. Null and empty texts have no words, texts
    shorter than a window lose none, texts of any length are parsed whole, repeated rows are copies of
    each other. Of factors that reach equally far the first by start, block and place counts. A null
    doc_id stays null; other columns are ignored; an empty table gives an empty result. The rows
    between blocks and ranges are as many as there are pairs of them, but no more than there are words."""
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(8, n_bytes // block_bytes)
    n_ranges = max(8, n_bytes // 6 // range_words)
    keyed = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.xxhash64("doc_id", "text").alias("did"))
    # Rows equal in doc_id and text are parted by where they are read.
    dealt = keyed.withColumn("block", F.pmod(F.xxhash64("did", F.spark_partition_id()), F.lit(n_blocks)).cast("int"))

    def index(t: pa.Table) -> pa.Table:
        hashes, counts = np.unique(Block(t, window).windows, return_counts=True)
        cut = _ranges(hashes, n_ranges)
        some = np.flatnonzero(np.diff(cut))
        block = t.column("block")[0].as_py()
        return pa.table({
            "range": pa.array(some.astype(np.int32)),
            "block": pa.array(np.full(len(some), block, dtype=np.int32)),
            "hashes": pa.array([hashes[cut[r] : cut[r + 1]].tobytes() for r in some], pa.binary()),
            "twice": pa.array([np.packbits(counts[cut[r] : cut[r + 1]] > 1).tobytes() for r in some], pa.binary()),
        })

    def meet(t: pa.Table) -> pa.Table:
        blocks = np.asarray(t.column("block"), dtype=np.int32)
        parts = [np.frombuffer(x, dtype=np.uint64) for x in t.column("hashes").to_pylist()]
        own = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(p)).astype(bool) for x, p in zip(t.column("twice").to_pylist(), parts, strict=True)]
        turn = np.argsort(blocks, kind="stable")
        sizes = np.array([len(parts[i]) for i in turn])
        hashes = np.concatenate([parts[i] for i in turn])
        owner = np.repeat(blocks[turn], sizes)
        order = np.argsort(hashes, kind="stable")
        h, o = hashes[order], owner[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        size = np.diff(np.append(first, len(h)))
        # The block before each, and for a run's first block its last.
        before = np.concatenate([[0], o[:-1]])
        before[first] = o[first + size - 1]
        back = np.empty(len(h), dtype=np.int32)
        back[order] = np.where(np.repeat(size, size) > 1, before, -1)
        refs, blocks_out = [], []
        for i, part in zip(turn, np.split(back, np.cumsum(sizes)[:-1]), strict=True):
            part = np.where((part < 0) & own[i], blocks[i], part).astype(np.int32)
            found = part >= 0
            if found.any():
                blocks_out.append(blocks[i])
                refs.append((np.packbits(found).tobytes(), part[found].tobytes()))
        return pa.table({
            "block": pa.array(np.array(blocks_out, dtype=np.int32)),
            "range": pa.array([t.column("range")[0].as_py()] * len(refs), pa.int32()),
            "found": pa.array([a for a, _ in refs], pa.binary()),
            "refs": pa.array([b for _, b in refs], pa.binary()),
        })

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        """The stretches of a block's documents for each reference block: words, and where they stand."""
        asked: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
        if left.num_rows and right.num_rows:
            block = Block(left, window)
            hashes, inverse = np.unique(block.windows, return_inverse=True)
            cut, ref = _ranges(hashes, n_ranges), np.full(len(hashes), -1, dtype=np.int32)
            for r, found, refs in zip(*(right.column(c).to_pylist() for c in ("range", "found", "refs")), strict=True):
                a, b = cut[r], cut[r + 1]
                ref[a:b][np.unpackbits(np.frombuffer(found, np.uint8), count=b - a).astype(bool)] = np.frombuffer(refs, np.int32)
            at, source = 0, ref[inverse]
            for did, words, size in zip(block.did, block.words, block.sizes, strict=True):
                hit = np.flatnonzero(source[at : at + size] >= 0)
                for run in np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1) if len(hit) else []:
                    a, z = int(run[0]), int(run[-1]) + window
                    text = b" ".join(words[a:z])
                    for to in np.unique(source[at + run]).tolist():
                        asked.setdefault((to, text), []).append((did, a))
                at += size
        own = left.column("block")[0].as_py() if left.num_rows else 0
        return pa.table({
            "to": pa.array([k[0] for k in asked], pa.int32()), "block": pa.array([own] * len(asked), pa.int32()),
            "words": pa.array([k[1] for k in asked], pa.binary()),
            "dids": pa.array([[d for d, _ in v] for v in asked.values()], pa.list_(pa.int64())),
            "starts": pa.array([[a for _, a in v] for v in asked.values()], pa.list_(pa.int32())),
        })

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        """The factors of the stretches that a reference block is asked for."""
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            me, block = left.column("block")[0].as_py(), Block(left, window)
            reference, ids = Reference(block), block.doc_id.to_pylist()
            begin = {did: int(e) - n for did, e, n in zip(reversed(block.did), reference.ends[::-1], reversed(block.sizes), strict=True)}
            for asking, words, dids, starts in zip(*(right.column(c).to_pylist() for c in ("block", "words", "dids", "starts")), strict=True):
                words = words.split()
                # Asked by itself, a block passes over the stretch's own place, so each place is parsed for itself.
                groups = [([d], [a], begin[d] + a) for d, a in zip(dids, starts, strict=True)] if asking == me else [(dids, starts, None)]
                for dids_, starts_, own in groups:
                    found = list(reference.factors(words, own))
                    out += [(asking, d, a + i, n, ids[doc], word, me) for d, a in zip(dids_, starts_, strict=True) for i, n, doc, word in found]
        columns = list(zip(*out, strict=True)) if out else [[]] * len(factor_schema)
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, factor_schema, strict=True)], schema=factor_schema)

    def factor(left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block(left, window, hashed=False)
        spans: dict[int, list[dict]] = {}
        for row in right.select(["did", "start", "length", "ref_block", "ref_doc_id", "ref_start"]).to_pylist():
            spans.setdefault(row.pop("did"), []).append(row)
        rows = [_kept(w, spans.get(d, []), with_text) for d, w in zip(block.did, block.words, strict=True)]
        n, gone, sha, chosen, text = zip(*rows, strict=True) if rows else [[]] * 5
        return pa.table({
            "doc_id": block.doc_id, "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()),
            "kept_sha256": pa.array(sha, pa.string()), "spans": pa.array(chosen, span_type), "kept_text": pa.array(text, pa.string()),
        })

    int32, int64 = pa.int32(), pa.int64()
    span_type = pa.list_(pa.struct([("start", int32), ("length", int32), ("ref_doc_id", int64), ("ref_start", int32), ("ref_block", int32)]))
    factor_schema = pa.schema([("block", int32), ("did", int64), ("start", int32), ("length", int32), ("ref_doc_id", int64), ("ref_start", int32), ("ref_block", int32)])
    by_block = dealt.groupBy("block")
    by_range = by_block.applyInArrow(index, "range int, block int, hashes binary, twice binary")
    found = by_range.groupBy("range").applyInArrow(meet, "block int, range int, found binary, refs binary")
    asked = by_block.cogroup(found.groupBy("block")).applyInArrow(ask, "to int, block int, words binary, dids array<long>, starts array<int>")
    factors = by_block.cogroup(asked.groupBy("to")).applyInArrow(answer, FACTORS)
    return by_block.cogroup(factors.groupBy("block")).applyInArrow(factor, RESULT)


def _kept(words: list[bytes], factors: list[dict], with_text: bool) -> tuple:
    """One document's row but for its id; factors: those found in all blocks."""
    factors.sort(key=lambda f: (f["start"], f["ref_block"], f["ref_start"], -f["length"]))
    gone, chosen, end, k = np.zeros(len(words), dtype=bool), [], 0, 0
    while k < len(factors):
        # Of the factors that begin at the last one's end or before it, else at the next place, the one that reaches furthest.
        edge, best = max(end, factors[k]["start"]), None
        while k < len(factors) and factors[k]["start"] <= edge:
            if best is None or factors[k]["start"] + factors[k]["length"] > best["start"] + best["length"]:
                best = factors[k]
            k += 1
        stop = best["start"] + best["length"]
        if stop > end:
            chosen.append(best)
            gone[best["start"] : stop] = True
            end = stop
    kept = [words[i] for i in np.flatnonzero(~gone)] if chosen else words
    text = b" ".join(kept)
    return len(words), int(gone.sum()), hashlib.sha256(text).hexdigest(), chosen, text.decode("utf-8", "replace") if with_text else None
