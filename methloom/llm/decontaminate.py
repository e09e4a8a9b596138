"""Benchmark passages in documents, by SimHash of item-sized windows.

For each benchmark item, a document's windows of the item's length are compared by the SimHash of
their word shingles: fingerprints are cut into radius + 1 blocks, and two of them within the radius
agree in some block, so looking up each block finds them all. What is found is verified exactly by
the weighted Jaccard similarity of the shingles (weights: how often a shingle occurs). A window
that shares no shingle with an item has similarity 0, so only windows over a shared shingle are
fingerprinted, and compared with the items that have one of the shingles that are shared there; that
loses nothing, and at a wide radius, where a block has few bits, it is what keeps the lists short.

The items' index goes to every task, in parts of ``part_bytes`` of text; a larger benchmark is
several parts and so several passes over the documents.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, pieces, rolling, without
from .licenses import words_of

SHINGLE = 5
MATCH = "doc_id long, tid long, item_id long, start int, n_words int, similarity double"


def simhash(shingles: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of ``size`` shingle hashes in a row from each start."""
    bits = np.unpackbits(shingles.astype(">u8").view(np.uint8)).reshape(-1, 64)
    sums = np.zeros((len(bits) + 1, 64), dtype=np.int32)
    np.cumsum(bits, axis=0, out=sums[1:])
    return np.packbits((sums[starts + size] - sums[starts]) * 2 > size, axis=1).view(">u8").ravel().astype(np.uint64)


def within(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i, j) with a[i] and b[j] at ``radius`` bits or fewer, by blocks of the index."""
    edges = np.linspace(0, 64, radius + 2).astype(int)
    found = []
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        mask = np.uint64((1 << int(hi - lo)) - 1)
        x, y = a >> np.uint64(lo) & mask, b >> np.uint64(lo) & mask
        order = np.argsort(y, kind="stable")
        left, right = np.searchsorted(y[order], x, "left"), np.searchsorted(y[order], x, "right")
        i = np.repeat(np.arange(len(a)), right - left)
        j = order[np.arange(len(i)) - np.repeat(np.cumsum(right - left) - (right - left), right - left) + left[i]]
        near = np.bitwise_count(a[i] ^ b[j]) <= radius
        found.append(i[near] * len(b) + j[near])
    pairs = np.unique(np.concatenate(found))
    return pairs // len(b), pairs % len(b)


def similarity(a: list[bytes], b: list[bytes], size: int) -> float:
    """Weighted Jaccard similarity of two word sequences' shingles."""
    x, y = (Counter(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) for w in (a, b))
    return (x & y).total() / (x | y).total()


class Index:
    """The items of one part: by shingle size, the shingles and, by length, the items."""

    def __init__(self, items: list[tuple[int, list[bytes]]], shingle: int):
        seen, self.items, self.sizes = WordHashes(), items, {}
        self.lengths: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        by_length: dict[int, list[int]] = {}
        for k, (_, words) in enumerate(items):
            by_length.setdefault(len(words), []).append(k)
        for n, own in by_length.items():
            size = min(shingle, n)
            grams = [rolling(seen.of(items[k][1]), size) for k in own]
            fps = np.concatenate([simhash(g, np.array([0]), len(g)) for g in grams])
            self.lengths[n] = (np.array(own), fps)
            # Shingles of the items of one length, sorted, and which of the items has each.
            of, flat = np.repeat(np.arange(len(own)), [len(g) for g in grams]), np.concatenate(grams)
            order = np.argsort(flat, kind="stable")
            self.sizes.setdefault(size, {}).update({n: (flat[order], of[order])})
        self.all = {size: np.unique(np.concatenate([flat for flat, _ in by.values()])) for size, by in self.sizes.items()}

    def matches(self, words: list[bytes], hashes: np.ndarray, radius: int, least: float):
        """(item, start, words, similarity) of each window that is found and verified."""
        for size, by_length in self.sizes.items():
            grams = rolling(hashes, size)
            table = self.all[size]
            if not len(grams):
                continue
            at = np.minimum(np.searchsorted(table, grams), len(table) - 1)
            hits = np.flatnonzero(table[at] == grams)
            if not len(hits):
                continue
            for n, (own, of) in by_length.items():
                here = hits[np.isin(grams[hits], own)]
                if not len(here):
                    continue
                n_here = min(n, len(words))
                most = len(words) - n_here
                first, last = np.maximum(here - (n_here - size), 0), np.minimum(here, most)
                marks = np.zeros(most + 2, dtype=np.int64)
                np.add.at(marks, first[first <= last], 1)
                np.add.at(marks, last[first <= last] + 1, -1)
                starts = np.flatnonzero(np.cumsum(marks)[: most + 1] > 0)
                for a in range(0, len(starts), 1024):
                    part = starts[a : a + 1024]
                    shared = np.unique(grams[here[(here >= part[0]) & (here <= part[-1] + n_here - size)]])
                    low, high = np.searchsorted(own, shared, "left"), np.searchsorted(own, shared, "right")
                    items = np.unique(np.concatenate([of[x:y] for x, y in zip(low, high, strict=True)] or [of[:0]]))
                    for z in range(0, len(items), 4096):
                        yield from self._verified(words, grams, part, items[z : z + 4096], n, n_here, size, radius, least)

    def _verified(self, words, grams, starts, items, n, n_here, size, radius, least):
        places = np.unique((starts[:, None] + np.arange(n_here - size + 1)[None, :]).ravel())
        local = np.searchsorted(places, starts)  # windows are whole runs, so they stay runs
        own, fps = (x[items] for x in self.lengths[n])
        i, j = within(simhash(grams[places], local, n_here - size + 1), fps, radius)
        for s, k in zip(starts[i].tolist(), own[j].tolist(), strict=True):
            sim = similarity(words[s : s + n_here], self.items[k][1], size)
            if sim >= least:
                yield self.items[k][0], s, n_here, sim


def contaminated(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, radius: int = 20, least: float = 0.8,
                 part_bytes: int = 32 << 20) -> DataFrame:
    """One row a document and item found in it: doc_id, item_id, start, n_words, similarity (of the
    best window; the first of equal ones).

    Words are runs of letters and digits (A-Z lower-cased) and of non-ASCII characters. An item of
    fewer than ``shingle`` words is one shingle; items and texts that are null or without words match
    nothing; a text shorter than an item is one window, texts of any length are searched whole. Equal
    items are found each, rows equal in doc_id count as one document, null ids are kept as null; other
    columns are ignored."""
    best = F.min_by(F.struct("start", "n_words", "similarity"), F.struct(-F.col("similarity"), "start")).alias("best")
    found = _found(docs, benchmark, shingle, radius, least, part_bytes).groupBy("doc_id", "item_id").agg(best)
    return found.select("doc_id", "item_id", "best.start", "best.n_words", "best.similarity")


def _found(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, radius: int = 20, least: float = 0.8,
           part_bytes: int = 32 << 20) -> DataFrame:
    """One row (MATCH) for each row of ``docs`` and item found in it; tid is the hash of the row's text."""
    items = benchmark.select(F.col("item_id"), F.col("text").cast("binary").alias("text"))
    n_bytes = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_parts = 1 + n_bytes // part_bytes
    text = docs.select("doc_id", F.xxhash64("text").alias("tid"), F.col("text").cast("binary").alias("text"))
    found = None
    for part in range(n_parts):
        chosen = items if n_parts == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_parts)) == part)
        rows = [(r["item_id"], w) for r in chosen.toLocalIterator() if (w := words_of(bytes(r["text"] or b"")))]
        if not rows:
            continue
        shared = docs.sparkSession.sparkContext.broadcast(Index(rows, shingle))

        def run(batches, shared=shared):
            index, seen = shared.value, WordHashes()
            for b in pieces(batches, "text"):
                out = []
                for doc_id, tid, t in zip(*(b.column(c).to_pylist() for c in ("doc_id", "tid", "text")), strict=True):
                    words = words_of(t)
                    best: dict[int, tuple] = {}
                    for item, start, n, sim in index.matches(words, seen.of(words), radius, least):
                        if item not in best or (-sim, start) < (-best[item][3], best[item][1]):
                            best[item] = (item, start, n, sim)
                    out += [(doc_id, tid, *x) for x in best.values()]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()]
        names = ["doc_id", "tid", "item_id", "start", "n_words", "similarity"]
        got = text.mapInArrow(run, MATCH)
        found = got if found is None else found.unionByName(got)
    if found is None:
        return docs.sparkSession.createDataFrame([], MATCH)
    return found


def clean(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """``docs`` without those in which an item is found; rows equal in doc_id are one document."""
    bad = contaminated(docs, benchmark, **parameters).select("doc_id").distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["doc_id"]), "left_anti")


def clean_rows(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """``docs`` without the rows in which an item is found: a row goes for its own text, so clean rows
    of the same doc_id, or of none, stay."""
    return without(docs, _found(docs, benchmark, **parameters))
