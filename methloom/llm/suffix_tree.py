"""A probabilistic suffix tree over words, learned and applied where its branches lie.

A context is the run of up to ``depth`` words before a token (before a text's start stands a mark).
The tree is cut at its first edges: all tokens after contexts that end in one word are dealt to one
part, which so has every deeper context of the branch with all its counts, learns the branch and
scores the branch's tokens at once. Every context and next word of the corpus takes part, however
rare; nothing of the tree is sent anywhere. A context is a state if it occurs ``least`` times and its
next-symbol distribution diverges from what the longest shorter state says: the log-likelihood gained
(count times Kullback-Leibler divergence) exceeds ``gain`` for each next symbol seen (Ron, Singer and
Tishby 1996, with absolute counts). A state's distribution is smoothed with the shorter state's by the
number of symbols seen (Witten and Bell), so it sums to one; a token is scored by its longest state.

A branch may be too large for a part. Contexts that occur more than ``part_tokens`` times are the
*head*. They are learned by joins and aggregates over all of their next words; their number, how many kinds
of next word each has and whether it is a state go to all tasks, with the next words that take ``p_min`` of the
corpus or more (at most 1/p_min a level). Tokens of the head are dealt by one more word. What the head says of a token
that is not listed so is asked: the texts send each such (context, next word) once a piece to a part of its own,
which has all of its counts and tells the parts that need it. So the size of a part decides
where a token is scored and never how.

Tokens travel in packed arrays, some ten bytes each, once: from the texts to the parts. Parts answer with
one number a document (and the counts of rare words, which a word's own part knows).
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BASE, discard, mixed, pieces, written

#: The end of a text: no word holds a line feed.
END = b"\n"
#: Bytes of text that a task works on at once.
PIECE = 6 << 20
#: Codes: 0 is the mark before a text's start, 1, 2, ... the common words by falling count; rare words
#: have this bit and a hash.
RARE = 1 << 31
ROW = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def held_out(doc_id: int | None, folds: int = 10, fold: int = 0) -> bool:
    """A null doc_id is not held out."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == fold


def in_training(folds: int, fold: int) -> Column:
    """The rows that are not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != fold, F.lit(True))


def word_hash(word: bytes) -> int:
    """As Spark's xxhash64 of the word."""
    return xxhash.xxh64_intdigest(word, 42)


def _looked_up(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Index of each value in a sorted array, -1 if it is not there."""
    if not len(table):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, at, -1)


def _packed_runs(cuts: np.ndarray, *arrays: np.ndarray) -> list[bytes]:
    """Each run of arrays of one length, by planes of bytes, compressed."""
    planes = np.concatenate([np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T for a in arrays])
    compress = zstandard.ZstdCompressor(level=1).compress
    return [compress(planes[:, a:z].tobytes()) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]


def _packed(*arrays: np.ndarray) -> bytes:
    return _packed_runs(np.array([0, len(arrays[0])]), *arrays)[0]


def _unpacked(blob: bytes, *types) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = len(data) // sum(np.dtype(t).itemsize for t in types), 0, []
    for t in types:
        size = np.dtype(t).itemsize
        plane = np.frombuffer(data, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(plane.T).view(t).ravel())
        at += n * size
    return out


#: Bytes as tokens have them, and which of them words are made of.
LOWER, WORD = np.arange(256, dtype=np.uint8), np.ones(256, dtype=bool)
LOWER[65:91] += 32
WORD[[9, 10, 11, 12, 13, 32]] = False


def _placed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, and where each value starts and the last ends."""
    offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts (binary, null: none), A-Z lower-cased, end to end, and their number in each text."""
    data, offsets = _placed(pc.fill_null(texts, b""))
    inside = WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = offsets[:-1][offsets[:-1] < len(data)]
    first[starts] = inside[starts]
    counts = np.diff(np.searchsorted(np.flatnonzero(first), offsets))
    kept = LOWER[data[inside]]
    places = np.append(np.flatnonzero(first[inside]), len(kept)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(places) - 1, [None, pa.py_buffer(places), pa.py_buffer(kept)]), counts


def _turned(h: np.ndarray, by: int) -> np.ndarray:
    return h << np.uint64(by) | h >> np.uint64(64 - by)


def word_hashes(words: pa.Array) -> np.ndarray:
    """``word_hash`` of each word, those below 32 bytes by lanes of all words at once."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    data, offsets = _placed(words)
    data = np.append(data, np.zeros(8, dtype=np.uint8))
    start, size = offsets[:-1], np.diff(offsets)
    lanes = {width: np.ndarray(len(data) - 7, f"<u{width}", data, strides=(1,)) for width in (8, 4, 1)}
    at_lane = lambda width, places: lanes[width][places].astype(np.uint64)
    h = np.uint64(42) + p5 + size.astype(np.uint64)
    for i in range(3):
        at = np.flatnonzero((size >= 8 * i + 8) & (size < 32))
        h[at] = _turned(h[at] ^ _turned(at_lane(8, start[at] + 8 * i) * p2, 31) * p1, 27) * p1 + p4
    at = np.flatnonzero(size & 4)
    h[at] = _turned(h[at] ^ at_lane(4, start[at] + (size[at] & ~7)) * p1, 23) * p2 + p3
    for i in range(3):
        at = np.flatnonzero((size & 3) > i)
        h[at] = _turned(h[at] ^ at_lane(1, start[at] + (size[at] & ~3) + i) * p5, 11) * p1
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    h ^= h >> np.uint64(32)
    for i in np.flatnonzero(size >= 32):
        h[i] = word_hash(data[offsets[i] : offsets[i + 1]].tobytes())
    return h


class Codes:
    """Codes of words: ``words`` are the common words' hashes, sorted, with their ranks."""

    def __init__(self, words: np.ndarray, ranks: np.ndarray):
        self.words, self.ranks = words, ranks

    def coded(self, h: np.ndarray) -> np.ndarray:
        at = _looked_up(self.words, h)
        # A rare word's code keeps its whole hash: the upper half is dropped where identity need not be exact.
        rare = h & np.uint64(0xFFFFFFFF7FFFFFFF) | np.uint64(RARE)
        return np.where(at >= 0, self.ranks[at] if len(self.ranks) else 0, rare).astype(np.uint64)

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the texts' words with an end each, end to end, and their number in each text. Each word
        of the batch is looked up once."""
        words, counts = split_words(texts)
        words, lengths = words.dictionary_encode(), counts + 1
        ends = np.cumsum(lengths) - 1
        out = np.full(int(lengths.sum()), self.coded(np.array([word_hash(END)], dtype=np.uint64))[0])
        inside = np.ones(len(out), dtype=bool)
        inside[ends] = False
        out[inside] = self.coded(word_hashes(words.dictionary))[np.asarray(words.indices)]
        return out, lengths


@dataclass
class Model:
    """What all tasks know: common words, totals, and the head's levels (sorted contexts, whether each is a
    state, the log of what its listed entries leave to others, sorted context index << 32 | symbol of its listed
    entries, their log probability, how many tokens and how many kinds of them follow it)."""

    words: np.ndarray
    ranks: np.ndarray
    counts: np.ndarray  # by code
    total: int
    distinct: int
    depth: int
    least: int
    gain: float
    levels: list[tuple] = field(default_factory=list)

    @property
    def whole(self) -> float:
        return self.total + 0.1 * (self.distinct + 1)

    def root(self, code: np.ndarray) -> np.ndarray:
        """Log probability without context. Rare words share alike, with any unseen one, what the common ones leave."""
        n_rare = self.distinct - (len(self.counts) - 1) + 1
        rare = (self.total - int(self.counts.sum()) + 0.1 * n_rare) / self.whole / n_rare
        table = np.log(np.append((self.counts + 0.1) / self.whole, rare))
        return table[np.where(code >= RARE, len(self.counts), code)]

    @staticmethod
    def context(words: list[np.ndarray]) -> np.ndarray:
        """Key of a context in the head: codes of 20 bits, the last word first."""
        key = np.zeros(len(words[0]), dtype=np.int64)
        for w in words:
            key = key << 20 | np.minimum(w, (1 << 20) - 1).astype(np.int64)
        return key

    def in_head(self, words: list[np.ndarray]) -> np.ndarray:
        """How many levels of each token's context are in the head."""
        out = np.zeros(len(words[0]), dtype=np.int64)
        for k, level in enumerate(self.levels, 1):
            at = np.flatnonzero(out == k - 1)
            small = np.logical_and.reduce([w[at] < 1 << 20 for w in words[:k]])
            at = at[small]
            out[at[_looked_up(level[0], self.context([w[at] for w in words[:k]])) >= 0]] = k
        return out

    def head(self, words: list[np.ndarray], symbol: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each token after its first ``levels`` levels, which are in the head, and the first level
        that does not list it (0: all do, and the probability is exact; else it shares alike what the listed ones leave)."""
        out, first = self.root(symbol), np.zeros(len(symbol), dtype=np.uint8)
        for k, (contexts, is_state, rest, entries, logs, _, _) in enumerate(self.levels, 1):
            at = np.flatnonzero(levels >= k)
            state = _looked_up(contexts, self.context([w[at] for w in words[:k]]))
            at, state = at[is_state[state]], state[is_state[state]]
            entry = _looked_up(entries, state << 32 | np.minimum(symbol[at], RARE).astype(np.int64))
            out[at] = np.where(entry >= 0, logs[entry] if len(logs) else 0.0, out[at] + rest[state])
            new = at[entry < 0]
            first[new] = np.where(first[new] == 0, k, first[new])
        return out, first

    def head_log(self, words: list[np.ndarray], symbol: np.ndarray, levels: np.ndarray) -> np.ndarray:
        return self.head(words, symbol, levels)[0]

    def told(self, words: list[np.ndarray], symbol: np.ndarray, levels: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Exact log probability of tokens that level ``first`` does not list, after ``levels`` levels; the tokens hold,
        with their counts in training, all there are of each (context of that level, symbol)."""
        log = self.head_log(words, symbol, first - 1)
        for k, (contexts, is_state, _, _, _, totals, kinds) in enumerate(self.levels, 1):
            at = np.flatnonzero((first <= k) & (levels >= k))
            state = _looked_up(contexts, self.context([w[at] for w in words[:k]]))
            at, state = at[is_state[state]], state[is_state[state]]
            _, gram = np.unique(_gram([w[at] for w in words], symbol[at], np.full(len(at), k)), return_inverse=True)
            c = np.bincount(gram, count[at])[gram] if len(at) else np.empty(0)
            log[at] = np.log((c + kinds[state] * np.exp(log[at])) / (totals[state] + kinds[state]))
        return log

    def add_level(self, contexts: np.ndarray, is_state: np.ndarray, totals: np.ndarray, kinds: np.ndarray, at: np.ndarray, symbol: np.ndarray, lower: np.ndarray, logs: np.ndarray) -> None:
        """contexts (sorted), and the listed entries: context index, symbol, log probability without and with this level."""
        left = 1 - np.bincount(at, np.exp(logs), len(contexts))
        below = 1 - np.bincount(at, np.exp(lower), len(contexts))
        code = at.astype(np.int64) << 32 | symbol.astype(np.int64)
        order = np.argsort(code)
        self.levels.append((contexts, is_state, np.log(np.maximum(left, 1e-12) / np.maximum(below, 1e-12)), code[order], logs[order], totals, kinds))


def _gram(words: list[np.ndarray], symbol: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Key of each token with its first ``levels`` words before, which are in the head."""
    low, key = np.uint64(0xFFFFFFFF), np.zeros(len(symbol), dtype=np.uint64)
    for k, w in enumerate(words, 1):
        at = np.flatnonzero(levels >= k)
        key[at] = mixed(key[at] * np.uint64(BASE) + w[at].astype(np.uint64) + np.uint64(k))
    return mixed(key ^ ((symbol.astype(np.uint64) & low) * np.uint64(BASE)))


def _part(words: list[np.ndarray], symbol: np.ndarray, levels: np.ndarray, n_parts: int) -> np.ndarray:
    """The part of each token: of the first words before it that are not in the head; where all are, of them and itself."""
    key, low = words[0].copy(), np.uint64(0xFFFFFFFF)
    for k in range(1, len(words) + 1):
        at = np.flatnonzero(levels >= k)
        key[at] = mixed(key[at] * np.uint64(BASE) + (words[k][at] if k < len(words) else symbol[at] & low) + np.uint64(k))
    return (mixed(key * np.uint64(BASE) + np.uint64(7)) % np.uint64(n_parts)).astype(np.uint16 if n_parts < 1 << 16 else np.uint32)


def learn_head(docs: DataFrame, folds: int, fold: int, depth: int, least: int, gain: float, p_min: float, part_tokens: int) -> Model:
    """Common words (``p_min`` of the training tokens or more) and the contexts too large for a part."""
    training = docs.where(in_training(folds, fold)).select("text")
    lower = F.translate(F.coalesce("text", F.lit("")), ascii_uppercase, ascii_lowercase)
    words = F.concat(F.split(lower, r"[\x20\x09-\x0D]+"), F.array(F.lit(END.decode())))
    each = training.select(F.explode(words).alias("word")).where("word <> ''").select(F.xxhash64("word").alias("w"))
    vocabulary = written(each.groupBy("w").agg(F.count("*").alias("c")))
    total, distinct = vocabulary.agg(F.sum("c"), F.count("*")).first()
    total = total or 0
    end = word_hash(END)
    is_end = F.col("w") == int(np.uint64(end).view(np.int64))
    common = vocabulary.where((F.col("c") >= p_min * total) | is_end).toPandas()  # at most 1 / p_min rows and one
    discard(vocabulary)
    words, counts = common["w"].to_numpy(np.int64).view(np.uint64), common["c"].to_numpy(np.int64)
    order = np.lexsort((words, -counts))
    by_hash = np.argsort(words[order])
    model = Model(words[order][by_hash], (by_hash + 1).astype(np.int64), np.concatenate([[0], counts[order]]), total, distinct, depth, least, gain)
    floor = max(part_tokens, total >> 16)
    hot = int((counts >= floor).sum())  # words of the head's contexts: codes up to this, and the mark
    n_texts = int(counts[words == np.uint64(end)].sum())
    if not hot and n_texts < floor:
        return model
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def grams(batches):
        model = shared.value
        codes = Codes(model.words, model.ranks)
        for b in pieces(batches, "text", PIECE):
            symbol, words, _ = _sequence(b.column("text"), codes, model.depth)
            symbol, inside = symbol & np.uint64(0xFFFFFFFF), np.arange(len(symbol))
            for k in range(1, model.depth + 1):
                inside = inside[words[k - 1][inside] <= hot]
                own = [w[inside] for w in words[:k]]
                context = Model.context(own)
                key, first, inverse = np.unique(mixed(context.view(np.uint64) * np.uint64(BASE) + symbol[inside]), return_index=True, return_inverse=True)
                rows = [np.full(len(key), k, np.int32), context[first], symbol[inside][first].astype(np.int64), np.bincount(inverse, minlength=len(key))]
                yield pa.RecordBatch.from_arrays([pa.array(r) for r in rows], names=["level", "context", "symbol", "c"])

    text = training.select(F.col("text").cast("binary").alias("text"))
    table = written(text.mapInArrow(grams, "level int, context long, symbol long, c long").groupBy("level", "context", "symbol").agg(F.sum("c").alias("c")))
    sums = table.groupBy("level", "context").agg(F.sum("c").alias("n")).where(F.col("n") >= floor)

    def rooted(batches):
        for b in batches:
            lower = shared.value.root(np.asarray(b.column("symbol")).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lower)], names=[*b.schema.names, "lower"])

    said, spare = None, [table]
    for k in range(1, depth + 1):
        own = table.where(F.col("level") == k).join(F.broadcast(sums.where(F.col("level") == k).drop("level")), "context").select("context", "symbol", "c", "n")
        if said is None:
            own = own.mapInArrow(rooted, "context long, symbol long, c long, n long, lower double")
        else:
            shorter = said.select(F.col("context").alias("shorter"), F.col("symbol").alias("_symbol"), F.col("log").alias("lower"))
            own = own.join(shorter, (F.shiftright("context", 20) == F.col("shorter")) & (F.col("symbol") == F.col("_symbol"))).select("context", "symbol", "c", "n", "lower")
        own = written(own)
        won = F.sum(F.col("c") * (F.log(F.col("c") / F.col("n")) - F.col("lower")))
        found = own.groupBy("context").agg(F.first("n").alias("total"), F.count("*").alias("kinds"), won.alias("won"))
        states = written(found.withColumn("is_state", (F.col("total") >= least) & (F.col("won") > gain * F.col("kinds"))))
        spare += [own, states]
        contexts = states.toPandas().sort_values("context")  # at most 2**16 rows a level
        if not len(contexts):
            break
        kinds, lower = F.col("kinds"), F.col("lower")
        log = F.when(F.col("is_state"), F.log((F.col("c") + kinds * F.exp(lower)) / (F.col("n") + kinds))).otherwise(lower)
        said = own.join(F.broadcast(states.select("context", "kinds", "is_state")), "context").withColumn("log", log)
        mine = said.where(F.col("is_state") & (F.col("symbol") < RARE) & (F.col("c") >= p_min * total)).select("context", "symbol", "lower", "log").toPandas()  # at most 1 / p_min rows
        keys = contexts["context"].to_numpy(np.int64)
        stats = (contexts["is_state"].to_numpy(bool), contexts["total"].to_numpy(np.int64), contexts["kinds"].to_numpy(np.int64))
        at = _looked_up(keys, mine["context"].to_numpy(np.int64))
        model.add_level(keys, *stats, at, mine["symbol"].to_numpy(np.int64), mine["lower"].to_numpy(float), mine["log"].to_numpy(float))
    for df in spare:
        discard(df)
    return model


def _cuts(sorted_: np.ndarray) -> np.ndarray:
    """Where the runs of equal values start, and the end."""
    return np.concatenate([[0], np.flatnonzero(np.diff(sorted_)) + 1, [len(sorted_)]]) if len(sorted_) else np.array([0])


def _sequence(texts: pa.Array, codes: Codes, depth: int):
    """Code of each token, of the 1st, 2nd, ... word before it, and the texts' lengths in tokens."""
    code, lengths = codes.of(texts)
    place = np.arange(len(code)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    words = []
    for k in range(1, depth + 1):
        word = np.zeros(len(code), dtype=np.uint64)
        inside = np.flatnonzero(place >= k)
        word[inside] = code[inside - k]
        words.append(word)
    return code, words, lengths


def _part_logs(model: Model, words: list[np.ndarray], symbol: np.ndarray, train: np.ndarray, keys: np.ndarray, told: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of each token of a part, and how often its first context word was seen in training. What the
    head says of tokens that it does not list is ``told`` by sorted ``keys``."""
    levels = model.in_head(words)
    log, first = model.head(words, symbol, levels)
    asked = np.flatnonzero(first)
    if len(asked):
        at = _looked_up(keys, _gram([w[asked] for w in words], symbol[asked], levels[asked]))
        if (at < 0).any():
            raise ValueError("a token of the head was not told")
        log[asked] = told[at]
    context, seen = np.zeros(len(symbol), dtype=np.uint64), np.zeros(len(symbol), dtype=np.uint32)
    lasting = np.ones(len(symbol), dtype=bool)
    for k in range(1, model.depth + 1):
        context = mixed(context * np.uint64(BASE) + words[k - 1] + np.uint64(k))
        at = np.flatnonzero(lasting & (levels < k))
        if not len(at):
            continue
        of = np.asarray(pa.array(context[at]).dictionary_encode().indices)
        n = np.bincount(of, train[at]).astype(np.int64)
        if k == 1:
            seen[at] = n.astype(np.uint32)[of]
        # A context that is too rare for a state has only such ones below it.
        enough = n[of] >= model.least
        lasting[at[~enough]] = False
        at, of = at[enough], of[enough]
        if not len(at):
            continue
        _, first, gram = np.unique(mixed(context[at] ^ (symbol[at].astype(np.uint64) * np.uint64(BASE))), return_index=True, return_inverse=True)
        count = np.bincount(gram, train[at], len(first)).astype(np.int64)
        of = of[first]
        kinds = np.bincount(of, count > 0, len(n))
        lower = log[at][first]
        some = np.flatnonzero(count)
        won = np.bincount(of[some], count[some] * (np.log(count[some] / n[of[some]]) - lower[some]), len(n))
        is_state = (n >= model.least) & (won > model.gain * kinds)
        own = np.flatnonzero(is_state[of])
        lower[own] = np.log((count[own] + kinds[of[own]] * np.exp(lower[own])) / (n[of[own]] + kinds[of[own]]))
        log[at] = lower[gram]
    return log, seen


def scores(docs: DataFrame, folds: int = 10, fold: int = 0, depth: int = 3, least: int = 2, gain: float = 1.0, p_min: float = 1e-6,
           part_tokens: int = 750_000) -> DataFrame:
    """One row a row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null and empty texts are one end token; texts of any length count whole. Repeated rows are scored
    each (and train each); a null doc_id is not held out. With no training text every token has
    probability 1/(0.1 * 1) of the smoothed base, as the formula gives. Ties do not arise: scores are
    sums. Other columns are ignored; an empty table gives no rows."""
    if depth < 1 or p_min < 1e-6:
        raise ValueError("a context has a word, and a common word is one in a million")
    model = learn_head(docs, folds, fold, depth, least, gain, p_min, part_tokens)
    text = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    n_parts = max(8, -(-model.total // part_tokens))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    ask_types, told_types = (np.uint8, np.uint8) + (np.uint32,) * (depth + 3), (np.uint64, np.float64)
    home_types, sent_types, back_types = (np.int64, np.int64, np.int64, np.float64, np.float64), (np.uint32, np.uint8) + (np.uint32,) * (depth + 2), (np.uint32, np.float32)

    def ask(batches):
        """(entry, blob): the distinct tokens of a piece that the head does not list, with their count in training and
        the parts that need them. All of one (context, symbol) are of one entry."""
        model = shared.value
        codes = Codes(model.words, model.ranks)
        for b in pieces(batches, "text", PIECE):
            held = [held_out(i, folds, fold) for i in b.column("doc_id").to_pylist()]
            symbol, words, lengths = _sequence(b.column("text"), codes, model.depth)
            levels = model.in_head(words)
            at = np.flatnonzero(levels)
            first = model.head([w[at] for w in words], symbol[at], levels[at])[1]
            at, first = at[first > 0], first[first > 0]
            symbol, levels, words = symbol[at], levels[at], [w[at] for w in words]
            part = _part(words, symbol, levels, n_parts).astype(np.uint32)
            key = _gram(words, symbol, levels) + part * np.uint64(BASE)
            _, one, gram = np.unique(key, return_index=True, return_inverse=True)
            count = np.bincount(gram, ~np.repeat(np.array(held, dtype=bool), lengths)[at], len(one))
            # Words beyond the head do not tell tokens apart.
            words = [np.where(levels[one] >= k, w[one], 0) for k, w in enumerate(words, 1)]
            entry = (_gram(words, symbol[one], first[one]) % np.uint64(n_parts)).astype(np.uint32)
            order = np.argsort(entry, kind="stable")
            arrays = [levels[one].astype(np.uint8), first[one], *(x.astype(np.uint32) for x in (part[one], count, *words, symbol[one]))]
            cuts = _cuts(entry[order])
            blobs = _packed_runs(cuts, *(x[order] for x in arrays))
            yield pa.RecordBatch.from_arrays([pa.array(entry[order[cuts[:-1]]] if len(order) else [], pa.int64()), pa.array(blobs, pa.binary())], names=["entry", "blob"])

    def answer(t: pa.Table) -> pa.Table:
        """What the head says of an entry's tokens, for each part (piece -1)."""
        levels, first, part, count, *words, symbol = (np.concatenate(x) for x in zip(*(_unpacked(x, *ask_types) for x in t.column("blob").to_pylist()), strict=True))
        log = shared.value.told(words, symbol, levels, first, count)
        key = _gram(words, symbol, levels)
        order = np.lexsort((key, part))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (np.diff(part[order]) != 0) | (np.diff(key[order]) != 0)
        order = order[new]
        cuts = _cuts(part[order])
        blobs = _packed_runs(cuts, key[order], log[order])
        none = pa.ListArray.from_arrays(pa.array([0] * (len(blobs) + 1), pa.int32()), pa.array([], pa.int64()))
        return pa.table({"part": pa.array(part[order[cuts[:-1]]].astype(np.int32)), "piece": pa.array([-1] * len(blobs), pa.int64()), "blob": pa.array(blobs, pa.binary()), "ids": none})

    def deal(batches):
        """(part, piece, blob) of the tokens that meet in a part, and each piece's documents (part -1)."""
        model, piece = shared.value, TaskContext.get().partitionId() << 32
        codes = Codes(model.words, model.ranks)
        known_log = np.log10((model.counts + 0.1) / model.whole)
        for b in pieces(batches, "text", PIECE):
            held = [held_out(i, folds, fold) for i in b.column("doc_id").to_pylist()]
            symbol, words, lengths = _sequence(b.column("text"), codes, model.depth)
            starts, common = np.cumsum(lengths) - lengths, symbol < RARE
            base = np.where(common, known_log[np.where(common, symbol, 0)], 0.0)
            levels = model.in_head(words)
            whole = np.flatnonzero(levels == model.depth)
            head_log, first = model.head([w[whole] for w in words], symbol[whole], levels[whole])
            here = whole[first == 0]
            log = np.zeros(len(symbol))
            log[here] = head_log[first == 0] / np.log(10.0)
            of_doc = np.repeat(np.arange(len(lengths), dtype=np.uint32), lengths)
            part = _part(words, symbol, levels, n_parts)
            away = np.delete(np.arange(len(symbol)), here)
            order = away[np.argsort(part[away], kind="stable")]
            train = ~np.repeat(np.array(held, dtype=bool), lengths)
            low = [w.astype(np.uint32) for w in (*words, symbol)]
            high = (words[0] >> np.uint64(32)).astype(np.uint32)
            cuts = _cuts(part[order])
            parts, blobs = [-1], [_packed(*(np.asarray(x) for x in (
                np.array(held, dtype=np.int64), lengths.astype(np.int64), np.add.reduceat(common.astype(np.int64), starts),
                np.add.reduceat(base, starts), np.add.reduceat(log, starts))))]
            doc = of_doc[order]
            step = np.diff(doc, prepend=np.uint32(0))
            step[cuts[:-1]] = doc[cuts[:-1]]  # in each part from 0
            parts += part[order[cuts[:-1]]].tolist()
            blobs += _packed_runs(cuts, step, train[order].astype(np.uint8), high[order], *(x[order] for x in low))
            ids = [b.column("doc_id")] + [pa.nulls(0, pa.int64())] * (len(parts) - 1)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]), pa.int32()), pa.concat_arrays(ids))
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([piece] * len(parts), pa.int64()), pa.array(blobs, pa.binary()), ids], names=["part", "piece", "blob", "ids"])
            piece += 1

    def meet(t: pa.Table) -> pa.Table:
        """Learn a part's branches and score its tokens: one answer for each piece."""
        if t.column("part")[0].as_py() < 0:
            return t.select(["piece", "part", "blob", "ids"])  # a piece's own documents
        model = shared.value
        told = [_unpacked(x, *told_types) for x in t.filter(pc.less(t.column("piece"), 0)).column("blob").to_pylist()]
        keys, told = (np.concatenate([x[i] for x in told]) if told else np.empty(0, told_types[i]) for i in (0, 1))
        order = np.argsort(keys)
        keys, told = keys[order], told[order]
        t = t.filter(pc.greater_equal(t.column("piece"), 0))
        piece, blobs = t.column("piece").to_pylist(), t.column("blob").to_pylist()
        columns = [[] for _ in sent_types]
        for x in blobs:
            for own, got in zip(columns, _unpacked(x, *sent_types), strict=True):
                own.append(got)
        steps, train, high, *words, symbol = columns
        train, high, symbol = np.concatenate(train), np.concatenate(high), np.concatenate(symbol)
        words = [np.concatenate(w) for w in words]
        rare_word = words[0] >= RARE
        # The word before is known by its whole hash, if it is rare.
        words[0] = words[0] | high.astype(np.uint64) << np.uint64(32)
        log, seen = _part_logs(model, words, symbol, train, keys, told)
        base = np.where(rare_word, seen.astype(np.int64), -1)
        out, at = [], 0
        for step in steps:
            n = len(step)
            of = np.cumsum(step, dtype=np.uint32)
            docs_, inverse = np.unique(of, return_inverse=True)
            rare = np.flatnonzero(base[at : at + n] >= 0)
            sums = _packed(docs_, np.bincount(inverse, log[at : at + n] / np.log(10.0)).astype(np.float32))
            counts = _packed(of[rare], base[at : at + n][rare].astype(np.uint32))
            out.append(len(sums).to_bytes(8, "big") + sums + counts)
            at += n
        none = pa.ListArray.from_arrays(pa.array([0] * (len(out) + 1), pa.int32()), pa.array([], pa.int64()))
        return pa.table({"piece": pa.array(piece, pa.int64()), "part": t.column("part").cast(pa.int32()), "blob": pa.array(out, pa.binary()), "ids": none})

    def gather(t: pa.Table) -> pa.Table:
        """A piece's documents with the answers of all parts."""
        model, part = shared.value, np.asarray(t.column("part"))
        home = int(np.flatnonzero(part < 0)[0])
        blobs = t.column("blob").to_pylist()
        held, lengths, known, base, score = (x.copy() for x in _unpacked(blobs[home], *home_types))
        for i in np.argsort(part, kind="stable"):
            if i == home:
                continue
            size = int.from_bytes(blobs[i][:8], "big")
            docs_, sums = _unpacked(blobs[i][8 : 8 + size], *back_types)
            score[docs_] += sums
            docs_, counts = _unpacked(blobs[i][8 + size :], np.uint32, np.uint32)
            known += np.bincount(docs_, counts > 0, len(known)).astype(np.int64)
            base += np.bincount(docs_, np.log10((counts + 0.1) / model.whole), len(base))
        columns = [t.column("ids")[home].values, held.astype(bool), lengths, known, base, score]
        return pa.table([pa.array(c) for c in columns], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    sent = text.mapInArrow(deal, "part int, piece long, blob binary, ids array<long>")
    if model.levels:
        asked = text.mapInArrow(ask, "entry long, blob binary")
        sent = sent.union(asked.groupBy("entry").applyInArrow(answer, "part int, piece long, blob binary, ids array<long>"))
    spread = F.when(F.col("part") < 0, F.col("piece")).otherwise(F.lit(-1))
    back = sent.groupBy("part", spread.alias("own")).applyInArrow(meet, "piece long, part int, blob binary, ids array<long>")
    out = back.groupBy("piece").applyInArrow(gather, ROW)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
