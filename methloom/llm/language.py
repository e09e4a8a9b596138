"""Language identification by unigram pieces, with all segmentations summed.

The pieces are those of a fixed public vocabulary. A language gives each piece a probability; a
word's probability is the sum over all its segmentations of the product over pieces (the forward
algorithm), a text's the product over its words. Probabilities are learned by expectation
maximisation, the expected piece counts (forward-backward) summed by Spark; the model has one
number for each piece and language whatever the corpus's size.
"""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Numbers, pieces, without

UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
#: Mark of a word's beginning in the vocabulary (fixed value).
MARK = "▁"
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Characters of a word whose lattice is held at a time. A longer run without spaces goes part by part; the sums at
#: the last places, as many as the longest piece has characters, are carried on, so that no segmentation is lost.
TOGETHER = 4096


@cache
def vocabulary(path: str | None = None) -> tuple[str, ...]:
    """Pieces of a sentencepiece model without its control and byte pieces; the given file or the
    installed 32,000-piece one."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = str(public_tokenizers.path("piece_bpe_32k.model"))
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]
    return tuple(sorted({model.id_to_piece(i) for i in ids}))


def held_out(doc_id: int | None, folds: int = 4, fold: int = 2) -> bool:
    """A null doc_id is not held out."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == fold


class Pieces:
    """The vocabulary by rolling hash of its characters; id len(pieces) stands for a character that is no piece."""

    def __init__(self, names: tuple[str, ...]):
        keys = np.array([self._key(n) for n in names], dtype=np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], order
        self.longest = max(map(len, names))
        self.other = len(names)

    @staticmethod
    def _key(name: str) -> int:
        k = 0
        for c in name:
            k = (k * int(_STEP) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return k

    def lattice(self, words: list[str]):
        """Words as one matrix of characters with, for each end and length, the piece there (-1: none)."""
        width = max(map(len, words))
        chars = np.zeros((len(words), width), dtype=np.uint64)
        for i, w in enumerate(words):
            chars[i, : len(w)] = np.frombuffer(w.encode("utf-32-le", "replace"), dtype=np.uint32) + 1
        arcs = {}
        for start in range(width):
            key, live = np.zeros(len(words), dtype=np.uint64), np.ones(len(words), dtype=bool)
            for n in range(1, min(self.longest, width - start) + 1):
                live &= chars[:, start + n - 1] > 0
                rows = np.flatnonzero(live)
                if not len(rows):
                    break
                key[rows] = key[rows] * _STEP + chars[rows, start + n - 1]
                at = np.minimum(np.searchsorted(self.keys, key[rows]), len(self.keys) - 1)
                hit = self.keys[at] == key[rows]
                piece = self.ids[at]
                if n == 1:
                    arcs[start, 1] = (rows, np.where(hit, piece, self.other))
                elif hit.any():
                    arcs[start, n] = (rows[hit], piece[hit])
        return width, arcs


def _groups(words: list[str], rows: int = 20_000):
    """Indexes of words of like length, so that a matrix has few empty places."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    a = 0
    while a < len(order):
        n = len(words[order[a]])
        b = a
        while b < len(order) and b - a < max(1, min(rows, (1 << 22) // max(1, len(words[order[b]])))) and len(words[order[b]]) <= n + 3:
            b += 1
        yield order[a:b]
        a = b


def _rescaled(values: np.ndarray, a: int, b: int, running: np.ndarray) -> np.ndarray:
    """Bring values[a:b], what is still to be used of a pass, within the range of doubles; the new running scale."""
    reach = values[a:b].max(axis=0)
    by = np.where(reach > 0, reach, 1.0)
    values[a:b] /= by
    return running + np.log(by)


def _forward(width: int, arcs: dict, n: int, p: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """alpha[end, word, language] and its scale: the value is alpha * exp(scale); p: piece by language."""
    alpha = np.zeros((width + 1, n, p.shape[1]))
    scale, running = np.zeros_like(alpha), np.zeros(alpha.shape[1:])
    alpha[0] = 1.0
    for start in range(width):
        if start and start % 8 == 0:
            running = _rescaled(alpha, start, start + longest + 1, running)
        scale[start] = running
        for k in range(1, longest + 1):
            if arc := arcs.get((start, k)):
                rows, piece = arc
                alpha[start + k, rows] += alpha[start, rows] * p[piece]
    scale[width] = running
    return alpha, scale


def _backward(width: int, arcs: dict, ends: np.ndarray, p: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """The same from the words' ends: beta[start, word, language] and its scale."""
    beta = np.zeros((width + 1, len(ends), p.shape[1]))
    scale, running = np.zeros_like(beta), np.zeros(beta.shape[1:])
    beta[ends, np.arange(len(ends))] = 1.0
    for start in range(width - 1, -1, -1):
        if start % 8 == 0:
            running = _rescaled(beta, start + 1, start + longest + 1, running)
            scale[start + 1 : start + longest + 1] = running
        # Where a word ends its value is 1 and, nothing of it being scaled before, its scale 0.
        scale[start] = running
        for k in range(1, longest + 1):
            if arc := arcs.get((start, k)):
                beta[start, arc[0]] += beta[start + k, arc[0]] * p[arc[1]]
    return beta, scale


def _parts(word: str, index: Pieces):
    """(characters, arcs) of the parts of a long word; arcs begin in the part and may end behind it."""
    for a in range(0, len(word), TOGETHER):
        b = min(a + TOGETHER, len(word))
        yield b - a, index.lattice([word[a : b + index.longest - 1]])[1]


def _carried(n: int, arcs: dict, first: np.ndarray, running: np.ndarray, p: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward over a part of n characters from the sums at its first places: alpha[place, language], its scale at
    each start, and the scale of the places behind the part."""
    alpha, scale = np.zeros((n + longest, p.shape[1])), np.zeros((n, p.shape[1]))
    alpha[:longest] = first
    for start in range(n):
        if start % 8 == 0:
            running = _rescaled(alpha, start, start + longest, running)
        scale[start] = running
        for k in range(1, longest + 1):
            if arc := arcs.get((start, k)):
                alpha[start + k] += alpha[start] * p[arc[1][0]]
    return alpha, scale, running


def _long_score(word: str, index: Pieces, p: np.ndarray) -> np.ndarray:
    """Log probability of one word of any length in each language."""
    first, running = np.zeros((index.longest, p.shape[1])), np.zeros(p.shape[1])
    first[0] = 1.0
    for n, arcs in _parts(word, index):
        alpha, _, running = _carried(n, arcs, first, running, p, index.longest)
        first = alpha[n:]
    return np.log(np.maximum(first[0], 1e-300)) + running


def _long_counts(word: str, index: Pieces, p: np.ndarray, out: np.ndarray, weight: np.ndarray) -> None:
    """Add one word's expected uses of pieces to ``out``: forward once for the sums at the parts' first places, then
    backward part by part."""
    longest, total = index.longest, _long_score(word, index, p)
    first, running = np.zeros((longest, p.shape[1])), np.zeros(p.shape[1])
    first[0] = 1.0
    begins = []
    for n, arcs in _parts(word, index):
        begins.append((first, running))
        alpha, _, running = _carried(n, arcs, first, running, p, longest)
        first = alpha[n:]
    after, down = np.zeros_like(first), np.zeros(p.shape[1])
    after[0] = 1.0
    for i in range(len(begins) - 1, -1, -1):
        a = i * TOGETHER
        n = min(TOGETHER, len(word) - a)
        arcs = index.lattice([word[a : a + n + longest - 1]])[1]
        alpha, up, _ = _carried(n, arcs, *begins[i], p, longest)
        beta = np.concatenate([np.zeros((n, p.shape[1])), after])
        for start in range(n - 1, -1, -1):
            if start % 8 == 0:
                down = _rescaled(beta, start + 1, start + longest + 1, down)
            scale = np.exp(up[start] + down - total) * weight
            for k in range(1, longest + 1):
                if arc := arcs.get((start, k)):
                    piece = arc[1][0]
                    way = p[piece] * beta[start + k]
                    beta[start] += way
                    out[piece] += alpha[start] * way * scale
        after = beta[:longest]


def word_scores(words: list[str], index: Pieces, p: np.ndarray) -> np.ndarray:
    """Log probability of each (marked) word in each language."""
    out = np.zeros((len(words), p.shape[1]))
    short = [i for i, w in enumerate(words) if len(w) <= TOGETHER]
    if short:
        out[short] = _part_scores([words[i] for i in short], index, p)
    for i, w in enumerate(words):
        if len(w) > TOGETHER:
            out[i] = _long_score(w, index, p)
    return out


def _part_scores(words: list[str], index: Pieces, p: np.ndarray) -> np.ndarray:
    out = np.zeros((len(words), p.shape[1]))
    for own in _groups(words):
        group = [words[i] for i in own]
        width, arcs = index.lattice(group)
        alpha, scale = _forward(width, arcs, len(group), p, index.longest)
        ends, row = np.array([len(w) for w in group]), np.arange(len(group))
        out[own] = np.log(np.maximum(alpha[ends, row], 1e-300)) + scale[ends, row]
    return out


def expected_counts(words: list[str], weights: np.ndarray, index: Pieces, p: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in each language, in words of any length."""
    out = np.zeros((index.other + 1, p.shape[1]))
    for w, weight in zip(words, weights, strict=True):
        if len(w) > TOGETHER:
            _long_counts(w, index, p, out, weight)
    short = [i for i, w in enumerate(words) if len(w) <= TOGETHER]
    words, weights = [words[i] for i in short], weights[short]
    for own in _groups(words):
        group, g_weights = [words[i] for i in own], weights[own]
        width, arcs = index.lattice(group)
        ends, row = np.array([len(w) for w in group]), np.arange(len(group))
        alpha, up = _forward(width, arcs, len(group), p, index.longest)
        beta, down = _backward(width, arcs, ends, p, index.longest)
        total = np.log(np.maximum(alpha[ends, row], 1e-300)) + up[ends, row]
        for (start, k), (rows, piece) in arcs.items():
            scale = np.exp(up[start, rows] + down[start + k, rows] - total[rows])
            np.add.at(out, piece, alpha[start, rows] * p[piece] * beta[start + k, rows] * scale * g_weights[rows])
    return out


def marked(words) -> list[str]:
    return [MARK + w.decode("utf-8", "replace") for w in words]


def learn(docs: DataFrame, names: tuple[str, ...], folds: int = 4, fold: int = 2, most_docs: int = 500, rounds: int = 2,
          smoothing: float = 0.1) -> tuple[list[str], np.ndarray]:
    """Languages and log-free piece probabilities (piece by language), from the text and lang of rows
    that are not held out and have both: about ``most_docs`` rows a language, chosen by a hash of doc_id and text
    (all of them where there are no more)."""
    train = docs.where("lang is not null and text is not null").where(
        F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != fold, F.lit(True))
    )
    counts = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).toLocalIterator()}
    langs = sorted(counts)
    if not langs:
        return [], np.zeros((len(names) + 1, 0))
    rate = F.element_at(F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, most_docs / counts[k])))]), F.col("lang"))
    sample = train.where(F.pmod(F.xxhash64(F.lit(7), "doc_id", "text"), F.lit(1 << 30)) < rate * (1 << 30))
    sample = sample.select("lang", F.col("text").cast("binary").alias("text"))
    p = np.full((len(names) + 1, len(langs)), 1.0 / (len(names) + 1))
    number = {k: i for i, k in enumerate(langs)}
    for _ in range(rounds):
        shared = docs.sparkSession.sparkContext.broadcast((names, p))

        def run(batches, shared=shared):
            names, p = shared.value
            index, out = Pieces(names), {}
            for b in pieces(batches, "text"):
                by_lang: dict[str, Numbers] = {}
                seen: dict[str, list[int]] = {}
                for lang, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                    own = by_lang.setdefault(lang, Numbers())
                    seen.setdefault(lang, []).extend(map(own.__getitem__, t.split()))
                for lang, own in by_lang.items():
                    if own:
                        k = number[lang]
                        weights = np.bincount(seen[lang], minlength=len(own)).astype(float)
                        got = expected_counts(marked(own), weights[:, None], index, p[:, k : k + 1])
                        out[k] = out.get(k, 0) + got[:, 0]
            for k, got in out.items():
                at = np.flatnonzero(got)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(got[at])], names=["lang", "piece", "n"])

        table = sample.mapInArrow(run, "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
        got = table.toPandas()  # at most one row a piece and language
        n = np.zeros_like(p)
        n[got["piece"].to_numpy(), got["lang"].to_numpy()] = got["n"].to_numpy()
        p = (n + smoothing) / (n + smoothing).sum(axis=0)
    return langs, p


def identify(docs: DataFrame, path: str | None = None, folds: int = 4, fold: int = 2, **learning) -> DataFrame:
    """One row a row of ``docs``: doc_id, held_out, lang_pred, score.

    lang_pred is the learned language under which the text is most probable (of equal ones the first
    by name), score its posterior from equal priors. A null text, a text without a letter, or no
    learned language at all gives ``und`` and score 0. Texts of any length count whole. lang, source and doc_id are never inputs of a
    prediction. Repeated rows come back each; other columns are ignored; an empty table gives no rows."""
    return _identified(docs, path, folds, fold, **learning).drop("tid")


def _identified(docs: DataFrame, path: str | None = None, folds: int = 4, fold: int = 2, **learning) -> DataFrame:
    """As ``identify``, with tid, the hash of the row's text."""
    names = vocabulary(path)
    langs, p = learn(docs, names, folds, fold, **learning)
    shared = docs.sparkSession.sparkContext.broadcast((names, p))

    def run(batches):
        names, p = shared.value
        index, own, logs = Pieces(names), Numbers(), np.zeros((0, p.shape[1]))
        for b in pieces(batches, "text"):
            ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            if len(own) > 400_000:
                own, logs = Numbers(), np.zeros((0, p.shape[1]))
            rows = []
            for t in texts:
                ok = bool(langs) and t is not None and LETTER.search(t.decode("utf-8", "replace")) is not None
                rows.append(np.fromiter(map(own.__getitem__, t.split()), dtype=np.int64) if ok else None)
            if len(own) > len(logs):
                new = [w for w, _ in zip(reversed(own), range(len(own) - len(logs)), strict=False)][::-1]
                logs = np.concatenate([logs, word_scores(marked(new), index, p)])
            pred, score = [], []
            for r in rows:
                if r is None:
                    pred.append(UNKNOWN)
                    score.append(0.0)
                else:
                    total = logs[r].sum(axis=0)
                    k = int(total.argmax())
                    pred.append(langs[k])
                    score.append(float(1 / np.exp(total - total[k]).sum()))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("tid"), pa.array([held_out(i, folds, fold) for i in ids], pa.bool_()), pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                names=["doc_id", "tid", "held_out", "lang_pred", "score"],
            )

    text = docs.select("doc_id", F.xxhash64("text").alias("tid"), F.col("text").cast("binary").alias("text"))
    return text.mapInArrow(run, "doc_id long, tid long, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, least: float = 0.5, **parameters) -> DataFrame:
    """``docs`` whose language is found with a score of ``least`` or more. A row goes for its own text:
    rows equal in doc_id (or null there) are told apart by the text's hash."""
    bad = _identified(docs, **parameters).where((F.col("lang_pred") == UNKNOWN) | (F.col("score") < least))
    return without(docs, bad)
