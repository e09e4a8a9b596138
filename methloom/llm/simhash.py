"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits, each padded to a word of
the binary Golay code [23, 12, 7]. That code is perfect: every word has one codeword within 3
bits, its *home*; a word at 3 bits from home has five more codewords at 4 bits. Of two
fingerprints at 3 bits or fewer, some two segments hold one error each at most (the third takes
the rest), and a word one bit from x has its home among the codewords within 4 bits of x. So the
pair of codeword indices (home of the other's first segment, home of one's second segment) is a
key of both: one side lists the neighbours of its first segment, the other of its second. That is
some 16 keys of 24 bits a fingerprint and side, and no pair in range is missed.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, components, discard, mixed, pieces, written
from .lines import LONG, dealt_to, grouped, met

RADIUS = 3
SHINGLE = 3
#: The pipeline's stage: words a shingle, similarity, bands and values a band, and the most bits that
#: fingerprints of similar texts differ in (10 expected at 0.8; 24 is five standard deviations more).
STAGE_SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 12, 5
APART = 24
#: Generator polynomial of the binary Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1.
GENERATOR = 0b110001110101
#: (lowest bit, number of bits) of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))


def shingles(text: bytes | None, shingle: int) -> np.ndarray:
    """Hash of each run of ``shingle`` words of a text (UTF-8), in order; of a shorter text one, of no words none."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)], dtype=np.uint64)


def _folded(hashes: np.ndarray) -> int:
    """Fingerprint of shingle hashes."""
    n, hashes = len(hashes), hashes.astype(">u8")
    counts = np.zeros(64, dtype=np.int64)
    for a in range(0, n, 1 << 16):
        counts += np.unpackbits(hashes[a : a + (1 << 16)].view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Unsigned fingerprint of one text (UTF-8). Bit set if more than half the shingle hashes set it."""
    return _folded(shingles(text, shingle))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): one row a document, fp the fingerprint as a signed long."""

    def run(batches):
        for b in pieces(batches, "text"):
            fps = np.array([fingerprint(t) for t in b.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


@cache
def _code() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndrome of each bit; error by syndrome; heaviness by syndrome; the five weight-7 codewords
    over each three-bit error, by its syndrome."""

    def remainder(x: int) -> int:
        for i in range(22, 10, -1):
            if x >> i & 1:
                x ^= GENERATOR << (i - 11)
        return x

    bits = np.array([remainder(1 << i) for i in range(23)], dtype=np.int64)
    error, weight = np.zeros(2048, dtype=np.int64), np.zeros(2048, dtype=np.int64)
    for w in (1, 2, 3):
        for at in combinations(range(23), w):
            s = int(np.bitwise_xor.reduce(bits[list(at)]))
            error[s], weight[s] = sum(1 << i for i in at), w
    words = np.array([d << 11 | remainder(d << 11) for d in range(4096)], dtype=np.int64)
    sevens = words[np.bitwise_count(words) == 7]
    over = np.zeros((2048, 5), dtype=np.int64)
    for s in np.flatnonzero(weight == 3):
        over[s] = sevens[(sevens & error[s]) == error[s]]
    return bits, error, weight, over


def near_codewords(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home index of each 23-bit word; indices of its codewords within 4 bits (home first, six
    columns); how many of the columns count (1 or 6)."""
    bits, error, weight, over = _code()
    s = np.zeros(len(x), dtype=np.int64)
    for i in range(23):
        s ^= np.where(x >> i & 1, bits[i], 0)
    home = x ^ error[s]
    near = np.concatenate([home[:, None], home[:, None] ^ over[s]], axis=1) >> 11
    return home >> 11, near, np.where(weight[s] == 3, 6, 1)


def keys(fps: DataFrame, side: int) -> DataFrame:
    """(key, fp, rep) of each row of ``fps`` (fp, rep) on one side of the join."""

    def run(batches):
        for b in batches:
            fp = np.asarray(b.column("fp"), dtype=np.int64).view(np.uint64)
            segs = [near_codewords(((fp >> np.uint64(lo)) & np.uint64((1 << n) - 1)).astype(np.int64)) for lo, n in SEGMENTS]
            out, rows = [], []
            for pair, (i, j) in enumerate(combinations(range(3), 2)):
                (home_i, near_i, n_i), (home_j, near_j, n_j) = segs[i], segs[j]
                near, n = (near_i, n_i) if side == 0 else (near_j, n_j)
                row, col = np.nonzero(np.arange(6)[None, :] < n[:, None])
                first, second = (near[row, col], home_j[row]) if side == 0 else (home_i[row], near[row, col])
                out.append(pair << 24 | first << 12 | second)
                rows.append(row)
            take = pa.array(np.concatenate(rows))
            arrays = [pa.array(np.concatenate(out).astype(np.int32)), b.column("fp").take(take), b.column("rep").take(take)]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "fp", "rep"])

    return fps.select("fp", "rep").mapInArrow(run, f"key int, fp long, rep {dict(fps.dtypes)['rep']}")


def linked(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(src, dst): the ``rep`` of each two distinct fingerprints at ``radius`` bits or fewer (3 at most)."""
    left = keys(fps, 0).toDF("key", "fp", "src")
    right = keys(fps, 1).toDF("key", "fp2", "dst")
    near = (F.col("fp") < F.col("fp2")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= radius)
    return left.join(right, (left["key"] == right["key"]) & near).select("src", "dst")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row a document: doc_id, fingerprint (16 hex digits), component_id.

    Equal texts and equal fingerprints are one class from the start, so copies cost one row; a null
    or empty text has fingerprint zero and is linked like any other; texts of any length count whole; a
    bit that half the shingles set, a tie, is not set. Repeated rows come back as
    often as they came. A null doc_id links others like any, but is never a component's id (null if its
    component has no other). Columns besides doc_id and text are ignored; an empty table gives an empty result."""
    if not 0 <= radius <= 3:
        raise ValueError("the Golay keys cover a radius of 0 to 3 bits")
    prints = written(fingerprints(docs))
    # A fingerprint that no doc_id has stands for itself, by a number above all longs, so that it is no component's smallest.
    beyond = F.lit(str(1 << 64)).cast("decimal(20,0)") + F.col("fp").cast("decimal(20,0)")
    fps = written(prints.groupBy("fp").agg(F.min("doc_id").alias("id")).withColumn("rep", F.coalesce(F.col("id").cast("decimal(20,0)"), beyond.cast("decimal(20,0)"))))
    comps = components(linked(fps, radius))
    smallest = F.when(F.col("component") <= (1 << 63) - 1, F.col("component").cast("long"))
    labels = fps.join(comps, fps["rep"] == comps["node"], "left").select("fp", F.when(F.col("component").isNull(), F.col("id")).otherwise(smallest).alias("component_id"))
    return prints.join(labels, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band of MinHash values of a set of shingle hashes."""
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 1 << 64, (2, BANDS * ROWS), dtype=np.uint64)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(hashes), 4096):
        part = mixed(hashes[None, i : i + 4096] ^ a[:, None])
        low = np.minimum(low, part.min(axis=1))
    keys = np.zeros(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        keys = mixed(keys * np.uint64(BASE) + low[r::ROWS] + b[r::ROWS])
    return keys


def similar_texts(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, tid, component) of each row: tid is the hash of its text, component joins texts whose
    fingerprints the Golay keys link (RADIUS bits or fewer, as ``near_duplicates``) and texts whose
    sets of five-word shingles are alike. Texts of the same words are one from the start, so are texts
    without words."""
    text = docs.select("doc_id", F.xxhash64("text").alias("tid"), F.col("text").cast("binary").alias("text"))

    def run(batches):
        for b in pieces(batches, "text"):
            texts = b.column("text").to_pylist()
            lids = np.array([xxhash.xxh64_intdigest(b" ".join((t or b"").lower().split())) for t in texts], dtype=np.uint64)
            fps = np.array([fingerprint(t) for t in texts], dtype=np.uint64)
            sets = [np.unique(shingles(t, STAGE_SHINGLE)) for t in texts]
            sketch = np.array([_folded(s) for s in sets], dtype=np.uint64)
            keys = np.concatenate([band_keys(s) for s in sets]).view(np.int64)
            ends = pa.array(np.arange(len(texts) + 1) * BANDS, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("tid"), *(pa.array(x.view(np.int64)) for x in (lids, fps, sketch)), pa.ListArray.from_arrays(ends, pa.array(keys))],
                names=["doc_id", "tid", "lid", "fp", "sketch", "keys"],
            )

    rows = written(text.mapInArrow(run, "doc_id long, tid long, lid long, fp long, sketch long, keys array<long>"))
    distinct = rows.groupBy("lid").agg(F.min(F.struct("tid", "sketch", "keys")).alias("x"))
    members = met(distinct.select("lid", "x.sketch", "x.keys"))
    wanted = distinct.join(members.select("lid").distinct(), "lid", "left_semi").select("lid", "x.tid")
    texts = written(text.join(wanted, "tid").groupBy("lid").agg(F.min("text").alias("text")))

    def similar(pairs: DataFrame) -> DataFrame:
        pairs = written(pairs)
        n = dealt_to(pairs.count())
        both = pairs.join(texts.toDF("a", "text_a"), "a").repartition(n, "b").join(texts.toDF("b", "text_b"), "b")

        def compare(batches):
            for b in pieces(batches, "text_a"):
                keep = []
                for x, y in zip(b.column("text_a").to_pylist(), b.column("text_b").to_pylist(), strict=True):
                    x, y = np.unique(shingles(x, STAGE_SHINGLE)), np.unique(shingles(y, STAGE_SHINGLE))
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(both >= similarity * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(keep)), b.column("b").filter(pa.array(keep))], names=["src", "dst"])

        return both.mapInArrow(compare, "src long, dst long")

    is_long = F.octet_length("text") > 8 * LONG
    any_long = not texts.where(is_long).isEmpty()

    def sets(rows: DataFrame) -> DataFrame:
        kept = list(rows.columns)

        def run(batches):
            for b in pieces(batches, "text"):
                runs = [None if t is None else np.unique(shingles(t, STAGE_SHINGLE)).view(np.int64) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(runs, pa.list_(pa.int64()))], names=[*kept, "runs"])

        here = rows.join(texts, "lid").select(*kept, F.when(~is_long, F.col("text")).alias("text"))
        return here.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in [*rows.dtypes, ("runs", "array<bigint>")]))

    near = lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= APART
    comps = grouped(members, similar, sets, similarity, near, texts.where(is_long).select("lid") if any_long else None)
    prints = rows.select("fp", "lid").distinct()
    fps = written(prints.groupBy("fp").agg(F.min("lid").alias("rep")))
    equal = prints.join(fps, "fp").where("lid <> rep").select(F.col("lid").alias("src"), F.col("rep").alias("dst"))
    comps = components(linked(fps).union(equal).union(comps.toDF("src", "dst")))
    discard(fps)
    found = rows.select("doc_id", "tid", "lid").join(comps, rows["lid"] == comps["node"], "left")
    return found.select("doc_id", "tid", F.coalesce("component", "lid").alias("component"))


def keep_first(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each component of ``similar_texts`` (the smallest doc_id, null last, then the smallest
    text hash; of repeated rows all). Texts without words are one component; texts of any length count
    whole; other columns pass, whatever their names; an empty table stays empty."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tid")
    kept = similar_texts(docs, similarity).groupBy("component").agg(F.min(order).alias("first")).select("first.doc_id", "first.tid")
    kept = kept.toDF("_doc", "_tid")
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_doc"]) & (F.xxhash64(docs["text"]) == kept["_tid"]), "left_semi")
