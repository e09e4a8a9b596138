"""Site windows against a read-by-read brute force: odd CIGARs, short, missing and constant kinetics, nulls,
lower case and unknown letters, every normalisation, map codes."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from methloom.functions import cigar as C
from methloom.functions import gather, walks
from methloom.functions import modtags as M
from methloom.functions import signal as S
from methloom.operators import filters, joins, sites

COMPLEMENT = dict(zip("ACGTRYSWKMBDHVN", "TGCAYRSWMKVHDBN", strict=True))
SCHEMA = "contig string, start long, flag int, read_id string, seq string, cigar string, fi array<int>, ri array<int>, fp array<int>, rp array<int>, fn int, ref_seq string"


def turned(seq):
    return "".join(COMPLEMENT.get(c, "N") for c in reversed(seq))


def drawn_cigar(rng, n):
    left, right = rng.randrange(0, 4), rng.randrange(0, 4)
    ops, rest = [], n - left - right
    while rest > 0:
        op = rng.choice("M=XIDN")
        k = rng.randrange(1, 9) if op in "DN" else min(rest, rng.randrange(1, 30))
        ops.append((op, k))
        rest -= 0 if op in "DN" else k
    return [*([("H", 2)] if rng.random() < 0.3 else []), *([("S", left)] if left else []), *ops, *([("S", right)] if right else [])]


def reads(n=60):
    rng = random.Random(8)
    out = []
    for i in range(n):
        size = rng.randrange(20, 120)
        seq = "".join(rng.choice("ACGTCGCGN" if i % 9 else "ACGTCGxé") for _ in range(size))
        ops = drawn_cigar(rng, size)
        span = sum(k for op, k in ops if op in "M=XDN")
        codes = [[rng.randrange(256) for _ in range(size - (i % 7 == 0) * rng.randrange(15))] for _ in range(4)]
        if i % 11 == 0:
            codes[1] = None
        if i % 13 == 0:
            codes[2] = [7] * size
        ref = "".join(rng.choice("ACGTacgt") for _ in range(span - (i % 5 == 0))) if i % 17 else None
        out.append((f"chr{i % 3}", None if i % 19 == 0 else i * 10, 16 * (i % 2), f"r{i}", seq, "".join(f"{k}{op}" for op, k in ops) if i % 23 else None, *codes, i, ref))
    return [*out, ("c", 5, 0, "none", None, None, None, None, None, None, None, None), ("c", 5, 0, "empty", "", "", [], [], [], [], 1, ""), out[3]]


def frame_of(code):
    r = code // 64
    return float((2**r - 1) * 64 + (code - 64 * r) * 2**r)


def normal(values, method):
    x = [frame_of(c) for c in values]
    if not x:
        return []
    if method == "zscore":
        shift = sum(x) / len(x)
        scale = (sum((v - shift) ** 2 for v in x) / len(x)) ** 0.5
    elif method == "mad":
        shift = statistics.median(x)
        scale = statistics.median(abs(v - shift) for v in x) / S.MAD_SCALE
    else:
        shift, scale = {"none": (0.0, 1.0), "min-max": (min(x), max(x) - min(x)), "min-mean": (min(x), sum(x) / len(x))}[method]
    return [0.0 if scale == 0 else np.floor((v - shift) / scale * 1e6 + 0.5) / 1e6 for v in x]


def brute(row, motifs, mod_loc, seq_len, norm, skip):
    contig, start, flag, read, seq, cigar, *codes, fn, ref = row
    if seq is None:
        return
    n, flank, reverse = len(seq), (seq_len - 1) // 2, flag & 16
    forward = turned(seq) if reverse else seq
    import re

    ops = [(op, int(k)) for k, op in re.findall(r"(\d+)([MIDNSH=X])", cigar or "")]
    offset, q, r = [None] * n, 0, 0
    for op, k in ops:
        for j in range(k):
            if op in "M=X" and q + j < n:
                offset[q + j] = r + j
        q, r = q + (k if op in "M=XIS" else 0), r + (k if op in "M=XDN" else 0)
    soft = [(op, k) for op, k in ops if op != "H"]
    left, right = (soft[0][1] if soft and soft[0][0] == "S" else 0), (soft[-1][1] if soft and soft[-1][0] == "S" else 0)
    first, last = (right, n - left) if reverse else (left, n - right)
    span = r
    turn = [(None if o is None else span - 1 - o) for o in reversed(offset)] if reverse else offset

    def code(j):
        if not first <= j < last or turn[j] is None:
            return 1
        differs = ref is not None and (turn[j] >= len(ref) or forward[j].upper() != ref[turn[j]].upper())
        return 4 * differs + 2 * (j > first and turn[j - 1] is not None and turn[j] != turn[j - 1] + 1)

    signals = [None if c is None else normal(c, norm) for c in codes]
    k = len(motifs[0])
    for i in range(n - k + 1):
        if forward[i : i + k] in motifs:
            loc = i + mod_loc
            other = n - 1 - loc - (k - 1 - 2 * mod_loc)
            if not (flank <= loc < n - flank and flank <= other < n - flank) or (skip and not first <= loc < last):
                continue
            at = offset[n - 1 - loc if reverse else loc]
            cut = lambda s, c: None if s is None else s[c - flank : c - flank + seq_len]
            yield (contig, -1 if at is None or start is None else start + at, "-" if reverse else "+", read, loc, forward[loc - flank : loc - flank + seq_len],
                   turned(forward)[other - flank : other - flank + seq_len], cut(signals[0], loc), cut(signals[2], loc), cut(signals[1], other), cut(signals[3], other),
                   [code(j) for j in range(loc - flank, loc - flank + seq_len)], [code(j) for j in range(n - 1 - other + flank, n - 1 - other + flank - seq_len, -1)], fn, 1)


@pytest.mark.parametrize(("motifs", "mod_loc", "norm", "skip"), [(["CG"], 0, "zscore", True), (["CG"], 0, "mad", False), (["CAG", "CCG", "CGG", "CTG"], 0, "min-max", True), (["GC"], 1, "min-mean", True), (["CG"], 0, "none", True)])
def test_windows(spark, monkeypatch, motifs, mod_loc, norm, skip):
    rows = [r for r in reads() if r[4] is None or r[4].isascii()]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sites.extract_features(df, motifs, mod_loc, 11, norm, skip, maps=True)
    key = lambda r: (r[3], r[4])
    have, want = sorted((tuple(r) for r in got.collect()), key=key), sorted((s for r in rows for s in brute(r, motifs, mod_loc, 11, norm, skip)), key=key)
    assert len(have) == len(want) > 20
    for a, b in zip(have, want, strict=True):
        assert a[:7] == b[:7] and a[11:] == b[11:]
        for x, y in zip(a[7:11], b[7:11], strict=True):
            assert (x is None) == (y is None) and (x is None or x == pytest.approx(y, abs=2e-6))
    assert sites.extract_features(df.limit(0), motifs).count() == 0


def test_columns_without_kinetics(spark):
    df = spark.createDataFrame(reads()[1:3], SCHEMA)
    assert sites.extract_features(df.drop("fi", "fn"), ["CG"], seq_len=5).columns == ["contig", "pos", "strand", "read_id", "loc", "f_kmer", "r_kmer", "label"]


def test_small_batches(spark, monkeypatch):
    """A read longer than a part is a part of its own; parts do not change rows."""
    rows = [r for r in reads() if r[4] is None or r[4].isascii()]
    plan = gather.Plan(["CG"], 0, 11, "zscore", True, False, False, ["read_id"])
    import pyarrow as pa

    ops = pa.list_(pa.struct([("op", pa.string()), ("len", pa.int32())]))
    batch = pa.RecordBatch.from_pydict({
        "read_id": [r[3] for r in rows], "start": pa.array([r[1] for r in rows], pa.int64()), "seq": pa.array([r[4] for r in rows], pa.string()), "reverse": [bool(r[2]) for r in rows],
        "cigar": pa.array([[{"op": "M", "len": len(r[4] or "")}] for r in rows], ops), "first": [0] * len(rows), "last": [len(r[4] or "") for r in rows],
    })
    whole = pa.Table.from_batches(gather.site_windows(plan)(iter([batch])))
    monkeypatch.setattr(gather, "BASES", 150)
    parts = list(gather.site_windows(plan)(iter([batch])))
    assert len(parts) > 5 and pa.Table.from_batches(parts).equals(whole)


@pytest.mark.parametrize("method", ["none", "zscore", "min-max", "min-mean", "mad"])
def test_normalised_like_the_column_expression(spark, method):
    rng = np.random.default_rng(1)
    lists = [[], [5.0], [3.0, 3.0], *(list(map(float, rng.integers(0, 900, n))) for n in (2, 7, 50))]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, x array<double>")
    want = [r[0] for r in df.orderBy("i").select(S.normalised(F.col("x"), method)).collect()]
    got = gather.normalised(np.concatenate(lists), np.array([len(x) for x in lists]), method)
    assert got == pytest.approx(np.concatenate([w for w in want if w]), abs=2e-6)


def test_placed_calls_like_decoding_and_looking_up(spark):
    """One pass gives what decoding and the lookup of references give, over odd tags and CIGARs."""
    from methloom.functions import cigar as C
    from methloom.functions import modtags as M
    from methloom.functions import walks as V
    from methloom.operators.joins import forward_sequence

    rng, rows = random.Random(12), []
    for r in reads(80):
        if r[4] is None or not r[4].isascii():
            continue
        forward = turned(r[4]) if r[2] & 16 else r[4]
        total = forward.count("C")
        taken = sorted(rng.sample(range(total), rng.randrange(0, total + 1))) if total else []
        skips = [b - a - 1 for a, b in zip([-1, *taken], taken, strict=False)]
        kind = rng.randrange(9)
        mm = None if kind == 0 or not skips else "C+m?," + ",".join(map(str, [*skips[:-1], skips[-1] + 900 * (kind == 1)])) + ";"
        rows.append((r[3], r[2], r[4], r[5], mm, None if kind == 2 else [rng.randrange(256) for _ in range(len(skips) - (kind == 3))]))
    rows += [("none", 0, None, None, None, None), ("empty", 16, "", "", "C+m,0;", [1])]
    df = spark.createDataFrame(rows, "read_id string, flag int, seq string, cigar string, mm string, ml array<int>").withColumn("cigar", C.parse(F.col("cigar")))
    reverse = F.col("flag").bitwiseAND(16) != 0
    decoded = df.withColumn("calls", M.decode(F.col("mm"), F.col("ml"), forward_sequence(df), reverse))
    offsets = V.to_references(V.walk(F.col("cigar")), F.transform("calls", lambda c: c["loc"]))
    both = F.filter(F.zip_with("calls", offsets, lambda c, o: F.struct(c["loc"].alias("loc"), c["prob"].alias("prob"), o.alias("offset"))), lambda c: c["offset"].isNotNull())
    want = {r.read_id: r.c or [] for r in decoded.select("read_id", both.alias("c")).collect()}
    got = {r.read_id: r.c for r in df.select("read_id", gather.placed_calls(F.col("cigar"), M.skips(F.col("mm")), F.col("ml"), F.col("seq"), reverse).alias("c")).collect()}
    assert got == want and sum(map(len, got.values())) > 100


def test_places_inside_of_clipped_pairs(spark):
    """Those of all places of reads at once are those of each place alone, over every kind of operation, beyond both ends and for nulls."""
    rng = random.Random(8)
    cigars = ["", "*", "3H", "4D"] + ["".join(f"{rng.randrange(1, 7)}{rng.choice('M=XIDNSHP')}" for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    reads = spark.createDataFrame([(i, c, [*range(-2, 45), None, 3]) for i, c in enumerate(cigars)] + [(-1, "9=", None)], "i int, cigar string, q array<int>")
    places = reads.select("i", C.blocks(C.parse(F.col("cigar"))).alias("b"), "q").select("i", "b", F.posexplode("q").alias("k", "x"))
    for n, matches_only, aligned in ((0, True, False), (2, True, True), (3, False, False), (1, False, True)):
        ok = filters.clipped_pairs(F.col("b"), F.col("x"), n, matches_only)
        ok = ok & C.to_reference(F.col("b"), F.col("x")).isNotNull() if aligned else ok
        want = {(r.i, r.k) for r in places.where(ok & F.col("x").isNotNull()).select("i", "k").collect()}
        got = reads.select("i", walks.inner_places(walks.walk(C.parse(F.col("cigar"))), F.col("q"), n, matches_only, aligned).alias("k"))
        assert {(r.i, k) for r in got.collect() for k in r.k or []} == want and want


def test_calls_of_clipped_pairs(spark):
    seq = "CGCGCGCGCG"
    reads = spark.createDataFrame([("a", 0, "c", 100, "10=", seq), ("b", 16, "c", 50, "2S8=", seq), ("d", 0, "c", 0, "10=", "A" * 10)], "read_id string, flag int, contig string, start long, cigar string, seq string")
    hits = F.when(F.col("read_id") != "d", F.array(*map(F.lit, range(0, 10, 2))))
    df = reads.withColumn("mm", M.mm_text(M.encode_skips(hits, joins.forward_sequence(reads)))).withColumn("ml", F.transform(hits, lambda i: i * 10)).withColumn("hap", F.lit(0))
    at = lambda n: sorted((r.read_id, r.pos) for r in joins.project_calls(df, n).collect())
    assert at(0) == [("a", p) for p in range(100, 110, 2)] + [("b", p) for p in range(51, 59, 2)]
    assert at(3) == [("a", 104), ("a", 106), ("b", 53)]
