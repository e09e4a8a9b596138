"""Fill-in-middle, hard negatives and personal data against brute force on small fixtures, with nulls, empty
and long texts, ties, repeated rows, empty tables and extra columns of clashing names."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from methloom.llm import fim, negatives, oracles, pii, queries

DOCS = "doc_id long, text string, lang string, n long, output string, form string, spans string, chain int"


def frame(spark, texts):
    rows = [(i, t, None, 1, "o", "f", "s", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[-1], (None, "no id\nhere", None, None, None, None, None, None), (None,) * 8], DOCS)


def lines_of(text):
    return re.findall(r"[^\n]*\n|[^\n]+", text)


def fim_texts():
    rng = random.Random(1)
    odd = ["", None, "\n", "\n\n", "a", "a\n", "ab<P>c\nd", "x\n<S>", "<M>", "<", "<P\n>", "<S\n<P", "é\nß\n漢字", "a\r\nb\x0b\n", "x" * 300_000 + "\n" + "é" * 1_200_000]
    return [*odd, *("\n".join("".join(rng.choice("ab<>PSMé ") for _ in range(rng.randrange(6))) for _ in range(rng.randrange(12))) for _ in range(300))]


def brute_fim(doc_id, text, seed=7, fim_percent=100, spm_percent=50):
    text = text or ""
    units = lines_of(text)
    n = len(units)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim_percent:
        return n, "plain", None, None, text
    if h[3] % 100 < spm_percent:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("options", [{}, {"seed": 3, "fim_percent": 60, "spm_percent": 10}])
def test_fill_in_middle(spark, options):
    docs = frame(spark, fim_texts())
    got = fim.transform(docs, **options).withColumn("restored", fim.restored(F.col("output"), F.col("form"))).collect()
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    key = lambda x: repr(x)[:200]
    want = sorted(((i, *brute_fim(i, t, **options), t or "") for i, t in texts), key=key)
    assert sorted((tuple(r) for r in got), key=key) == want
    assert len({r.form for r in got}) == 3
    assert fim.transform(docs.limit(0)).count() == 0


def test_fill_in_middle_over_slices(spark, monkeypatch):
    """Shifts carry from slice to slice."""
    monkeypatch.setattr(fim, "SLICE", 7)
    rng = random.Random(2)
    for _ in range(50):
        total = rng.randrange(0, 60)
        at = np.sort([rng.randrange(0, total + 1) for _ in range(rng.randrange(1, 9))])
        at[0] = 0
        shift = np.array([rng.randrange(-50, 50) for _ in at])
        moved = np.concatenate([w for _, _, w in fim._shifts(total, at, shift)]) if total else []
        assert list(moved) == [p + shift[np.searchsorted(at, p, "right") - 1] for p in range(total)]


def test_restored_only_from_sound_outputs(spark):
    rows = [("<P>a<S>b<M>c", "psm"), ("<S>b<P>a<M>c", "spm"), ("<S>b<P>a<M>c", "psm"), ("<P>a<S>b", "psm"), ("x<P>a<S>b<M>c", "psm"), ("<P>a<S>b<M>c<M>", "psm"), ("abc", "plain"),
            ("a<P>", "plain"), (None, "plain"), ("abc", None), ("abc", "other"), ("", "psm"), ("<P><S><M>", "psm")]
    df = spark.createDataFrame(rows, "output string, form string")
    got = [r[0] for r in df.select(fim.restored(F.col("output"), F.col("form"))).collect()]
    assert got == ["acb", "acb", None, None, None, None, "abc", "a<P>", None, None, None, None, ""]


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_hard_negatives"])
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = con.sql(getattr(oracles, name.split("_")[0].upper())).df()[list(got.columns)]
    cells = lambda df: sorted(tuple("" if v is None or v != v else str(int(v) if isinstance(v, float) else v) for v in r) for r in df.astype(object).itertuples(index=False))
    assert cells(got) == cells(want) and len(got)


def test_exact_scores():
    rng = np.random.default_rng(4)
    for k, top in ((1, 2**31 - 1), (3, 10), (64, 140), (64, 2**27), (65, 2**27), (200, 2**24), (1000, 5), (0, 1)):
        a, b = rng.integers(-top, top, (7, k), endpoint=True), rng.integers(-top, top, (9, k), endpoint=True)
        if k:
            a[0], b[0], b[1] = top, top, -top
        want = [[sum(int(x) * int(y) for x, y in zip(u, v, strict=True)) for v in b] for u in a]
        assert negatives.exact_scores(a, b).tolist() == want
    assert all(p % 2 and 64 * (p // 2) ** 2 < 1 << 24 for p in negatives.PRIMES)


def brute_negatives(rows, positives, negatives_, low, high):
    sound = {(i, y, tuple(v)) for i, y, v in rows if None not in (i, y, v) and all(x is not None and np.isfinite(x) for x in v)}
    sound = [(i, y, [int(np.floor(256 * x)) for x in v]) for i, y, v in sound if all(abs(x) < 1e6 for x in v)]
    out = []
    for i, y, v in sound:
        if i % 50:
            continue
        scored = sorted((-sum(p * q for p, q in zip(v, w, strict=True)), j, z) for j, z, w in sound if j != i and len(w) == len(v))
        for s, j, _ in [x for x in scored if x[2] == y][:positives]:
            near = [(t, m) for t, m, z in scored if z != y and low * -s <= 100 * -t <= high * -s][:negatives_]
            out += [(i, j, k + 1, m, -s, -t) for k, (t, m) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("unit", [(2048, 8192), (2, 20)])
def test_hard_negatives(spark, unit):
    rng = np.random.default_rng(7)
    x = np.abs(rng.normal(size=(260, 6))) * 0.2
    x[100:140] = x[99]  # ties
    x[0], x[150:160] = -x[0], 3000.0
    rows = [(i, int(i % 3) if i % 41 else None, [float(v) for v in r]) for i, r in enumerate(x.astype(np.float32))]
    bad = [None, [None] + [1.0] * 5, [float("nan")] * 6, [float("inf")] * 6, [1e30] * 6]
    rows += [(1000 + 50 * i, 1, v) for i, v in enumerate(bad)] + [(1300, 1, []), (1301, 2, []), (1302, 1, []), (1350, 1, [0.5, 0.5]), (1351, 1, [0.5, 0.25]), (1352, 2, [0.5, 0.125])]
    rows += [rows[50], rows[51], (None, 1, rows[3][2]), (52, 2, rows[99][2]), (-50, 0, rows[7][2])]
    df = spark.createDataFrame([(*r, 1, 1, "w") for r in rows], "vec_id long, label int, embedding array<float>, akey int, rank int, window string")
    for options in ({}, {"positives": 2, "negatives": 7, "low": 20, "high": 100}):
        got = sorted(tuple(r) for r in negatives.mine(df, unit=unit, **options).collect())
        o = {"positives": 5, "negatives": 3, "low": 50, "high": 95} | options
        assert got == brute_negatives(rows, o["positives"], o["negatives"], o["low"], o["high"]) and len(got) > 20
    assert negatives.mine(df.limit(0)).count() == 0


# The base patterns as they are stated.
STATED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def sound(kind, text):
    digits = re.sub(r"[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        twice = [2 * int(d) if i % 2 else int(d) for i, d in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(t - 9 if t > 9 else t for t in twice) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def stated(text):
    return [(k, m.start(), m.end()) for k, p in STATED.items() for m in re.finditer(p, text) if sound(k, m[0])]


def pii_texts():
    rng = random.Random(3)
    pools = ["0123456789.", "0159 -", "+ (1)2-.3", "a.@-b1_%", "1.2@ +(9)-a\n"]
    drawn = ["".join(rng.choice(pool) for _ in range(rng.randrange(60))) for pool in pools for _ in range(400)]
    fixed = ["", None, "a@b.c@d.e", "@@a@b.c.", "x@y", "a@b..c", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.1", "000255.1.1.1", "4111 1111 1111 1111 5", "4111111111111111", "+1 (743) 555-3824 4465758382390017",
             "é@ü.de é a@b.cd", "call +44 20 7946 0958.", "ä" * 9 + "10.0.0.1", "9" * 200_000, "a" * 200_000 + "@b.c", "1." * 50_000, "- " * 50_000 + "@", "$" * 100_000 + "x1"]
    return [*fixed, *drawn]


def test_base_patterns():
    for text in pii_texts():
        if len(text or "") < 1000:
            assert pii.patterns(text or "") == stated(text or ""), text
    assert pii.patterns("9" * 200_000) == [] and pii.patterns("a" * 200_000 + "@b.c") == [("email", 0, 200_004)]


def test_scan(spark):
    docs = frame(spark, pii_texts())
    rows = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect() if r.doc_id is not None}
    got = pii.scan(docs).collect()
    assert len(got) == docs.count()
    text = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    for r in got:
        base = stated(rows[r.doc_id]) if r.doc_id is not None and len(rows[r.doc_id]) < 1000 else pii.patterns(rows.get(r.doc_id, ""))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for x, _, _ in base) for k in pii.KINDS]
        assert r.base_sha256 == hashlib.sha256(text(base).encode()).hexdigest()
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)]
        assert set(base) <= set(spans) and spans == sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), s[1]))
        more = set(spans) - set(base)
        assert not any(a < y and x < b for _, a, b in more for _, x, y in base)
    assert pii.scan(docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def field(spark):
    return pii.fit(pii.examples(spark))


def test_viterbi_and_sums_against_all_paths(field):
    rng = np.random.default_rng(5)
    for n in (1, 2, 4):
        e = np.zeros((2, 4, pii.STATES))
        e[:, :n] = rng.normal(size=(2, n, pii.STATES)) * 2
        lengths = np.array([n, n])
        states, (a, b, total) = pii.viterbi(e, lengths, field.pairs), pii._sums(e, lengths, field.pairs)
        paths = np.stack(np.meshgrid(*[np.arange(pii.STATES)] * n, indexing="ij"), -1).reshape(-1, n)
        for c in range(2):
            ends = np.concatenate([np.zeros((len(paths), 1), int), paths, np.zeros((len(paths), 1), int)], axis=1)
            score = field.pairs[ends[:, :-1], ends[:, 1:]].sum(axis=1) + e[c, np.arange(n), paths].sum(axis=1)
            assert list(states[c, :n]) == list(paths[score.argmax()])
            assert total[c] == pytest.approx(np.logaddexp.reduce(score))
            share = np.exp(score - total[c])
            want = [[share[paths[:, t] == s].sum() for s in range(pii.STATES)] for t in range(n)]
            assert np.exp(a + b - total[:, None, None])[c, :n] == pytest.approx(np.array(want), abs=1e-9)


def test_padding_changes_nothing(field):
    rng = np.random.default_rng(6)
    scores = [rng.normal(size=(n, pii.STATES)) for n in (1, 5, 2, 40, 1, 3)]
    for (s, p), (t, q) in zip(field.decode(scores), [field.decode([x])[0] for x in scores], strict=True):
        assert list(s) == list(t) and p == pytest.approx(q)


def test_field_on_held_out_rows(spark, field):
    """Rows of other digits than the learned ones: nearly all spans are found, and nothing in rows without any."""
    found = missed = wrong = 0
    for row in pii.examples(spark, copies=3, seed=99).collect():
        got = {s for c in pii.chains(row.text) for s in pii.added(row.text, c, *field.decode([field.scores(pii._neighbours(row.text, c))])[0], [], 0.9)}
        want = {(s.kind, s.start, s.end) for s in row.spans}
        found, missed, wrong = found + len(got & want), missed + len(want - got), wrong + len(got - want)
    assert found / (found + missed) > 0.85 and wrong / (found + wrong) < 0.05


def test_field_adds_what_patterns_miss(spark):
    texts = ["please dial (212) 867-5309 after six", "john@mailhost wrote", "amex 371449635398431 declined", "+1 (743) 555-3824 4465758382390017 xx", "on 2023-11-05 we paid $45.50 for 3 items, see 3.11.2"]
    got = {r.doc_id: r.spans for r in pii.find(frame(spark, texts)).where("doc_id is not null").collect()}
    parts = [[(s.kind, texts[i][s.start : s.end], s.base) for s in got[i]] for i in range(5)]
    assert parts[:3] == [[("phone", "(212) 867-5309", False)], [("email", "john@mailhost", False)], [("card", "371449635398431", False)]]
    assert ("phone", "+1 (743) 555-3824", False) in parts[3] and parts[4] == []


def test_own_labelled_table(spark):
    """Another table teaches another kind of span; nulls and unknown kinds are left out; an empty one adds nothing."""
    kind = "text string, spans array<struct<kind:string,start:bigint,end:bigint>>"
    rows = [(f"badge {10 + i}:{20 + i}:{30 + i}:{i} seen", [("ip", 6, 6 + len(f"{10 + i}:{20 + i}:{30 + i}:{i}")), ("other", 0, 5)]) for i in range(30)] + [(None, None), ("plain 12 words", None)]
    docs = spark.createDataFrame([(1, "badge 11:12:13:9 seen")], "doc_id long, text string")
    assert [s.kind for s in pii.find(docs, spark.createDataFrame(rows, kind)).first().spans] == ["ip"]
    assert pii.find(docs, spark.createDataFrame([], kind)).first().spans == []
