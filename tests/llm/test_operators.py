"""The ten operators against brute force on small fixtures, with nulls, empty and long texts, ties,
repeated rows, empty tables and extra columns of clashing names."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from conftest import SF
from methloom.llm import common, decontaminate, embeddings, language, licenses, lines, mixing, queries, simhash, substrings, suffix_tree, warc

DOCS = "doc_id long, text string, lang string, source string, fp string, key int, row string, block int"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def sentence(rng, n, words=400):
    return " ".join(f"w{int(rng.random() ** 2 * words)}" for _ in range(n))


def texts():
    rng = random.Random(5)
    base = sentence(rng, 120)
    near = base.split()
    near[60] = "changed"
    long = sentence(rng, 30_000, 3000)
    odd = ["", None, " \t\n ", "a", "A b", "a b", "é ß x", "x" * 5000, "\n\n", "12 34 !!"]
    return [*odd, base, base, " ".join(near), base.upper(), long, long[: len(long) // 2], *(sentence(rng, rng.randrange(1, 90)) for _ in range(60))]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de"][i % 2] if i % 7 else None, f"s{i % 4}" if i % 5 else None, "z", i, "r", i) for i, t in enumerate(texts())]
    rows += [rows[12], (None, "null id text of some words here", "en", "s1", "z", 1, "r", 1), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def components(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in linked:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(n)]


def brute_fingerprint(text):
    words = WORD.findall((text or "").encode().lower())
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, none):
    rows = docs.select("doc_id", "text").collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    comp = components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    low = {}
    for r, c in zip(rows, comp, strict=True):
        if r.doc_id is not None:
            low[c] = min(low.get(c, r.doc_id), r.doc_id)
    want = sorted((r.doc_id if r.doc_id is not None else -1, f"{f:016x}", low.get(c, -1)) for r, f, c in zip(rows, fps, comp, strict=True))
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint, -1 if r.component_id is None else r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    assert simhash.near_duplicates(none).count() == 0


def test_golay_keys_find_all_pairs_in_radius(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = set(base)
    for b in base:
        for n in (1, 2, 3, 4):
            for _ in range(4):
                fps.add(b ^ sum(1 << i for i in rng.sample(range(64), n)))
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)], "fp long, rep long")
    want = {(min(i, j), max(i, j)) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3}
    got = {(min(r.src, r.dst), max(r.src, r.dst)) for r in simhash.linked(df).collect()}
    assert got == want and len(want) > 300


def test_stage_keeps_one_of_similar_texts(spark):
    """The pipeline's stage: five-word Jaccard of 0.8 or more, whatever the fingerprints' distance."""
    rng = random.Random(12)
    rows, close = [], 0
    for g in range(40):
        base = [f"x{rng.randrange(10**6)}" for _ in range(300)]
        rows.append((2 * g, " ".join(base)))
        for k in rng.sample(range(300), 5):
            base[k] = "changed"
        rows.append((2 * g + 1, " ".join(base)))
        close += (brute_fingerprint(rows[-1][1]) ^ brute_fingerprint(rows[-2][1])).bit_count() <= 3
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    comp = components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    assert len(set(comp)) <= 45 and close < 30
    rows += [(None, "a clean text of a null id"), (None, "another clean text, null id too"), (None, rows[0][1])]
    got = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = [r.doc_id for r in got if r.doc_id is not None]
    assert len(set(comp)) <= len(kept) <= len(set(comp)) + 2 and {2 * g for g in range(40)} <= set(kept)
    assert sorted(r.text for r in got if r.doc_id is None) == ["a clean text of a null id", "another clean text, null id too"]


def test_stage_keeps_one_of_big_groups(spark):
    """Groups of near texts of which most pairs are below the similarity and are linked by a few."""
    rng = random.Random(15)
    rows = []
    for g in range(3):
        base = [f"y{rng.randrange(10**6)}" for _ in range(60)]
        rows.append((100 * g + 99, " ".join(base)))
        for k in range(50):
            w = list(base)
            for _ in range(1 if k < 40 else 4):
                w[rng.randrange(60)] = f"z{rng.randrange(10**6)}"
            rows.append((100 * g + k, " ".join(w)))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    comp = components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).count()
    assert len(set(comp)) <= kept <= len(set(comp)) + 3 and len(set(comp)) < 40


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(1, k) for k in range(2, 30)] + [(5, 5), (None, 3), (2, 1)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(chain, "src long, dst long")).collect()}
    assert all(got[k] == 100 for k in range(100, 161)) and all(got[k] == 1 for k in range(1, 30)) and len(got) == 61 + 29
    assert common.components(spark.createDataFrame([], "src long, dst long")).count() == 0


PAGES = "page_id long, url string, html string, payload_digest string, refers_to long"


def test_warc(spark, tmp_path):
    html = ["<p>a</p>", "<p>a</p>", "", None, "é\r\n\r\nWARC/1.1\r\nx", "<p>b</p>", "<p>a</p>", "x" * 300_000]
    rows = [(10 - i, f"http://h/{i}\r\ny" if i % 2 else None, t, "no", 1) for i, t in enumerate(html)]
    rows += [rows[5], (None, "u", "<p>a</p>", None, None), (None, "u", "only null", None, None)]
    pages = spark.createDataFrame(rows, PAGES)
    got = warc.archived(pages).collect()
    assert len(got) == len(rows)
    first = {}
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        first.setdefault((r[2] or "").encode(), r[0])
    seen = collections.Counter()
    for r in got:
        seen[r.page_id, r.record_type] += 1
        if r.page_id is not None:
            payload = next((x[2] or "").encode() for x in rows if x[0] == r.page_id)
            assert r.payload_bytes == len(payload)
            assert r.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
            assert (r.record_type == "response") == (r.refers_to is None)
            if r.record_type == "revisit":
                assert r.refers_to == first[payload]
            else:
                assert first[payload] == r.page_id
    assert seen[5, "response"] == seen[5, "revisit"] == 1  # a repeated row revisits its page
    assert seen[None, "revisit"] == seen[None, "response"] == 1
    small = {r.page_id: r.record_type for r in warc.archived(pages.where("page_id is not null"), least=3).collect()}
    assert small[7] == small[8] == "response"  # two empty payloads below the least size
    assert warc.archived(spark.createDataFrame([], PAGES)).count() == 0


def _token_lists(rows):
    return [WORD.findall((r.text or "").encode().lower()) + [b"\n"] for r in rows]


def _held(rows):
    return [r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 10 == 0 for r in rows]


def brute_tree(toks, held, depth=3, least=2, gain=1.0, p_min=1e-6):
    """(probability of a symbol after a context, log10 score of each text) of the suffix tree, context by context."""
    counts = collections.Counter(w for t, h in zip(toks, held, strict=True) if not h for w in t)
    n, v = sum(counts.values()), len(counts)
    whole, common = n + 0.1 * (v + 1), {w for w, c in counts.items() if c >= p_min * n or w == b"\n"}
    n_rare = v - len(common) + 1
    rare = (sum(c for w, c in counts.items() if w not in common) + 0.1 * n_rare) / whole / n_rare
    after = collections.defaultdict(collections.Counter)
    context = lambda t, i, k: tuple(t[i - j] if i >= j else None for j in range(1, k + 1))
    for t, h in zip(toks, held, strict=True):
        if not h:
            for i, w in enumerate(t):
                for k in range(1, depth + 1):
                    after[context(t, i, k)][w] += 1
    states = set()

    def p(c, w):
        if not c:
            return (counts[w] + 0.1) / whole if w in common else rare
        if c not in states:
            return p(c[:-1], w)
        own = after[c]
        return (own[w] + len(own) * p(c[:-1], w)) / (own.total() + len(own))

    for k in range(1, depth + 1):
        for c in [c for c in after if len(c) == k]:
            own = after[c]
            won = sum(x * math.log(x / own.total() / p(c[:-1], w)) for w, x in own.items())
            if own.total() >= least and won > gain * len(own):
                states.add(c)
    return p, counts, states, [sum(math.log10(p(context(t, i, depth), w)) for i, w in enumerate(t)) for t in toks]


def test_suffix_tree(docs, none):
    rows = docs.collect()
    toks, held = _token_lists(rows), _held(rows)
    p, counts, _, want_score = brute_tree(toks, held)
    n, v = sum(counts.values()), len(counts)
    base = lambda t: sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
    want = [(-1 if r.doc_id is None else r.doc_id, h, len(t), sum(counts[w] > 0 for w in t), n, base(t), s) for r, h, t, s in zip(rows, held, toks, want_score, strict=True)]
    order = lambda r: (r[0], r[2], r[5])

    def compare(want, **parameters):
        got = sorted(((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in suffix_tree.scores(docs, **parameters).collect()), key=order)
        for g, w in zip(got, sorted(want, key=order), strict=True):
            assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-5)

    compare(want)
    # the head (contexts too large for a part) says the same where no entry is too rare for it
    compare(want, part_tokens=40)
    # rare words share a probability without context; their counts come from the parts
    compare([(*w[:6], s) for w, s in zip(want, brute_tree(toks, held, p_min=1e-3)[3], strict=True)], p_min=1e-3)
    compare([(*w[:6], s) for w, s in zip(want, brute_tree(toks, held, depth=1, least=5, gain=0.5)[3], strict=True)], depth=1, least=5, gain=0.5)
    got = suffix_tree.scores(docs, p_min=1e-2, part_tokens=40).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_known, round(r.base_score, 6)) for r in got) == sorted((w[0], w[3], round(w[5], 6)) for w in want)
    assert suffix_tree.scores(none).count() == 0


def test_suffix_tree_distributions_sum_to_one_and_learn(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("ab cd ef".split()[k % 3] if rng.random() < 0.9 else f"w{rng.randrange(50)}" for k in range(60))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    rows = df.collect()
    toks, held = _token_lists(rows), _held(rows)
    p, counts, states, _ = brute_tree(toks, held)
    assert {(b"ab",), (b"cd",), (b"ef",)} <= states and any(len(c) > 1 for c in states)
    for c in [*sorted(states, key=repr)[:20], (), (b"never",)]:
        assert sum(p(c, w) for w in [*counts, b"unseen"]) == pytest.approx(1, abs=1e-9)
    # A head with few entries leaves the rest to the unigrams and still sums to one.
    model = suffix_tree.learn_head(df, 10, 0, 3, 2, 1.0, 0.01, 500)
    assert len(model.levels) == 3 and all(level[1].any() for level in model.levels[:1])
    symbols = np.append(np.arange(1, len(model.counts), dtype=np.uint64), np.uint64(suffix_tree.RARE))
    n_rare = model.distinct - (len(model.counts) - 1) + 1
    for k, level in enumerate(model.levels, 1):
        for c in level[0][:5].tolist():
            words = [np.full(len(symbols), c >> 20 * (k - 1 - i) & ((1 << 20) - 1), dtype=np.uint64) for i in range(k)]
            q = np.exp(model.head_log(words, symbols, np.full(len(symbols), k)))
            assert q[:-1].sum() + n_rare * q[-1] == pytest.approx(1, abs=1e-9)
    got = [r for r in suffix_tree.scores(df).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got) + 100


def test_suffix_tree_keeps_contexts_that_are_a_small_share(spark):
    """Contexts and entries that occur a few times, and contexts of three words, count."""
    rng = random.Random(2)
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]
    phrase = "p q r s t u"
    rows = [(i, sentence(rng, 40, 30) + (f" {phrase}" if i % 40 == 1 and i not in held else "")) for i in range(400)]
    rows[held[0]] = (held[0], phrase)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in suffix_tree.scores(df, p_min=0.05).collect()}  # the phrase is far below this share
    assert got[held[0]].score > got[held[0]].base_score + 6


def test_licenses(spark, none):
    low = lambda t: t.lower() if t.isascii() else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    rng = random.Random(2)
    said = ["Under the MIT License", "Apache License, Version 2.0", "CC BY-NC 4.0", "under the mit", "licensed under the license"]
    rows = [(i, f"{sentence(rng, 8)}. {rng.choice(said)} {rng.choice(said)}.\n{rng.choice(said)}", "x") for i in range(40)]
    notice = "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    rows += [(90, "", None), (91, None, None), (92, "mit", None), (93, f"x {notice} y", None), (94, notice.replace("free of charge", "gratis and free of any charge"), None), (94, "CC BY NC", None), (None, "cc by nc", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, template string")
    got = licenses.scan(df).collect()
    words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    want = []
    for i, t, _ in rows:
        w, at, labels = words.findall(low(t or "")), [], set()
        for p, label in licenses.PHRASES.items():
            q = p.split()
            hits = [k for k in range(len(w)) if w[k : k + len(q)] == q]
            at += hits
            labels |= {label} if hits else set()
        want.append((-1 if i is None else i, len(w), len(at), min(at, default=-1), max(at, default=-1), ",".join(sorted(labels))))
    one = lambda x: -1 if x is None else x
    assert sorted((one(r.doc_id), r.n_words, r.n_base, one(r.first_word), one(r.last_word), r.base_labels) for r in got) == sorted(want)
    by = {r.doc_id: r for r in got}
    assert by[93].labels == "mit" and by[93].score == 1.0 and by[93].spans[0].start == 1
    assert all(set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1 for r in got)
    assert licenses.scan(none).count() == 0


def test_license_notices_with_words_put_in_and_repeated(spark):
    """Each notice by itself gives its own label alone, with words of its beginning or end repeated
    around it and with words put in; texts of other words give none."""
    rng = random.Random(11)
    rows, want = [], {}
    for n, (notice, label) in enumerate(licenses.NOTICES.items()):
        words = notice.split()
        made = [words, words[:2] * 4 + words, words[:2] * 40 + words, words + words[-2:] * 30, words[:3] * 12 + words]
        for k in range(1, 4):
            w = list(words)
            for _ in range(1 if len(words) < 30 else k):
                w.insert(rng.randrange(len(w) // 3, len(w) - len(w) // 3), "zz")
            made.append(w if len(words) >= 12 else words)
        for k, w in enumerate(made):
            rows.append((100 * n + k, " ".join([*sentence(rng, 30).split(), *w, *sentence(rng, 30).split()])))
            want[rows[-1][0]] = label
    two = [next(k for k, own in licenses.NOTICES.items() if own == label) for label in ("isc", "gpl")]
    rows += [(9000, " ".join(two)), (9001, sentence(rng, 20_000)), (9002, " ".join(["permission", "is", "hereby"] * 3000)), (9000, None)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = {r.doc_id: r for r in got if r.n_words}
    wrong = {i: (by[i].labels, label) for i, label in want.items() if set(by[i].labels.split(",")) - set(by[i].base_labels.split(",")) - {label} or label not in by[i].labels.split(",")}
    assert not wrong
    assert set(by[9000].labels.split(",")) == {"isc", "gpl"} and by[9001].labels == by[9002].labels == ""
    for r in by.values():
        spans = sorted((x.start, x.length) for x in r.spans)
        assert all(a + n <= b + n // 2 for (a, n), (b, _) in zip(spans, spans[1:], strict=False))


def test_benchmark(spark, docs, none):
    rng = random.Random(8)
    items = [sentence(rng, n, 5000) for n in (5, 3, 14, 20, 37, 37, 59)]
    bench = spark.createDataFrame([*((i, t, "x") for i, t in enumerate(items)), (20, None, "x"), (21, "", "x"), (22, items[3], "x"), (None, items[6], "x")], "item_id long, text string, start string")
    cut = items[4].split()
    rows = [(i, f"{sentence(rng, 40, 5000)} {t} {sentence(rng, 40, 5000)}") for i, t in enumerate(items)]
    rows += [(30, items[4].upper().replace(" ", ", ")), (31, " ".join(cut[:34])), (32, " ".join(cut[:20])), (33, sentence(rng, 500, 5000)), (34, None), (35, ""), (36, " ".join([*cut[:18], "zz", *cut[19:]])), (30, "again"), (None, items[2])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    grams = lambda w, k: collections.Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))
    want = {}
    for i, t in rows:
        w = licenses.words_of((t or "").encode())
        for r in bench.collect():
            q = licenses.words_of((r.text or "").encode())
            if q and w:
                k, n = min(5, len(q)), min(len(q), len(w))
                best = max(((x & y).total() / (x | y).total() for s in range(len(w) - n + 1) for x, y in [(grams(w[s : s + n], k), grams(q, k))]), default=0)
                if best >= 0.8:
                    want[i, r.item_id] = max(best, want.get((i, r.item_id), 0))
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(df, bench).collect()}
    assert got == pytest.approx(want) and len(want) >= 12
    parts = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(df, bench, part_bytes=300).collect()}
    assert parts == got
    assert {r.doc_id for r in decontaminate.clean(df, bench).collect()} == {r[0] for r in rows} - {k[0] for k in got}
    assert decontaminate.contaminated(none, bench).count() == 0
    assert decontaminate.contaminated(docs, bench.where("item_id = 21")).count() == 0


def test_stages_reject_rows_not_ids(spark):
    """Of rows of one id, or of none, those with a leak or without letters go and the others stay."""
    leak = "one two three four five six seven eight nine ten eleven twelve"
    clean_ = [(k, f"the cat and the dog of the {w}") for k in (None, 7) for w in ("house", "garden")]
    bench = spark.createDataFrame([(1, leak)], "item_id long, text string")
    df = spark.createDataFrame([*clean_, (None, f"a {leak} b"), (7, leak), (7, leak)], "doc_id long, text string")
    key = lambda r: (r[0] or 0, r[1])
    assert sorted(map(tuple, decontaminate.clean_rows(df, bench).collect()), key=key) == sorted(clean_, key=key)
    rows = [(*r, "en") for r in clean_] + [(None, "12 34", "en"), (7, "...", "en"), (None, None, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(((r.doc_id, r.text) for r in language.accepted(df).collect()), key=key) == sorted(clean_, key=key)


def test_multi_index_finds_all_within_radius():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    b = np.concatenate([a ^ np.uint64(k) for k in (0, 1, 7, 0xFFF, 0xFFFFF)])
    for radius in (0, 3, 12):
        i, j = decontaminate.within(a, b, radius)
        want = {(x, y) for x in range(len(a)) for y in range(len(b)) if int(a[x] ^ b[y]).bit_count() <= radius}
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == want


def brute_removed(rows, size=6, least=0.8):
    places = collections.defaultdict(set)
    for i, t in rows:
        if t is not None:
            tid = t
            for k, line in enumerate(t.split("\n")):
                if line.strip(" "):
                    places[line].add((i is None, i, tid, k))
    names = list(places)
    sets = [{x[i : i + size] for i in range(max(1, len(x) - size + 1))} for x in names]
    comp = components(len(names), [(i, j) for i in range(len(names)) for j in range(i) if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])])
    return names, places, comp


def test_lines(spark, docs, none):
    rng = random.Random(4)
    pool = [sentence(rng, rng.randrange(1, 40)) for _ in range(60)]
    near = [" ".join([*p.split()[:-1], "q"]) for p in pool[:25]]
    rows = [(i, "\n".join(rng.choice(pool + near + ["", "  ", "}"]) for _ in range(rng.randrange(1, 8)))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, sentence(rng, 9000)), (104, pool[0]), (104, pool[0]), (None, pool[1]), (None, "a line of a null id")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, component string")
    got = lines.decisions(df).collect()
    assert len(got) == len(rows)
    names, places, comp = brute_removed(rows)
    kept = collections.Counter()
    number = {n: c for n, c in zip(names, comp, strict=True)}
    texts_ = collections.defaultdict(list)
    for i, t in rows:
        texts_[i].append(t)
    for r in got:
        t = texts_[r.doc_id][0] if r.doc_id != 104 else pool[0]
        if r.doc_id is None:
            continue
        parts = (t or "").split("\n") if t is not None else []
        assert r.n_lines == len(parts)
        for k, line in enumerate(parts):
            if not line.strip(" "):
                assert k not in r.removed
            elif k not in r.removed:
                kept[number[line]] += 1
    assert all(n == 1 for c, n in kept.items())  # nothing of a component stays twice
    firsts = {c: min(p for n in names if number[n] == c for p in places[n]) for c in set(comp)}
    assert sum(f[1] is not None for f in firsts.values()) == sum(kept.values())
    clean = {r.doc_id: r for r in lines.without_duplicates(df.where("doc_id < 100")).collect()}
    assert set(clean) == set(range(80))
    assert lines.decisions(none).count() == 0


def test_big_groups_of_near_lines_stay_whole(spark):
    rng = random.Random(9)
    base = sentence(rng, 60, 5000).split()
    rows = []
    for i in range(150):
        w = list(base)
        for k in rng.sample(range(60), 2):
            w[k] = f"u{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = lines.decisions(spark.createDataFrame(rows, "doc_id long, text string"))
    names, _, comp = brute_removed(rows)
    assert got.where("n_removed = 0").count() == len(set(comp))


def test_repetitive_lines_meet(spark):
    """Lines of equal sets of runs are found however often the runs repeat, and however few there are."""
    rng = random.Random(8)
    words = sentence(rng, 40, 5000)[:131] + " "
    groups = [[words * 2, words * 4, words * 9], ["-" * 100, "-" * 1000, "-" * 7], ["ha " * 40, "ha " * 300], ["| 0 " * 30, "| 0 " * 99]]
    rows = [(10 * g + k, line) for g, own in enumerate(groups) for k, line in enumerate(own)]
    got = lines.decisions(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got if r.n_removed == 0} == {0, 10, 20, 30}


def test_language(spark, none):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(10**6, None, "en"), (10**6 + 1, "", "en"), (10**6 + 2, "123 ... 456", "de"), (10**6 + 3, "ab" * 20_000, None), (None, "the of and", None)]
    more = df.select("doc_id", "text", "lang").union(spark.createDataFrame(extra, "doc_id long, text string, lang string")).withColumn("score", F.lit("x"))
    got = language.identify(more)
    rows = {r.doc_id: r for r in got.collect()}
    assert got.count() == df.count() + 5 and all(0 <= r.score <= 1 for r in rows.values())
    assert all(rows[10**6 + k].lang_pred == "und" for k in (0, 1, 2)) and rows[10**6 + 3].lang_pred != "und"
    real = {r.doc_id: r.lang for r in df.collect()}
    held = [r for r in rows.values() if r.held_out and r.doc_id in real]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows.values() if r.doc_id is not None)
    assert sum(r.lang_pred == real[r.doc_id] for r in held) >= 0.97 * len(held)
    # neither lang nor source of what is predicted matters
    again = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(more.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2, F.col("lang")))).collect()}
    assert again == {k: (r.lang_pred, r.score) for k, r in rows.items()}
    assert language.identify(none).count() == 0
    assert {r.doc_id for r in language.accepted(more).collect()} >= set(real)
    assert {r.lang_pred for r in language.identify(more.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_without_spaces(spark):
    """Texts of one long token teach, too: three languages whose words are not parted."""
    rng = random.Random(6)
    own = {"de": "und nicht eine werden durch zwischen", "en": "the and that with which through", "fr": "les vous dans pour avec toujours"}
    rows = [(3 * i + k, "".join(rng.choice(words.split()) for _ in range(rng.choice([25, 60, 400]))), lang) for i in range(40) for k, (lang, words) in enumerate(own.items())]
    got = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    lang = {i: k for i, _, k in rows}
    assert all(r.lang_pred == lang[r.doc_id] and r.score > 0.99 for r in got)


def test_long_texts_and_repeated_rows(spark):
    """Texts of tens of thousands of words are searched to their ends; equal rows come back each."""
    rng = random.Random(13)
    item = sentence(rng, 30, 5000)
    notice = next(k for k, v in licenses.NOTICES.items() if v == "isc")
    far = f"{sentence(rng, 60_000, 5000)} {item} under the MIT license {notice}"
    df = spark.createDataFrame([(1, far, "en"), (2, item, "en"), (2, item, "en"), (3, notice, "de"), (3, notice, "de")], "doc_id long, text string, lang string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contaminated(df, bench).collect()}
    assert set(got) == {1, 2} and got[1].start == 60_000 and got[1].similarity == 1.0
    assert [r.doc_id for r in decontaminate.clean_rows(df, bench).collect()] == [3, 3]
    found = licenses.scan(df).collect()
    assert len(found) == 5 and sum(r.labels == "isc" for r in found if r.doc_id == 3) == 2
    one = next(r for r in found if r.doc_id == 1)
    assert one.labels == "isc,mit" and one.first_word == 60_030 and one.spans[0].start >= 60_034
    said = language.identify(df).collect()
    assert sorted(r.doc_id for r in said) == [1, 2, 2, 3, 3]
    assert len({(r.lang_pred, r.score) for r in said if r.doc_id == 2}) == 1


def test_expected_counts_of_long_words():
    names = ("▁a", "▁ab", "b", "c", "bc", "▁", "a", "abca")
    index, size = language.Pieces(names), np.array([len(n) for n in ("▁a", "▁ab", "b", "c", "bc", "▁", "a", "abca", "?")])
    p = np.random.default_rng(2).random((len(names) + 1, 2)) * 1e-4
    words = ["▁" + "abc" * 4000, "▁" + "abc" * 3 + "x", "▁", "▁" + "a" * 49, "▁" + "ab" * 30]
    got = language.expected_counts(words, np.ones((len(words), 1)), index, p)
    assert size @ got == pytest.approx(np.full(2, sum(map(len, words))), rel=1e-9)


def test_forward_sums_all_segmentations():
    names = ("▁a", "▁ab", "b", "c", "bc", "▁", "a")
    index = language.Pieces(names)
    rng = np.random.default_rng(1)
    p = rng.random((len(names) + 1, 2))

    def brute(word, k):
        if not word:
            return 1.0
        total = 0.0
        for n in range(1, len(word) + 1):
            if word[:n] in names:
                total += p[names.index(word[:n]), k] * brute(word[n:], k)
            elif n == 1:
                total += p[-1, k] * brute(word[1:], k)
        return total

    words = ["▁abc", "▁ab", "▁xbc", "▁abcabcabcabc", "▁"]
    got = language.word_scores(words, index, p)
    for w, row in zip(words, got, strict=True):
        assert row == pytest.approx([math.log(brute(w, 0)), math.log(brute(w, 1))])
    counts = language.expected_counts(["▁abc"], np.ones((1, 1)), index, p[:, :1])
    assert counts[[names.index("b"), names.index("c"), names.index("bc")], 0].sum() == pytest.approx(
        (2 * p[0, 0] * p[2, 0] * p[3, 0] + p[0, 0] * p[4, 0] + p[1, 0] * p[3, 0] + p[5, 0] * p[6, 0] * (2 * p[2, 0] * p[3, 0] + p[4, 0])) / brute("▁abc", 0))


def test_substrings(spark, docs, none):
    rng = random.Random(6)
    shared = sentence(rng, 50).split()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows += [(200 + k, " ".join([*sentence(rng, 20).split(), *shared[a:b], *sentence(rng, 20).split()])) for k, (a, b) in enumerate([(0, 50), (5, 40), (0, 34), (10, 50), (0, 35)])]
    rows += [(300, " ".join(["la"] * 80)), (301, " ".join(shared * 3))]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, block string")
    split = [WORD.findall((t or "").encode()) for _, t in rows]
    count = collections.Counter(tuple(w[i : i + 35]) for w in split for i in range(len(w) - 34))
    want = []
    for (i, _), w in zip(rows, split, strict=True):
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - 34):
            if count[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = True
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want.append((-1 if i is None else i, len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    got = substrings.parse(df).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(want)
    for r in got:
        covered = {k for s in r.spans for k in range(s.start, s.start + s.length)}
        assert len(covered) == r.n_removed and all(s.length >= 35 for s in r.spans)
        assert len(r.kept_text.split()) >= 0
    # Every factor stands, word for word, at another place, the one that it names.
    words = {}
    for (i, _), w in zip(rows, split, strict=True):
        words.setdefault(i, []).append(w)
    n = 0
    for r in got:
        for s in r.spans:
            n += 1
            own = [w[s.start : s.start + s.length] for w in words[r.doc_id]]
            ref = [w[s.ref_start : s.ref_start + s.length] for w in words[s.ref_doc_id]]
            assert any(x == y and len(x) == s.length for x in own for y in ref)
            assert (s.ref_doc_id, s.ref_start) != (r.doc_id, s.start) or len(own) > 1
    assert n > 10
    few = substrings.parse(df, block_bytes=2000, range_words=500, with_text=False).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in few) == sorted(want)
    assert substrings.parse(none).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 8))
    x = np.concatenate([base, base[:10] + rng.normal(size=(10, 8)) * 0.3, base[:5] * 3, np.repeat(base[:1], 30, 0) + rng.normal(size=(30, 8)) * 0.2]).astype(np.float32)
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)]
    bad = [None, [], [0.0] * 8, [float("nan")] + [1.0] * 7, [float("inf")] + [1.0] * 7, [None] + [1.0] * 7]
    rows += [(200 + i, v, None) for i, v in enumerate(bad)] + [(300, [1.0, 0.0], 1), (301, [2.0, 0.1], 1), (3, rows[3][1], 1), (None, rows[3][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int")
    ok = [i for i, r in enumerate(rows) if r[0] is not None and r[1] and all(v is not None and math.isfinite(v) for v in r[1]) and any(r[1])]
    links = []
    for i in ok:
        for j in ok:
            if i < j and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1]), np.array(rows[j][1])
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.9:
                    links.append((i, j))
    comp = components(len(rows), links)
    n = collections.Counter(k for p in links for k in p)
    low = {}
    for i, c in enumerate(comp):
        if rows[i][0] is not None:
            low[c] = min(low.get(c, rows[i][0]), rows[i][0])
    want = sorted((-1 if r[0] is None else r[0], n[i], -1 if r[0] is None else low[comp[i]]) for i, r in enumerate(rows))
    for chunk in (8192, 16):
        got = embeddings.near_duplicates(df, chunk=chunk).collect()
        assert sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, -1 if r.component_id is None else r.component_id) for r in got) == want
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_mixing(spark, docs, none):
    got = mixing.mix(docs).collect()
    rows = docs.collect()
    assert len(got) == len(rows)
    size = lambda t: len(WORD.findall((t or "").encode()))
    sizes = collections.Counter()
    for r in rows:
        sizes[r.source] += size(r.text)
    names = [*sorted(s for s in sizes if s is not None), None]
    left, goal, free = 1.5 * sum(sizes.values()), {}, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    while free:
        full = [s for s in free if left * free[s] / sum(free.values()) > 2 * sizes[s]]
        if not full:
            goal |= {s: left * w / sum(free.values()) for s, w in free.items()}
            break
        for s in full:
            goal[s] = 2 * sizes[s]
        left -= sum(goal[s] for s in full)
        free = {s: w for s, w in free.items() if s not in full}
    taken = collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(goal[r.source]) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - goal[s]) <= 0.02 * goal[s] + 300 for s in names)
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda r: (-1 if r.doc_id is None else r.doc_id, r.size, r.taken)
    assert sorted(map(key, again)) == sorted(map(key, got))
    assert mixing.mix(none).count() == 0


def test_sainte_lague_by_single_seats():
    rng = random.Random(1)
    for _ in range(30):
        votes = np.array([rng.choice([0, rng.randrange(1, 1000)]) for _ in range(6)])
        most = np.array([rng.randrange(1, 40) for _ in range(6)])
        seats = rng.randrange(0, 80)
        want = np.zeros(6, dtype=int)
        for _ in range(min(seats, int(most[votes > 0].sum()))):
            q = [v / (2 * g + 1) if v and g < m else -1 for v, g, m in zip(votes, want, most, strict=True)]
            want[int(np.argmax(q))] += 1
        got = mixing.sainte_lague(votes, seats, most)
        quotient = lambda s: sorted(v / (2 * k + 1) for v, n in zip(votes, s, strict=True) for k in range(n))
        assert quotient(got) == pytest.approx(quotient(want))  # equal up to ties


def test_queries_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))
