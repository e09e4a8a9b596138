"""Cases that once went wrong: links over rows without an id, long words, learning from rows without an id,
licenses that differ by a word, mixtures block by block, a tree that a part's size changed, a stage without its method."""

import collections
import pathlib
import random
import re
import time
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_operators import _held, _token_lists, brute_fingerprint, brute_tree, components, sentence

from methloom.llm import common, embeddings, language, licenses, lines, mixing, simhash, suffix_tree


def test_links_over_a_fingerprint_without_id(spark, monkeypatch):
    """Fingerprints 0, 7 and 63: the middle one, which only a row without an id has, joins the others."""
    prints = spark.createDataFrame([(5, 0), (3, 63), (None, 7), (None, 7), (9, -1), (None, -2), (None, 1 << 62), (-4, 1 << 40)], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs: docs)
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(prints).collect()}
    alone = {(-4, f"{1 << 40:016x}"): -4}
    assert got[5, f"{0:016x}"] == got[3, f"{63:016x}"] == got[None, f"{7:016x}"] == min(3, -4)
    assert {k: got[k] for k in alone} == alone and got[9, "f" * 16] == got[None, "f" * 15 + "e"] == 9
    assert got[None, f"{1 << 62:016x}"] == -4  # two bits from 1 << 40


@pytest.fixture(scope="module")
def index():
    rng = np.random.default_rng(1)
    names = sorted({"".join(rng.choice(list("abc")) for _ in range(rng.integers(1, 7))) for _ in range(120)} | {language.MARK + "a", "a", "b"})
    p = rng.random((len(names) + 1, 3))
    return language.Pieces(tuple(names)), p / p.sum(axis=0)


@pytest.mark.parametrize("together", [1, 5, 6, 37, 100])
def test_long_words_lose_no_segmentation(index, monkeypatch, together):
    pieces, p = index
    rng = np.random.default_rng(together)
    words = [language.MARK + "".join(rng.choice(list("abcx")) for _ in range(n)) for n in (1, 36, 99, 100, 101, 400)]
    weights = rng.random((len(words), 1)) + 0.5
    scores, counts = language.word_scores(words, pieces, p), language.expected_counts(words, weights, pieces, p)
    monkeypatch.setattr(language, "TOGETHER", together)
    assert language.word_scores(words, pieces, p) == pytest.approx(scores, rel=1e-10)
    assert language.expected_counts(words, weights, pieces, p) == pytest.approx(counts, rel=1e-8, abs=1e-12)


def test_learns_from_rows_without_an_id(spark):
    rows = [(None, f"der die und {i}", "de") for i in range(300)] + [(None, f"the of and {i}", "en") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, p = language.learn(docs, language.vocabulary(), most_docs=50)
    assert langs == ["de", "en"] and abs(p[:, 0] - p[:, 1]).max() > 0.01
    got = language.identify(spark.createDataFrame([(1, "the and of"), (2, "und die der")], "doc_id long, text string").withColumn("lang", F.lit(None).cast("string")).unionByName(docs), most_docs=50)
    assert {r.doc_id: r.lang_pred for r in got.where("doc_id is not null").collect()} == {1: "en", 2: "de"}


def test_telling_words(spark):
    """No license's text gives the label of another one that differs by a word."""
    said = "This work is licensed under a Creative Commons Attribution{} 4.0 International License."
    kinds = {"": "cc-by", "-ShareAlike": "cc-by-sa", "-NonCommercial": "cc-by-nc", "-NoDerivatives": "cc-by-nd", "-NonCommercial-ShareAlike": "cc-by-nc-sa", "-NonCommercial-NoDerivatives": "cc-by-nc-nd"}
    rows = [(i, said.format(k), v) for i, (k, v) in enumerate(kinds.items())]
    rows += [(100 + i, t, v) for i, (t, v) in enumerate(licenses.NOTICES.items())]
    gpl = next(t for t, v in licenses.NOTICES.items() if v == "gpl")
    rows += [(200, gpl.replace("gnu general", "gnu affero general"), "agpl"), (202, gpl.replace("this program", "frob"), "gpl"),
             (203, "licensed under a Creative Commons Attribution 3.0 Unported License", "cc-by"), (204, "Distributed under the Boost Software License, Version 1.0.", "boost"), (205, gpl[: len(gpl) // 2], None)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")).collect()}
    wrong = {}
    for i, text, label in rows:
        own = set(got[i].labels.split(",")) - set(got[i].base_labels.split(",")) - {""}
        if label is not None and own - ({label} - {""}) or (label and label not in got[i].labels.split(",")):
            wrong[i] = (text, label, got[i].labels)
    assert not wrong


def places_of(spark, docs, n_shards, seed=1):
    """Rows of ``docs`` on their shards' lines: {(source, shard): [(doc_id, size), ...]} in the seeded order."""
    word = re.compile(rb"[^\x20\x09-\x0D]+")
    shard = F.pmod(F.xxhash64("doc_id", F.xxhash64("text"), F.lit(seed)), F.lit(n_shards)).cast("int")
    rows = docs.select("doc_id", "text", "source", shard.alias("shard"), F.xxhash64("doc_id", F.lit(seed + 1)).alias("h")).collect()
    lines = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.h, r.doc_id)):
        lines[r.source, r.shard].append((r.doc_id, len(word.findall((r.text or "").encode()))))
    return lines


@pytest.mark.parametrize("shard_docs", [20_000, 40])
def test_mixing_takes_the_blocks_it_chose(spark, shard_docs):
    """``taken`` of every document, block by block: quotas by single seats, blocks by the spread walk."""
    rng, most, block = random.Random(4), 2, 32
    docs = spark.createDataFrame(
        [(i, " ".join("w" * rng.randrange(0, 90)) if i % 9 else None, rng.choice(["a", "b", "b", "b", "c", "", None])) for i in range(400)],
        "doc_id long, text string, source string",
    )
    got = {r.doc_id: r for r in mixing.mix(docs, shard_docs=shard_docs).collect()}
    lines = places_of(spark, docs, max(8, -(-400 // shard_docs)))
    shards = {key: sum(size for _, size in own) for key, own in lines.items()}
    names = sorted({k[0] for k in lines if k[0] is not None}) + [None]
    size, blocks = collections.Counter(), collections.Counter()
    for (source, _), n in shards.items():
        size[source] += n
        blocks[source] += -(-n // block)
    goal = mixing.targets([size[s] for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))])
    votes = [g * blocks[s] / size[s] for g, s in zip(goal, names, strict=True)]
    seats = by_single_seats(votes, round(sum(votes)), [most * blocks[s] for s in names])
    starts = {(r.source, r.shard): r.c for r in spark.createDataFrame([(*k, max(-(-n // block), 1)) for k, n in shards.items()], "source string, shard int, n long")
              .select("source", "shard", F.pmod(F.xxhash64("source", "shard", F.lit(1)), "n").alias("c")).collect()}
    for s, n in zip(names, seats, strict=True):
        own = sorted((k for k in shards if k[0] == s), key=lambda k: k[1])
        for key, quota in zip(own, by_single_seats([shards[k] for k in own], n, [most * -(-shards[k] // block) for k in own]), strict=True):
            whole, rest = divmod(quota, max(-(-shards[key] // block), 1))
            n_blocks, at = max(-(-shards[key] // block), 1), 0
            walk = [(i + starts[key] + 1) * rest // n_blocks - (i + starts[key]) * rest // n_blocks for i in range(n_blocks)]
            assert sum(walk) == rest
            for doc, n_words in lines[key]:
                want = whole * n_words + sum(walk[t // block] for t in range(at, at + n_words))
                assert (got[doc].size, got[doc].taken) == (n_words, want)
                at += n_words


def by_single_seats(votes, seats, most):
    """Highest quotients one at a time, equal ones by position."""
    out = [0] * len(votes)
    for _ in range(min(seats, sum(m for v, m in zip(votes, most, strict=True) if v > 0))):
        quotient = [Fraction(v) / (2 * g + 1) if g < m else -1 for v, g, m in zip(votes, out, most, strict=True)]
        out[quotient.index(max(quotient))] += 1
    return out


def test_quotas_of_shards_are_exact(spark):
    """Ties without end, caps that bind, empty shards, sources without seats: as by single seats."""
    rng = random.Random(9)
    tokens = {0: [64] * 50, 1: [rng.randrange(1, 500) for _ in range(40)], 2: [0] * 5, 3: [1] * 30 + [10_000], 4: [7], 5: [rng.choice([0, 1, 33]) for _ in range(60)]}
    seats = {0: 173, 1: 211, 2: 0, 3: 600, 4: 2, 5: 41}
    rows = [(k, i, t, -(-t // 32)) for k, own in tokens.items() for i, t in enumerate(own)]
    shards = spark.createDataFrame(rows, "k int, shard int, tokens long, blocks long")
    got = {(r.k, r.shard): r.quota for r in mixing.quotas(shards, seats, 2).collect()}
    for k, own in tokens.items():
        assert [got[k, i] for i in range(len(own))] == by_single_seats(own, seats[k], [2 * -(-t // 32) for t in own]), k


def test_vectors_of_many_lengths(spark):
    """Each length links its own vectors; a vector alone in its length links with its copies only."""
    rng = np.random.default_rng(3)
    rows = []
    for n in range(1, 7):
        base = rng.normal(size=(3, n))
        rows += [(10 * n + i, v.tolist()) for i, v in enumerate([*base, base[0] * 2 + 1e-3])]
    rows += [(100, [1.0] * 9), (101, [1.0] * 9), (102, [1.0] * 12), (103, []), (104, None)]
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    vectors = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v}
    for i, _ in rows:
        near = [j for j in vectors if i in vectors and j != i and len(vectors[j]) == len(vectors[i]) and vectors[i] @ vectors[j] >= 0.9]
        assert got[i].n_links == len(near), i
    assert got[101].component_id == 100 and got[102].kept and got[104].kept


def test_sets_of_near_sizes_share_a_size_class(spark):
    """Any two sizes of a ratio of 0.8 or more have a class in common, exact ratios (4 and 5) too; far ones have none."""
    from methloom.llm import lines

    sets = spark.range(1, 401).selectExpr("id", "sequence(1, int(id)) as runs")
    one = {r.id: r.size_class for r in lines._classed(sets, 0.8, False).select("id", "size_class").collect()}
    near = {}
    for r in lines._classed(sets, 0.8, True).select("id", "size_class").collect():
        near.setdefault(r.id, set()).add(r.size_class)
    for a in range(1, 401):
        for b in range(1, 401):
            if min(a, b) * 5 >= max(a, b) * 4:
                assert one[b] in near[a], (a, b)
            elif max(a, b) > 3 * min(a, b):
                assert one[b] not in near[a], (a, b)


def test_maps_of_parities_refuse_no_pair_that_is_similar(spark):
    """Links of buckets are those of brute force, and most sets below the similarity need not be moved to see it."""
    from methloom.llm import lines

    rng, rows = random.Random(4), []
    for family in range(12):
        base = rng.sample(range(10**9), rng.choice([5, 9, 40, 300]))
        for share in (0, 0.02, 0.1, 0.11, 0.12, 0.15, 0.2, 0.3, 0.3, 0.5):
            n = round(share * len(base))
            own = base[: len(base) - n] + rng.sample(range(10**9), n)
            rows.append((len(rows) * 7919 % 1000, family, own))
    # One set without members, one that is not given (a long line's): neither is ever compared here.
    rows += [(2000, 0, []), (2001, 0, None)]
    table = spark.createDataFrame(rows, "lid long, family long, runs array<int>").cache()
    size = {lid: len(own or []) for lid, _, own in rows}
    jaccard = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    links = {(a, b) for a, i, x in rows for b, j, y in rows if a < b and i == j and x and y and 10 * jaccard(x, y) >= 8}
    apart = {(a, b) for a, i, x in rows for b, j, y in rows if a < b and i == j and x and y and 100 * jaccard(x, y) < 65}
    maps = lines._maps(table)
    assert {r.lid: r["size"] for r in maps.collect()} == {lid: n for lid, n in size.items() if n}
    possible = {tuple(r) for r in maps.alias("x").join(maps.alias("y"), F.col("x.lid") < F.col("y.lid")).where(lines._maybe(0.8)).select("x.lid", "y.lid").collect()}
    assert links <= possible and len(apart) > 100 and not apart & possible

    root = {lid: lid for lid in size}
    for _ in rows:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    members = lines.met(table.select("lid", F.lit(0).cast("long").alias("sketch"), F.array("family", F.col("family") + 100).alias("keys")))
    sets = lambda some: some.join(table.select("lid", "runs"), "lid")

    def similar(pairs):
        x, y = (table.select(F.col("lid").alias(c), F.col("runs").alias(f"r{c}")) for c in "ab")
        both = pairs.join(x, "a").join(y, "b").where("size(ra) > 0 and size(rb) > 0")
        return both.where(lines.alike(F.col("ra"), F.col("rb"), 0.8)).select(F.col("a").alias("src"), F.col("b").alias("dst"))

    got = {r.node: r.component for r in lines.grouped(members, similar, sets, 0.8, lambda a, b: F.lit(True)).collect()}
    assert got == {lid: c for lid, c in root.items() if list(root.values()).count(c) > 1}
    table.unpersist()


def test_sets_of_runs_are_made_distinct_outside_of_lambdas(spark):
    """Odd texts have the sets of brute force, in the order of their first runs; what is not per run is compiled, not in a lambda."""
    texts = ["", "short", "abcdef", "abcdefg", "é𝄞 wide 𝄞𝄞", "tick " * 40, "aaaaaaaaaaaa", "\x00\t nul"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, line string")
    out = df.select("id", lines.run_set(F.col("line")).alias("runs"))
    runs = lambda u: [u[2 * i : 2 * i + 12] for i in range(max(1, len(u) // 2 - 5))]
    each = [(i, k, bytearray(r)) for i, t in enumerate(texts) for k, r in enumerate(dict.fromkeys(runs(t.encode("utf-16-be"))))]
    want = collections.defaultdict(list)
    for r in spark.createDataFrame(each, "id long, k long, run binary").select("id", "k", F.hash("run").alias("h")).orderBy("id", "k").collect():
        want[r.id].append(r.h)
    assert {r.id: r.runs for r in out.collect()} == want
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "array_distinct(" in plan and "lambdafunction(array_distinct(" not in plan, plan


def test_written_tables_leave_no_shuffle_files(spark):
    """Tables of buckets come by one shuffle, and its files go with the query that wrote them."""
    folders = [str(d) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    there = lambda: {f.name for d in folders for f in pathlib.Path(d).glob("*/shuffle_*")}
    before, was = there(), spark.conf.get(common.CLEANUP)
    rows = [(lid, lid * 7, [lid // 3, lid // 50, -lid]) for lid in range(2000)]
    members = lines.met(spark.createDataFrame(rows, "lid long, sketch long, keys array<long>"))
    buckets = collections.defaultdict(set)
    for lid, _, keys in rows:
        for key in keys:
            buckets[key].add(lid)
    want = {(k, lid, lid * 7, min(own), min(own) * 7) for k, own in buckets.items() if len(own) > 1 for lid in own}
    got = [tuple(r) for r in members.select("key", "lid", "sketch", "rep", "rep_sketch").collect()]
    assert set(got) == want
    assert spark.conf.get(common.CLEANUP) == was
    for _ in range(50):
        if there() <= before:
            break
        time.sleep(0.1)
    assert there() <= before


def test_words_of_a_batch_are_those_of_each_text():
    texts = [None, b"", b"  One\xa0tWo ", b"C", b"\xc3\x84b C\x0b", b"d\n\n\x0be f\r", b"z" * 31 + b" " + b"Y" * 32 + b" " + b"q" * 100]
    for skipped in range(len(texts) + 1):
        column = pa.array(texts, pa.binary()).slice(skipped)
        words, counts = suffix_tree.split_words(column)
        want = [(t or b"").lower().split() for t in texts[skipped:]]
        assert words.to_pylist() == sum(want, []) and counts.tolist() == [len(w) for w in want]
    words = pa.array([bytes(range(33, 33 + n)) for n in range(80)])
    assert suffix_tree.word_hashes(words).tolist() == [suffix_tree.word_hash(w) for w in words.to_pylist()]
    code, lengths = suffix_tree.Codes(np.sort(suffix_tree.word_hashes(words[:3])), np.array([7, 8, 9])).of(pa.array([b"! a", None]))
    assert lengths.tolist() == [3, 1] and code[2] == code[3] and 7 <= code[0] <= 9 and code[1] >= suffix_tree.RARE


@pytest.mark.parametrize("p_min", [1e-6, 1e-3, 1e-2])
@pytest.mark.parametrize("depth", [1, 3])
def test_suffix_tree_is_the_same_for_parts_of_any_size(spark, p_min, depth):
    """Scores equal the brute-force tree wherever tokens meet, also of next words too rare to be listed with the head."""
    rng = random.Random(21)
    phrases = [sentence(rng, 6, 200) for _ in range(30)]
    rows = [(i, " ".join(rng.choice(phrases) if rng.random() < 0.5 else sentence(rng, 5, 200) for _ in range(rng.randrange(1, 25)))) for i in range(120)]
    df = spark.createDataFrame([*rows, (None, rows[5][1]), (500, None)], "doc_id long, text string")
    rows = df.collect()
    toks, held = _token_lists(rows), _held(rows)
    want = sorted(brute_tree(toks, held, depth=depth, p_min=p_min)[3])
    for part_tokens in (10, 100, 750_000):
        got = sorted(r.score for r in suffix_tree.scores(df, depth=depth, p_min=p_min, part_tokens=part_tokens).collect())
        assert got == pytest.approx(want, rel=1e-5), part_tokens


def test_stage_links_fingerprints_in_radius(spark):
    """The pipeline's stage comes through SimHash: texts at 3 bits or fewer are one, whatever their sets of shingles, also
    in a chain with similar ones; others stay."""
    rng = random.Random(31)
    word = lambda: f"v{rng.randrange(10**6)}"
    rows = []
    for g in range(4):
        block = " ".join(word() for _ in range(30))
        for k in range(12):
            tail = [word() for _ in range(25 + 5 * k)]
            rows.append((100 * g + k, " ".join([block] * 40 + tail)))
        rows.append((100 * g + 50, " ".join([block] * 40 + tail[:-1] + [word()])))
    fps = [brute_fingerprint(t) for _, t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    n = len(rows)
    by_bits = [(i, j) for i in range(n) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    by_sets = [(i, j) for i in range(n) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    comp = components(n, by_bits + by_sets)
    assert any(fps[i] != fps[j] for i, j in set(by_bits) - set(by_sets)) and len(set(comp)) < len(set(components(n, by_sets)))
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({min(rows[j][0] for j in range(n) if comp[j] == c) for c in comp})
