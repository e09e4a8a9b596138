"""Queries that score, fit and test."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.calls import half_up
from ..operators import compare, diff, scoring, sites, windows
from . import fixtures as fx
from .call_queries import UNIT, C
from .registry import query

SITE = ["contig", "pos", "strand"]


def _features(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.select(F.col("vec_id"), F.col("label"), F.slice("embedding", 1, 21).alias("ipd"), F.slice("embedding", 22, 21).alias("pw"), F.concat(F.lit("K"), F.col("label").cast("string")).alias("kmer"))


FEATURES = "(select vec_id, label, embedding[1:21] as ipd, embedding[22:42] as pw from embeddings) e"


@query(f"""select vec_id, 50 as n, floor((list_sum(list_transform(range(0, 21), lambda i: ipd[i + 1]::double * (i + 9))) + list_sum(list_transform(range(0, 21), lambda i: pw[i + 1]::double * (i + 30))) + 2 + 5) * 1e4 + 0.5) / 1e4 as total from {FEATURES}""")
def p1_assembled(spark, d):
    # places weigh 1, 2, ...: C and A are at 2 and 5
    got = scoring.assemble(_features(spark, d).withColumn("kmer", F.lit("CA")), "kmer", ["ipd", "pw"]).withColumn("n", F.size("vector"))
    total = F.aggregate(F.transform("vector", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return got.select("vec_id", "n", half_up(total, 1e4).alias("total"))


SCORES = f"""with s as (select vec_id, list_sum(list_transform(range(0, 21), lambda i: ipd[i + 1]::double * ((i + 8) % 7 - 3) / 16e0)) + list_sum(list_transform(range(0, 21), lambda i: pw[i + 1]::double * ((i + 29) % 7 - 3) / 16e0)) as z from {FEATURES})
"""
ONE = "floor(floor({p} * 1e6 + 0.5) / 1e6 * 1e4 + 0.5) / 1e4"
P = "1e0 / (1e0 + exp(-z))"
P2 = f"{SCORES} select vec_id, {ONE.format(p=P)} as prob_1, case when z > 0 then 1 else 0 end as label from s"


@query(P2)
def p2_scored_sites(spark, d):
    got = scoring.assemble(_features(spark, d).withColumn("kmer", F.lit("NN")), "kmer", ["ipd", "pw"])
    return scoring.score_sites(got, keep=["vec_id"]).select("vec_id", half_up(F.col("prob_1"), 1e4).alias("prob_1"), "label")


@query(f"""select contig, pos, strand, coverage, floor(floor(list_sum(list_transform(range(0, 20), lambda k: (k + 0.5e0) / 20 * h[k + 1])) / list_sum(h) * 1e6 + 0.5) / 1e6 * 1e4 + 0.5) / 1e4 as score from {UNIT} g""")
def p3_scored_windows(spark, d):
    w = windows.neighbour_windows(sites.site_histogram(sites.fold_strands(fx.calls(spark, d))))
    return scoring.score_windows(w).select(*SITE, "coverage", half_up(F.col("score"), 1e4).alias("score"))


@query(f"""{SCORES} select vec_id, 0 as loc, {ONE.format(p=P)} as prob_1, case when z > 0 then 1 else 0 end as label from s
  union all select vec_id, 1, {ONE.format(p=f"(1e0 - {P})")}, case when z < 0 then 1 else 0 end from s""")
def p4_per_strand_scores(spark, d):
    import numpy as np

    def load():
        one = scoring.Linear()
        return lambda x: np.stack([one(x), 1 - one(x)], axis=1)

    got = scoring.assemble(_features(spark, d).withColumn("kmer", F.lit("NN")), "kmer", ["ipd", "pw"]).withColumn("loc", F.lit(0))
    got = scoring.score_sites(got, load, keep=["vec_id", "loc"], per_strand=True)
    return got.select("vec_id", "loc", half_up(F.col("prob_1"), 1e4).alias("prob_1"), "label")


@query()
def p5_fitted_classifier(spark, d):
    got = scoring.assemble(_features(spark, d).withColumn("kmer", F.lit("NN")), "kmer", ["ipd", "pw"]).withColumn("is_true", (F.col("label") % 2).cast("int"))
    scored = scoring.apply_classifier(scoring.fit_classifier(got, "is_true"), got)
    return compare.classification_metrics(scored)


SMOOTH = """(with f as (select contig, case when strand = '-' then pos - 1 else pos end as pos, count(*) as n, cast(sum(label) as bigint) as x from {c} where hap = {h} group by 1, 2)
  select contig, pos, sum(x) over w / (sum(n) over w)::double as level, sum(n) over w as sn from f window w as (partition by contig order by pos range between 250 preceding and 250 following))"""


@query(f"""with j as (select a.contig, a.pos, a.level as la, b.level as lb, a.level * (1 - a.level) / a.sn + b.level * (1 - b.level) / b.sn as v
    from {SMOOTH.format(c=C, h=1)} a join {SMOOTH.format(c=C, h=2)} b on a.contig = b.contig and a.pos = b.pos)
  select contig, pos, floor(la * 1e6 + 0.5) / 1e6 as level_a, floor(lb * 1e6 + 0.5) / 1e6 as level_b, floor((case when v > 0 then (la - lb) / sqrt(v) else 0e0 end) * 1e5 + 0.5) / 1e5 as z from j""")
def p6_diff_sites(spark, d):
    group = lambda h: sites.dmr_input(fx.calls(spark, d).where(F.col("hap") == h).groupBy(*SITE).agg(F.count("*").alias("coverage"), F.sum("label").cast("long").alias("n_mod")))
    got = diff.diff_sites(group(1), group(2))
    return got.select("contig", "pos", half_up(F.col("level_a"), 1e6).alias("level_a"), half_up(F.col("level_b"), 1e6).alias("level_b"), half_up(F.col("z"), 1e5).alias("z"))


POOLED = """(with f as (select contig, case when strand = '-' then pos - 1 else pos end as pos, depth % 2 as replicate, count(*) as n, cast(sum(label) as bigint) as x from {c} where hap = {h} group by 1, 2, 3),
  g as (select contig, pos, sum(n)::bigint as n, sum(x)::bigint as x, count(*) as k, sum(x * x / n::double) as s from f group by 1, 2),
  e as (select *, greatest(1e0, coalesce(case when k > 1 and x > 0 and x < n then (s - x * (x / n::double)) / (x / n::double * (1 - x / n::double)) / (k - 1) end, 1e0)) as disp from g),
  l as (select contig, pos, disp, sum(x) over w / (sum(n) over w)::double as level, sum(n) over w as sn from e window w as (partition by contig order by pos range between 250 preceding and 250 following))
  select contig, pos, level, level * (1 - level) / sn * disp as v from l)"""
# The same rational approximation of the normal tail as the operator's, fixed coefficients.
TAIL = "((1 / (1 + 0.3275911e0 * abs({z}) / sqrt(2e0))) * (0.254829592e0 + (1 / (1 + 0.3275911e0 * abs({z}) / sqrt(2e0))) * (-0.284496736e0 + (1 / (1 + 0.3275911e0 * abs({z}) / sqrt(2e0))) * (1.421413741e0 + (1 / (1 + 0.3275911e0 * abs({z}) / sqrt(2e0))) * (-1.453152027e0 + (1 / (1 + 0.3275911e0 * abs({z}) / sqrt(2e0))) * 1.061405429e0)))) * exp(-{z} * {z} / 2e0))"
ABOVE = "(case when {z} > 0 then " + TAIL + " / 2 else 1 - " + TAIL + " / 2 end)"
REPLICATES = f"""with j as (select a.contig, a.pos, a.level - b.level as diff, sqrt(a.v + b.v) as se from {POOLED.format(c=C, h=1)} a join {POOLED.format(c=C, h=2)} b on a.contig = b.contig and a.pos = b.pos),
  t as (select *, case when se > 0 then diff / se else 0e0 end as z, (0.3e0 - diff) / se as up, (0.3e0 + diff) / se as down from j)
"""


def _replicates(spark, d, hap):
    df = fx.calls(spark, d).where(F.col("hap") == hap).withColumn("pos", F.when(F.col("strand") == "-", F.col("pos") - 1).otherwise(F.col("pos")))
    return df.groupBy("contig", "pos", (F.col("depth") % 2).alias("replicate")).agg(F.count("*").alias("n"), F.sum("label").cast("long").alias("x"))


@query(f"{REPLICATES} select contig, pos, floor(z * 1e5 + 0.5) / 1e5 as z, floor({TAIL.format(z='z')} * 1e5 + 0.5) / 1e5 as p, {TAIL.format(z='z')} < 0.05e0 as significant from t")
def p6_diff_replicates(spark, d):
    got = diff.diff_sites(_replicates(spark, d, 1), _replicates(spark, d, 2), p=0.05)
    return got.select("contig", "pos", half_up(F.col("z"), 1e5).alias("z"), half_up(F.col("p"), 1e5).alias("p"), "significant")


@query(f"{REPLICATES} select contig, pos, case when se > 0 then {ABOVE.format(z='up')} + {ABOVE.format(z='down')} > 0.5e0 else abs(diff) > 0.3e0 end as significant from t")
def p6_diff_delta(spark, d):
    return diff.diff_sites(_replicates(spark, d, 1), _replicates(spark, d, 2), delta=0.3, p=0.5).select("contig", "pos", "significant")


#: Newton steps of a regression on two features, a system of three by Cramer's rule.
TWO = "(select vec_id, list_sum(list_transform(ipd, lambda x: x::double)) as u, list_sum(list_transform(pw, lambda x: x::double)) as v, (label % 2)::double as y from " + FEATURES + ")"


def _newton_step(k: int) -> str:
    p = "(1e0 / (1e0 + exp(-(b0 + b1 * u + b2 * v))))"
    w = f"(case when y = 1 then 2e0 else 1e0 end)"
    h = f"({w} * {p} * (1 - {p}))"
    det = lambda m: "+".join(f"({m[0][i]}) * (({m[1][(i + 1) % 3]}) * ({m[2][(i + 2) % 3]}) - ({m[1][(i + 2) % 3]}) * ({m[2][(i + 1) % 3]}))" for i in range(3))
    a = [["h00", "h01", "h02"], ["h01", "h11 + 0.5e0", "h12"], ["h02", "h12", "h22 + 0.5e0"]]
    g = ["g0", "g1 - 0.5e0 * b1", "g2 - 0.5e0 * b2"]
    swapped = lambda j: [[g[r] if c == j else a[r][c] for c in range(3)] for r in range(3)]
    return f"""m{k} as materialized (select b0, b1, b2, sum({w} * (y - {p})) as g0, sum({w} * (y - {p}) * u) as g1, sum({w} * (y - {p}) * v) as g2, sum({h}) as h00, sum({h} * u) as h01, sum({h} * v) as h02,
      sum({h} * u * u) as h11, sum({h} * u * v) as h12, sum({h} * v * v) as h22 from f, n{k - 1} group by b0, b1, b2),
    n{k} as materialized (select {", ".join(f"b{j} + ({det(swapped(j))}) / ({det(a)}) as b{j}" for j in range(3))} from m{k})"""


@query(f"""with f as (select * from {TWO} t), n0 as (select 0e0 as b0, 0e0 as b1, 0e0 as b2), {", ".join(_newton_step(k) for k in range(1, 9))}
  select term, floor(weight * 1e6 + 0.5) / 1e6 as weight from (select unnest([0, 1, 2]) as term, unnest([b0, b1, b2]) as weight from n8) t""")
def p5_fitted_weights(spark, d):
    """A regression by reweighted least squares, positives weighed twice."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double"))
    df = _features(spark, d).withColumns({"vector": F.array(total("ipd"), total("pw")), "y": (F.col("label") % 2).cast("int")})
    weights = scoring.fit_logistic(df, "y", positive_weight=2.0, rounds=8, penalty=0.5)[-1]
    # The sums of all rows are in them; as rows of a table derived from the features.
    one = df.groupBy().agg(F.count("*").alias("_n")).select(F.posexplode(F.array(*[F.lit(float(w)) for w in weights])).alias("term", "w"))
    return one.select("term", half_up(F.col("w"), 1e6).alias("weight"))


#: Groups with replicates, as ``diff.shrunk_sites`` takes them, in SQL. ``level``: its sums over the sites within 250, or a site's own.
def _group_sql(hap: int, smoothing: bool) -> str:
    over = "over (partition by contig order by pos range between 250 preceding and 250 following)" if smoothing else ""
    total = lambda c: f"sum({c}) {over}" if smoothing else c
    free = "1e0" if smoothing else "case when k > 1 then k / (k - 1)::double end"
    return f"""(with f as (select contig, case when strand = '-' then pos - 1 else pos end as pos, depth % 2 as replicate, count(*)::double as n, sum(label)::double as x from {C} where hap = {hap} group by 1, 2, 3),
  g as (select contig, pos, sum(n) as n, sum(x) as x, sum(n * (n - 1)) as pairs, count(*) as k, list({{'n': n, 'x': x}} order by n, x) as reps,
    sum(n * n) as noise0, sum(n * n * (n - 1)) as noise1, sum(n * n * (n - 1) * (n - 1)) as noise2 from f group by 1, 2),
  l as (select *, {total('x')} / {total('n')} as level, {total('n')} as all_n, {total('pairs')} as all_pairs from g)
  select *, case when level > 0 and level < 1 and pairs > 0 then list_sum(list_transform(reps, lambda r: (r.x - r.n * level) * (r.x - r.n * level))) * ({free}) / (level * (1 - level)) - n end as moment from l)"""


TERMS = """list_concat(list_concat(flatten(list_transform({r}, lambda r: list_transform(range(0, r.x::int), lambda k: {{'c': {m}, 'd': k - {m}, 's': 1e0}}))),
  flatten(list_transform({r}, lambda r: list_transform(range(0, (r.n - r.x)::int), lambda k: {{'c': 1 - {m}, 'd': k - 1 + {m}, 's': 1e0}})))),
  flatten(list_transform({r}, lambda r: list_transform(range(0, r.n::int), lambda k: {{'c': 1e0, 'd': k - 1e0, 's': -1e0}}))))"""
OWN = "list_transform({r}, lambda r: {{'c': 1e0, 'd': r.n - 1, 's': 0.5e0 / len({r})}})"
PRIOR = """(select ln(phi) - spread / 2 as mean, spread from (select phi, greatest(0.01e0, least(4e0, ln(1 + greatest(coalesce((mm - 2 * phi * mb + phi * phi * bb - 2 * (c0 + 2 * phi * c1 + phi * phi * c2)) / bb, 0e0), 0e0) / (phi * phi)))) as spread
  from (select *, coalesce(greatest(1e-4, least(0.9e0, m / b)), 1e-4) as phi from (select sum(moment) as m, sum(pairs) as b, sum(moment * moment) as mm, sum(moment * pairs) as mb, sum(pairs * pairs) as bb, sum(noise0) as c0, sum(noise1) as c1, sum(noise2) as c2 from {t} where moment is not null) q) q) q)"""
BOTH_MOMENTS = "(select " + ", ".join(f"case when a_moment is not null then a_{c} else 0 end + case when b_moment is not null then b_{c} else 0 end as {c}" for c in ("moment", "pairs", "noise0", "noise1", "noise2")) + " from j where a_moment is not null or b_moment is not null)"


def _newton_sql(source: str, name: str, steps: int = 10) -> str:
    """CTEs that end in ``name``: rows of ``source`` (terms, mean, spread) with phi."""
    out, last = [f"{name}0 as materialized (select *, mean as theta from {source})"], f"{name}0"
    part = "(t.d / (t.c + exp(theta) * t.d))"
    for k in range(1, steps + 1):
        out.append(f"""{name}{k}g as materialized (select *, coalesce(list_sum(list_transform(terms, lambda t: t.s * {part})), 0e0) as g, -coalesce(list_sum(list_transform(terms, lambda t: t.s * {part} * {part})), 0e0) as h from {last})""")
        out.append(f"""{name}{k} as materialized (select * exclude (g, h, theta), least(theta + greatest(-1e0, least(1e0, (exp(theta) * g - (theta - mean) / spread) / greatest(1 / spread - exp(theta) * exp(theta) * h - exp(theta) * g, 1 / spread))), -0.05e0) as theta from {name}{k}g)""")
        last = f"{name}{k}"
    return ", ".join([*out, f"{name} as materialized (select *, exp(theta) as phi from {last})"])


WALD = """select contig, pos, floor((a_level - b_level) * 1e6 + 0.5) / 1e6 as diff, floor(phi_a * 1e4 + 0.5) / 1e4 as phi_a, floor(phi_b * 1e4 + 0.5) / 1e4 as phi_b, floor(case when v > 0 then (a_level - b_level) / sqrt(v) else 0e0 end * 1e4 + 0.5) / 1e4 as z
  from (select *, a_level * (1 - a_level) * (a_all_n + phi_a * a_all_pairs) / (a_all_n * a_all_n) + b_level * (1 - b_level) * (b_all_n + phi_b * b_all_pairs) / (b_all_n * b_all_n) as v from w) q"""
JOINED = "j as (select a.contig, a.pos, " + ", ".join(f"{g}.{c} as {g}_{c}" for g in "ab" for c in ("level", "all_n", "all_pairs", "reps", "moment", "pairs", "noise0", "noise1", "noise2")) + " from a join b on a.contig = b.contig and a.pos = b.pos)"
SHRUNK = f"""with a as materialized {_group_sql(1, True)}, b as materialized {_group_sql(2, True)}, {JOINED},
  pa as (select j.*, {TERMS.format(r='a_reps', m='a_level')} as terms, p.mean, p.spread from j, {PRIOR.format(t='a')} p), {_newton_sql('pa', 'na')},
  pb as (select j.contig, j.pos, {TERMS.format(r='b_reps', m='b_level')} as terms, p.mean, p.spread from j, {PRIOR.format(t='b')} p), {_newton_sql('pb', 'nb')},
  w as (select na.*, na.phi as phi_a, nb.phi as phi_b from na join nb on na.contig = nb.contig and na.pos = nb.pos) {WALD}"""
EQUAL = f"""with a as materialized {_group_sql(1, False)}, b as materialized {_group_sql(2, False)}, {JOINED},
  pa as (select j.*, list_concat(list_concat(list_concat({TERMS.format(r='a_reps', m='a_level')}, {OWN.format(r='a_reps')}), {TERMS.format(r='b_reps', m='b_level')}), {OWN.format(r='b_reps')}) as terms, p.mean, p.spread from j, {PRIOR.format(t=BOTH_MOMENTS)} p), {_newton_sql('pa', 'na')},
  w as (select *, phi as phi_a, phi as phi_b from na) {WALD}"""


def _wald(df):
    return df.select("contig", "pos", half_up(F.col("diff"), 1e6).alias("diff"), *[half_up(F.col(c), 1e4).alias(c) for c in ("phi_a", "phi_b", "z")])


@query(SHRUNK)
def p6_diff_shrunk(spark, d):
    """Dispersions of each group shrunk to their common ones; smoothed levels."""
    return _wald(diff.diff_sites(_replicates(spark, d, 1), _replicates(spark, d, 2), dispersion="shrunk"))


@query(EQUAL)
def p6_diff_equal_unsmoothed(spark, d):
    """One dispersion of both groups; levels of the sites alone."""
    return _wald(diff.diff_sites(_replicates(spark, d, 1), _replicates(spark, d, 2), dispersion="shrunk", smoothing=False, equal_disp=True))


@query(f"""{REPLICATES.replace("250", "0")}, s as (select contig, pos, diff, case when se > 0 then {ABOVE.format(z='up')} + {ABOVE.format(z='down')} > 0.5e0 else abs(diff) > 0.3e0 end as significant from t),
  g as (select contig, pos, sum(new) over (partition by contig order by pos rows unbounded preceding) as island from (select contig, pos, case when pos - lag(pos) over (partition by contig order by pos) < 60 then 0 else 1 end as new from s where significant) q),
  r as (select contig, island, min(pos) as start, max(pos) + 1 as stop, count(*) as n_significant from g group by 1, 2)
  select r.contig, r.start, r.stop as "end", r.n_significant, count(*) as n_sites, floor(avg(s.diff) * 1e6 + 0.5) / 1e6 as diff, floor(sum(s.diff) * 1e4 + 0.5) / 1e4 as area
  from r join s on s.contig = r.contig and s.pos >= r.start and s.pos < r.stop group by r.contig, r.start, r.stop, r.n_significant having r.stop - r.start >= 20 and count(*) >= 3 and r.n_significant >= 0.3e0 * count(*)""")
def p6_diff_regions(spark, d):
    """Regions of sites whose difference is above a threshold."""
    tests = diff.diff_sites(_replicates(spark, d, 1), _replicates(spark, d, 2), delta=0.3, p=0.5, smoothing=False)
    got = diff.diff_regions(tests, dis_merge=60, minlen=20, min_sites=3, pct_sig=0.3)
    return got.select("contig", "start", "end", "n_significant", "n_sites", half_up(F.col("diff"), 1e6).alias("diff"), half_up(F.col("area"), 1e4).alias("area"))

@query(f"select contig, pos, strand, cast(least(floor(prob_1 * 20), 19) as int) as bin, count(*) as n from {C} group by 1, 2, 3, 4")
def p7_sql_hooks(spark, d):
    scoring.register_hooks(spark)
    return spark.sql("select contig, pos, strand, prob_bin(prob_1, 20) as bin, count(*) as n from {calls} group by 1, 2, 3, 4", calls=fx.calls(spark, d))


@query(f"""select contig, pos, strand, array_to_string(list_transform(h, lambda x: cast(cast(floor(x / sqrt(list_sum(list_transform(h, lambda y: y * y))) * 1e4 + 0.5) as int) as varchar)), ',') as hist
  from (select contig, pos, strand, list_transform(range(0, 20), lambda k: list_count(list_filter(list(least(floor(prob_1 * 20), 19)), lambda b: b = k))::double) as h from {C} group by 1, 2, 3) g""")
def p7_histogram_aggregate(spark, d):
    """Histograms by an aggregate under a SQL name."""
    scoring.register_hooks(spark)
    got = spark.sql("select contig, pos, strand, prob_histogram(prob_1) as h from {calls} group by contig, pos, strand", calls=fx.calls(spark, d))
    return got.select("contig", "pos", "strand", F.array_join(F.transform("h", lambda x: F.floor(x * 1e4 + 0.5).cast("int").cast("string")), ",").alias("hist"))


@query(f"select read_id, unnest(list_filter(range(0, length(seq) - 1), lambda i: substring(seq, i + 1, 2) = 'CG'))::int as loc from ({fx.D_READS}) r where length(seq) > 1")
def p7_motif_table(spark, d):
    """Motif sites by a table function over a table of reads."""
    scoring.register_hooks(spark)
    return spark.sql("select read_id, loc from read_motifs(table(select read_id, seq from {reads}), 'CG')", reads=fx.reads(spark, d))
