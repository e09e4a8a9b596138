"""Two-group differential sites (P6): Wald test on levels, with a dispersion between replicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let
from .scoring import normal_tail
from .windows import smooth_sites

#: Bounds of the mean dispersion, and of the prior's variance on the log scale.
MEAN_BOUNDS, SPREAD_BOUNDS = (1e-4, 0.9), (0.01, 4.0)
#: Dispersions stay below exp(TOP); a Newton step moves the logarithm by 1 at most.
TOP = -0.05


def _upto(n: Column, body) -> Column:
    """``body`` of 0, 1, ... n - 1, as an array."""
    return F.transform(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>")), body)


def _terms(replicates: Column, mu: Column, own: bool = False) -> Column:
    """The beta-binomial log likelihood of dispersion phi is the sum of s log(c + phi d) over these terms:
    rising factorials of a site's modified, unmodified and all calls. With a level that is the replicates'
    ``own`` comes half the log variance of that level (the adjusted profile likelihood), as its mean over
    replicates; without it dispersions would be too small."""
    term = lambda c, d, s: F.struct(F.coalesce(c, F.lit(0.0)).alias("c"), d.cast("double").alias("d"), F.lit(s).alias("s"))

    def one(r: Column) -> Column:
        mod = _upto(r["x"], lambda k: term(mu, k - mu, 1.0))
        unmod = _upto(r["n"] - r["x"], lambda k: term(1 - mu, k - 1 + mu, 1.0))
        return F.concat(mod, unmod, _upto(r["n"], lambda k: term(F.lit(1.0), k - 1, -1.0)))

    terms = F.flatten(F.transform(replicates, one))
    if not own:
        return terms
    size = F.size(replicates)
    lost = F.transform(replicates, lambda r: F.struct(F.lit(1.0).alias("c"), (r["n"] - 1).cast("double").alias("d"), (0.5 / size).alias("s")))
    return F.concat(terms, lost)


def _mode(terms: Column, mean: Column, spread: Column, steps: int) -> Column:
    """Dispersion of the highest posterior density of its logarithm, by Newton steps from the prior's mean. Where
    the curvature is less than the prior's, the prior's is taken, so that a step goes up."""
    zero = F.struct(F.lit(0.0).alias("g"), F.lit(0.0).alias("h"))

    def add(s: Column, t: Column, phi: Column) -> Column:
        part = let(t["d"] / (t["c"] + phi * t["d"]), lambda u: F.struct((t["s"] * u).alias("g"), (t["s"] * u * u).alias("h")))
        return let(part, lambda p: F.struct((s["g"] + p["g"]).alias("g"), (s["h"] - p["h"]).alias("h")))

    def step(theta: Column, _: Column) -> Column:
        def moved(phi: Column) -> Column:
            def to(v: Column) -> Column:
                slope = phi * v["g"] - (theta - mean) / spread
                curve = F.greatest(1 / spread - phi * phi * v["h"] - phi * v["g"], 1 / spread)
                return F.least(theta + F.greatest(F.lit(-1.0), F.least(F.lit(1.0), slope / curve)), F.lit(TOP))

            return let(F.aggregate(terms, zero, lambda s, t: add(s, t, phi)), to)

        return let(F.exp(theta), moved)

    return F.exp(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), mean, step))


def _group(df: DataFrame, span: int, smoothing: bool, name: str) -> DataFrame:
    """A row a site: level, what its variance is made of, its replicates, and the moments of its dispersion."""
    n, x = F.col("n"), F.col("x")
    at = df.groupBy("contig", "pos").agg(
        F.sum("n").alias("n"), F.sum("x").alias("x"), F.sum(n * (n - 1)).alias("pairs"), F.count("*").alias("k"),
        F.array_sort(F.collect_list(F.struct("n", "x"))).alias("reps"),
        *[F.sum((n * n * c).cast("double")).alias(f"noise{i}") for i, c in enumerate((F.lit(1), n - 1, (n - 1) * (n - 1)))],
    )
    if smoothing:
        at = smooth_sites(at, span, more=["pairs"]).withColumnsRenamed({"smooth_n": "all_n", "smooth_pairs": "all_pairs"})
    else:
        at = at.withColumns({"level": F.col("x") / F.col("n"), "all_n": F.col("n"), "all_pairs": F.col("pairs")})
    mu, k = F.col("level"), F.col("k")
    off = F.aggregate("reps", F.lit(0.0), lambda s, r: s + (r["x"] - r["n"] * mu) * (r["x"] - r["n"] * mu))
    # A level that comes from the replicates themselves takes one degree of freedom.
    free = F.lit(1.0) if smoothing else F.when(k > 1, k / (k - 1))
    moment = F.when((mu > 0) & (mu < 1) & (F.col("pairs") > 0), off * free / F.when((mu > 0) & (mu < 1), mu * (1 - mu)) - F.col("n"))
    return at.select("contig", "pos", *[F.col(c).alias(f"{c}_{name}") for c in ("level", "all_n", "all_pairs", "reps", "pairs", "noise0", "noise1", "noise2")], moment.alias(f"moment_{name}"))


def _prior(moments: DataFrame) -> DataFrame:
    """One row (mean, spread): mean and variance of the log dispersion, by moments over all sites (moment, pairs,
    noise0..2). The sites' spread around the common dispersion, less what sampling alone gives, is its variance."""
    m, b = F.col("moment"), F.col("pairs").cast("double")
    used = moments.where("moment is not null")
    sums = used.agg(
        F.sum(m).alias("m"), F.sum(b).alias("b"), F.sum(m * m).alias("mm"), F.sum(m * b).alias("mb"), F.sum(b * b).alias("bb"),
        *[F.sum(f"noise{i}").alias(f"c{i}") for i in range(3)],
    )
    low, high = MEAN_BOUNDS
    phi = F.coalesce(F.greatest(F.lit(low), F.least(F.lit(high), F.col("m") / F.when(F.col("b") > 0, F.col("b")))), F.lit(low))
    own = sums.withColumn("phi", phi)
    phi = F.col("phi")
    noise = 2 * (F.col("c0") + 2 * phi * F.col("c1") + phi * phi * F.col("c2"))
    variance = (F.col("mm") - 2 * phi * F.col("mb") + phi * phi * F.col("bb") - noise) / F.when(F.col("bb") > 0, F.col("bb"))
    low, high = SPREAD_BOUNDS
    spread = F.greatest(F.lit(low), F.least(F.lit(high), F.log(1 + F.greatest(F.coalesce(variance, F.lit(0.0)), F.lit(0.0)) / (phi * phi))))
    return own.withColumn("spread", spread).select((F.log("phi") - F.col("spread") / 2).alias("mean"), "spread")


def shrunk_sites(case: DataFrame, control: DataFrame, span: int = 500, smoothing: bool = True, equal_disp: bool = False, steps: int = 10) -> DataFrame:
    """(contig, pos, level_a, level_b, phi_a, phi_b, var_a, var_b) of the sites that both groups have, with beta-binomial
    dispersions shrunk by empirical Bayes.

    case and control: (contig, pos, n, x), a row for each replicate. Levels are smoothed over ``span`` or, without
    ``smoothing``, a site's own. A dispersion's logarithm has a normal prior, whose mean and variance come from the
    moments of all sites in one aggregate; the posterior's mode is found by ``steps`` Newton steps as expressions of
    the site. With ``equal_disp`` both groups have one dispersion at a site. Variances: level (1 - level)
    (n + phi pairs) / n**2, where pairs is the sum of n (n - 1) over the replicates that the level is made of."""
    a, b = _group(case, span, smoothing, "a"), _group(control, span, smoothing, "b")
    both = a.join(b, ["contig", "pos"])
    parts = ("moment", "pairs", "noise0", "noise1", "noise2")
    if equal_disp:
        known = lambda c, g: F.when(F.col(f"moment_{g}").isNotNull(), F.col(f"{c}_{g}")).otherwise(0)
        some = F.col("moment_a").isNotNull() | F.col("moment_b").isNotNull()
        prior = _prior(both.select(*[F.when(some, known(c, "a") + known(c, "b")).alias(c) for c in parts]))
        terms = F.concat(_terms(F.col("reps_a"), F.col("level_a"), not smoothing), _terms(F.col("reps_b"), F.col("level_b"), not smoothing))
        both = both.crossJoin(F.broadcast(prior)).withColumn("_terms", terms)
        both = both.withColumn("phi_a", _mode(F.col("_terms"), F.col("mean"), F.col("spread"), steps)).withColumn("phi_b", F.col("phi_a"))
    else:
        for g, df in (("a", a), ("b", b)):
            prior = _prior(df.select(*[F.col(f"{c}_{g}").alias(c) for c in parts]))
            both = both.crossJoin(F.broadcast(prior)).withColumn("_terms", _terms(F.col(f"reps_{g}"), F.col(f"level_{g}"), not smoothing))
            both = both.withColumn(f"phi_{g}", _mode(F.col("_terms"), F.col("mean"), F.col("spread"), steps)).drop("mean", "spread", "_terms")
    mu, n = lambda g: F.col(f"level_{g}"), lambda g: F.col(f"all_n_{g}")
    var = lambda g: mu(g) * (1 - mu(g)) * (n(g) + F.col(f"phi_{g}") * F.col(f"all_pairs_{g}")) / (n(g) * n(g))
    return both.select("contig", "pos", "level_a", "level_b", "phi_a", "phi_b", var("a").alias("var_a"), var("b").alias("var_b"))


def _moment_sites(case: DataFrame, control: DataFrame, span: int, smoothing: bool) -> DataFrame:
    """As ``shrunk_sites``, with the ratio of observed to binomial variance of a site's replicates, 1 at least."""

    def group(df: DataFrame, name: str) -> DataFrame:
        if "replicate" in df.columns:
            pooled = df.groupBy("contig", "pos").agg(F.sum("n").alias("n"), F.sum("x").alias("x"), F.count("*").alias("_k"),
                                                    F.sum(F.col("x") * F.col("x") / F.col("n")).alias("_s"))
            rate = F.col("x") / F.col("n")
            chi = F.when((rate > 0) & (rate < 1), (F.col("_s") - F.col("x") * rate) / (rate * (1 - rate)))
            pooled = pooled.withColumn("disp", F.greatest(F.lit(1.0), F.coalesce(chi / F.when(F.col("_k") > 1, F.col("_k") - 1), F.lit(1.0))))
        else:
            pooled = df.groupBy("contig", "pos").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).withColumn("disp", F.lit(1.0))
        s = smooth_sites(pooled, span) if smoothing else pooled.withColumns({"level": F.col("x") / F.col("n"), "smooth_n": F.col("n")})
        return s.select("contig", "pos", F.col("level").alias(f"level_{name}"), (F.col("level") * (1 - F.col("level")) / F.col("smooth_n") * F.col("disp")).alias(f"var_{name}"))

    return group(case, "a").join(group(control, "b"), ["contig", "pos"])


def diff_sites(case: DataFrame, control: DataFrame, delta: float = 0.0, p: float = 0.001, span: int = 500, dispersion: str = "moments",
               smoothing: bool = True, equal_disp: bool = False) -> DataFrame:
    """(contig, pos, level_a, level_b[, phi_a, phi_b], diff, se, z, p, significant) of the sites that both groups have.

    case and control: (contig, pos, n, x), with ``replicate`` where there are several. Levels are
    smoothed over ``span``, or a site's own without ``smoothing``. ``dispersion``: ``moments``, the standard error of
    two proportions times the dispersion between a site's replicates (1 at least), or ``shrunk``, that of
    beta-binomial replicates (``shrunk_sites``, for one dispersion of both groups with ``equal_disp``). Significant:
    p below the cutoff, or with delta > 0 the probability that abs(diff) > delta above 1 - p."""
    if dispersion == "shrunk":
        both = shrunk_sites(case, control, span, smoothing, equal_disp)
    elif dispersion == "moments" and not equal_disp:
        both = _moment_sites(case, control, span, smoothing)
    else:
        raise ValueError(f"unknown dispersion: {dispersion}, equal: {equal_disp}")
    both = both.withColumn("diff", F.col("level_a") - F.col("level_b")).withColumn("se", F.sqrt(F.col("var_a") + F.col("var_b")))
    both = both.withColumn("z", F.when(F.col("se") > 0, F.col("diff") / F.col("se")).otherwise(0.0)).withColumn("p", normal_tail(F.col("z")))
    if delta > 0:
        tail = lambda z: F.when(z > 0, normal_tail(z) / 2).otherwise(1 - normal_tail(z) / 2)  # noqa: E731  P(Z > z)
        above = F.when(F.col("se") > 0, tail((delta - F.col("diff")) / F.col("se")) + tail((delta + F.col("diff")) / F.col("se"))).otherwise((F.abs("diff") > delta).cast("double"))
        significant = above > 1 - p
    else:
        significant = F.col("p") < p
    return both.withColumn("significant", significant).drop("var_a", "var_b")


def diff_regions(tests: DataFrame, **options) -> DataFrame:
    """Regions of tested sites (``diff_sites``) by ``call_regions`` with its options, with the mean levels and the mean
    and summed difference of their sites: (contig, start, end, length, n_sites, n_significant, level_a, level_b, diff,
    area)."""
    from .joins import overlap_join
    from .windows import call_regions

    found = call_regions(tests.select("contig", "pos", "significant"), **options)
    places = tests.select("contig", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), "level_a", "level_b", "diff")
    keys = ["contig", "start", "end", "length", "n_sites", "n_significant"]
    within = overlap_join(found, places)
    return within.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in ("level_a", "level_b", "diff")], F.sum("diff").alias("area"))
