"""Beta-binomial dispersions: the posterior mode against a grid, p values under a simulated null, regions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from methloom.operators import diff


def log_likelihood(phi, mu, replicates):
    f = lambda c, d: math.log(c + phi * d)
    return sum(
        sum(f(mu, k - mu) for k in range(x)) + sum(f(1 - mu, k - 1 + mu) for k in range(n - x)) - sum(f(1, k - 1) for k in range(n))
        for n, x in replicates
    )


def test_mode_is_the_highest_of_a_grid(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(40):
        reps = [(n := int(rng.integers(1, 40)), int(rng.integers(0, n + 1))) for _ in range(rng.integers(1, 5))]
        mu = sum(x for _, x in reps) / sum(n for n, _ in reps)
        rows.append((i, reps, float(np.clip(mu, 0, 1)), float(rng.choice([-5.0, -3.0, -1.5])), float(rng.choice([0.05, 0.5, 2.0]))))
    df = spark.createDataFrame(rows, "i int, reps array<struct<n:bigint,x:bigint>>, mu double, mean double, spread double")
    df = df.withColumn("t", diff._terms(F.col("reps"), F.col("mu")))
    got = {r.i: r.phi for r in df.select("i", diff._mode(F.col("t"), F.col("mean"), F.col("spread"), 10).alias("phi")).collect()}
    grid = np.linspace(-12, diff.TOP, 4000)
    for i, reps, mu, mean, spread in rows:
        score = [log_likelihood(math.exp(t), mu, reps) - (t - mean) ** 2 / (2 * spread) if 0 < mu < 1 else -((t - mean) ** 2) for t in grid]
        best = max(score)
        own = log_likelihood(got[i], mu, reps) - (math.log(got[i]) - mean) ** 2 / (2 * spread) if 0 < mu < 1 else -((math.log(got[i]) - mean) ** 2)
        assert own == pytest.approx(best, abs=2e-3)


def simulated(spark, sites, replicates, spread, seed, shift=0.0):
    """Two groups of beta-binomial counts; levels of the second are ``shift`` higher."""
    rng = np.random.default_rng(seed)
    mu, phi = rng.uniform(0.25, 0.75, sites), np.exp(rng.normal(-2.5, spread, sites))
    out = []
    for level in (mu, np.minimum(mu + shift, 0.95)):
        a, b = level * (1 / phi - 1), (1 - level) * (1 / phi - 1)
        rows = []
        for r in range(replicates):
            n = rng.integers(10, 30, sites)
            x = rng.binomial(n, rng.beta(a, b))
            rows += [("chr1", int(1000 * i), int(r), int(n[i]), int(x[i])) for i in range(sites)]
        out.append(spark.createDataFrame(rows, "contig string, pos long, replicate int, n long, x long"))
    return out


@pytest.mark.parametrize("equal", [False, True])
def test_p_is_uniform_under_the_null(spark, equal):
    case, control = simulated(spark, 3000, 4, 0.6, 3)
    got = diff.diff_sites(case, control, dispersion="shrunk", smoothing=False, equal_disp=equal).toPandas()
    assert len(got) == 3000
    for cut in (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9):
        assert (got.p < cut).mean() == pytest.approx(cut, abs=0.02 + 0.12 * cut)
    # Binomial errors would reject far too often.
    plain = diff.diff_sites(case.drop("replicate"), control.drop("replicate"), smoothing=False).toPandas()
    assert (plain.p < 0.05).mean() > 0.2


def test_shrunk_dispersions_are_nearer_to_the_truth_than_moments(spark):
    rng = np.random.default_rng(5)
    case, control = simulated(spark, 1500, 4, 0.3, 5)
    got = diff.shrunk_sites(case, control, smoothing=False).orderBy("pos").toPandas()
    rng.uniform(0.25, 0.75, 1500)
    truth = rng.normal(-2.5, 0.3, 1500)
    assert np.sqrt(np.mean((np.log(got.phi_a) - truth) ** 2)) < 0.45
    assert abs(np.log(got.phi_a).mean() - truth.mean()) < 0.25


def test_power_and_smoothing(spark):
    case, control = simulated(spark, 400, 4, 0.3, 7, shift=0.2)
    own = diff.diff_sites(case, control, p=0.05, dispersion="shrunk", smoothing=False).toPandas()
    assert own.significant.mean() > 0.4 and (own["diff"] < 0).mean() > 0.9
    # Places of 100 in place of 1000: five neighbours' counts are added up.
    near = lambda df: df.withColumn("pos", F.col("pos") / 10).withColumn("pos", F.col("pos").cast("long"))
    smooth = diff.diff_sites(near(case), near(control), p=0.05, dispersion="shrunk").toPandas()
    assert smooth.se.median() < own.se.median() / 1.5


def test_odd_sites(spark):
    """No variance, one replicate, no calls modified, a site of one group, no rows."""
    rows = [("c", 1, 0, 5, 0), ("c", 1, 1, 3, 0), ("c", 2, 0, 4, 4), ("c", 3, 0, 1, 1), ("c", 3, 1, 1, 0), ("c", 9, 0, 3, 1)]
    schema = "contig string, pos long, replicate int, n long, x long"
    case, control = spark.createDataFrame(rows, schema), spark.createDataFrame(rows[:5], schema)
    for smoothing in (True, False):
        for equal in (True, False):
            got = diff.diff_sites(case, control, dispersion="shrunk", smoothing=smoothing, equal_disp=equal, span=0).orderBy("pos").collect()
            assert [r.pos for r in got] == [1, 2, 3] and [r.z for r in got] == [0, 0, 0]
            assert all(0 < r.phi_a < 1 for r in got) and not any(r.significant for r in got)
    assert diff.diff_sites(case.limit(0), control, dispersion="shrunk").count() == 0
    with pytest.raises(ValueError):
        diff.diff_sites(case, control, dispersion="other")


def test_regions(spark):
    rows = [("c", 10 * i, 0.8 if 20 <= i < 40 else 0.5, 0.5, 0.3 if 20 <= i < 40 else 0.0, 20 <= i < 40 and i != 30) for i in range(100)]
    tests = spark.createDataFrame(rows, "contig string, pos long, level_a double, level_b double, diff double, significant boolean")
    got = diff.diff_regions(tests, dis_merge=50, minlen=50, min_sites=5).collect()
    assert [(r.contig, r.start, r.end, r.n_sites, r.n_significant) for r in got] == [("c", 200, 391, 20, 19)]
    assert got[0]["diff"] == pytest.approx(0.3) and got[0].area == pytest.approx(6.0)
