"""Scoring and learning."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calls as X
from ..functions.sequence import base_codes, motif_hits

Scorer = Callable[[np.ndarray], np.ndarray]
SITE_COLUMNS = ["contig", "pos", "strand", "read_id", "loc"]


def assemble(features: DataFrame, kmer: str = "kmer", arrays: list[str] | None = None, scalars: list[str] | None = None, column: str = "vector") -> DataFrame:
    """One array of doubles a row: the k-mer's bases one-hot (A, C, G, T), then arrays, then scalars;
    a missing value is 0."""
    one_hot = F.flatten(F.transform(base_codes(kmer), lambda c: F.transform(F.array(*map(F.lit, range(4))), lambda b: (c == b).cast("double"))))
    number = lambda x: F.coalesce(x.cast("double"), F.lit(0.0))
    parts = [one_hot] + [F.transform(a, number) for a in arrays or []]
    if scalars:
        parts.append(F.array(*[number(F.col(s)) for s in scalars]))
    return features.withColumn(column, F.concat(*parts))


class Linear:
    """A closed-form scorer: logistic of a weighted sum; weights are (k % 7 - 3) / 16, exact in binary."""

    def __call__(self, x: np.ndarray) -> np.ndarray:
        w = (np.arange(x.shape[1]) % 7 - 3) / 16.0
        return 1.0 / (1.0 + np.exp(-(x @ w)))


def score_sites(features: DataFrame, load: Callable[[], Scorer] = Linear, vector: str = "vector", batch_size: int = 512,
                per_strand: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Calls (prob_0, prob_1, label) of assembled rows. ``load`` makes the scorer once a task; it
    maps a matrix to one probability a row, or with ``per_strand`` to two (forward, reverse), which
    become calls at loc and loc + 1. The kept columns pass through."""
    keep = keep or [c for c in SITE_COLUMNS if c in features.columns]
    kinds = dict(features.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = load()
        for frame in frames:
            for a in range(0, len(frame), batch_size):
                part = frame.iloc[a : a + batch_size]
                p = np.asarray(scorer(np.stack(part[vector].to_numpy()))).reshape(len(part), -1)
                yield part[keep].assign(_p=list(p.astype(float)))

    out = features.select(*keep, vector).mapInPandas(run, ", ".join([*(f"{c} {kinds[c]}" for c in keep), "_p array<double>"]))
    if per_strand:
        out = out.select(*keep, F.posexplode("_p").alias("_k", "_one")).withColumn("loc", F.col("loc") + F.col("_k")).drop("_k")
    else:
        out = out.withColumn("_one", F.get("_p", F.lit(0))).drop("_p")
    one = X.half_up(F.col("_one"), 1e6)
    return out.select(*keep, (1 - one).alias("prob_0"), one.alias("prob_1"), (F.col("_one") > 0.5).cast("int").alias("label"))


class Centre:
    """A closed-form site scorer: mean of the bins' middles in the centre histogram."""

    def __call__(self, offsets: np.ndarray, hists: np.ndarray) -> np.ndarray:
        h = hists[:, hists.shape[1] // 2]
        middles = (np.arange(h.shape[1]) + 0.5) / h.shape[1]
        total = h.sum(axis=1)
        return np.divide(h @ middles, total, out=np.zeros(len(h)), where=total > 0)


def score_windows(windows: DataFrame, load: Callable[[], Callable] | None = None, batch_size: int = 1024) -> DataFrame:
    """A score from 0 to 1 (6 decimals) for each row of ``neighbour_windows``; the scorer gets offsets
    [sites, L] and histograms [sites, L, bins]."""
    load = load or Centre
    keep = [c for c in windows.columns if c not in ("offsets", "hists", "hist")]
    kinds = dict(windows.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = load()
        for frame in frames:
            for a in range(0, len(frame), batch_size):
                part = frame.iloc[a : a + batch_size]
                hists = np.stack([np.stack(h) for h in part["hists"]])
                yield part[keep].assign(score=np.asarray(scorer(np.stack(part["offsets"].to_numpy()), hists), dtype=float))

    out = windows.select(*keep, "offsets", "hists").mapInPandas(run, ", ".join([*(f"{c} {kinds[c]}" for c in keep), "score double"]))
    return out.withColumn("score", X.half_up(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))), 1e6))


def fit_classifier(features: DataFrame, label: str = "label", vector: str = "vector", positive_weight: float = 1.0, rounds: int = 20):
    """P5: logistic regression on assembled rows, positives weighed."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    df = features.select(array_to_vector(F.col(vector)).alias("features"), F.col(label).cast("double").alias("label"))
    df = df.withColumn("weight", F.when(F.col("label") == 1, positive_weight).otherwise(1.0))
    return LogisticRegression(maxIter=rounds, regParam=0.01, weightCol="weight").fit(df)


def fit_logistic(features: DataFrame, label: str = "label", vector: str = "vector", positive_weight: float = 1.0, rounds: int = 12,
                 penalty: float = 0.01, fold: Column | None = None, folds: int = 0) -> np.ndarray:
    """P5: weights [models, 1 + length of the vectors] (intercept first) of logistic regressions by iteratively
    reweighted least squares: least of the weighted log loss, summed, and half ``penalty`` times the squares of the
    weights but the intercept.

    Each round is one aggregate: tasks sum gradient and outer products over their rows, the sums are added by
    entry, and the driver solves a system of the vector's length. The last model is of all rows; with ``fold``
    (0 to folds - 1; rows of one contig or read in one fold) model k is of all rows but those of fold k. Rows with
    a null label or vector are left out; nulls in a vector are 0."""
    df = features.where(F.col(label).isNotNull() & F.col(vector).isNotNull())
    df = df.select(
        F.transform(vector, lambda x: F.coalesce(x.cast("double"), F.lit(0.0))).alias("x"), F.col(label).cast("double").alias("y"),
        (F.lit(-1) if fold is None else F.pmod(fold, F.lit(folds))).cast("int").alias("fold"),
    )
    size = df.agg(F.max(F.size("x"))).first()[0]
    if size is None:
        raise ValueError("no labelled rows")
    beta = np.zeros((folds + 1, size + 1))

    def sums(batches: Iterator, beta: np.ndarray) -> Iterator:
        import pyarrow as pa

        out = np.zeros((len(beta), beta.shape[1] + 1, beta.shape[1]))
        for b in batches:
            x = np.asarray(b.column("x").flatten(), dtype=float).reshape(b.num_rows, -1)
            x, y, own = np.insert(x, 0, 1.0, axis=1), np.asarray(b.column("y")), np.asarray(b.column("fold"))
            weight = np.where(y == 1, positive_weight, 1.0)
            for k in range(len(beta)):
                z = x @ beta[k]
                p = np.exp(-np.logaddexp(0, -z))
                w = weight * (own != k)
                out[k, 0] += (w * (y - p)) @ x
                out[k, 1:] += (x * (w * p * (1 - p))[:, None]).T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size)), pa.array(out.ravel())], names=["i", "v"])

    ridge = np.full(size + 1, float(penalty))
    ridge[0] = 0.0
    for _ in range(rounds):
        got = df.mapInArrow(lambda b, beta=beta: sums(b, beta), "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()  # a row an entry
        total = np.zeros((folds + 1) * (size + 2) * (size + 1))
        total[got["i"].to_numpy()] = got["v"].to_numpy()
        total = total.reshape(folds + 1, size + 2, size + 1)
        slope, curve = total[:, 0] - ridge * beta, total[:, 1:] + np.diag(np.maximum(ridge, 1e-12))
        beta = beta + np.linalg.solve(curve, slope[:, :, None])[:, :, 0]
    return beta


def apply_logistic(features: DataFrame, weights: np.ndarray, vector: str = "vector", fold: Column | None = None) -> DataFrame:
    """``features`` with prob_1 and predicted by ``fit_logistic``'s last model or, with ``fold``, each row by the model
    that its fold was left out of; an expression, without a fitted object in the plan."""
    beta = F.array(*[F.array(*[F.lit(float(w)) for w in row]) for row in weights])
    own = F.get(beta, F.lit(len(weights) - 1) if fold is None else F.pmod(fold, F.lit(len(weights) - 1)).cast("int"))
    return features.withColumn("_w", own).withColumn("prob_1", 1 / (1 + F.exp(-F.aggregate(
        F.zip_with(vector, F.slice("_w", 2, 1 << 30), lambda x, w: F.coalesce(x.cast("double"), F.lit(0.0)) * w), F.get("_w", F.lit(0)), lambda s, x: s + x,
    )))).withColumn("predicted", (F.col("prob_1") > 0.5).cast("int")).drop("_w")


def apply_classifier(model, features: DataFrame, vector: str = "vector") -> DataFrame:
    """``features`` with prob_1 and predicted by a fitted classifier: its weights as an expression, so the plan
    holds no fitted object."""
    weights = F.array(*[F.lit(float(w)) for w in model.coefficients])
    z = F.aggregate(F.zip_with(F.col(vector), weights, lambda x, w: x * w), F.lit(float(model.intercept)), lambda s, x: s + x)
    return features.withColumn("prob_1", 1 / (1 + F.exp(-z))).withColumn("predicted", (F.col("prob_1") > 0.5).cast("int"))


def fit_regressor(windows: DataFrame, target: str = "freq", rounds: int = 10):
    """P5: boosted trees on a site's offsets and histograms, regressing its frequency."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import GBTRegressor

    flat = F.concat(F.transform("offsets", lambda x: x.cast("double")), F.flatten("hists"))
    df = windows.select(array_to_vector(flat).alias("features"), F.col(target).cast("double").alias("label"))
    return GBTRegressor(maxIter=rounds, maxDepth=4, seed=1).fit(df)


#: A function of Spark's registry that puts its one argument into an expression; compiled by Spark's own compiler, on the driver only.
BUILDER = """
import org.apache.spark.sql.catalyst.analysis.UnresolvedAttribute;
import org.apache.spark.sql.catalyst.expressions.Expression;

public class ExpressionBuilder extends scala.runtime.AbstractFunction1 {
  private Expression body;

  public ExpressionBuilder of(Expression body) {
    ExpressionBuilder out = new ExpressionBuilder();
    out.body = body;
    return out;
  }

  public Object apply(Object args) {
    if (((scala.collection.Seq) args).size() != 1) throw new IllegalArgumentException("one argument is expected");
    final Object arg = ((scala.collection.Seq) args).apply(0);
    return body.transform(new scala.runtime.AbstractPartialFunction() {
      public boolean isDefinedAt(Object e) { return e instanceof UnresolvedAttribute; }
      public Object applyOrElse(Object e, scala.Function1 other) { return isDefinedAt(e) ? arg : other.apply(e); }
    });
  }
}"""


@cache
def _builder(gateway):
    """One class for each JVM: the gateway knows methods by the name of their class."""
    compiler = gateway.jvm.org.codehaus.janino.SimpleCompiler()
    compiler.cook(BUILDER)
    return compiler.getClassLoader().loadClass("ExpressionBuilder").newInstance()


def register_expression(spark: SparkSession, name: str, sql: str) -> None:
    """A SQL name for an expression of one argument, which it names p. Unlike in SQL's own functions aggregates may be in it."""
    state = spark._jsparkSession.sessionState()
    builder = _builder(spark.sparkContext._gateway).of(state.sqlParser().parseExpression(sql))
    state.functionRegistry().createOrReplaceTempFunction(name, builder, "scala_udf")


def _histogram_sql(bins: int) -> str:
    """``prob_histogram`` by counts that are summed in parts: null and NaN are in no bin."""
    place = f"case when p is not null and not isnan(cast(p as double)) then least(greatest(floor(cast(p as double) * {bins}), 0), {bins - 1}) end"
    counts = ", ".join(f"cast(count_if({place} = {k}) as double)" for k in range(bins))
    unit = "transform(h, x -> if(n > 0, floor(x / n * 1e6 + 0.5) / 1e6, x))"
    norm = "sqrt(aggregate(h, 0e0, (s, x) -> s + x * x))"
    return f"get(transform(array(array({counts})), h -> get(transform(array({norm}), n -> {unit}), 0)), 0)"


def register_hooks(spark: SparkSession, scorer: Scorer | None = None) -> None:
    """SQL names: ``site_score(array<double>)`` (a vectorised scorer), the table functions
    ``motif_sites(seq, motif)`` and, for whole tables, ``read_motifs(table(reads), motif)`` (read_id, loc; a batch of
    reads at once), the aggregate ``prob_histogram(p)`` (20 bins, unit length, 6 decimals; over windows
    ``prob_histogram_over(p)``) and ``prob_bin(p, bins)``. The aggregate is an expression of counts: a call of Python for each group would take
    all the time where groups are small."""
    import pyarrow as pa
    from pyspark.sql.functions import arrow_udtf, pandas_udf, udtf

    from ..functions.gather import read_hits

    own = scorer or Linear()

    @pandas_udf("double")
    def site_score(v: pd.Series) -> pd.Series:
        return pd.Series(own(np.stack(v.to_numpy())) if len(v) else [], dtype=float)

    @udtf(returnType="loc: int")
    class MotifSites:
        def eval(self, seq: str, motif: str):
            at = seq.find(motif) if seq else -1
            while at >= 0:
                yield (at,)
                at = seq.find(motif, at + 1)

    @pandas_udf("array<double>")
    def prob_histogram(p: pd.Series) -> list:
        p = p.dropna().to_numpy(dtype=float)
        h = np.bincount(np.clip(np.floor(p * 20).astype(int), 0, 19), minlength=20).astype(float)
        norm = np.sqrt((h * h).sum())
        return list(np.floor(h / norm * 1e6 + 0.5) / 1e6 if norm else h)

    @arrow_udtf(returnType="read_id string, loc int")
    class ReadMotifs:
        def eval(self, batch: pa.RecordBatch, motif: pa.Array):
            row, loc = read_hits(batch.column("seq"), [motif[0].as_py()])
            yield pa.table({"read_id": batch.column("read_id").take(pa.array(row)), "loc": pa.array(loc, pa.int32())})

    spark.udf.register("prob_histogram_over", prob_histogram)
    if hasattr(spark, "_jvm"):
        register_expression(spark, "prob_histogram", _histogram_sql(20))
    else:  # a client without a JVM
        spark.udf.register("prob_histogram", prob_histogram)
    spark.udtf.register("read_motifs", ReadMotifs)
    spark.udf.register("site_score", site_score)
    spark.udtf.register("motif_sites", MotifSites)
    spark.sql("create or replace temporary function prob_bin(p double, bins int) returns int return cast(least(floor(p * bins), bins - 1) as int)")


def motif_table(df: DataFrame, motifs: list[str]) -> DataFrame:
    """The table function's rows by built-in functions: (read_id, loc)."""
    return df.select("read_id", F.explode(motif_hits("seq", motifs)).alias("loc"))


def normal_tail(z: Column) -> Column:
    """Two-sided p of a normal z: a rational approximation of the complementary error function
    (Abramowitz and Stegun 7.1.26, fixed coefficients), within 1.5e-7."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)
