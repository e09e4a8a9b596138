"""The pipeline's stages: columns, effects and the whole run."""

import corpus_pipeline as pipeline
from conftest import SF
from pyspark.sql import functions as F


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    bench = {r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        path = str(tmp_path / str(k))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "source_mixing":
            assert docs.columns == columns
            assert 0.5 * n < docs.count() <= n
        if name == "line_dedup":
            lines = [x for r in docs.collect() for x in (r.text or "").split("\n") if x.strip(" ")]
            assert len(lines) == len(set(lines))
            assert all(r.n_chars == len(r.text) for r in docs.collect())
        if name == "benchmark_decontamination":
            assert not any(b in (r.text or "") for r in docs.collect() for b in bench)
    assert set(docs.columns) >= {"doc_id", "size", "target", "taken"}
    got = sorted(tuple(r) for r in pipeline.run(spark, SF).select("doc_id", "size", "taken").collect())
    assert got == sorted(tuple(r) for r in docs.select("doc_id", "size", "taken").collect())


def test_stages_with_odd_rows_and_clashing_names(spark):
    """Nulls, empty and very long texts, repeated rows, no rows, and columns named like the operators' own."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    long = "the and that with which through " * 40_000
    odd = [(901, None, None, None, None), (902, "", "en", "a", 0), (903, long, "en", None, len(long)), (None, "the and of a null id", "en", "a", 20)]
    odd += [(904, "the line of a repeated row\nand that", "en", "b", 35)] * 2 + [(None, None, None, None, None)]
    rows = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")
    df = docs.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars")).union(rows)
    extra = ["removed", "_t", "_doc", "_tid", "tid", "row", "t", "key", "lid", "component", "shard", "start", "stop", "size", "_row"]
    for c in extra:
        df = df.withColumn(c, F.lit(f"own {c}"))
    kept = {}
    for name, stage in pipeline.STAGES:
        got = stage(spark, df, SF)
        assert stage(spark, df.limit(0), SF).count() == 0
        here = got.collect()
        kept[name] = here
        if name != "source_mixing":
            assert got.columns == df.columns
            assert all(r[c] == f"own {c}" for r in here for c in extra)
        else:
            assert set(got.columns) >= {*df.columns, "taken", "target"} and got.count() == df.count()
            assert all(r.removed == "own removed" and r["size"] == len((r.text or "").split()) for r in here)
    ids = {name: [r.doc_id for r in rows] for name, rows in kept.items()}
    assert {903, 904} <= set(ids["language_id"]) and not {901, 902} & set(ids["language_id"]) and ids["language_id"].count(904) == 2
    assert [r.text for r in kept["language_id"] if r.doc_id is None] == ["the and of a null id"]
    assert len(kept["line_dedup"]) == df.count() and {r.text for r in kept["line_dedup"] if r.doc_id in (901, 902)} == {None, ""}
    assert {901, 903} <= set(ids["simhash_near_dedup"]) and 902 not in ids["simhash_near_dedup"] and ids["simhash_near_dedup"].count(904) == 2
    assert {901, 902, 903, 904} <= set(ids["benchmark_decontamination"])
