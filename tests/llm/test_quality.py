"""Held-out quality of the models that are trained here, on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.llm import lm_scoring, toxicity

SF = "/root/testdata/sf0.01"


def test_language_model_beats_counts_on_held_out_texts(spark):
    held = lm_scoring.query(spark, SF).filter("held_out")
    one = held.agg(F.sum("score").alias("score"), F.sum("base_score").alias("base"), F.sum("n_tokens").alias("n"), F.avg((F.col("score") > F.col("base_score")).cast("int")).alias("better")).first()
    assert (one.score - one.base) / one.n > 0.1 and one.better > 0.9


def test_toxicity_on_held_out_labels(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    found = toxicity.query(spark, SF).join(labels, "doc_id").filter("held_out")
    n = {(r.toxic, r.predicted): r["count"] for r in found.groupBy("toxic", "predicted").count().collect()}
    assert n.get((1, 1), 0) >= n.get((1, 0), 0) and n.get((0, 1), 0) <= 0.02 * n[0, 0]
