"""Held-out accuracy of the learned operators on the given tables."""

from matchloom.llm import queries

SF = "/root/testdata/sf0.01"


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = queries.op10_language_id(spark, SF).join(docs, "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").collect()
    right = sum(r["lang"] == r["lang_pred"] for r in rows)
    assert len(rows) > 150 and right >= 0.97 * len(rows), (right, len(rows))
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"  # some hundred toxic rows
    labels = spark.read.parquet(f"{sf}/labels.parquet").groupBy("doc_id").agg({"toxic": "max"}).withColumnRenamed("max(toxic)", "toxic")
    rows = queries.op3_toxicity(spark, sf).join(labels, "doc_id").where("held_out and toxic is not null").collect()
    bad, good = [r for r in rows if r["toxic"] == 1], [r for r in rows if r["toxic"] == 0]
    assert len(bad) >= 50 and sum(r["predicted"] for r in bad) >= 0.9 * len(bad)
    assert len(good) >= 400 and sum(r["predicted"] for r in good) <= 0.05 * len(good)
    assert all(r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows)
