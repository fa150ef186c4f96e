"""Held-out accuracy on the given tables, and defined scores for odd rows and missing labels."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsynth.llm import quality, queries, toxicity
from obsynth.llm.common import crc_fold, labelled_sample, table

DATA = os.environ.get("TEST_LLM_DIR", "/root/testdata/sf0.1")
ODD = [(1, ""), (2, None), (None, "some words"), (3, "x" * 200_000), (3, "same"), (3, "same"), (4, " \n"), (5, "the " * 40_000)]


@pytest.mark.parametrize(("name", "label", "least"), [("op2_random_indexing_quality", "quality", 0.98), ("op3_compression_toxicity", "toxic", 0.93)])
def test_held_out_accuracy(spark, name, label, least):
    scored = queries.QUERIES[name](spark, DATA).join(table(spark, DATA, "labels"), "doc_id")
    r = scored.where("held_out").agg(
        F.avg((F.col("predicted") == F.col(label)).cast("int")).alias("right"), F.min("score").alias("lo"), F.max("score").alias("hi"),
        F.avg(F.when(F.col(label) == 1, F.col("score"))).alias("ones"), F.avg(F.when(F.col(label) == 0, F.col("score"))).alias("zeros"),
    ).first()
    assert r["right"] >= least and 0 <= r["lo"] and r["hi"] <= 1 and r["ones"] > r["zeros"] + 0.4


def test_held_out_toxicity(spark):
    """A constant reaches 0.88 accuracy: recall, precision and the order of scores count."""
    scored = queries.QUERIES["op3_compression_toxicity"](spark, DATA).join(table(spark, DATA, "labels"), "doc_id").where("held_out")
    rows = sorted((r["score"], r["toxic"]) for r in scored.collect())
    toxic = [s for s, t in rows if t]
    caught = sum(s >= 0.5 for s in toxic)
    ranks = [i + 1 for i, (_, t) in enumerate(rows) if t]
    auc = (sum(ranks) - len(toxic) * (len(toxic) + 1) / 2) / (len(toxic) * (len(rows) - len(toxic)))
    print("recall", caught / len(toxic), "precision", caught / sum(s >= 0.5 for s, _ in rows), "auc", auc)
    assert caught / len(toxic) >= 0.75 and caught / sum(s >= 0.5 for s, _ in rows) >= 0.85 and auc >= 0.92


def test_dictionaries_are_trained_on_whole_texts():
    """A marked word far behind the beginning of very long texts reaches the dictionary."""
    rng = random.Random(0)
    plain = lambda n: " ".join(rng.choice("abcdef") + rng.choice("ghijkl") + rng.choice("mnopqr") for _ in range(n))
    long = lambda: plain(rng.randint(6000, 9000))
    end = lambda word: "".join(f" {word} {plain(30)}" for _ in range(6))
    texts = [long() + end("vexation") for _ in range(30)] + [long() for _ in range(60)]
    y = np.array([1] * 30 + [0] * 60)
    model = toxicity.fit([t.encode() for t in texts], y, np.arange(90) % 4)
    assert b"VEXation" in model.toxic and b"VEXation" not in model.ordinary
    gains = toxicity.Gains(model)
    p = model.probability(gains.features([(plain(8000) + end(w)).encode() for w in ("vexation", "fgm")]))
    assert p[0] > 0.5 > p[1]


@pytest.mark.parametrize(("module", "score", "label"), [(quality, quality.score_quality, "quality"), (toxicity, toxicity.score_toxicity, "toxic")])
def test_odd_rows_and_labels(spark, module, score, label):
    docs = spark.createDataFrame([(d, t, 9.0, i) for i, (d, t) in enumerate(ODD)], "doc_id long, text string, score double, label int")
    for marks in ([], [(1, 1, 1)], [(1, 0, 0), (3, 1, 1), (4, None, None), (None, 1, 1), (99, 0, 0)]):
        labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
        model = module.train(docs, labels, F.lit(False))
        out = score(docs, model)
        got = out.collect()
        assert out.columns == ["doc_id", "text", "label", "score"] and len(got) == len(ODD)
        assert all(0 <= r["score"] <= 1 for r in got)
        by = {r["label"]: r["score"] for r in got}
        assert by[4] == by[5] and by[0] == by[1]
        assert score(docs.limit(0), model).count() == 0
    assert module.train(docs.limit(0), labels, F.lit(False)) is not None


def test_sample_is_bounded_and_leaves_held_rows_out(spark):
    labels = spark.range(500).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("toxic"))
    got = labelled_sample(labels.union(labels), "toxic", crc_fold("doc_id", 5) == 0, {0: 10, 1: 7}).collect()
    assert sorted(r["label"] for r in got) == [0] * 10 + [1] * 7
    held = {r["doc_id"] for r in labels.where(crc_fold("doc_id", 5) == 0).collect()}
    assert not held & {r["doc_id"] for r in got}
