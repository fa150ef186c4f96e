"""Every stage on odd rows, the whole pipeline on the given tables, and the registered queries."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from obsynth.llm import queries
from obsynth.llm.common import table
from tools.check import compare, connect

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, toxicity int, `a b` string"
LONG = " ".join(f"word{i}" for i in range(3000))
ROWS = [(1, LONG), (2, LONG), (2, LONG), (3, None), (4, ""), (None, LONG), (5, "token=abcdefghijklmnop " + LONG[:4000]), (6, "a few words"), (6, "a few words"), (7, LONG + " end")]


def odd(spark):
    return spark.createDataFrame([(d, t, None, "s", None, None, i, "x") for i, (d, t) in enumerate(ROWS)], SCHEMA)


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES[:-1]])
def test_stage_keeps_columns(spark, name):
    stage = dict(P.STAGES)[name]
    docs = odd(spark)
    out = stage(spark, docs, DATA)
    assert out.columns == docs.columns and out.count() <= len(ROWS)
    assert stage(spark, docs.limit(0), DATA).count() == 0


def test_one_of_each_stays(spark):
    kept = P.keep_one_of_each(spark, odd(spark), DATA).select("doc_id").collect()
    assert sorted((r[0] for r in kept), key=repr) == sorted([1, 3, 4, None, 5, 6], key=repr)


def test_secrets_take_effect(spark):
    out = P.mask(spark, odd(spark), DATA).where("doc_id = 5").first()
    assert out["text"].startswith("[SECRET] word0") and out["n_chars"] == len(out["text"])


def test_stages_reject_what_they_should(spark):
    docs, labels = table(spark, DATA.replace("sf0.001", "sf0.01"), "documents"), table(spark, DATA.replace("sf0.001", "sf0.01"), "labels")
    left = P.drop_poor(spark, docs, DATA.replace("sf0.001", "sf0.01")).select("doc_id")
    r = labels.join(left.withColumn("kept", F.lit(1)), "doc_id", "left").groupBy("quality").agg(F.avg(F.coalesce("kept", F.lit(0))).alias("kept"))
    share = {x["quality"]: x["kept"] for x in r.collect()}
    assert share[1] > 0.97 and share[0] < 0.1


def test_toxic_documents_go(spark):
    """The stage learns from all labels, so this is its fit; held-out figures are in test_classifiers."""
    d = DATA.replace("sf0.001", "sf0.1")
    left = P.drop_toxic(spark, table(spark, d, "documents"), d).select("doc_id")
    r = table(spark, d, "labels").join(left.withColumn("kept", F.lit(1)), "doc_id", "left").groupBy("toxic").agg(F.avg(F.coalesce("kept", F.lit(0))).alias("kept"))
    share = {x["toxic"]: x["kept"] for x in r.collect()}
    assert share[0] > 0.97 and share[1] < 0.25


def test_run(spark):
    out = P.run(spark, DATA)
    rows = out.collect()
    docs = {r["doc_id"] for r in table(spark, DATA, "documents").collect()}
    assert 0 < len({r["doc_id"] for r in rows}) <= len(docs) and {r["doc_id"] for r in rows} <= docs
    sums = {}
    for r in rows:
        sums[r["doc_id"]] = sums.get(r["doc_id"], 0) + r["length"]
    assert all(sums[r["doc_id"]] == r["doc_tokens"] for r in rows)


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, con, name):
    got = queries.QUERIES[name](spark, DATA).toArrow()
    assert got.num_rows > 0
    if name in queries.ORACLES:
        assert compare(got, con.execute(queries.ORACLES[name]).to_arrow_table()) == ""
