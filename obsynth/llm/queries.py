"""The numbered queries with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality, toxicity
from .bpe import encode_decode
from .common import crc_fold, table
from .dialogue import conversation_report, damaged
from .html_main import extract_main
from .media import png_features, texts_to_png
from .ngram_join import Similarity, near_duplicates
from .packing import pack_documents
from .secret_scan import report_sql, secret_report
from .simhash import simhash_groups
from .spelling import letter_runs, misspelt, spelling_variants, word_counts
from .topk import exact_top_k
from .urls import judge_pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def op(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@op
def op1_template_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main(table(spark, sf_dir, "pages"))


def scored(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@op
def op2_random_indexing_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), crc_fold("doc_id", 3) == 1
    model = quality.train(docs, table(spark, sf_dir, "labels"), held)
    return scored(quality.score_quality(docs.select("doc_id", "text", held.alias("held_out")), model))


@op
def op3_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), crc_fold("doc_id", 5) == 0
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), held)
    return scored(toxicity.score_toxicity(docs.select("doc_id", "text", held.alias("held_out")), model))


@op
def op4_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"))


ORACLES["op4_entropy_secrets"] = report_sql()


@op
def op5_host_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_pages(table(spark, sf_dir, "pages")).drop("trust", "distrust")


@op
def op6_fragment_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), Similarity(words=4, percent=85))


ORACLES["op6_fragment_jaccard"] = """
with recursive w as (
    select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents
), s as (
    select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
        else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) end as s from w
), g as (select doc_id, unnest(s) as g from s),
o as (select a.doc_id as a, b.doc_id as b, count(*) as n from g a join g b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select a, b from o join s x on x.doc_id = a join s y on y.doc_id = b where 100 * n >= 85 * (len(x.s) + len(y.s) - n)),
e as (select a, b from l union all select b, a from l),
r(a, b) as (select doc_id, doc_id from s union select r.a, e.b from r join e on r.b = e.a)
select doc_id, cast(len(s) as bigint) as n_shingles, min(r.b) as component_id from s join r on r.a = doc_id group by doc_id, len(s)
"""


@op
def op7_norm_sorted_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"))


ORACLES["op7_norm_sorted_top_k"] = """
with v as (
    select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v from embeddings
    where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
    select a.vec_id as query_id, b.vec_id, cast(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) as bigint) as score
    from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0
)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
from s qualify rank <= 20
"""


@op
def op8_png_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return png_features(texts_to_png(table(spark, sf_dir, "documents"))).drop("hash", "error")


@op
def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"))


@op
def op10_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


@op
def op11_gram_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = misspelt(letter_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), least=6), one_in=199)
    return spelling_variants(word_counts(runs, least_chars=6, least=5), factor=5)


@op
def op12_grammar_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversation_report(damaged(rows), rows.select("conv_id"))


@op
def op13_tiled_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"), words=4, radius=4)
