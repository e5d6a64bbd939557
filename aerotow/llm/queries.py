"""Registered queries of the operators: opN_<name>(spark, sf_dir), whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, decontaminate, embedding_quality, jaccard, languages, licenses, lm, merkle, quality, spelling, toxicity, urls, warc
from .scratch import new_path, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def tokenizer_path() -> str:
    """The installed public vocabulary that the BPE query uses."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


@register
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(decontaminate.find_contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


@register
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(licenses.scan(table(spark, sf_dir, "documents")))


def page_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled page outcomes: a page's path ends with the number of the document that it shows; bad: its document
    is labelled as of low quality or toxic."""
    number = F.regexp_extract(urls.path(F.col("url")), r"/(\d{1,18})(?:\.html|/)?$", 1)
    pages = table(spark, sf_dir, "pages").select("page_id", number.alias("number")).where("number <> ''")
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(bad).alias("bad"))
    return pages.join(labels, F.col("number").cast("bigint") == F.col("doc_id")).select("page_id", "bad")


@register
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), page_outcomes(spark, sf_dir)).select(
        "page_id", "host", "path", "rule", "verdict")


@register
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).drop("text_hash", "removed_share")


@register
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(toxicity.learning_rows(docs, table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model).select(
        "doc_id", (toxicity.remainder() == 1).alias("held_out"), "score", "predicted")


@register
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write(warc.plan(table(spark, sf_dir, "pages")), path)
    return warc.report(warc.read(spark, path))


@register
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), tokenizer_path())


@register
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = toxicity.remainder()
    model = languages.fit(docs.where(fold != 1))
    return languages.predict(docs, model).select("doc_id", (fold == 1).alias("held_out"), "lang_pred", "score")


@register
def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = toxicity.remainder(by=7) == 2
    scored = lm.score(table(spark, sf_dir, "documents"), ~held_out, across=True)
    return scored.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@register
def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


@register
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(table(spark, sf_dir, "documents"))


@register
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


@register
def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = embedding_quality.fit(embedding_quality.learning_rows(docs, table(spark, sf_dir, "labels")))
    return embedding_quality.score(docs, model).select("doc_id", (embedding_quality.fold() == 0).alias("held_out"), "score", "predicted")
