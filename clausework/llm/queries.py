"""The registered queries of this folder: thin, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework.llm import bpe, decontaminate, html, jaccard, language, lattice, media, merkle, minhash, pii, quality, repair, sharding
from clausework.llm.common import table


def word_bpe() -> str:
    """Path of the public word-end BPE; a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return pii.pseudonymise(docs, pii.key_of(spark), counts="n_replaced")


def op2_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = lattice.pieces_of(public_tokenizers.path("piece_bpe_32k.model"))
    return lattice.score(table(spark, sf_dir, "documents"), pieces)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), word_bpe())


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify(language.document_rows(table(spark, sf_dir, "documents")), ["host"])
    return found.withColumnRenamed("id", "doc_id")


def pages_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify(language.page_rows(table(spark, sf_dir, "pages")), ["suffix", "domain", "host"])
    return found.withColumnRenamed("id", "page_id")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"), 8)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.document_media(table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = merkle.tampered_chars(F.col("doc_id"), F.col("n_chars"))
    return merkle.manifest(table(spark, sf_dir, "documents"), {"n_chars": changed})


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.audits(repair.damaged(table(spark, sf_dir, "conversations")), "dropped")


def pages_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with a figure for the document of its own number below its markup: the documents' texts are the payloads."""
    pages, docs = table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents").select("doc_id", "text")
    digest = docs.groupBy("doc_id").agg(F.min(F.sha2(media.padded(F.col("text")), 256)).alias("digest"))
    figure = F.concat(F.lit(f'<figure><img src="{media.SCHEME}'), F.coalesce("digest", F.lit("none")), F.lit('"><figcaption>'), F.col("url"), F.lit("</figcaption></figure>"))
    shown = pages.join(digest, F.col("page_id") == F.col("doc_id"), "left").select("page_id", F.concat("html", figure).alias("html"))
    return media.page_media(shown, docs)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": op1_pii,
        "op2_lattice": op2_lattice,
        "op3_bpe": op3_bpe,
        "op4_jaccard": op4_jaccard,
        "op5_html": op5_html,
        "op6_quality": op6_quality,
        "op7_language": op7_language,
        "pages_language": pages_language,
        "op8_decontamination": op8_decontamination,
        "op9_sharding": op9_sharding,
        "op10_media": op10_media,
        "pages_media": pages_media,
        "op11_merkle": op11_merkle,
        "op12_minhash": op12_minhash,
        "op13_repair": op13_repair,
    }
