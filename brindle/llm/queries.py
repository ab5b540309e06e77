"""The operators' queries over the driver's tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, chat, decontam, html, langid, merkle, multihash, neardup, pieces, pii, topk, toxicity, warc
from .oracle import ORACLES  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> str:
    """The vocabulary file's place; it is never copied."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.exact_top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5, scale=256.0)


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.grouped(table(spark, sf_dir, "documents"), neardup.Join(words=4, percent=80))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.sanitised_spans(table(spark, sf_dir, "documents")))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.learn(documents, table(spark, sf_dir, "labels"))
    found = toxicity.score(documents, model, threshold=0.7)
    return found.select("doc_id", toxicity.is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "evidence")


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat.repair(table(spark, sf_dir, "conversations"))
    return found.select("conv_id", "turn", "role", "new_role", "action", "inserted", "inserted_after", F.sha2("part", 256).alias("part_sha256"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), piece_model())


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return decontam.digest_items(found)


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.told(centroids.cluster(table(spark, sf_dir, "embeddings"), centroids.Clustering(centroids=40, rounds=5, dimension=64, scale=256.0)))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multihash.edited_fingerprints(table(spark, sf_dir, "documents"), share=4)


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's proof holds against its own row, or against the row with one character more where a seventh is tampered with."""
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    other = merkle.leaf_digest([F.try_add("n_chars", F.lit(1)) if f == "n_chars" else F.col(f) for f in fields])
    chosen = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    found = merkle.manifest(table(spark, sf_dir, "documents"), fields, "lang", "doc_id", more={"other": F.when(chosen, other)})
    found = merkle.verified(found.withColumn("held", F.coalesce("other", "leaf")), "held")
    return found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", "verified")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk": op1_topk,
    "op2_minhash": op2_minhash,
    "op3_warc": op3_warc,
    "op4_pii": op4_pii,
    "op5_toxicity": op5_toxicity,
    "op6_langid": op6_langid,
    "op7_chat": op7_chat,
    "op8_html": op8_html,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_decontamination": op10_decontamination,
    "op11_centroids": op11_centroids,
    "op12_fingerprints": op12_fingerprints,
    "op13_manifest": op13_manifest,
}
