"""The registered queries of this package and the SQL they are checked against."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugelake.llm import (
    bpe,
    conversations,
    embedding_dedup,
    fingerprints,
    lm,
    manifest,
    mixing,
    packing,
    pii,
    quality,
    simhash,
    suffix_dedup,
    token_files,
)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def op1_mixing(spark, sf_dir):
    rows = mixing.mixed(documents(spark, sf_dir, "doc_id", "text", "source"))
    return rows.selectExpr(
        "doc_id",
        "mix_size as size",
        "mix_source_size as source_size",
        "mix_target as target",
        "mix_size * mix_copies as taken",
    )


def op2_quality(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality.score(documents(spark, sf_dir, "doc_id", "text"), labels)


def op3_bpe(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = documents(spark, sf_dir, "doc_id", "text")
    return bpe.digests(docs, path, public_tokenizers.PATTERN)


def op4_pii(spark, sf_dir):
    docs = documents(spark, sf_dir, "doc_id", "text")
    return pii.find(docs, pii.train(docs))


def op5_suffix_dedup(spark, sf_dir):
    rows = suffix_dedup.deduplicated(documents(spark, sf_dir, "doc_id", "text"))
    return rows.selectExpr(
        "doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256) as kept_sha256"
    )


def op6_simhash(spark, sf_dir):
    return simhash.near_duplicates(documents(spark, sf_dir, "doc_id", "text"))


def op7_fingerprints(spark, sf_dir):
    rows = fingerprints.fingerprinted(documents(spark, sf_dir, "doc_id", "text"))
    vec, other, after = F.col("vec"), F.col("edited_vec"), F.col("next_vec")
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprints.written(vec).alias("fingerprint"),
        fingerprints.written(other).alias("edited_fingerprint"),
        fingerprints.likeness(vec, other).alias("near_edited"),
        fingerprints.likeness(vec, after).alias("near_next"),
    )


def op8_embeddings(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return embedding_dedup.near_duplicates(vectors.select("vec_id", "embedding"))


def op9_token_files(spark, sf_dir):
    docs = documents(spark, sf_dir, "doc_id", "text")
    return token_files.written(docs, public_tokenizers.path("byte_bpe_50k.json"))


def op10_lm(spark, sf_dir):
    docs = documents(spark, sf_dir, "doc_id", "text")
    return lm.score(docs, public_tokenizers.path("byte_bpe_50k.json"))


def op11_manifest(spark, sf_dir):
    docs = documents(spark, sf_dir, *manifest.FIELDS)
    rows = manifest.manifest(docs, {"tampered": manifest.tampered()})
    root = manifest.folded(F.coalesce("tampered", "leaf"), F.col("path"))
    return rows.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        manifest.proof(F.col("path")).alias("proof_sha256"),
        root.alias("folded_root"),
        (root == F.col("root")).alias("verified"),
    )


def op12_conversations(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found = conversations.Repair(rows)
    digests = found.digests().withColumnRenamed("conv_id", "_conv")
    every = found.audits.join(digests, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    return every.select(*found.audits.columns, "repaired_sha256")


def op13_packing(spark, sf_dir):
    docs = documents(spark, sf_dir, "doc_id", "text")
    rows = packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))
    return rows.withColumn("length", F.col("length").cast("long"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_quality": op2_quality,
    "op3_bpe": op3_bpe,
    "op4_pii": op4_pii,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_simhash": op6_simhash,
    "op7_fingerprints": op7_fingerprints,
    "op8_embeddings": op8_embeddings,
    "op9_token_files": op9_token_files,
    "op10_lm": op10_lm,
    "op11_manifest": op11_manifest,
    "op12_conversations": op12_conversations,
    "op13_packing": op13_packing,
}

ORACLE: dict[str, str] = {
    "op1_mixing": mixing.SQL,
    "op5_suffix_dedup": suffix_dedup.SQL,
    "op8_embeddings": embedding_dedup.SQL,
    "op11_manifest": manifest.SQL,
    "op12_conversations": conversations.SQL,
}
