"""A corpus pipeline in stages; each stage's rows are written as Parquet and read by the next.

All stages but the last return the columns of documents, whatever else the table holds; columns whose
names clash with an operator's own come through unchanged. An empty table gives an empty table at every
stage. What each does with nulls, empty texts and repeated rows is said below.
"""

import public_tokenizers

from gaugelake.llm import bpe, mixing, near_texts, pii, quality, simhash
from gaugelake.settle import settle


def good(spark, docs, sf_dir):
    """Documents that the quality classifier, fitted on the labels, accepts.

    Null and empty texts are scored as an empty text; repeated rows are accepted or go alike, rows
    without doc_id are scored like any other. Without labels of both kinds nothing is accepted.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality.keep_good(docs, labels)


def distinct(spark, docs, sf_dir):
    """One document of each group of near-duplicates, the one with the smallest doc_id.

    Near-duplicates share about 0.8 of their shingles of five words, or are linked by such texts.
    Null and empty texts are near-duplicates of each other. Of repeated rows of a doc_id one stays,
    of tied texts the first; rows without doc_id all stay.
    """
    return simhash.keep_one(docs, near_texts.near_texts)


def private(spark, docs, sf_dir):
    """All documents, personal data replaced by its kind, with n_chars as the text is now.

    Every row stays; null and empty texts as they are, repeated rows alike.
    """
    return pii.redacted(docs, pii.train(docs))


def mixed(spark, docs, sf_dir):
    """Documents as often as the mix of sources to target weights takes them, up to three times.

    A null source is a source. Null and empty texts have no words and come once at most. Repeated
    rows are drawn each on their own.
    """
    return mixing.mix(docs)


def tokens(spark, docs, sf_dir):
    """Token ids of each document, with the digests of ids and decoded bytes.

    Null and empty texts have no ids; every row stays, repeated ones too.
    """
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = bpe.encoded(docs, path, public_tokenizers.PATTERN)
    return rows.selectExpr(
        "doc_id",
        "cast(length(ids) / 4 as long) as n_tokens",
        "ids",
        "sha2(ids, 256) as ids_sha256",
        "sha2(decoded, 256) as decoded_sha256",
    )


STAGES = [
    ("quality classifier", good),
    ("SimHash near-dedup", distinct),
    ("PII", private),
    ("mixing sources", mixed),
    ("byte-level BPE", tokens),
]

#: Fingerprints by XXH64, the fitted models and BPE can't be expressed in DuckDB's SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Apply all stages to the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
