"""Five stages from raw documents to token digests. Each stage works on what the one before it kept.

All stages but the last take and return rows with the columns of documents.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fathom.llm import minhash_forest, quality_fm, queries, secret_scan, segtree_bpe, source_mix
from fathom.llm.common import whole


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier, fitted on labels, doesn't reject."""
    return quality_fm.accepted(docs, queries.table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity of 0.8 or more."""
    return minhash_forest.one_of_each(docs, k=5, percent=80)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark."""
    return secret_scan.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the mix: whole repetitions of a document, and its first words where a source's fraction ends."""
    return source_mix.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of what they decode to, for each row of the mix."""
    return segtree_bpe.digests(docs, queries.MULTI_BPE, public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", classify),
    ("MinHash near-dedup", deduplicate),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]

#: SQL expresses neither the trained classifier nor the BPE merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's result is a table of its own; those but the last are deleted at the end."""
    return _run(queries.table(spark, sf_dir, "documents"), sf_dir)


@whole
def _run(docs: DataFrame, sf_dir: str) -> DataFrame:
    for _, stage in STAGES:
        docs = stage(docs.sparkSession, docs, sf_dir)
    return docs
