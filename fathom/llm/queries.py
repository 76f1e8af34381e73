"""One query per operator, over its whole table, and DuckDB SQL where SQL can say the same."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import exact_dedup, fill_in_middle, grid_order_join, hmm_lm, lang_id, merkle_manifest, minhash_forest, quality_fm, secret_scan, segtree_bpe, source_mix, token_planes, topk_search

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
MULTI_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark, sf_dir):
    return secret_scan.digest(table(spark, sf_dir, "documents"))


def op2_token_planes(spark, sf_dir):
    return token_planes.write_and_read(table(spark, sf_dir, "documents"), BYTE_BPE)


def op3_minhash_forest(spark, sf_dir):
    return minhash_forest.groups(table(spark, sf_dir, "documents"), k=4)


def op4_hmm_lm(spark, sf_dir):
    return hmm_lm.score(table(spark, sf_dir, "documents"))


def op5_segtree_bpe(spark, sf_dir):
    return segtree_bpe.digests(table(spark, sf_dir, "documents"), MULTI_BPE, public_tokenizers.PATTERN)


def op6_source_mix(spark, sf_dir):
    return source_mix.mix(table(spark, sf_dir, "documents"))


def op7_topk_search(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").selectExpr("vec_id as id", "embedding as vector")
    return topk_search.top_k(vectors, vectors.where("id % 50 = 0"), k=5)


def op8_grid_order_join(spark, sf_dir):
    return grid_order_join.groups(table(spark, sf_dir, "embeddings"), cosine=0.95)


def op9_lang_id(spark, sf_dir):
    return lang_id.predict(table(spark, sf_dir, "documents"))


def op10_quality_fm(spark, sf_dir):
    return quality_fm.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_merkle_manifest(spark, sf_dir):
    return merkle_manifest.digests(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark, sf_dir):
    return fill_in_middle.digests(table(spark, sf_dir, "documents"))


def op13_exact_dedup(spark, sf_dir):
    return exact_dedup.groups(table(spark, sf_dir, "documents"), text_sha256=F.sha2(exact_dedup.normalised(F.col("text")), 256))


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_token_planes, op3_minhash_forest, op4_hmm_lm, op5_segtree_bpe, op6_source_mix, op7_topk_search, op8_grid_order_join, op9_lang_id,
        op10_quality_fm, op11_merkle_manifest, op12_fill_in_middle, op13_exact_dedup,
    )
}
ORACLES = {
    "op6_source_mix": source_mix.ORACLE,
    "op7_topk_search": topk_search.ORACLE,
    "op11_merkle_manifest": merkle_manifest.ORACLE,
    "op12_fill_in_middle": fill_in_middle.ORACLE,
    "op13_exact_dedup": exact_dedup.ORACLE,
}
