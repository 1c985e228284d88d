"""The registered queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkgraph.llm import decontam, jaccard, langid, minhash, omh, packing, secret_scan, sharding, spelling, toxicity, trie, warc, wavelet
from linkgraph.llm.common import fold

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(table(spark, sf_dir, "pages"))


def op2_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.token_table(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_jaccard_rtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op4_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op5_secret_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op6_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), fold("doc_id", 5) == 0
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held)
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op7_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), by_window=True)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return omh.fingerprints(table(spark, sf_dir, "documents"))


def language_model(docs: DataFrame) -> langid.Model:
    return langid.fit(docs, fold("doc_id", 3) != 1)


def op10_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, language_model(docs)).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", F.col("n_spans"))


def op11_minhash_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.join(table(spark, sf_dir, "documents"), k=5, num=85, den=100)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(table(spark, sf_dir, "conversations"), rebuild=True)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


OPS = (op1_warc_derivatives, op2_wavelet_shards, op3_jaccard_rtree, op4_extendible_shards, op5_secret_battery, op6_toxicity_cnn, op7_template_decontamination, op8_best_fit_packing, op9_order_minhash, op10_language_spans, op11_minhash_bayes, op12_prefix_trie, op13_spelling_variants)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPS}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_derivatives": warc.oracle(), "op3_jaccard_rtree": jaccard.oracle(k=4), "op4_extendible_shards": sharding.oracle(), "op11_minhash_bayes": jaccard.oracle(k=5, kept=True), "op12_prefix_trie": trie.oracle(), "op13_spelling_variants": spelling.oracle()}
