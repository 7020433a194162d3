"""The queries of this subpackage and their SQL, which __spark_entry__.py adds to the others."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, mixing, negatives, oracles, packing, pii, quality, search, sharding, simhash, substrings, toxicity, urls, vectors

#: The key of the pseudonyms that the queries make. A deployment gives its own.
SECRET = "sievework"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(_table(spark, sf_dir, "documents"), SECRET).select("doc_id", "text", "n_pii")


def op3_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.linked(_table(spark, sf_dir, "embeddings"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mixed(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "shard")


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.deduplicated(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, _table(spark, sf_dir, "labels"))
    return toxicity.predict(docs, model).withColumn("toxic", F.col("p_toxic") > 0.5)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0")).alias("fingerprint"), "component_id")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.cleaned(_table(spark, sf_dir, "documents"), "source").drop("text")


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes are the pages' own: a page is bad that quality's base rule would find too short."""
    return urls.filtered(_table(spark, sf_dir, "pages"), urls.thin(F.col("html")), urls.RULES)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.packed(packing.tokenized(_table(spark, sf_dir, "documents"), tokenizer_path()))
    return out.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in steps of 1 / 256; labels of every seventh id are the next one's."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = _table(spark, sf_dir, "embeddings").where(finite).select("vec_id", label.alias("label"), F.transform(v, lambda x: F.floor(256 * x.cast("double"))).alias("vector"))
    return negatives.mined(rows, F.col("vec_id") % 100 == 0)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.placed(_table(spark, sf_dir, "documents"), shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(search.indexed(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = [op1_language_id, op2_pii, op3_vectors, op4_mixing, op5_substrings, op6_toxicity, op7_simhash, op8_quality, op9_urls, op10_packing, op11_negatives, op12_sharding, op13_search]
    return {f.__name__: f for f in own} | {"pipeline": partial(corpus_pipeline.run)}


def oracle_sql() -> dict[str, str]:
    return {"op3_vectors": oracles.VECTORS, "op4_mixing": oracles.mixing(), "op5_substrings": oracles.SUBSTRINGS, "op8_quality": oracles.QUALITY, "op9_urls": urls.SQL, "op11_negatives": negatives.SQL, "op12_sharding": sharding.sql(), "op13_search": search.SQL}
