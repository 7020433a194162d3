"""A corpus from documents to training sequences, stage by stage; each stage's rows are a Parquet table that the next one reads."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import mixing, packing, pii, simhash, toxicity
from sievework.llm.queries import tokenizer_path
from sievework.llm.shared import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model doesn't hold toxic. It learns from labels and the texts of documents in sf_dir."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.clean_only(docs, toxicity.learn(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group whose shingles of five words are similar by 0.8 or more; blank ones are a group."""
    return simhash.one_of_each(docs)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by pseudonyms of the same format; n_chars, where there is one, follows the text. The
    key is the session's spark.sievework.pseudonym.key; without one, a random key of this run, which is kept nowhere: then equal
    values are linked within the run and nobody can undo them."""
    key = spark.conf.get("spark.sievework.pseudonym.key", None) or secrets.token_hex(32)
    out = pii.pseudonymised(docs, key, count_col=_unused(docs, "n_pii"))
    new = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return out.withColumns(new).select(*docs.columns)


def _unused(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name = "_" + name
    return name


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix to target weights: a row for each whole pass over a document and for its partial draw."""
    return mixing.drawn(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of the mix's documents, with its token ids, its sequence and its place there."""
    out = packing.packed(packing.tokenized(docs, tokenizer_path()))
    return out.select("doc_id", "piece", "start", "length", "ids", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("personal_data", hide_personal_data), ("mixing", mix_sources), ("packing", pack)]

#: Trained models, fingerprints and tokenizers are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
