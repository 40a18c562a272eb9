"""The registered query of each operator, and its SQL where SQL can express it."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, chat, itq, licenses, mixing, ngram_join, pii, quality, secret_scan, toxicity
from tessera.llm.common import materialize, n_words, table
from tessera.llm.oracle import ORACLE_SQL as ORACLE_SQL


#: Anyone can map back what was mapped by this key: it shows the query on test tables, and is no secret.
DEMONSTRATION_KEY = "a key for demonstrations only"


def tokenizer_path(name: str) -> str:
    """A public tokenizer's file: from the folder in TESSERA_TOKENIZERS, else from the installed package."""
    if folder := os.environ.get("TESSERA_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("word_bpe_49k.json"), decoded="decoded")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.candidates(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    found = secret_scan.discoveries(materialize(found, "secrets"))  # counted over all, then judged: written once
    return found.select("doc_id", *_kinds(), F.sha2(secret_scan.joined("plain"), 256).alias("base_sha256"), secret_scan.joined("spans").alias("spans"))


def _kinds() -> list:
    """n_assign, n_access and n_hex: plain spans of each kind."""
    return [F.size(F.array_remove(F.transform("plain", _is(k)), 0)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]


def _is(kind: str):
    return lambda s: (s["kind"] == kind).cast("int")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text under pseudonyms; the key is a secret of the deployment, from TESSERA_PII_KEY, else DEMONSTRATION_KEY."""
    key = os.environ.get("TESSERA_PII_KEY", DEMONSTRATION_KEY).encode()
    return pii.pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), key)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    mixed = mixing.mix(materialize(docs, "docs"))  # sizes are read often, so counted once
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = quality.with_counts(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    judged = quality.judge(materialize(counted.drop("text"), "quality"))  # read twice, so written once
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("class_distance", 6).alias("class_distance"), F.round("common_distance", 6).alias("common_distance"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], said.schema)
    said = said.unionByName(more)
    paths = chat.best_paths(chat.linear(said, "conv_id", "turn", "role", "text"), "conv", "node", "parent", "score")
    made = chat.format_paths(paths, said, "conv_id", None, "role", "text", turn="turn")
    return chat.read_back(made).withColumnRenamed("tree", "conv_id")


def op9_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_duplicates(table(spark, sf_dir, "embeddings"))


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Field:
    """Learned from the labelled rows of docs that aren't held out."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out())
    return toxicity.train(docs.select("doc_id", "text"), labels)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity_model(spark, docs, sf_dir), keep=["doc_id"])
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "toxic_spans")


QUERIES = {"op1_bpe": op1_bpe, "op2_licenses": op2_licenses, "op3_secrets": op3_secrets, "op4_ngram_join": op4_ngram_join, "op5_pii": op5_pii, "op6_mixing": op6_mixing, "op7_quality": op7_quality, "op8_chat": op8_chat, "op9_itq": op9_itq, "op10_toxicity": op10_toxicity}
