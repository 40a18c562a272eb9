"""A corpus pipeline over the table documents: STAGES in order, each written as Parquet and read again.

Every stage takes the documents that its predecessor kept and returns the columns of documents; the last
returns tokens. Its functions take (spark, docs, sf_dir).

Rows: null texts count as empty, are kept as not toxic, have no near duplicates, no secrets and no tokens, and are
never taken by the mix, as are texts without a word. A null source is a source of its own. Ids may be null or
repeated: then rows are told apart by themselves, rows equal in id and text are one, and of a group of near
duplicates the one with the least id stays, nulls last. Columns beside those of documents pass through all stages
but the last, unless their names begin with an underscore. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import bpe, mixing, ngram_join, secret_scan, toxicity
from tessera.llm.common import discard, materialize, n_words, packed, table, unpacked
from tessera.llm.queries import tokenizer_path, toxicity_model


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below one half stay."""
    rest = [c for c in docs.columns if c != "text"]  # held apart, as one of them may be named like a result
    scored = toxicity.score(docs.select(packed(docs, rest), "text"), toxicity_model(spark, docs, sf_dir))
    return scored.where("score < 0.5").select(*unpacked(rest), "text").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of links the document with the least id stays, nulls last; of rows equal in id and text, one."""
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        gone = materialize(ngram_join.join(docs).where("component_id <> doc_id").select("doc_id"), "gone")
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    # ids don't tell rows apart: rows are numbered
    rows = materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    joined = ngram_join.join(rows, "_row").select(F.col("doc_id").alias("_row"), "component_id")
    first = joined.join(rows.select("_row", "doc_id"), "_row").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row"))["_row"].alias("_row"))
    kept = rows.join(materialize(first.select("_row"), "kept"), "_row", "left_semi")
    known = F.col("doc_id").isNotNull()
    return kept.where(known).dropDuplicates(["doc_id", "text"]).unionByName(kept.where(~known)).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets give way to their kind in brackets."""
    clean = secret_scan.redact_all(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (0 to 2 times). Of rows equal in id and text, which of them are taken makes no difference."""
    key = F.xxhash64("text")
    narrow = materialize(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), key.alias("_h")), "narrow")
    taken = mixing.mix(narrow, keep=["doc_id", "_h"]).groupBy("doc_id", "_h").agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows"))
    taken = materialize(taken.select(F.col("doc_id").alias("_id"), F.col("_h").alias("_key"), "_copies", "_rows"), "taken")
    discard(narrow)
    some, each = taken.where("_copies > 0"), F.col("_copies")
    rows = docs.withColumn("_h", key).join(some, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("_h").eqNullSafe(F.col("_key")))
    if not some.where("_rows > 1").isEmpty():  # equal rows share what is taken of them
        rank = F.row_number().over(Window.partitionBy("_id", "_key").orderBy("_key"))
        each = F.floor(F.col("_copies") / F.col("_rows")) + (rank <= F.col("_copies") % F.col("_rows")).cast("int")
    rows = rows.withColumn("_times", each.cast("int")).where("_times > 0")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids of every row."""
    coded = bpe.encode(docs.select("doc_id", "source", "text"), tokenizer_path("word_bpe_49k.json"))
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("toxicity", drop_toxic), ("ngram_join", drop_near_duplicates), ("secrets", redact_secrets), ("mixing", mix_sources), ("bpe", tokenize)]
#: The stages learn a model, find components and fit budgets, which SQL can't express; tests compare each with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        if i:
            discard(before)
    return docs
