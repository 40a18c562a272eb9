"""Sources and sinks: Parquet stores, XML, text formats, binary files, encryption, backup, and shared tables."""

from __future__ import annotations

import uuid
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def open_store(spark: SparkSession, path: str, *tables: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(str(PurePosixPath(path) / f"{t}.parquet") if "://" not in path else f"{path}/{t}.parquet") for t in tables}


def save(df: DataFrame, path: str, codec: str = "zstd", partition_by: list[str] = (), mode: str = "errorifexists") -> None:
    w = df.write.mode(mode).option("compression", codec)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def recompress(spark: SparkSession, source: str, target: str, codec: str = "zstd") -> None:
    save(spark.read.parquet(source), target, codec)


def backup(store: dict[str, DataFrame], path: str, key: Column | None = None) -> None:
    """Every table into a folder; with a key each row becomes one encrypted column `sealed` (see restore)."""
    for name, df in store.items():
        out = df if key is None else df.select(encrypt(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}), key).alias("sealed"))
        out.write.mode("overwrite").parquet(f"{path}/{name}.parquet")


def restore(spark: SparkSession, path: str, name: str, schema: str, key: Column) -> DataFrame:
    """A table of an encrypted backup; rows that another key sealed come out as nulls."""
    opened = decrypt(F.col("sealed"), key).cast("string")
    return spark.read.parquet(f"{path}/{name}.parquet").select(F.from_json(opened, schema).alias("x")).select("x.*")


def commit(df: DataFrame, path: str, listeners: list = ()) -> str:
    """Writes a new version beside those that are there and returns its folder; readers of older ones aren't disturbed.

    It counts once it is whole: Spark marks it at its end, and latest() passes over unmarked ones.
    """
    spark = df.sparkSession
    last = max((n for n, _ in _versions(spark, path, whole=False)), default=0)
    target = f"{path}/version={last + 1:012d}-{uuid.uuid4().hex}"
    df.write.parquet(target)
    for x in listeners:
        x.committed(target)
    return target


def _versions(spark: SparkSession, path: str, whole: bool = True) -> list[tuple[int, str]]:
    """Numbers and folders of committed versions in order."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(where):
        return []
    found = [s.getPath() for s in files.listStatus(where) if s.getPath().getName().startswith("version=")]
    mark = spark._jvm.org.apache.hadoop.fs.Path
    kept = [p for p in found if not whole or files.exists(mark(p, "_SUCCESS"))]
    return sorted((int(p.getName()[len("version=") :].partition("-")[0]), p.toString()) for p in kept)


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The last committed version."""
    return spark.read.parquet(_versions(spark, path)[-1][1])


def rollback(spark: SparkSession, path: str) -> str | None:
    """Takes the last committed version back, and all that were begun after it; gives the folder of the one before, if there is one."""
    whole = _versions(spark, path)
    for n, folder in _versions(spark, path, whole=False):
        if whole and n >= whole[-1][0]:
            where = spark._jvm.org.apache.hadoop.fs.Path(folder)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return whole[-2][1] if len(whole) > 1 else None


def export_xml(df: DataFrame, path: str, row_tag: str = "row", root_tag: str = "rows") -> None:
    df.write.format("xml").option("rowTag", row_tag).option("rootTag", root_tag).save(path)


def import_xml(spark: SparkSession, path: str, schema: str, row_tag: str = "row") -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def things_from_xml(df: DataFrame, xml: str, schema: str) -> DataFrame:
    """A column of XML documents parsed into a struct x."""
    return df.withColumn("x", F.from_xml(xml, schema))


def separated(spark: SparkSession, path: str, schema: str, sep: str = "|", comment: str = "#") -> DataFrame:
    return spark.read.option("sep", sep).option("comment", comment).schema(schema).csv(path)


def split_lines(spark: SparkSession, path: str, sep: str, names: list[str]) -> DataFrame:
    """Lines cut at a literal separator of any length; lines with another number of parts are left out."""
    parts = F.split(F.col("value"), rf"\Q{sep}\E")
    rows = spark.read.text(path).select(parts.alias("p")).where(F.size("p") == len(names))
    return rows.select(*[F.trim(F.get("p", F.lit(i))).alias(n) for i, n in enumerate(names)])


def blobs(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def blob_range(content: Column, start: int, length: int) -> Column:
    """Bytes start to start + length - 1 of a binary column, from 0."""
    return F.substring(content, start + 1, length)


def encrypt(c: Column, key: Column) -> Column:
    return F.aes_encrypt(c.cast("binary"), key)


def decrypt(c: Column, key: Column) -> Column:
    return F.try_aes_decrypt(c, key)
