"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.session import scratch_folder

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: For the job that writes a step: its shuffle files are of no use to the next one, which reads the written
#: table, and batches for Python are bounded in bytes, whatever the length of a text.
STEP = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
}
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def word_count(text: Column) -> Column:
    """Number of words as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def written(df: DataFrame, purpose: str, settings: dict[str, str] | None = None, kinds: str | None = None) -> DataFrame:
    """Write a step's result to the shared folder and read it back; ``settings`` hold for this step. ``kinds``: a column to lay rows out by.

    It cuts the lineage: a lost executor costs no earlier step. The shuffle files of the step go as
    soon as it has ended.
    """
    step = {**STEP, **(settings or {})}
    spark = df.sparkSession
    path = scratch_folder(spark, purpose)
    before = {key: spark.conf.get(key) for key in step}
    try:
        for key, value in step.items():
            spark.conf.set(key, value)
        (df.write.partitionBy(kinds) if kinds else df.write).parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*frames: DataFrame | None, kind: str = "") -> None:
    """Delete tables that ``written`` has made and that no later step reads, or one kind of their rows (``column=value``)."""
    for df in frames:
        if df is not None and "_written_at" in df.__dict__:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(f"{df._written_at}/{kind}" if kind else df._written_at)
            where.getFileSystem(df.sparkSession._jsc.sc().hadoopConfiguration()).delete(where, True)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def need(df: DataFrame, names: Iterable[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {missing}")

#: DuckDB: one row with the CRC-32 table, made from the polynomial, as ``tab``.
CRC_TABLE_SQL = """SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k:
         CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS tab"""


def crc_sql(text: str) -> str:
    """DuckDB: the unsigned CRC-32 of a text's UTF-8 bytes, with ``tab`` in scope."""
    octets = f"list_transform(range(strlen({text})), lambda i: ('0x' || substr(hex(encode({text})), 2 * i::INTEGER + 1, 2))::BIGINT)"
    step = "xor(c // 256, tab[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {octets}), lambda c, b: {step}), 4294967295)"
