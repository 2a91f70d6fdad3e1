"""Keyed tables on files: the transcript store, result documents and job state."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.functions.lexicon import STAGE_SLICES, STORE_CONFIG, STORE_TTL_DAYS
from callweave.functions.numeric import block_of
from callweave.functions.text import is_blank


# --- transcript store --------------------------------------------------------------------------
def config_text(config: Column) -> Column:
    """A map in canonical form, because maps cannot be compared."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(config))))


def expected_config(lang: Column, settings: Mapping[str, str] = STORE_CONFIG) -> Column:
    pairs = [F.lit(x) for kv in settings.items() for x in kv]
    return F.create_map(*pairs, F.lit("language"), lang)


def is_expired(created_at: Column, now: Column, days: int = STORE_TTL_DAYS) -> Column:
    return created_at < now - F.make_interval(days=F.lit(days))


def store_lookup(
    requests: DataFrame, store: DataFrame, now: Column, settings: Mapping[str, str] = STORE_CONFIG, days: int = STORE_TTL_DAYS
) -> DataFrame:
    """Stored words per request (content_sha1, lang), or null.

    A hit has the same content, language and configuration, is not too old and holds a word list.
    A newer entry of a key replaces the older ones, whether it is usable or not; of entries written at the same
    moment a usable one counts.
    """
    usable = F.coalesce(
        F.col("words").isNotNull()
        & ~is_expired(F.col("created_at"), now, days)
        & (config_text(F.col("config")) == config_text(expected_config(F.col("lang"), settings))),
        F.lit(False),
    )
    answers = store.select("content_sha1", "lang", "created_at", usable.alias("__usable"), F.when(usable, F.col("words")).alias("words"))
    newest = answers.groupBy("content_sha1", "lang").agg(F.max_by("words", F.struct("created_at", "__usable")).alias("words"))
    return requests.join(newest, ["content_sha1", "lang"], "left")


def store_misses(looked_up: DataFrame) -> DataFrame:
    return looked_up.where("words is null").drop("words")


def store_rows(transcribed: DataFrame, now: Column, settings: Mapping[str, str] = STORE_CONFIG) -> DataFrame:
    """Rows to append; calls without a result are not stored."""
    return transcribed.where(F.col("words").isNotNull()).select(
        "content_sha1",
        "lang",
        expected_config(F.col("lang"), settings).alias("config"),
        now.alias("created_at"),
        "words",
    )


def append_store(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("lang").parquet(path)


# --- result documents --------------------------------------------------------------------------
def latest(rows: DataFrame, key: str, version: str) -> DataFrame:
    """The row with the highest version per key, picked with partial aggregation."""
    others = [c for c in rows.columns if c not in (key, version)]
    picked = rows.groupBy(key).agg(F.max(version).alias(version), F.max_by(F.struct(*others), version).alias("__r"))
    return picked.select(key, version, *[F.col(f"__r.{c}").alias(c) for c in others])


def upsert(spark: SparkSession, rows: DataFrame, path: str, key: str = "filename", version: str = "version", buckets: int = 64) -> None:
    """Merge rows into a bucketed table; a key keeps its row with the highest version.

    Keys are spread over ``bucket`` partitions by hash. Only buckets that receive rows are read and
    rewritten, and writing the same batch twice leaves the same table.
    """
    new = rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    touched = [r[0] for r in new.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
    if not touched:
        return
    cols = [*rows.columns, "bucket"]
    merged = new.select(cols)
    old = read_results(spark, path)
    if old is not None:
        merged = merged.unionByName(old.where(F.col("bucket").isin(touched)).select(cols))
    out = latest(merged, key, version).select(cols)
    # A partition cannot be overwritten while it is read: the merge is written next to it first.
    staging = f"{path}_staging"
    out.write.mode("overwrite").partitionBy("bucket").parquet(staging)
    (
        spark.read.parquet(staging)
        .select(cols)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("bucket")
        .parquet(path)
    )


def read_results(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, or None before the first write."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    return spark.read.parquet(path)


def stage_slice(results: DataFrame, stage: str, doc: str = "doc") -> DataFrame:
    """The named part of a result document; missing parts are null. ``doc`` is JSON text."""
    return results.select(
        "filename", *[F.get_json_object(doc, f"$.{k}").alias(k) for k in STAGE_SLICES[stage]]
    )


def backlog(calls: DataFrame, results: DataFrame, running: DataFrame | None = None) -> DataFrame:
    """Calls without a result and without a live job."""
    out = calls.join(results.select("filename"), "filename", "left_anti")
    if running is not None:
        out = out.join(running.select("filename"), "filename", "left_anti")
    return out


def job_status(requests: DataFrame, jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Job state if there is one, else completed if there is a result, else idle."""
    done = results.select("filename").distinct().withColumn("__done", F.lit(True))
    out = requests.join(jobs.select("filename", "status", "percent"), "filename", "left").join(done, "filename", "left")
    finished = F.col("__done").isNotNull()
    return out.select(
        "filename",
        F.coalesce("status", F.when(finished, "completed"), F.lit("idle")).alias("status"),
        F.coalesce("percent", F.when(finished, 100), F.lit(0)).cast("long").alias("percent"),
    )


# --- result assembly ---------------------------------------------------------------------------
def assemble(turns: DataFrame, per_call: DataFrame, page_rows: int = 1000) -> DataFrame:
    """One document per call with its turns and call-level parts.

    Turns are gathered in pages of ``page_rows``, so a document of any length is a sequence of
    bounded rows. Call-level parts sit on page 0; an ordinary call has only that page.
    """
    cols = [c for c in turns.columns if c != "call_id"]
    pages = (
        turns.withColumn("page", block_of(F.col("seg_idx"), page_rows))
        .groupBy("call_id", "page")
        .agg(F.array_sort(F.collect_list(F.struct("seg_idx", *[c for c in cols if c != "seg_idx"]))).alias("segments"))
    )
    head = per_call.withColumn("page", F.lit(0).cast("long"))
    return pages.join(head, ["call_id", "page"], "full_outer")


def as_json(documents: DataFrame) -> DataFrame:
    rest = [c for c in documents.columns if c not in ("call_id", "page")]
    return documents.select("call_id", "page", F.to_json(F.struct(*rest)).alias("doc"))


def has_text(turns: DataFrame) -> DataFrame:
    return turns.where(~is_blank(F.col("text")))
