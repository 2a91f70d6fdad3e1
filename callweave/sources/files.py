"""File readers: call catalogue, annotations, ground-truth tables; and report writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.functions.text import clock_seconds, strip
from callweave.model import ANNOTATIONS
from callweave.operators.scans import numbered

AUDIO_GLOB = "*.{wav,mp3,opus}"


def call_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """Recordings below a folder, without derived ``_denoised`` files. File contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", AUDIO_GLOB).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("filename"), "path", "length", "modificationTime").where(
        ~F.col("filename").endswith("_denoised.wav")
    )


def with_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    """Recordings with the SHA-1 of their bytes, the key of the transcript store."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", AUDIO_GLOB).load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.sha1("content").alias("content_sha1"))


def fingerprint(content: Column) -> Column:
    return F.sha1(content)


def annotations_json(spark: SparkSession, path: str) -> DataFrame:
    """Annotated turns, one JSON object per line; unreadable lines are kept in ``_corrupt_record``."""
    schema = f"{ANNOTATIONS}, _corrupt_record string"
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def annotations_csv(spark: SparkSession, path: str) -> DataFrame:
    """The same from CSV, where lists and the intensity map are JSON text or ``|``-separated."""
    flat = (
        ANNOTATIONS.replace("emotion_label array<string>", "emotion_label string")
        .replace("intensity map<string,double>", "intensity string")
        .replace("conduct_risk array<string>", "conduct_risk string")
    )
    rows = (
        spark.read.schema(f"{flat}, _corrupt_record string")
        .option("header", True)
        .option("escape", '"')
        .option("multiLine", True)  # a text may hold line ends
        .option("mode", "PERMISSIVE")
        .csv(path)
    )

    def listed(c: str) -> Column:
        as_json = F.from_json(F.col(c), "array<string>")
        return F.when(F.col(c).startswith("["), as_json).otherwise(F.split(F.col(c), r"\|"))

    return rows.withColumns(
        {
            "emotion_label": listed("emotion_label"),
            "conduct_risk": listed("conduct_risk"),
            "intensity": F.from_json("intensity", "map<string,double>"),
        }
    )


def truth_speaker(raw: Column, agents: tuple[str, ...] = ("agent",), customers: tuple[str, ...] = ("customer",)) -> Column:
    """agent, customer, overlap (both named) or unknown."""
    s = F.lower(raw)

    def any_of(names: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for n in names:
            out = out | s.contains(n)
        return out

    a, c = any_of(agents), any_of(customers)
    return F.when(a & c, "overlap").when(a, "agent").when(c, "customer").otherwise("unknown")


def truth_rows(lines: DataFrame, **names) -> DataFrame:
    """Turns from pipe-table lines (file, line_no, value): time range, speaker, text.

    Only the last table of a file counts; it starts at the last header line with "Timestamp".
    """
    head = F.col("value").startswith("|") & F.col("value").contains("Timestamp")
    starts = lines.where(head).groupBy("file").agg(F.max("line_no").alias("__start"))
    body = strip(F.col("value"))
    rows = (
        lines.join(starts, "file")
        .where(F.col("line_no") >= F.col("__start"))
        .where(body.startswith("|") & ~body.contains("Timestamp") & ~body.contains("---"))
    )
    cells = F.split(body, r"\|")
    cells = F.slice(cells, F.lit(2), F.greatest(F.size(cells) - 2, F.lit(0)))
    rows = rows.withColumn("__c", F.transform(cells, lambda c: F.replace(strip(c), F.lit("*"), F.lit(""))))
    rows = rows.where(F.size("__c") >= 2)
    span = F.split(F.regexp_replace(F.get("__c", F.lit(0)), "[–—]", "-"), "-")
    rows = rows.withColumns({"start_time_s": clock_seconds(F.get(span, F.lit(0))), "end_time_s": clock_seconds(F.get(span, F.lit(1)))})
    return rows.where("start_time_s is not null and end_time_s is not null").select(
        "file",
        "line_no",
        "start_time_s",
        "end_time_s",
        F.round(F.col("end_time_s") - F.col("start_time_s"), 2).alias("duration_s"),
        truth_speaker(F.get("__c", F.lit(1)), **names).alias("speaker"),
        F.coalesce(F.get("__c", F.lit(2)), F.lit("")).alias("raw_text"),
    )


def truth_file(spark: SparkSession, path: str, **names) -> DataFrame:
    """Read ground-truth files. A file is one small hand-written table, split into lines in its task."""
    whole = spark.read.format("text").option("wholetext", True).load(path).select(F.col("_metadata.file_path").alias("file"), "value")
    lines = whole.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value"))
    return truth_rows(lines, **names)


def write_report_csv(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").option("header", True).csv(path)


def write_report_json(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)


def sorted_listing(names: DataFrame, column: str) -> DataFrame:
    """Distinct names with their place in sorted order.

    Names are dealt out by range, so that tasks hold equal shares whatever the names have in common, and are counted range by range.
    """
    dealt = names.select(column).distinct().repartitionByRange(column).withColumns({"__all": F.lit(0), "__range": F.spark_partition_id()})
    placed = numbered(dealt, ["__all"], [column], F.col("__range"), "place")
    return placed.select(column, (F.col("place") + 1).alias("place"))
