"""Queries over stores, result tables and file formats."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from callweave.functions.lexicon import STAGE_SLICES, STORE_CONFIG
from callweave.model import ANNOTATIONS
from callweave.plans import standins
from callweave.plans.registry import query
from callweave.session import scratch_folder
from callweave.sources import files, store

NOW = "2000-01-31 00:00:00"


@query("io2_content_fingerprint", "SELECT doc_id, sha1(text) AS content_sha1 FROM documents")
def io2(spark, d):
    return standins.documents(spark, d).select(F.col("call_id").alias("doc_id"), files.fingerprint(F.col("text")).alias("content_sha1"))


@query("fx12_age_test", f"SELECT o_orderkey, o_orderdate < TIMESTAMP '{NOW}' - INTERVAL 30 DAYS AS expired FROM orders")
def fx12(spark, d):
    now = F.lit(NOW).cast("timestamp")
    return standins.table(spark, d, "orders").select(
        "o_orderkey", store.is_expired(F.col("o_orderdate").cast("timestamp"), now).alias("expired")
    )


@query(
    "fx15_config_fingerprint",
    """SELECT event_id, (event_id % 2 = 0) AND event_type <> 'error' AS same FROM events""",
)
def fx15(spark, d):
    """The stored map has its entries in another order, and one value differs for errors."""
    pairs = [F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in reversed(STORE_CONFIG.items())]
    lang = F.struct(F.lit("language").alias("key"), F.when(F.col("event_id") % 2 == 0, "hi").otherwise("en").alias("value"))
    entries = F.array(lang, *pairs)
    changed = F.when(
        F.col("event_type") == "error",
        F.transform(entries, lambda e: F.struct(e["key"].alias("key"), F.when(e["key"] == "model", "other").otherwise(e["value"]).alias("value"))),
    ).otherwise(entries)
    stored = store.config_text(F.map_from_entries(changed))
    wanted = store.config_text(store.expected_config(F.lit("hi")))
    return standins.table(spark, d, "events").select("event_id", (stored == wanted).alias("same"))


@query(
    "io9_store_lookup",
    f"""WITH s AS (SELECT sha1(text) AS h, lang, doc_id, doc_id % 3 <> 0 AS has_words, doc_id % 7 <> 0 AS right_config,
      TIMESTAMP '{NOW}' - to_days((doc_id % 60)::INT) AS created_at FROM documents),
    o AS (SELECT *, has_words AND right_config AND created_at >= TIMESTAMP '{NOW}' - INTERVAL 30 DAYS AS ok FROM s),
    u AS (SELECT h, lang, ok FROM o QUALIFY row_number() OVER (PARTITION BY h, lang ORDER BY created_at DESC, ok DESC) = 1)
    SELECT d.doc_id, coalesce(u.ok, false) AS hit FROM documents d LEFT JOIN u ON sha1(d.text) = u.h AND d.lang = u.lang""",
)
def io9(spark, d):
    docs = standins.table(spark, d, "documents")
    n = F.col("doc_id")
    now = F.lit(NOW).cast("timestamp")
    sha = files.fingerprint(F.col("text")).alias("content_sha1")
    word = F.array(F.struct(F.lit(0.0).alias("start"), F.lit(0.4).alias("end"), F.col("lang").alias("text"), F.lit(1.0).alias("probability")))
    entries = docs.select(
        sha,
        "lang",
        F.when(n % 7 != 0, store.expected_config(F.col("lang"))).otherwise(store.expected_config(F.lit("xx"))).alias("config"),
        (now - F.make_interval(days=(n % 60).cast("int"))).alias("created_at"),
        F.when(n % 3 != 0, word).alias("words"),
    )
    out = store.store_lookup(docs.select(sha, "lang", "doc_id"), entries, now)
    return out.select("doc_id", F.col("words").isNotNull().alias("hit"))


@query(
    "io6_latest_result",
    "SELECT user_id::VARCHAR AS filename, event_id AS version, event_type AS doc FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
)
def io6(spark, d):
    rows = standins.table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("filename"), F.col("event_id").alias("version"), F.col("event_type").alias("doc")
    )
    return store.latest(rows, "filename", "version")


@query(
    "io6_upsert_table",
    "SELECT user_id::VARCHAR AS filename, event_id AS version, event_type AS doc FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
)
def io6u(spark, d):
    """Three writes in arbitrary order, one of them twice, into a table of files."""
    rows = standins.table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("filename"), F.col("event_id").alias("version"), F.col("event_type").alias("doc")
    )
    path = scratch_folder(spark, "results") + "/table"
    for kinds in (["purchase", "view"], ["click"], ["signup", "error"], ["click"]):
        store.upsert(spark, rows.where(F.col("doc").isin(kinds)), path, buckets=8)
    return store.read_results(spark, path).select("filename", "version", "doc")


DOC_JSON = """rd AS (SELECT event_id::VARCHAR AS filename, '{"duration_s":' || value || CASE WHEN event_type = 'error' THEN '' ELSE ',"denoise_metrics":' || props END || '}' AS doc FROM events)"""


@query(
    "io7_stage_slice",
    f"""WITH {DOC_JSON} SELECT filename, json_extract_string(doc, '$.duration_s') AS duration_s,
      replace(json_extract(doc, '$.denoise_metrics')::VARCHAR, ' ', '') AS denoise_metrics FROM rd""",
)
def io7(spark, d):
    tail = F.when(F.col("event_type") == "error", "").otherwise(F.concat(F.lit(',"denoise_metrics":'), "props"))
    docs = standins.table(spark, d, "events").select(
        F.col("event_id").cast("string").alias("filename"),
        F.concat(F.lit('{"duration_s":'), F.col("value").cast("string"), tail, F.lit("}")).alias("doc"),
    )
    return store.stage_slice(docs, "denoise")


@query(
    "io7_all_slices",
    r"""SELECT event_id::VARCHAR AS filename, stage, CASE WHEN stage IN ('denoise', 'compliance') THEN '{}' WHEN stage IN ('qa-score', 'crm-note')
       THEN '{"qa":"' || replace(json(props)::VARCHAR, '"', '\"') || '"}' ELSE '{"segments":"[]"}' END AS slice
       FROM events, (VALUES ('denoise'), ('diarize'), ('transcribe'), ('emotion'), ('compliance'), ('qa-score'), ('crm-note')) s(stage)""",
)
def io7all(spark, d):
    docs = standins.table(spark, d, "events").select(
        F.col("event_id").cast("string").alias("filename"),
        F.concat(F.lit('{"qa":'), F.col("props"), F.lit(',"segments":[]}')).alias("doc"),
    )
    parts = [
        store.stage_slice(docs, s).select("filename", F.lit(s).alias("stage"), F.to_json(F.struct(*keys)).alias("slice"))
        for s, keys in STAGE_SLICES.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(
    "io10_backlog",
    """SELECT DISTINCT e.user_id::VARCHAR AS filename FROM events e WHERE NOT EXISTS (SELECT 1 FROM events r WHERE r.user_id = e.user_id AND r.event_type = 'purchase' AND r.value > 100)
       AND NOT EXISTS (SELECT 1 FROM events r WHERE r.user_id = e.user_id AND r.event_type = 'error' AND r.value > 200)""",
)
def io10(spark, d):
    ev = standins.table(spark, d, "events").withColumn("filename", F.col("user_id").cast("string"))
    done = ev.where("event_type = 'purchase' and value > 100").select("filename").distinct()
    live = ev.where("event_type = 'error' and value > 200").select("filename").distinct()
    return store.backlog(ev.select("filename").distinct(), done, live)


@query(
    "so3_not_yet_processed",
    "SELECT call_id FROM (SELECT doc_id AS call_id FROM documents EXCEPT SELECT doc_id FROM labels)",
)
def so3(spark, d):
    calls = standins.table(spark, d, "documents").select(F.col("doc_id").alias("call_id"))
    return calls.join(standins.table(spark, d, "labels").select(F.col("doc_id").alias("call_id")), "call_id", "left_anti").distinct()


@query(
    "jn13_job_status",
    """WITH f AS (SELECT DISTINCT user_id::VARCHAR AS filename, user_id FROM events), j AS (SELECT user_id, count(*) % 101 AS percent FROM events WHERE event_type = 'error' AND value > 150 GROUP BY user_id),
    r AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND value > 100)
    SELECT filename, CASE WHEN j.user_id IS NOT NULL THEN 'running' WHEN r.user_id IS NOT NULL THEN 'completed' ELSE 'idle' END AS status,
      (CASE WHEN j.user_id IS NOT NULL THEN percent WHEN r.user_id IS NOT NULL THEN 100 ELSE 0 END)::BIGINT AS percent
    FROM f LEFT JOIN j ON f.user_id = j.user_id LEFT JOIN r ON f.user_id = r.user_id""",
)
def jn13(spark, d):
    ev = standins.table(spark, d, "events").withColumn("filename", F.col("user_id").cast("string"))
    jobs = ev.where("event_type = 'error' and value > 150").groupBy("filename").agg(
        F.lit("running").alias("status"), (F.count(F.lit(1)) % 101).alias("percent")
    )
    results = ev.where("event_type = 'purchase' and value > 100")
    return store.job_status(ev.select("filename").distinct(), jobs, results)


@query(
    "tk5_sorted_listing",
    "SELECT source, row_number() OVER (ORDER BY source) AS place FROM (SELECT DISTINCT source FROM documents)",
)
def tk5(spark, d):
    return files.sorted_listing(standins.table(spark, d, "documents"), "source")


@query(
    "io1_call_catalogue",
    """SELECT 'call_' || user_id % 8 || suffix AS filename, count(*)::BIGINT AS length FROM events, (VALUES ('.wav'), ('.mp3'), ('_denoised.mp3')) s(suffix)
       GROUP BY user_id % 8, suffix""",
)
def io1(spark, d):
    """Catalogue of a folder in which every group of users has recordings, a derived file and a text; a file has a byte for each event.

    The names, at most 8 groups of them, come from the events; the file system of the folder creates them, wherever it is.
    """
    folder = scratch_folder(spark, "catalogue")
    groups = standins.table(spark, d, "events").groupBy((F.col("user_id") % 8).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    jvm = spark._jvm
    for r in groups.collect():
        for suffix in (".wav", ".mp3", "_denoised.wav", "_denoised.mp3", ".txt"):
            path = jvm.org.apache.hadoop.fs.Path(f"{folder}/call_{r['g']}{suffix}")
            out = path.getFileSystem(spark._jsc.sc().hadoopConfiguration()).create(path)
            out.write(bytearray(r["n"]))
            out.close()
    return files.call_catalogue(spark, folder).select("filename", "length")


@query(
    "io3_annotations_round_trip",
    """SELECT conv_id::VARCHAR AS dialogue_id, turn::VARCHAR AS utterance_id, role AS speaker, text, length(text)::DOUBLE AS "end" FROM conversations""",
)
def io3(spark, d):
    """Conversations written as annotation lines and read back under the fixed schema."""
    conv = standins.table(spark, d, "conversations")
    rows = conv.select(
        F.col("conv_id").cast("string").alias("dialogue_id"),
        F.col("turn").cast("string").alias("utterance_id"),
        F.col("role").alias("speaker"),
        F.lit(0.0).alias("start"),
        F.length("text").cast("double").alias("end"),
        "text",
        F.array(F.lit("neutral")).alias("emotion_label"),
        F.create_map(F.lit("neutral"), F.lit(0.9)).alias("intensity"),
    )
    path = scratch_folder(spark, "annotations") + "/lines"
    rows.write.json(path)
    back = files.annotations_json(spark, path)
    return back.where("emotion_label[0] = 'neutral' and intensity['neutral'] = 0.9 and _corrupt_record is null").select(
        "dialogue_id", "utterance_id", "speaker", "text", "end"
    )


@query(
    "io3_annotations_csv",
    """SELECT conv_id::VARCHAR AS dialogue_id, turn::VARCHAR AS utterance_id, role AS speaker, text, length(text)::DOUBLE AS "end",
       'neutral,' || role AS emotion_label, CASE WHEN turn % 2 = 0 THEN 'a,b' ELSE 'a' END AS conduct_risk, 0.9::DOUBLE AS intensity FROM conversations""",
)
def io3_csv(spark, d):
    """The same as CSV: lists as JSON text or separated by ``|``, the map as JSON text."""
    conv = standins.table(spark, d, "conversations")
    labels = F.when(F.col("turn") % 3 == 0, F.to_json(F.array(F.lit("neutral"), "role"))).otherwise(F.concat(F.lit("neutral|"), F.col("role")))
    values = {
        "dialogue_id": F.col("conv_id").cast("string"),
        "utterance_id": F.col("turn").cast("string"),
        "speaker": F.col("role"),
        "start": F.lit(0.0),
        "end": F.length("text").cast("double"),
        "text": F.col("text"),
        "emotion_label": labels,
        "intensity": F.lit('{"neutral": 0.9}'),
        "conduct_risk": F.when(F.col("turn") % 2 == 0, "a|b").otherwise("a"),
    }
    names = StructType.fromDDL(ANNOTATIONS).names
    rows = conv.select(*[values.get(n, F.lit(None).cast("string")).alias(n) for n in names])
    path = scratch_folder(spark, "annotations") + "/table"
    rows.write.option("header", True).option("escape", '"').option("quoteAll", True).option("emptyValue", "").csv(path)
    back = files.annotations_csv(spark, path).where("_corrupt_record is null")
    lists = [F.array_join(c, ",").alias(c) for c in ("emotion_label", "conduct_risk")]
    return back.select("dialogue_id", "utterance_id", "speaker", "text", "end", *lists, F.col("intensity")["neutral"].alias("intensity"))


@query(
    "io4_ground_truth_table",
    """SELECT conv_id::VARCHAR AS file, turn AS line_no, turn * 60.0::DOUBLE + turn AS start_time_s, turn * 60.0::DOUBLE + turn + 5 AS end_time_s,
       CASE role WHEN 'assistant' THEN 'agent' WHEN 'user' THEN 'customer' ELSE 'overlap' END AS speaker FROM conversations""",
)
def io4(spark, d):
    """Conversations as pipe-table lines behind an older table that must not count."""
    conv = standins.table(spark, d, "conversations")
    who = F.when(F.col("role") == "assistant", "**Agent**").when(F.col("role") == "user", "Customer").otherwise("agent & customer")
    stamp = lambda s: F.concat("turn", F.lit(":"), s.cast("string"))
    line = F.concat(
        F.lit("| "), stamp(F.col("turn")), F.lit(" – "), stamp(F.col("turn") + 5), F.lit(" | "), who, F.lit(" | words |")
    )
    body = conv.select(F.col("conv_id").cast("string").alias("file"), F.col("turn").alias("line_no"), line.alias("value"))
    file = body.select("file").distinct()
    head = F.array(
        *[
            F.struct(F.lit(i).cast("long").alias("line_no"), F.lit(t).alias("value"))
            for i, t in [(-5, "| Timestamp | Speaker |"), (-4, "| 0:01 - 0:02 | Agent |"), (-2, "| Timestamp | Speaker | Text |"), (-1, "|---|---|---|")]
        ]
    )
    lines = body.unionByName(file.select("file", F.inline(head)))
    return files.truth_rows(lines).select("file", "line_no", "start_time_s", "end_time_s", "speaker")


@query(
    "io8_report_sink",
    "SELECT event_type, count(*) AS n, max(value) AS top FROM events GROUP BY event_type",
)
def io8(spark, d):
    """A metrics report written as CSV with a header and as JSON, read back and found equal."""
    report = standins.table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))
    base = scratch_folder(spark, "report")
    files.write_report_csv(report, base + "/csv")
    files.write_report_json(report, base + "/json")
    schema = "event_type string, n long, top double"
    csv = spark.read.schema(schema).option("header", True).csv(base + "/csv")
    return csv.intersect(spark.read.schema(schema).json(base + "/json"))
