"""Who is the agent: context lines, phrase heuristic, parsed answers, and applying a mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callweave.functions.jsonfix import unfence
from callweave.functions.lexicon import AGENT_PHRASES, java_pattern
from callweave.functions.text import is_blank, strip
from callweave.operators.turns import meaningful


def _first_turns(turns: DataFrame, n: int) -> DataFrame:
    """The first n turns of each call. The row limit per call is applied before the shuffle."""
    at = Window.partitionBy("call_id").orderBy("seg_idx")
    return turns.withColumn("__rn", F.row_number().over(at)).where(F.col("__rn") <= n).drop("__rn")


def _in_order(col: str, sep: str):
    rows = F.array_sort(F.collect_list(F.struct("seg_idx", F.col(col).alias("x"))))
    return F.array_join(F.transform(rows, lambda r: r["x"]), sep)


def transcript_head(turns: DataFrame, lines: int = 80) -> DataFrame:
    """First ``lines`` non-blank turns as ``[speaker]: text`` lines."""
    rows = turns.where(~is_blank(F.col("text")))
    rows = _first_turns(rows, lines).withColumn(
        "line", F.concat(F.lit("["), F.col("speaker"), F.lit("]: "), strip(F.col("text")))
    )
    return rows.groupBy("call_id").agg(
        _in_order("line", "\n").alias("transcript"), F.count(F.lit(1)).alias("n_lines")
    )


def role_context(turns: DataFrame, max_turns: int = 12, min_words: int = 2) -> DataFrame:
    """Earliest meaningful turns, speakers lettered by first appearance."""
    rows = _first_turns(meaningful(turns, min_words), max_turns)
    rows = rows.withColumn("__who", F.lower(F.trim("speaker")))
    entry = F.struct("seg_idx", F.col("__who").alias("who"), strip(F.col("text")).alias("text"))
    per_call = rows.groupBy("call_id").agg(F.array_sort(F.collect_list(entry)).alias("t"))
    order = F.array_distinct(F.transform("t", lambda r: r["who"]))
    per_call = per_call.withColumn("who", order)
    line = lambda r: F.concat(
        F.lit("[SPK_"),
        F.char(F.lit(64) + F.array_position(F.col("who"), r["who"])),
        F.lit("] "),
        r["text"],
    )
    return per_call.select(
        "call_id",
        F.array_join(F.transform("t", line), " ").alias("context"),
        F.size("t").cast("long").alias("turns_used"),
    )


def role_heuristic(turns: DataFrame, pattern: str | None = None, max_turns: int = 12) -> DataFrame:
    """(call_id, speaker, role, method) for the two ``spk_`` speakers of a call.

    The first speaker in name order who says an agent phrase early on is the agent; without one the
    first speaker is. A lone speaker is the agent.
    """
    regex = java_pattern("(?i)" + (pattern or AGENT_PHRASES))
    named = turns.where(F.col("speaker").startswith("spk_"))
    # The set of speakers is bounded by what a diarizer may emit.
    cast = named.groupBy("call_id").agg(F.array_sort(F.collect_set("speaker")).alias("cast"))
    early = _first_turns(turns, max_turns).where(
        F.col("speaker").startswith("spk_") & (F.col("text") != "")
    )
    said = early.groupBy("call_id", "speaker").agg(_in_order("text", " ").alias("said"))
    hits = said.where(F.col("said").rlike(regex)).groupBy("call_id").agg(F.min("speaker").alias("hit"))
    both = cast.join(hits, "call_id", "left")
    agent = F.when(F.size("cast") >= 2, F.coalesce("hit", F.col("cast")[0])).otherwise(F.col("cast")[0])
    both = both.withColumn("agent", agent)
    other = F.get(F.filter("cast", lambda s: s != F.col("agent")), F.lit(0))
    both = both.withColumns(
        {
            "customer": other,
            "method": F.when((F.size("cast") >= 2) & F.col("hit").isNotNull(), "heuristic").otherwise("fallback"),
        }
    )
    pairs = F.array_compact(
        F.array(
            F.struct(F.col("agent").alias("speaker"), F.lit("agent").alias("role")),
            F.when(
                F.col("customer").isNotNull(),
                F.struct(F.col("customer").alias("speaker"), F.lit("customer").alias("role")),
            ),
        )
    )
    return both.select("call_id", "method", F.inline(pairs))


def apply_roles(turns: DataFrame, mapping: DataFrame) -> DataFrame:
    """Replace the speaker where a known role is mapped. Spark broadcasts the mapping if it is small."""
    known = mapping.where(F.col("role") != "unknown").select("call_id", "speaker", F.col("role").alias("__role"))
    joined = turns.join(known, ["call_id", "speaker"], "left")
    return joined.withColumn("speaker", F.coalesce("__role", "speaker")).drop("__role").select(turns.columns)


def parse_role_answer(answers: DataFrame, raw: str = "raw", speakers: str = "speakers") -> DataFrame:
    """Add ``roles``: map of speaker to agent/customer from a JSON answer, or null.

    ``speakers`` is the sorted list of expected speakers. If exactly one of them is known, the first
    remaining one gets the other role.
    """
    text = unfence(F.col(raw))
    parsed = F.when(
        F.try_parse_json(text).isNotNull() & text.startswith("{"), F.from_json(text, "map<string,string>")
    )
    out = answers.withColumn("__m", parsed)
    known = F.map_filter(
        "__m", lambda k, v: F.array_contains(F.col(speakers), k) & v.isin("agent", "customer")
    )
    out = out.withColumn("__k", known)
    rest = F.get(F.array_except(F.col(speakers), F.map_keys("__k")), F.lit(0))
    lone = F.get(F.map_values("__k"), F.lit(0))
    filled = F.map_concat(
        "__k", F.create_map(rest, F.when(lone == "agent", "customer").otherwise("agent"))
    )
    n = F.size("__k")
    roles = F.when((n == 1) & rest.isNotNull(), filled).when(n >= 1, F.col("__k"))
    return out.withColumn("roles", roles).drop("__m", "__k")


def speakers_of(turns: DataFrame) -> DataFrame:
    """Distinct speakers of a call, sorted."""
    return turns.where(F.col("speaker") != "").groupBy("call_id").agg(
        F.array_sort(F.collect_set("speaker")).alias("speakers")
    )


def speakers_in_both(mapping: DataFrame, turns: DataFrame) -> DataFrame:
    """Speakers that a mapping names and the transcript has."""
    return mapping.select("call_id", "speaker").intersect(turns.select("call_id", "speaker"))
