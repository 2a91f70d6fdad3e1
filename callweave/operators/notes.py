"""Extractive summaries and follow-up notes."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave.functions import lexicon
from callweave.functions.numeric import block_of, steady
from callweave.functions.rules import is_agent
from callweave.functions.text import SENTENCE_END, SPACE, is_blank, strip, tokens
from callweave.operators.emotion import sentiment_mode
from callweave.operators.scans import BLOCK_ROWS, Run, running, shared
from callweave.session import materialize

NO_TRANSCRIPT = "No transcript available for summarization."
MIN_CHARS = 10
#: A call of at most so many sentences and characters is scored in one row.
ROW_SENTENCES = 2_000
ROW_CHARS = 500_000


def split_sentences(docs: DataFrame, name: str = "sentences") -> DataFrame:
    """Add sentences longer than ten characters, or the non-blank lines if there are none.

    The text is trimmed first and breaks swallow all white space, so the pieces need no trimming.
    """
    rows = docs.withColumn("__body", strip(F.coalesce("text", F.lit(""))))
    pieces = F.split("__body", f"(?<={SENTENCE_END}){SPACE}+")
    rows = rows.withColumn("__kept", F.filter(pieces, lambda s: F.length(s) > MIN_CHARS))
    lines = F.filter(F.transform(F.split("__body", "\n"), strip), lambda s: s != "")
    chosen = F.when(F.size("__kept") > 0, F.col("__kept")).otherwise(lines)
    return rows.withColumn(name, chosen).drop("__body", "__kept")


def sentence_scores(sentences: DataFrame) -> DataFrame:
    """TF-IDF score per sentence.

    ``sentences`` has (call_id, sent_idx, sentence, n_docs). Every distinct token adds
    tf * ln((n+1)/(df+1)) + 1, so long sentences are favoured; a sentence without tokens has the score 0.
    """
    words = sentences.withColumn("__tok", tokens(F.col("sentence"))).select(
        "call_id", "sent_idx", "n_docs", F.size("__tok").alias("n_tok"), F.explode_outer("__tok").alias("token")
    )
    tf = words.groupBy("call_id", "sent_idx", "token").agg(
        F.count("token").alias("tf"), F.first("n_tok").alias("n_tok"), F.first("n_docs").alias("n_docs")
    )
    df = tf.where("token is not null").groupBy("call_id", "token").agg(F.count(F.lit(1)).alias("df"))
    weight = F.try_divide("tf", "n_tok") * F.ln((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1
    return (
        tf.join(df, ["call_id", "token"], "left")
        .groupBy("call_id", "sent_idx")
        .agg(F.sum(weight).alias("s"))
        .select("call_id", "sent_idx", steady(F.coalesce("s", F.lit(0.0)), 9).alias("score"))
    )


def top_sentences(scored: DataFrame, n: int = 5) -> DataFrame:
    """The n best sentences of each call. The limit per call is applied before the shuffle."""
    rank = Window.partitionBy("call_id").orderBy(F.col("score").desc(), "sent_idx")
    return scored.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= n)


def document_scores(sentences: Sequence[str]) -> list[float]:
    """``sentence_scores`` of one document; a sentence comes as its tokens with a blank between them."""
    counts = [Counter(s.split(" ")) if s else Counter() for s in sentences]
    df = Counter(chain.from_iterable(counts))
    # A token in every sentence of a document has the weight 1.
    idf = {token: math.log((len(counts) + 1) / (n + 1)) for token, n in df.items()}
    return [sum(tf / c.total() * idf[t] + 1 for t, tf in c.items()) for c in counts]


def _scores(batch: pd.Series) -> pd.Series:
    return batch.map(document_scores)


def best_sentences(docs: DataFrame, n: int = 5) -> DataFrame:
    """Add ``sentences`` and ``best``, the numbers of the n best in order of rank, to transcripts that are one row each.

    A row holds its whole text, so its sentences are scored and ranked where they are and nothing is shuffled.
    """
    return _with_best(split_sentences(docs), n)


def _with_best(rows: DataFrame, n: int) -> DataFrame:
    """Add ``best`` to rows that have the ``sentences`` of a transcript."""
    said = F.transform("sentences", lambda s: F.array_join(tokens(s), " "))
    rows = rows.withColumn("__s", F.pandas_udf(_scores, "array<double>")(said))
    at = F.transform("__s", lambda s, i: F.struct((0.0 - steady(s, 9)).alias("down"), i.alias("i")))
    return rows.withColumn("best", F.transform(F.slice(F.array_sort(at), 1, n), lambda x: x["i"])).drop("__s")


def summarize_documents(docs: DataFrame, n: int = 5) -> DataFrame:
    """Summary of transcripts that are one row each (call_id, text)."""
    rows = best_sentences(docs.select("call_id", "text"), n)
    chosen = F.array_join(F.transform(F.array_sort("best"), lambda i: F.get(F.col("sentences"), i)), " ")
    return rows.select("call_id", F.when(F.size("best") > 0, chosen).otherwise(NO_TRANSCRIPT).alias("summary"))


def _stitched(turns: DataFrame, breaks: str, ends: str | None, block_rows: int) -> DataFrame:
    """Pieces of a call's text joined across turns: (call_id, sent_idx, sentence).

    A turn goes on with the previous turn's last piece unless that ended in ``ends``. The group of
    pieces that form one sentence is as large as the sentence.
    """
    body = strip(F.col("text"))
    rows = turns.where(~is_blank(F.col("text"))).select(
        "call_id",
        "seg_idx",
        (body.rlike(f"{ends}$") if ends else F.lit(False)).alias("__closed"),
        F.split(body, breaks).alias("__parts"),
    )
    pieces = rows.select(
        "call_id", "seg_idx", "__closed", F.size("__parts").alias("__n"), F.posexplode_outer("__parts").alias("k", "piece")
    )
    # A sentence ends inside a turn after every piece but the last, and at a turn's end if closed.
    ends_here = F.when((F.col("k") < F.col("__n") - 1) | F.col("__closed"), 1).otherwise(0).cast("long")
    pieces = running(
        shared(pieces),
        ["call_id"],
        ["seg_idx", "k"],
        block_of(F.col("seg_idx"), block_rows),
        {"sent_idx": Run("sum", ends_here, inclusive=False)},
    ).withColumn("sent_idx", F.coalesce("sent_idx", F.lit(0).cast("long")))
    entry = F.struct("seg_idx", "k", "piece")
    return (
        pieces.groupBy("call_id", "sent_idx")
        .agg(F.array_sort(F.collect_list(entry)).alias("__p"))
        .select(
            "call_id",
            "sent_idx",
            strip(F.array_join(F.transform("__p", lambda p: p["piece"]), " ")).alias("sentence"),
        )
    )


def call_sentences(turns: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Sentences of a call's whole transcript, which may run across turns.

    They are used four times, so they are written to the shared folder once.
    """
    all_sents = materialize(
        _stitched(turns, f"(?<={SENTENCE_END}){SPACE}+", SENTENCE_END, block_rows), "sentences"
    )
    kept = all_sents.where(F.length("sentence") > MIN_CHARS)
    short = all_sents.groupBy("call_id").agg(F.max(F.length("sentence")).alias("m")).where(F.col("m") <= MIN_CHARS)
    short_turns = turns.join(short.select("call_id"), "call_id", "left_semi")
    lines = _stitched(short_turns, "\n", None, block_rows).where(F.col("sentence") != "")
    rows = kept.unionByName(lines)
    sizes = rows.groupBy("call_id").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.length("sentence")).alias("n_chars"))
    return rows.join(sizes, "call_id")


def summarize_calls(
    turns: DataFrame, n: int = 5, block_rows: int = BLOCK_ROWS, row_sentences: int = ROW_SENTENCES, row_chars: int = ROW_CHARS
) -> DataFrame:
    """Summary per call from its turns (call_id, seg_idx, text).

    Calls of few sentences and characters become one row each, in which sentences are scored, so their tokens are not shuffled. The tokens of
    longer calls are: no task holds such a call.
    """
    rows = call_sentences(turns, block_rows)
    fits = (F.col("n_docs") <= row_sentences) & (F.col("n_chars") <= row_chars)
    entry = F.struct("sent_idx", "sentence")
    summary = lambda chosen: F.array_join(F.transform(chosen, lambda s: s["sentence"]), " ").alias("summary")
    short = rows.where(fits).groupBy("call_id").agg(F.array_sort(F.collect_list(entry)).alias("__all"))
    short = _with_best(short.withColumn("sentences", F.transform("__all", lambda s: s["sentence"])), n)
    short = short.select("call_id", summary(F.transform(F.array_sort("best"), lambda i: F.get(F.col("__all"), i))))
    long = rows.where(~fits)
    best = top_sentences(sentence_scores(long), n).select("call_id", "sent_idx")
    chosen = best.join(long.select("call_id", "sent_idx", "sentence"), ["call_id", "sent_idx"])
    found = chosen.groupBy("call_id").agg(F.array_sort(F.collect_list(entry)).alias("__s")).select("call_id", summary("__s"))
    return (
        turns.select("call_id")
        .distinct()
        .join(short.unionByName(found), "call_id", "left")
        .select("call_id", F.coalesce("summary", F.lit(NO_TRANSCRIPT)).alias("summary"))
    )


def with_findings(summary: Column, flags: Column, dominant: Column) -> Column:
    """Append the first five flags and the dominant sentiment to a summary."""
    listed = F.when(
        F.size(flags) > 0,
        F.concat(F.lit("\nCompliance flags: "), F.array_join(F.slice(flags, 1, 5), "; ")),
    )
    mood = F.when(dominant.isNotNull(), F.concat(F.lit("Overall customer sentiment: "), dominant))
    full = F.concat_ws(" ", summary, listed, mood)
    return F.when(summary == NO_TRANSCRIPT, summary).otherwise(full)


def compliance_sentence(total: Column, by_agent: Column) -> Column:
    return F.when(total == 0, lexicon.NO_VIOLATIONS).otherwise(
        F.concat(total.cast("string"), F.lit(lexicon.VIOLATIONS_FOUND), by_agent.cast("string"), F.lit(lexicon.VIOLATIONS_BY_AGENT))
    )


def recommended_action(total: Column, by_agent: Column, grade: Column) -> Column:
    return (
        F.when((total == 0) & grade.isin("A", "B"), lexicon.ACTION_NONE)
        .when((total > 0) & (by_agent > 0), lexicon.ACTION_REVIEW)
        .when(grade == "D", lexicon.ACTION_COACHING)
        .otherwise(lexicon.ACTION_MONITOR)
    )


def crm_notes(
    graded: DataFrame, emotions: DataFrame, flags: DataFrame | None = None, summaries: DataFrame | None = None
) -> DataFrame:
    """One note per call.

    ``graded`` has total_violations, agent_violations, qa_score and grade; ``emotions`` has speaker
    and sentiment per turn; ``flags`` (call_id, flags) and ``summaries`` (call_id, summary) are
    optional.
    """
    agent_rows = emotions.where(is_agent(F.col("speaker")))
    out = (
        graded.join(sentiment_mode(emotions), "call_id", "left")
        .join(sentiment_mode(agent_rows, "agent_dominant"), "call_id", "left")
    )
    total, by_agent = F.col("total_violations"), F.col("agent_violations")
    points = F.array_compact(
        F.array(
            F.when(F.col("dominant").isNotNull(), F.concat(F.lit("Customer sentiment: "), "dominant")),
            F.when(F.col("agent_dominant").isNotNull(), F.concat(F.lit("Agent tone: "), "agent_dominant")),
            F.when(
                F.col("qa_score").isNotNull(),
                F.concat(
                    F.lit("QA Score: "), F.col("qa_score").cast("string"), F.lit(" ("), F.col("grade"), F.lit(")")
                ),
            ),
        )
    )
    cols = [
        F.col("call_id"),
        points.alias("key_points"),
        compliance_sentence(total, by_agent).alias("compliance_summary"),
        recommended_action(total, by_agent, F.coalesce("grade", F.lit(""))).alias("recommended_action"),
        total.alias("total_violations"),
    ]
    if summaries is not None:
        out = out.join(summaries, "call_id", "left")
        if flags is not None:
            out = out.join(flags.select("call_id", "flags"), "call_id", "left")
            listed = F.coalesce("flags", F.array().cast("array<string>"))
        else:
            listed = F.array().cast("array<string>")
        text = F.coalesce("summary", F.lit(NO_TRANSCRIPT))
        cols.insert(1, with_findings(text, listed, F.col("dominant")).alias("summary"))
    return out.select(*cols)


def note_as_text(note: DataFrame) -> DataFrame:
    """The note as one block of plain text."""
    numbered = F.transform(
        F.coalesce("key_points", F.array().cast("array<string>")),
        lambda p, i: F.concat((i + 1).cast("string"), F.lit(". "), p),
    )
    lines = F.concat(
        F.array(
            F.concat(F.lit("Executive Summary: "), F.coalesce("summary", F.lit(""))),
            F.lit(""),
            F.lit("Key Discussion Points:"),
        ),
        numbered,
        F.array(
            F.lit(""),
            F.concat(F.lit("Compliance Overview: "), F.coalesce("compliance_summary", F.lit(""))),
            F.lit(""),
            F.concat(F.lit("Recommended Action: "), F.coalesce("recommended_action", F.lit(""))),
        ),
    )
    return note.select("call_id", F.array_join(lines, "\n").alias("note_text"))
