"""Policy scanning: keywords, phrases, threats, near misses and regulatory patterns.

Violations are a long table (call_id, seg_idx, speaker, category, keyword, matched, match_type,
distance, stage, pos); (stage, pos) is the order in which they are found within a turn.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave.functions import lexicon
from callweave.functions.lexicon import java_pattern, needs_devanagari
from callweave.functions.rules import is_agent
from callweave.functions.text import DEVANAGARI, swapped, tokens_with_marks

EXACT, COMPOUND, THREAT, FUZZY, REGULATORY = 0, 1, 2, 3, 4
VIOLATION_COLUMNS = [
    "call_id", "seg_idx", "speaker", "category", "keyword", "matched", "match_type", "distance", "stage", "pos",
]


@dataclass(frozen=True)
class Policy:
    """The dictionaries and patterns to scan for."""

    keywords: Sequence[str] = tuple(lexicon.ABUSIVE_KEYWORDS)
    innocent: Sequence[str] = tuple(lexicon.INNOCENT_WORDS)
    compounds: Sequence[str] = tuple(lexicon.COMPOUND_PATTERNS)
    threats: Sequence[str] = tuple(lexicon.THREAT_PATTERNS)
    regulatory: Mapping[str, Sequence[str]] = field(
        default_factory=lambda: {"RBI": lexicon.RBI_PATTERNS, "IRDAI": lexicon.IRDAI_PATTERNS}
    )
    max_distance: int = 2
    min_token: int = 5

    def with_keywords(self, *extra: str) -> Policy:
        return Policy(
            (*self.keywords, *extra), self.innocent, self.compounds, self.threats, self.regulatory,
            self.max_distance, self.min_token,
        )

    def with_regulatory(self, **extra: Sequence[str]) -> Policy:
        return Policy(
            self.keywords, self.innocent, self.compounds, self.threats, {**self.regulatory, **extra},
            self.max_distance, self.min_token,
        )


DEFAULT_POLICY = Policy()


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _is_devanagari(char: str) -> bool:
    return "\u0900" <= char <= "\u097f"


def keyword_hits(lowered: Column, keywords: Sequence[str], devanagari: Column | None = None) -> Column:
    """Keywords contained in the text, in dictionary order; ``devanagari`` spares texts without such letters the keywords that have some."""

    def hit(word: str) -> Column:
        found = F.contains(lowered, F.lit(word))
        return devanagari & found if devanagari is not None and any(map(_is_devanagari, word)) else found

    return F.array_compact(F.array(*[F.when(hit(k), F.lit(k)) for k in dict.fromkeys(keywords)])).cast("array<string>")


def folded(text: Column) -> Column:
    """Lower case, with the letters that case-insensitive matching treats as s and i mapped to them."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.lower(swapped(text, {"\u017f": "s", "\u0131": "i", "\u0130": "i"})))


def has_devanagari(text: Column) -> Column:
    return F.when(F.octet_length(text) == F.length(text), False).otherwise(text.rlike(DEVANAGARI))


def pattern_hits(
    text: Column, patterns: Sequence[str], folded_text: Column | None = None, devanagari: Column | None = None
) -> Column:
    """First match of every pattern that matches, in pattern order.

    Where it is known what a match must contain, a substring test decides whether the regular
    expression is run at all.
    """
    found = []
    for p in patterns:
        regex = java_pattern(p)
        hit = text.rlike(regex)
        if folded_text is not None and p in lexicon.PATTERN_HINTS:
            hint = F.lit(False)
            for word in lexicon.PATTERN_HINTS[p]:
                hint = hint | F.contains(folded_text, F.lit(word))
            hit = hint & hit
        elif devanagari is not None and needs_devanagari(p):
            hit = devanagari & hit
        found.append(F.when(hit, F.regexp_extract(text, regex, 0)))
    return F.array_compact(F.array(*found)).cast("array<string>") if found else _strings([])


def _keep_new(found: Column, seen: Column, same) -> Column:
    """Matches that are not yet covered, taken one after the other."""
    return F.aggregate(
        found,
        _strings([]),
        lambda kept, m: F.when(F.exists(F.concat(seen, kept), lambda s: same(s, m)), kept).otherwise(
            F.concat(kept, F.array(m))
        ),
    )


def scan_columns(turns: DataFrame, policy: Policy = DEFAULT_POLICY, text: str = "text") -> DataFrame:
    """Add ``exact``, ``compound``, ``threat`` (arrays of strings) and one array per regulator."""
    body = F.coalesce(F.col(text), F.lit(""))
    # Used many times each, so Spark computes them once per row instead of inlining them.
    out = turns.withColumns({"__low": F.lower(body), "__fold": folded(body), "__dev": has_devanagari(body)})
    hits = lambda ps: pattern_hits(body, ps, F.col("__fold"), F.col("__dev"))
    out = out.withColumns(
        {
            "exact": keyword_hits(F.col("__low"), policy.keywords, F.col("__dev")),
            "__c": hits(policy.compounds),
            "__t": hits(policy.threats),
            **{f"reg_{k}": hits(ps) for k, ps in policy.regulatory.items()},
        }
    )
    contains = lambda s, m: F.contains(s, m) | F.contains(m, s)
    out = out.withColumn("compound", _keep_new(F.col("__c"), F.col("exact"), contains))
    out = out.withColumn(
        "threat", _keep_new(F.col("__t"), F.concat("exact", "compound"), lambda s, m: s == m)
    )
    return out.drop("__low", "__fold", "__dev", "__c", "__t")


def _as_rows(found: Column, category: str, match_type: str, stage: int, first: int = 0) -> Column:
    return F.transform(
        found,
        lambda m, i: F.struct(
            F.lit(category).alias("category"),
            m.alias("keyword"),
            m.alias("matched"),
            F.lit(match_type).alias("match_type"),
            F.lit(0).cast("long").alias("distance"),
            F.lit(stage).alias("stage"),
            (i + F.lit(first)).cast("long").alias("pos"),
        ),
    )


def _direct_rows(policy: Policy) -> list[Column]:
    return [
        _as_rows(F.col("exact"), "ABUSIVE", "exact", EXACT),
        _as_rows(F.col("compound"), "ABUSIVE", "compound", COMPOUND),
        _as_rows(F.col("threat"), "THREAT", "threat", THREAT),
        *[
            _as_rows(F.col(f"reg_{k}"), k, "pattern", REGULATORY, sum(len(ps) for ps in list(policy.regulatory.values())[:i]))
            for i, k in enumerate(policy.regulatory)
        ],
    ]


def _reach_table(policy: Policy, devanagari: bool) -> Column | None:
    """Map literal from token length to the keywords that such a token can reach, in dictionary order.

    Every Devanagari letter of a keyword costs a token without any such letter an edit, so keywords that have more of them than
    edits are allowed are out of its reach.
    """
    reach: dict[int, list[str]] = {}
    for word, _, length in reachable_lengths(policy):
        if devanagari or sum(map(_is_devanagari, word)) <= policy.max_distance:
            reach.setdefault(length, []).append(word)
    if not reach:
        return None
    return F.create_map(*[x for n, words in sorted(reach.items()) for x in (F.lit(n), F.array(*[F.lit(w) for w in words]))])


def _near_keywords(token: Column, policy: Policy, devanagari: bool = True) -> Column:
    """Keywords one or two edits from a token, in dictionary order: array of (keyword, distance).

    The keywords are part of the plan, by token length; only those in reach are compared. ``devanagari`` says whether tokens may have such letters.
    """
    table = _reach_table(policy, devanagari)
    if table is None:
        return F.array().cast("array<struct<keyword:string,distance:bigint>>")
    allowed = F.when(F.length(token) < 6, 1).otherwise(policy.max_distance)
    close = F.filter(
        F.coalesce(F.element_at(table, F.length(token)), _strings([])),
        lambda k: F.levenshtein(token, k, policy.max_distance).between(1, allowed),
    )
    return F.transform(close, lambda k: F.struct(k.alias("keyword"), F.levenshtein(token, k, policy.max_distance).cast("long").alias("distance")))


def _candidate_rows(policy: Policy, text: str) -> Column:
    """Near misses: tokens of a reachable length that some keyword is close to and no earlier detector has taken.

    The few tokens that are close are then looked up among what was taken and the innocent words.
    """
    seen = F.concat("exact", "compound", "threat")
    lengths = sorted({n for _, _, n in reachable_lengths(policy)})
    innocent = list(dict.fromkeys(policy.innocent))
    low, high = (lengths[0], lengths[-1]) if lengths else (1, 0)
    body = F.coalesce(F.col(text), F.lit(""))
    tokens = F.array_distinct(tokens_with_marks(body))

    def rows(devanagari: bool) -> Column:
        near = F.transform(
            tokens,
            lambda t, i: F.when(
                F.length(t).between(low, high),
                F.struct(t.alias("token"), i.cast("long").alias("pos"), F.get(_near_keywords(t, policy, devanagari), F.lit(0)).alias("m")),
            ),
        )
        return F.filter(near, lambda r: r["m"].isNotNull())

    near = F.when(has_devanagari(body), rows(True)).otherwise(rows(False))
    free = lambda t: ~F.array_contains(seen, t) & (~t.isin(innocent) if innocent else F.lit(True))
    return F.transform(
        F.filter(near, lambda r: free(r["token"])),
        lambda r: F.struct(
            F.lit("ABUSIVE").alias("category"),
            r["m"]["keyword"].alias("keyword"),
            r["token"].alias("matched"),
            F.lit("fuzzy").alias("match_type"),
            r["m"]["distance"].alias("distance"),
            F.lit(FUZZY).alias("stage"),
            r["pos"].alias("pos"),
        ),
    )


def direct_violations(scanned: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Everything that one look at a turn finds, in long form."""
    rows = F.concat(*_direct_rows(policy))
    return scanned.select("call_id", "seg_idx", "speaker", F.inline(rows)).select(VIOLATION_COLUMNS)


def reachable_lengths(policy: Policy) -> list[tuple[str, int, int]]:
    """(keyword, position, token length) wherever the length difference allows a match."""
    rows = []
    for pos, word in enumerate(dict.fromkeys(policy.keywords)):
        for length in range(policy.min_token, len(word) + policy.max_distance + 1):
            allowed = 1 if length < 6 else policy.max_distance
            if abs(length - len(word)) <= allowed:
                rows.append((word, pos, length))
    return rows


def near_miss_dictionary(tokens: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """(token, keyword, distance) for distinct tokens one or two edits from a keyword.

    The keywords are part of the plan, by the token lengths that can reach them: no join.
    """
    known = tokens.select("token").distinct()
    if policy.innocent:
        known = known.where(~F.col("token").isin(list(dict.fromkeys(policy.innocent))))
    found = known.withColumn("m", F.get(_near_keywords(F.col("token"), policy), F.lit(0))).where("m is not null")
    return found.select("token", "m.keyword", "m.distance")


def near_misses(turns: DataFrame, policy: Policy = DEFAULT_POLICY, text: str = "text") -> DataFrame:
    """Tokens close to a keyword that no earlier detector has taken, in long form."""
    scanned = scan_columns(turns, policy, text)
    return scanned.select("call_id", "seg_idx", "speaker", F.inline(_candidate_rows(policy, text))).select(VIOLATION_COLUMNS)


def violations(turns: DataFrame, policy: Policy = DEFAULT_POLICY, text: str = "text") -> DataFrame:
    """All violations of all turns.

    One scan of the texts finds everything, near misses included: there is neither a join nor a shuffle.
    """
    rows = F.concat(*_direct_rows(policy), _candidate_rows(policy, text))
    return scan_columns(turns, policy, text).select("call_id", "seg_idx", "speaker", F.inline(rows)).select(VIOLATION_COLUMNS)


def first_of_kind(found: DataFrame) -> DataFrame:
    """Keep the first violation per turn and matched string."""
    at = Window.partitionBy("call_id", "seg_idx", "matched").orderBy("stage", "pos")
    return found.withColumn("__rn", F.row_number().over(at)).where("__rn = 1").drop("__rn")


def flag_text() -> Column:
    return F.concat(F.col("category"), F.lit(":"), F.col("keyword"))


def turn_flags(turns: DataFrame, found: DataFrame) -> DataFrame:
    """Per turn: ``violation_count`` and the ordered ``flags``; turns without any stay."""
    entry = F.struct("stage", "pos", flag_text().alias("flag"))
    per_turn = found.groupBy("call_id", "seg_idx").agg(
        F.array_sort(F.collect_list(entry)).alias("__f"), F.count(F.lit(1)).alias("violation_count")
    )
    return (
        turns.select("call_id", "seg_idx", "speaker")
        .join(per_turn, ["call_id", "seg_idx"], "left")
        .select(
            "call_id",
            "seg_idx",
            "speaker",
            F.coalesce("violation_count", F.lit(0).cast("long")).alias("violation_count"),
            F.coalesce(F.transform("__f", lambda r: r["flag"]), _strings([])).alias("flags"),
        )
    )


def first_flags(found: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` flags of each call, in order."""
    at = Window.partitionBy("call_id").orderBy("seg_idx", "stage", "pos", "matched")
    top = found.withColumn("rn", F.row_number().over(at)).where(F.col("rn") <= n)
    rows = F.array_sort(F.collect_list(F.struct("rn", flag_text().alias("flag"))))
    return top.groupBy("call_id").agg(F.transform(rows, lambda r: r["flag"]).alias("flags"))


def call_compliance(counted: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """Totals per call from rows with ``speaker`` and ``violation_count``."""
    v = F.coalesce("violation_count", F.lit(0).cast("long"))
    agent = F.coalesce(is_agent(F.col("speaker")), F.lit(False))
    out = counted.groupBy("call_id").agg(
        F.sum(v).alias("total_violations"),
        F.sum(F.when(agent, v).otherwise(0)).alias("agent_violations"),
        F.sum(F.when(agent, 0).otherwise(v)).alias("customer_violations"),
    )
    if calls is not None:
        zero = F.lit(0).cast("long")
        out = calls.select("call_id").join(out, "call_id", "left").select(
            "call_id",
            *[F.coalesce(c, zero).alias(c) for c in ("total_violations", "agent_violations", "customer_violations")],
        )
    return out.withColumn("compliant", F.col("total_violations") == 0)


def violation_totals(found: DataFrame, calls: DataFrame) -> DataFrame:
    """Totals per call straight from the long table; calls without violations stay."""
    counted = found.groupBy("call_id", "speaker").agg(F.count(F.lit(1)).alias("violation_count"))
    return call_compliance(counted, calls)


def merge_reviews(counted: DataFrame, reviews: DataFrame) -> DataFrame:
    """Let a reviewer's verdicts override keyword results, call by call.

    ``counted`` has (call_id, seg_idx, speaker, violation_count, flags), ``reviews`` (call_id,
    seg_idx, review_count). Reviews count only for calls where every turn has one. Adds ``source``
    and ``suppressed`` (flags the reviewer dismissed).
    """
    joined = counted.join(reviews.select("call_id", "seg_idx", "review_count"), ["call_id", "seg_idx"], "left")
    n_reviews = reviews.groupBy("call_id").agg(F.count(F.lit(1)).alias("__n_reviews"))
    n_turns = counted.groupBy("call_id").agg(F.count(F.lit(1)).alias("__n_turns"))
    valid = n_turns.join(n_reviews, "call_id").where("__n_turns = __n_reviews").select(
        "call_id", F.lit(True).alias("__valid")
    )
    joined = joined.join(valid, "call_id", "left")
    usable = F.coalesce("__valid", F.lit(False)) & F.col("review_count").isNotNull()
    dismissed = usable & (F.col("review_count") == 0) & (F.col("violation_count") > 0)
    source = (
        F.when(usable & (F.col("review_count") > 0), "reviewer").when(dismissed, "suppressed").otherwise("keyword")
    )
    final = F.when(usable & (F.col("review_count") > 0), F.col("review_count")).when(dismissed, 0).otherwise(
        F.col("violation_count")
    )
    return joined.select(
        "call_id",
        "seg_idx",
        "speaker",
        final.cast("long").alias("violation_count"),
        source.alias("source"),
        F.when(dismissed, F.col("flags")).otherwise(_strings([])).alias("suppressed"),
    )
