"""A Merkle manifest of a dataset: a content-addressed graph of digests, and proofs by descending it.

Every row is a leaf: the digest of its columns. Per group, leaves in order are numbered without a global window (``ranks.ranked``);
while a group has several nodes, every FAN consecutive ones become the digest of their concatenated digests. The groups' roots are
leaves of one more tree, whose root stands for the dataset. Each level is a table of records (digest, children): the store. It is
addressed by content, equal subtrees share a record.

A proof descends from the root. What is asked for at a height are the distinct prefixes of the requested ranks, in base FAN: leaves below
one node share its way down. A node's digest finds its children in the store, the next digit of the rank selects one, and the others are
collected as what lies left and right of it. The segments come top down and are reversed for folding, which starts at the leaf.

A level has a FAN-th of the rows of the one below, so all of them together shuffle about as much as the leaves. Nothing is collected but
the height of the tree. Paths grow with the logarithm of the table; they are held once for FAN leaves until the last step.

Defined cases: a null field is ``-``; null keys of groups come first, as do null ids within a group; rows with equal ids go by their leaf; repeated
rows are leaves of their own, next to each other; a group of one leaf has the leaf as its root, a dataset of one group that group's root;
a table without rows has no root and gives an empty result; a row with a null id is never tampered with in ``op12_manifest``.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import CRC_TABLE_SQL, crc_sql, discard, lower_ascii, need, written
from callweave.llm.ranks import ranked

#: Children of a node, a power of two.
FAN_BITS = 4
FAN = 1 << FAN_BITS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


class Tree(NamedTuple):
    """``levels[h]``: records (digest, children) of the nodes at height h + 1. ``tops``: (key, height, digest), one row a group."""

    levels: list[DataFrame]
    tops: DataFrame


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(f) for f in fields]).cast("binary"), 256)


def tree(leaves: DataFrame) -> Tree:
    """The tree of each key over ``leaves``: (key, place, total, digest), places from 0."""
    highest = leaves.agg(F.max("total").alias("n")).first()["n"] or 0
    nodes = leaves.select("key", "place", "total", "digest")
    levels, tops, height = [], nodes.where("total = 1").select("key", F.lit(0).alias("height"), "digest"), 0
    while highest > 1:
        child = F.struct(F.col("place").bitwiseAND(F.lit(FAN - 1)).alias("digit"), "digest")
        up = F.shiftright("place", FAN_BITS).alias("place")
        # At most FAN children to a node.
        runs = nodes.where("total > 1").groupBy("key", up).agg(
            F.sort_array(F.collect_list(child)).alias("run"), F.max(F.shiftright(F.col("total") + (FAN - 1), FAN_BITS)).alias("total")
        )
        runs = runs.select("key", "place", "total", F.transform("run", lambda x: x["digest"]).alias("children"))
        runs = runs.withColumn("digest", F.sha2(F.array_join("children", "").cast("binary"), 256))
        nodes = written(runs, "level")
        levels.append(nodes)
        height += 1
        tops = tops.unionByName(nodes.where("total = 1").select("key", F.lit(height).alias("height"), "digest"))
        highest = -(-highest // FAN)
    return Tree(levels, tops)


def store(*trees: Tree) -> DataFrame:
    """The records (digest, children) of trees, each once. ``op12_manifest`` reads it level by level."""
    parts = [level.select("digest", "children") for t in trees for level in t.levels]
    if not parts:
        return trees[0].tops.select("digest", F.array("digest").alias("children")).limit(0)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.dropDuplicates(["digest"])


def descend(grown: Tree, roots: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests`` (key, place, ...) with what ``roots`` (key, height, digest, segments, ...) carries, and the way down in ``segments``.

    ``segments`` has (left, right) of every height from the root down to the leaf. ``digest`` is the leaf that the descent arrives at.
    """
    given = [c for c in roots.columns if c not in ("key", "height", "digest", "segments")]
    asked = [requests]
    for _ in grown.levels:
        asked.append(asked[-1].select("key", F.shiftright("place", FAN_BITS).alias("place")).distinct())
    if grown.levels:
        asked[1] = written(asked[1], "asked")
        asked[2:] = [asked[1].select("key", F.shiftright("place", FAN_BITS * h).alias("place")).distinct() for h in range(1, len(grown.levels))]
    at = lambda h: roots.where(F.col("height") == h).select("key", F.lit(0).cast("long").alias("place"), "digest", "segments", *given)
    front = at(len(grown.levels))
    for height in range(len(grown.levels), 0, -1):
        records = grown.levels[height - 1].select("digest", "children").dropDuplicates(["digest"])
        here = front.join(records, "digest").select("key", F.col("place").alias("up"), "segments", "children", *given)
        if height > 1:
            here = written(here, "front")
            discard(front)
        below = asked[height - 1].withColumn("up", F.shiftright("place", FAN_BITS))
        digit = F.col("place").bitwiseAND(F.lit(FAN - 1)).cast("int")
        part = lambda begin, size: F.array_join(F.slice("children", begin, size), "")
        segment = F.struct(part(F.lit(1), digit).alias("left"), part(digit + 2, F.lit(FAN)).alias("right"))
        met = below.join(here, ["key", "up"]).withColumns(
            {"segments": F.concat("segments", F.array(segment)), "digest": F.get("children", digit)}
        )
        front = met.drop("up", "children")
        if height > 1:
            front = front.unionByName(at(height - 1))
    lone = requests.join(at(0).drop("place"), "key")
    return front.unionByName(lone) if grown.levels else lone


def folded(start: Column, segments: Column) -> Column:
    """The root that a leaf and its segments, leaf first, lead to."""
    return F.aggregate(segments, start, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]).cast("binary"), 256))


def siblings(segments: Column) -> Column:
    """All digests of a proof, leaf first, in one text."""
    return F.array_join(F.transform(segments, lambda s: F.concat(s["left"], s["right"])), "")


def manifest(rows: DataFrame, by: str = "source", order: str = "doc_id", extra: Sequence[str] = ()) -> DataFrame:
    """(order, by, leaf, place, subroot, root, segments, extra) of ``rows``: ``leaf``, the columns ``by`` and ``order``, and ``extra``.

    ``segments`` leads from the leaf to the root.
    """
    given = rows.select(F.struct(F.col(by).alias("by")).alias("key"), F.struct(F.col(order).alias("id"), F.col("leaf").alias("digest"), *extra).alias("row"))
    # Leaves are computed once, before the sort samples them.
    given = written(given, "leaves")
    order_by = [F.col("row.id").asc_nulls_first(), F.col("row.digest").asc()]
    leaves = written(ranked(given, ["key"], order_by), "places")
    discard(given)
    grown = tree(leaves.select("key", "place", "total", F.col("row.digest").alias("digest")))
    tops = written(grown.tops, "tops")
    whole = ranked(tops.withColumn("all", F.lit(0)), ["all"], [F.col("key").asc()])
    whole = written(whole.select(F.struct("all").alias("key"), "place", "total", F.struct("key", "height", "digest").alias("group"), "digest"), "groups")
    above = tree(whole)
    root = above.tops.select("key", "height", "digest", F.col("digest").alias("root"), F.array().cast("array<struct<left:string,right:string>>").alias("segments"))
    roots = descend(above, root, whole.select("key", "place", "group"))
    roots = roots.select(F.col("group.key").alias("key"), "group.height", "group.digest", F.col("group.digest").alias("subroot"), "root", "segments")
    found = descend(grown, written(roots, "roots"), leaves.select("key", "place", "row"))
    return found.select(
        F.col("row.id").alias(order), F.col("key.by").alias(by), F.col("digest").alias("leaf"), "place", "subroot", "root",
        F.reverse("segments").alias("segments"), *[F.col("row").getField(c).alias(c) for c in extra],
    )


def op12_manifest(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    need(docs, FIELDS)
    own = [F.col(c) for c in FIELDS]
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    changed = F.when(crc % 5 == 0, leaf([*own[:-1], lower_ascii(F.col("text"))]))
    rows = docs.select("doc_id", "source", leaf(own).alias("leaf"), changed.alias("changed"))
    found = manifest(rows, extra=["changed"])
    found = found.withColumn("folded_root", folded(F.coalesce("changed", "leaf"), F.col("segments")))
    return found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("segments")).cast("binary"), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )

SQL = rf"""
WITH RECURSIVE crct AS (
  {CRC_TABLE_SQL}
), coded AS (
  SELECT d.*, {crc_sql("doc_id::VARCHAR")} AS crc FROM documents d, crct
), parts AS (
  SELECT *, concat_ws('', {", ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in FIELDS[:-1])}) AS head,
         coalesce(strlen(text) || ':' || text, '-') AS body,
         coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') AS lowered FROM coded
), digests AS (
  SELECT doc_id, source, sha256(head || body) AS leaf, CASE WHEN crc % 5 = 0 THEN sha256(head || lowered) END AS changed FROM parts
), leaves AS (
  SELECT *, row_number() OVER () AS id, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM digests
), nodes(source, level, place, n, digest) AS (
  SELECT source, 0, place, n, leaf FROM leaves
  UNION ALL
  SELECT source, level + 1, place // 16, (max(n) + 15) // 16, sha256(string_agg(digest, '' ORDER BY place)) FROM nodes WHERE n > 1 GROUP BY source, level, place // 16
), tops AS (
  SELECT source, level, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1
), above(level, place, n, digest) AS (
  SELECT 0, place, n, subroot FROM tops
  UNION ALL
  SELECT level + 1, place // 16, (max(n) + 15) // 16, sha256(string_agg(digest, '' ORDER BY place)) FROM above WHERE n > 1 GROUP BY level, place // 16
), around AS (
  SELECT l.id, x.level AS step, (l.place // (16 ** x.level)::BIGINT) AS own, x.place, x.digest FROM leaves l JOIN nodes x
    ON x.source IS NOT DISTINCT FROM l.source AND x.n > 1 AND x.place // 16 = l.place // (16 ** (x.level + 1))::BIGINT
  UNION ALL
  SELECT l.id, t.level + x.level, t.place // (16 ** x.level)::BIGINT, x.place, x.digest FROM leaves l JOIN tops t ON t.source IS NOT DISTINCT FROM l.source
    JOIN above x ON x.n > 1 AND x.place // 16 = t.place // (16 ** (x.level + 1))::BIGINT
), segments AS (
  SELECT id, step, coalesce(string_agg(digest, '' ORDER BY place) FILTER (place < own), '') AS lhs, coalesce(string_agg(digest, '' ORDER BY place) FILTER (place > own), '') AS rhs
  FROM around GROUP BY id, step
), folds(id, step, digest) AS (
  SELECT id, 0, coalesce(changed, leaf) FROM leaves
  UNION ALL
  SELECT f.id, f.step + 1, sha256(s.lhs || f.digest || s.rhs) FROM folds f JOIN segments s ON s.id = f.id AND s.step = f.step
), folded AS (
  SELECT id, arg_max(digest, step) AS folded_root FROM folds GROUP BY id
), proofs AS (
  SELECT id, sha256(string_agg(lhs || rhs, '' ORDER BY step)) AS proof_sha256 FROM segments GROUP BY id
)
SELECT l.doc_id, l.leaf, t.subroot, a.digest AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, f.folded_root, f.folded_root = a.digest AS verified
FROM leaves l JOIN tops t ON t.source IS NOT DISTINCT FROM l.source JOIN above a ON a.n = 1 JOIN folded f ON f.id = l.id LEFT JOIN proofs p ON p.id = l.id
"""
