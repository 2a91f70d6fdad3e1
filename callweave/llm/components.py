"""Distributed union-find over links, and finding all links among bucket members without all pairs.

No step brings links or components to the driver; every round is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import discard, written
from callweave.llm.shingles import distinct, jaccard_counts

#: A block of members that are compared with another block: rows, and bytes of their sets.
BLOCK_ROWS = 400
BLOCK_BYTES = 8_000_000

#: What names a pair of blocks of a bucket.
GROUP = ["bucket", "low", "high"]

#: Makes the sorted distinct hashes of a list of bodies.
Sets = Callable[[Sequence[bytes]], list[np.ndarray]]


def _forest(links: DataFrame) -> DataFrame:
    """Reduce the links of each task to a spanning forest: every node of a tree with the tree's least node."""

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            up: dict = {}

            def root(x, up=up):
                top = x
                while up.setdefault(top, top) != top:
                    top = up[top]
                while up[x] != top:
                    up[x], x = top, up[x]
                return top

            for a, b in zip(batch["a"].tolist(), batch["b"].tolist()):
                x, y = root(a), root(b)
                if x != y:
                    up[max(x, y)] = min(x, y)
            pairs = [(x, root(x)) for x in list(up)]
            yield pd.DataFrame([(x, y) for x, y in pairs if x != y], columns=["a", "b"])

    return links.mapInPandas(reduce, links.select("a", "b").schema)


def components(links: DataFrame, purpose: str = "components") -> DataFrame:
    """(id, component) for every node of ``links`` (a, b); the component is its least node.

    Each task first reduces its links to a forest. Then large-star and small-star steps alternate until no
    link changes; a step joins every node to the least node among its neighbours, so a hub of any degree is
    one partial minimum per task and no list of neighbours is ever made.
    """
    links = written(_forest(links.select("a", "b")), purpose)
    before = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: neighbours above a node go to the least of the node and its neighbours.
        least = both.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("a", "least"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = large.where("a <> b").distinct()
        # Small star: a node and its lesser neighbours go to the least of them.
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        foot = down.groupBy("a").agg(F.min("b").alias("least"))
        small = down.join(foot, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(foot.select("a", F.col("least").alias("b")))
        links, old = written(small.where("a <> b").distinct(), purpose), links
        discard(old)
        n = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if before == (n["n"], n["s"]):
            break
        before = (n["n"], n["s"])
    nodes = links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    nodes = written(nodes.unionByName(links.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()), purpose)
    discard(links)
    return nodes


def hash_sets(bodies: Sequence[bytes]) -> list[np.ndarray]:
    """Bodies that are sorted distinct 64-bit hashes already."""
    return [np.frombuffer(b, np.uint64) for b in bodies]


def confirmed(pairs: DataFrame, bodies: DataFrame, per_cent: int, sets: Sets = hash_sets) -> DataFrame:
    """Pairs (a, b) whose sets are at least ``per_cent`` similar; ``sets`` makes them of ``bodies`` (id, body)."""
    of = lambda side: bodies.select(F.col("id").alias(side), F.col("body").alias(f"h{side}"))
    met = pairs.join(of("a"), "a").join(of("b"), "b")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                fine = []
                for x, y in zip(sets(batch["ha"].tolist()), sets(batch["hb"].tolist())):
                    both, either = jaccard_counts(x, y)
                    fine.append(100 * both >= per_cent * either)
                yield batch.loc[fine, ["a", "b"]]

    return met.mapInPandas(check, "a long, b long")


def shared_counts(sets: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """Sizes of all intersections, as products of a 0/1 matrix in strips of its columns."""
    sizes = np.array([len(x) for x in sets])
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.full(len(values), -1)
    several = np.flatnonzero(counts > 1)
    rank[several] = np.arange(len(several))
    column, row = rank[inverse], np.repeat(np.arange(len(sets)), sizes)
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((len(sets), len(sets)), np.float64)
    for begin in range(0, len(several), columns):
        low, high = np.searchsorted(column, [begin, begin + columns])
        strip = np.zeros((len(sets), columns), np.float32)
        strip[row[low:high], column[low:high] - begin] = 1
        total += strip @ strip.T
    return total


def _agreeing(pairs: DataFrame, bodies: DataFrame, agree: int) -> DataFrame:
    """Pairs whose signatures (``sig``, bytes) have at least ``agree`` places in common."""
    of = lambda side: bodies.select(F.col("id").alias(side), F.col("sig").alias(f"s{side}"))
    met = pairs.join(of("a"), "a").join(of("b"), "b")

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x, y = (np.frombuffer(b"".join(batch[c]), np.uint8).reshape(len(batch), -1) for c in ("sa", "sb"))
                yield batch.loc[(x == y).sum(axis=1) >= agree, ["a", "b"]]

    return met.mapInPandas(near, "a long, b long")


def _candidates(names: list[int], sigs: list[bytes], agree: int) -> tuple[np.ndarray, np.ndarray]:
    """Places i < j of members of different components whose signatures agree often enough."""
    name = np.array(names)
    fits = name[:, None] != name[None, :]
    if agree:
        own = np.frombuffer(b"".join(sigs), np.uint8).reshape(len(sigs), -1)
        for begin in range(0, len(own), 64):
            fits[begin : begin + 64] &= np.count_nonzero(own[begin : begin + 64, None] == own[None], axis=2) >= agree
    i, j = np.nonzero(fits)
    return i[i < j], j[i < j]


def _connecting(ids: list[int], names: list[int], pairs, found: dict[int, np.ndarray], per_cent: int) -> list[tuple[int, int]]:
    """Links among ``pairs`` of places that connect components; ``found`` has the sets of the places."""
    places = sorted(found)
    dense = len(pairs[0]) > 8 * len(places)
    if dense:
        both, row = shared_counts([found[k] for k in places]), {k: n for n, k in enumerate(places)}
    up: dict = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    out = []
    for i, j in zip(*(p.tolist() for p in pairs)):
        x, y = root(names[i]), root(names[j])
        if x == y:
            continue
        a, b = len(found[i]), len(found[j])
        # Sets whose sizes differ too much share too little, whatever they share.
        if 100 * min(a, b) < per_cent * max(a, b):
            continue
        shared = both[row[i], row[j]] if dense else jaccard_counts(found[i], found[j])[0]
        if 100 * shared >= per_cent * (a + b - shared):
            up[x] = y
            out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return out


def _hopeful(left: DataFrame, bodies: DataFrame, per_cent: int) -> DataFrame:
    """The rows of ``left`` (bucket, id, component) that may be similar enough to another one of their bucket; bodies are hash sets.

    A set of n hashes, s of which any other set holds, meets a set of m hashes in s at most, so (100 + p) s has to be p (n + m), where m is at
    least that of the bucket's smallest set. Members of a large bucket that are edited too much go here, before anything is dealt into blocks.
    """

    def values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                made = hash_sets(batch["body"].tolist())
                yield pd.DataFrame({"id": np.repeat(batch["id"].to_numpy(), [len(x) for x in made]), "value": np.concatenate(made).view(np.int64)})

    of_left = bodies.join(left.select("id").distinct(), "id", "left_semi").select("id", "body")
    held = of_left.mapInPandas(values, "id long, value long").groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    alone = held.where("n = 1").groupBy("id").agg(F.count(F.lit(1)).alias("alone"))
    sizes = bodies.select("id", F.expr("size div 8").alias("n")).join(alone, "id", "left")
    rows = left.join(sizes.select("id", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("s")), "id")
    least = rows.groupBy("bucket").agg(F.min("n").alias("m"))
    fits = (100 * F.col("s") >= per_cent * F.col("n")) & ((100 + per_cent) * F.col("s") >= per_cent * (F.col("n") + F.col("m")))
    return rows.join(least, "bucket").where(fits).select("bucket", "id", "component")


def _blocks(left: DataFrame, sizes: DataFrame) -> DataFrame:
    """``left`` (bucket, id, component) as groups (bucket, low, high) of bounded size in which members are compared.

    Of buckets with the same members one is looked at. Members of a bucket's largest component are dealt into blocks of their own, which meet
    the blocks of the others but not each other.
    """
    marks = [F.bit_xor(F.xxhash64("id", F.lit(seed))).alias(f"x{seed}") for seed in (1, 2)]
    parts = left.join(sizes, "id").groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), *marks)
    per = parts.groupBy("bucket").agg(
        F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"),
        F.max(F.struct("n", "bytes", "component")).alias("main"), F.count(F.lit(1)).alias("parts"),
    ).where("parts > 1")
    one = per.groupBy("n", "x1", "x2").agg(F.min(F.struct("bucket", "bytes", "main")).alias("one")).select("n", "one.*")
    number = lambda rows, size: F.greatest(F.ceil(rows / BLOCK_ROWS), F.ceil(size / BLOCK_BYTES)).cast("int")
    main = F.col("main")
    whole = number(F.col("n"), F.col("bytes")) == 1
    few = F.when(whole, 1).otherwise(number(F.col("n") - main["n"], F.col("bytes") - main["bytes"]))
    many = F.when(whole, 0).otherwise(number(main["n"], main["bytes"]))
    placed = left.select("bucket", "id", "component").join(one.select("bucket", few.alias("few"), many.alias("many"), main["component"].alias("main")), "bucket")
    of_main = (F.col("component") == F.col("main")) & (F.col("many") > 0)
    at = F.xxhash64("id")
    block = F.when(of_main, F.col("few") + F.pmod(at, F.greatest("many", F.lit(1)))).otherwise(F.pmod(at, "few")).cast("int").alias("block")
    others = F.col("few") + F.when(of_main, 0).otherwise(F.col("many"))
    placed = placed.select("bucket", "id", "component", block, F.explode(F.sequence(F.lit(0), others - 1)).alias("other"))
    return placed.select("bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "id", "component")


def _grouped(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[list[tuple]]:
    """The groups that end in each of the sorted batches: (bucket, low, high) and the lists of their ``columns``."""
    last, held = None, ()
    for batch in batches:
        done = []
        for now, *values in zip(zip(*[batch[c].tolist() for c in GROUP]), *[batch[c].tolist() for c in columns]):
            if now != last:
                done += [(last, held)] if held else []
                last, held = now, [[] for _ in columns]
            for store, value in zip(held, values):
                store.append(value)
        yield done
    yield [(last, held)] if held else []


def _near_members(placed: DataFrame, bodies: DataFrame, agree: int) -> DataFrame:
    """The rows of ``placed`` whose signature is near to one of another component in their group; bodies stay where they are."""
    dealt = placed.join(bodies.select("id", "sig"), "id").repartition(*GROUP).sortWithinPartitions(*GROUP)

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for groups in _grouped(batches, ["id", "component", "sig"]):
            out = []
            for group, (ids, names, sigs) in groups:
                if len(set(names)) > 1:
                    used = distinct(np.concatenate(_candidates(names, sigs, agree))).tolist()
                    out += [(*group, ids[k], names[k]) for k in used]
            yield pd.DataFrame(out, columns=[*GROUP, "id", "component"]).astype("int64")

    return dealt.mapInPandas(near, "bucket long, low int, high int, id long, component long")


def _rest(left: DataFrame, bodies: DataFrame, per_cent: int, sets: Sets, agree: int, purpose: str = "links") -> DataFrame:
    """Links between different components that share a bucket of ``left`` (bucket, id, component).

    Members that cannot be like another are left out where the bodies are hash sets (``_hopeful``). The others of a bucket are dealt into blocks,
    and pairs of blocks are groups of bounded size (``_blocks``), in which many intersections come from one matrix product. A group gives the links
    that connect its components: fewer than it has rows. With ``agree`` the signatures are dealt first, and only members that another one's is near to
    get their bodies dealt and their sets made.
    """
    if sets is hash_sets:
        left = written(_hopeful(left, bodies, per_cent), purpose)
    placed = _blocks(left, bodies.select("id", "size"))
    if agree:
        placed = written(_near_members(placed, bodies, agree), purpose)
    # Dealt by all three, so that the blocks of one bucket go to many tasks.
    sig = F.col("sig") if agree else F.lit(None).cast("binary").alias("sig")
    dealt = placed.join(bodies.select("id", "body", sig), "id").repartition(*GROUP).sortWithinPartitions(*GROUP)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for groups in _grouped(batches, ["id", "component", "body", "sig"]):
            plans, need = [], []
            for _, (ids, names, texts, sigs) in groups:
                if len(set(names)) > 1:
                    pairs = _candidates(names, sigs, agree)
                    used = distinct(np.concatenate(pairs)).tolist()
                    if used:
                        plans.append((ids, names, pairs, used, len(need)))
                        need += [texts[k] for k in used]
            made = sets(need) if need else []
            out = []
            for ids, names, pairs, used, begin in plans:
                out += _connecting(ids, names, pairs, dict(zip(used, made[begin : begin + len(used)])), per_cent)
            yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return dealt.mapInPandas(compare, "a long, b long")


def shared_buckets(members: DataFrame) -> DataFrame:
    """The distinct rows of ``members`` (bucket, id) whose bucket has another id as well.

    One exchange deals the buckets. Most rows are alone in theirs and end where they are sorted, neither counted nor joined; of a bucket that goes on
    in the next batch one id is held, never the bucket.
    """
    dealt = members.select("bucket", "id").repartition("bucket").sortWithinPartitions("bucket")

    def several(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buckets = ids = np.zeros(0, np.int64)
        for batch in batches:
            if len(batch):
                buckets, ids = np.r_[buckets[-1:], batch["bucket"].to_numpy()], np.r_[ids[-1:], batch["id"].to_numpy()]
                starts = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]])
                differ = np.minimum.reduceat(ids, starts) != np.maximum.reduceat(ids, starts)
                found = np.repeat(differ, np.diff(np.r_[starts, len(ids)]))
                yield pd.DataFrame({"bucket": buckets[found], "id": ids[found]})

    return dealt.mapInPandas(several, "bucket long, id long").distinct()


def linked(
    members: DataFrame,
    bodies_of: Callable[[DataFrame], DataFrame],
    per_cent: int,
    *,
    sets: Sets = hash_sets,
    near: Callable[[DataFrame], DataFrame] | None = None,
    agree: int = 0,
    stars: int = 2,
    purpose: str = "links",
    met: Callable[[], None] = lambda: None,
) -> DataFrame:
    """(id, component) of all members that some bucket brings together and whose sets are ``per_cent`` similar.

    ``members`` has (bucket, id), repeated rows count once. In each of the star rounds every bucket names one of its members as hub, and
    only (member, hub) pairs whose components still differ are confirmed, after the cheaper test ``near``. What is left after the stars are the
    buckets that hold more than one component; there, blocks of members are compared with each other (``_rest``), so no connection is
    lost and no list of pairs is made. Without ``near`` a hub has met all others of its bucket as blocks would, so it leaves the bucket, and buckets of
    two are done with. Copies of one text never come here: they are one member.

    ``bodies_of`` is called once with the distinct ids that share a bucket with another and gives what their sets are made of (id, body);
    ``sets`` makes the sorted hashes of a list of bodies. With ``agree``, bodies also have ``sig``, and only members whose signatures have that many bytes
    in common are compared. ``met`` is called when ``members`` has been read for the last time.
    """
    bodies = nodes = None
    members = before = written(shared_buckets(members), purpose)
    met()
    for step in range(stars + 1):
        if nodes is None:
            placed = members.withColumn("component", F.col("id"))
        else:
            placed = members.join(nodes, "id", "left").withColumn("component", F.coalesce("component", "id"))
        per = placed.groupBy("bucket").agg(
            F.min_by(F.struct("id", "component"), F.struct(F.xxhash64("id", F.lit(step)), "id")).alias("hub"),
            F.min("component").alias("low"),
            F.max("component").alias("high"),
        ).where(F.col("low") != F.col("high"))
        placed = written(placed.join(per.select("bucket", "hub"), "bucket"), purpose)
        discard(before)
        before = placed
        # The other buckets are done with.
        members = (placed if near is not None else placed.where(F.col("id") != F.col("hub.id"))).select("bucket", "id")
        if bodies is None:
            bodies = bodies_of(placed.select("id").distinct())
            bodies = written(bodies.withColumn("size", F.octet_length("body")), purpose)
        if step < stars:
            raw = placed.where(F.col("component") != F.col("hub.component")).select(F.col("id").alias("x"), F.col("hub.id").alias("y"))
            pairs = raw.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
            # Numbers only: the bodies of a pair come in with the step that compares them.
            pairs = pairs if near is None else near(pairs)
            pairs = written(_agreeing(pairs, bodies, agree) if agree else pairs, purpose)
            links = written(confirmed(pairs, bodies, per_cent, sets), purpose)
            discard(pairs)
        else:
            links = written(_rest(placed, bodies, per_cent, sets, agree, purpose), purpose)
        # The components so far stand for the links they came from.
        old, nodes = nodes, components(links if nodes is None else links.unionByName(nodes.select(F.col("id").alias("a"), F.col("component").alias("b"))), purpose)
        discard(old, links)
    discard(before, bodies)
    return nodes
