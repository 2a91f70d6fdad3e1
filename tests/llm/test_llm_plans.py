"""What the pipeline's stages read, deal out and send to Python, seen in their plans, and the same results by plain loops."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from callweave.llm import components, decontaminate, fuzzy_lines, mixing, near_dups, quality, shingles


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_are_counted_once_for_the_mix(spark):
    rows = [(i, f"s{i % 3}" if i % 7 else None, "word " * (i % 40)) for i in range(300)]
    taken = mixing.copies(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    assert "regexp" not in plan(taken)
    assert {r.row.doc_id: r["size"] for r in taken.collect()} == {i: i % 40 for i in range(300)}


@pytest.mark.parametrize("n", [2, 5])
def test_hubs_leave_their_buckets(spark, monkeypatch, n):
    """A star round compares the hub with all others, so of a bucket of two nothing is left for the blocks."""
    rng = random.Random(n)
    sets = {b * 10 + i: np.unique(np.array([rng.randrange(10**9) for _ in range(20)], np.uint64)) for b in range(6) for i in range(n)}
    sets[11] = sets[10]
    members = spark.createDataFrame([(k // 10, k) for k in sets], "bucket long, id long")
    bodies = spark.createDataFrame([(k, bytearray(s.tobytes())) for k, s in sets.items()], "id long, body binary")
    left, rest = [], components._rest

    def counted(placed, *args):
        left.append(placed.count())
        return rest(placed, *args)

    monkeypatch.setattr(components, "_rest", counted)
    nodes = components.linked(members, lambda ids: bodies.join(ids, "id", "left_semi"), 80, stars=1)
    assert {(r.id, r.component) for r in nodes.collect()} == {(10, 10), (11, 10)}
    assert left[0] == 0 if n == 2 else 0 < left[0] <= 6 * (n - 1)


def test_components_go_on_from_those_found(spark):
    """Members that only a chain over several buckets and rounds connects."""
    rng = random.Random(8)
    base = [rng.randrange(10**9) for _ in range(40)]
    sets = {i: np.unique(np.array(base[: 40 - i] + [10**10 + i * 100 + k for k in range(i)], np.uint64)) for i in range(12)}
    near = {(a, b) for a in sets for b in sets if a < b and 100 * len(set(sets[a]) & set(sets[b])) >= 85 * len(set(sets[a]) | set(sets[b]))}
    want = {i: i for i in sets}
    for _ in sets:
        for a, b in near:
            want[a] = want[b] = min(want[a], want[b])
    members = spark.createDataFrame([(b, i) for b in range(4) for i in sets if i % 4 in (b, (b + 1) % 4)], "bucket long, id long")
    near = {(a, b) for a, b in near if {a % 4, (a - 1) % 4} & {b % 4, (b - 1) % 4}}
    want = {i: i for i in sets}
    for _ in sets:
        for a, b in near:
            want[a] = want[b] = min(want[a], want[b])
    bodies = spark.createDataFrame([(k, bytearray(s.tobytes())) for k, s in sets.items()], "id long, body binary")
    for stars in (0, 1, 2):
        found = {r.id: r.component for r in components.linked(members, lambda ids: bodies.join(ids, "id", "left_semi"), 85, stars=stars).collect()}
        assert {i: found.get(i, i) for i in sets} == want


def test_band_keys_are_dealt_out_without_python(spark):
    keys = spark.createDataFrame([(1, 5, "one line of words\nand another one\none line of words")], "id long, mark long, text string")
    signed = fuzzy_lines.signed_units(keys).cache()
    members = fuzzy_lines._band_members(signed)
    assert "Generate explode" in plan(members) and physical(members).count("MapIn") <= physical(signed).count("MapIn")
    found = Counter(r.id for r in members.collect())
    assert sorted(found.values()) == [fuzzy_lines.BANDS] * 2
    assert signed.where("kind = 0").count() == 3
    signed.unpersist()


def test_only_texts_that_are_cut_go_to_python(spark):
    rows = [(1, "a line that stands alone among the others"), (2, "a copied line of text\nsecond"), (3, "a copied line of text\nthird"), (4, None), (5, "a copied line of text\n \n")]
    cut = fuzzy_lines.dedup_texts(spark.createDataFrame(rows, "doc_id long, text string"))
    python = next(x for x in plan(cut).splitlines() if "ArrowEvalPython" in x)
    assert "CASE WHEN" in python and "isnotnull(pieces" in python
    # The text is dealt out within its row only.
    assert "coalesce(text" not in next(x for x in plan(cut).splitlines() if "Project" in x and "xxhash64" in x).split(" AS mark")[1]
    assert {r.doc_id: r.text for r in cut.collect()} == {1: rows[0][1], 2: rows[1][1], 3: "third", 4: None}


def test_near_stage_deals_texts_out_once_for_its_rows(spark):
    docs = spark.createDataFrame([(i % 4, f"text number {i % 4} has some words of its own {i % 4}", i) for i in range(12)], "doc_id long, text string, n int").repartition(3)
    one = near_dups.keep_one_row(docs)
    assert sum("Exchange hashpartitioning(id" in x for x in physical(one).splitlines()) <= 2
    assert "number" not in plan(one)
    assert sorted(r.doc_id for r in one.collect()) == [0, 1, 2, 3]


def test_distinct_values_and_shared_ones():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 50, 3000):
        a, b = (rng.integers(0, 2000, n).astype(np.uint64) << np.uint64(52) for _ in "ab")
        x, y = shingles.distinct(a), shingles.distinct(b)
        assert x.tolist() == sorted(set(a.tolist()))
        both = len(set(a.tolist()) & set(b.tolist()))
        assert shingles.jaccard_counts(x, y) == (both, len(x) + len(y) - both)


def test_candidates_of_large_and_small_blocks():
    rng = np.random.default_rng(9)
    for n in (1, 2, 70, 150):
        sigs = rng.integers(0, 2, (n, 75)).astype(np.uint8)
        names = rng.integers(0, 1 + n // 2, n).tolist()
        want = [(i, j) for i in range(n) for j in range(i + 1, n) if names[i] != names[j] and (sigs[i] == sigs[j]).sum() >= 40]
        assert list(zip(*(x.tolist() for x in components._candidates(names, [s.tobytes() for s in sigs], 40)))) == want


def test_distinct_words_of_some_texts_are_looked_up_once(monkeypatch):
    rng = random.Random(2)
    words = [f"{'Ab'[k % 2]}{k}x" for k in range(60)] + ["é!", "Éa", "??", "12-3"]
    texts = [" ".join(rng.choices(words[: 30 + i], k=rng.randrange(1, 80))) for i in range(34)] * 2
    model = quality.fit_rows(texts, [i % 2 for i in range(68)])
    monkeypatch.setattr(quality, "PIECE", 1000)
    odd = [None, "", " \n", *texts[:20], "unseen words that ??? are not in it É", texts[3]]
    x = model.inputs(odd)
    asked = Counter()
    shape = quality.shape
    monkeypatch.setattr(quality, "shape", lambda w: asked.update([w]) or shape(w))
    monkeypatch.setattr(quality, "PIECE", 10**6)
    assert np.array_equal(model.inputs(odd), x)
    assert set(asked.values()) == {1}
    for row, text in zip(x, odd):
        w = (text or "").split()
        if not w:
            assert not row.any()
            continue
        known = [model.words[v] for v in w if v in model.words]
        forms = [model.shapes[shape(v)] for v in w if shape(v) in model.shapes]
        assert np.allclose(row[: quality.DIM], model.vectors[known].sum(0) / max(1, len(known)))
        assert np.allclose(row[quality.DIM : 2 * quality.DIM], model.vectors[forms].sum(0) / len(w))
        assert np.allclose(row[2 * quality.DIM :], [np.log1p(len(w)), 1 - len(known) / len(w), len(set(w)) / len(w), 1 + (len(w) - len(forms)) / len(w)])


def test_walks_hash_as_by_hand():
    text = decontaminate._points("some text to walk over")
    walk = decontaminate.Embedding(6)
    found = walk.hashes(np.r_[text, np.zeros(7, np.uint8)], np.array([0, 5, 20]))
    for column, start in enumerate((0, 5, 20)):
        want, at = [0] * decontaminate.REPEATS, start
        for step in range(walk.last + 1):
            c = int(text[at]) if at < min(start + 6, len(text)) else 0
            for repeat, salt in walk.sampled[step]:
                want[repeat] = (want[repeat] + (c + 1) * int(salt)) % 2**64
            at += int(walk.moves[step][c])
        for repeat, x in enumerate(want):
            x ^= x >> 29
            x = x * 0xBF58476D1CE4E5B9 % 2**64
            assert int(found[repeat][column]) == x ^ (x >> 32)
