"""Results of the training-data operators against SQL, brute force and held-out rows."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from harness import compare, duck
from pyspark.sql import functions as F

from callweave.llm import components, decontaminate, fingerprints, language, near_dups, quality, queries, shingles, suffixes

FOLDER = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    assert compare(spark, duck(FOLDER), name, queries.QUERIES[name], queries.ORACLES[name], FOLDER) == ""


def texts_of(spark, folder=FOLDER):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}


def test_quality_on_held_out_rows(spark):
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    rows = queries.QUERIES["op2_quality"](spark, LARGER).join(labels, "doc_id").where("held_out").collect()
    for value in (0, 1):
        own = [r.predicted == value for r in rows if r.quality == value]
        assert len(own) > 5 and sum(own) / len(own) > 0.9


def test_quality_reads_no_held_out_label(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    from callweave.llm.common import crc_mod

    train = crc_mod(F.col("doc_id"), 3) != 1
    flipped = labels.withColumn("quality", F.when(train, F.col("quality")).otherwise(1 - F.col("quality")))
    a, b = (quality.fit(docs, x, train=train) for x in (labels, flipped))
    assert np.array_equal(a.layers[0], b.layers[0]) and a.temperature == b.temperature


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "lang")
    rows = queries.QUERIES["op3_language"](spark, LARGER).join(docs, "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_backs_off_to_grams():
    model = language.fit_rows([("en", "the thing that thinks " * 3), ("de", "der die das dass " * 3)])
    assert model.predict("Thinking", {})[0] == "en" and model.predict("dasselbe", {})[0] == "de"
    assert model.predict("123 --", {}) == ("und", 0.0) and model.predict(None, {}) == ("und", 0.0)


def plain_distance(pattern, text):
    """Least edit distance to a substring, by the table."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern):
            new.append(min(row[i] + (p != c), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_edit_distance_to_substrings():
    rng = random.Random(1)
    for _ in range(200):
        p = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 90)))
        t = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 120)))
        assert decontaminate.best_substring(p, t)[0] == plain_distance(p, t)


def edited(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = rng.choice("xyz")
        elif kind == 1:
            out.insert(at, rng.choice("xyz"))
        else:
            del out[at]
    return "".join(out)


def test_leaks_against_brute_force(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{LARGER}/benchmark.parquet").collect()]
    finder = decontaminate.Finder(items)
    docs = [t or "" for t in texts_of(spark).values()]
    rng = random.Random(2)
    planted, want = [], []
    for n, (key, text) in enumerate(items * 3):
        host = docs[n % len(docs)][:2000]
        at = rng.randint(0, len(host))
        planted.append(host[:at] + " " + edited(rng, text, int(len(text) * 0.05) * (n >= len(items))) + " " + host[at:])
        want.append(key)
    found = [{m["item_id"]: m for m in ms} for ms in finder.find(planted)]
    assert all(k in f for k, f in zip(want[: len(items)], found))  # exact passages
    assert sum(k in f for k, f in zip(want, found)) / len(want) >= 0.95
    for text, ms in list(zip(planted, found))[::17]:
        for key, m in ms.items():
            pattern, low = decontaminate.normal(dict(items)[key]), decontaminate.normal(text)
            assert m["distance"] == plain_distance(pattern, low)
            assert abs(len(pattern) - (m["end"] - m["start"])) <= m["distance"]
    # Documents without a passage: whatever is found is true.
    for text, ms in zip(docs[:60], finder.find(docs[:60])):
        for m in ms:
            assert plain_distance(decontaminate.normal(dict(items)[m["item_id"]]), decontaminate.normal(text)) == m["distance"]


def test_blocks_of_items_are_all_used(spark):
    items = spark.createDataFrame([(i, f"benchmark passage number {i} {'abcdefgh'[i]} about thing {i * 7919}") for i in range(8)], "item_id long, text string")
    found = decontaminate.finders(items, block=3)
    assert [len(f.items) for f in found] == [3, 3, 2]
    docs = items.select(F.col("item_id").alias("doc_id"), F.concat(F.lit("so "), "text", F.lit(" it")).alias("text"))
    rows = docs.select("doc_id", decontaminate.matches(found, F.col("text")).alias("m")).collect()
    assert all(r.doc_id in [m.item_id for m in r.m] for r in rows)


def test_repeated_strings_against_brute_force(spark):
    assert {(a - b) % suffixes.MODULUS for a in suffixes.COVER for b in suffixes.COVER} == set(range(suffixes.MODULUS))
    docs = {k: (t or "").encode() for k, t in texts_of(spark).items()}
    counts = collections.Counter(r[i : i + 200] for r in docs.values() for i in range(len(r) - 199))
    for row in queries.QUERIES["op6_suffixes"](spark, FOLDER).collect():
        r = docs[row.doc_id]
        gone = bytearray(len(r))
        for i in range(len(r) - 199):
            if counts[r[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(b for b, g in zip(r, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        assert (row.n_bytes, row.n_removed, row.n_spans, row.kept_sha256) == (len(r), sum(gone), runs, hashlib.sha256(kept).hexdigest())


def test_repeats_at_every_offset(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    passage, almost = word(260), word(199)
    rows = [(i, word(rng.randint(0, 300)) + passage[rng.randint(0, 30) : 260 - rng.randint(0, 30)] + word(rng.randint(0, 300))) for i in range(12)]
    rows += [(i, word(40 + i) + almost + word(30)) for i in range(20, 25)] + [(30, "ab" * 150), (31, "x" * 500)]
    docs = {k: t.encode() for k, t in rows}
    counts = collections.Counter(r[i : i + 200] for r in docs.values() for i in range(len(r) - 199))
    # Several batches and several parts of the range of names.
    monkeypatch.setattr(suffixes, "PLACES", 900)
    monkeypatch.setattr(suffixes, "PART_BYTES", 1500)
    out = suffixes.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    for r in out:
        raw = docs[r.row.doc_id]
        gone = {j for i in range(len(raw) - 199) if counts[raw[i : i + 200]] > 1 for j in range(i, i + 200)}
        assert r.result.n_removed == len(gone) and bytes(r.result.kept) == bytes(b for i, b in enumerate(raw) if i not in gone)


def bag(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    return collections.Counter(zip(words, [*words[1:], None]))


def alike(a, b):
    return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0


def test_fingerprints_against_brute_force(spark):
    docs = {k: t or "" for k, t in texts_of(spark).items()}
    order = sorted(docs, reverse=True)
    after = dict(zip(order, [*order[1:], order[0]]))
    rows = queries.QUERIES["op8_fingerprints"](spark, FOLDER).collect()
    assert len(rows) == len(docs)
    errors, same = [], {}
    for r in rows:
        text, other = docs[r.doc_id], docs[after[r.doc_id]]
        half = len(text) // 2
        new = text[: len(text) - half] + other[:half]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        errors += [r.near_edited - alike(bag(text), bag(new)), r.near_next - alike(bag(text), bag(other))]
        assert same.setdefault(text, r.fingerprint) == r.fingerprint
    assert abs(np.mean(errors)) < 0.03 and np.sqrt(np.mean(np.square(errors))) < 0.5 / fingerprints.SAMPLES**0.5


def test_collision_rate_is_generalised_jaccard(spark):
    """With 128 samples the likeness of weighted bags is near its expectation."""
    words = [f"w{i}" for i in range(60)]
    a = [w for i, w in enumerate(words[:45]) for _ in range(1 + i % 5)]
    b = [w for i, w in enumerate(words) if i > 14 for _ in range(1 + i % 3)]
    bags = [collections.Counter(x) for x in (a, b)]
    rows = [(i, fingerprints_term(w), n) for i, x in enumerate(bags) for w, n in x.items()]
    found = {r.k: r.samples for r in fingerprints.samples(spark.createDataFrame(rows, "k long, term long, times long"), ["k"], 128).collect()}
    share = np.mean([x == y for x, y in zip(found[0], found[1])])
    assert abs(share - alike(*bags)) < 0.13


def fingerprints_term(word):
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=7).digest(), "big")


def test_shingle_sets_follow_the_definition():
    texts = ["A b\tc\nd  E f", "a B c D e F", "one two", "ONE   two", "", None, " \n", "ä ö ü a b c"]
    sets = shingles.shingle_sets(texts)
    assert [len(s) for s in sets] == [2, 2, 1, 1, 0, 0, 0, 2]
    assert np.array_equal(sets[0], sets[1]) and np.array_equal(sets[2], sets[3])


def union_find(pairs):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {x: root(x) for x in list(up)}


def test_components_against_union_find(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(90)] + [(2000, 2001 + i) for i in range(50)]
    pairs = [(min(p), max(p)) for p in pairs if p[0] != p[1]]
    found = components.components(spark.createDataFrame(pairs, "a long, b long").repartition(7))
    assert {r.id: r.component for r in found.collect()} == union_find(pairs)


@pytest.mark.parametrize("block", [400, 7])
def test_near_dups_in_chains_and_large_groups(spark, monkeypatch, block):
    """A hub with many near copies, a chain whose ends are far apart, and exact copies; in one block of members or many."""
    monkeypatch.setattr(components, "BLOCK_ROWS", block)
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(rng.randrange(5)):
            words[rng.randrange(300)] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    chain = [f"c{rng.randrange(5000)}" for _ in range(200)]
    for i in range(200, 212):
        rows.append((i, " ".join(chain)))
        at = 10 + 15 * (i - 200)
        chain = [*chain[:at], f"x{i}", *chain[at + 1 :], f"y{i}"]
    rows += [(300 + i, "the very same short text here") for i in range(40)] + [(400, "word"), (401, "WORD "), (402, "two words")]
    sets = dict(zip((k for k, _ in rows), shingles.shingle_sets([t for _, t in rows])))
    pairs = []
    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both, either = shingles.jaccard_counts(sets[a], sets[b])
            if 100 * both >= 85 * either:
                pairs.append((a, b))
    want = {**{k: k for k in keys}, **union_find(pairs)}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: r.first_id for r in near_dups.groups(near_dups.keyed(docs)).collect()}
    assert got == want


def test_pigeonhole_keys_cover_the_distance():
    """Any signatures within DISTANCE share a key, whichever symbols differ."""
    rng = np.random.default_rng(6)
    assert 2 * near_dups.CHUNKS > near_dups.DISTANCE and sorted(np.concatenate(near_dups.CUTS)) == list(range(near_dups.SYMBOLS))
    for _ in range(300):
        differ = np.zeros(near_dups.SYMBOLS, bool)
        differ[rng.choice(near_dups.SYMBOLS, near_dups.DISTANCE, replace=False)] = True
        assert min(differ[c].sum() for c in near_dups.CUTS) <= 1


@pytest.mark.parametrize("length", [10, 20, 36, 45, 72, 90, 120, 150, 250])
def test_short_items_at_the_full_share_of_edits(length):
    """Items of every length, with one edit in ten characters, in the middle of a text."""
    rng = random.Random(length)
    prose = lambda n: "".join(rng.choice("abcdefghijklmnopqrst") if rng.random() > 0.16 else " " for _ in range(n)).strip().ljust(n, "q")
    items = [(i, prose(length)) for i in range(60)]
    docs = [f"{prose(300)} {edited(rng, text, length // 10)} {prose(300)}" for _, text in items]
    for i, found in enumerate(decontaminate.Finder(items).find(docs)):
        assert i in [m["item_id"] for m in found]


@pytest.mark.parametrize("length", [8, 20, 60, 200])
def test_items_in_texts_without_spaces(length):
    """Exact and edited passages in the middle of a text that has no space."""
    rng = random.Random(length)
    run = lambda n: "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(n))
    items = [(i, run(length)) for i in range(40)]
    finder = decontaminate.Finder(items)
    for edits in (0, length // 10):
        docs = [run(301) + edited(rng, text, edits) + run(300) for _, text in items]
        for i, found in enumerate(finder.find(docs)):
            assert i in [m["item_id"] for m in found]


def test_leaks_go_from_documents_without_spaces(spark):
    text = "一二三四五六七八九十百千万億兆京垓天地玄黄宇宙洪荒日月盈昃辰宿列張"
    items = spark.createDataFrame([(1, text)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "寒来暑往秋収冬蔵" * 20 + text + "閏余成歳律呂調陽" * 20), (2, "寒来暑往秋収冬蔵" * 40)], "doc_id long, text string")
    assert [r.doc_id for r in decontaminate.remove_leaks(docs, items).collect()] == [2]


def test_likeness_of_single_pairs(spark):
    """Pairs that are neither far apart nor alike, where the error is greatest."""
    docs = texts_of(spark)
    errors = []
    for r in queries.QUERIES["op8_fingerprints"](spark, FOLDER).collect():
        text = docs[r.doc_id] or ""
        half = len(text) // 2
        other = docs[max((k for k in docs if k < r.doc_id), default=max(docs))] or ""
        true = alike(bag(text), bag(text[: len(text) - half] + other[:half]))
        if 0.2 < true < 0.9:
            errors.append(r.near_edited - true)
    assert len(errors) > 50 and np.sqrt(np.mean(np.square(errors))) < 0.08
