"""Large buckets: what is dealt into blocks, against all pairs."""

import random

import numpy as np
import pytest

from callweave.llm import components, packing


def group(seed, n):
    """Sets around one base: a third of them near it, the others edited ever more."""
    rng = random.Random(seed)
    fresh = iter(range(10_000, 10_000_000))
    base = list(range(1, 141))
    out = []
    for i in range(n):
        edits = rng.randrange(0, 9) if i % 3 == 0 else rng.randrange(12, 100)
        s = list(base)
        for place in rng.sample(range(140), edits):
            s[place] = next(fresh)
        out.append(np.sort(np.array(s, np.uint64)))
    return out


def frames(spark, sets, names):
    rows = [(7, i, names[i]) for i in range(len(sets))]
    left = spark.createDataFrame(rows, "bucket long, id long, component long").repartition(3)
    bodies = spark.createDataFrame([(i, bytearray(s.tobytes()), s.nbytes) for i, s in enumerate(sets)], "id long, body binary, size int").repartition(3)
    return left, bodies


def links(sets, per_cent):
    width = max(int(s.max()) for s in sets) + 1
    held = np.zeros((len(sets), width), np.float32)
    for row, s in zip(held, sets):
        row[s.astype(np.int64)] = 1
    both = held @ held.T
    size = held.sum(axis=1)
    fine = 100 * both >= per_cent * (size[:, None] + size[None, :] - both)
    return {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(fine, 1)))}


def test_members_edited_too_much_are_not_dealt_into_blocks(spark):
    """A row for each member and block grew with the square of the bucket."""
    for n in (1200, 2400):
        sets = group(3, n)
        left, bodies = frames(spark, sets, list(range(n)))
        hopeful = components._hopeful(left, bodies, 85)
        kept = {r.id for r in hopeful.collect()}
        assert {x for pair in links(sets, 85) for x in pair} <= kept
        assert len(kept) <= 0.4 * n
        # All that are left but a few are one component: a row for each of them, and few more.
        names = {i: 0 if k % 20 else i for k, i in enumerate(sorted(kept))}
        one = [names.get(i, 0) for i in range(n)]
        dealt = components._blocks(frames(spark, sets, one)[0].where(components.F.col("id").isin(list(kept))), bodies.select("id", "size"))
        assert dealt.count() <= 1.25 * len(kept)


def test_blocks_bring_all_pairs_of_different_components_together(spark, monkeypatch):
    monkeypatch.setattr(components, "BLOCK_ROWS", 7)
    rng = random.Random(5)
    names = [rng.choice([0, 0, 0, i]) for i in range(90)]
    rows = [(1, i, names[i]) for i in range(90)] + [(2, i, names[i]) for i in range(5)] + [(3, i, 4) for i in range(5)]
    left = spark.createDataFrame(rows, "bucket long, id long, component long").repartition(3)
    sizes = spark.createDataFrame([(i, 8) for i in range(90)], "id long, size int")
    met, groups = set(), {}
    for r in components._blocks(left, sizes).collect():
        groups.setdefault((r.bucket, r.low, r.high), []).append(r.id)
    for ids in groups.values():
        met |= {(a, b) for a in ids for b in ids if a < b}
    assert {b for b, *_ in groups} == {1, 2}
    assert {(a, b) for a in range(90) for b in range(a + 1, 90) if names[a] != names[b]} <= met


def test_rest_finds_the_components_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(components, "BLOCK_ROWS", 50)
    sets = group(4, 400)
    left, bodies = frames(spark, sets, list(range(400)))
    found = {(r.a, r.b) for r in components._rest(left, bodies, 85, components.hash_sets, 0).collect()}

    def parts(pairs):
        up = list(range(400))
        for a, b in sorted(pairs):
            x, y = up[a], up[b]
            up = [x if u == y else u for u in up]
        return {frozenset(i for i in range(400) if up[i] == u) for u in up}

    assert found <= links(sets, 85)
    assert parts(found) == parts(links(sets, 85))


def test_letters_go_to_the_model_alone():
    """Runs of letters took the way of whole texts: cut by a regular expression, then joined again."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    encoder = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    seen = []
    whole = encoder._ids
    encoder._ids = lambda chunks: (seen.extend(chunks), whole(chunks))[1]
    rng = random.Random(6)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(1, 9)))
    plain = "x" + "".join(rng.choice(" \n") + word("abzÉéßȀɏ") + rng.choice(["", "", ",", ".\"", "-"]) for _ in range(3000))
    odd = ["".join(rng.choice(list("abÉ×÷ªºñЖ中'’́.,!?- \n\t\r 09A")) for _ in range(rng.randrange(60))) for _ in range(2000)]
    want = [np.array(e.ids, "<u4").tobytes() for e in encoder.tokenizer.encode_batch_fast([plain, *odd], add_special_tokens=False)]
    assert list(encoder.texts([plain])) == want[:1]
    assert sum(map(len, seen)) < 0.02 * len(plain)
    assert list(encoder.texts(odd)) == want[1:]


def test_shared_buckets_are_found_in_one_exchange(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(40), rng.randrange(30)) for _ in range(60)] + [(100, 1)] * 9 + [(101, i % 7) for i in range(50)] + [(-3, 5), (102, 2)]
    members = spark.createDataFrame(rows, "bucket long, id long").repartition(4)
    held = {}
    for bucket, i in rows:
        held.setdefault(bucket, set()).add(i)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")  # buckets go on from batch to batch
    try:
        found = [tuple(r) for r in components.shared_buckets(members).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(found) == sorted((bucket, i) for bucket, ids in held.items() if len(ids) > 1 for i in ids)


def test_only_members_with_a_near_signature_get_bodies(spark):
    rng = random.Random(6)
    sigs = [bytearray(rng.randrange(256) for _ in range(75)) for _ in range(30)]
    sigs[7] = sigs[3][:50] + sigs[7][50:]
    sigs[9] = sigs[4][:50] + sigs[9][50:]
    names = [*range(9), 4, *range(10, 30)]  # 9 is of the component of 4 already
    placed = spark.createDataFrame([(1, 0, 0, i, names[i]) for i in range(30)], "bucket long, low int, high int, id long, component long")
    bodies = spark.createDataFrame([(i, s) for i, s in enumerate(sigs)], "id long, sig binary")
    assert sorted(r.id for r in components._near_members(placed, bodies, 45).collect()) == [3, 7]


def test_bytes_are_shown_as_by_the_vocabulary():
    text = "".join(map(chr, [*range(0x250), 0x938, 0x20AC, 0x1F600])) + "a b\nc ­" * 3
    assert packing.shown_bytes(text) == text.encode().decode("latin-1").translate(packing.BYTES)
