"""Packing, manifests and importance resampling against plain versions, and their odd tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_cases import empty, odd

from callweave.llm import importance, merkle, packing, queries, ranks

FOLDER = "/root/testdata/sf0.001"
public_tokenizers = pytest.importorskip("public_tokenizers")
FILE = public_tokenizers.path("byte_bpe_50k.json")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def by_id(row):
    return (row[0] is None, row[0] or 0, row[1:])


# ---------------------------------------------------------------- ranks


def test_ranks_number_every_group(spark):
    rows = [(k, v) for k in ("a", "b", None) for v in [3, 1, 2, 2, None] * 40]
    df = spark.createDataFrame(rows, "k string, v int").repartition(7).select(F.struct("k").alias("key"), "v")
    got = collections.defaultdict(list)
    for r in ranks.ranked(df, ["key"], [F.col("v").asc_nulls_first()]).collect():
        got[r.key.k].append((r.place, r.v, r.total))
    for k in ("a", "b", None):
        found = sorted(got[k])
        assert [p for p, _, _ in found] == list(range(200)) and {n for *_, n in found} == {200}
        assert [v for _, v, _ in found] == sorted((v for x, v in rows if x == k), key=lambda v: (v is not None, v or 0))


# ---------------------------------------------------------------- manifests


def plain_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: sha("".join(map(field, (r.doc_id, r.source, r.lang, r.n_chars, text))))

    def build(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
        return levels

    def proof(levels, i):
        for nodes in levels[:-1]:
            first = i // 16 * 16
            yield "".join(nodes[first:i]), "".join(nodes[i + 1 : first + 16])
            i //= 16

    groups = collections.defaultdict(list)
    for r in rows:
        groups[r.source].append((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for g in groups.values():
        g.sort(key=lambda x: x[:3])
    trees = {s: build([x[2] for x in groups[s]]) for s in order}
    top = build([trees[s][-1][0] for s in order])
    for k, s in enumerate(order):
        for i, (_, _, own, r) in enumerate(groups[s]):
            segments = [*proof(trees[s], i), *proof(top, k)]
            at = own
            if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0:
                at = leaf(r, None if r.text is None else lowered(r.text))
            for left, right in segments:
                at = sha(left + at + right)
            yield r.doc_id, own, trees[s][-1][0], top[-1][0], sha("".join(a + b for a, b in segments)), at, at == top[-1][0]


def manifest_of(spark, docs, path):
    docs.write.parquet(f"{path}/documents.parquet")
    return sorted((tuple(r) for r in merkle.op12_manifest(spark, str(path)).collect()), key=by_id)


def test_manifest_against_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    got = sorted((tuple(r) for r in queries.QUERIES["op12_manifest"](spark, FOLDER).collect()), key=by_id)
    assert got == sorted(plain_manifest(docs), key=by_id) and {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("sizes", [[1], [16], [17, 1, 256], [2] * 20, [300, 15]])
def test_manifest_shapes(spark, tmp_path, sizes):
    """One leaf, full runs, a last run of one, more than FAN groups, groups of different height."""
    rows = [(i, f"Text {i} of {k}", None, f"s{k}" if k else None, 3) for k, n in enumerate(sizes) for i in range(1000 * k, 1000 * k + n)]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").repartition(3)
    assert manifest_of(spark, docs, tmp_path) == sorted(plain_manifest(docs.collect()), key=by_id)


def test_manifest_of_odd_tables(spark, tmp_path):
    copies = odd(spark).where("doc_id = 6").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(40)))).drop("copy")
    repeated = odd(spark).unionByName(copies)
    assert manifest_of(spark, repeated, tmp_path / "odd") == sorted(plain_manifest(repeated.collect()), key=by_id)
    assert manifest_of(spark, empty(spark), tmp_path / "none") == []


def test_store_leads_from_the_root_to_every_leaf(spark):
    rows = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("leaf"))
    leaves = ranks.ranked(rows.select(F.struct("source").alias("key"), F.col("leaf").alias("digest"), "doc_id"), ["key"], [F.col("doc_id").asc()])
    grown = merkle.tree(leaves)
    children = {r.digest: r.children for r in merkle.store(grown).collect()}
    assert all(d == sha("".join(c)) for d, c in children.items())
    seen, front = [], [r.digest for r in grown.tops.collect()]
    while front:
        seen += [d for d in front if d not in children]
        front = [c for d in front if d in children for c in children[d]]
    assert seen == [r.leaf for r in rows.orderBy("doc_id").collect()]
    # A proof of some leaves only descends to those.
    root = grown.tops.select("key", "height", "digest", F.array().cast("array<struct<left:string,right:string>>").alias("segments"))
    some = merkle.descend(grown, root, leaves.where("doc_id in (0, 16, 99)").select("key", "place", "doc_id")).collect()
    assert {r.doc_id: r.digest for r in some} == {i: sha(str(i)) for i in (0, 16, 99)} and {len(r.segments) for r in some} == {2}


# ---------------------------------------------------------------- packing


def test_tokens_of_chunks_are_tokens_of_texts():
    """Chunks encoded once give what the tokeniser gives for whole texts, whatever white space stands between them."""
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(FILE)
    own.encode_special_tokens = True
    pick = random.Random(3)
    signs = ["a", "b c", "it's", " ", "  ", "\n", "\t", "\r\n", "\x1c", "\x85", " ", "　", "é中", "\U0001f600", ".", "12", "<|endoftext|>"]
    texts = ["".join(pick.choice(signs) for _ in range(pick.randint(0, 25))) for _ in range(3000)]
    encoder = packing.Encoder(FILE)
    for some in (texts, texts[:50]):
        found = [np.frombuffer(x, "<u4").tolist() for x in encoder.texts(some)]
        assert found == [e.ids for e in own.encode_batch(some, add_special_tokens=False)]


def test_forgotten_chunks_change_nothing(monkeypatch):
    texts = [f"word{i} and word{i * 7 % 50}\nnext line {i}" for i in range(200)]
    want = list(packing.Encoder(FILE).texts(texts))
    monkeypatch.setattr(packing, "MEMO", 5)
    monkeypatch.setattr(packing, "BATCH", 100)
    assert list(packing.Encoder(FILE).texts(texts)) == want


def check_packing(docs, rows):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(FILE)
    wanted = []
    for doc_id, text in docs:
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or min(len(ids), 1024)
        edges = [0, *range(first, len(ids) + 1, 1024)]
        wanted += [(doc_id, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for i, (a, b) in enumerate(zip(edges, edges[1:]))]
    assert sorted((tuple(r)[:5] for r in rows), key=by_id) == sorted(wanted, key=by_id)
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    return len(bins), sum(r.length for r in rows)


def test_packing_against_the_tokeniser(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    rows = queries.QUERIES["op11_packing"](spark, FOLDER).collect()
    n, tokens = check_packing(docs, rows)
    assert n <= 1.05 * math.ceil(tokens / 1024)


def test_packing_of_odd_tables(spark):
    docs = odd(spark).unionByName(odd(spark).limit(1).withColumn("text", F.lit("no spaces " + "x" * 30_000 + "\n" * 500 + "é" * 3000)))
    check_packing([(r.doc_id, r.text) for r in docs.collect()], packing.packed(docs.select("doc_id", "text"), FILE).collect())
    assert packing.packed(empty(spark).select("doc_id", "text"), FILE).count() == 0


def test_packing_over_several_packers(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARE", 40)
    docs = spark.range(300).select((F.col("id") % 100).alias("doc_id"), F.expr("repeat('word ', cast(id % 37 * 30 as int))").alias("text"))
    rows = packing.packed(docs, FILE, most=8)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, packing.packed(docs, FILE, most=8).collect()))
    assert len({r.sequence_id // packing.NUMBERS for r in rows.collect()}) > 1
    check_packing([(r.doc_id, r.text) for r in docs.collect()], rows.collect())


@pytest.mark.parametrize("most", [1, 2, 5, 1000])
def test_packer_is_bounded_best_fit(most):
    """The same bins as a plain list of open bins gives: least sufficient space, latest of equals; the fullest closes first."""
    pick = random.Random(most)
    lengths = [pick.choice([1, 3, 5, 8, 13, 20, 31]) for _ in range(2000)]
    packer, open_bins, made = packing.Packer(32, most), [], 0
    for length in lengths:
        fit = [b for b in open_bins if b[0] >= length]
        if fit:
            best = min(b[0] for b in fit)
            chosen = [b for b in fit if b[0] == best][-1]
            open_bins.remove(chosen)
        else:
            if len(open_bins) == most:
                least = min(b[0] for b in open_bins)
                open_bins.remove([b for b in open_bins if b[0] == least][-1])
            chosen, made = [32, made], made + 1
        assert packer.place(length) == (chosen[1], 32 - chosen[0])
        chosen[0] -= length
        if chosen[0]:
            open_bins.append(chosen)
        assert packer.open == len(open_bins) <= most


# ---------------------------------------------------------------- importance resampling


def plain_resampling(docs, bench, runs=1, buckets=10_000):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text or ""))
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, runs + 1) for i in range(len(words) - n + 1)]

    found = [(i, *features(t)) for i, t in docs]
    s = collections.Counter(b for *_, x in found for b in x)
    t = collections.Counter(b for x in bench for b in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    rows = []
    for i, n, x in found:
        weight = sum(gain[b] for b in x)
        h = int(sha(f"2024:{'' if i is None else i}")[:8], 16)
        rows.append((i, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    fit = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = {id(r): k + 1 for k, r in enumerate(fit[: 10 * len(fit) // 100])}
    return sorted([(*r[:4], drawn.get(id(r))) for r in rows], key=repr)


def texts_and_items(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    return docs, [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]


def test_resampling_against_brute_force(spark):
    got = queries.QUERIES["op13_importance"](spark, FOLDER).collect()
    assert sorted(map(tuple, got), key=repr) == plain_resampling(*texts_and_items(spark)) and any(r.rank for r in got)


@pytest.mark.parametrize("size", [0, 40, 100_000])
def test_any_dictionary_gives_the_same_runs(spark, size):
    """Runs of up to three words, whose CRCs are composed; words that the dictionary lacks stand in the gaps."""
    docs, bench = texts_and_items(spark)
    read = lambda name: spark.read.parquet(f"{FOLDER}/{name}.parquet")
    got = importance.resampled(read("documents"), read("benchmark"), runs=3, size=size).collect()
    assert sorted(map(tuple, got), key=repr) == plain_resampling(docs, bench, 3)


def test_composed_checksums():
    pick = random.Random(8)
    parts = [(pick.randbytes(pick.randint(0, 40)), pick.randbytes(pick.choice([0, 1, 2, 7, 300]))) for _ in range(200)]
    crc = lambda side: np.array([zlib.crc32(p[side]) for p in parts], np.uint32)
    got = importance.appended(crc(0), crc(1), np.array([len(b) for _, b in parts]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in parts]


@pytest.mark.parametrize("listed", [[], [b"b"], [b"a", b"cc", "é".encode()], [b"zz", b"bb"]])
def test_payloads_of_known_and_unknown_words(listed):
    known = importance.Dictionary(listed)
    for text in ("", None, " - ", "a", "B", "a b cc", "aa bb, CC-dd\n\x00é zz", "b b b", "_a_", "Éé 1a", "zz a zz bb"):
        words = importance.words(text)
        assert known.payloads(text).tolist() == [zlib.crc32(w) | len(w) << 32 for w in words]


def test_resampling_of_odd_tables(spark):
    docs, items = odd(spark), spark.createDataFrame([(1, "long1 word2 and other words"), (2, None)], "item_id long, text string")
    got = importance.resampled(docs, items, extra=("source", "row", "size")).collect()
    wanted = plain_resampling([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in items.collect()])
    assert sorted((tuple(r)[:5] for r in got), key=repr) == wanted and all(r.row == "r" for r in got)
    assert {r.weight for r in importance.resampled(docs.where("doc_id = 2"), items.limit(0)).collect()} == {0}
    assert importance.resampled(empty(spark), items).count() == 0
