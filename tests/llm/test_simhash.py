"""SimHash clusters against all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from tillroll.llm import components, simhash
from tillroll.llm.components import connected_components


def slow_fingerprint(text, width=4):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    grams = [b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps: list[int], max_bits: int) -> list[int]:
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= max_bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def edited(text, rng):
    words = text.split()
    words[rng.randrange(len(words))] = "other"
    return " ".join(words)


def test_clusters_match_all_pairs(spark, docs_of):
    rng = random.Random(5)
    texts = [prose(i, rng.randrange(1, 120)) for i in range(150)]
    for i in range(0, 150, 5):
        texts += [edited(texts[i], rng) for _ in range(3)] + [texts[i]]
    texts += ["", None, "  \t\n", "A", "a", "one two", "one  TWO\x0b", "é È"]
    rng.shuffle(texts)
    docs = docs_of([(i + 10, t) for i, t in enumerate(texts)])
    got = {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in simhash.simhash_clusters(docs).collect()}
    fps = [slow_fingerprint(t) for t in texts]
    want = slow_components(fps, 4)
    assert got == {i + 10: (fps[i], want[i] + 10) for i in range(len(texts))}


@pytest.mark.parametrize("max_bits", [2, 4])
def test_long_lists_lose_no_link(spark, max_bits):
    """A ball of near fingerprints, with lists too long for one comparison."""
    rng = random.Random(max_bits)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for base in list(fps)[:3]:
        for _ in range(120):
            x = base
            for _ in range(rng.randrange(1, 6)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    table = spark.createDataFrame([(int(np.array(x, np.uint64).view(np.int64)),) for x in fps], "fp long")
    links = connected_components(simhash.fingerprint_links(table.repartition(3), max_bits, block=8))
    root = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in links.collect()}
    groups = {}
    for i, r in enumerate(slow_components(fps, max_bits)):
        groups.setdefault(r, set()).add(fps[i])
    got = {}
    for x in fps:
        got.setdefault(root.get(x, x), set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, got.values()))


@pytest.mark.parametrize("max_bits", [2, 4])
def test_cube_equals_pairs(max_bits):
    rng = np.random.default_rng(max_bits)
    mask = simhash._half_masks(simhash._byte_masks(max_bits)[3], max_bits)[1]
    free = [i for i in range(64) if not mask >> i & 1]
    base = int(rng.integers(1 << 62)) & mask
    values = np.array(sorted({base | sum(1 << f for f in free if rng.random() < 0.2) for _ in range(200)}), np.uint64)

    def classes(edges):
        sets = simhash.UnionFind()
        for a, b in edges:
            sets.union(a, b)
        return [sets.find(int(v)) for v in values]

    assert classes(simhash._cube(values, mask, max_bits)) == classes(simhash._pairs(values, max_bits, 8 - max_bits))


def test_tally_rejects_and_counts():
    rng = np.random.default_rng(9)
    x = rng.integers(0, 1 << 63, 500).astype(np.uint64)
    x[::3] &= np.uint64(0x00FF0000FF00FF80)
    want = [sum((int(v) >> 8 * p) & 0xFF == 0 for p in range(8)) for v in x]
    assert simhash._shared_bytes(x).tolist() == want
    # three shared bytes put a pair into one list, the tally of four lets it go
    a, b = 0x1122334455667788, 0x1122334400000000
    three = np.array([a, a ^ 0x0101010101000000], np.uint64)
    assert not simhash._pairs(three, 64, 4) and simhash._pairs(three, 64, 3)
    assert simhash._pairs(np.array([a, b], np.uint64), 64, 4) == [(a, b)]
    assert len(simhash._byte_masks(4)) == 35


@pytest.mark.parametrize("max_bits", [1, 3, 4])
def test_every_close_pair_meets(max_bits):
    rng, masks = random.Random(max_bits), simhash._byte_masks(max_bits)
    for _ in range(2000):
        x = y = rng.getrandbits(64)
        for bit in rng.sample(range(64), max_bits):
            y ^= 1 << bit
        assert any(x & m == y & m for m in masks)
        assert simhash._pairs(np.array([x, y], np.uint64), max_bits, 8 - max_bits)


def test_long_text_in_chunks(monkeypatch):
    text = prose(3, 2000).encode()
    whole = simhash.fingerprint(text, 4)
    monkeypatch.setattr(simhash, "CHUNK", 64)
    assert simhash.fingerprint(text, 4) == whole == slow_fingerprint(text.decode())


def test_odd_rows(spark, docs_of):
    docs = docs_of([(5, "same text here now"), (3, "same text here now"), (3, "same text here now"), (None, "same text here now"),
                    (None, "quite another text"), (9, ""), (8, None)])
    rows = simhash.simhash_clusters(docs).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in rows) == sorted(
        [("5", "3"), ("3", "3"), ("3", "3"), ("None", "3"), ("None", "None"), ("9", "8"), ("8", "8")])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "8", "None", "None"]
    other, third = prose(71, 40), prose(72, 40)
    shared = docs_of([(1, text := prose(70, 40)), (1, other), (1, other), (2, third), (3, text), (3, other), (4, third)])
    kept = sorted((r["doc_id"], r["text"]) for r in simhash.keep_one(shared).collect())
    assert kept == sorted([(1, text), (1, other), (2, third)])
    empty = docs.where("false")
    assert simhash.simhash_clusters(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (7, 7), (9, 8), (3, 40), (40, 41)], "a long, b long")
    got = sorted((r["node"], r["root"]) for r in connected_components(edges).collect())
    assert got == [(1, 1), (2, 1), (3, 1), (8, 8), (9, 8), (40, 1), (41, 1)]
    chain = spark.range(0, 60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).repartition(5)
    assert {r["root"] for r in connected_components(chain).collect()} == {0}
    assert connected_components(edges.where("false")).count() == 0


def test_components_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(components, "FOREST_NODES", 4)
    edges = [pa.RecordBatch.from_arrays([pa.array([i, i + 1]), pa.array([i + 1, i + 2])], names=["a", "b"]) for i in range(0, 40, 2)]
    stars = [tuple(r.values()) for b in components._forest(iter(edges)) for r in b.to_pylist()]
    sets = components.UnionFind()
    for a, b in stars:
        sets.union(a, b)
    assert {sets.find(i) for i in range(41)} == {0}
