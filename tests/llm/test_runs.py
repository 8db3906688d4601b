"""Periodic runs against a comparison of all periods, and the query against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tillroll.llm import queries, runs


def all_periods(words, least=24):
    """Every stretch in which words q apart are equal, for each q."""
    found, n = {}, len(words)
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 3 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def invented(rng):
    kind = rng.randint(0, 4)
    if kind == 0:
        return [rng.randint(0, 50) for _ in range(rng.randint(0, 200))]
    if kind == 1:
        return [rng.randint(0, 1) for _ in range(rng.randint(0, 250))]
    out = []
    for _ in range(rng.randint(1, 6)):
        unit = [rng.randint(0, rng.choice([1, 2, 30])) for _ in range(rng.randint(1, 20))]
        out += (unit * rng.randint(1, 9))[:rng.randint(1, 150)]
        out += [rng.randint(0, 40) for _ in range(rng.choice([0, 1, 30]))]
        out += out[:rng.choice([0, 0, 60])]
    return out


@pytest.mark.parametrize("least", [12, 24, 30])
def test_equals_all_periods(least):
    rng, some = random.Random(least), 0
    for _ in range(150):
        texts = [invented(rng) for _ in range(rng.randint(1, 5))]
        ids = np.array([x for t in texts for x in t], np.int64)
        doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        want, at = [], 0
        for t in texts:
            want += [(s + at, n, q) for s, n, q in all_periods(t, least)]
            at += len(t)
        assert runs.find_runs(ids, doc, least) == sorted(want)
        some += len(want)
    assert some > 100


def test_fibonacci_and_long_texts():
    a, b = [0], [0, 1]
    while len(b) < 3000:
        a, b = b, b + a
    assert runs.find_runs(np.array(b), np.zeros(len(b), int)) == all_periods(b)
    n = 1_000_000
    assert runs.find_runs(np.zeros(n, np.int64), np.zeros(n, int)) == [(0, n, 1)]
    lines = np.array([w for i in range(60_000) for w in [*range(10), 20 + i]])
    assert runs.find_runs(lines, np.zeros(len(lines), int)) == []


def test_grammar_derives_the_text():
    rng = random.Random(2)
    ids = np.array([rng.randint(0, 3) for _ in range(500)])
    g = runs.Grammar(ids, np.array([0, 300]), np.array([300, 500]))
    assert (g.start < g.mid).all() and (g.mid < g.stop).all()
    for x, place in zip(g.symbols.tolist(), g.places.tolist(), strict=True):
        size = g.stop[x] - g.start[x]
        assert (ids[place:place + size] == ids[g.start[x]:g.stop[x]]).all()


def test_odd_input(docs_of):
    loop = " ".join(["a b\tc"] * 12)
    rows = [(1, None), (2, ""), (3, " \n\x0b "), (4, loop), (4, loop), (None, "x " * 30), (5, "x y " * 24), (6, "one two three")]
    got = sorted((r["doc_id"] or 0, r["n_words"], [tuple(x) for x in r["runs"]], bytes(r["collapsed"]).decode())
                 for r in runs.periodic_runs(docs_of(rows)).collect())
    found = (36, [(0, 36, 3)], "a b c")
    assert got == [(0, 30, [(0, 30, 1)], "x"), (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, *found), (4, *found),
                   (5, 24, [(0, 24, 1)], "x y"), (6, 3, [], "one two three")]
    assert runs.periodic_runs(docs_of([])).count() == 0
    with pytest.raises(ValueError):
        runs.periodic_runs(docs_of([]), min_length=25)


def test_query_against_plain_python(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r.asDict() for r in queries.op11_periodic_runs(spark, sf).collect()}
    assert len(got) == len(docs)
    planted = 0
    for doc_id, text in docs.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
            planted += 1
        found = all_periods(words)
        gone = {i for s, m, q in found for i in range(s + q, s + m)}
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
        assert got[doc_id] == {
            "doc_id": doc_id, "n_runs": len(found), "start": best[0], "length": best[1], "period": best[2],
            "exponent_milli": 1000 * best[1] // best[2] if found else None,
            "runs_sha256": hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest(),
            "collapsed_sha256": hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest()}
    assert planted > 5
