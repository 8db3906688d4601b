"""Leaks against edit distances to every place."""

from __future__ import annotations

import functools
import random

import pytest

from tests.llm.conftest import prose
from tillroll.llm import decontam


def best_place(item: bytes, text: bytes) -> int:
    """Fewest edits between the item and any piece of the text."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        above, row[0] = row[0], 0
        for i, p in enumerate(item, 1):
            above, row[i] = row[i], min(above + (p != c), row[i] + 1, row[i - 1] + 1)
        best = min(best, row[-1])
    return best


def edited(text, n, rng):
    t = list(text)
    for _ in range(n):
        i = rng.randrange(len(t))
        kind = rng.randrange(3)
        if kind == 0:
            t[i] = rng.choice("xyzq")
        elif kind == 1:
            t.insert(i, rng.choice("xyzq"))
        else:
            del t[i]
    return "".join(t)


def corpus():
    rng = random.Random(11)
    items = [prose(500 + i, rng.randrange(6, 30)) for i in range(12)] + ["Short one, here!", "tiny", "", None, prose(500, 20)]
    rows = []
    for i in range(36):
        body = prose(i, rng.randrange(0, 60))
        if i % 2:
            item = items[rng.randrange(12)]
            body = f"{body}\n{edited(item, rng.randrange(0, len(item) // 7), rng).upper()} {prose(900 + i, rng.randrange(0, 30))}"
        rows.append((i, body))
    rows += [(90, None), (91, ""), (92, "a tiny word"), (93, "destiny"), (94, "short   ONE -- here"), (None, items[2]), (95, items[3]), (95, items[3])]
    return items, rows


@functools.cache
def _expected():
    return expected(*corpus())


def expected(items, rows):
    out = set()
    for d, t in rows:
        text = decontam.folded(t)
        for i, item in enumerate(items):
            x = decontam.folded(item)
            if not x:
                continue
            if len(x) < 8:
                if b" " + x + b" " in b" " + text + b" ":
                    out.add((d, i, 0))
                continue
            k = max(0, min(len(x) // 10, len(x) // 8 - 1))
            e = best_place(x, text)
            if e <= k:
                out.add((d, i, e))
    return out


@pytest.mark.parametrize("block", [1 << 20, 600])
def test_screen_finds_every_leak(block, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK", block)
    items, rows = corpus()
    kept = [(i, decontam.folded(x)) for i, x in enumerate(items) if x]
    screen = decontam.Screen([x for _, x in kept])
    found = screen.matches([decontam.folded(t) for _, t in rows])
    got = {(d, kept[i][0], e) for (d, _), m in zip(rows, found, strict=True) for i, (e, _) in m.items()}
    assert got == _expected()


def test_leaks_and_filter(spark, docs_of, monkeypatch):
    items, rows = corpus()
    docs = docs_of(rows).repartition(3)
    bench = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)], "item_id long, text string, doc_id string")
    want = _expected()
    got = decontam.find_leaks(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"], r["edits"]) for r in got} == want
    leaked = {d for d, _, _ in want}
    kept = decontam.without_leaks(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(d) for d, _ in rows if d not in leaked)
    monkeypatch.setattr(decontam, "SLICE_BYTES", 300)  # several passes
    assert {(r["doc_id"], r["item_id"], r["edits"]) for r in decontam.find_leaks(docs, bench).collect()} == want
    assert decontam.without_leaks(docs, bench).count() == kept.count()
    assert decontam.without_leaks(docs, bench.where("false")).count() == len(rows)
    assert decontam.find_leaks(docs, bench.where("false")).count() == 0
    assert decontam.find_leaks(docs.where("false"), bench).count() == 0


def test_alignment():
    rng = random.Random(2)
    for _ in range(100):
        item = prose(rng.randrange(10 ** 6), 3).encode()
        text = (prose(rng.randrange(10 ** 6), 1) + edited(item.decode(), rng.randrange(4), rng)).encode()
        assert decontam.align(item, text, len(text))[0] == best_place(item, text)


def test_fixture_passages_are_found(spark):
    sf = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [(r["item_id"], " ".join(r["text"].split())) for r in bench.collect()]
    plain = {(r["doc_id"], i) for r in docs.collect() for i, t in items if t in " ".join((r["text"] or "").split())}
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(docs, bench).collect()}
    assert plain <= got and len(plain) > 10


@pytest.mark.parametrize("shared", [2000])
def test_pairs_in_parts(monkeypatch, shared):
    """Counting in parts finds what counting at once finds, also beside repetition."""
    items, rows = corpus()
    items = [decontam.folded(i) for i in items if i] + [b"a" * 120, b"ab" * 40, b"one line again " * 6, b"a" * 60 + b"b" * 30 + b"a" * 60]
    rng = random.Random(shared)
    texts = [decontam.folded(t) for _, t in rows]
    texts += [b"a" * 300, b"x" + b"ab" * 200, b"one line again " * 40, b"a" * 130 + b"b" * 29 + b"a" * 90, b"a" * 80]
    texts += [t[:100] + b"a" * 200 + t[100:] + b" " + rng.choice(items) for t in texts[:8]]
    whole = decontam.Screen(items).matches(texts)
    assert sum(map(len, whole)) > 20
    monkeypatch.setattr(decontam, "SHARED", shared)
    assert decontam.Screen(items).matches(texts) == whole


def test_repetitive_long_text():
    """A long text of one line against an item of the same line, and one that nearly is."""
    line = b"the same line again and again "
    screen = decontam.Screen([line * 10, b"other words " * 9, (line * 4)[:-1] + b"but not this end of it"])
    long = line * 8_000
    found = screen.matches([long, b"clean text " * 30, b"x" * 400_000])
    assert found[0][0][0] == 0 and set(found[0]) == {0} and found[1:] == [{}, {}]
