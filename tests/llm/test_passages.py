"""Shared passages against a comparison of all windows (the query is compared with its SQL in test_sql.py)."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tests.llm.conftest import prose
from tillroll.llm import passages


def all_windows(rows, width):
    """(id, words, removed, kept text) by looking at every window of every text."""
    order = lambda i: (i is None, i or 0)
    first: dict[tuple, tuple] = {}
    texts = [(i, (t or "").split()) for i, t in rows]
    for i, w in texts:
        for j in range(len(w) - width + 1):
            key = tuple(w[j:j + width])
            first[key] = min(first.get(key, order(i)), order(i))
    out = []
    for i, w in texts:
        gone = set()
        for j in range(len(w) - width + 1):
            if first[tuple(w[j:j + width])] < order(i):
                gone.update(range(j, j + width))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def result(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], bytes(r["kept"]).decode()) for r in df.collect()), key=str)


def invented(seed, n_docs, width):
    """Texts that share whole texts, pieces, pieces of pieces, and edges."""
    rng = random.Random(seed)
    pool = [prose(seed * 100 + i, rng.randint(1, 5 * width)).split() for i in range(8)]
    rows = []
    for _ in range(n_docs):
        words = []
        for _ in range(rng.randint(1, 5)):
            p = rng.choice(pool)
            a = rng.randint(0, len(p)) if rng.random() < .5 else 0
            words += p[a:a + rng.randint(0, 3 * width)] if rng.random() < .7 else p
            if rng.random() < .4:
                words += prose(rng.randint(0, 10 ** 6), rng.randint(1, width)).split()
            if rng.random() < .2 and words:
                words[rng.randrange(len(words))] = "changed"
        rows.append((rng.choice([None, *range(n_docs)]) if rng.random() < .1 else rng.randrange(1000), rng.choice([" ", "\n", "\t "]).join(words)))
    return rows


@pytest.mark.parametrize("seed,width,gram", [(1, 50, 8), (2, 50, 8), (3, 12, 4), (4, 12, 4), (5, 5, 5), (6, 20, 1)])
def test_equals_all_windows(docs_of, seed, width, gram):
    rows = invented(seed, 60, width)
    got = result(passages.remove_passages(docs_of(rows), width=width, gram=gram))
    want = all_windows(rows, width)
    assert got == want
    assert sum(r[2] for r in want) > 0


def test_split_anchors(docs_of):
    """Small shards and an anchor dealt over many: the same words go."""
    line = prose(9, 30)
    rows = [(i, " ".join([prose(i % 40, 40), line, prose(1000 + i % 30, 40)])) for i in range(150)]
    want = all_windows(rows, 30 + 20)
    docs = docs_of(rows)
    small = passages.shared_passages(docs, shard_words=200, salted=3).select("key", "start", "stop", "first").distinct()
    whole = passages.shared_passages(docs).select("key", "start", "stop", "first").distinct()
    assert small.exceptAll(whole).isEmpty() and whole.exceptAll(small).isEmpty()
    assert result(passages.remove_passages(docs)) == want


def test_odd_input(docs_of):
    text = prose(1, 60)
    long = " ".join([prose(2, 3000), text, prose(3, 3000)])
    rows = [(1, None), (2, ""), (3, "a b"), (4, text), (4, text), (4, text + " more"), (None, text), (None, text), (5, text.replace(" ", "\u00a0")),
            (6, long), (7, " ".join(["same"] * 500)), (8, " ".join(["same"] * 60))]
    got = {(r[0], r[1], r[2]) for r in result(passages.remove_passages(docs_of(rows)))}
    assert got == {(1, 0, 0), (2, 0, 0), (3, 2, 0), (4, 60, 0), (4, 61, 0), (None, 60, 60), (5, 1, 0), (6, 6060, 60), (7, 500, 0), (8, 60, 60)}
    assert passages.remove_passages(docs_of([])).count() == 0
    with pytest.raises(ValueError):
        passages.shared_passages(docs_of([]), width=3)


def test_anchors_across_chunks(monkeypatch):
    """A text cut into chunks has the anchors of the whole one."""
    rng = np.random.default_rng(4)
    x = rng.integers(0, 30, 5000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def by_window():
        h, at, first, last = passages.stretches(x)
        return {j: (int(a), int(v)) for v, a, f, z in zip(h, at, first, last, strict=True) for j in range(f, z + 1)}
    want = by_window()
    monkeypatch.setattr(passages, "CHUNK", 700)
    assert by_window() == want and len(want) == 5000 - 49
