"""Held-out accuracy of the language and quality classifiers, and their parts."""

from __future__ import annotations

import itertools
import math
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from tillroll.llm import langid, quality
from tillroll.llm.queries import op4_language_id, op6_quality

SF = "/root/testdata/sf0.01"


def test_language_of_held_out_documents(spark):
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = op4_language_id(spark, SF).join(truth, "doc_id").collect()
    assert len(rows) == truth.count()
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_rows(spark, docs_of):
    train = docs_of([(i, prose(i, 30), "en") for i in range(8)] + [(20 + i, "über straße größe mädchen schön " * 5, "de") for i in range(2)]
                    + [(40, "unlabelled"), (41, None, "fr"), (42, "", "fr")])
    model = langid.train(train)
    assert set(model.languages) == {"en", "de"}
    odd = docs_of([(1, None), (2, ""), (3, "123 !?"), (4, "schöne größe"), (None, "stone river"), (4, "schöne größe"), (5, "w" * 300_000)])
    rows = langid.predict(odd, model).collect()
    assert [r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 3)] == ["und"] * 3
    assert [(r["lang_pred"], r["lang"]) for r in rows if r["doc_id"] == 4] == [("de", "de")] * 2
    assert len(rows) == 7 and all(0 <= r["score"] <= 1 for r in rows)
    narrow = langid.predict(odd, model, margin=math.inf).where("lang <> 'und'").count()
    assert narrow == 0
    none = langid.train(train.where("false"))
    assert {r["lang_pred"] for r in langid.predict(odd, none).collect()} == {"und"}
    assert langid.predict(odd.where("false"), model).count() == 0


def test_quality_of_held_out_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = op6_quality(spark, SF).join(labels, "doc_id").where("held_out AND quality IS NOT NULL").collect()
    assert len(rows) > 50
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.93 * len(rows)


def test_chains_against_all_labellings():
    rng = np.random.default_rng(1)
    first = np.array([0, 3, 3, 4, 8])
    scores, trans = rng.normal(size=8), rng.normal(size=(2, 2))
    good, z, expected = quality.chains(scores, first, trans)
    seen = np.zeros((2, 2))
    for c in range(4):
        rows = range(first[c], first[c + 1])
        weights = {}
        for ys in itertools.product((0, 1), repeat=len(rows)):
            w = sum(scores[i] for i, y in zip(rows, ys, strict=True) if y) + sum(trans[a, b] for a, b in zip(ys, ys[1:], strict=False))
            weights[ys] = math.exp(w)
        total = sum(weights.values())
        if len(rows):
            assert math.isclose(z[c], math.log(total))
        for k, i in enumerate(rows):
            assert math.isclose(good[i], sum(w for ys, w in weights.items() if ys[k]) / total)
        for ys, w in weights.items():
            for a, b in zip(ys, ys[1:], strict=False):
                seen[a, b] += w / total
    assert np.allclose(seen, expected)


@pytest.mark.parametrize("block", [2, 3, 7, 64])
def test_long_texts_in_blocks(monkeypatch, block):
    """Blocks give what all lines at once give, whatever the odds and repeats."""
    rng = np.random.default_rng(block)
    model = quality.Model(rng.normal(size=3 * quality.N_OWN), 0.3, rng.normal(size=(2, 2)) * 2, (1.0, 0.0), 0.5)
    lines = [[b"", b"same line", b"A B 12 !!", b"x", "é".encode(), b"word " * 9][k] + b"z" * int(n)
             for k, n in zip(rng.integers(0, 6, 130), rng.integers(0, 3, 130), strict=True)]
    texts = [b"\n".join(lines[:n]) + end for n in (1, 2, 3, 4, 7, 8, 9, 65, 130) for end in (b"", b"\n")] + [b"", b"\n\n\n"]
    whole = model.raw(texts)
    monkeypatch.setattr(quality, "BLOCK_LINES", block)
    assert np.allclose(model.raw(texts), whole, atol=1e-12, equal_nan=True)
    odds = rng.normal(size=50) * 300
    good, _, _ = quality.chains(odds, np.array([0, 50]), model.trans)
    assert np.allclose(quality.chain_marginals(odds, model.trans), good, atol=1e-9)


def test_very_many_short_lines_stay_small():
    model = quality.Model(np.full(3 * quality.N_OWN, 0.1), -0.2, np.zeros((2, 2)), (1.0, 0.0), 0.5)
    tracemalloc.start()
    score = model.scores([b"a\n" * 200_000])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 0 <= score[0] <= 1 and peak < 40 << 20


def test_line_features():
    texts = [b"one two\nTHREE!! 4\n", b"", b"\n\n", b"no end", b"same\nsame\nsame"]
    x, length, first = quality.line_features(texts)
    assert first.tolist() == [0, 2, 2, 4, 5, 8] and length.tolist() == [7, 9, 0, 0, 6, 4, 4, 4]
    n = quality.N_OWN
    assert x[1, n:2 * n].tolist() == x[0, :n].tolist() and x[0, 2 * n:].tolist() == x[1, :n].tolist()
    assert not x[4, n:].any() and not x[2, n:2 * n].any()
    seen = quality.N_CLASSES + 3
    assert x[5:8, seen].tolist() == [0, 1, 1]
    alone = [quality.line_features([t])[0] for t in texts if t]
    assert np.array_equal(np.vstack(alone), x)


def test_quality_rows(spark, docs_of):
    good = [(i, "\n".join(prose(100 * i + j, 12).capitalize() + "." for j in range(4))) for i in range(40)]
    bad = [(100 + i, "\n".join("*** $$$ %% | " * 4 + prose(i, 2) for _ in range(4))) for i in range(40)]
    docs = docs_of(good + bad)
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 1) for i, _ in bad] + [(None, 1, 0), (7, None, 0), (8, 3, 0)],
                                   "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    rows = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert all(rows[i] >= 0.7 for i, _ in good) and all(rows[i] < 0.7 for i, _ in bad)
    odd = docs_of([(1, None), (2, ""), (3, "\n\n\n"), (None, good[0][1]), (4, "x" * 200_000), (4, "a\n" * 50_000), (5, "é"), (5, "é")])
    scored = quality.score(odd, model)
    assert scored.columns[:-1] == [c for c in odd.columns if c != "score"] and scored.columns[-1] == "score"
    got = scored.collect()
    assert len(got) == 8 and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in got if r["doc_id"] in (1, 2)} == {model.share}
    assert quality.score(odd.where("false"), model).count() == 0
    for kept in (labels.where("false"), labels.where("quality = 1")):
        one = quality.train(docs, kept)
        assert {r["score"] for r in quality.score(odd, one).collect()} == {1.0 if kept.count() else 0.5}


@pytest.mark.parametrize("rows", [1, 5])
def test_samples_are_bounded(docs_of, rows):
    docs = docs_of([(i, prose(i % 9, 40), "en" if i % 3 else "de") for i in range(60)])
    taken = langid.sample(docs, rows=rows, chars=50)
    assert taken.groupBy("lang").count().where(F.col("count") > rows).count() == 0
    assert taken.where(F.length("text") > 50).count() == 0
