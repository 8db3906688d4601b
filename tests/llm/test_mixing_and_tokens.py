"""Mixes against their definition; shards against a plain encoder."""

from __future__ import annotations

import math
from array import array
from collections import Counter, defaultdict

import numpy as np
import pytest
import tiktoken

from tests.llm.conftest import prose
from tillroll.llm import mixing, tokens


def sources(n_hot=200, others=6):
    rows = [(i, prose(i, 20), None, "hot") for i in range(n_hot)]
    rows += [(1000 * s + i, prose(1000 * s + i, 15), None, f"s{s}") for s in range(1, others) for i in range(4 * s)]
    rows += [(9000 + i, prose(9000 + i, 10), None, None) for i in range(5)]
    return rows + [(9100, None, None, "hot"), (9101, "", None, ""), (9102, "w", None, ""), (None, "two words", None, "s1"), (9000, prose(9000, 10), None, None)]


def n_tokens(t):
    return max(1, len((t or "").split()))


def by_source(rows):
    out = Counter()
    for _, t, _, s in rows:
        out[s] += n_tokens(t)
    return out


@pytest.mark.parametrize("limit", [1.0, 1.5, 3.0])
def test_cover_passes_every_document_within_the_limit(docs_of, limit):
    rows = sources()
    docs = docs_of(rows).repartition(4)
    got = mixing.mix(docs, max_repeats=limit)
    assert set(docs.columns) < set(got.columns)
    out = got.collect()
    whole = by_source(rows)
    used = by_source([(r["doc_id"], r["text"], None, r["source"]) for r in out])
    seen = Counter((r["doc_id"], r["text"]) for r in out)
    assert set(seen) == {(i, t) for i, t, _, _ in rows}  # nothing is lost
    total, top = sum(whole.values()), max(whole.values())
    # the exponent by plain bisection
    lo, hi = 0.0, 1.0
    for _ in range(80):
        a = (lo + hi) / 2
        ok = max((top / t) ** (1 - a) for t in whole.values()) <= limit
        lo, hi = (lo, a) if ok else (a, hi)
    for s, t in whole.items():
        quota = t * (top / t) ** (1 - hi)
        longest = max(n_tokens(x) for _, x, _, y in rows if y == s)
        assert quota - 1 <= used[s] <= quota + longest + 1
    assert total <= sum(used.values())
    epochs = defaultdict(set)
    for r in out:
        epochs[r["source"]].add(r["epoch"])
    for s, e in epochs.items():
        assert e == set(range(len(e)))


def test_budget_cuts_a_permutation(docs_of, spark):
    rows = sources()
    whole = by_source(rows)
    budget = sum(whole.values()) // 2
    out = mixing.mix(docs_of(rows), budget=budget, max_repeats=None, target_entropy=0.9).collect()
    used = by_source([(r["doc_id"], r["text"], None, r["source"]) for r in out])
    table = spark.createDataFrame([(str(s), t) for s, t in whole.items()], "__source string, tokens long")
    found = mixing.solve(table, budget, None, 0.9)
    weights = {s: (t / sum(whole.values())) ** found.exponent for s, t in whole.items()}
    z = sum(weights.values())
    entropy = -sum(w / z * math.log(w / z) for w in weights.values())
    assert math.isclose(entropy, 0.9 * math.log(len(whole)), rel_tol=1e-6)
    for s in whole:
        assert weights[s] / z * budget - 1 <= used[s] <= weights[s] / z * budget + 22
    # within the last permutation the rows taken are a beginning of it
    last = [r for r in out if r["source"] == "hot"]
    assert len({r["place"] for r in last}) == len(last)


def test_mix_of_nothing_and_of_one(docs_of):
    docs = docs_of([(1, "a b", None, "x"), (2, "c", None, "x")])
    assert mixing.mix(docs.where("false")).count() == 0
    assert sorted(r["doc_id"] for r in mixing.mix(docs).collect()) == [1, 2]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 5000])
def test_feistel_is_a_permutation(n):
    slots = tokens.feistel(np.arange(n), n)
    assert sorted(slots.tolist()) == list(range(n))
    if n >= 64:
        assert slots.tolist() != list(range(n))
        assert tokens.feistel(np.arange(n), n, key=1).tolist() != slots.tolist()


@pytest.fixture(scope="module")
def ranks():
    return tokens.vocabulary()


def test_words_are_encoded_as_the_whole_text(ranks):
    e = tokens.Encoder(ranks)
    texts = ["", " ", "a", " a", "a ", "a b", "a  b", "a   b", "a \n b", "a\n b", "a\nb c\n", "don't we'll  it's", "x  y", "x  y",
             "12 34ab !!? ...", "é è  ü", "<|endoftext|> x", "tab\t tab \t", "\n\n a", "a \r\n b", prose(1, 300), "😀 😀  😀", "  a  b"]
    assert [e.encode(t) for t in texts] == [e.whole(t) for t in texts]


def test_shards_hold_every_token_once(spark, docs_of, ranks, tmp_path):
    rows = [(i, prose(i, 3 + 7 * i % 90)) for i in range(70)] + [(80, None), (81, ""), (None, "no id"), (82, "é\n\n x"), (82, "é\n\n x"), (83, prose(5, 3000))]
    docs = docs_of(rows).repartition(3)
    out = tokens.materialise(docs, str(tmp_path / "s"), seq_len=16, shard_seqs=20).collect()
    assert sorted(r["slot"] for r in out) == list(range(len(out)))
    merges = tokens.Encoder(ranks).encoding
    assert isinstance(merges, tiktoken.Encoding)
    want = Counter()
    for _, t in rows:
        want.update([*merges.encode_ordinary(t or ""), tokens.END])
    got, padding = Counter(), 0
    for r in out:
        assert r["shard"] == r["slot"] // 20 and r["offset"] == r["slot"] % 20 * 32 and r["length"] == 32
        ids = tokens.read_shard(r["path"], r["offset"], 1, 16)[0].tolist()
        got.update(ids[:r["n_tokens"]])
        assert all(x == tokens.END for x in ids[r["n_tokens"]:])
        padding += 16 - r["n_tokens"]
    assert got == want and padding < 3 * 16
    assert {d for r in out for d in r["doc_ids"]} == {d for d, _ in rows}
    # one file a shard, read in order from any slot
    by_shard = defaultdict(set)
    for r in out:
        by_shard[r["shard"]].add(r["path"])
    assert all(len(p) == 1 for p in by_shard.values())
    first = min(by_shard[0])
    assert np.array_equal(tokens.read_shard(first, 0, 20, 16)[5:], tokens.read_shard(first, 5 * 32, 15, 16))
    # a document's tokens, in the packed order, through its sequences
    ids = {r["slot"]: r["doc_ids"] for r in out}
    assert sum(83 in x for x in ids.values()) > 100


@pytest.mark.parametrize("write_tasks", [1, 3])
def test_few_tasks_write_the_same_shards(docs_of, ranks, tmp_path, write_tasks):
    docs = docs_of([(i, prose(i, 3 + 7 * i % 90)) for i in range(70)]).repartition(3, "doc_id")

    def shards(name, **tasks):
        rows = tokens.materialise(docs, str(tmp_path / name), seq_len=16, shard_seqs=20, **tasks).collect()
        return {p[1]: open(p[0], "rb").read() for p in {(r["path"], r["shard"]) for r in rows}}

    many, few = shards("many"), shards("few", write_tasks=write_tasks)
    assert len(many) > 5 and many == few


def test_no_documents_no_shards(docs_of):
    assert tokens.materialise(docs_of([(1, "x")]).where("false")).count() == 0


def test_targets_that_no_mix_meets_are_errors(spark):
    sources = spark.createDataFrame([(1000,), (10,), (1,)], "tokens long")
    with pytest.raises(ValueError, match="repeats"):
        mixing.solve(sources, budget=10_000, max_repeats=2)         # 9.9 times at the least
    with pytest.raises(ValueError, match="entropy"):
        mixing.solve(sources, max_repeats=1.2, target_entropy=0.9)  # one needs a large exponent, the other a small one
    with pytest.raises(ValueError):
        mixing.solve(sources, max_repeats=None, target_entropy=1.5)
    # both can be met: within both, at the end that entropy sets
    met = mixing.solve(sources, max_repeats=60.0, target_entropy=0.5)
    p = [1000 / 1011, 10 / 1011, 1 / 1011]
    w = [x ** met.exponent for x in p]
    entropy = -sum(x / sum(w) * math.log(x / sum(w)) for x in w)
    assert entropy == pytest.approx(0.5 * math.log(3), abs=1e-6)
    assert max(x ** (met.exponent - 1) for x in p) / p[0] ** (met.exponent - 1) <= 60
    assert mixing.solve(sources, budget=1000, max_repeats=2).exponent < 1


def test_long_texts_are_cut_between_words_only(monkeypatch):
    e = tokens.Encoder(tokens.vocabulary())
    texts = ["", " ", "a b  c \n d\t e's  12 345 !? x " * 40, "\x00 \x01 b\x1c c\x85 d  e" * 30, " " * 200, "word" * 100]
    for size in (1, 7, 50):
        monkeypatch.setattr(tokens, "PIECE_CHARS", size)
        calls = []
        monkeypatch.setattr(tokens.Encoder, "whole", lambda self, t: calls.append(t) or array("H", self.encoding.encode_ordinary(t)).tobytes())
        for text in texts:
            assert e.encode(text) == array("H", e.encoding.encode_ordinary(text)).tobytes()
        assert len(calls) > len(texts)
    assert tokens.encoder(tokens.vocabulary()) is tokens.encoder(tokens.vocabulary())
