"""Nearest neighbours against brute force; url rules against all rules."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillroll.llm import ann, urlfilter


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1.0) for i, v in rows], "vec_id long, embedding array<float>, rank int, score double")


def slow(rows, k, asks):
    out = {}
    for q, x in rows:
        if asks(q):
            d = sorted((float(np.sqrt(((np.float64(np.float32(y)) - np.float64(np.float32(x))) ** 2).sum())), i) for i, y in rows if i != q)
            out[q] = [(i, s) for s, i in d[:k]]
    return out


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_all_leaves_opened_is_exact_with_ties_copies_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 16)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[5][1]) for i in range(40)] + [(2000 + i, [float(i % 3), 1.0, 0.0, 0.0, 0.0, 0.0]) for i in range(30)]
    odd = [(9000, None), (9010, [0.0] * 6), (9020, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (9030, [float("nan")] * 6), (9040, [float("inf")] * 6),
           (9050, []), (9060, [1.0, 2.0]), (None, [1.0] * 6), (5, rows[5][1])]
    asks = lambda i: i % 10 == 0
    got = answers(ann.nearest(frame(spark, rows + odd), F.col("id") % 10 == 0, trees=3, leaf=8, probe=4.0))
    want = slow(rows, 10, asks)
    assert set(got) == set(want)
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=1e-12, atol=0)


def test_recall_at_production_settings(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = answers(ann.nearest(df, F.col("id") % 100 == 0))
    want = slow(rows, 10, lambda i: i % 100 == 0)
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hit >= 0.9 * 10 * len(want)


def test_few_or_no_candidates(spark):
    two = frame(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0])])
    assert answers(ann.nearest(two, F.col("id") == 0)) == {0: [(1, pytest.approx(2 ** 0.5))]}
    assert ann.nearest(two.where("false"), F.col("id") == 0).count() == 0


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"),
         ("block", "net", "/es/ok"), ("allow", "net", "/es/ok"), ("block", "a.b.c", ""), ("allow", "c", "/x/y/z"), ("block", "d", "")]
URLS = [None, "", "no scheme", "http://", "://com", "http://com", "http://COM/", "https://x.example.com/en/1?q#f", "http://example.com/en",
        "http://www.example.com/en/a", "http://sub.www.example.com/en/", "http://notexample.com/en/", "http://a.net/es/1", "http://net/es/okay",
        "http://net/es?/es/", "ftp://q.a.b.c/x/y/zebra", "ftp://a.b.c", "http://b.c/x/y/z", "http://b.c/x/y/", "http://d#com/",
        "http://É.com/x", "http://a://b.com/", "http://x.com:80/", "http://com./", "a\nb://net/es/\n"]


def by_hand(url):
    """Longest rule by walking all rules."""
    _, there, rest = (url or "").partition("://")
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest)) if there else 0
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:] if there else ""
    path = tail[:min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fit = [((len(h.split(".")) + p.count("/"), len(h + p), a == "block"), h + p, a) for a, h, p in RULES
           if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[1], best[2] if best else "allow"


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)], "page_id long, url string, host string, verdict string")
    rows = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(pages, RULES).collect()}
    assert rows == {i: by_hand(u) for i, u in enumerate(URLS)}
    table = spark.createDataFrame(RULES, "action string, host string, path string")
    joined = {r["page_id"]: (r["rule"], r["verdict"]) for r in urlfilter.judge_by_join(pages, table).collect()}
    assert joined == {i: by_hand(u)[2:] for i, u in enumerate(URLS)}
    assert urlfilter.judge(pages.where("false"), RULES).count() == 0
    assert urlfilter.judge(pages, []).where("verdict <> 'allow' OR rule IS NOT NULL").count() == 0


def test_rule_lists_are_bounded(monkeypatch):
    monkeypatch.setattr(urlfilter, "MAX_RULES", 2)
    with pytest.raises(ValueError):
        urlfilter.Trie(RULES)
    with pytest.raises(ValueError):
        urlfilter.Trie([("maybe", "com", "/")])
