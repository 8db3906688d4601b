"""Periodic runs of words, found on a Re-Pair grammar.

A run is a stretch of consecutive words with smallest period q that no neighbour
extends, at least ``min_length`` words and three periods long (a line pasted over
and over, a generator's loop).

1. Places that no run can reach are cut out: every ``min_length // 3`` words in a
   row of a run occur twice in the document, so only stretches of such grams go on.
2. Re-Pair over the word ids of what is left, for all documents of an Arrow batch
   at once: the pairs that occur again are replaced by new symbols, in rounds; where
   two overlap the more frequent one is taken, which Re-Pair would replace first.
   Every replacement is written down with its place: these are the derivation
   positions of each nonterminal.  When no pair occurs twice, what remains is
   paired as a balanced tree.
3. For each nonterminal, once, the runs across its boundary.  One half of such a
   run has half its length, so the gram of ``min_length // 6`` words beside the
   boundary occurs again a period away; these distances, from an index of the
   grams, are the candidates, and each is extended word by word inside the
   nonterminal.  A multiple of a period found already gives the same run.
4. The runs are moved to all derivation positions.  Each run of the text lies
   across the boundary of the smallest nonterminal that holds it and is found there
   in full; intervals that a longer one of the same period holds are its parts in
   smaller nonterminals and go.

Results for odd input: a null text has no words, no runs and an empty collapsed
text; texts shorter than ``min_length`` words have no runs; rows without an id or
that share one are handled one by one; an empty table gives an empty table; other
columns are ignored.  Memory: some 300 bytes a word of the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import binary_values, small_batches

MIN_LENGTH = 24
#: Words of a batch that share a grammar (a longer text has its own).
TOGETHER = 400_000
#: Candidate periods that are tried at once.
CANDIDATES = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def _gram_hashes(ids: np.ndarray, gram: int) -> np.ndarray:
    """A hash of every ``gram`` ids in a row (none if there are fewer)."""
    n = len(ids) - gram + 1
    h = np.zeros(max(n, 0), np.uint64)
    x = _mixed(ids.astype(np.uint64) + _ODD)
    for i in range(gram if n > 0 else 0):
        h = h * _ODD + x[i:i + n]
    return _mixed(h)


def _stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs of true values."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _reachable(ids: np.ndarray, doc: np.ndarray, min_length: int) -> tuple[np.ndarray, np.ndarray]:
    """Stretches [start, end) of words that a run may hold, each in one document."""
    gram = min_length // 3
    if len(ids) < min_length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = _gram_hashes(ids, gram) ^ _mixed(doc[:len(ids) - gram + 1].astype(np.uint64))
    ordered = np.sort(h)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(again, h), len(again) - 1)
    whole = doc[:len(h)] == doc[gram - 1:]
    hit = (again[at] == h) & whole
    # neighbouring documents never share a stretch: the grams across their border are not whole
    starts, ends = _stretches(hit)
    long = ends - starts >= min_length - gram + 1
    return starts[long], ends[long] + gram - 1


class Grammar:
    """Nonterminals as arrays: ``start``, ``mid`` and ``stop`` of one occurrence
    in the ids, and ``symbols``/``places``, every derivation position."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        at = np.concatenate([np.arange(s, e) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)])
        self._seq, self._from, self._to = ids[at].astype(np.int64), at, at + 1
        self._part = np.repeat(np.arange(len(starts)), ends - starts)
        self._next = int(ids.max()) + 1
        self.first = self._next
        self._nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self._places: list[tuple[np.ndarray, np.ndarray]] = []
        while self._repeated_pairs():
            pass
        while self._any_pairs():
            pass
        self.start, self.mid, self.stop = (np.concatenate(x) for x in zip(*self._nodes, strict=True))
        symbols, places = (np.concatenate(x) for x in zip(*self._places, strict=True))
        order = np.argsort(symbols, kind="stable")
        self.symbols, self.places = symbols[order] - self.first, places[order]

    def _replace(self, i: np.ndarray, key: np.ndarray) -> None:
        """New symbols, one for each key, at the pairs that start at items ``i``."""
        _, one, which = np.unique(key, return_index=True, return_inverse=True)
        new = self._next + which
        self._next += len(one)
        self._nodes.append((self._from[i[one]], self._from[i[one] + 1], self._to[i[one] + 1]))
        self._places.append((new, self._from[i]))
        self._seq[i], self._to[i] = new, self._to[i + 1]
        keep = np.ones(len(self._seq), bool)
        keep[i + 1] = False
        self._seq, self._from, self._to, self._part = (x[keep] for x in (self._seq, self._from, self._to, self._part))

    def _repeated_pairs(self) -> bool:
        inside = self._part[1:] == self._part[:-1]
        key = np.where(inside, self._seq[:-1] * self._next + self._seq[1:], -1)
        pairs, which, count = np.unique(key, return_inverse=True, return_counts=True)
        count[pairs < 0] = 0
        rank = np.empty(len(pairs), np.int64)
        rank[np.lexsort((pairs, count))] = np.arange(len(pairs))
        rank[count < 2] = -1
        rank = rank[which]
        # equal pairs in a row overlap (aaaa): every second one, from the left
        head = np.concatenate([[True], rank[1:] != rank[:-1]]) if len(rank) else np.zeros(0, bool)
        heads = np.flatnonzero(head)
        if not len(heads):
            return False
        block = np.cumsum(head) - 1
        of = rank[heads]
        before, after = np.concatenate([[-1], of[:-1]]), np.concatenate([of[1:], [-1]])
        top = (of >= 0) & (of > before) & (of > after)
        i = np.flatnonzero(top[block] & ((np.arange(len(rank)) - heads[block]) % 2 == 0))
        if not len(i):
            return False
        self._replace(i, key[i])
        return True

    def _any_pairs(self) -> bool:
        part = np.flatnonzero(np.concatenate([[True], self._part[1:] != self._part[:-1]]))
        nth = np.arange(len(self._part)) - np.repeat(part, np.diff(np.concatenate([part, [len(self._part)]])))
        i = np.flatnonzero((nth[:-1] % 2 == 0) & (self._part[1:] == self._part[:-1]))
        if not len(i):
            return False
        self._replace(i, i)
        return True


def _matched(ids: np.ndarray, q: int, x: int, lo: int, hi: int) -> tuple[int, int]:
    """The longest [a, b) around ``x`` in [lo, hi) in which every word equals the
    one ``q`` later; empty if ``x`` itself does not."""
    a = b = x
    size = 64
    while b < hi:
        z = min(hi, b + size)
        wrong = np.flatnonzero(ids[b:z] != ids[b + q:z + q])
        if len(wrong):
            b += int(wrong[0])
            break
        b, size = z, size * 4
    size = 64
    while a > lo:
        z = max(lo, a - size)
        wrong = np.flatnonzero(ids[z:a] != ids[z + q:a + q])
        if len(wrong):
            a = z + int(wrong[-1]) + 1
            break
        a, size = z, size * 4
    return a, b


class _Index:
    """The places of each short gram, in order."""

    def __init__(self, ids: np.ndarray, gram: int) -> None:
        _, which = np.unique(_gram_hashes(ids, gram), return_inverse=True)
        self.wide = len(ids) + 1
        self.gram_of = which.astype(np.int64)
        self.keys = np.sort(self.gram_of * self.wide + np.arange(len(which)))

    def between(self, at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of ``keys``: the places in [lo, hi) of the gram that starts at ``at``."""
        base = self.gram_of[at] * self.wide
        return np.searchsorted(self.keys, base + lo), np.searchsorted(self.keys, base + np.maximum(lo, hi))


def _candidates(ids: np.ndarray, g: Grammar, min_length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(nonterminal, period, whether the longer half lies left) that the gram beside
    the boundary and some of the words between allow."""
    gram, half = min_length // 6, (min_length + 1) // 2
    index = _Index(ids, gram)
    size = g.stop - g.start
    for left in (True, False):
        room = (g.mid - g.start if left else g.stop - g.mid) >= half
        node = np.flatnonzero((size >= min_length) & room)
        start, mid, stop, far = g.start[node], g.mid[node], g.stop[node], size[node] // 3
        if left:
            at = mid - gram
            lo, hi = index.between(at, np.maximum(start, at - far), at)
        else:
            at = mid
            lo, hi = index.between(at, at + 1, np.minimum(stop - gram, at + far) + 1)
        n = hi - lo
        ends = np.cumsum(n)
        a = 0
        while a < len(node):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CANDIDATES, side="right")))
            k = n[a:b]
            row = np.repeat(np.arange(a, b), k)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
            place = index.keys[lo[row] + nth] % index.wide
            q = np.abs(at[row] - place)
            reach = np.maximum(half, (3 * q + 1) // 2)
            fits = (mid[row] - reach >= start[row]) if left else (mid[row] + reach <= stop[row])
            row, q, reach = row[fits], q[fits], reach[fits]
            # the longer half of the run: these words equal the ones a period later
            from_ = mid[row] - reach if left else mid[row]
            for part in (0, 3, 5, 7, 1):
                x = from_ + (reach - q - 1) * part // 7
                same = ids[x] == ids[x + q]
                row, q, reach, from_ = row[same], q[same], reach[same], from_[same]
            if len(row):
                yield node[row], q, np.full(len(row), left)
            a = b


def _boundary_runs(ids: np.ndarray, g: Grammar, min_length: int) -> Iterator[tuple[int, int, int, int]]:
    """(nonterminal, period, start and length inside it) of the runs across the
    nonterminals' boundaries."""
    found = list(_candidates(ids, g, min_length))
    if not found:
        return
    node, q, left = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((left, q, node))
    node, q, left = node[order], q[order], left[order]
    cuts = np.concatenate([[0], np.flatnonzero(node[1:] != node[:-1]) + 1, [len(node)]])
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        x = int(node[a])
        lo, mid, hi = int(g.start[x]), int(g.mid[x]), int(g.stop[x])
        qs, ls = q[a:b], left[a:b]
        while len(qs):
            p, is_left = int(qs[0]), bool(ls[0])
            qs, ls = qs[1:], ls[1:]
            s, e = _matched(ids, p, mid - 1 - p if is_left else mid, lo, hi - p)
            if e <= s or e + p - s < max(min_length, 3 * p):
                continue
            e += p
            yield x, p, s - lo, e - s
            if len(qs):
                # what a multiple's longer half would have to be lies in this run
                reach = np.maximum((min_length + 1) // 2, (3 * qs + 1) // 2)
                inside = np.where(ls, (mid - reach >= s) & (mid <= e), (mid + reach <= e) & (mid >= s))
                keep = ~((qs % p == 0) & inside)
                qs, ls = qs[keep], ls[keep]


def find_runs(ids: np.ndarray, doc: np.ndarray, min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) by start, then period, of all runs in ``ids``, word
    ids of documents one after another (``doc``: their numbers, ascending)."""
    starts, ends = _reachable(ids, doc, min_length)
    if not len(starts):
        return []
    g = Grammar(ids, starts, ends)
    spans = []
    for x, p, offset, length in _boundary_runs(ids, g, min_length):
        a, b = np.searchsorted(g.symbols, [x, x + 1])
        spans.extend((p, s + offset, -length) for s in set(g.places[a:b].tolist()))
    spans.sort()
    best: dict[tuple[int, int], int] = {}
    period, reached = 0, 0
    for p, s, length in spans:
        if p != period:
            period, reached = p, 0
        if s - length > reached:
            reached = s - length
            key = s, -length
            best[key] = min(best.get(key, p), p)
    return sorted((s, n, p) for (s, n), p in best.items())


def _collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period."""
    kept, at = [], 0
    for s, e in sorted((s + p, s + n) for s, n, p in runs):
        if s > at:
            kept.extend(words[at:s])
        at = max(at, e)
    kept.extend(words[at:])
    return b" ".join(kept)


def _scan(min_length: int):
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def found(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
        sizes = np.array([len(w) for w in texts])
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for t in texts for w in t), np.int64, int(sizes.sum()))
        doc = np.repeat(np.arange(len(texts)), sizes)
        first = np.cumsum(sizes) - sizes
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for s, n, p in find_runs(ids, doc, min_length):
            d = int(doc[s])
            out[d].append((s - int(first[d]), n, p))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or b"").split() for t in binary_values(batch.column(1))]
            a = 0
            while a < len(texts):
                b, words = a, 0
                while b < len(texts) and (b == a or words + len(texts[b]) <= TOGETHER):
                    words += len(texts[b])
                    b += 1
                part = texts[a:b]
                runs = found(part)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([len(w) for w in part], pa.int64()),
                     pa.array([[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs], run_type),
                     pa.array([_collapse(w, r) for w, r in zip(part, runs, strict=True)], pa.binary())],
                    names=["id", "n_words", "runs", "collapsed"])
                texts[a:b] = [[] for _ in part]
                a = b

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """(``id_col``, n_words, runs, collapsed): a row per row of ``docs``; ``runs``
    are structs (start, length, period) by start and period, ``collapsed`` is the
    text, words joined by one space, without the words a run repeats."""
    if min_length < 12 or min_length % 6:
        raise ValueError("min_length must be a multiple of 6, at least 12")
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _scan(min_length), f"id {kind}, n_words long, "
                           "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed binary")
    return found.withColumnRenamed("id", id_col)
