"""Quality classifier: a linear-chain conditional random field over the lines of
a document.

Every line gets surface features (shares of letters, capitals, digits, spaces and
kinds of marks, word lengths, whether it repeats) of its own and of the lines
before and after it.  The field labels each line good or bad; forward-backward
gives every line's marginal probability of good, and the document's raw quality is
their mean weighted by line length.  A logistic curve fitted on the training
documents turns that into the score.

Training takes a labelled document's label for all its lines, from at most
``SAMPLE_ROWS`` documents of each label, ``SAMPLE_CHARS`` characters of each (both
parameters); scoring reads whole texts.  Texts are scored together up to
``BLOCK_LINES`` lines; a longer text is scored in blocks of as many lines, with the
forward messages carried from block to block and the backward ones from its end, the
same marginals.  It holds the features of one block, 34 bytes a line (offsets, odds
and messages) and its different lines (to tell repeats).

Results for odd input: a null or empty text has no lines and gets the training
documents' share of label 1; a text of blank lines is scored by those lines;
without both labels in training every score is that share, or 0.5 without any;
rows are judged one by one, so repeated rows and null ids pass through; an empty
table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm.common import binary_values, small_batches

SAMPLE_ROWS, SAMPLE_CHARS = 2500, 4000
THRESHOLD = 0.7
STEPS, RATE, DECAY = 300, 0.05, 1e-3
#: Lines whose features are held at once.
BLOCK_LINES = 8192

#: Byte classes counted per line.
_KINDS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t",
          b".,;:'\"()-?", b"!", b"|", b"*$%&#@^~+=<>/\\_{}[]`"]
_CLASS = np.full(256, 8, np.uint8)  # 8: the rest, letters of other scripts above all
for _i, _chars in enumerate(_KINDS):
    for _c in _chars:
        _CLASS[_c] = _i
N_CLASSES = 9
N_OWN = N_CLASSES + 6
SEEN_BEFORE = N_CLASSES + 3


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of every line, its length, first line of every text and the end)."""
    kept = [t if t.endswith(b"\n") else t + b"\n" for t in texts if t]
    data = np.frombuffer(b"".join(kept), np.uint8)
    counts_of = np.array([t.count(b"\n") + (not t.endswith(b"\n")) if t else 0 for t in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(counts_of)])
    if not len(data):
        return np.zeros((0, 3 * N_OWN)), np.zeros(0), first
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    length = (ends - starts).astype(np.float64)
    kinds = _CLASS[data]
    counts = np.empty((len(starts), N_CLASSES))
    for k in range(N_CLASSES):
        hits = np.flatnonzero(kinds == k)
        counts[:, k] = np.searchsorted(hits, ends) - np.searchsorted(hits, starts)
    blank = kinds == 3
    blank |= data == 10
    word_starts = np.flatnonzero(np.concatenate([[True], blank[:-1]]) & ~blank)
    words = (np.searchsorted(word_starts, ends) - np.searchsorted(word_starts, starts)).astype(np.float64)
    seen_before = np.zeros(len(starts))
    variety = np.ones(len(starts))
    at = 0
    for t, n in zip(texts, counts_of.tolist(), strict=True):
        seen: set[bytes] = set()
        for i, line in enumerate(t.split(b"\n")[:n]):
            if line in seen:
                seen_before[at + i] = 1.0
            else:
                seen.add(line)
            parts = line.split()
            if parts:
                variety[at + i] = len(set(parts)) / len(parts)
        at += n
    size = np.maximum(length, 1.0)
    own = np.column_stack([
        counts / size[:, None] * 4, np.log1p(length) / 4, np.log1p(words) / 3,
        (length - counts[:, 3]) / np.maximum(words, 1) / 8, seen_before, variety,
        (counts[:, 5] + counts[:, 6] + counts[:, 7]) / np.maximum(words, 1)])
    np.clip(own, 0, 8, out=own)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    inner = first[:-1][counts_of > 0]
    before[inner] = 0
    after[inner[1:] - 1] = 0
    after[-1] = 0
    return np.hstack([own, before, after]), length, first


def _logadd(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def chains(scores: np.ndarray, first: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over all chains at once, a line position at a time.

    ``scores``: log-odds of good for each line; ``trans[i, j]``: weight of state j
    (1 good) after i.  Returns (marginal of good per line, log partition per
    chain, expected transitions)."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    lens, begin = n[order], first[:-1][order]
    lines = len(scores)
    fwd, back = np.zeros((lines, 2)), np.zeros((lines, 2))
    unary = np.column_stack([np.zeros(lines), scores])
    longest = int(lens[0]) if len(lens) else 0
    active = [int(np.searchsorted(-lens, -t, side="left")) for t in range(longest + 1)]  # chains longer than t
    for t in range(longest):
        i = begin[:active[t]] + t
        if t == 0:
            fwd[i] = unary[i]
        else:
            p = fwd[i - 1]
            fwd[i, 0] = _logadd(p[:, 0] + trans[0, 0], p[:, 1] + trans[1, 0])
            fwd[i, 1] = _logadd(p[:, 0] + trans[0, 1], p[:, 1] + trans[1, 1])
            fwd[i] += unary[i]
    for t in range(longest - 2, -1, -1):
        i = begin[:active[t + 1]] + t
        q = back[i + 1] + unary[i + 1]
        back[i, 0] = _logadd(trans[0, 0] + q[:, 0], trans[0, 1] + q[:, 1])
        back[i, 1] = _logadd(trans[1, 0] + q[:, 0], trans[1, 1] + q[:, 1])
    both = fwd + back
    total = _logadd(both[:, 0], both[:, 1])
    good = np.exp(both[:, 1] - total)
    z = np.zeros(len(n))
    full = n > 0
    z[full] = total[first[:-1][full]]
    linked = np.ones(lines, bool)
    linked[first[:-1][full]] = False
    j = np.flatnonzero(linked)
    expected = np.empty((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            expected[a, b] = np.exp(fwd[j - 1, a] + trans[a, b] + unary[j, b] + back[j, b] - total[j]).sum()
    return good, z, expected


def chain_marginals(odds: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Marginals of good along one long chain, from its lines' log-odds, by messages
    that are log-odds themselves (two numbers less to carry than in ``chains``)."""
    t00, t01, t10, t11 = (math.exp(t) for t in trans.ravel())
    log, exp, n = math.log, math.exp, len(odds)
    messages = np.empty(n)
    for start in range(0, n, BLOCK_LINES):
        block = []
        for u in odds[start:start + BLOCK_LINES].tolist():
            if start or block:
                e = exp(min(max(last, -600.0), 600.0))
                u += log((t01 + t11 * e) / (t00 + t10 * e))
            last = u
            block.append(u)
        messages[start:start + len(block)] = block
    back = 0.0
    for end in range(n, 0, -BLOCK_LINES):
        start = max(0, end - BLOCK_LINES)
        block = []
        for u in odds[start:end][::-1].tolist():
            block.append(back)
            e = exp(min(max(back + u, -600.0), 600.0))
            back = log((t10 + t11 * e) / (t00 + t01 * e))
        messages[start:end] += block[::-1]
    return 1 / (1 + np.exp(-np.clip(messages, -600, 600)))


def _line_ends(text: bytes) -> np.ndarray:
    """Where the lines of a text end, its last one too."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10)
    return ends if text.endswith(b"\n") else np.append(ends, len(text))


def _blocks(text: bytes, ends: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(first line, end, text) of blocks of lines with a line more on either side."""
    for i in range(0, len(ends), BLOCK_LINES):
        low, high = max(i - 1, 0), min(i + BLOCK_LINES + 1, len(ends))
        yield low, high, text[ends[low - 1] + 1 if low else 0:ends[high - 1]] + b"\n"


def _weighted(good: np.ndarray, length: np.ndarray, first: np.ndarray, missing: float) -> np.ndarray:
    weight = length + 1.0
    top = np.concatenate([[0], np.cumsum(good * weight)])
    low = np.concatenate([[0], np.cumsum(weight)])
    whole = low[first[1:]] - low[first[:-1]]
    return np.where(whole > 0, (top[first[1:]] - top[first[:-1]]) / np.maximum(whole, 1), missing)


@dataclass
class Model:
    """Weights of the features and transitions, and the curve that turns the
    weighted marginal into a score; ``share`` is the training share of label 1."""

    weights: np.ndarray | None
    bias: float
    trans: np.ndarray
    curve: tuple[float, float]
    share: float

    def raw(self, texts: list[bytes]) -> np.ndarray:
        """Length-weighted marginal of every text, nan without lines."""
        counts = [t.count(b"\n") + (not t.endswith(b"\n")) if t else 0 for t in texts]
        result, group, held = np.empty(len(texts)), [], 0
        for i, n in enumerate([*counts, BLOCK_LINES]):
            if held + n > BLOCK_LINES and group:
                result[group] = self._together([texts[j] for j in group])
                group, held = [], 0
            if i < len(texts) and n > BLOCK_LINES:
                result[i] = self._long(texts[i])
            elif i < len(texts):
                group.append(i)
                held += n
        if group:
            result[group] = self._together([texts[j] for j in group])
        return result

    def _together(self, texts: list[bytes]) -> np.ndarray:
        x, length, first = line_features(texts)
        good, _, _ = chains(x @ self.weights + self.bias, first, self.trans)
        return _weighted(good, length, first, np.nan)

    def _long(self, text: bytes) -> float:
        ends = _line_ends(text)
        n = len(ends)
        repeated, seen = np.zeros(n + 2), set()  # of line i at i + 1, none beyond either end
        done = 0
        for low, high, part in _blocks(text, ends):
            for i, line in enumerate(part[:-1].split(b"\n")[done - low:], done):
                repeated[i + 1] = line in seen
                seen.add(line)
            done = high
        del seen
        odds = np.empty(n)
        for low, high, part in _blocks(text, ends):
            x, _, _ = line_features([part])
            x[:, SEEN_BEFORE] = repeated[low + 1:high + 1]
            x[:, N_OWN + SEEN_BEFORE] = repeated[low:high]
            x[:, 2 * N_OWN + SEEN_BEFORE] = repeated[low + 2:high + 2]
            inner = slice(int(low > 0), None if high == n else -1)  # lines beside the block lack a neighbour
            odds[low:high][inner] = (x @ self.weights + self.bias)[inner]
        weight = np.diff(ends, prepend=-1)  # a line's length and one
        return float(chain_marginals(odds, self.trans) @ weight / weight.sum())

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.share)
        q = self.raw(texts)
        a, b = self.curve
        return np.where(np.isnan(q), self.share, 1 / (1 + np.exp(-(a * np.nan_to_num(q) + b))))


def fit(texts: list[bytes], labels: np.ndarray, share: float) -> Model:
    """Maximum likelihood by gradient steps (Adam) over the whole sample."""
    kinds = np.unique(labels)
    if len(kinds) < 2:
        return Model(None, 0.0, np.zeros((2, 2)), (1.0, 0.0), share)
    x, length, first = line_features(texts)
    n = np.diff(first)
    y = np.repeat(labels, n).astype(np.float64)
    counts = np.bincount(labels, minlength=2)
    doc_weight = (len(labels) / (2.0 * counts))[labels]
    line_weight = np.repeat(doc_weight / np.maximum(n, 1), n)
    theta = np.zeros(x.shape[1] + 1 + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    seen = np.zeros((2, 2))
    for a in (0, 1):
        seen[a, a] = np.maximum(n[labels == a] - 1, 0).sum()
    links = max(seen.sum(), 1.0)
    for step in range(1, STEPS + 1):
        trans = theta[-4:].reshape(2, 2)
        good, _, expected = chains(x @ theta[:-5] + theta[-5], first, trans)
        miss = (good - y) * line_weight
        grad = np.concatenate([x.T @ miss, [miss.sum()]]) / len(labels)
        grad[:-1] += DECAY * theta[:-5]
        grad = np.concatenate([grad, ((expected - seen) / links).ravel() + 0.05 * theta[-4:]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    made = Model(theta[:-5].copy(), float(theta[-5]), theta[-4:].reshape(2, 2).copy(), (1.0, 0.0), share)
    made.curve = _curve(made.raw(texts), labels)
    return made


def _curve(raw: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the label on the weighted marginal."""
    there = ~np.isnan(raw)
    q, y = raw[there], labels[there].astype(np.float64)
    a = b = 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * q + b)))
        w = np.maximum(p * (1 - p), 1e-6)
        g = np.array([(q * (p - y)).sum() + 1e-2 * a, (p - y).sum()])
        h = np.array([[(w * q * q).sum() + 1e-2, (w * q).sum()], [(w * q).sum(), w.sum() + 1e-6]])
        d = np.linalg.solve(h, g)
        a, b = a - float(np.clip(d[0], -5, 5)), b - float(np.clip(d[1], -5, 5))
    return max(a, 0.0), b


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Model:
    """Fits on a bounded sample of the documents that ``labels`` marks 0 or 1
    (others and null labels are left out; of several labels the larger counts),
    drawn by a hash of the id; only the sample's texts leave their tasks."""
    small_batches(docs.sparkSession)
    marked = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(
        F.max(F.col(label_col).cast("int")).alias("label"))
    share = marked.agg(F.avg("label")).first()[0]
    text = F.col(text_col).cast("string")
    there = docs.where(F.length(text) > 0).select(F.col(id_col).alias("__id")).distinct().join(marked, "__id")
    order = F.xxhash64("__id")
    drawn = [there.where(F.col("label") == v).orderBy(order, "__id").limit(rows) for v in (0, 1)]
    sampled = docs.select(F.col(id_col).alias("__id"), F.substring(text, 1, chars).alias("text")).where(F.length("text") > 0).join(
        F.broadcast(drawn[0].union(drawn[1])), "__id")  # at most 2 * rows ids
    found = sampled.dropDuplicates(["__id"]).select("text", "label").orderBy("label", F.xxhash64("text")).collect()
    return fit([r["text"].encode("utf-8", "surrogatepass") for r in found],
               np.array([r["label"] for r in found], np.int64), 0.5 if share is None else float(share))


def score(docs: DataFrame, model: Model, text_col: str = "text", columns: dict[str, Column] | None = None,
          score_col: str = "score") -> DataFrame:
    """``columns`` (default: all of ``docs``) and the score of every row's text."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = {c: F.col(c) for c in docs.columns} if columns is None else columns
    rows = docs.select(*[c.alias(k) for k, c in columns.items() if k != score_col],
                       F.col(text_col).cast("string").alias("__text"))
    fields = rows.schema.fields[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in binary_values(batch.column(batch.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(shared.value.scores(texts), pa.float64())],
                                             names=[*[f.name for f in fields], score_col])

    return rows.mapInArrow(run, T.StructType([*fields, T.StructField(score_col, T.DoubleType())]))
