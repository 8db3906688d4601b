"""Benchmark decontamination by the q-gram lemma.

Texts and benchmark items are compared in lower case with punctuation and white
space as single spaces.  An item of ``m`` bytes that occurs with at most ``k``
edits shares at least ``m + 1 - q (k + 1)`` of its q-grams with the place, all
within ``k + 1`` neighbouring diagonals (text position minus item position).  So
shared q-grams are counted in overlapping bands of diagonals, wide enough that any
such run lies in one band.  A band that reaches the bound, and reaches it with
different q-grams of the item, is verified by an alignment of the item within the
band's diagonals, given up when no way in the band keeps the budget.  ``k`` is ``edit_rate`` of the
item's length, less for items so short that the bound would not be positive.

The items are broadcast in slices of at most ``SLICE_BYTES``, whose index takes up
to 56 bytes a byte; a larger benchmark is met in several passes over the documents.
Texts are scanned whole, joined to blocks of about ``BLOCK`` bytes, longer ones in
overlapping blocks.  Repetitive texts share a gram with many places of an item:
beyond ``SHARED`` pairs of places, a block's pairs are counted in parts, each
keeping the pairs of the bands that the next one can still add to, without items
that the text is known to hold unchanged.  So a task holds one text, one index and
about 100 bytes for each of ``SHARED`` pairs.

Results for odd input: null and empty texts match nothing and stay; empty items
are left out, items shorter than ``q`` bytes are looked for exactly, as words of
their own; items with the same text are separate items; rows without an id are
judged like others; repeated rows are judged alike; an empty benchmark leaves all
documents, an empty table gives an empty table; all columns are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import small_batches

GRAM, EDIT_RATE = 8, 0.1
SLICE_BYTES = 2 << 20
BLOCK = 1 << 20
#: Pairs of places with a shared gram that are counted at once.
SHARED = 1 << 21
#: Diagonals by which bands are apart, or the largest edit budget if that is more.
STRIDE = 64

_FOLD = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def folded(text: str | None) -> bytes:
    return b" ".join((text or "").lower().encode("utf-8", "surrogatepass").translate(_FOLD).split())


def align(item: bytes, text: bytes, diagonals: int, limit: int | None = None) -> tuple[int, int]:
    """(edits, end): the fewest edits that turn ``item`` into a piece of ``text``
    on the diagonals 0 to ``diagonals``, and where that piece ends.  Above
    ``limit`` edits some number above it."""
    n, t = len(item), np.zeros(len(item) + diagonals + 1, np.uint8)
    raw = np.frombuffer(text[:len(t)], np.uint8)
    t[:len(raw)] = raw
    limit = n if limit is None else limit
    steps = np.arange(diagonals + 1, dtype=np.int32)
    row, down = np.zeros(diagonals + 1, np.int32), np.full(diagonals + 1, n + 1, np.int32)
    for i, c in enumerate(item):
        np.add(row[1:], 1, out=down[:-1])
        row += t[i:i + diagonals + 1] != c
        np.minimum(row, down, out=row)
        row -= steps
        np.minimum.accumulate(row, out=row)
        row += steps
        if not i & 7 and row.min() > limit:
            return limit + 1, n
    d = int(row.argmin())
    return int(row[d]), n + d


class Screen:
    """The q-gram index of a slice of items."""

    def __init__(self, items: list[bytes], gram: int = GRAM, edit_rate: float = EDIT_RATE) -> None:
        if gram != 8:
            raise ValueError("grams are eight bytes, compared as one word")
        self.items, self.gram = items, gram
        m = np.array([len(x) for x in items], np.int64)
        self.edits = np.maximum(0, np.minimum((m * edit_rate).astype(np.int64), m // gram - 1))
        self.bound = m + 1 - gram * (self.edits + 1)
        self.short = [i for i in range(len(items)) if len(items[i]) < gram]
        self.reach = int(self.edits.max(initial=0))
        self.stride = max(STRIDE, self.reach)
        self.longest = int(m.max(initial=0))
        codes, owner, place = [], [], []
        for i, x in enumerate(items):
            if len(x) >= gram:
                c = self._codes(np.frombuffer(x, np.uint8))
                codes.append(c), owner.append(np.full(len(c), i)), place.append(np.arange(len(c)))
        flat = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.owner = (np.concatenate(owner)[order] if codes else np.zeros(0)).astype(np.int32)
        self.place = (np.concatenate(place)[order] if codes else np.zeros(0)).astype(np.int32)
        self.codes, self.first, self.count = np.unique(flat[order], return_index=True, return_counts=True)
        self.bits = max(16, int(len(self.codes) * 16).bit_length())
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[self._slot(self.codes)] = True

    @staticmethod
    def _codes(data: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)).view(np.uint64).ravel()

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def _bands(self, data: np.ndarray, known: Callable[[int, int], np.ndarray | None]) -> Iterator[tuple[int, int]]:
        """(item, first diagonal) of the bands that reach the item's bound; ``known``
        tells of a stretch of ``data`` which items need no more of them."""
        codes = self._codes(data)
        at = np.flatnonzero(self.seen[self._slot(codes)])
        where = np.searchsorted(self.codes, codes[at])
        where[where == len(self.codes)] = 0
        real = self.codes[where] == codes[at]
        at, where = at[real], where[real]
        n = self.count[where]
        total = int(n.sum())
        if not total:
            return
        if total > SHARED:
            yield from self._bands_in_parts(at, where, known)
            return
        inner = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
        key, place = self._banded(np.repeat(at, n), np.repeat(self.first[where], n) + inner)
        band = key & 0xFFFFFFFF
        width = int(band.max()) + 1
        if len(self.items) * width <= 1 << 22:
            counts = np.bincount((key >> 32) * width + (key & 0xFFFFFFFF), minlength=len(self.items) * width).reshape(-1, width)
            enough = counts >= np.maximum(self.bound, 1)[:, None]
            left = enough[key >> 32, key & 0xFFFFFFFF]
        else:
            _, back, times = np.unique(key, return_inverse=True, return_counts=True)
            left = times[back] >= np.maximum(self.bound, 1)[key >> 32]
        # a way through the band uses every q-gram of the item once at most
        both = np.unique(np.column_stack([key[left], place[left]]), axis=0)
        keys, times = np.unique(both[:, 0], return_counts=True)
        for k in keys[times >= np.maximum(self.bound, 1)[keys >> 32]].tolist():
            yield k >> 32, (k & 0xFFFFFFFF) * self.stride - self.longest

    def _banded(self, at: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item << 32 | band, place in the item) of the shared grams at text positions
        ``at`` and index entries ``hit``, in every band that holds their diagonal."""
        item, place = self.owner[hit].astype(np.int64), self.place[hit].astype(np.int64)
        diagonal = at - place + self.longest  # not below zero
        band = diagonal // self.stride
        again = (diagonal % self.stride < self.edits[item]) & (band > 0)
        key = np.concatenate([item * (1 << 32) + band, item[again] * (1 << 32) + band[again] - 1])
        return key, np.concatenate([place, place[again]])

    def _bands_in_parts(self, at: np.ndarray, where: np.ndarray,
                        known: Callable[[int, int], np.ndarray | None]) -> Iterator[tuple[int, int]]:
        """The bands of ``_bands`` from parts of ``SHARED`` pairs, in text order."""
        n = self.count[where]
        ends = np.cumsum(n)
        total, width = int(ends[-1]), int(at[-1] + self.longest) // self.stride + 2
        held = np.zeros(0, np.int64)  # (item, band, place) in one number: pairs of open bands, each place once
        for a in range(0, total, SHARED):
            b = min(a + SHARED, total)
            row = np.searchsorted(ends, np.arange(a, b), side="right")
            hit = self.first[where[row]] + np.arange(a, b) - (ends[row] - n[row])
            done = known(int(at[row[0]]), int(at[row[-1]]) + self.gram)
            if done is not None:
                need = ~done[self.owner[hit]]
                row, hit = row[need], hit[need]
                held = held[~done[held // (width * (self.longest + 1))]]
            key, place = self._banded(at[row], hit)
            held = np.unique(np.concatenate([held, ((key >> 32) * width + (key & 0xFFFFFFFF)) * (self.longest + 1) + place]))
            group = held // (self.longest + 1)
            # a band's pairs lie before the end of its last diagonal
            following = int(at[np.searchsorted(ends, b, side="right")]) if b < total else None
            closed = np.ones(len(group), bool) if following is None else (group % width + 1) * self.stride + self.reach <= following
            bands, times = np.unique(group[closed], return_counts=True)
            held = held[~closed]
            for k in bands[times >= np.maximum(self.bound, 1)[bands // width]].tolist():
                yield k // width, (k % width) * self.stride - self.longest

    def matches(self, texts: list[bytes]) -> list[dict[int, tuple[int, int]]]:
        """For each folded text: item -> (edits, end of the best piece)."""
        out: list[dict[int, tuple[int, int]]] = [{} for _ in texts]
        for first, last in self._blocks(texts):
            joined = b"\n".join(texts[first:last])
            starts = np.cumsum([0] + [len(t) + 1 for t in texts[first:last]])
            data = np.frombuffer(joined, np.uint8)
            overlap = 2 * (self.longest + self.reach) + self.stride
            for a in range(0, max(1, len(data) - overlap), BLOCK):
                part = data[a:a + BLOCK + overlap]
                if len(part) < self.gram:
                    continue

                def known(lo: int, hi: int, a: int = a) -> np.ndarray | None:
                    # the items that the only text of this stretch holds without an edit
                    doc = int(np.searchsorted(starts, a + lo, side="right")) - 1
                    if a + hi >= starts[doc + 1] or a + lo - self.longest - self.stride - self.reach < starts[doc]:
                        return None
                    whole = [i for i, (edits, _) in out[first + doc].items() if edits == 0]
                    return np.isin(np.arange(len(self.items)), whole) if whole else None

                for i, diagonal in self._bands(part, known):
                    self._verify(i, a + diagonal, joined, starts, first, out)
        for i in self.short:
            if self.items[i]:
                word = b" " + self.items[i] + b" "
                for t, found in zip(texts, out, strict=True):
                    spot = (b" " + t + b" ").find(word)
                    if spot >= 0:
                        found[i] = (0, spot + len(self.items[i]))
        return out

    def _blocks(self, texts: list[bytes]) -> Iterator[tuple[int, int]]:
        first, size = 0, 0
        for i, t in enumerate(texts):
            if size and size + len(t) > BLOCK:
                yield first, i
                first, size = i, 0
            size += len(t) + 1
        if first < len(texts):
            yield first, len(texts)

    def _verify(self, i: int, diagonal: int, joined: bytes, starts: np.ndarray, first: int,
                out: list[dict[int, tuple[int, int]]]) -> None:
        item, k = self.items[i], int(self.edits[i])
        low, high = diagonal - k, diagonal + self.stride + 2 * k
        end = min(len(joined), high + len(item) + 1)
        doc = int(np.searchsorted(starts, max(0, low), side="right")) - 1
        while doc < len(starts) - 1 and starts[doc] <= high:
            s, e = max(low, int(starts[doc])), min(end, int(starts[doc + 1]) - 1)
            found = out[first + doc]
            if e - s >= len(item) - k and not (i in found and found[i][0] == 0):
                # bytes that match nothing stand for diagonals that begin before the document
                region = bytes(s - low) + joined[s:e]
                spot = region.find(item)
                edits, stop = (0, spot + len(item)) if spot >= 0 else align(item, region, high - low, k)
                if edits <= k and (i not in found or edits < found[i][0]):
                    found[i] = (edits, low - int(starts[doc]) + stop)
            doc += 1


def item_slices(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, bytes]]]:
    """The items in slices that may be broadcast."""
    held, size = [], 0
    rows = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    for r in rows.orderBy("id", "text").toLocalIterator():
        text = folded(r["text"])
        if not text:
            continue
        if held and size + len(text) > SLICE_BYTES:
            yield held
            held, size = [], 0
        held.append((r["id"], text))
        size += len(text)
    if held:
        yield held


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_id_col: str = "item_id", item_text_col: str = "text", edit_rate: float = EDIT_RATE) -> DataFrame:
    """(``id_col``, item_id, edits, end_byte): every item that a document holds
    within its edit budget; ``end_byte`` counts in the folded text."""
    spark = docs.sparkSession
    small_batches(spark)
    schema = f"`{id_col}` long, item_id long, edits int, end_byte long"
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string").alias("__text"))
    found = spark.createDataFrame([], schema)
    for items in item_slices(benchmark, item_id_col, item_text_col):
        shared = spark.sparkContext.broadcast((Screen([t for _, t in items], edit_rate=edit_rate), [i for i, _ in items]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            screen, ids = shared.value
            for batch in batches:
                texts = [folded(t) for t in batch.column(1).to_pylist()]
                hits = [(d, ids[i], e, end) for d, m in zip(batch.column(0).to_pylist(), screen.matches(texts), strict=True)
                        for i, (e, end) in m.items()]
                if hits:
                    d, i, e, end = zip(*hits, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(i, pa.int64()), pa.array(e, pa.int32()),
                                                      pa.array(end, pa.int64())], names=[id_col, "item_id", "edits", "end_byte"])

        found = found.union(rows.mapInArrow(run, schema))
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id",
                  item_text_col: str = "text", edit_rate: float = EDIT_RATE) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item."""
    spark = docs.sparkSession
    small_batches(spark)
    at = docs.columns.index(text_col)
    for items in item_slices(benchmark, item_id_col, item_text_col):
        shared = spark.sparkContext.broadcast(Screen([t for _, t in items], edit_rate=edit_rate))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [folded(t) for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array([not m for m in shared.value.matches(texts)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
