"""SimHash near-duplicates through a byte-position inverted index.

A document's fingerprint is the bitwise majority of the XXH64 values (seed 42)
of its word shingles.  Two fingerprints within ``max_bits`` (at most 4) bits
share at least ``8 - max_bits`` of their eight positional bytes, and so at least
one fewer of the first seven.  Posting lists are keyed by that many bytes of the
first seven positions (35 lists a fingerprint for 4 bits).  Where two entries meet,
the positional bytes they share are tallied over all eight positions; the pair is
retained when the tally reaches ``8 - max_bits``, and its bit distance is verified.
Equal fingerprints are one entry of the index.

The entries of lists longer than ``BLOCK`` (thousands of near copies of one text)
go, once each, to a second index over half bytes, of which ``16 - max_bits`` must be
equal.  What is left there are at most 16 free bits, so a list holds at most 65,536
different fingerprints whatever the input, and its components come from a sweep over
that 16-bit cube.  No link is lost and no list is expanded into all its pairs.

Results for odd input: null, empty and white-space texts have fingerprint zero
and link like any other; rows without an id take part under their fingerprint
and never name a component (a component of such rows only has a null id);
repeated ids are ordinary rows; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import (UnionFind, binary_values, popcount, small_batches,
                                 stream_groups, write_table)
from tillroll.llm.components import connected_components

SEED = 42
#: Entries of a posting list that are compared with each other in one task.
BLOCK = 4096
#: Edges that a task gathers before it hands them on.
EDGES = 50_000
#: Bytes of text whose words are held at once.
CHUNK = 1 << 20

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_OFFSETS = (np.arange(8) * 256)[None, :]


def _hashes(text: bytes, width: int) -> Iterator[np.ndarray]:
    """XXH64 values of the shingles, a chunk of the text at a time."""
    carry: list[bytes] = []
    done, at, n, hash64 = False, 0, len(text), xxhash.xxh64_intdigest
    while at < n:
        end = at + CHUNK
        if end < n:
            cut = _SPACE.search(text, end)
            end = cut.start() if cut else n
        words = carry + text[at:end].lower().split()
        at = end
        if len(words) < width:
            carry = words
            continue
        joined, spot, cuts = b" ".join(words), 0, [0]
        for w in words:
            spot += len(w) + 1
            cuts.append(spot)
        yield np.array([hash64(joined[a:b - 1], SEED) for a, b in zip(cuts, cuts[width:], strict=False)], np.uint64)
        carry, done = words[len(words) - width + 1:], True
    if not done and carry:
        yield np.array([hash64(b" ".join(carry), SEED)], np.uint64)


def fingerprint(text: bytes | None, width: int) -> int:
    """The 64-bit fingerprint of one text, unsigned."""
    counts, n = np.zeros((8, 256), np.int64), 0
    for h in _hashes(text or b"", width):
        counts += np.bincount((h.view(np.uint8).reshape(-1, 8) + _OFFSETS).ravel(), minlength=2048).reshape(8, 256)
        n += len(h)
    if not n:
        return 0
    return int(np.packbits((2 * (counts @ _BITS) > n).ravel(), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, t, fp) with ``t`` a hash of the text and ``fp`` the fingerprint as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, width) for t in binary_values(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps.view(np.int64))], names=["id", "t", "fp"])

    return (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), _text_id(text_col).alias("t"))
            .mapInArrow(run, "id long, t long, fp long"))


def _text_id(text_col: str) -> Column:
    return F.xxhash64(F.col(text_col).cast("string"))


def _byte_masks(max_bits: int) -> list[int]:
    """Masks of the posting lists: one byte fewer than close pairs share, of seven."""
    return [sum(0xFF << (8 * p) for p in c) for c in combinations(range(7), 7 - max_bits)]


def _half_masks(byte_mask: int, max_bits: int) -> list[int]:
    """Masks that keep ``byte_mask`` and all but ``max_bits`` of the other half bytes."""
    free = [4 * i for i in range(16) if not (byte_mask >> (4 * i)) & 0xF]
    return [byte_mask | sum(0xF << s for s in c) for c in combinations(free, len(free) - max_bits)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _shared_bytes(x: np.ndarray) -> np.ndarray:
    """How many positional bytes are equal, from the exclusive or of two fingerprints."""
    some = x | x >> np.uint64(4)
    some |= some >> np.uint64(2)
    some |= some >> np.uint64(1)
    return 8 - popcount(some & np.uint64(0x0101010101010101))


def _close(x: np.ndarray, max_bits: int, min_bytes: int) -> np.ndarray:
    """Which exclusive ors reach the tally of shared bytes and then the bit distance."""
    kept = np.flatnonzero(_shared_bytes(x) >= min_bytes)
    return kept[popcount(x[kept]) <= max_bits]


def _pairs(values: np.ndarray, max_bits: int, min_bytes: int) -> list[tuple[int, int]]:
    """Spanning edges of a list's link graph: every value found is compared with
    those not yet found."""
    edges, left = [], values
    while len(left) > 1:
        found, left = [int(left[0])], left[1:]
        while found and len(left):
            a = found.pop()
            near = _close(left ^ np.uint64(a), max_bits, min_bytes)
            if len(near):
                new = left[near].tolist()
                edges += [(a, b) for b in new]
                found += new
                left = np.delete(left, near)
    return edges


def _cube(values: np.ndarray, mask: int, max_bits: int) -> list[tuple[int, int]]:
    """Edges joining the link graph's components for any number of values that
    differ in at most 16 bits: the smallest label spreads over balls of half the
    distance, from the values to the cube's points and back."""
    free = [i for i in range(64) if not (mask >> i) & 1]
    width = len(free)
    at = np.zeros(len(values), np.int64)
    for k, i in enumerate(free):
        at |= ((values >> np.uint64(i)) & np.uint64(1)).astype(np.int64) << k

    def ball(radius: int) -> list[int]:
        return [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(width), r)]

    none, cells = 1 << width, np.arange(1 << width)
    up, down = ball(max_bits // 2), ball(max_bits - max_bits // 2)
    label = np.full(none, none)
    label[at] = at
    there = label < none
    while True:
        middle = np.full(none, none)
        for m in up:
            np.minimum(middle, label[cells ^ m], out=middle)
        after = np.full(none, none)
        for m in down:
            np.minimum(after, middle[cells ^ m], out=after)
        after[~there] = none
        if (after == label).all():
            break
        label = after
    of = dict(zip(at.tolist(), values.tolist(), strict=True))
    return [(of[int(label[p])], v) for p, v in of.items() if label[p] != p]


class _Edges:
    """Edges of one task, without those that join what the batch has joined already."""

    def __init__(self) -> None:
        self.sets, self.edges = UnionFind(), []

    def add(self, pairs: Iterable[tuple[int, int]]) -> None:
        self.edges += [(a, b) for a, b in pairs if self.sets.union(a, b)]

    def batch(self) -> pa.RecordBatch:
        pair = np.array(self.edges, np.uint64).reshape(-1, 2).view(np.int64)
        self.__init__()
        return _link_batch(pair[:, 0], pair[:, 1], False)


def _link_batch(a: np.ndarray, b: np.ndarray, long: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), long))], names=["a", "b", "long"])


def _lists(max_bits: int, block: int):
    """Posting lists, sorted by key, to edges; entries of long lists go on as (fp, fp, long)."""
    min_bytes = 8 - max_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        held_n, is_long = 0, False
        edges = _Edges()

        def close() -> None:
            if held_n > 1 and not is_long:
                edges.add(_pairs(np.concatenate(held), max_bits, min_bytes))

        for cols, starts, goes_on in stream_groups(batches, ["c", "key"]):
            fp = cols["fp"].view(np.uint64)
            if not goes_on:
                close()
                held, held_n, is_long = [], 0, False
            sizes = np.diff(np.append(starts, len(fp)))
            last = len(starts) - 1
            # lists of two that lie inside the batch, all at once
            twos = np.flatnonzero(sizes == 2)
            twos = twos[(twos > 0) & (twos < last)] if last else twos[:0]
            a, b = fp[starts[twos]], fp[starts[twos] + 1]
            near = _close(a ^ b, max_bits, min_bytes)
            edges.add(zip(a[near].tolist(), b[near].tolist(), strict=True))
            some = np.flatnonzero(sizes > 2)
            for g in sorted({0, last, *some.tolist()}):
                values = fp[starts[g]:starts[g] + sizes[g]]
                if g:
                    close()
                    held, held_n, is_long = [], 0, False
                if not is_long and held_n + len(values) <= block:
                    held.append(values.copy())
                    held_n += len(values)
                    continue
                entries = np.concatenate([*held, values]).view(np.int64)
                held, is_long = [], True
                yield _link_batch(entries, entries, True)
            if len(edges.edges) >= EDGES:
                yield edges.batch()
        close()
        yield edges.batch()

    return run


def _half_keys(max_bits: int):
    masks = np.array(_half_masks(0, max_bits), np.uint64)
    k = len(masks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(fps), 100):
                fp = fps[i:i + 100]
                n = len(fp)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(np.arange(k, dtype=np.int32), n)),
                    pa.array((fp[None, :] & masks[:, None]).ravel().view(np.int64)),
                    pa.array(np.tile(fp, k).view(np.int64))], names=["c", "key", "fp"])

    return run


def _half_lists(max_bits: int, block: int):
    masks = _half_masks(0, max_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        held_c = -1
        edges = _Edges()

        def close() -> None:
            if not held:
                return
            values = np.concatenate(held)
            if len(values) > block:
                edges.add(_cube(values, masks[held_c], max_bits))
            elif len(values) > 1:
                edges.add(_pairs(values, max_bits, 8 - max_bits))

        for cols, starts, goes_on in stream_groups(batches, ["c", "key"]):
            fp, c = cols["fp"].view(np.uint64), cols["c"]
            ends = np.append(starts[1:], len(fp))
            for g, (s, e) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
                if g or not goes_on:
                    close()
                    held = []
                held_c = int(c[s])
                if e - s > 1 or g == len(starts) - 1 or (g == 0 and goes_on):
                    held.append(fp[s:e].copy())
            if len(edges.edges) >= EDGES:
                yield edges.batch()
        close()
        yield edges.batch()

    return run


def _keyed(df: DataFrame) -> DataFrame:
    return df.repartition("c", "key").sortWithinPartitions("c", "key")


def fingerprint_links(fps: DataFrame, max_bits: int, block: int = BLOCK) -> DataFrame:
    """``fps`` (fp: distinct longs) -> (a, b): edges whose components are those
    of all pairs within ``max_bits`` bits."""
    if not 0 <= max_bits <= 4:
        raise ValueError("max_bits must lie between 0 and 4")
    masks = [F.lit(_signed(m)) for m in _byte_masks(max_bits)]
    if max_bits == 0:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("false")
    postings = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(m) for m in masks])).alias("c", "key"))
    out = "a long, b long, long boolean"
    first = write_table(_keyed(postings.select("c", "key", "fp")).mapInArrow(_lists(max_bits, block), out), "simhash-lists")
    longer = first.where("long").select(F.col("a").alias("fp")).distinct()
    second = _keyed(longer.mapInArrow(_half_keys(max_bits), "c int, key long, fp long")).mapInArrow(_half_lists(max_bits, block), out)
    return first.where("NOT long").union(second).select("a", "b")


def _clusters(docs: DataFrame, id_col: str, text_col: str, shingle_words: int, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """(rows with their fingerprints, (fp, root, component_id) of each fingerprint)."""
    small_batches(docs.sparkSession)
    rows = write_table(fingerprints(docs, id_col, text_col, shingle_words), "simhash-fp")
    classes = write_table(rows.groupBy("fp").agg(F.min("id").alias("least")), "simhash-classes")
    roots = connected_components(fingerprint_links(classes.select("fp"), max_bits))
    linked = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    named = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows, linked.join(named, "root").select("fp", "root", "component_id")


def simhash_clusters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     shingle_words: int = 4, max_bits: int = 4) -> DataFrame:
    """(``id_col``, fp, component_id): one row per row of ``docs``;
    ``component_id`` is the smallest id that can be reached over links of at
    most ``max_bits`` differing bits, itself included."""
    rows, by_fp = _clusters(docs, id_col, text_col, shingle_words, max_bits)
    return rows.join(by_fp.drop("root"), "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             shingle_words: int = 4, max_bits: int = 4) -> DataFrame:
    """The rows of ``docs``, all columns, without near-duplicates: of every group
    the document with the smallest id stays, once if its row is repeated; of texts of
    a group that share that id, the one with the smallest hash.  Texts of different
    groups that share an id each stay.  Rows without an id can't be named as a copy
    and stay."""
    rows, by_fp = _clusters(docs, id_col, text_col, shingle_words, max_bits)
    first = rows.where("id IS NOT NULL").join(by_fp, "fp").groupBy("root").agg(F.min(F.struct("id", "t")).alias("f"))
    stay = write_table(first.select("f.id", "f.t").distinct(), "simhash-kept")
    keyed = docs.withColumns({"__id": F.col(id_col).cast("long"), "__t": _text_id(text_col)})
    kept = keyed.join(stay, (F.col("__id") == stay["id"]) & (F.col("__t") == stay["t"]), "left_semi")
    return kept.dropDuplicates(["__id", "__t"]).select(*docs.columns).union(docs.where(F.col(id_col).cast("long").isNull()))
