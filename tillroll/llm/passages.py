"""Passages that documents share, located by repeated-phrase automata.

A window is ``width`` words in a row; a passage is a string of words made of windows
that occur in two documents or more.

1. Anchors: the gram of ``gram`` words with the least hash (leftmost, if equal) of
   each window.  The windows that share an anchor form a stretch; equal windows
   have equal anchors at the same place, so only stretches with equal anchors are
   compared, one in some twenty words.  Equal stretches are one entry with its
   first document and its last.
2. Passages are confirmed: a stretch that is the only one of its anchor recurs
   whole, if it lies in two documents.  Where an anchor has several stretches, the
   windows of each are counted by their hash; those of two documents or more that
   lie in the same stretches are one passage.  Its first document is known then.
3. Aho-Corasick automata are compiled from the passages, in shards by anchor of
   ``SHARD_WORDS`` words, two letters a word.
4. The words of all documents around the anchors that recur stream through the
   shard of their anchor, equal stretches once; every passage inside is located.
   An anchor with over ``SALTED`` stretches or passages is dealt over several
   shards, each pair of parts meeting once.
5. What is located in a stretch holds at all its places: a word goes if a located
   passage covers it whose first document is smaller than its own.

Results for odd input: a null text has no words; documents shorter than ``width``
words share nothing; rows without an id come after all others, as one document;
rows that share an id count as one document, so that they do not remove each
other's words; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import binary_values, small_batches, write_table

WIDTH, GRAM = 50, 8
#: Words of the passages of one automaton: some 180 bytes of memory each.
SHARD_WORDS = 300_000
#: Stretches, and passages, of one anchor that share a shard.
SALTED = 5_000
#: Windows of a text whose anchors are sought at once (below 2 ** 20).
CHUNK = 1 << 18
LAST_KEY = (1 << 63) - 1

_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_PLACE = np.uint64((1 << 20) - 1)


def _slide_min(x: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while step * 2 <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    rest = width - step
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def stretches(hashes: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor hash, anchor place, first window, last window) of the stretches of a
    text given by the hashes of its words."""
    windows = len(hashes) - width + 1
    if windows < 1:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    h, at = [], []
    for a in range(0, windows, CHUNK):
        b = min(a + CHUNK, windows)
        x = hashes[a:b + width - 1]
        n = len(x) - gram + 1
        g = np.zeros(n, np.uint64)
        for i in range(gram):
            g = g * _ODD + x[i:i + n]
        g = (g ^ (g >> np.uint64(31))) * _MIX
        # the place in the low bits: of equal grams the leftmost is least
        least = _slide_min((g & ~_PLACE) | np.arange(n, dtype=np.uint64), width - gram + 1)
        p = (least & _PLACE).astype(np.int64)
        h.append(g[p])
        at.append(p + a)
    h, at = np.concatenate(h), np.concatenate(at)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:], [windows]]) - 1
    return h[first], at[first], first, last


def _signed(values) -> np.ndarray:
    return np.asarray(values, np.uint64).view(np.int64)


class _Hashes:
    """Hashes of words; a word's is computed once a batch."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def of(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


_PLACES = "h long, c long, key long, t long, pos long, lead int, size int"


def _places(width: int, gram: int):
    """Texts to stretches: anchor, stretch, document, text, first word, words before
    the anchor, words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = _Hashes()
            out: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), binary_values(batch.column(1)), strict=True):
                words = text.split()
                h, at, first, last = stretches(hashes.of(words), width, gram)
                if not len(h):
                    continue
                line = b" ".join(words)
                starts = np.cumsum([0] + [len(w) + 1 for w in words])
                size, lead = last - first + width, at - first
                c = [xxhash.xxh3_64_intdigest(line[a:b], s) for a, b, s in
                     zip(starts[first].tolist(), (starts[first + size] - 1).tolist(), lead.tolist(), strict=True)]
                out.append((h, c, np.full(len(h), key), np.full(len(h), xxhash.xxh64_intdigest(text), np.uint64), first, lead, size))
            if out:
                h, c, key, t, pos, lead, size = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_signed(h)), pa.array(_signed(c)), pa.array(key), pa.array(_signed(t)), pa.array(pos),
                     pa.array(lead.astype(np.int32)), pa.array(size.astype(np.int32))],
                    names=["h", "c", "key", "t", "pos", "lead", "size"])

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        texts = binary_values(batch.column(1))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(_signed([xxhash.xxh64_intdigest(t) for t in texts] or np.zeros(0))),
             pa.array([z.compress(t) for t in texts], pa.binary())], names=["key", "t", "z"])


def _packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, t, z): order key, text id and compressed text of every row."""
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_KEY)).alias("key"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return keyed.mapInArrow(_pack, "key long, t long, z binary")


def _unpack(z: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(z).split()


_PIECES = "h long, c long, key long, last long, lead int, many boolean, words binary"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with wanted stretches to the words of these; of rows with equal key and
    text in a row the first is enough."""
    types = [pa.int64()] * 4 + [pa.int32(), pa.bool_(), pa.binary()]
    done = None
    for batch in batches:
        rows: list[tuple] = []
        for key, t, z, at in zip(*(batch.column(i) for i in range(4)), strict=True):
            key = key.as_py()
            if (key, t.as_py()) == done:
                continue
            done = key, t.as_py()
            words = _unpack(z.as_py())
            rows.extend((p["h"], p["c"], key, p["last"], p["lead"], p["many"], b" ".join(words[p["pos"]:p["pos"] + p["size"]]))
                        for p in at.as_py())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, ty) for x, ty in zip(zip(*rows, strict=True), types, strict=True)],
                                             names=[f.split()[0] for f in _PIECES.split(", ")])


def _windows(width: int):
    """Stretches (c, key, last, lead, words) to their windows: hash, words before the
    anchor, first and last document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                w, at, before = [], [], []
                for n, (lead, text) in enumerate(zip(part.column(4).to_pylist(), binary_values(part.column(5)), strict=True)):
                    ends = [len(x) + 1 for x in text.split(b" ")]
                    starts = np.cumsum([0, *ends]).tolist()
                    m = len(ends) - width + 1
                    w.extend(xxhash.xxh3_64_intdigest(text[starts[j]:starts[j + width] - 1]) for j in range(m))
                    at.extend([n] * m)
                    before.extend(range(lead, lead - m, -1))
                at = pa.array(at, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_signed(w or np.zeros(0))), pa.array(before, pa.int32()), *(part.column(x).take(at) for x in range(4))],
                    names=["w", "before", "h", "c", "key", "last"])

    return run


_ROWS = "shard long, kind int, h long, c long, lead int, first long, words binary"


class _Automaton:
    """Passages as an Aho-Corasick automaton over two letters a word."""

    def __init__(self, passages: list[tuple[bytes, int]]) -> None:
        vocabulary = dict.fromkeys(w for p, _ in passages for w in p.split(b" "))
        side = int(len(vocabulary) ** 0.5) + 1
        # first letters below second ones, so that a match begins with a word
        self._letters = {w: chr(1 + i // side) + chr(1 + side + i % side) for i, w in enumerate(vocabulary)}
        self._first = [first for _, first in passages]
        self._size = [p.count(b" ") + 1 for p, _ in passages]
        self._found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, (p, _) in enumerate(passages):
            self._found.add_word(self._spell(p.split(b" ")), i)
        self._found.make_automaton()

    def _spell(self, words: list[bytes]) -> str:
        get = self._letters.get
        return "".join([get(w, "\0\0") for w in words])

    def locate(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(start, end, first document) of every passage in ``words``."""
        out = []
        for last, i in self._found.iter(self._spell(words)):
            end = (last + 1) // 2
            out.append((end - self._size[i], end, self._first[i]))
        return out


_LOCATED = "h long, c long, lead int, spans array<struct<start: int, stop: int, first: long>>"


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (shard, kind): passages first (kind 0), then the stretches that
    stream through their automaton."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("first", pa.int64())]))
    shard, passages, automaton = None, {}, None
    for batch in batches:
        out: list[tuple] = []
        for at, kind, h, c, lead, first, words in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if at != shard:
                shard, passages, automaton = at, {}, None
            if kind == 0:
                passages[words] = first
                continue
            if automaton is None:
                if not passages:
                    continue
                automaton, passages = _Automaton(list(passages.items())), {}
            spans = automaton.locate(words.split(b" "))
            if spans:
                out.append((h, c, lead, [{"start": s, "stop": e, "first": f} for s, e, f in spans]))
        if out:
            h, c, lead, spans = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h, pa.int64()), pa.array(c, pa.int64()), pa.array(lead, pa.int32()), pa.array(spans, span)],
                names=["h", "c", "lead", "spans"])


def shared_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    width: int = WIDTH, gram: int = GRAM, shard_words: int = SHARD_WORDS, salted: int = SALTED) -> DataFrame:
    """(key, t, start, stop, first): word spans [start, stop) of every text ``t`` of
    document ``key`` that are located passages, with the smallest document that holds
    the passage; the place in that document comes too."""
    small_batches(docs.sparkSession)
    if not 1 <= gram <= width or width - gram + 1 >= 1 << 20:
        raise ValueError("gram must lie between 1 and width")
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_KEY)).alias("key"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    places = write_table(keyed.mapInArrow(_places(width, gram), _PLACES), "passages-places")
    units = places.groupBy("h", "c").agg(F.min(F.struct("key", "t", "pos")).alias("f"), F.max("key").alias("last"),
                                         F.first("lead").alias("lead"), F.first("size").alias("size"))
    units = write_table(units, "passages-units")
    anchors = units.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.min("f.key").alias("a"), F.max("last").alias("b")).where("a < b")
    live = units.join(anchors.select("h", "k"), "h").select(
        "f.key", "f.t", F.struct("h", "c", "last", "lead", "f.pos", "size", (F.col("k") > 1).alias("many")).alias("at"))
    wanted = live.groupBy("key", "t").agg(F.collect_list("at").alias("at"))
    pieces = write_table(_packed(docs, id_col, text_col).join(wanted, ["key", "t"]).select("key", "t", "z", "at")
                         .mapInArrow(_pieces, _PIECES), "passages-pieces")

    # confirmed: windows of two documents; those of the same stretches are one passage
    windows = pieces.where("many").select("h", "c", "key", "last", "lead", "words").mapInArrow(
        _windows(width), "w long, before int, h long, c long, key long, last long")
    recur = windows.groupBy("h", "w").agg(
        F.min(F.struct("key", "c")).alias("f"), F.max("last").alias("last"), F.first("before").alias("before"),
        F.sum(F.col("c").bitwiseAND(0x7FFFFFFF)).alias("s1"), F.sum(F.shiftrightunsigned("c", 33)).alias("s2")).where("f.key < last")
    passages = write_table(recur.groupBy("h", "s1", "s2", "f").agg(
        F.max("before").alias("most"), F.min("before").alias("least")), "passages-confirmed")
    inside = passages.groupBy("h", F.col("f.c").alias("c")).agg(F.collect_list(F.struct("most", "least")).alias("parts"))

    # an anchor's passages and stretches meet in its shard, or in one for each pair of parts
    size = passages.agg(F.sum(F.col("most") - F.col("least") + width)).first()[0] or 0
    size += pieces.where("NOT many").agg(F.sum(F.size(F.split(F.col("words").cast("string"), " ")))).first()[0] or 0
    shards = 1 + size // shard_words
    hot = pieces.where("many").groupBy("h").agg(F.count(F.lit(1)).alias("n")).join(
        passages.groupBy("h").agg(F.count(F.lit(1)).alias("m")), "h").where((F.col("n") > salted) | (F.col("m") > salted))
    hot = write_table(hot.select("h", F.ceil(F.col("n") / salted).cast("int").alias("piece_parts"),
                                 F.ceil(F.col("m") / salted).cast("int").alias("passage_parts")), "passages-hot")
    part = lambda name: F.coalesce(name, F.lit(1))
    shard = F.pmod(F.xxhash64("h", "piece_part", "passage_part"), F.lit(shards))
    names = ["shard", "kind", "h", "c", "lead", "first", "words"]
    whole = pieces.where("NOT many").select(
        "h", "c", "lead", F.col("key").alias("first"), "words", F.lit(0).alias("piece_part"), F.lit(0).alias("passage_part"))
    cut = (pieces.where("many").join(inside, ["h", "c"]).join(hot, "h", "left")
           .select("h", "c", "lead", F.col("key").alias("first"), F.split(F.col("words").cast("string"), " ").alias("split"),
                   "piece_parts", "passage_parts", F.explode("parts").alias("p"))
           .select("h", "c", "lead", "first", F.array_join(F.slice(
               "split", F.col("lead") - F.col("p.most") + 1, F.col("p.most") - F.col("p.least") + width), " ").cast("binary").alias("words"),
               "piece_parts", "passage_parts")
           .withColumn("passage_part", F.pmod(F.xxhash64("words"), part("passage_parts")).cast("int"))
           .withColumn("piece_part", F.explode(F.sequence(F.lit(0), part("piece_parts") - 1)))
           .select("h", "c", "lead", "first", "words", "piece_part", "passage_part"))
    streamed = (pieces.where("many").join(hot, "h", "left").select(
        "h", "c", "lead", F.col("key").alias("first"), "words",
        F.pmod(F.xxhash64("c"), part("piece_parts")).cast("int").alias("piece_part"),
        F.explode(F.sequence(F.lit(0), part("passage_parts") - 1)).alias("passage_part")).union(whole))
    rows = (cut.union(whole).withColumn("kind", F.lit(0)).union(streamed.withColumn("kind", F.lit(1)))
            .withColumn("shard", shard).select(*names))
    located = write_table(rows.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(_locate, _LOCATED),
                          "passages-located")
    # what is located in a stretch holds at each of its places; hot stretches are dealt by AQE's skew join
    spans = located.groupBy("h", "c").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return (places.select("h", "c", "key", "t", "pos").join(spans, ["h", "c"])
            .select("key", "t", "pos", F.explode("spans").alias("s"))
            .select("key", "t", (F.col("pos") + F.col("s.start")).alias("start"), (F.col("pos") + F.col("s.stop")).alias("stop"),
                    F.col("s.first").alias("first")))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for key, z, spans in zip(*batch.columns, strict=True):
            words = _unpack(z.as_py())
            kept, at = [], 0
            for s in sorted((s["start"], s["stop"]) for s in spans.as_py() or []):
                if s[0] > at:
                    kept.extend(words[at:s[0]])
                at = max(at, s[1])
            kept.extend(words[at:])
            out.append((key.as_py(), len(words), len(words) - len(kept), b" ".join(kept)))
        k, n, r, b = zip(*out, strict=True) if out else ([], [], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(b, pa.binary())],
                                         names=["key", "n_words", "n_removed", "kept"])


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(``id_col``, n_words, n_removed, kept): every row's words, joined by one space,
    without those that a passage covers which a smaller document holds too."""
    spans = shared_passages(docs, id_col, text_col, width, gram).where("first < key").groupBy("key", "t").agg(
        F.collect_set(F.struct("start", "stop")).alias("spans"))
    cut = _packed(docs, id_col, text_col).join(spans, ["key", "t"], "left").select("key", "z", "spans").mapInArrow(
        _cut, "key long, n_words long, n_removed long, kept binary")
    return cut.select(F.when(F.col("key") != LAST_KEY, F.col("key")).alias(id_col), "n_words", "n_removed", "kept")
