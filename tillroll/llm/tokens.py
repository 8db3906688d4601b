"""Token ids in training order: packed sequences, a keyed permutation, fixed-stride shards.

Texts are encoded with a given byte-level vocabulary, ended by an end token, and
packed one after the other into sequences of ``seq_len`` ids within each input
partition; only a partition's last sequence is padded, with end tokens.  Sequences
are numbered by partition and position.  A keyed Feistel network over the next
even number of bits, walked until it falls inside the range, maps each number to
its global slot, a permutation without a table.  Slots are cut into ranges of
``shard_seqs``; each range is one file in which slot ``s`` starts at byte
``(s - first) * 2 * seq_len``.  A reader resumes at any slot by that offset.

Encoded sequences are a written table, so numbers and slots survive a lost
executor.  A shard's file is named after the task attempt that wrote it; the
result names the file of the attempt that succeeded.

Results for odd input: a null or empty text is a lone end token; rows without an
id are encoded and carry a null in the list of ids; repeated rows are encoded each
time; an empty table makes no shard and gives an empty table; other columns are
ignored.  Texts are ordinary text throughout: no string in them becomes a special
token.
"""

from __future__ import annotations

import base64
import os
import re
import uuid
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import scratch_path, small_batches, write_table

TOKENIZERS = "/opt/tokenizers"
VOCABULARY, END = "byte_bpe_multi_50k.tiktoken", 50256
SEQ_LEN, SHARD_SEQS = 1024, 16384
KEY = 0x5EED
#: Tasks that write shards, however many shards there are.
WRITE_TASKS = 8192
#: Characters after which a text is cut at the next space that follows a word.
PIECE_CHARS = 1 << 16
#: How the vocabulary splits text before merging: a fixed value that belongs to it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CUT = re.compile(r"(?<=\S) ")


def vocabulary(folder: str = TOKENIZERS, name: str = VOCABULARY) -> bytes:
    with open(os.path.join(folder, name), "rb") as f:
        return f.read()


class Encoder:
    """Byte-level ids of a text as little-endian uint16.

    A space after a word always begins a piece, so a long text is cut there and its
    parts are encoded one by one: the list of ids held at a time stays small."""

    def __init__(self, ranks: bytes) -> None:
        import tiktoken
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})

    def whole(self, text: str) -> bytes:
        return array("H", self.encoding.encode_ordinary(text)).tobytes()

    def encode(self, text: str) -> bytes:
        out, start = [], 0
        while len(text) - start > PIECE_CHARS and (cut := _CUT.search(text, start + PIECE_CHARS)):
            out.append(self.whole(text[start:cut.start()]))
            start = cut.start()
        out.append(self.whole(text[start:]))
        return b"".join(out)


@lru_cache(maxsize=1)
def encoder(ranks: bytes) -> Encoder:
    """The worker's encoder, made for its first task."""
    return Encoder(ranks)


def feistel(index: np.ndarray, n: int, key: int = KEY, rounds: int = 6) -> np.ndarray:
    """The slots of ``index`` (each below ``n``) in the keyed permutation of [0, n)."""
    if n <= 1:
        return np.zeros(len(index), np.int64)
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    x, out = index.astype(np.uint64), np.empty(len(index), np.int64)
    todo = np.arange(len(index))
    while len(todo):
        left, right = x >> shift, x & mask
        for r in range(rounds):
            f = right * np.uint64(0x9E3779B97F4A7C15) + np.uint64((key * 0xC2B2AE3D27D4EB4F + r * 0x165667B19E3779F9) % (1 << 64))
            f ^= f >> np.uint64(29)
            f *= np.uint64(0xBF58476D1CE4E5B9)
            f ^= f >> np.uint64(32)
            left, right = right, left ^ (f & mask)
        x = (left << shift) | right
        inside = x < np.uint64(n)
        out[todo[inside]] = x[inside].astype(np.int64)
        todo, x = todo[~inside], x[~inside]  # walk the cycle until it comes back into the range
    return out


def pack_sequences(docs: DataFrame, id_col: str, text_col: str, seq_len: int, ranks: bytes) -> DataFrame:
    """(part, at, n, ids, n_tokens, z): runs of sequences; ``at`` is the run's
    first position in its partition, ``n`` its sequences, ``z`` their compressed
    ids, ``ids`` the documents of each and ``n_tokens`` its ids that are not padding."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    width, run_seqs = 2 * seq_len, 256
    end = np.array([END], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, part, z = encoder(shared.value), TaskContext.get().partitionId(), zstandard.ZstdCompressor(level=6)
        buffer, at = bytearray(), 0
        owners: list[tuple[int, int | None]] = []  # (end offset in the buffer, document)

        def out(seqs: int, last: bool) -> pa.RecordBatch:
            nonlocal at, owners
            tokens = [seq_len] * seqs
            if last and len(buffer) < seqs * width:
                tokens[-1] = (len(buffer) - (seqs - 1) * width) // 2
                buffer.extend(end * ((seqs * width - len(buffer)) // 2))
            ids, k = [], 0
            for s in range(seqs):
                mine = []
                while k < len(owners):
                    mine.append(owners[k][1])
                    if owners[k][0] > (s + 1) * width:
                        break
                    k += 1
                ids.append(mine)
            cut = seqs * width
            batch = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([at], pa.int64()), pa.array([seqs], pa.int32()),
                 pa.array([ids], pa.list_(pa.list_(pa.int64()))), pa.array([tokens], pa.list_(pa.int32())),
                 pa.array([z.compress(bytes(buffer[:cut]))], pa.binary())],
                names=["part", "at", "n", "ids", "n_tokens", "z"])
            del buffer[:cut]
            owners = [(e - cut, d) for e, d in owners if e > cut]
            at += seqs
            return batch

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                buffer += texts.encode(text or "")
                buffer += end
                owners.append((len(buffer), doc))
                while len(buffer) >= run_seqs * width:
                    yield out(run_seqs, False)
        if buffer:
            yield out(-(-len(buffer) // width), True)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "part int, at long, n int, ids array<array<bigint>>, n_tokens array<int>, z binary")


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if re.match(r"[a-z][a-z0-9+.-]*:/", path) else f"file://{path}")


RESULT = "slot long, doc_ids array<bigint>, n_tokens int, shard int, path string, offset long, length int"


def materialise(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                seq_len: int = SEQ_LEN, shard_seqs: int = SHARD_SEQS, key: int = KEY,
                ranks: bytes | None = None, write_tasks: int = WRITE_TASKS) -> DataFrame:
    """Writes the shards under ``folder`` (default: a fresh shared one), in at most
    ``write_tasks`` tasks, and returns a row per sequence: slot, doc_ids (documents
    it holds, in order), n_tokens (without padding), shard, path, offset and length
    in bytes."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or scratch_path(spark, "shards")
    runs = write_table(pack_sequences(docs, id_col, text_col, seq_len, ranks or vocabulary()), "sequences")
    per_part = runs.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()  # a row for each partition
    offsets, total = {}, 0
    for r in per_part:
        offsets[r["part"]] = total
        total += r["n"]
    width = 2 * seq_len
    shards = -(-total // shard_seqs)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part, at, n, ids, n_tokens, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = zstandard.ZstdDecompressor().decompress(packed)
                slots = feistel(offsets[part] + at + np.arange(n), total, key)
                shard = slots // shard_seqs
                order = np.argsort(shard, kind="stable")
                cuts = np.flatnonzero(np.diff(shard[order])) + 1
                groups = np.split(order, cuts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(shard[g[0]]) for g in groups], pa.int32()),
                     pa.array([slots[g] for g in groups], pa.list_(pa.int64())),
                     pa.array([[ids[i] for i in g] for g in groups], pa.list_(pa.list_(pa.int64()))),
                     pa.array([[n_tokens[i] for i in g] for g in groups], pa.list_(pa.int32())),
                     pa.array([z.compress(b"".join(data[i * width:(i + 1) * width] for i in g)) for g in groups], pa.binary())],
                    names=["shard", "slots", "ids", "n_tokens", "z"])

    dealt = runs.mapInArrow(deal, "shard int, slots array<bigint>, ids array<array<bigint>>, n_tokens array<int>, z binary")
    # a shard's task follows from its number: nothing is sampled, and a task writes a range of shards one by one
    tasks = max(1, min(shards, write_tasks))
    ranged = dealt.repartitionById(tasks, F.expr(f"int(shard * {tasks}L div {max(1, shards)}L)")).sortWithinPartitions("shard")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        open_shard, data, rows = None, bytearray(), []

        def close() -> pa.RecordBatch:
            name = f"{folder}/{open_shard:08d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.bin"
            fs, path = _filesystem(name)
            fs.create_dir(path.rpartition("/")[0])
            with fs.open_output_stream(path, compression=None) as out:
                out.write(memoryview(data))
            rows.sort(key=lambda r: r[0])
            first = open_shard * shard_seqs
            slot, ids, n_tokens = zip(*rows, strict=True)
            m = len(rows)
            return pa.RecordBatch.from_arrays(
                [pa.array(slot, pa.int64()), pa.array(ids, pa.list_(pa.int64())), pa.array(n_tokens, pa.int32()),
                 pa.array([open_shard] * m, pa.int32()), pa.array([name] * m), pa.array([(s - first) * width for s in slot], pa.int64()),
                 pa.array([width] * m, pa.int32())],
                names=[f.split()[0] for f in RESULT.split(", ")])

        for batch in batches:
            for shard, slots, ids, n_tokens, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != open_shard:
                    if open_shard is not None:
                        yield close()
                    size = min(shard_seqs, total - shard * shard_seqs) * width
                    open_shard, data, rows = shard, bytearray(size), []
                got = zstandard.ZstdDecompressor().decompress(packed)
                for i, s in enumerate(slots):
                    spot = (s - shard * shard_seqs) * width
                    data[spot:spot + width] = got[i * width:(i + 1) * width]
                rows += zip(slots, ids, n_tokens, strict=True)
        if open_shard is not None:
            yield close()

    return write_table(ranged.mapInArrow(write, RESULT), "shard-rows")


def read_shard(path: str, offset: int, count: int, seq_len: int = SEQ_LEN) -> np.ndarray:
    """``count`` sequences from ``offset`` of a shard: a sequential read that may
    begin at any slot."""
    fs, name = _filesystem(path)
    with fs.open_input_file(name) as f:
        f.seek(offset)
        return np.frombuffer(f.read(count * 2 * seq_len), "<u2").reshape(-1, seq_len)
