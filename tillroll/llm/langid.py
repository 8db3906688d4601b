"""Language identification by compression.

Each language has a zstandard raw-content dictionary made of sampled labelled
text.  A text (lower-case, everything but letters as single spaces) is compressed
once with every dictionary; the language whose dictionary makes it smallest is
the prediction, and it is rejected when the runner-up comes too close.  The model is the dictionaries: at most
``MODEL_BYTES`` together, taken from at most ``SAMPLE_ROWS`` texts of each
language with ``SAMPLE_CHARS`` characters each; every whole text is predicted.

Results for odd input: a null text, or one without a letter, is ``und`` with
score 0; ties go to the language with more labelled texts, then to the name that
sorts first; without any labelled
text all rows are ``und``; rows are judged one by one, so repeated rows and null
ids pass through; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.common import small_batches

UNKNOWN = "und"
#: Labelled texts of each language that may be sampled, and characters of each.
SAMPLE_ROWS, SAMPLE_CHARS = 300, 2000
#: Bytes of all dictionaries together, and of one at most.
MODEL_BYTES, DICTIONARY_BYTES = 8 << 20, 192 << 10
#: Level for most texts; short ones, in which each match counts, get the slow search.
LEVEL, SHORT_LEVEL, SHORT_BYTES = 5, 19, 2000

_OTHER = re.compile(r"[\W\d_]+")


@dataclass
class Model:
    """``languages``: dictionary and number of labelled texts of each."""

    languages: dict[str, tuple[bytes, int]]

    def compressors(self, level: int) -> list[tuple[int, str, zstandard.ZstdCompressor]]:
        """(rank, language, compressor): more labelled texts first."""
        made = []
        for lang, (content, _) in sorted(self.languages.items(), key=lambda x: (-x[1][1], x[0])):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            made.append((len(made), lang, zstandard.ZstdCompressor(
                dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)))
        return made


def folded(text: str) -> bytes:
    return _OTHER.sub(" ", f" {text.lower()} ").encode("utf-8", "surrogatepass")


def sample(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS,
           chars: int = SAMPLE_CHARS) -> DataFrame:
    """(lang, text, rank): up to ``rows`` labelled texts of each language, in an
    order that depends on the text alone."""
    text = F.col(text_col).cast("string")
    labelled = docs.where(F.col(lang_col).isNotNull() & (F.length(F.trim(text)) > 0)).select(
        F.col(lang_col).cast("string").alias("lang"), F.substring(text, 1, chars).alias("text"),
        F.xxhash64(text).alias("h"))
    order = Window.partitionBy("lang").orderBy("h", "text")
    return labelled.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= rows).select("lang", "text", "rank")


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS,
          chars: int = SAMPLE_CHARS) -> Model:
    """Dictionaries from the labelled rows of ``docs`` (null languages are left out)."""
    small_batches(docs.sparkSession)
    parts: dict[str, list[bytes]] = {}
    counts = dict(docs.where(F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).cast("string")).count().collect())
    for r in sample(docs, text_col, lang_col, rows, chars).orderBy("lang", "rank").toLocalIterator():
        parts.setdefault(r["lang"], []).append(folded(r["text"]))
    each = min(DICTIONARY_BYTES, MODEL_BYTES // max(1, len(parts)))
    return Model({lang: (b"".join(texts)[:each], counts[lang]) for lang, texts in parts.items()})


def _letters(text: str) -> bool:
    return next(filter(str.isalpha, text), None) is not None


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
            margin: float = 0.01, extra: dict[str, Column] | None = None) -> DataFrame:
    """(id, ``extra`` columns, lang, lang_pred, score, margin): ``lang_pred`` is
    the best language, ``lang`` the same or ``und`` where the prediction is
    rejected; ``margin`` is by how much of its size the runner-up is larger,
    ``score`` the best language's share when a byte less counts e times as much."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    extra = extra or {}
    rows = docs.select(F.col(id_col), *[c.alias(k) for k, c in extra.items()],
                       F.col(text_col).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools, slow = shared.value.compressors(LEVEL), shared.value.compressors(SHORT_LEVEL)
        for batch in batches:
            best, kept, scores, margins = [], [], [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                if not tools or text is None or not _letters(text):
                    best.append(UNKNOWN), kept.append(UNKNOWN), scores.append(0.0), margins.append(0.0)
                    continue
                data = folded(text)
                sizes = [(len(z.compress(data)), rank, lang)
                         for rank, lang, z in (slow if len(data) < SHORT_BYTES else tools)]
                low, _, lang = min(sizes)
                wide = (min((s for s, _, x in sizes if x != lang), default=2 * low) - low) / low
                best.append(lang), kept.append(lang if wide >= margin else UNKNOWN), margins.append(wide)
                scores.append(1 / sum(math.exp(low - s) for s, _, _ in sizes))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(kept, pa.string()), pa.array(best, pa.string()),
                 pa.array(scores, pa.float64()), pa.array(margins, pa.float64())],
                names=[*batch.schema.names[:-1], "lang", "lang_pred", "score", "margin"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{schema}, lang string, lang_pred string, score double, margin double")
