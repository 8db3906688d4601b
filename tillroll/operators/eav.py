"""Entity-attribute-value pivot.

The shop export keeps every measure as text rows (entity id, key, value).
The original statements join the value table once per key (2-3 self joins
per query).  Here all keys an entity needs are pivoted in ONE grouped
aggregation: filter to the wanted keys (pushed to the scan), shuffle by the
entity id with map-side partial aggregation, and emit one column per key.

Duplicate rows of a key add up for amounts (what a one-key SUM does);
identifiers (bigint keys) and text keys keep the greatest value.  A missing
key is null.  ``duplicate_keys`` lists the rows that would add up; the pivot
reports them itself with ``repeated``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.numbers import coercion_counts, mysql_number, saturated


def eav_pivot(meta: DataFrame, id_col: str | list[str], numeric: dict[str, tuple[str, str]] | None = None,
              text: dict[str, str] | None = None, key_col: str = "meta_key",
              value_col: str = "meta_value", checks: Observation | None = None, repeated: str | None = None) -> DataFrame:
    """(id, one column per key); an id may be several columns.

    ``numeric`` maps key -> (column name, Spark type) with MySQL text
    coercion; ``text`` maps key -> column name (raw text kept).  Both checks run in
    the pivot's own pass: ``checks`` observes what the coercion met in the numeric
    keys (``coercion_counts``), and ``repeated`` names a column with the keys that
    the entity has more than once, as a map to their number (null if none).
    """
    numeric, text = numeric or {}, text or {}
    keys = list(numeric) + list(text)
    key, value = F.col(key_col), F.col(value_col)
    # coerced once a row, whatever the number of keys: small generated code
    types = sorted({dtype for _, dtype in numeric.values()})
    of_type = {t: [k for k, (_, dtype) in numeric.items() if dtype == t] for t in types}
    wanted = meta.filter(key.isin(keys))
    if checks is not None:
        counted = F.when(key.isin(list(numeric)), value)
        wanted = wanted.observe(checks, *[c.alias(name) for name, c in coercion_counts(counted).items()])
    ids = [id_col] if isinstance(id_col, str) else list(id_col)
    m = wanted.select(
        *ids, key.alias("_key"), *([value.alias("_text")] if text else []),
        *[F.when(key.isin(of_type[t]), mysql_number(value, t)).alias(f"_{i}") for i, t in enumerate(types)])
    aggs = [saturated((F.max if dtype == "bigint" else F.sum)(F.when(F.col("_key") == k, F.col(f"_{types.index(dtype)}"))), dtype).alias(name)
            for k, (name, dtype) in numeric.items()]
    aggs += [F.max(F.when(F.col("_key") == k, F.col("_text"))).alias(name) for k, name in text.items()]
    if repeated is None:
        return m.groupBy(*ids).agg(*aggs)
    counts = [F.count(F.when(F.col("_key") == k, 1)).alias(f"_n{i}") for i, k in enumerate(keys)]
    pairs = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), F.col(f"_n{i}").alias("n")) for i, k in enumerate(keys)]),
                     lambda p: p["n"] > 1)
    wide = m.groupBy(*ids).agg(*aggs, *counts)
    return wide.withColumn(repeated, F.when(F.size(pairs) > 0, F.map_from_entries(pairs))).drop(*[f"_n{i}" for i in range(len(keys))])


def duplicate_keys(meta: DataFrame, id_col: str, keys: list[str], key_col: str = "meta_key") -> DataFrame:
    """(id, key, n): the entities that have one of ``keys`` more than once.  The
    original's joins multiply such rows; an export should have none."""
    return (meta.filter(F.col(key_col).isin(list(keys))).groupBy(id_col, key_col)
            .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1))
