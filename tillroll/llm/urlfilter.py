"""URL allow and block lists: a broadcast trie over reversed host labels and
path segments; the longest matching rule decides.

A rule ``(action, host, path)`` fits its host and all its subdomains when the
url's path starts with the rule's path.  In the trie a host is walked from its
last label (``com`` before ``example``), below each host hang the path's
segments; what follows a rule path's last slash is matched as a prefix of the
url's next segment.  The longest rule wins: more host labels and complete path
segments together, then more characters; block wins over allow for the same
rule.  A url that no rule fits gets the default verdict.

Results for odd input: a null url, or one without ``://``, has an empty host and
path and no rule can fit it; rows are judged one by one, so repeated rows and
null ids pass through; an empty table gives an empty table; other columns are
kept unless named like a result, which then wins.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm.common import small_batches

#: Rules that may be broadcast; above it the rules must come as a table (``judge_by_join``).
MAX_RULES = 1_000_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


class Trie:
    """Nodes are dicts: a label or segment -> node; ``None`` -> the rules that
    end here, as (rest of the path, length, text, action)."""

    def __init__(self, rules: Sequence[tuple[str, str, str]]) -> None:
        if len(rules) > MAX_RULES:
            raise ValueError(f"{len(rules)} rules are too many to broadcast; use judge_by_join")
        self.hosts: dict = {}
        for action, host, path in rules:
            if action not in ("allow", "block"):
                raise ValueError(f"unknown action {action!r}")
            labels = host.split(".") if host else []
            segments = path.split("/")
            node = self.hosts
            for label in reversed(labels):
                node = node.setdefault(label, {})
            node = node.setdefault(("path",), {})
            for s in segments[:-1]:
                node = node.setdefault(s, {})
            node.setdefault(None, []).append(
                (segments[-1], (len(labels) + len(segments) - 1, len(host) + len(path), action == "block"),
                 host + path, action))

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, action) of the longest rule that fits."""
        best = None
        segments = path.split("/")
        labels = host.split(".") if host else []
        node = self.hosts
        for depth in range(len(labels) + 1):
            at, i = node.get(("path",)), 0
            while at is not None:
                for rest, length, text, action in at.get(None, ()):
                    if segments[i].startswith(rest) and (best is None or length > best[0]):
                        best = (length, text, action)
                at = at.get(segments[i]) if i < len(segments) - 1 else None
                i += 1
            if depth == len(labels):
                break
            node = node.get(labels[len(labels) - 1 - depth])
            if node is None:
                break
        return best and best[1:]


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], url_col: str = "url",
          default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule (host and path of the rule that decides,
    null if none fits) and verdict (allow or block)."""
    spark = pages.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(Trie([r for r in rules if r[1]]))
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    split = pages.withColumns({"host": host_of(F.col(url_col).cast("string")),
                               "path": path_of(F.col(url_col).cast("string"))}).select(*keep, "host", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = shared.value.match
        for batch in batches:
            found = [match(h, p) for h, p in zip(batch.column(len(keep)).to_pylist(),
                                                 batch.column(len(keep) + 1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([f and f[0] for f in found], pa.string()),
                 pa.array([f[1] if f else default for f in found], pa.string())],
                names=[*batch.schema.names, "rule", "verdict"])

    schema = T.StructType([*split.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])
    return split.mapInArrow(run, schema)


def judge_by_join(pages: DataFrame, rules: DataFrame, url_col: str = "url", id_col: str = "page_id",
                  default: str = "allow") -> DataFrame:
    """The same verdicts for rule lists of any size: ``rules`` (action, host,
    path) meets every (host suffix, path) of a url in a join; ids must be unique.
    Returns (id, rule, verdict)."""
    urls = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    suffixes = urls.select("id", "path", F.split("host", r"\.").alias("labels")).select(
        "id", "path", F.explode(F.expr("transform(sequence(1, size(labels)), i -> array_join(slice(labels, i, size(labels)), '.'))")).alias("suffix"))
    rule = rules.where("host <> ''").select(
        F.col("host").alias("suffix"), F.col("path").alias("rule_path"), "action",
        F.struct((F.size(F.split("host", r"\.")) + F.size(F.split("path", "/")) - 1).alias("parts"),
                 (F.length("host") + F.length("path")).alias("chars"), (F.col("action") == "block").alias("blocks"),
                 F.concat("host", "path").alias("text"), F.col("action").alias("verdict")).alias("rank"))
    best = (suffixes.join(rule, "suffix").where(F.startswith("path", "rule_path"))
            .groupBy("id").agg(F.max("rank").alias("rank")))
    return urls.join(best, "id", "left").select(
        F.col("id").alias(id_col), F.col("rank.text").alias("rule"),
        F.coalesce("rank.verdict", F.lit(default)).alias("verdict"))
