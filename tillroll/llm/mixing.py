"""Mixing sources to target weights, with DataFrame functions only.

Every source gets the weight of its token share raised to an exponent.  The
exponent is bisected until the weights meet a target: the least exponent (the
flattest mix) that repeats no source more than ``max_repeats`` times, or the
largest that reaches a target entropy.  One pass over the table of sources tries
31 exponents, five halvings at once.  The weights times the token budget are each
source's quota, and the quota is dealt as permutations of the source's documents:
whole ones while the quota lasts, then the beginning of another, cut in the block
of its order in which the quota ends.  Without a budget it is the smallest that
passes every document at least once.

A permutation is the order of a keyed hash.  It is cut into ``BLOCKS`` equal
ranges of the hash; block sums find where a quota ends, and only that block's
documents are added up one by one, so a source with a third of all rows needs no
task that holds it.

Results for odd input: documents without a source are one source of their own;
null or empty texts count as one token; repeated rows are rows of their own, dealt
alike; a single source has weight 1; an empty table gives an empty table; columns
named like a result give way to it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.common import write_table

BLOCKS = 4096
MAX_REPEATS = 2.0
SEED = 20240101
_PASSES, _POINTS = 8, 31


def tokens_of(text: Column) -> Column:
    """Words, one at least: the unit of shares and quotas."""
    return F.greatest(F.lit(1), F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))).cast("long")


def _source(col: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(col).cast("string")), F.lit(""))


@dataclass(frozen=True)
class Mix:
    """The exponent, the tokens of the corpus and the budget that was met."""

    exponent: float
    tokens: int
    budget: float


def _search(sources: DataFrame, holds, lowest: float, highest: float, want_low: bool) -> float:
    """The end of the interval at which the monotone condition ``holds`` (a
    function of exponent -> aggregate boolean column) turns, to about 1e-12."""
    lo, hi = lowest, highest
    for _ in range(_PASSES):
        points = [lo + (hi - lo) * i / (_POINTS + 1) for i in range(1, _POINTS + 1)]
        got = sources.agg(*[holds(a).alias(f"a{i}") for i, a in enumerate(points)]).first()
        good = [a for i, a in enumerate(points) if got[i]]
        bad = [a for i, a in enumerate(points) if not got[i]]
        if want_low:
            lo, hi = max(bad, default=lo), min(good, default=hi)
        else:
            lo, hi = max(good, default=lo), min(bad, default=hi)
    return hi if want_low else lo


def solve(sources: DataFrame, budget: int | None = None, max_repeats: float | None = MAX_REPEATS,
          target_entropy: float | None = None) -> Mix | None:
    """``sources`` (tokens) -> the exponent in [0, 1] and the budget; None for no
    tokens.  ``target_entropy`` is a share of the entropy of equal weights.  As the
    exponent grows, repetition and entropy fall: the first target bounds it from
    below, the second from above.  The end that its target sets is taken, of both
    the larger one.  Targets that no exponent meets are an error."""
    head = sources.agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"), F.max("tokens").alias("top")).first()
    if not head["t"]:
        return None
    total, n, top = int(head["t"]), int(head["n"]), int(head["top"])
    p = F.col("tokens") / F.lit(float(total))

    def repeats(a: float) -> Column:
        rate = F.pow(p, F.lit(a - 1.0))
        if budget is None:  # the largest source passes once
            return F.max(rate) / F.lit((top / total) ** (a - 1.0))
        return F.max(rate) / F.sum(F.pow(p, F.lit(a))) * F.lit(budget / total)

    def entropy(a: float) -> Column:
        z = F.sum(F.pow(p, F.lit(a)))
        return F.ln(z) - F.lit(a) * F.sum(F.pow(p, F.lit(a)) * F.ln(p)) / z

    least, most = 0.0, 1.0
    if max_repeats is not None:
        least = _search(sources, lambda a: repeats(a) <= max_repeats, 0.0, 1.0, True)
    if target_entropy is not None:
        most = _search(sources, lambda a: entropy(a) >= target_entropy * math.log(n) - 1e-12, 0.0, 1.0, False)
    exponent = least if target_entropy is None else most
    got = sources.agg(repeats(exponent).alias("repeats"), entropy(exponent).alias("entropy")).first()
    if max_repeats is not None and got["repeats"] > max_repeats * (1 + 1e-6):
        raise ValueError(f"no mix keeps within {max_repeats} repeats" + (
            "" if target_entropy is None else f" at {target_entropy} of the entropy") + f": {got['repeats']:.4g} at exponent {exponent:.4g}")
    if target_entropy is not None and got["entropy"] < target_entropy * math.log(n) - 1e-6:
        raise ValueError(f"no mix has {target_entropy} of the entropy of equal weights")
    mass = sources.agg(F.sum(F.pow(p, F.lit(exponent))).alias("z")).first()["z"]
    met = float(budget) if budget is not None else total * mass * (top / total) ** (1.0 - exponent)
    return Mix(exponent, total, met)


def _hash(epoch: Column) -> Column:
    return F.xxhash64(F.lit(SEED), epoch, F.col("__row"))


def mix(docs: DataFrame, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id",
        budget: int | None = None, max_repeats: float | None = MAX_REPEATS,
        target_entropy: float | None = None) -> DataFrame:
    """``docs`` dealt to the mix: every column, with ``epoch`` (0 for a row's
    first pass) and ``place`` (its hash in that epoch's permutation: sort by
    epoch, then place)."""
    row = F.xxhash64(F.col(id_col), F.col(text_col).cast("string"))
    narrow = write_table(docs.select(_source(source_col).alias("__source"), tokens_of(F.col(text_col).cast("string")).alias("tokens"),
                                     row.alias("__row")), "mix-rows")
    sources = write_table(narrow.groupBy("__source").agg(F.sum("tokens").alias("tokens")), "mix-sources")
    found = solve(sources, budget, max_repeats, target_entropy)
    kept = [c for c in docs.columns if c not in ("epoch", "place")]
    if found is None:
        return docs.select(*kept, F.lit(0).alias("epoch"), F.lit(0).cast("long").alias("place"))
    p = F.col("tokens") / F.lit(float(found.tokens))
    mass = sources.agg(F.sum(F.pow(p, F.lit(found.exponent))).alias("z")).first()["z"]
    quota = F.round(F.pow(p, F.lit(found.exponent)) / F.lit(mass) * F.lit(found.budget)).cast("long")
    quotas = sources.select("__source", F.expr("tokens").alias("whole"), quota.alias("quota")).select(
        "__source", F.floor(F.col("quota") / F.col("whole")).cast("int").alias("epochs"),
        (F.col("quota") % F.col("whole")).alias("rest"))
    # where the last permutation ends: the block by sums of blocks, the row inside that block
    last = narrow.join(quotas.where("rest > 0"), "__source").withColumn("place", _hash(F.col("epochs")))
    block = F.shiftright(F.col("place"), 64 - int(math.log2(BLOCKS)))
    sums = last.withColumn("block", block).groupBy("__source", "rest", "block").agg(F.sum("tokens").alias("tokens"))
    up_to = Window.partitionBy("__source").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    ending = (sums.withColumn("upto", F.sum("tokens").over(up_to)).where("upto >= rest AND upto - tokens < rest")
              .select("__source", "block", (F.col("rest") - F.col("upto") + F.col("tokens")).alias("left")))
    inside = last.withColumn("block", block).join(ending, ["__source", "block"])
    row_by_row = Window.partitionBy("__source").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    cuts = (inside.withColumn("upto", F.sum("tokens").over(row_by_row)).where("upto - tokens < left")
            .groupBy("__source").agg(F.max("place").alias("cut")))
    plan = write_table(quotas.join(cuts, "__source", "left").select("__source", "epochs", "cut"), "mix-plan")
    whole = docs.select(*kept, _source(source_col).alias("__source"), row.alias("__row")).join(plan, "__source")
    passes = F.col("epochs") + F.when(_hash(F.col("epochs")) <= F.col("cut"), 1).otherwise(0)
    dealt = whole.where(passes > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), passes - 1)))
    return dealt.select(*kept, "epoch", _hash(F.col("epoch")).alias("place"))
