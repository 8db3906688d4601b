"""Category tree operators: closure and membership.

The closure (ancestor, term, depth) — every term paired with itself and all
its descendants — grows by path doubling: a pair of a depth between 2^k and
2^(k+1) is a known pair, one of at most 2^k, followed by one of exactly 2^k.  In
a tree a term has one ancestor at that distance, so a round's join is no larger
than its result, and depth d takes log2 d rounds.  Every round's new pairs are a
written table.  A pair that is known already is not followed again, so a cycle
ends; depths are those of the shortest way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import registry, write_table

_TREES: dict[int, tuple[DataFrame, DataFrame]] = registry()


def closure(categories: DataFrame) -> DataFrame:
    """(ancestor_id, term_id, depth): depth 0 pairs a term with itself."""
    edges = write_table(categories.select("term_id", "parent_id").filter(F.col("term_id").isNotNull()).distinct(), "category-edges")
    terms = edges.select("term_id").distinct()
    known = terms.select(F.col("term_id").alias("ancestor_id"), "term_id", F.lit(0).alias("depth"))
    step = (edges.filter("parent_id <> term_id").join(terms.select(F.col("term_id").alias("parent_id")), "parent_id", "left_semi")
            .select(F.col("parent_id").alias("ancestor_id"), "term_id", F.lit(1).alias("depth")).distinct())
    far = 1
    while True:
        new = write_table(step, "category-level")
        known = known.unionByName(new)
        jumps = new.filter(F.col("depth") == far).select(F.col("ancestor_id").alias("above"), F.col("term_id").alias("below"))
        if jumps.isEmpty():
            return known
        step = (known.filter("depth > 0").join(jumps, F.col("term_id") == F.col("above"))
                .groupBy("ancestor_id", F.col("below").alias("term_id")).agg((F.min("depth") + far).alias("depth"))
                .join(known.select("ancestor_id", "term_id"), ["ancestor_id", "term_id"], "left_anti"))
        far *= 2


def materialized_closure(categories: DataFrame) -> DataFrame:
    """The closure of ``categories``, computed once and checkpointed.

    Each step of the recursion re-reads the category frame, and the reports
    walk the tree several times per query; the closure of a category
    dimension is small, so it is written once (a table in the shared
    checkpoint folder — lineage cut, survives executor loss) and
    reused for as long as the same category frame is.
    """
    hit = _TREES.get(id(categories))
    if hit is None or hit[0] is not categories:
        hit = (categories, write_table(closure(categories), "category-closure"))
        _TREES[id(categories)] = hit
    return hit[1]


def expand_with_descendants(chosen: DataFrame, tree: DataFrame) -> DataFrame:
    """(term_id) of the chosen terms and all their descendants."""
    return (tree.join(chosen.select(F.col("term_id").alias("ancestor_id")), "ancestor_id")
            .select("term_id").distinct())


def members(groups: DataFrame, tree: DataFrame, product_categories: DataFrame) -> DataFrame:
    """(term_id, product_id): products in each group term or below it, once
    per group even when a product sits in several of its sub-terms."""
    walk = tree.join(groups.select(F.col("term_id").alias("ancestor_id")), "ancestor_id").select(
        "ancestor_id", F.col("term_id").alias("sub_id"))
    pc = product_categories.select(F.col("term_id").alias("sub_id"), "product_id")
    return walk.join(pc, "sub_id").select(F.col("ancestor_id").alias("term_id"), "product_id").distinct()


def without_included_ancestor(included: DataFrame, tree: DataFrame) -> DataFrame:
    """(term_id) of included terms none of whose proper ancestors is included."""
    covered = (tree.filter(F.col("depth") > 0)
               .join(included.select(F.col("term_id").alias("ancestor_id")), "ancestor_id", "left_semi")
               .select("term_id"))
    return included.select("term_id").join(covered, "term_id", "left_anti")
