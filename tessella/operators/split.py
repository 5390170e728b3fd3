"""Splits of patches without spatial leakage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

V = F.col
#: Of each eight blocks, the fourth is for validation and the eighth for testing.
TRAIN, VALIDATION, TEST, DROPPED = 0, 1, 2, -1


def assign_splits(patches: DataFrame, patch: int, guard: int | None = None, block_rows: int | None = None) -> DataFrame:
    """(patch_id, strip_id, row0, col0) -> with split: 0 train, 1 validation, 2 test, -1 dropped.

    A patch is dropped if one of a higher split in its strip lies closer than ``guard`` (greatest of the gaps between their
    squares). Patches meet through cells as wide as the farthest origin that can be too close, so only neighbours are compared.
    """
    guard = patch if guard is None else guard
    block = F.floor(V("row0") / (block_rows or max(4 * patch, 512)))
    dealt = patches.withColumn("split", F.when(block % 8 == 3, VALIDATION).when(block % 8 == 7, TEST).otherwise(TRAIN))
    reach = patch + guard
    cell = lambda c: F.floor(V(c) / reach)
    beside = F.array(F.lit(-1), F.lit(0), F.lit(1))
    high = dealt.where("split > 0").select(V("strip_id").alias("h_strip"), V("row0").alias("h_row"), V("col0").alias("h_col"), V("split").alias("h_split"))
    high = high.withColumn("h_y", F.explode(F.transform(beside, lambda d: F.floor(V("h_row") / reach) + d))).withColumn("h_x", F.explode(F.transform(beside, lambda d: F.floor(V("h_col") / reach) + d)))
    gap = F.greatest(F.abs(V("row0") - V("h_row")) - patch, F.abs(V("col0") - V("h_col")) - patch, F.lit(0))
    near = (V("strip_id") == V("h_strip")) & (cell("row0") == V("h_y")) & (cell("col0") == V("h_x")) & (V("h_split") > V("split")) & (gap < guard)
    kept = dealt.join(high, near, "left_anti")
    ids = kept.select(V("patch_id").alias("k_id"))
    return dealt.join(ids, V("patch_id") == V("k_id"), "left").withColumn("split", F.when(V("k_id").isNull(), DROPPED).otherwise(V("split"))).drop("k_id")
