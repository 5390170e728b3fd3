"""Mixing sources to target weights by capped water-filling (native).

Every source starts with its weighted share of the requested total. A source whose share exceeds ``max_epochs``
times its size is clamped there, and the excess is spread over the others by weight, until no share is above its
cap. The level of the water is found by rounds of one small aggregate each, so any number of sources works.

A share of r times the source's size is met by floor(r) whole passes over the source and a seeded pass over part of
it: documents are ordered by a hash of seed and doc_id and taken while the part is not yet filled (a document is
taken if its middle lies within the part), so a source misses its target by half a document at most. The order is
never sorted as a whole: two levels of hash buckets are summed first and only the one bucket on the border is sorted, its
equal rows as one. So a source's plan is one row, by which every document is judged where it is.

Defined results: null text has size 0; the null source is a source of its own, last in order; a document without doc_id is
hashed by its text; repeated rows are separate documents (of equal ones at the end of a part a seeded share is taken); very
long texts count whole; other columns are ignored by mix() and kept by repeat_documents(), whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...], share: float, max_epochs: float) -> DataFrame:
    """(source, source_size) -> with weight and target. The ordered window runs over one row per source."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int"))
    capped = materialize(sources.select("source", "source_size", weight.alias("weight")).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs))))
    total, weight_sum = capped.agg(F.sum("source_size"), F.sum("weight")).first()
    wanted = share * (total or 0)
    level, clamped = (wanted / weight_sum if weight_sum else 0.0), -1
    while True:
        over = F.col("weight") * F.lit(level) >= F.col("cap")
        n, filled, free = capped.agg(F.count_if(over), F.sum(F.when(over, F.col("cap"))), F.sum(F.when(~over, F.col("weight")))).first()
        if n == clamped or not free:
            break
        clamped, level = n, (wanted - (filled or 0.0)) / free
    over = F.col("weight") * F.lit(level) >= F.col("cap")
    return capped.withColumn("target", F.when(over, F.col("cap")).otherwise(F.col("weight") * F.lit(level)))


def _border(sums: DataFrame, bucket: str, base: str) -> DataFrame:
    """Per source, the bucket in which the running size crosses ``part``, and the size before it."""
    w = Window.partitionBy("source").orderBy(bucket)
    running = sums.withColumn("before", F.col(base) + F.sum("bucket_size").over(w) - F.col("bucket_size"))
    inside = running.where(F.col("before") <= F.col("part"))
    return inside.groupBy("source", "part").agg(F.max_by(bucket, bucket).alias(f"{bucket}_border"), F.max_by("before", bucket).alias(f"{bucket}_before"))


def _draw(doc_id: Column, text: Column, seed: int) -> Column:
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    return F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary"))


def mix_plan(sizes: DataFrame, weights: tuple[int, ...], share: float, max_epochs: float) -> DataFrame:
    """Per source (p_source): source_size, target, whole (passes), and where the pass over a part ends: rows of (source, size, draw)
    with (draw, size) below (last_draw, last_size) are in it, and of those there a share of last_share."""
    sizes = sizes.withColumn("b1", F.substring("draw", 1, 2)).withColumn("b2", F.substring("draw", 3, 2))
    level1 = materialize(sizes.groupBy("source", "b1").agg(F.sum("size").alias("bucket_size")))
    targets = source_targets(level1.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, share, max_epochs)
    ratio = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    targets = targets.withColumn("whole", F.floor(ratio)).withColumn("part", F.col("target") - F.floor(ratio) * F.col("source_size"))
    targets = materialize(targets.select("source", "source_size", "target", "whole", "part"))
    part = targets.select(F.col("source").alias("p_source"), "part")

    first = _border(level1.join(part, F.col("source").eqNullSafe(F.col("p_source"))).withColumn("zero", F.lit(0)), "b1", "zero")
    first = materialize(first).withColumnRenamed("source", "f_source")
    in1 = sizes.join(first, sizes.source.eqNullSafe(F.col("f_source")) & (F.col("b1") == F.col("b1_border")))
    level2 = in1.groupBy("source", "part", "b1_border", "b1_before", "b2").agg(F.sum("size").alias("bucket_size"))
    second = _border(level2, "b2", "b1_before")
    border = materialize(second.withColumnRenamed("source", "s_source").join(first.drop("part"), F.col("s_source").eqNullSafe(F.col("f_source"))).drop("f_source"))

    # The rows of the border bucket, equal ones counted as one key: of the first key that the part can't take whole, it takes a share.
    hit = sizes.join(border, sizes.source.eqNullSafe(F.col("s_source")) & (F.col("b1") == F.col("b1_border")) & (F.col("b2") == F.col("b2_border")))
    keys = hit.groupBy("source", "part", "b2_before", "draw", "size").agg(F.count(F.lit(1)).alias("rows"))
    before = F.sum(F.col("size") * F.col("rows")).over(Window.partitionBy("source").orderBy("draw", "size").rowsBetween(Window.unboundedPreceding, -1))
    room = F.col("part") - F.col("b2_before") - F.coalesce(before, F.lit(0))
    fits = F.when(F.col("size") > 0, F.floor(room / F.col("size") + 0.5)).when(room >= 0, F.col("rows")).otherwise(0)
    keys = keys.withColumn("fits", F.greatest(F.least(fits, F.col("rows")), F.lit(0)))
    last = F.min(F.when(F.col("fits") < F.col("rows"), F.struct("draw", "size", (F.col("fits") / F.col("rows")).alias("share"))))
    ends = keys.groupBy(F.col("source").alias("e_source")).agg(last.alias("last"))
    out = targets.withColumnRenamed("source", "p_source").join(border.select("s_source", F.concat("b1_border", "b2_border", F.lit("g")).alias("beyond")), F.col("p_source").eqNullSafe(F.col("s_source")), "left")
    out = out.join(ends, F.col("p_source").eqNullSafe(F.col("e_source")), "left")
    ends_at = [F.coalesce("last.draw", "beyond", F.lit("")).alias("last_draw"), F.coalesce("last.size", F.lit(0)).alias("last_size"), F.coalesce("last.share", F.lit(0.0)).alias("last_share")]
    return materialize(out.select("p_source", "source_size", "target", "whole", *ends_at))


def _copies(draw: Column, size: Column, max_epochs: float, seed: int) -> Column:
    """Passes that take a row, by its source's plan; which of equal rows at the end of a part are taken is drawn."""
    at_end = (draw == F.col("last_draw")) & (size == F.col("last_size")) & (F.rand(seed) < F.col("last_share"))
    below = (draw < F.col("last_draw")) | ((draw == F.col("last_draw")) & (size < F.col("last_size")))
    return F.least(F.col("whole") + (below | at_end).cast("int"), F.lit(int(max_epochs))).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: int = 17) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies (0 to max_epochs), taken."""
    sizes = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _draw(F.col("doc_id"), F.col("text"), seed).alias("draw")))
    plan = mix_plan(sizes.select("source", "size", "draw"), weights, share, max_epochs)
    out = sizes.join(plan, F.col("source").eqNullSafe(F.col("p_source"))).withColumn("copies", _copies(F.col("draw"), F.col("size"), max_epochs, seed))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def repeat_documents(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: int = 17) -> DataFrame:
    """``docs`` as the mix takes them: a row appears once per pass, or not at all. Texts are not moved."""
    size, draw = word_count(docs["text"]), _draw(docs["doc_id"], docs["text"], seed)
    sizes = materialize(docs.select(docs["source"], size.alias("size"), draw.alias("draw")))
    plan = mix_plan(sizes, weights, share, max_epochs)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs["source"].alias("of"), size.alias("size"), draw.alias("draw"))
    taken = rows.join(plan, F.col("of").eqNullSafe(F.col("p_source"))).withColumn("copies", _copies(F.col("draw"), F.col("size"), max_epochs, seed))
    return taken.where("copies > 0").withColumn("pass", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('17:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, '')))) AS draw FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, source_size * 2.0::DOUBLE AS cap FROM s0),
fill AS (
  SELECT 0 AS step, 1.5::DOUBLE * (SELECT sum(source_size) FROM s)::DOUBLE / (SELECT sum(weight) FROM s)::DOUBLE AS lvl
  UNION ALL
  SELECT step + 1, (1.5::DOUBLE * (SELECT sum(source_size) FROM s)::DOUBLE - (SELECT coalesce(sum(cap), 0) FROM s WHERE weight * lvl >= cap)) / (SELECT sum(weight) FROM s WHERE weight * lvl < cap)::DOUBLE
  FROM fill WHERE step < 60 AND (SELECT count(*) FROM s WHERE weight * lvl < cap) > 0),
t AS (SELECT source, source_size, CASE WHEN weight * lvl >= cap THEN cap ELSE weight * lvl END AS target FROM s, (SELECT arg_max(lvl, step) AS lvl FROM fill)),
r AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
o AS (SELECT d.doc_id, d.source, d.size, r.source_size, r.target, r.whole, r.target - r.whole * r.source_size AS part,
  sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw, d.doc_id NULLS FIRST, d.size ROWS UNBOUNDED PRECEDING) - d.size / 2.0::DOUBLE AS middle
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target::DOUBLE AS target, (least(whole + CASE WHEN middle <= part THEN 1 ELSE 0 END, 2) * size)::BIGINT AS taken FROM o
"""
