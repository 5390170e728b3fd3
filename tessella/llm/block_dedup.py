"""Exact dedup by deterministic block naming (native).

A normalised text is cut into fixed-size blocks. Equal blocks get equal integer names: the distinct blocks are
range-sorted and numbered. Adjacent names are paired, the distinct pairs are sorted and numbered again, and so on
until one name is left per document. Two documents of one length have equal final names if and only if their
texts are equal: no hash decides.

A first round names each document by its length and three short blocks (start, middle, end). A document alone
under that name already has an identity of its own and leaves; only the others go through the full naming.

Defined results: a null text equals the empty text; a null doc_id is below every other; repeated rows (same doc_id
and text) each count in group_size and share one decision; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, scratch, shuffle_partitions

BLOCK = 2048
PROBE = 48


def _named(distinct: DataFrame, cols: list[str], name: str) -> DataFrame:
    """Number the rows of ``distinct``, sorted; written out, since names must not change on a retry. Which number a row gets depends on the
    bounds that Spark draws: names of one run are equal or not, and mean nothing else."""
    n = shuffle_partitions(distinct.sparkSession)
    # Bounds are drawn from the heads of long blocks and, where very many blocks have one head, their hashes: whole blocks would
    # make the sample of bounds large.
    heads = [x for c in cols for x in ((F.substring(c, 1, 64), F.xxhash64(c)) if c == "block" else (F.col(c),))]
    ordered = distinct.repartitionByRange(n, *heads).sortWithinPartitions(*cols)
    return materialize(ordered.select(*cols, F.monotonically_increasing_id().alias(name)))


def _probe(text: Column, size: Column) -> Column:
    middle = F.greatest((size / 2).cast("int"), F.lit(1))
    return F.concat(F.substring(text, 1, PROBE), F.substr(text, middle, F.lit(PROBE)), F.right(text, F.lit(PROBE)))


def block_names(texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, sha, size, norm) -> (doc_id, sha, size, name); name is equal for equal texts of one size."""
    last = F.greatest(F.ceil(F.col("size") / F.lit(block)).cast("int") - 1, F.lit(0))
    blocks = texts.select(
        "doc_id", "sha", "size", F.posexplode(F.transform(F.sequence(F.lit(0), last), lambda i: F.substr(F.col("norm"), i * block + 1, F.lit(block)))).alias("pos", "block")
    )
    names = _named(blocks.select("block").distinct(), ["block"], "name")
    joined = blocks.join(names, "block").select("doc_id", "sha", "size", "pos", "name")
    gather = F.transform(F.array_sort(F.collect_set(F.struct("pos", "name"))), lambda x: x["name"]).alias("names")
    level = materialize(joined.groupBy("doc_id", "sha", "size").agg(gather))
    done: DataFrame | None = None
    while True:
        settled = level.where(F.size("names") == 1).select("doc_id", "sha", "size", F.col("names")[0].alias("name"))
        done = settled if done is None else done.unionByName(settled)
        rest = level.where(F.size("names") > 1)
        if rest.isEmpty():
            return done
        pair = F.transform(
            F.sequence(F.lit(0), F.ceil(F.size("names") / 2).cast("int") - 1), lambda j: F.struct(F.get(F.col("names"), 2 * j).alias("a"), F.coalesce(F.get(F.col("names"), 2 * j + 1), F.lit(-1)).alias("b"))
        )
        pairs = rest.select("doc_id", "sha", "size", F.posexplode(pair).alias("pos", "pair")).select("doc_id", "sha", "size", "pos", "pair.a", "pair.b")
        names = _named(pairs.select("a", "b").distinct(), ["a", "b"], "name")
        level = materialize(pairs.join(names, ["a", "b"]).groupBy("doc_id", "sha", "size").agg(gather))


def exact_groups(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    norm = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), norm.alias("norm"))
    texts = texts.withColumn("size", F.length("norm")).withColumn("sha", F.sha2(F.encode("norm", "UTF-8"), 256))
    with scratch(docs.sparkSession) as keep:
        heads = keep(materialize(texts.select("doc_id", "sha", "size", _probe(F.col("norm"), F.col("size")).alias("probe"))))
        # Only documents that share length and probe blocks with another row can have a copy.
        # Written first, so that the join deals both sides anew and a probe that very many share can be split.
        shared = materialize(heads.groupBy("size", "probe").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("size", "probe"))
        members = materialize(heads.join(shared, ["size", "probe"]).groupBy("doc_id", "sha", "size").agg(F.count(F.lit(1)).alias("rows")))
        keys = members.select(F.col("doc_id").alias("m_id"), F.col("sha").alias("m_sha"))
        # By merge at any size, so that the plan is the same for small and large tables; written once, used twice.
        candidates = materialize(texts.join(keys.hint("merge"), texts.doc_id.eqNullSafe(F.col("m_id")) & (texts.sha == F.col("m_sha")), "left_semi"))
        named = block_names(candidates, block).withColumnsRenamed({"doc_id": "b_id", "sha": "b_sha", "size": "b_size"})
        rows = members.join(named, members.doc_id.eqNullSafe(F.col("b_id")) & (F.col("sha") == F.col("b_sha"))).select("doc_id", "sha", "size", "rows", "name")
        rows = keep(materialize(rows))
    groups = rows.groupBy("size", "name").agg(F.max("doc_id").alias("keep_id"), F.sum("rows").alias("group_size"))
    found = rows.join(groups, ["size", "name"]).select(F.col("doc_id").alias("f_id"), F.col("sha").alias("f_sha"), "keep_id", "group_size")
    out = heads.join(found, heads.doc_id.eqNullSafe(F.col("f_id")) & (heads.sha == F.col("f_sha")), "left")
    stays = F.when(F.col("f_sha").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select(
        "doc_id", stays.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(stays).alias("kept"), F.col("sha").alias("text_sha256")
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text another row keeps; of repeated rows of a keeper one stays."""
    kept = materialize(exact_groups(docs).where("kept").groupBy(F.col("doc_id").alias("k_id"), F.col("text_sha256").alias("k_sha")).agg(F.count(F.lit(1)).alias("k_rows")))
    norm = ascii_lower(F.coalesce(docs.text, F.lit("")))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs.doc_id.cast("long").alias("id"), F.sha2(F.encode(norm, "UTF-8"), 256).alias("sha"))
    # Rows are found by doc_id and text, since one doc_id may come with several texts.
    meets = lambda k: rows.id.eqNullSafe(k.k_id) & (rows.sha == k.k_sha)
    single, repeated = kept.where("k_rows = 1"), kept.where("k_rows > 1")
    out = rows.join(single.hint("merge"), meets(single), "left_semi").select("doc.*")
    if repeated.isEmpty():
        return out
    return out.unionByName(rows.join(repeated, meets(repeated), "left_semi").dropDuplicates(["id", "sha"]).select("doc.*"))


ORACLE = r"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""
