"""Quality rules with adaptive thresholds from mergeable quantile sketches (native).

Each document gets counts; four per-mille ratios are drawn from them. Per language and source, each ratio is
summed up in a histogram sketch with buckets of bounded relative width (a value keeps its 8 leading bits), which
merges by adding counts, so partial aggregation keeps hot sources cheap and the result does not depend on the order
of merging. The sketch gives the quartiles, and a document fails if a ratio lies above the upper fence
q3 + 3 * max(q3 - q1, slack). The slack keeps sources whose documents are all alike from rejecting ordinary ones.

Defined results: a null text has no words and fails the base rules; null language or source are groups of their own;
repeated rows are judged alike; very long texts are measured whole; other columns, whatever their names, are ignored by
quality_report() and kept by keep_good(); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, let, materialize

#: Least distance between quartiles that a fence assumes, in thousandths.
SLACK = {"symbols": 8, "dup_lines": 150, "repeats": 100, "capitals": 60}
METRICS = list(SLACK)


def _covered(words: Column) -> Column:
    """Words that lie in a three-word window found at two or more places of the array."""

    def gram(i: Column) -> list[Column]:
        return [F.get(words, i + k) for k in range(3)]

    def twins(rows: Column) -> Column:  # of rows (key, at), the ``at`` of those whose key another row has
        ordered = F.array_sort(rows)
        return let(
            ordered,
            lambda s: F.transform(
                F.filter(s, lambda x, k: F.coalesce(x["key"] == F.get(s, k - 1)["key"], F.lit(False)) | F.coalesce(x["key"] == F.get(s, k + 1)["key"], F.lit(False))), lambda x: x["at"]
            ),
        )

    def exact(hashes: Column) -> Column:
        suspects = twins(F.transform(hashes, lambda h, i: F.struct(h.alias("key"), i.alias("at"))))
        sure = twins(F.transform(suspects, lambda i: F.struct(F.concat_ws(" ", *gram(i)).alias("key"), i.alias("at"))))
        gaps = lambda p: F.transform(p, lambda at, k: F.least(F.coalesce(F.get(p, k + 1) - at, F.lit(3)), F.lit(3)))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(F.array_sort(sure), lambda p: F.aggregate(gaps(p), F.lit(0), lambda a, x: a + x))).otherwise(F.lit(0))

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(*gram(i)))
    return F.when(F.size(words) >= 3, let(hashes, exact)).otherwise(F.lit(0))


def _counts(words: Column) -> Column:
    joined = F.array_join(words, "")
    return let(
        joined,
        lambda j: F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(j).cast("long").alias("word_chars"),
            F.regexp_count(j, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            F.regexp_count(j, F.lit(r"[A-Z]")).cast("long").alias("n_capitals"),
            _covered(words).cast("long").alias("n_repeat_words"),
        ),
    )


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` plus a struct column m: the counts, base_failed, and the ratios in thousandths."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    line_counts = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    both = F.struct(let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), _counts).alias("w"), line_counts.alias("l"))

    def ratios(b: Column) -> Column:
        w, line = b["w"], b["l"]
        per_mille = lambda a, n: F.floor(F.coalesce(F.try_divide(a * 1000, n), F.lit(0))).cast("long")
        return F.struct(
            w["n_words"].alias("n_words"), w["word_chars"].alias("word_chars"), w["n_symbols"].alias("n_symbols"), line["n_dup_lines"].alias("n_dup_lines"), w["n_repeat_words"].alias("n_repeat_words"),
            ((w["n_words"] < 50) | (w["n_repeat_words"] * 100 > w["n_words"] * 50)).alias("base_failed"),
            per_mille(w["n_symbols"], w["word_chars"]).alias("symbols"), per_mille(line["n_dup_lines"], line["n_lines"]).alias("dup_lines"),
            per_mille(w["n_repeat_words"], w["n_words"]).alias("repeats"), per_mille(w["n_capitals"], w["word_chars"]).alias("capitals"),
        )

    return docs.withColumn("m", let(both, ratios))


def sketch_bucket(value: Column) -> Column:
    """The value with all but its 8 leading bits cleared: the lower edge of its bucket."""
    spare = F.greatest(F.length(F.bin(value)) - 8, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, spare), spare)


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, METRICS...) -> mergeable sketches: lang, source, metric, bucket, n."""
    stacked = rows.select("lang", "source", F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), sketch_bucket(F.col(k)).alias("bucket")) for k in METRICS])).alias("x"))
    return stacked.groupBy("lang", "source", "x.metric", "x.bucket").agg(F.count(F.lit(1)).alias("n"))


def fences(sketch: DataFrame) -> DataFrame:
    """Upper fences per language and source: lang, source, symbols_max, dup_lines_max, ..."""
    w = Window.partitionBy("lang", "source", "metric")
    run = sketch.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("total", F.sum("n").over(w))
    at = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("total") * q, F.col("bucket")))
    quartiles = run.groupBy("lang", "source", "metric").agg(at(1).alias("q1"), at(3).alias("q3"))
    slack = F.element_at(F.create_map(*[F.lit(x) for kv in SLACK.items() for x in kv]), F.col("metric"))
    fence = quartiles.withColumn("fence", F.col("q3") + 3 * F.greatest(F.col("q3") - F.col("q1"), slack))
    return fence.groupBy("lang", "source").agg(*[F.max(F.when(F.col("metric") == k, F.col("fence"))).alias(f"{k}_max") for k in METRICS])


def judged(rows: DataFrame) -> DataFrame:
    """Adds kept to rows that hold lang, source and the struct m."""
    limits = materialize(fences(sketches(rows.select("lang", "source", *[F.col(f"m.{k}").alias(k) for k in METRICS]))))
    limits = limits.withColumnsRenamed({"lang": "f_lang", "source": "f_source"})
    joined = rows.join(limits, rows.lang.eqNullSafe(F.col("f_lang")) & rows.source.eqNullSafe(F.col("f_source")))
    over = F.lit(False)
    for k in METRICS:
        over = over | (F.col(f"m.{k}") > F.col(f"{k}_max"))
    return joined.withColumn("kept", ~F.col("m.base_failed") & ~over).drop("f_lang", "f_source", *[f"{k}_max" for k in METRICS])


def quality_report(docs: DataFrame) -> DataFrame:
    rows = materialize(measured(docs.select(F.col("doc_id"), "text", "lang", "source")).drop("text"))
    return judged(rows).select("doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words", "m.base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents that the rules reject. Texts are measured once and stay in place."""
    whole = F.struct(*[docs[c] for c in docs.columns]).alias("doc")
    rows = materialize(measured(docs.select("text", "lang", "source", whole)).select("lang", "source", "doc", "m"))
    return judged(rows).where("kept").select("doc.*")


ORACLE = r"""
WITH base AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM base),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM g) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT p)::BIGINT AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY rid),
lines AS (SELECT rid, count(*) AS n, count(*) - count(DISTINCT l) AS d FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM base) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
c AS (SELECT w.doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(lines.d, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
  len(regexp_extract_all(t, '[A-Z]'))::BIGINT AS n_capitals, coalesce(lines.n, 0) AS n_lines
  FROM w LEFT JOIN rep USING (rid) LEFT JOIN lines USING (rid)),
m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  CASE WHEN word_chars > 0 THEN n_symbols * 1000 // word_chars ELSE 0 END AS symbols, CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines ELSE 0 END AS dup_lines,
  CASE WHEN n_words > 0 THEN n_repeat_words * 1000 // n_words ELSE 0 END AS repeats, CASE WHEN word_chars > 0 THEN n_capitals * 1000 // word_chars ELSE 0 END AS capitals FROM c),
x AS (SELECT lang, source, unnest([{'k': 'symbols', 'v': symbols, 's': 8}, {'k': 'dup_lines', 'v': dup_lines, 's': 150}, {'k': 'repeats', 'v': repeats, 's': 100}, {'k': 'capitals', 'v': capitals, 's': 60}]) AS z FROM m),
b AS (SELECT lang, source, z.k AS k, z.s AS s, (z.v >> greatest(length(bin(z.v)) - 8, 0)::INT) << greatest(length(bin(z.v)) - 8, 0)::INT AS bucket FROM x),
h AS (SELECT lang, source, k, s, bucket, sum(count(*)) OVER (PARTITION BY lang, source, k ORDER BY bucket) AS upto, sum(count(*)) OVER (PARTITION BY lang, source, k) AS total FROM b GROUP BY lang, source, k, s, bucket),
q AS (SELECT lang, source, k, s, min(bucket) FILTER (WHERE upto * 4 >= total) AS q1, min(bucket) FILTER (WHERE upto * 4 >= total * 3) AS q3 FROM h GROUP BY lang, source, k, s),
f AS (SELECT lang, source, max(q3 + 3 * greatest(q3 - q1, s)) FILTER (WHERE k = 'symbols') AS f1, max(q3 + 3 * greatest(q3 - q1, s)) FILTER (WHERE k = 'dup_lines') AS f2,
  max(q3 + 3 * greatest(q3 - q1, s)) FILTER (WHERE k = 'repeats') AS f3, max(q3 + 3 * greatest(q3 - q1, s)) FILTER (WHERE k = 'capitals') AS f4 FROM q GROUP BY lang, source)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND symbols <= f1 AND dup_lines <= f2 AND repeats <= f3 AND capitals <= f4 AS kept
FROM m JOIN f ON m.lang IS NOT DISTINCT FROM f.lang AND m.source IS NOT DISTINCT FROM f.source
"""
