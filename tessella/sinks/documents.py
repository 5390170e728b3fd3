"""Metadata, statistics, telemetry and training histories as JSON documents: pieces for raster_files.write_files()."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

V = F.col


def one_each(rows: DataFrame, name: str, *, drop: tuple[str, ...] = ()) -> DataFrame:
    """One document a row, called by its ``name`` column; arrays of numbers, as pixels are, and the columns in ``drop`` are left out."""
    numeric = ("array<double>", "array<float>", "array<int>", "array<bigint>", "array<smallint>", "array<tinyint>", "binary")
    kept = [f.name for f in rows.schema.fields if f.name != name and f.name not in drop and f.dataType.simpleString() not in numeric]
    body = F.to_json(F.struct(*kept), {"ignoreNullFields": "false", "pretty": "true"})
    return rows.select(F.concat(V(name).cast("string"), F.lit(".json")).alias("path"), F.lit(0).cast("long").alias("place"), F.encode(body, "UTF-8").alias("content"))


def telemetry(pairs: DataFrame, summary: DataFrame, args: dict, path: str = "evaluation.json") -> DataFrame:
    """One document {summary, pairs, args} of an evaluation: a summary row a variant, and the pairs' scores in order. It holds as many pairs as were
    evaluated: a report, not a table."""
    scores = pairs.agg(F.array_sort(F.collect_list(F.struct("pair", "variant", *[c for c in pairs.columns if c not in ("pair", "variant")]))).alias("pairs"))
    top = summary.agg(F.map_from_entries(F.collect_list(F.struct(V("variant"), F.struct(*[c for c in summary.columns if c != "variant"])))).alias("summary"))
    given = F.from_json(F.lit(json.dumps({k: str(v) for k, v in args.items()})), "map<string,string>").alias("args")
    body = F.to_json(F.struct("summary", "pairs", "args"), {"ignoreNullFields": "false"})
    return top.join(scores, how="cross").select("summary", "pairs", given).select(F.lit(path).alias("path"), F.lit(0).cast("long").alias("place"), F.encode(body, "UTF-8").alias("content"))  # one row each


def history(rows: DataFrame, epoch: str = "epoch", path: str = "history.json") -> DataFrame:
    """One document with the epochs' rows in order."""
    all_rows = rows.agg(F.array_sort(F.collect_list(F.struct(epoch, *[c for c in rows.columns if c != epoch]))).alias("rows"))
    return all_rows.select(F.lit(path).alias("path"), F.lit(0).cast("long").alias("place"), F.encode(F.to_json("rows", {"ignoreNullFields": "false"}), "UTF-8").alias("content"))


def improvements(rows: DataFrame, value: str, epoch: str = "epoch") -> DataFrame:
    """The epochs at which the value was less than at all before: those whose state is to be kept. A few hundred rows in one window."""
    before = F.min(value).over(Window.orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("before", before).where(V("before").isNull() | (V(value) < V("before"))).drop("before")
