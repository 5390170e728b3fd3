"""Discovery of products, labels, pointers and checksums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

V = F.col
#: Fixed value: how a pointer file of the large-file store begins.
POINTER = "version https://git-lfs.github.com/spec/"


def files(spark: SparkSession, root: str) -> DataFrame:
    """path and length of all files below root; contents are not read unless used."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)


def read_documents(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Whole JSON documents, one row each (one an element, if a document is a list), with the path."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path).withColumn("path", F.col("_metadata.file_path"))


def sensor(path: Column) -> Column:
    low = F.lower(path)
    named = F.when(low.contains("ohr"), "OHRC").when(low.contains("tmc"), "TMC").when(low.contains("iir"), "IIRS")
    return named


def discover(paths: DataFrame, path: str = "path") -> DataFrame:
    """(dir, sensor, kind, files): a product is a directory with an image and its label: img + xml, else tif + xml, else qub + hdr.
    Of several files with one extension the last by name counts; version-control folders are skipped."""
    p = paths.where(~V(path).contains(".git")).select(V(path).alias("path"))
    p = p.withColumn("dir", F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).withColumn("ext", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))).where("ext <> ''")
    grouped = p.groupBy("dir", "ext").agg(F.max("path").alias("path")).groupBy("dir").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("ext", "path")))).alias("files"))
    has = lambda *e: F.forall(F.array(*map(F.lit, e)), lambda x: F.map_contains_key("files", x))
    kind = F.when(has(".img", ".xml"), "raw").when(has(".tif", ".xml"), "tiff").when(has(".qub", ".hdr"), "cube")
    return grouped.withColumn("kind", kind).where("kind is not null").select("dir", F.coalesce(sensor(V("dir")), F.concat(F.lit("UNKNOWN_"), F.upper("kind"))).alias("sensor"), "kind", "files")


def find_one(paths: DataFrame, name: str, path: str = "path") -> DataFrame:
    """The first path, in order, that ends in /name; raises if there is none."""
    hit = paths.where(F.concat(F.lit("/"), V(path)).endswith("/" + name)).agg(F.min(path).alias("path"))
    return hit.where(F.assert_true(V("path").isNotNull(), F.lit(f"{name} not found")).isNull())


def is_pointer(content: Column) -> Column:
    return F.coalesce(F.decode(F.substring(content, 1, 200), "ISO-8859-1").startswith(POINTER), F.lit(False))


def verify(found: DataFrame, labels: DataFrame) -> DataFrame:
    """(file, actual_md5, label_md5, match) of files against the checksums of their labels."""
    return found.join(labels, "file", "left").select("file", "actual_md5", "label_md5", F.coalesce(V("actual_md5") == F.lower("label_md5"), F.lit(False)).alias("match"))


def new_files(incoming: DataFrame, present: DataFrame) -> DataFrame:
    """What is not present with the same path and size."""
    return incoming.join(present, ["path", "size"], "left_anti")


def _local(name: str) -> str:
    return f"//*[local-name()='{name}']/text()"


#: Mission parameters of a label.
MISSION = ("pixel_resolution", "roll", "pitch", "yaw", "sun_azimuth", "sun_elevation", "solar_incidence", "spacecraft_altitude")


def parse_labels(texts: DataFrame, key: str = "path", xml: str = "value") -> DataFrame:
    """(key, file_name, data_type, offset, axes, params) of product labels, whatever their namespaces; the last of repeated parameters
    counts; a label with neither an image nor a spectrum array raises."""
    x = V(xml)
    strings = lambda tag: F.xpath(x, F.lit(_local(tag)))
    last = lambda tag: F.element_at(strings(tag), -1)
    some = lambda tag: F.when(F.size(strings(tag)) > 0, last(tag))
    axes = F.map_from_arrays(F.transform(strings("axis_name"), F.trim), F.transform(strings("elements"), lambda e: F.trim(e).cast("long")))
    params = F.map_from_arrays(F.array(*map(F.lit, MISSION)), F.array(*[F.trim(some(m)) for m in MISSION]))
    checked = F.when(F.assert_true(x.contains("Array_2D_Image") | x.contains("Array_3D_Spectrum"), F.lit("label without an array")).isNull(), F.trim(F.xpath_string(x, F.lit(_local("file_name")))))
    return texts.select(
        key, checked.alias("file_name"), F.trim(F.xpath_string(x, F.lit(_local("data_type")))).alias("data_type"), F.coalesce(F.trim(some("offset")).cast("long"), F.lit(0).cast("long")).alias("offset"), axes.alias("axes"), F.map_filter(params, lambda k, v: v.isNotNull()).alias("params")
    )


def label_leaves(texts: DataFrame, key: str = "path", xml: str = "value") -> DataFrame:
    """(key, tag, value, attributes) of every element that holds text only, namespaces stripped."""
    leaf = F.regexp_extract_all(V(xml), F.lit(r"<([A-Za-z_:][\w:.-]*(?:\s[^<>]*)?>[^<>]+)</"), F.lit(1))
    rows = texts.select(key, F.explode(leaf).alias("l")).withColumn("head", F.regexp_extract("l", r"^([^>]*)>", 1))
    bare = lambda name: F.element_at(F.split(name, ":"), -1)
    pairs = F.transform(F.regexp_extract_all("head", F.lit(r"""([\w:.-]+\s*=\s*(?:"[^"]*"|'[^']*'))"""), F.lit(1)), lambda p: F.split(p, r"\s*=\s*", 2))
    attributes = F.map_from_entries(F.transform(pairs, lambda p: F.struct(bare(p[0]), F.substring(p[1], F.lit(2), F.length(p[1]) - 2))))
    return rows.select(key, bare(F.regexp_extract("head", r"^([\w:.-]+)", 1)).alias("tag"), F.trim(F.regexp_extract("l", r">([^<>]+)$", 1)).alias("value"), attributes.alias("attributes")).where("value <> ''")


#: Bytes of an element, by the label's name for its type.
TYPE_BYTES = {"UnsignedByte": 1, "SignedByte": 1, "UnsignedLSB2": 2, "SignedLSB2": 2, "UnsignedMSB2": 2, "SignedMSB2": 2, "UnsignedLSB4": 4, "SignedLSB4": 4, "UnsignedMSB4": 4, "SignedMSB4": 4, "IEEE754LSBSingle": 4, "IEEE754MSBSingle": 4}


def label_audit(texts: DataFrame, key: str = "path", xml: str = "value") -> DataFrame:
    """(key, axes, file_size, md5, data_type, bands, expected_bytes): axes by their names in lower case, one band if there is no such axis,
    and the bytes that axes and type call for, to hold against the file's size."""
    x = V(xml)
    strings = lambda tag: F.xpath(x, F.lit(_local(tag)))
    one = lambda tag: F.trim(F.get(strings(tag), F.lit(0)))
    axes = F.map_from_arrays(F.transform(strings("axis_name"), lambda a: F.lower(F.trim(a))), F.transform(strings("elements"), lambda e: F.trim(e).cast("long")))
    size = F.element_at(F.create_map(*[F.lit(v) for kv in TYPE_BYTES.items() for v in kv]), one("data_type"))
    elements = F.aggregate(F.map_values("axes"), F.lit(1).cast("long"), lambda a, n: a * n)
    rows = texts.select(key, axes.alias("axes"), one("file_size").cast("long").alias("file_size"), F.lower(one("md5_checksum")).alias("md5"), one("data_type").alias("data_type"), size.alias("size"))
    return rows.select(key, "axes", "file_size", "md5", "data_type", F.coalesce(F.try_element_at("axes", F.lit("band")), F.lit(1)).alias("bands"), (elements * V("size")).alias("expected_bytes"))
