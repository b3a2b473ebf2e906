"""Readers and writers of the formats that the pipeline's artefacts use.

Readers take explicit schemas and fail on malformed input unless told otherwise; nothing is inferred. Writers refuse to
overwrite, write to a staging folder first and publish by renaming it, so readers never see half a result.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from detlake.functions.keys import image_format

VOC_SCHEMA = (
    "folder string, filename string, size struct<width:string,height:string,depth:string>, "
    "object array<struct<name:string,bndbox:struct<xmin:string,ymin:string,xmax:string,ymax:string>>>"
)


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """One object a line; blank lines are skipped. Malformed lines fail, or come out in ``_corrupt``."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files of one object each."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """With a header; an empty field is null."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)


def read_texts(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """(path, stem, text): whole files to the last byte, recursively."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select("path", F.lower(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)).alias("stem"), F.col("content").cast("string").alias("text"))


def read_binary(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length, modified, sha256, md5, format) of files; the content stays out of the result."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select("path", "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"), image_format(F.col("content")).alias("format"))


def parse_voc(texts: DataFrame, text: str = "text") -> DataFrame:
    """Annotation XML in a column: width, height, object_index, raw_class and corner texts, one row an object.

    A document without objects has one row with a null object_index; a malformed one as well, and parse_error true.
    """
    parsed = texts.withColumn("_x", F.from_xml(F.col(text), VOC_SCHEMA + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    error = F.col("_x").isNull() | F.col("_x._corrupt").isNotNull()
    flat = parsed.withColumn("parse_error", error).select(*texts.columns, "parse_error", F.col("_x.size.width").try_cast("int").alias("width"), F.col("_x.size.height").try_cast("int").alias("height"), F.posexplode_outer("_x.object").alias("_i", "_o"))
    return flat.select(*texts.columns, "parse_error", "width", "height", (F.col("_i") + 1).alias("object_index"), F.col("_o.name").alias("raw_class"), *(F.col(f"_o.bndbox.{c}").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")))


def canonical_json(*columns: str) -> Column:
    """A row as compact JSON with keys in order and nulls written."""
    return F.to_json(F.struct(*(F.col(c) for c in sorted(columns))), {"ignoreNullFields": "false"})


def write_jsonl(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Canonical JSON lines, in order over all part files."""
    rows = df.orderBy(*order) if order else df
    _publish(rows.select(canonical_json(*df.columns).alias("value")), path, lambda w, p: w.text(p))


def write_csv(df: DataFrame, path: str, allow_empty: bool = True) -> None:
    if not allow_empty and df.isEmpty():
        raise ValueError("there is nothing to write")
    _publish(df, path, lambda w, p: w.option("header", True).csv(p))


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    _publish(df, path, lambda w, p: w.partitionBy(*(partition_by or [])).parquet(p))


def _publish(df: DataFrame, path: str, write) -> None:
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    if fs.exists(target):
        raise FileExistsError(path)
    staging = f"{path.rstrip('/')}.staging"
    write(df.write.mode("overwrite"), staging)
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(staging), target):
        raise OSError(f"{path} could not be published")


def strict_object(text: str) -> dict:
    """A JSON object without repeated keys or non-finite numbers (for small manifests)."""

    def pairs(items):
        out = dict(items)
        if len(out) != len(items):
            raise ValueError("a key is repeated")
        return out

    def constant(name):
        raise ValueError(f"{name} is not a number here")

    value = json.loads(text, object_pairs_hook=pairs, parse_constant=constant)
    if not isinstance(value, dict):
        raise ValueError("not an object")
    return value
