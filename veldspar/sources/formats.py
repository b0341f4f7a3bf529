"""Documents of several formats as DataFrames, and back. One row a document; whole files are split by Spark, not on the driver."""

from __future__ import annotations

import configparser
import json
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Documents over several lines."""
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema else r).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    r = spark.read
    return (r.schema(schema) if schema else r).json(path)


def read_variant(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines without a fixed schema: (document) as VARIANT; null for what is no JSON."""
    return spark.read.text(path).select(F.try_parse_json("value").alias("document"))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, header: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("header", header).csv(path)


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: T.StructType | str) -> DataFrame:
    """Attributes are fields named ``$name``, text beside them is ``$$``."""
    return spark.read.format("xml").schema(schema).option("rowTag", row_tag).option("attributePrefix", "$").option("valueTag", "$$").load(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _ini(text: str) -> dict:
    p = configparser.ConfigParser(interpolation=None, default_section="")
    p.optionxform = str
    p.read_string(text)
    return {s: dict(p[s]) for s in p.sections()}


def _decoded(path: DataFrame, decode) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p, text in zip(b["path"], b["text"], strict=True):
                try:
                    out.append((p, json.dumps(decode(text), default=str), None))
                except (ValueError, configparser.Error) as e:
                    out.append((p, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "json", "error"])

    return path.mapInPandas(run, "path string, json string, error string").select("path", F.try_parse_json("json").alias("document"), "error")


def read_toml(spark: SparkSession, path: str) -> DataFrame:
    """(path, document, error): a file that does not parse gives its error."""
    return _decoded(read_text(spark, path), tomllib.loads)


def read_ini(spark: SparkSession, path: str) -> DataFrame:
    """(path, document, error): sections as structs of strings."""
    return _decoded(read_text(spark, path), _ini)


def write_jsonl(df: DataFrame, path: str) -> None:
    """Nulls are absent fields and are not written."""
    df.write.option("ignoreNullFields", True).json(path)


def embed(spark: SparkSession, glob: str) -> DataFrame:
    """(path, text) of every file that a pattern names."""
    return read_text(spark, glob)
