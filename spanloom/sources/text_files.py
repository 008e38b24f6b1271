"""Whole text files in and out, and the choice of their encoding."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.validators import output_name


class UnsupportedFormat(ValueError):
    pass


class CorruptDocument(ValueError):
    pass


class EncryptedDocument(ValueError):
    pass


class ScannedDocument(ValueError):
    pass


FORMATS = ("txt", "csv", "xlsx", "docx", "pptx")


def format_of(path: str) -> str:
    """Lower-cased suffix, if there is a reader for it."""
    suffix = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if suffix not in FORMATS:
        raise UnsupportedFormat(path)
    return suffix


def encoding_of(content: Column) -> Column:
    """utf-8 where the bytes are valid UTF-8, else cp1252."""
    return F.when(F.is_valid_utf8(content.cast("string")), "utf-8").otherwise("cp1252")


def decode(content: bytes) -> tuple[str, str]:
    try:
        return content.decode("utf-8"), "utf-8"
    except UnicodeDecodeError:
        return content.decode("cp1252"), "cp1252"


def read_texts(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, text, encoding of each file; a file is one row. UTF-8 is decoded in the JVM, other files by an Arrow stage."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [decode(c) for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in found], pa.string()), pa.array([e for _, e in found], pa.string())], names=["path", "text", "encoding"])

    return files.mapInArrow(run, "path string, text string, encoding string")


def encoded(texts: DataFrame, text: str = "text") -> DataFrame:
    """texts with content, the bytes of text in the file's own encoding; a character that it doesn't have is an error."""

    @F.pandas_udf("binary")
    def encode(values, encodings):
        import pandas as pd

        return pd.Series([None if v is None else v.encode(e) for v, e in zip(values, encodings, strict=True)])

    return texts.withColumn("content", encode(F.col(text), F.col("encoding")))


def write_texts(texts: DataFrame, folder: str, text: str = "text") -> None:
    """Writes each UTF-8 text as a line-free record of text files below folder."""
    texts.select(F.col(text).alias("value")).write.option("lineSep", "\n").text(folder)


def _local(uri: str) -> str:
    """file:/x as a plain path, which all versions of the file system layer take."""
    return re.sub(r"^file:/+", "/", uri)


def write_files(contents: DataFrame, folder: str, at: Column) -> DataFrame:
    """Writes the bytes of each file (path, content) into a folder that executors share, under its output name, and gives path, output.

    A file is written beside its place and then moved there, so that a task that runs twice leaves one whole file. Sources of one name
    in different folders would meet in one output: an error.
    """
    named = contents.withColumn("output", F.concat(F.lit(folder.rstrip("/") + "/"), output_name(F.regexp_extract("path", r"[^/]+$", 0), at)))
    if twice := named.groupBy("output").count().where("count > 1").head():
        raise ValueError(f"several sources for {twice['output']}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        for batch in batches:
            for content, output in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                system, place = fs.FileSystem.from_uri(_local(output))
                system.create_dir(place.rpartition("/")[0])
                beside = f"{place}.{uuid.uuid4().hex}"
                with system.open_output_stream(beside) as out:
                    out.write(content)
                system.move(beside, place)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)], names=["path", "output"])

    named.select("path", "content", "output").mapInArrow(run, "path string, output string").write.format("noop").mode("overwrite").save()
    return named.select("path", "output")
