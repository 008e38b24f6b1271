"""Whole files in, masked files and their audit out, for every format that has a reader."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.validators import column_label
from spanloom.operators import merge as M
from spanloom.operators.audit import audit_report, metadata_rows
from spanloom.plans.pipeline import Config, anonymize_cells, detect, exploded, retained
from spanloom.sources import delimited, office, text_files
from spanloom.sources.text_files import FORMATS, format_of, write_files


class FileResults(NamedTuple):
    """files: path and output of each file that was written; audit: path and the columns of audit_report()."""

    files: DataFrame
    audit: DataFrame


class _Masked(NamedTuple):
    contents: DataFrame  # path, content
    spans: DataFrame  # path, first, second, type, value, start, confirmed, location


SPAN_ROWS = ["path", "first", "second", "type", "value", "start", "confirmed", "location"]


def _texts(spark: SparkSession, path: str, glob: str, config: Config) -> _Masked:
    found = detect(text_files.read_texts(spark, path, glob), config).withColumn("spans", retained(F.col("spans"), config))
    masked = found.withColumn("masked", M.mask(F.col("text"), F.col("spans"), config.referential))
    rows = exploded(found, ["path"]).withColumns({"first": F.lit(0).cast("long"), "second": F.lit(0), "location": F.lit("texte")})
    return _Masked(text_files.encoded(masked, "masked").select("path", "content"), rows.select(*SPAN_ROWS))


def _cells(spark: SparkSession, path: str, glob: str, config: Config, include: set[int] | None, exclude: set[int]) -> _Masked:
    rows = delimited.read_rows(spark, path, glob)
    columns = F.col("text_columns") if include is None else F.array(*map(F.lit, sorted(include))).cast("array<int>")
    chosen = F.array_except(columns, F.array(*map(F.lit, sorted(exclude))).cast("array<int>"))
    masked = anonymize_cells(rows, config, chosen, header=F.col("has_header"), spans="spans")
    flat = masked.select("path", F.col("row_id").alias("first"), "header", F.posexplode("spans").alias("second", "own"))
    location = F.concat(column_label(F.col("header"), F.col("second")), F.lit(" L"), (F.col("first") + 1).cast("string"))
    return _Masked(delimited.file_content(masked), exploded(flat.withColumn("location", location), ["path", "first", "second", "location"], "own").select(*SPAN_ROWS))


def _packages(spark: SparkSession, path: str, glob: str, config: Config) -> _Masked:
    found = detect(office.read_units(spark, path, glob), config).withColumn("spans", retained(F.col("spans"), config))
    masked = found.withColumn("runs", M.mask_runs(F.col("runs"), F.col("spans"), config.referential))
    packages = office.masked_packages(spark, path, masked, glob)
    rows = exploded(found, ["path", "unit_id", "location"]).withColumns({"first": F.col("unit_id"), "second": F.lit(0)}).select(*SPAN_ROWS)
    fields = packages.select("path", F.posexplode("purged").alias("second", "p")).select("path", F.lit(2**62).alias("first"), "second", F.lit(0).alias("start"), F.col("p.label").alias("label"), F.col("p.original").alias("value"))
    blanked = metadata_rows(fields).select(*SPAN_ROWS)
    return _Masked(packages.select("path", "content"), rows.unionByName(blanked))


def anonymize_files(spark: SparkSession, path: str, folder: str, config: Config = Config(), at: Column | None = None, include: set[int] | None = None, exclude: set[int] = frozenset()) -> FileResults:
    """Masks a file, or all files of a folder or pattern, writes them into `folder` under their output names and reports what was masked.

    The suffix tells the format; a single file without a reader is UnsupportedFormat, among several those with a reader are taken. include and
    exclude choose columns of delimited files; for workbooks they aren't supported, for other formats they don't matter. Unconfirmed spans stay
    clear but in workbooks. Files are looked at once to be written, and again when the audit is read.
    """
    suffix = path.rsplit("/", 1)[-1].rpartition(".")[2]
    single = suffix and not any(c in path.rsplit("/", 1)[-1] for c in "*?[{") and "." in path.rsplit("/", 1)[-1]
    wanted = (format_of(path),) if single else FORMATS
    if single and wanted == ("xlsx",) and (include is not None or exclude):
        raise NotImplementedError("columns of a workbook can't be chosen")
    at = F.current_timestamp() if at is None else at
    done: list[_Masked] = []
    for kind in wanted:
        glob = "*." + "".join(f"[{c}{c.upper()}]" for c in kind)
        if spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path").isEmpty():
            continue
        if kind == "txt":
            done.append(_texts(spark, path, glob, config))
        elif kind == "csv":
            done.append(_cells(spark, path, glob, config, include, exclude))
        else:
            done.append(_packages(spark, path, glob, replace(config, mask_unconfirmed=True) if kind == "xlsx" else config))
    if not done:
        raise FileNotFoundError(path)
    contents, spans = (reduce(DataFrame.unionByName, parts) for parts in zip(*done, strict=True))
    return FileResults(write_files(contents, folder, at), audit_report(spans, config.referential, ["first", "second", "start"], ["path"]))
