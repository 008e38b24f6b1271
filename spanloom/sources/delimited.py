"""Delimited files: dialect, ragged rows with their numbers, and writing back."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.sources.text_files import decode, read_texts

#: Separators in order of preference, and the one taken if nothing better is found.
STRUCTURAL, FALLBACK, DEFAULT = (";", "|", "\t"), (",",), ";"
SAMPLE = 4096


@dataclass(frozen=True)
class Dialect:
    delimiter: str
    encoding: str
    has_header: bool
    line_end: str


def delimiter_of(sample: str) -> str:
    """The separator that each line has equally often and most often; structural ones before the comma."""
    if "\n" in sample and not sample.endswith("\n"):
        sample = sample.rpartition("\n")[0]
    lines = [x for x in sample.splitlines() if x]
    for group in (STRUCTURAL, FALLBACK):
        counts = {d: {x.count(d) for x in lines} for d in group}
        steady = {d: max(c) for d, c in counts.items() if len(c) == 1 and max(c) > 0}
        if steady:
            return max(steady, key=lambda d: (steady[d], -group.index(d)))
    return DEFAULT


def dialect_of(content: bytes) -> Dialect:
    text, encoding = decode(content)
    try:
        header = csv.Sniffer().has_header(text[:SAMPLE])
    except (csv.Error, ValueError):  # the sniffer may guess a separator that its own reader refuses
        header = False
    return Dialect(delimiter_of(text[:SAMPLE]), encoding, header, "\r\n" if "\r\n" in text else "\n")


def delimiter_votes(lines: DataFrame, key: str) -> DataFrame:
    """key, delimiter of each sample of lines (key, line), as an aggregate."""
    marks = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(i).alias("rank"), F.lit(d in STRUCTURAL).alias("first")) for i, d in enumerate(STRUCTURAL + FALLBACK)])
    votes = lines.where(F.length("line") > 0).select(key, "line", F.explode(marks).alias("m"))
    count = F.length("line") - F.length(F.replace(F.col("line"), F.col("m.d"), F.lit("")))
    held = votes.groupBy(key, "m").agg(F.min(count).alias("low"), F.max(count).alias("high")).where("low = high AND high > 0")
    best = held.groupBy(key).agg(F.max_by("m.d", F.struct("m.first", "high", (-F.col("m.rank")).alias("r"))).alias("delimiter"))
    return lines.select(key).distinct().join(best, key, "left").select(key, F.coalesce("delimiter", F.lit(DEFAULT)).alias("delimiter"))


def text_columns(rows: list[list[str]], has_header: bool) -> list[int]:
    """Columns that have a letter in a data cell."""
    return sorted({i for row in rows[has_header:] for i, cell in enumerate(row) if any(map(str.isalpha, cell))})


ROWS = "path string, row_id long, cells array<string>, delimiter string, encoding string, has_header boolean, line_end string, header array<string>, text_columns array<int>"


def read_rows(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, row_id (from 0, header included), cells array<string>, dialect, header cells (none without a header), columns with text. Rows stay
    ragged; a file is parsed by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path_, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                d = dialect_of(content)
                rows = list(csv.reader(io.StringIO(decode(content)[0], newline=""), delimiter=d.delimiter))
                header, with_text = rows[0] if d.has_header and rows else [], text_columns(rows, d.has_header)
                for at in range(0, len(rows), 10_000):
                    part = rows[at : at + 10_000]
                    n = len(part)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path_] * n, pa.string()), pa.array(range(at, at + n), pa.int64()), pa.array(part, pa.list_(pa.string())), pa.array([d.delimiter] * n, pa.string()),
                         pa.array([d.encoding] * n, pa.string()), pa.array([d.has_header] * n, pa.bool_()), pa.array([d.line_end] * n, pa.string()), pa.array([header] * n, pa.list_(pa.string())),
                         pa.array([with_text] * n, pa.list_(pa.int32()))],
                        names=["path", "row_id", "cells", "delimiter", "encoding", "has_header", "line_end", "header", "text_columns"],
                    )

    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content").mapInArrow(run, ROWS)


def read_flat(spark: SparkSession, path: str, delimiter: str, has_header: bool) -> DataFrame:
    """Large files without ragged rows: Spark's own splittable reader, all columns strings."""
    return spark.read.csv(path, sep=delimiter, header=has_header, inferSchema=False, multiLine=False)


def file_content(rows: DataFrame) -> DataFrame:
    """path, content: the bytes of each file from its rows, least quoting, in its own dialect and encoding; a character that the encoding
    doesn't have is an error."""

    def write(key: tuple, table: pa.Table) -> pa.Table:
        first = table.slice(0, 1).to_pylist()[0]
        out = io.StringIO(newline="")
        writer = csv.writer(out, delimiter=first["delimiter"], lineterminator=first["line_end"])
        order = sorted(zip(table.column("row_id").to_pylist(), table.column("cells").to_pylist(), strict=True), key=lambda r: r[0])
        writer.writerows(cells for _, cells in order)
        return pa.table({"path": [key[0].as_py()], "content": [out.getvalue().encode(first["encoding"])]})

    return rows.groupBy("path").applyInArrow(write, "path string, content binary")


def audit_csv(audit: DataFrame, folder: str) -> None:
    audit.select("type", "original", "tag", "occurrences", "locations", "confirme").write.csv(folder, header=True)


def audit_json(audit: DataFrame, folder: str) -> None:
    audit.write.json(folder)


__all__ = ["Dialect", "audit_csv", "audit_json", "delimiter_of", "delimiter_votes", "dialect_of", "file_content", "read_flat", "read_rows", "read_texts"]
