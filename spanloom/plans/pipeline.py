"""The detection plan: one column expression for a text, and the frames built on it."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.spans import let
from spanloom.model import Referential, no_spans
from spanloom.operators import detectors as D
from spanloom.operators import merge as M
from spanloom.operators.audit import audit_report
from spanloom.rules import Rules


@dataclass(frozen=True)
class Config:
    referential: Referential = field(default_factory=Referential)
    rules: Rules = field(default_factory=Rules)
    recognizer: object = field(default_factory=D.NullRecognizer)
    mask_unconfirmed: bool = False


def candidates(text: Column, config: Config, recognized: Column | None = None) -> Column:
    """All spans before resolution: deterministic, secrets, recogniser, forced. Only detectors of active types are planned, and the
    recogniser only if a type it finds is active; recognized are its spans where they are known already."""
    ref = config.referential
    found = [D.deterministic(text, t) for t in D.PATTERNS if ref.is_active(t)]
    known = [D.contextual(text, t) for t in D.CONTEXT if ref.is_active(t)]
    found += known
    if ref.is_active("PASSWORD"):
        found.append(D.secret_shapes(text, F.concat(*known) if known else None))
    if codes := ref.active_by_method("ner"):
        own = config.recognizer.spans(text, codes) if recognized is None else recognized
        found.append(F.filter(own, lambda s: ref.active_column(s["type"])))
    found.append(config.rules.forced_spans(text))
    return F.concat(*found) if found else no_spans()


def detect(docs: DataFrame, config: Config = Config(), text: str = "text", into: str = "spans") -> DataFrame:
    """docs with the resolved spans of a text. Keep rules take effect after the resolution, so a kept span still shadows its rivals."""
    step = docs.withColumn("__candidates", candidates(F.col(text), config)).withColumn(into, M.merge(F.col("__candidates"))).drop("__candidates")
    if config.rules.live("keep"):
        step = step.withColumn(into, F.filter(into, lambda s: ~config.rules.keeps(s["value"])))
    return step


def retained(spans: Column, config: Config) -> Column:
    return spans if config.mask_unconfirmed else M.confirmed_only(spans)


class Result(NamedTuple):
    masked: DataFrame
    spans: DataFrame
    audit: DataFrame


def exploded(found: DataFrame, keys: list[str], spans: str = "spans") -> DataFrame:
    """One row for each span, with keys before its fields."""
    return found.select(*keys, F.explode(spans).alias("s")).select(*keys, "s.*")


def anonymize(docs: DataFrame, key: str, config: Config = Config(), text: str = "text", location: Column | None = None) -> Result:
    """Masked texts, their retained spans and the audit. Nothing but the audit is shuffled."""
    found = detect(docs, config, text).withColumn("spans", retained(F.col("spans"), config))
    masked = found.withColumn("masked", M.mask(F.col(text), F.col("spans"), config.referential))
    rows = exploded(found, [key])
    where = F.col(key).cast("string") if location is None else location
    return Result(masked, rows, audit_report(rows.withColumn("location", where), config.referential, [key, "start"]))


def anonymize_cells(rows: DataFrame, config: Config = Config(), columns: Column | list[int] | None = None, cells: str = "cells", header: Column | bool = True, row_id: str = "row_id", spans: str | None = None) -> DataFrame:
    """rows with the cells of the given columns masked in place, header rows excepted; all other columns of rows stay.

    columns: numbers, or a column of numbers for each row, as where rows of several files stand together; None: maskable_columns(), which runs a
    query. header: whether row 0 is one. spans names a column to add: the retained spans of each cell. Cells are masked inside their array, so
    nothing is shuffled; only cells that are to be masked are looked at.
    """
    from spanloom.operators.retention import maskable_columns

    if columns is None:
        columns = maskable_columns(rows, cells, True if isinstance(header, Column) else header, row_id)
    chosen = columns if isinstance(columns, Column) else F.array(*map(F.lit, columns)).cast("array<int>")
    body = ~(F.lit(header) if isinstance(header, bool) else header) | (F.col(row_id) > 0)
    work = next(w for w in ("__spans", "___spans", "____spans") if w not in rows.columns)
    codes, model = config.referential.active_by_method("ner"), getattr(config.recognizer, "array_spans", None)
    step, recognized = rows, None
    if codes and model is not None:
        step = rows.withColumn(work + "_found", model(F.when(body, F.transform(cells, lambda c, i: F.when(F.array_contains(chosen, i), c))), codes))
        recognized = lambda i: F.coalesce(F.get(F.col(work + "_found"), i), no_spans())

    def found(c: Column, i: Column) -> Column:
        resolved = let(candidates(c, config, recognized(i) if recognized else None), M.merge)
        if config.rules.live("keep"):
            resolved = F.filter(resolved, lambda s: ~config.rules.keeps(s["value"]))
        return F.when(body & c.isNotNull() & F.array_contains(chosen, i), retained(resolved, config)).otherwise(no_spans())

    step = step.withColumn(work, F.transform(cells, found))
    step = step.withColumn(cells, F.transform(cells, lambda c, i: let(F.get(F.col(work), i), lambda s: M.mask(c, s, config.referential))))
    return (step.withColumnRenamed(work, spans) if spans else step.drop(work)).drop(work + "_found")


def distinct_texts(units: DataFrame, text: str = "text") -> DataFrame:
    """Each text of units once, and how many units have it."""
    return units.groupBy(text).agg(F.count("*").alias("units"))


def anonymize_distinct(units: DataFrame, config: Config, text: str = "text") -> DataFrame:
    """units with spans, each distinct text being looked at once: worth two shuffles where a model recognises."""
    once = detect(distinct_texts(units, text).select(text), config, text)
    return units.join(once.withColumnRenamed(text, "__text"), F.col(text).eqNullSafe(F.col("__text")), "left").drop("__text")
