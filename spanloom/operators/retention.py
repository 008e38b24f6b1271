"""Review policies: which spans, cells and columns stay masked."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.validators import looks_structured


@dataclass(frozen=True)
class Policy:
    """Toggles of a review. Small ones are literals; excluded places are frames joined on their keys.

    types_off: types not to mask; values: (type, value) -> masked or not; columns: enabled columns (None: all).
    """

    types_off: tuple[str, ...] = ()
    values: dict[tuple[str, str], bool] = field(default_factory=dict)
    columns: tuple[int, ...] | None = None

    def type_on(self, type_: Column) -> Column:
        return ~type_.isin(*self.types_off) if self.types_off else F.lit(True)

    def value_on(self, type_: Column, value: Column, default: Column) -> Column:
        return reduce(lambda rest, kv: F.when((type_ == kv[0][0]) & (value == kv[0][1]), F.lit(kv[1])).otherwise(rest), self.values.items(), default)


def retain(spans: DataFrame, policy: Policy, default: Column | None = None, excluded: DataFrame | None = None, on: list[str] | None = None) -> DataFrame:
    """spans with retained: its column is on, its place isn't excluded, its type is on and its value is on (by default: confirmed)."""
    default = F.col("confirmed") if default is None else default
    held = policy.type_on(F.col("type")) & policy.value_on(F.col("type"), F.col("value"), default)
    if policy.columns is not None:
        held = held & F.col("column_id").isin(*policy.columns)
    if excluded is None:
        return spans.withColumn("retained", held)
    marked = spans.join(excluded.select(*on).distinct().withColumn("__out", F.lit(True)), on, "left")
    return marked.withColumn("retained", held & F.col("__out").isNull()).drop("__out")


def toggled(spans: DataFrame, toggles: DataFrame, on: list[str], policy: Policy = Policy()) -> DataFrame:
    """spans with retained from a frame of toggles (on columns, keep): the toggle or else confirmed, and the type is on."""
    rows = spans.join(toggles.select(*on, F.col("keep").alias("__keep")), on, "left")
    return rows.withColumn("retained", F.coalesce("__keep", "confirmed") & policy.type_on(F.col("type"))).drop("__keep")


def first_confirmed(spans: DataFrame, order: list[str]) -> DataFrame:
    """type, value, on (confirmed of the first occurrence), confirmed (of all): the defaults of value toggles."""
    return spans.groupBy("type", "value").agg(F.min_by("confirmed", F.struct(*order)).alias("on"), F.bool_and("confirmed").alias("confirmed"))


def with_defaults(spans: DataFrame, order: list[str]) -> DataFrame:
    """spans with value_on: whether the first occurrence of their type and value, by order, is confirmed. The defaults are one row for each value
    and are joined, so a frequent value is split among tasks."""
    own = first_confirmed(spans, order).select(F.col("type").alias("__type"), F.col("value").alias("__value"), F.col("on").alias("value_on"))
    return spans.join(own, (F.col("type") == F.col("__type")) & (F.col("value") == F.col("__value"))).drop("__type", "__value")


def retain_units(spans: DataFrame, policy: Policy, side: Column, order: list[str]) -> DataFrame:
    """The review of a document's units: spans with retained. In main parts the type and the value are on, a value by default if its first
    occurrence there is confirmed; side parts (comments, notes) aren't reviewed and keep their confirmed spans whatever the toggles."""
    main = retain(with_defaults(spans.where(~side), order), policy, F.col("value_on")).drop("value_on")
    return main.unionByName(spans.where(side).withColumn("retained", F.col("confirmed")))


def retain_occurrences(spans: DataFrame, policy: Policy, order: list[str], excluded: DataFrame | None = None, on: list[str] | None = None) -> DataFrame:
    """The review of pages: type and value are on, and the occurrence isn't among those excluded (rows of the columns `on`)."""
    return retain(with_defaults(spans, order), policy, F.col("value_on"), excluded, on).drop("value_on")


def rects_by_page(spans: DataFrame, manual: DataFrame, order: list[str]) -> DataFrame:
    """doc_id, page, rects to black out: those of retained spans (doc_id, page, rects, retained), in order, then hand-drawn ones (doc_id, page,
    rect). Rectangles that repeat count once; a page bounds the group."""
    found = spans.where("retained").select("doc_id", "page", F.lit(0).alias("drawn"), F.struct(*order).alias("at"), "rects")
    drawn = manual.select("doc_id", "page", F.lit(1).alias("drawn"), F.lit(None).cast(found.schema["at"].dataType).alias("at"), F.array("rect").alias("rects"))
    listed = F.sort_array(F.collect_list(F.struct("drawn", "at", "rects")))
    return found.unionByName(drawn).groupBy("doc_id", "page").agg(F.array_distinct(F.flatten(F.transform(listed, lambda x: x["rects"]))).alias("rects"))


def zone_rows(manual: DataFrame) -> DataFrame:
    """Audit rows of hand-drawn rectangles (doc_id, page from 0): type ZONE, at their page."""
    return manual.select("doc_id", "page", F.lit("ZONE").alias("type"), F.lit("(zone manuelle)").alias("value"), F.lit(True).alias("confirmed"), F.concat(F.lit("page "), (F.col("page") + 1).cast("string")).alias("location"))


def pending(spans: DataFrame) -> DataFrame:
    """Unconfirmed spans that aren't retained."""
    return spans.where(~F.col("confirmed") & ~F.col("retained"))


def column_profile(rows: DataFrame, cells: str = "cells", header: bool = True, row_id: str = "row_id") -> DataFrame:
    """column_id, maskable: whether a data cell of the column has a letter."""
    body = rows.where(F.col(row_id) > 0) if header else rows
    flat = body.select(F.posexplode(cells).alias("column_id", "cell"))
    return flat.groupBy("column_id").agg(F.bool_or(~looks_structured(F.col("cell"))).alias("maskable"))


def maskable_columns(rows: DataFrame, cells: str = "cells", header: bool = True, row_id: str = "row_id", include: set[int] | None = None, exclude: set[int] = frozenset()) -> list[int]:
    """Default columns, or include in their place, less exclude."""
    if include is None:
        include = {r["column_id"] for r in column_profile(rows, cells, header, row_id).where("maskable").collect()}
    return sorted(set(include) - set(exclude))


def page(rows: DataFrame, index: int, order: list[str], size: int = 20) -> DataFrame:
    """Page index of rows, the index moved into range; an empty frame has one empty page."""
    last = max(1, -(-rows.count() // size)) - 1
    return rows.orderBy(*order).offset(min(max(index, 0), last) * size).limit(size)


def page_after(rows: DataFrame, order: list[str], last: tuple | None = None, size: int = 20) -> DataFrame:
    """The page that follows the row with the values `last` in the columns of order, which must tell rows apart and not be null; the first
    page without it. However deep, it sorts no more than its own rows."""
    if last is not None:
        later = F.lit(False)
        for column, value in reversed(list(zip(order, last, strict=True))):
            later = (F.col(column) > F.lit(value)) | ((F.col(column) == F.lit(value)) & later)
        rows = rows.where(later)
    return rows.orderBy(*order).limit(size)


def page_count(rows: DataFrame, size: int = 20) -> DataFrame:
    return rows.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / size)).cast("long").alias("pages"))


def with_manual_rects(spans: DataFrame, rects: DataFrame) -> DataFrame:
    """Span rows (page, type, value, rects, retained) with hand-drawn rectangles (page, rect), which are always retained."""
    drawn = rects.select("page", F.lit("ZONE").alias("type"), F.lit("(zone manuelle)").alias("value"), F.array("rect").alias("rects"), F.lit(True).alias("retained"))
    return spans.select("page", "type", "value", "rects", "retained").unionByName(drawn)
