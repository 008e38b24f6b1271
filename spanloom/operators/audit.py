"""Reports over span rows (type, value, confirmed, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.model import Referential


#: Types of rows that no detector makes, with their tags: hand-drawn rectangles and blanked metadata.
OTHER_TAGS = {"ZONE": "[ZONE]", "META": ""}


def _tag(referential: Referential) -> Column:
    tag = referential.tag_for(F.when(F.col("type").isin(*OTHER_TAGS), F.lit(None)).otherwise(F.col("type")))
    for type_, own in OTHER_TAGS.items():
        tag = F.when(F.col("type") == type_, own).otherwise(tag)
    return tag.alias("tag")


def audit_report(spans: DataFrame, referential: Referential, order: list[str], by: list[str] = []) -> DataFrame:  # noqa: B006
    """type, original, tag, occurrences, locations, confirme of each type and value, and of each `by` before them. spans needs location;
    locations are joined in the order given, repeats kept; confirme is oui if all occurrences are confirmed. All locations of a value make
    one text; where a value may be too frequent for that, audit_counts() and audit_locations() give the same as rows."""
    placed = F.sort_array(F.collect_list(F.struct(*order, F.col("location").alias("location"))))
    return spans.groupBy(*by, "type", F.col("value").alias("original")).agg(
        F.count("*").alias("occurrences"),
        F.array_join(F.transform(placed, lambda x: x["location"]), "; ").alias("locations"),
        F.when(F.bool_and("confirmed"), "oui").otherwise("non").alias("confirme"),
    ).select(*by, "type", "original", _tag(referential), "occurrences", "locations", "confirme")


def audit_counts(spans: DataFrame, referential: Referential, by: list[str] = []) -> DataFrame:  # noqa: B006
    """audit_report() without locations: an aggregate that is partly done before its shuffle, however frequent a value is."""
    counted = spans.groupBy(*by, "type", F.col("value").alias("original")).agg(F.count("*").alias("occurrences"), F.when(F.bool_and("confirmed"), "oui").otherwise("non").alias("confirme"))
    return counted.select(*by, "type", "original", _tag(referential), "occurrences", "confirme")


def audit_locations(spans: DataFrame, order: list[str], by: list[str] = []) -> DataFrame:  # noqa: B006
    """type, original, the columns of order and location of each occurrence, as a row; nothing is shuffled."""
    return spans.select(*by, "type", F.col("value").alias("original"), *order, "location")


def value_counts(spans: DataFrame) -> DataFrame:
    return spans.groupBy("type", "value").agg(F.count("*").alias("occurrences"))


def risk(spans: DataFrame, referential: Referential, keys: list[str] | None = None) -> DataFrame:
    """The risk of the most sensitive span: Élevé, Moyen or Faible."""
    top = F.coalesce(F.max(referential.rank_for(F.col("type"))), F.lit(0))
    level = F.when(top >= 3, "Élevé").when(top == 2, "Moyen").otherwise("Faible").alias("risk")
    return spans.groupBy(*keys).agg(level) if keys else spans.agg(level)


def risk_of(spans: Column, referential: Referential) -> Column:
    top = F.coalesce(F.array_max(F.transform(spans, lambda s: referential.rank_for(s["type"]))), F.lit(0))
    return F.when(top >= 3, "Élevé").when(top == 2, "Moyen").otherwise("Faible")


def statistics(spans: DataFrame, referential: Referential) -> DataFrame:
    """detected, categories, to_mask, to_keep and risk of the retained. spans needs retained."""
    top = F.coalesce(F.max(F.when(F.col("retained"), referential.rank_for(F.col("type")))), F.lit(0))
    return spans.agg(
        F.count("*").alias("detected"), F.count_distinct("type").alias("categories"), F.count_if("retained").alias("to_mask"), F.count_if(~F.col("retained")).alias("to_keep"),
        F.when(top >= 3, "Élevé").when(top == 2, "Moyen").otherwise("Faible").alias("risk"),
    )


def retained_per_type(spans: DataFrame) -> DataFrame:
    return spans.groupBy("type").agg(F.count("*").alias("total"), F.count_if("retained").alias("retained"))


def metadata_rows(fields: DataFrame) -> DataFrame:
    """Audit rows of a document's metadata fields (label, value and any others) that aren't blank."""
    rows = fields.where(F.length(F.trim("value")) > 0)
    return rows.withColumns({"type": F.lit("META"), "confirmed": F.lit(True), "location": F.concat(F.lit("Métadonnées / "), F.col("label"))}).drop("label")
