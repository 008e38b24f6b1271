"""Pages of positioned words: reading order, text, propagation of values.

Word rows: doc_id, page, block, line, word_no, text, x0, y0, x1, y1. Everything is by page, so a page is the unit of distribution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.validators import normalize, propagatable
from spanloom.model import span

PAGE = ["doc_id", "page"]


def native_documents(pages: DataFrame, least: int = 10) -> DataFrame:
    """doc_id, native: whether a page has at least ten characters that aren't outer white space."""
    return pages.groupBy("doc_id").agg(F.coalesce(F.bool_or(F.length(F.regexp_replace("text", r"(?U)^\s+|\s+$", "")) >= least), F.lit(False)).alias("native"))


def reading_order(words: DataFrame) -> DataFrame:
    """words with vertical and place (1, 2, ... in a page): upright blocks by top (in steps of ten) and left edge, then vertical blocks by left and top
    edge; inside a block by line and word. A block is vertical if most of its words of two or more characters are taller than wide."""
    longer = F.length("text") >= 2
    block = Window.partitionBy(*PAGE, "block")
    tall = F.coalesce(F.sum(F.when(longer, ((F.col("y1") - F.col("y0")) > (F.col("x1") - F.col("x0"))).cast("int"))).over(block), F.lit(0))
    marked = words.withColumns({"vertical": 2 * tall > F.coalesce(F.sum(longer.cast("int")).over(block), F.lit(0)), "bx": F.min("x0").over(block), "by": F.min("y0").over(block)})
    first = F.when(F.col("vertical"), F.col("bx")).otherwise(F.bround(F.col("by") / 10) * 10)
    second = F.when(F.col("vertical"), F.col("by")).otherwise(F.col("bx"))
    order = Window.partitionBy(*PAGE).orderBy("vertical", first, second, "block", "line", "word_no")
    return marked.withColumn("place", F.row_number().over(order)).drop("bx", "by")


def page_words(ordered: DataFrame) -> DataFrame:
    """ordered words with char_start and char_end in the page's text: words are joined by a space, or a new line where block or line changes."""
    order = Window.partitionBy(*PAGE).orderBy("place")
    changed = (F.lag("block").over(order) != F.col("block")) | (F.lag("line").over(order) != F.col("line"))
    sep = F.when(F.lag("place").over(order).isNull(), "").when(changed, "\n").otherwise(" ")
    rows = ordered.withColumn("sep", sep)
    end = F.sum(F.length("sep") + F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("char_end", end.cast("int")).withColumn("char_start", (F.col("char_end") - F.length("text")).cast("int"))


def page_texts(placed: DataFrame) -> DataFrame:
    """doc_id, page, text, words of each page; a page bounds the group."""
    word = F.struct("place", "sep", "text", F.struct("x0", "y0", "x1", "y1").alias("rect"), "char_start", "char_end")
    rows = placed.groupBy(*PAGE).agg(F.sort_array(F.collect_list(word)).alias("all"))
    return rows.select(
        *PAGE, F.array_join(F.transform("all", lambda w: F.concat(w["sep"], w["text"])), "").alias("text"),
        F.transform("all", lambda w: F.struct(w["text"].alias("text"), w["rect"].alias("rect"), w["char_start"].alias("char_start"), w["char_end"].alias("char_end"))).alias("words"),
    )


def page_counts(pages: DataFrame) -> DataFrame:
    """doc_id, pages: how many pages each document has."""
    return pages.groupBy("doc_id").agg(F.count_distinct("page").alias("pages"))


def document_texts(pages: DataFrame) -> DataFrame:
    """doc_id, text: pages joined by a blank line."""
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "\n\n").alias("text"))


def propagation_targets(spans: DataFrame) -> DataFrame:
    """doc_id, norm, n, type, value: each normalised value of confirmed spans that may be propagated, with the first type and wording. spans: doc_id, page, seq, type, value, confirmed."""
    fit = spans.where(F.col("confirmed") & propagatable(F.col("value"))).withColumn("norm", normalize(F.col("value")))
    first = fit.groupBy("doc_id", "norm").agg(F.min_by(F.struct("type", "value"), F.struct("page", "seq")).alias("t"))
    return first.select("doc_id", "norm", F.size(F.split("norm", " ")).alias("n"), "t.type", "t.value")


def propagated(placed: DataFrame, targets: DataFrame) -> DataFrame:
    """doc_id, page, span: whole-word places of targets on all pages, found left to right without overlap of one target with itself.

    Runs of words meet targets by an equi-join on document, length and words, so no page is compared with every target.
    """
    order = Window.partitionBy(*PAGE).orderBy("place")
    words = placed.select(*PAGE, "place", "char_start", "char_end", normalize(F.col("text")).alias("norm_word"))
    lengths = targets.select("doc_id", "n").distinct().groupBy("doc_id").agg(F.collect_set("n").alias("lengths"), F.max("n").alias("most"))
    rows = words.join(lengths, "doc_id")
    ahead = rows.withColumn("i", F.row_number().over(order))
    pages_ = ahead.groupBy(*PAGE, "lengths").agg(F.sort_array(F.collect_list(F.struct("i", "norm_word", "char_start", "char_end"))).alias("w"))
    runs = pages_.select(*PAGE, "w", F.explode("lengths").alias("n")).select(
        *PAGE, "n", F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - F.col("n"), F.lit(0))), lambda k: F.struct(
            k.alias("at"), F.array_join(F.transform(F.slice("w", k + 1, F.col("n")), lambda x: x["norm_word"]), " ").alias("norm"),
            F.get(F.col("w"), k)["char_start"].alias("a"), F.get(F.col("w"), k + F.col("n") - 1)["char_end"].alias("b")))).alias("run"),
    ).select(*PAGE, "n", "run.*").where("b IS NOT NULL")
    hits = runs.join(targets, ["doc_id", "n", "norm"])
    grouped = hits.groupBy(*PAGE, "norm", "n", "type", "value").agg(F.sort_array(F.collect_list(F.struct("at", "a", "b"))).alias("found"))
    start = F.struct(F.lit(-1).alias("next"), F.array().cast("array<struct<a:int,b:int>>").alias("out"))
    picked = F.aggregate("found", start, lambda acc, f: F.when(f["at"] < acc["next"], acc).otherwise(
        F.struct((f["at"] + F.col("n")).alias("next"), F.array_append(acc["out"], F.struct(f["a"].alias("a"), f["b"].alias("b"))).alias("out"))), lambda acc: acc["out"])
    return grouped.select(*PAGE, "type", "value", F.explode(picked).alias("p")).select(*PAGE, span(F.col("type"), F.col("value"), F.col("p.a"), F.col("p.b"), "propagated").alias("span"))
