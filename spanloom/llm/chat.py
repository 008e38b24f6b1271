"""Chat formatting by perspective rotation, with DataFrame functions only.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant, all others as named users and
system turns as they are. The mask names the character ranges a model learns from: the assistant's own texts with their end marks.

A dialogue is rendered in parts of PART turns, so that one endless conversation is many rows and never one group; parts joined in order
are the whole. Turns are in the order of turn, then role, then text. They are numbered without bringing a conversation together: all turns
are sorted in ranges, and a range's turns are numbered on from the counts of the ranges before it. Participants are joined as rows.

Repeated rows stay: equal turns follow each other, and up to PART of them count as one turn of their part. A null text is empty, an empty
one is rendered as an empty turn; texts of any length are rendered whole. A null role is "unknown", a null turn comes first; a null conv_id
is one conversation. A conversation of system turns only has no perspective. Marks that occur in a text are broken up by a space. An empty
table gives an empty result. Other columns are not read, so none clashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import storage

PART = 64
SYSTEM = "system"
END = "<|end|>\n"


def _head(role: Column, perspective: Column) -> Column:
    named = F.concat(F.lit("<|user:"), role, F.lit("|>\n"))
    return F.when(role == SYSTEM, F.lit("<|system|>\n")).when(role == perspective, F.lit("<|assistant|>\n")).otherwise(named)


def _numbered(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text, k) with number: 0, 1, ... in their conversation."""
    order = ["conv_id", "turn", "role", "text", "k"]
    placed = turns.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id())
    placed = storage.table(placed.withColumn("range", F.shiftright("id", 33)))
    ranges = placed.groupBy("conv_id", "range").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))  # as many rows as a conversation has ranges
    base = ranges.select(F.col("conv_id").alias("own_conv"), F.col("range").alias("own_range"), (F.coalesce(before, F.lit(0)) - F.col("first")).alias("base"))
    same = F.col("conv_id").eqNullSafe(F.col("own_conv")) & (F.col("range") == F.col("own_range"))
    return placed.join(base, same).withColumn("number", F.col("id") + F.col("base")).drop("own_conv", "own_range", "base", "range", "id")


def perspectives(conversations: DataFrame, part: int = PART) -> DataFrame:
    """conv_id, perspective, part, n_turns, rendered, mask: ranges "start:end" of rendered, joined by commas, to learn from."""
    turns = conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"),
        F.replace(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
    )
    distinct = turns.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    chunks = distinct.select("conv_id", "turn", "role", "text", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / part))).alias("k"))
    chunks = chunks.withColumn("copies", F.least(F.col("n") - F.col("k") * part, F.lit(part)).cast("int")).drop("n")
    numbered = _numbered(chunks).withColumn("part", F.floor(F.col("number") / part))
    listed = F.sort_array(F.collect_list(F.struct("number", "role", "text", "copies")))
    parts = numbered.groupBy("conv_id", "part").agg(F.flatten(F.transform(listed, lambda t: F.array_repeat(F.struct(t["role"], t["text"]), t["copies"]))).alias("turns"))
    people = storage.table(turns.where(F.col("role") != SYSTEM).select(F.col("conv_id").alias("own_conv"), F.col("role").alias("perspective")).distinct())
    rows = parts.join(people.hint("merge"), F.col("conv_id").eqNullSafe(F.col("own_conv")))  # a table, so that the join can split a long conversation
    rows = rows.withColumn("pieces", F.transform("turns", lambda t: F.struct(
        _head(t["role"], F.col("perspective")).alias("head"), F.concat(t["text"], F.lit(END)).alias("body"), (t["role"] == F.col("perspective")).alias("own"))))

    def step(acc: Column, p: Column) -> Column:
        start = acc["pos"] + F.length(p["head"])
        stop = start + F.length(p["body"])
        own = F.concat(acc["mask"], F.when(acc["mask"] != "", ",").otherwise(""), start.cast("string"), F.lit(":"), stop.cast("string"))
        return F.struct(stop.alias("pos"), F.when(p["own"], own).otherwise(acc["mask"]).alias("mask"))

    mask = F.aggregate("pieces", F.struct(F.lit(0).alias("pos"), F.lit("").alias("mask")), step, lambda acc: acc["mask"])
    return rows.select(
        "conv_id", "perspective", "part", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), "").alias("rendered"), mask.alias("mask")
    )


SQL = f"""
WITH g AS (SELECT conv_id, turn, role, text, count(*) AS n FROM (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations) GROUP BY ALL),
c AS (SELECT *, unnest(range(0, (n - 1) // {PART} + 1)) AS k FROM g),
t AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, k) - 1) // {PART} AS part, unnest(range(0, least({PART}, n - {PART} * k))) AS copy FROM c),
people AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> '{SYSTEM}'),
s AS (SELECT t.conv_id, perspective, part, turn, k, copy, role, text, role = perspective AS own,
             CASE WHEN role = '{SYSTEM}' THEN '<|system|>' WHEN role = perspective THEN '<|assistant|>' ELSE '<|user:' || role || '|>' END || chr(10) AS head,
             text || '<|end|>' || chr(10) AS body FROM t JOIN people p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
e AS (SELECT *, CAST(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, part ORDER BY turn NULLS FIRST, role, text, k, copy ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop FROM s)
SELECT conv_id, perspective, part, count(*) AS n_turns, string_agg(head || body, '' ORDER BY turn NULLS FIRST, role, text, k, copy) AS rendered,
       coalesce(string_agg(CASE WHEN own THEN (stop - length(body)) || ':' || stop END, ',' ORDER BY turn NULLS FIRST, role, text, k, copy), '') AS mask
FROM e GROUP BY conv_id, perspective, part
"""
