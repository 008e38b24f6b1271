"""Regex matches with offsets, as one native expression.

Java's matcher isn't asked for offsets: matches are fenced by a control character and offsets follow from the lengths of the pieces
between fences, in code points. A fence character in the text itself is first replaced by U+FFFD, which has its length; values are cut
from the unchanged text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.model import no_spans, span

FENCE = "\u0001"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is evaluated once however often use names it; for the inside of lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(values: Column, both: Callable[[Column, Column], Column]) -> Column:
    """Each entry joined with all before it, by doubling: n log n steps, where one append for each would copy n squared."""
    shifts = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int")), lambda k: F.pow(F.lit(2), k).cast("int"))
    return F.aggregate(shifts, values, lambda acc, shift: F.transform(acc, lambda x, i: F.when(i < shift, x).otherwise(both(x, F.get(acc, i - shift)))))


def running_sums(values: Column) -> Column:
    return _running(values, lambda x, y: x + y)


def running_max(values: Column) -> Column:
    return _running(values, lambda x, y: F.greatest(x, y))


def _walk(text: Column, pieces: Column, make: Callable[[Column, Column, Column], Column]) -> Column:
    """make(value, start, end) for every second piece, empty ones excepted."""

    def spans(pieces: Column, ends: Column) -> Column:
        odd = F.filter(F.sequence(F.lit(0), F.size(pieces) - 1), lambda i: (i % 2 == 1) & (F.length(F.get(pieces, i)) > 0))
        place = lambda i: F.get(ends, i - 1)
        value = lambda i: F.when(text.contains(FENCE), F.substring(text, place(i) + 1, F.length(F.get(pieces, i)))).otherwise(F.get(pieces, i))
        return F.transform(odd, lambda i: make(value(i), place(i), F.get(ends, i)))

    return let(pieces, lambda p: let(running_sums(F.transform(p, lambda x: F.length(x))), lambda ends: spans(p, ends)))


def regex_spans(text: Column, pattern: str, type_: str, source: str, confidence: float = 1.0, gate: Column | None = None, group: bool = False) -> Column:
    """All non-overlapping matches of a Java pattern. With group the span is group 2 of a pattern made of the groups 1 (before) and 2.

    gate is a cheap condition without which there can be no match; texts that fail it skip the rest.
    """
    safe = F.replace(text, F.lit(FENCE), F.lit("�"))
    fenced = F.regexp_replace(safe, F.lit(pattern), F.lit(f"$1{FENCE}$2{FENCE}" if group else f"{FENCE}$0{FENCE}"))
    found = _walk(text, F.split(fenced, FENCE, -1), lambda v, a, b: span(F.lit(type_), v, a, b, source, confidence))
    gate = text.rlike(pattern) if gate is None else gate
    return F.when(text.isNull(), no_spans()).when(gate, found).otherwise(no_spans())


def literal_spans(text: Column, surface: str, type_: str, source: str, confidence: float = 1.0) -> Column:
    """All non-overlapping places of a literal, case-sensitive and without word boundaries."""
    if not surface:
        return no_spans()
    safe = F.replace(text, F.lit(FENCE), F.lit("�"))
    fenced = F.replace(safe, F.lit(surface), F.lit(FENCE + surface + FENCE))
    found = _walk(text, F.split(fenced, FENCE, -1), lambda v, a, b: span(F.lit(type_), v, a, b, source, confidence))
    return F.when(text.contains(surface), found).otherwise(no_spans())
