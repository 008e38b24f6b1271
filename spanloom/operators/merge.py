"""Overlap resolution, masking and relatives: arrays of spans in, arrays or text out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions.spans import let, running_max, running_sums
from spanloom.model import SPANS, Referential, no_spans


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def numbered(spans: Column) -> Column:
    return F.transform(spans, lambda s, i: s.withField("seq", i))


def _by_rank(a: Column, b: Column) -> Column:
    strong = lambda s: F.when(s["source"].isin("deterministic", "rule"), 1).otherwise(0)
    size = lambda s: s["end"] - s["start"]
    order = F.lit(0)
    for less, more in ((a["seq"], b["seq"]), (size(b), size(a)), (b["confidence"], a["confidence"]), (strong(b), strong(a))):
        order = F.when(less < more, -1).when(less > more, 1).otherwise(order)
    return order


def by_place(spans: Column) -> Column:
    """Sorted by start and length."""
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("a"), (s["end"] - s["start"]).alias("n"), s["seq"].alias("q"), s.alias("s")))
    return F.transform(F.sort_array(keyed), lambda k: k["s"])


def _strongest(spans: Column) -> Column:
    """Those of a group of spans that stay, from the strongest down, in order of place."""
    ranked = F.array_sort(spans, _by_rank)
    return by_place(F.aggregate(ranked, no_spans(), lambda acc, s: F.when(F.exists(acc, lambda k: overlaps(k, s)), acc).otherwise(F.array_append(acc, s))))


def merge(spans: Column) -> Column:
    """Keeps spans from the strongest down unless they overlap a kept one: deterministic and rule spans first, then by confidence, length
    and earlier place in the array. The result is in order of place.

    Only spans that hang together by overlaps compete: in order of place a group ends where the next span starts at or after all ends so far."""

    def apart(placed: Column, reach: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(placed) - 1), lambda i: (i == 0) | (F.get(placed, i)["start"] >= F.get(reach, i - 1)))

        def groups(heads: Column) -> Column:
            stop = lambda k: F.coalesce(F.get(heads, k + 1), F.size(placed))
            own = lambda h, k: F.slice(placed, h + 1, stop(k) - h)
            return F.flatten(F.transform(heads, lambda h, k: F.when(stop(k) - h == 1, own(h, k)).otherwise(_strongest(own(h, k)))))

        return F.when(F.size(heads) == F.size(placed), placed).otherwise(let(heads, groups))

    resolved = let(by_place(numbered(spans)), lambda placed: let(running_max(F.transform(placed, lambda s: s["end"])), lambda reach: apart(placed, reach)))
    return F.when(F.size(spans) <= 1, numbered(spans)).otherwise(resolved)


def mask(text: Column, spans: Column, referential: Referential) -> Column:
    """text with each span replaced by the tag of its type; spans must not overlap and be in order of place."""
    tags = referential.tag_for

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["pos"] + 1, s["start"] - acc["pos"])
        return F.struct(F.concat(acc["out"], gap, tags(s["type"])).alias("out"), s["end"].alias("pos"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("pos"))
    done = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["pos"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def confirmed_only(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["confirmed"])


def _first_not(spans: Column, before: Callable[[Column], Column]) -> Column:
    """How many spans lead the array for which before holds, by halving; it must hold for none after them."""

    def step(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        more = (acc["low"] < acc["high"]) & before(F.get(spans, middle))
        low, high = F.when(more, middle + 1).otherwise(acc["low"]), F.when(more, acc["high"]).otherwise(middle)
        return F.struct(low.alias("low"), F.greatest(low, high).alias("high"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(spans) + 1)).cast("int"))
    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.size(spans).alias("high")), step, lambda acc: acc["low"])


def mask_runs(runs: Column, spans: Column, referential: Referential) -> Column:
    """Texts of formatted runs with spans over their concatenation masked: the tag stands in the first run a span touches, the rest of
    the span goes from the runs after it. spans must not overlap and be in order of place."""
    tags = referential.tag_for

    def masked(run: Column, a: Column, b: Column, full: Column) -> Column:
        low, high = _first_not(full, lambda s: s["end"] <= a), _first_not(full, lambda s: s["start"] < b)

        def cut(mine: Column) -> Column:
            def piece(s: Column, i: Column) -> Column:
                pos = F.coalesce(F.get(mine, i - 1)["end"], a)
                gap = F.substring(run, pos - a + 1, F.greatest(s["start"] - pos, F.lit(0)))
                return F.concat(gap, F.when(s["start"] >= a, tags(s["type"])).otherwise(F.lit("")))

            last = F.least(F.coalesce(F.get(mine, F.size(mine) - 1)["end"], a), b)
            return F.when(F.size(mine) > 0, F.concat(F.array_join(F.transform(mine, piece), ""), F.substring(run, last - a + 1, F.length(run)))).otherwise(run)

        return F.get(F.transform(F.array(F.slice(full, low + 1, high - low)), cut), F.lit(0))

    def all_runs(x: Column) -> Column:
        return F.transform(x["runs"], lambda run, i: masked(run, F.coalesce(F.get(x["ends"], i - 1), F.lit(0)), F.get(x["ends"], i), x["spans"]))

    lengths = F.transform(runs, lambda r: F.coalesce(F.length(r), F.lit(0)))
    once = F.struct(runs.alias("runs"), running_sums(lengths).alias("ends"), F.filter(spans, lambda s: s["end"] > s["start"]).alias("spans"))
    return F.when(F.size(spans) > 0, F.get(F.transform(F.array(once), all_runs), F.lit(0))).otherwise(runs)


def rects_of(words: Column, start: Column, end: Column) -> Column:
    """Rectangles of the words whose character range meets [start, end)."""
    return F.transform(F.filter(words, lambda w: (w["char_start"] < end) & (start < w["char_end"])), lambda w: w["rect"])


def rects_of_all(words: Column, spans: Column) -> Column:
    """Rectangles of several spans, each once, in order."""
    return F.array_distinct(F.flatten(F.transform(spans, lambda s: rects_of(words, s["start"], s["end"]))))


def with_manual(spans: Column, manual: Column) -> Column:
    """Spans with hand-drawn ones joined and resolved again."""
    return merge(F.concat(spans, manual).cast(SPANS))
