"""Quality rules as one Spark projection.

quality_columns() computes the counts of a text with built-in expressions only; THRESHOLDS is compiled into one boolean. Nothing
is shuffled and no user function runs. A null text is an empty text; it has no words and fails. Words are runs of anything but
0x20 and 0x09-0x0D. Texts of any length are judged whole, an empty table gives an empty result. Rows are judged one by one, so ties,
repeated rows and other columns make no difference; result columns replace input columns of the same name, whatever its case, and working
columns get a prefix that no input column has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
#: Frequent short words of four languages, as fixed values.
STOP_WORDS = (
    "a an and are as at be by for from he in is it of on or that the this to was were will with "
    "au auf das de der des die ein eine für ist mit nicht sich sie und von zu im den "
    "avec ce dans du en est et la le les pas pour que qui sur un une "
    "al como con del el es las lo los no para por se su una y"
).split()
#: (measure, least, most): a text is kept if each measure lies between its bounds; None is no bound.
THRESHOLDS = (
    ("n_words", 50, None),
    ("mean_word_chars", 2.0, 20.0),
    ("symbols_per_word", None, 0.15),
    ("marks_per_word", None, 0.5),
    ("upper_share", None, 0.5),
    ("stop_word_share", 0.02, None),
    ("dup_line_share", None, 0.5),
    ("repeat_word_share", None, 0.5),
)
_BLANK = " \t\n\x0b\x0c\r"


def _without(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def quality_columns(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and the ratios of THRESHOLDS (double)."""
    work = "__q_"
    while any(c.lower().startswith(work) for c in docs.columns):
        work = "_" + work
    q = lambda name: F.col(work + name)
    as_long = lambda c: c.cast("long")
    step = docs.withColumn(work + "text", F.coalesce(F.col(text).cast("string"), F.lit("")))
    step = step.withColumns({
        work + "words": F.array_remove(F.split(q("text"), r"[\x20\x09-\x0D]+"), ""),
        work + "lines": F.filter(F.split(q("text"), "\n"), lambda x: F.length(F.btrim(x, F.lit(_BLANK))) > 0),
    })
    # Windows of three words by hash, in order of the text; sorted, equal ones are neighbours.
    step = step.withColumns({
        work + "n": F.size(q("words")),
        work + "tri": F.slice(
            F.transform(q("words"), lambda w, i: F.xxhash64(w, F.get(q("words"), i + 1), F.get(q("words"), i + 2))), F.lit(1), F.greatest(F.size(q("words")) - 2, F.lit(0))
        ),
    })
    step = step.withColumn(work + "sorted", F.sort_array(q("tri")))
    step = step.withColumn(work + "again", F.array_distinct(F.filter(q("sorted"), lambda x, i: x == F.get(q("sorted"), i - 1))))
    # Starts of repeated windows: by lookup in the few that repeat or, where that would be long, by sorting windows with their places.
    few = F.size(q("again")).cast("long") * F.size(q("tri")) <= 4_000_000
    looked_up = F.filter(F.transform(q("tri"), lambda x, i: F.when(F.array_contains(q("again"), x), i).otherwise(F.lit(-1))), lambda p: p >= 0)
    step = step.withColumn(work + "pairs", F.when(few, F.lit(None)).otherwise(F.sort_array(F.transform(q("tri"), lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    paired = F.filter(
        F.transform(
            q("pairs"),
            lambda x, i: F.when((x["h"] == F.get(q("pairs"), i - 1)["h"]) | (x["h"] == F.get(q("pairs"), i + 1)["h"]), x["i"]).otherwise(F.lit(-1)),
        ),
        lambda p: p >= 0,
    )
    step = step.withColumn(work + "at", F.when(F.size(q("again")) == 0, F.array().cast("array<int>")).when(few, looked_up).otherwise(F.sort_array(paired)))
    covered = F.aggregate(F.transform(q("at"), lambda p, i: F.least(F.lit(3), F.coalesce(F.get(q("at"), i + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    stop = F.size(F.filter(q("words"), lambda w: F.lower(w).isin(STOP_WORDS)))
    letters = F.length(F.regexp_replace(q("text"), r"\P{L}+", ""))
    upper = F.length(F.regexp_replace(q("text"), r"\P{Lu}+", ""))
    step = step.withColumns({
        "n_words": as_long(q("n")),
        "word_chars": as_long(F.length(q("text")) - _without(q("text"), _BLANK)),
        "n_symbols": as_long(_without(q("text"), SYMBOLS)),
        "n_dup_lines": as_long(F.size(q("lines")) - F.size(F.array_distinct(q("lines")))),
        "n_repeat_words": as_long(covered),
        work + "n_lines": F.size(q("lines")),
        work + "stop": stop,
        work + "letters": letters,
        work + "upper": upper,
        work + "marks": _without(q("text"), "!"),
    })
    words = F.greatest(F.col("n_words"), F.lit(1))
    step = step.withColumns({
        "mean_word_chars": F.col("word_chars") / words,
        "symbols_per_word": F.col("n_symbols") / words,
        "marks_per_word": q("marks") / words,
        "upper_share": q("upper") / F.greatest(q("letters"), F.lit(1)),
        "stop_word_share": q("stop") / words,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(q("n_lines"), F.lit(1)),
        "repeat_word_share": F.col("n_repeat_words") / words,
    })
    return step.drop(*[c for c in step.columns if c.startswith(work)])


def passes(thresholds=THRESHOLDS) -> Column:
    """The table as one condition over quality_columns()."""
    held = F.lit(True)
    for name, least, most in thresholds:
        if least is not None:
            held = held & (F.col(name) >= least)
        if most is not None:
            held = held & (F.col(name) <= most)
    return held


def judge(docs: DataFrame, text: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """quality_columns() with base_failed (fewer than 50 words, or more than half of the words in repeated windows of three) and kept."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return quality_columns(docs, text).withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & passes(thresholds))


def keep(docs: DataFrame, text: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """The rows of docs that are kept, with the columns of docs.

    The filter stands above a column that isn't deterministic: pushed below the projections it would evaluate each step once for every
    element of the steps built on it.
    """
    own = docs.select(F.col(f"`{text}`").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own_row"))
    judged = judge(own, "text", thresholds).select("own_row", "kept", F.spark_partition_id().alias("part"))
    return judged.where("kept AND part >= 0").select("own_row.*")
