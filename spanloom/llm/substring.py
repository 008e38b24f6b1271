"""Substring deduplication by prefix-partitioned suffix trees over words.

A window of WINDOW words that also starts earlier (in a document of smaller doc_id, or earlier in its own) is a repeat, and its words are
removed. Repeats are judged on the input. The steps:

1. Exact copies of a text, found by its MD5, are repeats as a whole from their second on, and take no further part.
2. Anchors thin out the suffixes: of the runs of GRAM words inside a window the one of least hash is the window's anchor. Equal windows
   have equal anchors, so a window whose anchor occurs once in the corpus is no repeat.
3. The suffixes that start the other windows are split by variable-length prefixes, five words or, for a prefix of more than GROUP
   suffixes, ten. Each partition sorts its suffixes by the hashes of their first 5, 10 and 20 words; those that share WINDOW words with a
   neighbour lie below a deep inner node and go on, all others leave.
4. The suffixes below one node of WINDOW words are a subtree, which one task builds: the suffixes are sorted by their further words up to
   DEPTH, the common prefixes of neighbours counted in words, and the inner nodes read off as intervals of the sorted order. All leaves of
   a node but the earliest repeat as many words as the node is deep; each leaf takes the deepest node of which it isn't the earliest. A
   longer repeat is the chain of its nodes of DEPTH words, which step 6 joins. maximal_repeats() lists the nodes themselves.
5. Ten words still too frequent are prefixed to WINDOW words, where a subtree counts as one node: its earliest leaf comes from an
   aggregate that is partly done before the shuffle, and leaves are marked by a join, which splits skewed keys. What such repeats have
   beyond WINDOW words is covered by the suffixes that start after them.
6. Repeats, merged into word ranges, are cut from the texts.

Words are compared by 64-bit hashes, a window by 96 bits of them or more. Texts are whole and of any length; null texts are empty texts and have
no words. Documents of under WINDOW words have no window. Rows that repeat both doc_id and text are one document and get the same result;
texts that share a doc_id are ordered by their MD5; a null doc_id comes before all others. An empty table gives an empty result. Input
columns are carried in a struct, so none of them clashes with a working column. Words are runs of anything but 0x20 and 0x09-0x0D.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage, textvec
from .neardup import content_key

WINDOW = 20
GRAM = 8
DEPTHS = (5, 10, 20)
#: Words to which the suffixes of a subtree are compared.
DEPTH = 28
#: Suffixes of one prefix up to which they are sorted together, some 3 MB, and 10 MB where all of them are leaves of one subtree.
GROUP = 100_000
#: Rows up to which document numbers (8 bytes) or ranges (24 bytes or less each) are broadcast; beyond it they are shuffled.
BROADCAST_ROWS = 200_000


def anchors(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, first word of each text, start of each whole window, its anchor's start, hashes of runs of gram words, of words)."""
    starts, ends, first = textvec.word_spans(data, offsets)
    hashes = textvec.word_hashes(data, starts, ends)
    if len(hashes) < window:
        none = np.zeros(0, np.int64)
        return none, first, none, none, np.zeros(0, np.uint64), hashes
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    begin = np.flatnonzero(text[: len(text) - window + 1] == text[window - 1 :])
    grams = textvec.chain(hashes, gram)
    near = np.lib.stride_tricks.sliding_window_view(grams, window - gram + 1)
    anchor = begin + np.concatenate([near[begin[i : i + 65536]].argmin(axis=1) for i in range(0, len(begin), 65536)] or [np.zeros(0, np.int64)])
    return text[begin], first, begin, anchor, grams, hashes


def anchor_rows(docs: DataFrame) -> DataFrame:
    """h, doc, at: each distinct anchor of each document. docs: doc, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, _, data, offsets in textvec.slices(batch.column(1)):
                text, first, _, anchor, grams, _ = anchors(data, offsets)
                if not len(text):
                    continue
                new = np.ones(len(anchor), bool)
                new[1:] = anchor[1:] != anchor[:-1]
                text, anchor = text[new], anchor[new]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams[anchor].view(np.int64)), batch.column(0).take(pa.array(row + text)), pa.array((anchor - first[text]).astype(np.int32))], names=["h", "doc", "at"]
                )

    return docs.mapInArrow(textvec.freeing(run), "h long, doc long, at int")


def suffix_rows(docs: DataFrame) -> DataFrame:
    """a, b, c, doc, at: hashes of the first 5, 10 and 20 words of each suffix whose window has a repeated anchor. docs: doc, text, ats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2).to_pylist()
            for row, rows, data, offsets in textvec.slices(batch.column(1)):
                text, first, begin, anchor, _, hashes = anchors(data, offsets)
                if not len(text):
                    continue
                known = np.unique(np.concatenate([first[t] + np.array(lists[row + t], np.int64) for t in range(rows)]))
                keep = np.isin(anchor, known)
                text, begin = text[keep], begin[keep]
                a, b, c = (textvec.chain(hashes, d)[begin] for d in DEPTHS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((a >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.array((b >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.array(c.view(np.int64)),
                     batch.column(0).take(pa.array(row + text)), pa.array((begin - first[text]).astype(np.int32))],
                    names=["a", "b", "c", "doc", "at"],
                )

    return docs.select("doc", "text", "ats").mapInArrow(textvec.freeing(run), "a int, b int, c long, doc long, at int")


def _joined(first: pa.RecordBatch | None, second: pa.RecordBatch) -> pa.RecordBatch:
    return second if first is None else pa.Table.from_batches([first, second]).combine_chunks().to_batches()[0]


def deep_leaves(suffixes: DataFrame, parts: int) -> DataFrame:
    """doc, at of the suffixes that share WINDOW words with another one. suffixes: g, a, b, c, doc, at; g is their group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, company = None, False  # the last suffix so far, and whether it is like the one before
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _joined(held, batch)
            same = np.ones(rows.num_rows, bool)
            same[0] = company
            for k in range(3):
                label = rows.column(k).to_numpy()
                same[1:] &= label[1:] == label[:-1]
            deep = pa.array(same[:-1] | same[1:])
            yield pa.RecordBatch.from_arrays([rows.column(k).slice(0, rows.num_rows - 1).filter(deep) for k in (3, 4)], names=["doc", "at"])
            held, company = rows.slice(rows.num_rows - 1), bool(same[-1])
        if held is not None and company:
            yield pa.RecordBatch.from_arrays([held.column(3), held.column(4)], names=["doc", "at"])

    return suffixes.repartition(parts, "g").sortWithinPartitions("a", "b", "c").select("a", "b", "c", "doc", "at").mapInArrow(textvec.freeing(run), "doc long, at int")


def tree_rows(docs: DataFrame, with_prev: bool = False) -> DataFrame:
    """b, c, tail, doc, at and, if asked for, prev of the suffixes at the places ats of each text: hashes of their first 10 and 20 words, those of
    each further word up to DEPTH, 0 past the end, and that of the word before, 0 at the start. docs: doc, text, ats."""
    more = np.arange(WINDOW, DEPTH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2).to_pylist()
            for row, rows, data, offsets in textvec.slices(batch.column(1)):
                starts, ends, first = textvec.word_spans(data, offsets)
                hashes = textvec.word_hashes(data, starts, ends)
                at = [np.array(lists[row + t], np.int64) for t in range(rows)]
                text = np.repeat(np.arange(rows), [len(x) for x in at])
                place = np.concatenate(at)
                begin = first[text] + place
                if not len(begin):
                    continue
                b, c = (textvec.chain(hashes, d)[begin] for d in DEPTHS[1:])
                for i in range(0, len(begin), 65536):
                    part = slice(i, i + 65536)
                    further = begin[part, None] + more
                    tail = np.where(further < first[text[part] + 1, None], hashes[np.minimum(further, len(hashes) - 1)], np.uint64(0))
                    cuts = np.arange(len(tail) + 1, dtype=np.int32) * np.int32(8 * len(more))
                    tails = pa.Array.from_buffers(pa.binary(), len(tail), [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(tail))])
                    columns = [pa.array((b[part] >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.array(c[part].view(np.int64)), tails, batch.column(0).take(pa.array(row + text[part])), pa.array(place[part].astype(np.int32))]
                    if with_prev:
                        columns.append(pa.array(np.where(place[part] > 0, hashes[np.maximum(begin[part] - 1, 0)], np.uint64(0)).view(np.int64)))
                    yield pa.RecordBatch.from_arrays(columns, names=["b", "c", "tail", "doc", "at", "prev"][: len(columns)])

    return docs.select("doc", "text", "ats").mapInArrow(textvec.freeing(run), "b int, c long, tail binary, doc long, at int" + ", prev long" * with_prev)


class SuffixTree:
    """The inner nodes of sorted suffixes as intervals of leaves. common: words that each suffix shares with the one before it."""

    def __init__(self, common: np.ndarray, most: int = DEPTH):
        self.common, self.most = common, most

    def subtrees(self, depth: int) -> np.ndarray:
        """First leaf of each largest run of leaves that share so many words; a lone leaf counts as one."""
        return np.flatnonzero(self.common < depth)

    def nodes(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """First leaf and number of leaves of the nodes of exactly this depth; at the greatest, of this depth or more."""
        begin = self.subtrees(depth)
        count = np.diff(begin, append=len(self.common))
        inner = self.common.copy()
        inner[begin] = self.most
        here = (count > 1) & ((np.minimum.reduceat(inner, begin) == depth) | (depth == self.most)) if len(begin) else np.zeros(0, bool)
        return begin[here], count[here]

    def repeated(self, rank: np.ndarray, least: int) -> np.ndarray:
        """For each leaf the depth of the deepest node, of at least `least`, that has a leaf of lower rank; 0 if none."""
        out = np.zeros(len(rank), np.int64)
        for depth in range(self.most, least - 1, -1):
            begin = self.subtrees(depth)
            count = np.diff(begin, append=len(rank))
            late = rank > np.repeat(np.minimum.reduceat(rank, begin), count)
            out[late & (out == 0)] = depth
        return out


def _sorted_subtrees(rows: DataFrame, parts: int) -> DataFrame:
    return rows.repartition(parts, "b", "c").sortWithinPartitions("b", "c", "tail")


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[SuffixTree, pa.RecordBatch, np.ndarray]]:
    """(tree, its leaves, their rank by doc and place) of whole subtrees, some at a time, from rows of _sorted_subtrees()."""

    def tree(rows: pa.RecordBatch, new: np.ndarray) -> tuple[SuffixTree, pa.RecordBatch, np.ndarray]:
        tails = np.frombuffer(b"".join(rows.column(2).to_pylist()), np.uint64).reshape(rows.num_rows, DEPTH - WINDOW)
        same = (tails[1:] == tails[:-1]) & (tails[1:] != 0)
        common = np.zeros(rows.num_rows, np.int64)
        common[1:] = np.where(new[1:], 0, WINDOW + np.logical_and.accumulate(same, axis=1).sum(axis=1))
        rank = np.empty(rows.num_rows, np.int64)
        rank[np.lexsort((rows.column(4).to_numpy(), rows.column(3).to_numpy()))] = np.arange(rows.num_rows)
        return SuffixTree(common), rows, rank

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        held = _joined(held, batch)
        new = np.zeros(held.num_rows, bool)
        new[0] = True
        for k in range(2):
            label = held.column(k).to_numpy()
            new[1:] |= label[1:] != label[:-1]
        cut = int(np.flatnonzero(new)[-1])  # the last subtree may go on
        if cut:
            yield tree(held.slice(0, cut), new[:cut])
            held = held.slice(cut)
    if held is not None:
        new = np.zeros(held.num_rows, bool)
        new[0] = True
        yield tree(held, new)


def tree_marks(rows: DataFrame, parts: int) -> DataFrame:
    """doc, at, words: how many words from its start each suffix of tree_rows() repeats, if it repeats some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree, leaves, rank in _trees(batches):
            words = tree.repeated(rank, WINDOW)
            keep = pa.array(words > 0)
            yield pa.RecordBatch.from_arrays([leaves.column(3).filter(keep), leaves.column(4).filter(keep), pa.array(words[words > 0].astype(np.int32))], names=["doc", "at", "words"])

    return _sorted_subtrees(rows, parts).mapInArrow(textvec.freeing(run), "doc long, at int, words int")


def tree_nodes(rows: DataFrame, parts: int) -> DataFrame:
    """doc, at, words, occurrences of each maximal repeat: the earliest leaf, depth and leaves of a node whose leaves don't all follow the same word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree, leaves, rank in _trees(batches):
            prev, by_rank = leaves.column(5).to_numpy(), np.argsort(rank)
            for depth in range(WINDOW, DEPTH + 1):
                begin, count = tree.nodes(depth)
                if not len(begin):
                    continue
                member = np.repeat(np.arange(len(begin)), count)
                leaf = np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())
                cuts = np.cumsum(count) - count
                low, high = np.minimum.reduceat(prev[leaf], cuts), np.maximum.reduceat(prev[leaf], cuts)
                free = (low != high) | (np.bincount(member, prev[leaf] == 0) > 0)
                first = pa.array(by_rank[np.minimum.reduceat(rank[leaf], cuts)[free]])
                yield pa.RecordBatch.from_arrays(
                    [leaves.column(3).take(first), leaves.column(4).take(first), pa.array(np.full(len(first), depth, np.int32)), pa.array(count[free])], names=["doc", "at", "words", "occurrences"]
                )

    return _sorted_subtrees(rows, parts).mapInArrow(textvec.freeing(run), "doc long, at int, words int, occurrences long")


def _ranges(marks: DataFrame) -> DataFrame:
    """doc, begins, ends: merged ranges of the words that repeats (doc, at, words) cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begins, ends = [], []
            for marked in batch.column(1).to_pylist():
                both = np.sort(np.array(marked, np.int64))
                at = both // (DEPTH + 1)
                reach = np.maximum.accumulate(at + both % (DEPTH + 1))
                cut = np.flatnonzero(at[1:] > reach[:-1]) + 1
                begins.append(at[np.append(0, cut)])
                ends.append(reach[np.append(cut - 1, len(at) - 1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(begins, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))], names=["doc", "begins", "ends"])

    both = F.col("at").cast("long") * (DEPTH + 1) + F.col("words")
    return marks.groupBy("doc").agg(F.collect_list(both)).mapInArrow(textvec.freeing(run), "doc long, begins array<long>, ends array<long>")


def _bounded(rows: DataFrame, size: int) -> DataFrame:
    return F.broadcast(rows) if size <= BROADCAST_ROWS else rows


def _with_places(docs: DataFrame, places: DataFrame) -> DataFrame:
    """docs (doc, text) that have places (doc, ats), with them."""
    some = docs.join(_bounded(places.select("doc"), places.count()), "doc", "left_semi")  # the lists aren't bounded by their number
    return some.join(places.hint("merge"), "doc")


def _subtrees(docs: DataFrame, parts: int, with_prev: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, list[DataFrame]]:
    """(copies: doc; rows of tree_rows(); repeats of WINDOW words with too frequent prefixes: doc, at, words; tables to drop)."""
    keyed = docs.select("doc", content_key(F.col("text")).alias("key"))
    firsts = keyed.groupBy("key").agg(F.min("doc").alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = storage.table(firsts.select("key", "first"))
    copies = storage.table(keyed.join(_bounded(firsts, firsts.count()), "key").where("doc <> first").select("doc"))
    own = docs.join(_bounded(copies, copies.count()), "doc", "left_anti").select("doc", "text")
    found = anchor_rows(own)
    shared = storage.table(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))  # a table, so that the join can split frequent anchors
    ats = storage.table(found.join(shared.hint("merge"), "h").groupBy("doc").agg(F.collect_list("at").alias("ats")))
    suffixes = storage.table(suffix_rows(_with_places(own, ats)))
    storage.drop(firsts, shared, ats)
    often = storage.table(suffixes.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > GROUP).select("a"))
    hot = storage.table(suffixes.join(often, "a").groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") > GROUP).select("a", "b"))
    grouped = suffixes.join(often.withColumn("deep", F.lit(True)), "a", "left").join(hot, ["a", "b"], "left_anti")
    leaves = deep_leaves(grouped.select(F.when(F.col("deep"), F.xxhash64("a", "b")).otherwise(F.col("a")).alias("g"), "a", "b", "c", "doc", "at"), parts)
    places = storage.table(leaves.groupBy("doc").agg(F.collect_list("at").alias("ats")))
    deep = suffixes.join(hot, ["a", "b"], "left_semi")
    earliest = deep.groupBy("a", "b", "c").agg(F.min(F.struct("doc", "at")).alias("first"))
    in_nodes = storage.table(deep.join(earliest, ["a", "b", "c"]).where(F.struct("doc", "at") != F.col("first")).select("doc", "at", F.lit(WINDOW).alias("words")))
    storage.drop(suffixes, often, hot)
    return copies, tree_rows(_with_places(own, places), with_prev), in_nodes, [places, in_nodes]


def repeated_ranges(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(copies: doc; ranges: doc, begins, ends) of docs (doc, text), doc being unique and in the order of precedence."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    copies, rows, in_nodes, tables = _subtrees(docs, parts)
    ranges = storage.table(_ranges(tree_marks(rows, parts).unionAll(in_nodes)))
    storage.drop(*tables)
    return copies, ranges


def maximal_repeats(docs: DataFrame) -> DataFrame:
    """doc, at, words, occurrences: the deep inner nodes of all subtrees whose leaves don't all follow the same word, at their earliest leaf.

    words is DEPTH where a repeat goes on beyond it. Exact copies count once; prefixes too frequent for a subtree aren't listed. docs (doc,
    text), doc being unique and in the order of precedence.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    _, rows, _, tables = _subtrees(docs, parts, with_prev=True)
    out = storage.table(tree_nodes(rows, parts))
    storage.drop(*tables)
    return out


def _numbered(docs: DataFrame) -> tuple[DataFrame, bool]:
    """docs (doc_id, text, row) with doc, a number in the order of precedence: doc_id itself where it is unique and not null, else one for each
    doc_id and text; and whether rows may repeat a number."""
    if docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty():
        return docs.withColumn("doc", F.col("doc_id")), False
    keys = docs.select(F.col("doc_id").alias("own_id"), content_key(F.col("text")).alias("own_key")).distinct()
    numbers = storage.table(keys.orderBy("own_id", "own_key").withColumn("doc", F.monotonically_increasing_id()))
    rows = docs.withColumn("key", content_key(F.col("text")))
    return rows.join(numbers, rows["doc_id"].eqNullSafe(numbers["own_id"]) & (rows["key"] == numbers["own_key"])).select("doc_id", "text", "row", "doc"), True


def cut_repeats(docs: DataFrame, digest: bool = False) -> DataFrame:
    """docs with repeats cut out of text; with digest instead doc_id, n_words, n_removed and kept_sha256 of each row.

    A text without repeats stays as it is. Of others the kept runs of words stay as they were, joined by a new line; a text of repeats
    only becomes empty. The digest is of the kept words joined by a space.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    numbered, repeated = _numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")))
    pairs = numbered.select("doc", "text")
    if repeated:
        pairs = pairs.dropDuplicates(["doc"])
    copies, ranges = repeated_ranges(pairs)
    size = ranges.agg(F.coalesce(F.sum(F.size("begins")), F.lit(0))).first()[0]
    own = numbered.join(_bounded(copies.withColumn("copy", F.lit(True)), copies.count()), "doc", "left").join(_bounded(ranges, size), "doc", "left")

    def keep_mask(n: int, copy: bool | None, begins: list[int] | None, ends: list[int] | None) -> np.ndarray:
        keep = np.ones(n, bool)
        if copy and n >= WINDOW:
            keep[:] = False
        for a, b in zip(begins or (), ends or (), strict=True):
            keep[a:b] = False
        return keep

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                n, removed, kept = [], [], []
                for text, *marks in zip(*(part.column(k).to_pylist() for k in range(1, 5)), strict=True):
                    words = text.encode().split()
                    keep = keep_mask(len(words), *marks)
                    n.append(len(words))
                    removed.append(int(len(words) - keep.sum()))
                    kept.append(hashlib.sha256(b" ".join(words if keep.all() else [w for w, k in zip(words, keep, strict=True) if k])).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    if digest:
        return own.select("doc_id", "text", "copy", "begins", "ends").mapInArrow(textvec.freeing(digests), "doc_id long, n_words long, n_removed long, kept_sha256 string")

    @F.arrow_udf("string")
    def cut(texts: pa.Array, copies: pa.Array, begins: pa.Array, ends: pa.Array) -> pa.Array:
        out = []
        for text, *marks in zip(*(x.to_pylist() for x in (texts, copies, begins, ends)), strict=True):
            if text is not None:
                raw = text.encode()
                data = np.frombuffer(raw, np.uint8)
                starts, stops, _ = textvec.word_spans(data, np.array([0, len(data)]))
                keep = keep_mask(len(starts), *marks)
                if not keep.all():
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], keep, [False]]).astype(np.int8)))
                    text = b"\n".join(raw[starts[a] : stops[b - 1]] for a, b in edge.reshape(-1, 2)).decode()
            out.append(text)
        return pa.array(out, pa.string())

    marked = F.coalesce("copy", F.lit(False)) | F.col("begins").isNotNull()  # only their texts go to Python
    new = own.select("row", "text", "copy", "begins", "ends", marked.alias("marked")).withColumn("cut", cut(F.when(F.col("marked"), F.col("row.text").cast("string")), "copy", "begins", "ends"))
    text = F.when(F.col("marked"), F.col("cut")).otherwise(F.col("row.text").cast("string")).alias("text")
    return new.select(*[text if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
