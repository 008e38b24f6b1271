"""Near-duplicate classes by DartMinHash signatures, banded joining and exact verification.

Two texts are linked if the weighted Jaccard likeness of their shingles of five words, weighted by how often they occur, is THRESHOLD
or more; classes are the connected components of links, and a class is named by its least doc_id. Exact copies become one content,
by the MD5 of the text, and only distinct contents are compared; a task signs a text once, however many copies of it it meets.

Contents that share a band fall into a bucket. A bucket is not expanded into pairs: in each round its members outside the leader's class
are compared with one leader, the member with the most company over all buckets (in further rounds, if asked for, one drawn by a hash). What is still in
different classes afterwards is compared pair by pair, each pair once, if their sizes and a longer sketch of each leave a
likeness of THRESHOLD possible (SIGMAS standard deviations below it). With 32 bands of 4 rows a pair of likeness 0.8 misses all bands with
probability 5e-8, and a sketch misses it with 2e-8. Counts by bucket and by class are tables before they are joined, so that Spark can split
the rows of a frequent bucket or a large class among tasks.

Texts are compared whole and may be of any length. An empty table gives an empty result. Columns other than doc_id and text are carried in a
struct or not read, so none clashes. Null texts count as empty. A text without words is linked to its exact copies only; one of one to four words is one shingle. Repeated
rows are copies of each other. Rows with a null doc_id keep a null doc_id and are named by the least other doc_id of their class, if any.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import storage, textvec
from .textvec import mix64

WIDTH = 5
COORDINATES = 128
ROWS_PER_BAND = 4
THRESHOLD = 0.8
SIGMAS = 5.5
#: Coordinates and bits of the sketches that decide which pairs are worth an exact look.
SKETCH, SKETCH_BITS = 1024, 2
LEADER_ROUNDS = 1
#: Contents up to which their texts are found by a broadcast of keys (24 bytes each); beyond it by a shuffle.
BROADCAST_KEYS = 200_000
#: Texts that a task remembers as signed, by their MD5.
REMEMBERED = 1_000_000
_GOLD = np.uint64(textvec._MULT)


def weighted_shingles(own: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, number of times) of shingles sorted by text and hash."""
    if not len(values):
        return own, values, np.zeros(0, np.int64)
    order = np.lexsort((values, own))
    own, values = own[order], values[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (values[1:] != values[:-1])
    at = np.flatnonzero(new)
    return own[at], values[at], np.diff(at, append=len(own))


def darts(own: np.ndarray, element: np.ndarray, weight: np.ndarray, texts: int, k: int = COORDINATES) -> tuple[np.ndarray, np.ndarray]:
    """(texts x k signature, whether a text has any weight).

    An element of weight w owns the region [0, w) of its line. Darts hit each unit of that line as a Poisson process in time, all
    drawn from hashes of the element, the unit and the dart's number, so equal elements see equal darts in every text. A dart counts
    if it lands in the region; it belongs to one of k coordinates, and the earliest dart of a coordinate is its entry. A text throws
    until the time by which k ln k + 2 k darts are expected, and twice as long while a coordinate is still without a dart.
    """
    total = np.bincount(own, weight, texts)
    has = total > 0
    best = np.full(texts * k, np.inf)
    entry = np.zeros(texts * k, np.uint64)
    until = np.where(has, (k * np.log(k) + 2 * k) / np.maximum(total, 1e-300), 0.0)
    units = np.ceil(weight).astype(np.int64)
    cell = np.repeat(np.arange(len(own)), units)
    unit = (np.arange(len(cell)) - np.repeat(np.cumsum(units) - units, units)).astype(np.uint64)
    text, room = own[cell], weight[cell] - unit
    seed = mix64(element[cell] + unit * _GOLD)
    number = np.zeros(len(cell), np.uint64)

    def gap(seed: np.ndarray, number: np.ndarray) -> np.ndarray:
        return -np.log((mix64(seed ^ mix64(number * _GOLD + np.uint64(1))) >> np.uint64(11)).astype(float) * 2.0**-53 + 2.0**-54)

    time = gap(seed, number)
    while len(cell):
        live = np.flatnonzero(time <= until[text])
        while len(live):
            dart = mix64(seed[live] + number[live] * _GOLD + np.uint64(7))
            lands = (dart >> np.uint64(40)).astype(float) * 2.0**-24 < room[live]
            at, t, d = (text[live] * k + (dart % np.uint64(k)).astype(np.int64))[lands], time[live][lands], dart[lands]
            np.minimum.at(best, at, t)
            first = best[at] == t
            entry[at[first]] = mix64(d[first])
            number[live] += np.uint64(1)
            time[live] += gap(seed[live], number[live])
            live = live[time[live] <= until[text[live]]]
        bare = np.isinf(best.reshape(texts, k)).any(axis=1) & has
        if not bare.any():
            break
        until[bare] *= 2
        keep = bare[text]
        text, room, seed, number, time, cell = text[keep], room[keep], seed[keep], number[keep], time[keep], cell[keep]
    return entry.reshape(texts, k), has


def signature_column(column: pa.Array, k: int = COORDINATES) -> tuple[np.ndarray, np.ndarray]:
    """(texts x k int32 signature, number of shingles of each text)."""
    out, total = np.zeros((len(column), k), np.int32), np.zeros(len(column))
    for at, rows, own, values in textvec.text_shingles(column, WIDTH):
        sig, _ = darts(*_floats(weighted_shingles(own, values)), rows, k)
        out[at : at + rows] = sig.astype(np.uint32).view(np.int32)
        total[at : at + rows] = np.bincount(own, minlength=rows)
    return out, total


def _floats(shingled: tuple) -> tuple:
    return shingled[0], shingled[1], shingled[2].astype(float)


def likeness(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Weighted Jaccard likeness of the shingles of two columns, row by row; 0 where both have none."""
    both = np.zeros(len(a))
    total = np.zeros(len(a))
    parts = []
    for column in (a, b):
        own, values, weight = map(np.concatenate, zip(*((at + o, v, w) for at, _, o, v, w in ((at, n, *weighted_shingles(o, v)) for at, n, o, v in textvec.text_shingles(column, WIDTH))), strict=True))
        total += np.bincount(own, weight, len(a))
        parts.append((own, values, weight))
    own, values, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((values, own))
    own, values, weight = own[order], values[order], weight[order]
    same = np.flatnonzero((own[1:] == own[:-1]) & (values[1:] == values[:-1]))
    both += np.bincount(own[same], np.minimum(weight[same], weight[same + 1]), len(a))
    return both / np.maximum(total - both, 1e-300)


def content_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def contents(docs: DataFrame, k: int = COORDINATES) -> DataFrame:
    """key, rep (least doc_id), weight (number of shingles), signature of each distinct text that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signed: set[bytes] = set()
        for batch in batches:
            keys, first = batch.column(0).to_pylist(), []
            for i, key in enumerate(keys):
                if key not in signed:
                    signed.add(key)
                    first.append(i)
            sig, total = signature_column(batch.column(2).take(pa.array(first, pa.int64())), k)
            at = np.full(len(keys), -1)
            at[first] = np.arange(len(first))
            rows = np.flatnonzero((at < 0) | (total[at] > 0 if len(total) else False))  # copies stand without a signature
            of = pa.array(at[rows], mask=at[rows] < 0)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(sig.reshape(-1)), k).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), pa.array(total).take(of), lists.take(of)], names=["key", "doc_id", "weight", "signature"])
            if len(signed) > REMEMBERED:
                signed.clear()

    rows = docs.select(content_key(F.col("text")).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(textvec.freeing(run), "key binary, doc_id long, weight double, signature array<int>").groupBy("key").agg(F.min("doc_id").alias("rep"), F.max("weight").alias("weight"), F.max("signature").alias("signature")).where("weight > 0")


def bands(rows: DataFrame, per_band: int = ROWS_PER_BAND, k: int = COORDINATES) -> DataFrame:
    """key, h: one row for each band of each content."""
    return rows.select("key", F.explode(_band_hashes(per_band, k)).alias("h"))


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, text of the contents wanted (key, rep)."""
    rows = docs.select(content_key(F.col("text")).alias("key"), F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_KEYS else wanted
    same = (rows["key"] == side["key"]) & rows["rep"].eqNullSafe(side["rep"])
    return rows.join(side, same, "left_semi").select("key", "text").dropDuplicates(["key"])


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                alike = pa.array(likeness(part.column(2), part.column(3)) >= threshold)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(alike), part.column(1).filter(alike)], names=["a", "b"])

    with_b = pairs.join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(textvec.freeing(run), "a binary, b binary")


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (key, label) after the classes that links (a, b) connect become one, named by the least label."""
    of = lambda name: labels.select(F.col("key").alias(name), F.col("label").alias("l" + name))
    edges = links.join(of("a"), "a").join(of("b"), "b").where("la <> lb").select(F.greatest("la", "lb").alias("u"), F.least("la", "lb").alias("v")).distinct()
    edges = storage.table(edges)
    if edges.isEmpty():
        return labels
    root = storage.table(edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct().withColumn("root", F.col("node")))
    ways = edges.union(edges.select("v", "u")).toDF("node", "near")
    last = root
    while True:
        near = ways.join(root.withColumnRenamed("node", "near").withColumnRenamed("root", "r"), "near").groupBy("node").agg(F.min("r").alias("r"))
        lower = storage.table(root.join(near, "node").select("node", F.least("root", "r").alias("root"), (F.col("r") < F.col("root")).alias("moved")))
        up = lower.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        step = storage.table(lower.join(up, "root").select("node", F.col("higher").alias("root"), "moved"))
        storage.drop(last, lower)
        root, last = step.select("node", "root"), step
        if step.where("moved").isEmpty():
            break
    named = labels.join(root.select(F.col("node").alias("label"), "root"), "label", "left")
    out = storage.table(named.select("key", F.coalesce("root", "label").alias("label")))
    storage.drop(edges, last)
    return out


def classes_of_contents(docs: DataFrame, threshold: float = THRESHOLD, per_band: int = ROWS_PER_BAND, k: int = COORDINATES) -> DataFrame:
    """key, label of the contents that share a band with another; equal labels are one class."""
    all_ = storage.table(contents(docs, k))
    rows = bands(all_, per_band, k)
    shared = storage.table(rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
    buckets = storage.table(rows.join(shared, "h"))
    company = storage.table(buckets.groupBy("key").agg(F.sum("n").alias("company")))
    texts = storage.table(_texts_of(docs, all_.join(company, "key", "left_semi").select("key", "rep")))
    labels = storage.table(company.select("key", F.col("key").alias("label")))
    for step in range(LEADER_ROUNDS):
        order = F.col("company") if step == 0 else F.xxhash64("key", "h", F.lit(step))
        members = storage.table(buckets.join(company.join(labels, "key"), "key").select("h", "key", "label", F.struct(order.alias("order"), "key", "label").alias("as_leader")))
        led = members.groupBy("h").agg(F.max("as_leader").alias("leader"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
        leaders = storage.table(led.select("h", "leader.key", "leader.label").toDF("h", "leader", "leader_label"))
        apart = members.join(leaders, "h").where("label <> leader_label").select(F.least("key", "leader").alias("a"), F.greatest("key", "leader").alias("b")).distinct()
        labels, before = _joined(labels, _verified(apart, texts, threshold)), labels
        storage.drop(members, leaders, *([before] if labels is not before else []))
    members = storage.table(buckets.join(labels, "key").select("h", "key", "label"))
    mixed = storage.table(members.groupBy("h").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("h"))
    left = storage.table(members.join(mixed, "h").select("h", "key", "label"))
    own = storage.table(left.select("key").distinct())
    known = storage.table(all_.join(own, "key").select("key", "weight", _band_hashes(per_band, k).alias("hs")).join(_sketches(texts.join(own, "key")), "key"))
    both = left.join(known, "key")
    x, y = (both.select(*(F.col(c).alias(f"{c}_{s}") for c in both.columns)) for s in "ab")
    once = F.element_at("hs_a", F.array_position(F.zip_with("hs_a", "hs_b", lambda p, q: p == q), F.lit(True)).cast("int")) == F.col("h_a")  # in the first band that both share
    rest = x.join(y, (F.col("h_a") == F.col("h_b")) & (F.col("label_a") < F.col("label_b")) & (F.least("weight_a", "weight_b") >= threshold * F.greatest("weight_a", "weight_b")) & _may_be_alike(threshold) & once)
    out = _joined(labels, _verified(rest.select(F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b")), texts, threshold))
    storage.drop(all_, shared, buckets, company, texts, members, mixed, left, own, known, *([labels] if out is not labels else []))
    return out


def _band_hashes(per_band: int, k: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(k // per_band - 1)), lambda b: F.xxhash64(b, F.slice(F.col("signature"), b * per_band + 1, F.lit(per_band))))


def _sketches(texts: DataFrame, size: int = SKETCH, bits: int = SKETCH_BITS) -> DataFrame:
    """key, s0, s1, ...: the low bits of each coordinate of a longer signature, 64 // bits coordinates to a number."""
    each = 64 // bits
    names = [f"s{j}" for j in range(size // each)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shifts = np.arange(each, dtype=np.uint64) * np.uint64(bits)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                low = signature_column(part.column(1), size)[0].view(np.uint32).astype(np.uint64) & np.uint64((1 << bits) - 1)
                packed = np.bitwise_or.reduce(low.reshape(len(low), len(names), each) << shifts, axis=2).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(packed[:, j]) for j in range(len(names)))], names=["key", *names])

    return texts.select("key", "text").mapInArrow(textvec.freeing(run), "key binary, " + ", ".join(f"{n} long" for n in names))


def _may_be_alike(threshold: float, k: int = SKETCH, bits: int = SKETCH_BITS) -> Column:
    """Whether sketches agree as often as those of alike texts do, SIGMAS standard deviations less."""
    each, differ = 64 // bits, F.lit(0)
    ones = sum(1 << (bits * i) for i in range(each))
    for j in range(k // each):
        x = F.col(f"s{j}_a").bitwiseXOR(F.col(f"s{j}_b"))
        any_bit = x
        for shift in range(1, bits):
            any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(x, shift))
        differ = differ + F.bit_count(any_bit.bitwiseAND(F.lit(ones)))
    agree = threshold + (1 - threshold) * 2.0**-bits
    return differ <= int(np.ceil(k * (1 - agree) + SIGMAS * np.sqrt(k * agree * (1 - agree))))


def _labelled(docs: DataFrame, threshold: float) -> DataFrame:
    """label, doc_id, key, class_id, class_size of every row; equal labels are one class, also where class_id is null or that of another."""
    labels = classes_of_contents(docs, threshold)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), content_key(F.col("text")).alias("key"))
    named = storage.table(rows.join(labels, "key", "left").select("doc_id", "key", F.coalesce("label", "key").alias("label")))
    sizes = storage.table(named.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")))
    storage.drop(labels)
    return named.join(sizes, "label")


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (least doc_id of the class), class_size, key of every row."""
    return _labelled(docs, threshold).select("doc_id", "class_id", "class_size", "key")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, that of its least doc_id; the columns of docs. A class whose doc_ids are all null keeps one row."""
    found = _labelled(docs, threshold)
    chosen = found.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("label", "doc_id").agg(F.min("key").alias("key"), F.count("*").alias("n"))
    chosen = storage.table(chosen.withColumnRenamed("doc_id", "own_id").select("own_id", F.col("key").alias("own_key"), "n"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), content_key(F.col("text")).alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = rows.join(chosen, rows["doc_id"].eqNullSafe(chosen["own_id"]) & (rows["key"] == chosen["own_key"]), "left_semi")
    if not chosen.where("n > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", "key"])
    return kept.select("row.*")
