"""Document fingerprints by one-permutation MinHash.

The shingles of five words of a text are hashed once; the top bits of a hash name its bin, which keeps the least hash. An empty
bin copies a full one found by optimal densification: bin and attempt number alone decide where to look, so two texts look in the
same places. Of each bin the low BITS bits of its value, remixed with its
number, are stored. Two fingerprints that agree in m of BINS bins have the
likeness (m / BINS - 2**-BITS) / (1 - 2**-BITS), cut to 0..1: unequal bins agree by chance with probability 2**-BITS.

A text of one to four words is one shingle. A text without words, null included, has the fingerprint "" ; two of those have the
likeness 1, and one of them and any other text 0. Equal texts, repeated rows among them, have equal fingerprints. Texts of any length
are hashed whole. An empty table gives an empty result; only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec
from .textvec import mix64

BINS = 1024
BITS = 4
#: Attempts that empty bins make side by side, and full bins of a row up to which they make none.
ATTEMPTS, FEW = 64, 32
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def signatures(column: pa.Array, bins: int = BINS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(texts x bins array of low bits, whether a text has words)."""
    out, full = np.zeros((len(column), bins), np.uint8), np.zeros(len(column), bool)
    shift = np.uint64(64 - bins.bit_length() + 1)
    for at, rows, own, values in textvec.text_shingles(column):
        least = np.full(rows * bins, _NONE)
        np.minimum.at(least, own * bins + (values >> shift).astype(np.int64), values)
        least = densify(least.reshape(rows, bins))
        low = mix64(least + np.arange(bins, dtype=np.uint64) * np.uint64(textvec._MULT)) & np.uint64((1 << bits) - 1)
        out[at : at + rows] = low
        has = np.zeros(rows, bool)
        has[own] = True
        full[at : at + rows] = has
        out[at : at + rows][~has] = 0
    return out, full


def _source(at: np.ndarray, attempt: int, bins: int) -> np.ndarray:
    return (mix64(at.astype(np.uint64) * np.uint64(0x10001) + np.uint64(attempt << 40)) % np.uint64(bins)).astype(np.int64)


@lru_cache(maxsize=2)
def _sources(bins: int) -> np.ndarray:
    """Where each bin looks at its first attempts."""
    return np.stack([_source(np.arange(bins), k + 1, bins) for k in range(ATTEMPTS)])


@lru_cache(maxsize=2)
def _turns(bins: int) -> np.ndarray:
    """The attempt at which each bin (column) first looks at each other one (row)."""
    out, attempt, all_ = np.zeros((bins, bins), np.int32), 1, np.arange(bins)
    left = bins * bins
    while left:
        at = _source(all_, attempt, bins)
        new = out[at, all_] == 0
        out[at[new], all_[new]] = attempt
        left -= int(new.sum())
        attempt += 1
    return out


def densify(least: np.ndarray) -> np.ndarray:
    """Fills empty bins of rows that have a full one. Rows with few full bins, where attempts would be many, ask which of them comes first."""
    bins = least.shape[1]
    empty = least == _NONE
    held = bins - empty.sum(axis=1)
    out = least.copy()
    rows, at = np.nonzero(empty & (held > FEW)[:, None])
    for sources in _sources(bins) if len(rows) else ():
        source = sources[at]
        value = least[rows, source]
        hit = value != _NONE
        out[rows[hit], at[hit]] = value[hit]
        rows, at = rows[~hit], at[~hit]
    for row in np.flatnonzero((held > 0) & (held <= FEW)):
        _first_full(least[row], out[row], np.flatnonzero(empty[row]))
    left = np.flatnonzero(np.diff(rows, prepend=-1))
    for row, own in zip(rows[left], np.split(at, left[1:]), strict=True) if len(rows) else ():
        _first_full(least[row], out[row], own)
    return out


def _first_full(least: np.ndarray, out: np.ndarray, at: np.ndarray) -> None:
    """Fills the bins `at` of one row."""
    full = np.flatnonzero(least != _NONE)
    out[at] = least[full[_turns(len(least))[full][:, at].argmin(axis=0)]]


def pack_hex(signature: np.ndarray, full: np.ndarray, bits: int = BITS) -> list[str]:
    """Hexadecimal text of the low bits of each row, "" for a text without words."""
    rows, bins = signature.shape
    planes = ((signature[:, :, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint8)) & 1).reshape(rows, bins * bits)
    packed = np.packbits(planes, axis=1)
    return [packed[i].tobytes().hex() if full[i] else "" for i in range(rows)]


def likeness(a: np.ndarray, a_full: np.ndarray, b: np.ndarray, b_full: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Estimated Jaccard likeness of the shingle sets, row by row."""
    chance = 2.0**-bits
    raw = ((a == b).mean(axis=1) - chance) / (1 - chance)
    return np.where(a_full & b_full, np.clip(raw, 0.0, 1.0), (a_full == b_full).astype(float))


def fingerprint_column(docs: DataFrame, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """doc_id and fingerprint of each row; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pack_hex(*signatures(batch.column(1), bins, bits), bits), pa.string())], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(textvec.freeing(run), docs.select("doc_id").schema.add("fingerprint", "string"))


def _bucket(splits: list[int], value: Column) -> Column:
    """Number of splits at or below value, by two short scans."""
    if not splits:
        return F.lit(0)
    step = max(1, int(len(splits) ** 0.5))
    fine = F.array(*map(F.lit, splits))
    coarse = F.array(*map(F.lit, splits[::step]))
    head = F.size(F.filter(coarse, lambda x: x <= value)) - 1
    rest = F.size(F.filter(F.slice(fine, F.greatest(head, F.lit(0)) * step + 1, F.lit(step)), lambda x: x <= value))
    return F.when(head < 0, F.lit(0)).otherwise(head * step + rest)


def in_order(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """docs (doc_id, text) dealt into ranges of doc_id and sorted, columns bucket, guest, doc_id, text. The first row of each range
    also stands at the end of the range before it, with guest = 1, and the first of all at the end of the last range.

    The ranges come from quantiles of doc_id; what reaches the driver is one number for each range.
    """
    spark = docs.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    quantiles = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n)).first()[0] if n > 1 else []
    splits = sorted(set(quantiles or []))
    placed = docs.withColumn("bucket", _bucket(splits, F.col("doc_id")))
    firsts = sorted(placed.groupBy("bucket").agg(F.min("doc_id")).collect())
    before, first = [-1] * (len(splits) + 1), [None] * (len(splits) + 1)
    for k, (bucket, doc_id) in enumerate(firsts):
        before[bucket], first[bucket] = firsts[k - 1][0], doc_id
    host = F.get(F.array(*map(F.lit, before)), F.col("bucket"))
    is_first = F.get(F.array(*(F.lit(x).cast("long") for x in first)), F.col("bucket")) == F.col("doc_id")
    here = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("guest"))
    both = F.array(here, F.struct(host.alias("bucket"), F.lit(1).alias("guest")))
    dealt = placed.select(F.explode(F.when(is_first, both).otherwise(F.array(here))).alias("at"), "doc_id", "text").select("at.bucket", "at.guest", "doc_id", "text")
    return dealt.repartitionById(n, F.pmod("bucket", F.lit(n)).cast("int")).sortWithinPartitions("bucket", "guest", "doc_id", "text")


def with_edits(docs: DataFrame, bins: int = BINS, bits: int = BITS, parts: int | None = None) -> DataFrame:
    """Fingerprints of each text, of its edited text and how near it is to that and to the next text.

    The edited text has its last floor(n / 2) code points replaced by the first as many of the next document's, by doc_id; after
    the last comes the first. Rows with the same doc_id follow each other by text; a null doc_id comes first and is returned null.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(ids: list[int], texts: list[str]) -> pa.RecordBatch:
            """texts has one more than ids: each one's next."""
            edited = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(texts[:-1], texts[1:], strict=True)]
            own, own_full = signatures(pa.array(texts, pa.large_string()), bins, bits)
            new, new_full = signatures(pa.array(edited, pa.large_string()), bins, bits)
            columns = [
                pa.array([None if i == -(2**63) else i for i in ids], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                pa.array(pack_hex(own[:-1], own_full[:-1], bits)), pa.array(pack_hex(new, new_full, bits)),
                pa.array(likeness(own[:-1], own_full[:-1], new, new_full, bits)), pa.array(likeness(own[:-1], own_full[:-1], own[1:], own_full[1:], bits)),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        ids: list[int] = []
        texts: list[str] = []
        size, bucket, closed = 0, None, False
        for batch in batches:
            for b, guest, doc_id, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if b != bucket:
                    bucket, closed, ids, texts, size = b, False, [], [], 0
                if closed:
                    continue
                texts.append(text)
                size += len(text)
                if not guest:
                    ids.append(doc_id)
                closed = bool(guest)
                if len(texts) > 1 and (guest or size > textvec.SLICE_BYTES or len(texts) > textvec.SLICE_ROWS):
                    yield rows(ids[: len(texts) - 1], texts)
                    ids, texts, size = ids[len(texts) - 1 :], texts[-1:], len(text)

    return in_order(docs, parts).mapInArrow(textvec.freeing(run), schema)
