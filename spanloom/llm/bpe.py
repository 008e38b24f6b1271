"""Byte-level BPE over whole columns.

Texts are cut into pre-tokens by the usual pattern, vectorised over code points. Encoding a pre-token has two tiers:

1. a minimal perfect hash over the vocabulary resolves a pre-token that is itself a vocabulary entry;
2. a miss runs the merges with a heap of ranked pairs over a doubly linked list of its bytes, O(n log n).

Resolved pre-tokens are remembered by a 64-bit hash in a table of bounded size, so that each distinct one is resolved once
in a while, not at each place. A second, independent hash is compared at each place; where it differs, the pre-tokens of that slice are
resolved one by one. Null texts encode as empty texts; empty texts have no ids. Texts of any length are encoded whole. Rows stay as they
are, repeated ones too. An empty table gives an empty result; only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd

from . import textvec
from .textvec import _MULT, mix64

#: What the pre-token pattern's classes are, as fixed values: letter, number, other, white space.
L, N, O, S = 0, 1, 2, 3
#: Code points handled at once, and remembered pre-tokens.
SLICE_CHARS = 1 << 20
MEMO = 2_000_000


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of each code point."""
    import regex

    table = np.full(0x110000, O, dtype=np.uint8)
    text = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((L, r"\p{L}+"), (N, r"\p{N}+"), (S, r"\s+")):
        for m in regex.finditer(pattern, text):
            a, b = ord(text[m.start()]), ord(text[m.end() - 1])
            if a < 0xD800 <= b:
                table[a:0xD800] = kind
                table[0xE000 : b + 1] = kind
            else:
                table[a : b + 1] = kind
    return table


@lru_cache(maxsize=1)
def _point_hash() -> np.ndarray:
    return mix64(np.arange(0x110000, dtype=np.uint64) + np.uint64(_MULT))


_PLACE_HASH = mix64(np.arange(1, 1025, dtype=np.uint64) * np.uint64(2)) | np.uint64(1)
_PLACE_CHECK = mix64(np.arange(5001, 6025, dtype=np.uint64) * np.uint64(6)) | np.uint64(1)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class MinimalPerfectHash:
    """Hash and displace: n keys onto 0..n-1 without a collision; a lookup reads one displacement and compares one key."""

    def __init__(self, keys: list[bytes], per_bucket: int = 2):
        import xxhash

        self.n, self.m = len(keys), max(1, len(keys) // per_bucket)
        self._hash = xxhash.xxh3_64_intdigest
        buckets: list[list[int]] = [[] for _ in range(self.m)]
        hashes = [self._hash(k) for k in keys]
        if len(set(hashes)) != self.n:
            raise ValueError("keys must be distinct")
        for i, h in enumerate(hashes):
            buckets[h % self.m].append(i)
        self.seeds = [0] * self.m
        self.slot_key: list[bytes | None] = [None] * self.n
        self.slot_of: list[int] = [0] * self.n
        free = np.ones(self.n, dtype=bool)
        order = sorted(range(self.m), key=lambda b: -len(buckets[b]))
        for b in order:
            members = buckets[b]
            if not members:
                break
            if len(members) == 1:
                continue
            seed = 1
            while True:
                slots = [self._spot(hashes[i], seed) for i in members]
                if len(set(slots)) == len(slots) and all(free[s] for s in slots):
                    break
                seed += 1
            self._put(keys, members, slots, b, seed, free)
        spare = iter(np.flatnonzero(free).tolist())
        for b in order:  # single keys take what is left; a negative seed names the slot itself
            if len(buckets[b]) == 1:
                slot = next(spare)
                self._put(keys, buckets[b], [slot], b, -slot - 1, free)

    def _put(self, keys, members, slots, bucket, seed, free) -> None:
        self.seeds[bucket] = seed
        for i, s in zip(members, slots, strict=True):
            free[s] = False
            self.slot_key[s], self.slot_of[s] = keys[i], i

    def _spot(self, h: int, seed: int) -> int:
        x = ((h ^ (seed * 0x9E3779B97F4A7C15)) * 0xFF51AFD7ED558CCD) & 0xFFFFFFFFFFFFFFFF
        x ^= x >> 32
        return x % self.n

    def get(self, key: bytes) -> int | None:
        """Index of key in the list given, or None."""
        if not self.n:
            return None
        h = self._hash(key)
        seed = self.seeds[h % self.m]
        slot = -seed - 1 if seed < 0 else self._spot(h, seed)
        return self.slot_of[slot] if self.slot_key[slot] == key else None


class Merger:
    """Second tier: merges of one pre-token, lowest rank first and leftmost among equals. A rank is the id of what the pair makes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.byte = [ranks[bytes([b])] for b in range(256)]
        self.bits = max(ranks.values()).bit_length()
        self.pair: dict[int, int] = {}
        get = ranks.get
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                if (a := get(token[:cut])) is not None and (b := get(token[cut:])) is not None:
                    self.pair[a << self.bits | b] = rank

    def encode(self, piece: bytes) -> list[int]:
        """The heap holds rank and place in one number; an entry is stale if its place no longer holds that pair."""
        n, bits, get = len(piece), self.bits, self.pair.get
        byte = self.byte
        ids = [byte[b] for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n))
        shift = n.bit_length()
        mask = (1 << shift) - 1
        heap = [r << shift | i for i in range(n - 1) if (r := get(ids[i] << bits | ids[i + 1])) is not None]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            x = pop(heap)
            i, rank = x & mask, x >> shift
            j = after[i]
            if ids[i] < 0 or j >= n or get(ids[i] << bits | ids[j]) != rank:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := get(rank << bits | ids[k])) is not None:
                    push(heap, r << shift | i)
            if (h := before[i]) >= 0 and (r := get(ids[h] << bits | rank)) is not None:
                push(heap, r << shift | h)
        return [x for x in ids if x >= 0]


class TwoTier:
    """bytes of a pre-token -> ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.keys = list(ranks)
        self.values = [ranks[k] for k in self.keys]
        self.hash = MinimalPerfectHash(self.keys)
        self.merger = Merger(ranks)

    def __call__(self, piece: bytes) -> list[int]:
        at = self.hash.get(piece)
        return self.merger.encode(piece) if at is None else [self.values[at]]

    def many(self, pieces: list[bytes]) -> list[list[int]]:
        return [self(p) for p in pieces]


def pretoken_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pre-tokens start among the code points of many texts; first: where each text starts, and the end."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    heads = first[:-1]
    heads = heads[heads < n]
    head = np.zeros(n + 1, dtype=bool)
    head[heads] = True
    head[n] = True
    opens = np.ones(n + 1, dtype=bool)
    opens[1:n] = kind[1:] != kind[:-1]
    opens |= head
    space = kind == S
    last = np.flatnonzero(space & opens[1:] & ~head[1:])  # last of a run of white space before something else in the same text
    opens[last] = True
    opens[last[points[last] == 0x20] + 1] = False
    tick = np.flatnonzero((points == 0x27) & opens[:n] & opens[1:] & ~head[1:])
    if len(tick):
        tick = tick[kind[tick + 1] == L]
        one = points[tick + 1]
        single = np.isin(one, [0x73, 0x74, 0x6D, 0x64])
        opens[tick[single] + 1] = False
        opens[tick[single] + 2] = True
        pairs = tick[~single]
        pairs = pairs[pairs + 2 < n]
        pairs = pairs[~opens[pairs + 2]]
        a, b = points[pairs + 1], points[pairs + 2]
        double = pairs[((a == 0x72) & (b == 0x65)) | ((a == 0x76) & (b == 0x65)) | ((a == 0x6C) & (b == 0x6C))]
        opens[double + 1] = False
        opens[double + 3] = True
    return np.flatnonzero(opens[:n])


class ColumnEncoder:
    """ids of many texts at once. many: bytes of distinct pre-tokens -> their ids, in order."""

    def __init__(self, many: Callable[[list[bytes]], list[list[int]]], memo: int = MEMO):
        self.many, self.memo = many, memo
        self._clear()

    def _clear(self) -> None:
        self.parts: list[tuple[pd.Index, int]] = []  # (hashes, number of the first); each part is much smaller than the one before
        self.n = 0
        self.at = np.zeros(0, np.int64)  # where the ids of a known pre-token start
        self.count = np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.uint32)
        self.check = np.zeros(0, np.uint64)  # second hash of each known pre-token

    def _find(self, distinct: np.ndarray) -> np.ndarray:
        where = np.full(len(distinct), -1, np.int64)
        for index, base in self.parts:
            open_ = np.flatnonzero(where < 0)
            if not len(open_):
                break
            got = index.get_indexer(distinct[open_])
            where[open_[got >= 0]] = got[got >= 0] + base
        return where

    def _learn(self, hashes: np.ndarray, check: np.ndarray, pieces: list[bytes]) -> None:
        self.check = np.concatenate([self.check, check])
        found = self.many(pieces)
        counts = np.fromiter(map(len, found), np.int32, len(found))
        added = np.fromiter((x for ids in found for x in ids), np.uint32, int(counts.sum()))
        self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(counts, dtype=np.int64) - counts])
        self.count = np.concatenate([self.count, counts])
        self.flat = np.concatenate([self.flat, added])
        base = self.n
        self.n += len(hashes)
        while self.parts and len(self.parts[-1][0]) < 4 * len(hashes):
            index, base = self.parts.pop()
            hashes = np.concatenate([index.to_numpy(), hashes])
        self.parts.append((pd.Index(hashes), base))

    def slices(self, texts: list[str], most: int = SLICE_CHARS) -> Iterator[tuple[int, list[str]]]:
        i, size, j = 0, 0, 0
        while j < len(texts):
            size += len(texts[j]) + 1
            j += 1
            if size >= most or j == len(texts):
                yield i, texts[i:j]
                i, size = j, 0

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text starts among them and the end)."""
        joined = "".join(texts)
        first = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=first[1:])
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        starts = pretoken_starts(points, first)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        lengths = np.diff(starts, append=len(points))
        place = np.arange(len(points), dtype=np.int64) - np.repeat(starts, lengths)
        code = _point_hash()[points]
        code *= _PLACE_HASH[place & (len(_PLACE_HASH) - 1)]
        if lengths.max() > len(_PLACE_HASH):
            code = np.where(place >= len(_PLACE_HASH), mix64(code + place.astype(np.uint64)), code)
        h = mix64(np.add.reduceat(code, starts) + lengths.astype(np.uint64))
        second = np.add.reduceat((points + np.uint64(1)) * _PLACE_CHECK[place & (len(_PLACE_CHECK) - 1)], starts) ^ lengths.astype(np.uint64)
        codes, distinct = pd.factorize(h)
        where = self._find(distinct)
        fresh = np.flatnonzero(where < 0)
        if len(fresh):
            if self.n and self.n + len(fresh) > self.memo:
                self._clear()
                where[:], fresh = -1, np.arange(len(distinct))
            where[fresh] = self.n + np.arange(len(fresh))
            seen = np.empty(len(distinct), np.int64)
            seen[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            some = seen[fresh]
            self._learn(distinct[fresh], second[some], _bytes_of(joined, starts[some], lengths[some]))
        token = where[codes]
        if (self.check[token] != second).any():
            found = self.many(_bytes_of(joined, starts, lengths))
            total = np.cumsum([0, *map(len, found)])
            return np.array([x for ids in found for x in ids], np.uint32), total[np.searchsorted(starts, first)]
        counts = self.count[token]
        total = np.zeros(len(counts) + 1, np.int64)
        np.cumsum(counts, out=total[1:])
        ids = self.flat[np.arange(int(total[-1])) + np.repeat(self.at[token] - total[:-1], counts)]
        return ids, total[np.searchsorted(starts, first)]


def _bytes_of(joined: str, starts: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    return [joined[a:b].encode("utf-8", "surrogatepass") for a, b in zip(starts.tolist(), (starts + lengths).tolist(), strict=True)]


@lru_cache(maxsize=2)
def two_tier(ranks_path: str) -> tuple[dict[bytes, int], TwoTier]:
    """Ranks and encoder of a file, made once in each Python worker."""
    ranks = read_ranks(ranks_path)
    return ranks, TwoTier(ranks)


def encode_decode(docs, ranks_path: str):
    """Ids of each text and the text decoded from them again, as digests: n_tokens, ids_sha256 (decimal ids joined by commas) and
    decoded_sha256. docs needs doc_id and text; other columns are not read. Rows stay as they are, repeated ones too."""
    import hashlib

    import pyarrow as pa
    from pyspark.sql import functions as F

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, two = two_tier(ranks_path)
        encoder = ColumnEncoder(two.many)
        decode = {i: b for b, i in ranks.items()}.__getitem__
        decimal = {i: str(i) for i in ranks.values()}.__getitem__
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            for at, part in encoder.slices(texts):
                ids, cuts = encoder.encode(part)
                n, own, back = [], [], []
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    mine = ids[a:b].tolist()
                    n.append(len(mine))
                    own.append(hashlib.sha256(",".join(map(decimal, mine)).encode()).hexdigest())
                    back.append(hashlib.sha256(b"".join(map(decode, mine))).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(n, pa.int64()), pa.array(own), pa.array(back)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(textvec.freeing(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_column(docs, ranks_path: str):
    """doc_id and ids array<int> of each text."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ColumnEncoder(two_tier(ranks_path)[1].many)
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            for at, part in encoder.slices(texts):
                ids, cuts = encoder.encode(part)
                lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), lists], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(textvec.freeing(run), "doc_id long, ids array<int>")


def decode_column(encoded, ranks_path: str):
    """doc_id and the bytes of encode_column's ids; a null list gives null."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = {i: b for b, i in read_ranks(ranks_path).items()}.__getitem__
        for batch in batches:
            texts = [None if ids is None else b"".join(map(decode, ids)) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(textvec.freeing(run), "doc_id long, decoded binary")
