"""Packing of tokenized documents into fixed windows by best-fit decreasing.

A document's ids, with the end id, are cut into full windows while they last; the rest is one piece. Pieces are spread over
shards by a hash, and each shard packs its pieces, longest first, into the open window with the least room that still fits.
A segment tree over the capacities 0..window finds that window in log2(window) steps. Only the pieces' metadata are shuffled.

The pieces are written once and counted; there is a shard for each SHARD of them, whatever the number of partitions, so that the few
open windows that a shard ends with are lost among thousands of full ones. Pieces are dealt in turn, so copies of one row spread evenly.

Null texts are empty texts: one piece holding the end id. Texts of any length are cut into full windows. Repeated rows are packed as often
as they occur; ties in length are broken by doc_id, start and checksum, so that a lost task packs the same windows again. An empty table
gives an empty result. Only doc_id and text are read, so other columns can't clash. A shard of a caller's own choice that has over
`block` pieces starts over with new windows after so many, which bounds its memory.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage, textvec
from .bpe import ColumnEncoder

WINDOW = 2048
END_ID = 1
#: Pieces of a shard, and most pieces that a task holds at once.
SHARD = 20_000
BLOCK = 1_000_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class WindowTree:
    """Open windows by remaining capacity; find gives the tightest that fits."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.held = [0] * (2 * self.size)  # number of windows below each node
        self.stacks: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, room: int, window_id: int) -> None:
        self.stacks[room].append(window_id)
        i = self.size + room
        while i:
            self.held[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, id) of a window with the least room of at least need, which leaves the tree."""
        held, i = self.held, self.size + need
        if not held[i]:
            while i > 1 and (i & 1 or not held[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if held[2 * i] else 2 * i + 1
        room = i - self.size
        while i:
            held[i] -= 1
            i >>= 1
        return room, self.stacks[room].pop()


def best_fit(lengths: list[int], window: int = WINDOW) -> tuple[list[int], list[int], int]:
    """(window, offset) of each piece in the order given, which should be longest first, and the number of windows."""
    tree, used, where, offsets = WindowTree(window), 0, [], []
    for n in lengths:
        got = tree.take(n) if n < window else None
        if got is None:
            room, w = window, used
            used += 1
        else:
            room, w = got
        where.append(w)
        offsets.append(window - room)
        if room > n:
            tree.add(room - n, w)
    return where, offsets, used


def ranks_of_tokenizer(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """(ranks, special tokens) of a byte-level BPE tokenizer file; the merges must be in the order of the ids."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable}
    for k, b in enumerate(sorted(set(range(256)) - set(printable))):
        byte_of[chr(256 + k)] = b
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
    if made != sorted(made):
        raise ValueError("merges aren't in the order of their ids")
    return {bytes(byte_of[c] for c in t): i for t, i in vocab.items()}, special


@lru_cache(maxsize=2)
def _core(path: str) -> tuple:
    """(merging core, special tokens) of a tokenizer file, made once in each Python worker."""
    import public_tokenizers
    import tiktoken

    ranks, special = ranks_of_tokenizer(path)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe, special


def tokenizer_encoder(path: str) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """Encoder of a tokenizer file for many texts at once; special tokens in a text count as such, as in that library."""
    core, special = _core(path)
    encoder = ColumnEncoder(lambda pieces: list(map(core.encode_single_piece, pieces)))

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not any(s in t for s in special for t in texts):
            return encoder.encode(texts)
        import tokenizers

        whole = tokenizers.Tokenizer.from_file(path)
        ids = [np.array(whole.encode(t, add_special_tokens=False).ids, np.uint32) for t in texts]
        return np.concatenate([*ids, np.zeros(0, np.uint32)]), np.cumsum([0, *map(len, ids)])

    encode.slices = encoder.slices  # type: ignore[attr-defined]
    return encode


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece of each document: its place, length, checksum, the document's length and, if asked for, the ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer_encoder(tokenizer)
        for batch in batches:
            doc_ids, texts = batch.column(0), ["" if t is None else t for t in batch.column(1).to_pylist()]
            for at, part in encode.slices(texts):
                ids, cuts = encode(part)
                rows: dict[str, list] = {k: [] for k in ("row", "start", "length", "crc", "tokens", "ids")}
                for k in range(len(part)):
                    own = np.append(ids[cuts[k] : cuts[k + 1]], np.uint32(end_id)).astype("<u4")
                    for start in range(0, len(own), window):
                        piece = own[start : start + window]
                        rows["row"].append(at + k)
                        rows["start"].append(start)
                        rows["length"].append(len(piece))
                        rows["crc"].append(zlib.crc32(piece.tobytes()))
                        rows["tokens"].append(len(own))
                        if with_ids:
                            rows["ids"].append(piece.astype(np.int32))
                columns = [doc_ids.take(pa.array(rows["row"], pa.int64())).cast(pa.int64()), *(pa.array(rows[k], pa.int64()) for k in ("start", "length", "crc", "tokens"))]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    columns.append(pa.array(rows["ids"], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(textvec.freeing(cut), PIECES + ", ids array<int>" * with_ids)


def pack(rows: DataFrame, window: int = WINDOW, shards: int | None = None, block: int = BLOCK) -> DataFrame:
    """Adds sequence_id and offset to rows of pieces()."""
    rows = storage.table(rows)
    n = shards or max(1, -(-rows.count() // SHARD))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        held, count = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal base, held, count
            if not count:
                return
            table = pa.Table.from_batches(held)
            table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
            where, offsets, used = best_fit(table.column("length").to_pylist(), window)
            table = table.append_column("sequence_id", pa.array(np.array(where, np.int64) + base)).append_column("offset", pa.array(offsets, pa.int64()))
            base += used
            held, count = [], 0
            yield from table.to_batches(max_chunksize=10_000)

        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= block:
                yield from flush()
        yield from flush()

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", sequence_id long, offset long"
    return rows.repartition(n).mapInArrow(textvec.freeing(place), schema)


def pack_documents(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False, shards: int | None = None, block: int = BLOCK) -> DataFrame:
    """Pieces of all documents with the sequence each lies in. docs needs doc_id and text; other columns are not read."""
    return pack(pieces(docs, tokenizer, window, end_id, with_ids), window, shards, block)


def sequences(packed: DataFrame) -> DataFrame:
    """The windows themselves, from rows packed with ids: sequence_id, length, ids in order. A window bounds each group."""
    one = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.flatten(F.transform(one, lambda x: x["ids"])).alias("ids"))
