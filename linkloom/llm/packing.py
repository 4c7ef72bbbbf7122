"""Harmonic packing of tokenised documents into sequences of fixed capacity.

A piece of length t belongs to the reciprocal class k with capacity / (k + 1) < t <= capacity / k, and a bin of that
class holds exactly k pieces. Every worker fills bins of its own, without a shuffle. As documents may be cut freely,
a document first gives whole sequences, then pieces whose lengths are exactly capacity / 2, / 4, ... down to a
smallest part: their bins fill without a gap. Only the last, short piece is packed with a gap, by its class. What a
worker has in unfinished bins at the end of its input it merges, longest first, so that few sequences stay part-full;
a whole piece is laid down there wherever it fits."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import bpe
from ._common import arrow_map, texts_of

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SMALLEST = 16  # exact parts are at least capacity / SMALLEST long
LONG_RUN = 20_000


class Ids:
    """Token ids of a byte-level BPE file of the tokenizers library, as that library gives them.

    The vocabulary and the merges' order are handed to a faster implementation of the same algorithm. It is used only
    if the merges are in the order of their ids, as it needs, and never for texts with very long runs without a
    break, which take it quadratic time: there, and otherwise, the library itself encodes."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.fast = None
        merges, added = bpe.byte_level(path)
        order = [new for _, new in sorted(merges.rank.values())]
        if order == sorted(order) and sorted(merges.entries.values()) == list(range(len(merges.entries))):
            self.fast = tiktoken.Encoding("compiled", pat_str=PATTERN, mergeable_ranks=merges.entries, special_tokens=added)

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None and (len(text) < LONG_RUN or max(map(len, text.split(" "))) < LONG_RUN):
            return np.array(self.fast.encode(text, allowed_special="all"), np.uint32)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(4)
def ids_of(path: str) -> Ids:
    return Ids(path)


def parts(length: int, capacity: int) -> list[int]:
    """Whole sequences, exact fractions by halves, and the rest."""
    out = [capacity] * (length // capacity)
    rest, size = length % capacity, capacity // 2
    while rest and size * SMALLEST >= capacity and capacity % size == 0:
        if rest >= size:
            out.append(size)
            rest -= size
        size //= 2
    return out + [rest] if rest else out


class Bins:
    """Open bins by class; a full one leaves with its number."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next = capacity, first
        self.open: dict[int, list] = defaultdict(list)

    def add(self, piece: tuple, length: int) -> list[tuple] | None:
        if length == self.capacity:
            self.next += 1
            return [(*piece, self.next - 1, 0)]
        k = self.capacity // length
        held = self.open[k]
        held.append((piece, length))
        if len(held) < k:
            return None
        del self.open[k]
        return self._lay(held)

    def _lay(self, held: list) -> list[tuple]:
        out, at = [], 0
        for piece, length in held:
            out.append((*piece, self.next, at))
            at += length
        self.next += 1
        return out

    def close(self) -> list[tuple]:
        """Merges the open bins: pieces, longest first, into the first bin with room."""
        left = sorted((x for held in self.open.values() for x in held), key=lambda x: -x[1])
        self.open.clear()
        bins: list[tuple[int, list]] = []
        for x in left:
            for i, (room, held) in enumerate(bins):
                if x[1] <= room:
                    held.append(x)
                    bins[i] = (room - x[1], held)
                    break
            else:
                bins.append((self.capacity - x[1], [x]))
        return [row for _, held in bins for row in self._lay(held)]


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack(path: str, capacity: int, end_id: int, with_ids: bool):
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64()] * len(names)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*((*r[:5], *r[-2:]) for r in rows))) or [()] * 7
        arrays = [pa.array(c, k) for c, k in zip(cols, kinds)]
        if with_ids:
            arrays.append(pa.array([r[5] for r in rows], pa.list_(pa.int64())))
        return pa.RecordBatch.from_arrays(arrays, names=[*names, *["ids"] * with_ids])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ids_of(path)
        bins, done = Bins(capacity, TaskContext.get().partitionId() << 40), []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py()), np.uint32(end_id))
                at = 0
                for n in parts(len(ids), capacity):
                    piece = (doc_id, at, n, zlib.crc32(ids[at : at + n].tobytes()), len(ids))
                    if with_ids:
                        piece += (ids[at : at + n].tolist(),)
                    done += bins.add(piece, n) or ()
                    at += n
                if len(done) >= 20_000:
                    yield out(done)
                    done = []
        yield out(done + bins.close())

    return run


def pack(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), with_ids also ids.

    A document's ids are those of the tokenizer file and then end_id, so that an empty or null text has one. Each id
    lies in exactly one piece; pieces of a sequence follow each other from offset 0. Repeated rows are documents of
    their own; ids may be null. Sequence numbers begin with the number of the input partition. Further columns are
    ignored."""
    slim = texts_of(docs, F.col(id_col).cast("long").alias("doc_id"), text_col=text_col)
    return arrow_map(slim, _pack(path, capacity, end_id, with_ids), SCHEMA + ", ids array<bigint>" * with_ids).withColumnRenamed("doc_id", id_col)
