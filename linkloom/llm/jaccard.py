"""N-gram Jaccard join: exact links between sets of word shingles.

The join runs over the classes of equal sets, in five steps.

1. *Reach.* If x and y are linked, x has at most m(|x|) = |x| - ceil(s |x|) shingles that y lacks. So the first
   m(n) + l(n) shingles of either, by hash, hold at least min(l(|x|), l(|y|)) common ones. Only these leading
   hashes are compared: a set with too few of them in any other set can have no link and goes. They move as packed
   32-bit fingerprints; one that occurs twice within a task is counted there and sent once, so a frequent shingle
   sends a fingerprint a task, whatever its count. (False hits keep a set that could go; none is lost.)
2. *Order.* The shingles of what stays are counted in a table of cells of bounded size. Rare cells come first, then
   hashes: any order of all shingles would do for the steps below, this one puts passages that many texts share last.
3. *Leaders.* In this order linked sets share one of their first m(n) + 1 shingles. Each set is first compared with
   one leader, that with which it shares most of these; the leader of a shingle is the set whose shingles are most
   common.
4. Components of these links. Shingles whose sets lie in one component have nothing left to tell.
5. *Tiles.* The sets of another shingle are dealt into tiles by bands of set sizes. Bands grow by 1 / s, so linked
   sets lie in one band or neighbouring ones. The smaller set of a pair brings only its first n - ceil(2 s n / (1 + s))
   + 1 shingles, the larger its first m(n) + 1. A pair is made if the places of the shingle in both sets leave room
   for the overlap asked for and the bitmaps do; the closest pair of each component is settled first, as often that
   joins it.

A comparison first bounds the overlap by hashed bitmaps: |x| + |y| - popcount(bx xor by) is at least twice the
overlap, as each bit holds the parity of the shingles hashed to it. Tiles use short bitmaps; those of the pairs that
are left have at least two bits a shingle by the set's band, and the longer one is folded to the length of the other.
What passes is settled by the exact intersection of the sorted arrays. Links inside a component are never enumerated;
every pair of sets is either compared, excluded by a bound, or already in one component, so components are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graphs
from ._common import STEP, U64, WORD, arrow_map, cut, dealt_anew, edges_between, mix, powers, shuffle_parts, slices, span_hashes, texts_of

#: Bits of the bitmaps that tiles compare; the least bits of those that pairs are compared by before their arrays.
BITS = 512
FLUSH_POSTINGS, FLUSH_SETS, SHARED = 1_000_000, 60_000, 65_535
#: Sets of a shingle that one side of a tile holds, and pairs with the same set that a task settles.
BLOCK = 512
#: The table of shingle counts has at most 2 ** CELLS cells, of a byte each where it is sent to the executors.
CELLS, CELL_BLOCK = 22, 1 << 16
#: Bytes of a text whose words are hashed at once.
PIECE = 1 << 19

_lower = np.arange(256)
_lower[65:91] += 32
#: A random value for each byte, letters A-Z as a-z.
BYTE = mix((np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95)))[_lower]
PLACE = mix(np.arange(101, 165, dtype=U64)) | U64(1)


def word_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the words of one text, a piece at a time; a word over several pieces is hashed on the way."""
    out, lo, n = [], 0, len(data)
    while lo < n:
        hi = min(n, lo + PIECE)
        if hi < n and WORD[data[hi - 1]] and WORD[data[hi]]:
            gaps = np.flatnonzero(~WORD[data[lo:hi]])
            if not len(gaps):
                total, at, step = 0, lo, 1
                while at < n and WORD[data[at]]:
                    some = data[at : at + PIECE]
                    gaps = np.flatnonzero(~WORD[some])
                    some = some[: gaps[0]] if len(gaps) else some
                    total += int((BYTE[some] * powers(STEP, len(some))).sum(dtype=U64)) * step
                    step = step * pow(STEP, len(some), 1 << 64) % (1 << 64)
                    at += len(some)
                out.append(mix(np.array([(total + at - lo) % (1 << 64)], U64)))
                lo = at
                continue
            hi = lo + int(gaps[-1]) + 1
        some = data[lo:hi]
        out.append(span_hashes(BYTE[some], *edges_between(WORD[some], np.array([0, len(some)]))))
        lo = hi
    return np.concatenate(out) if out else np.zeros(0, U64)


def shingle_sets(data: np.ndarray, offs: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles of width words, case of A-Z aside."""
    if len(offs) == 2 and len(data) > PIECE:
        words = word_hashes(data)
        at = np.array([0, len(words)])
    else:
        begins, ends = edges_between(WORD[data], offs)
        words = span_hashes(BYTE[data], begins, ends)
        at = np.searchsorted(begins, offs)
    n = len(words) - width + 1
    wide = np.zeros(max(n, 0), U64)
    for k in range(width) if n > 0 else ():
        wide += words[k : k + n] * PLACE[k]
    wide = mix(wide)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(wide[a : b - width + 1]))
        elif b > a:
            out.append(mix(np.array([(words[a:b] * PLACE[: b - a]).sum(dtype=U64)]) + U64(b - a)))
        else:
            out.append(np.zeros(0, U64))
    return out


def least(n, percent: int):
    """Shared shingles that a set of n needs at least."""
    return (percent * n + 99) // 100


def spare(n, percent: int):
    """l(n): shared ones asked for among the leading hashes."""
    return ((100 - percent) * 3 * n + 499) // 500


def needed(n, percent: int):
    return spare(least(n, percent), percent)


def key_of(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def bitmap_size(n: int) -> int:
    """Bits for a set of n shingles: the same within a band, two a shingle at least, and one size for neighbours in
    most cases."""
    return max(BITS, 1 << int(2 * n).bit_length())


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """A bitmap of words as one of size words: parities of the joined cells."""
    return np.bitwise_xor.reduce(bits.reshape(-1, size), axis=0)


def bitmap(found: np.ndarray, size: int) -> np.ndarray:
    bits = np.bincount((found >> U64(7)).astype(np.int64) & (size - 1), minlength=size) & 1
    return np.packbits(bits.astype(bool), bitorder="little").view(np.int64)


REACH = "kind int, rng int, flush long, idx int, doc_id long, tag long, key binary, n int, cnt int, fps binary, ids binary"
REACHED = "kind int, flush long, idx int, doc_id long, tag long, key binary, n int, cnt int, fps binary, ids binary"


def _reach(parts: int, percent: int, width: int):
    """Rows of kind 0 for documents and of kind 1 for packed leading hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("kind", pa.int32()), ("rng", pa.int32()), ("flush", pa.int64()), ("idx", pa.int32()), ("doc_id", pa.int64()), ("tag", pa.int64()), ("key", pa.binary()), ("n", pa.int32()), ("cnt", pa.int32()), ("fps", pa.binary()), ("ids", pa.binary())])
        task, flushes = TaskContext.get().partitionId(), 0
        docs: list[tuple] = []
        sets: dict[bytes, int] = {}
        lead: list[np.ndarray] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, flushes
            number = task << 24 | flushes
            flushes += 1
            count = np.zeros(len(lead), np.int64)
            rng_of, fps, ids = [], [], []
            if held:
                every = np.concatenate(lead)
                owner = np.repeat(np.arange(len(lead)), [len(x) for x in lead])
                order = np.argsort(every)
                every, owner = every[order], owner[order]
                first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
                size = np.diff(np.append(first, len(every)))
                count = np.bincount(owner[np.repeat(size > 1, size)], minlength=len(lead))
                mark = np.where(size > 1, SHARED, owner[first]).astype(np.uint16)
                every = every[first]
                rng = ((every >> U64(32)) * U64(parts)) >> U64(32)
                low = every.astype(np.uint32)
                bounds = np.searchsorted(rng, np.arange(parts + 1, dtype=U64))
                for r in np.flatnonzero(np.diff(bounds)).tolist():
                    rng_of.append(r)
                    fps.append(low[bounds[r] : bounds[r + 1]].tobytes())
                    ids.append(mark[bounds[r] : bounds[r + 1]].tobytes())
            nd, nb = len(docs), len(rng_of)
            for lo in range(0, nd, 20_000):
                some = docs[lo : lo + 20_000]
                idx = [x[1] for x in some]
                yield pa.RecordBatch.from_arrays([pa.array([0] * len(some), pa.int32()), pa.array([(number * 31 + lo + i) % parts for i in range(len(some))], pa.int32()), pa.array([number] * len(some), pa.int64()), pa.array(idx, pa.int32()), pa.array([x[0] for x in some], pa.int64()), pa.array([x[4] for x in some], pa.int64()), pa.array([x[2] for x in some], pa.binary()), pa.array([x[3] for x in some], pa.int32()), pa.array([int(count[i]) if i >= 0 else 0 for i in idx], pa.int32()), pa.nulls(len(some), pa.binary()), pa.nulls(len(some), pa.binary())], schema=schema)
            if nb:
                no = pa.nulls(nb, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([1] * nb, pa.int32()), pa.array(rng_of, pa.int32()), pa.array([number] * nb, pa.int64()), no, pa.nulls(nb, pa.int64()), pa.nulls(nb, pa.int64()), pa.nulls(nb, pa.binary()), no, no, pa.array(fps, pa.binary()), pa.array(ids, pa.binary())], schema=schema)
            docs.clear(), sets.clear(), lead.clear()
            held = 0

        for batch in batches:
            doc_ids, tags = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi, data, offs in slices(batch.column(2)):
                for doc_id, tag, found in zip(doc_ids[lo:hi], tags[lo:hi], shingle_sets(data, offs, width)):
                    n = len(found)
                    if not n:
                        docs.append((doc_id, -1, None, 0, tag))
                        continue
                    key = key_of(found)
                    idx = sets.get(key)
                    if idx is None:
                        idx = sets[key] = len(lead)
                        lead.append(found[: n - least(n, percent) + spare(n, percent)].copy())
                        held += len(lead[-1])
                    docs.append((doc_id, idx, key, n, tag))
                if held >= FLUSH_POSTINGS or len(sets) >= FLUSH_SETS or len(docs) >= 200_000:
                    yield from flush()
        yield from flush()

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passes documents on and counts, for each set, its fingerprints that other sets have as well: a row for each flush,
    with the sets' numbers in fps and the counts in ids."""
    schema = pa.schema([("kind", pa.int32()), ("flush", pa.int64()), ("idx", pa.int32()), ("doc_id", pa.int64()), ("tag", pa.int64()), ("key", pa.binary()), ("n", pa.int32()), ("cnt", pa.int32()), ("fps", pa.binary()), ("ids", pa.binary())])
    keys, owners, flushes = [], [], {}
    for batch in batches:
        kind = batch.column(0).to_numpy()
        t = pa.Table.from_batches([batch])
        if (kind == 0).any():
            yield from t.filter(pa.array(kind == 0)).select(schema.names).cast(schema).to_batches()
        t = t.filter(pa.array(kind == 1))
        for rng, flush, fps, ids in zip(*(t[c].to_pylist() for c in ("rng", "flush", "fps", "ids"))):
            fps = np.frombuffer(fps, np.uint32)
            keys.append(fps.astype(U64) | U64(rng << 32))
            owners.append(np.frombuffer(ids, np.uint16).astype(np.int64) | flushes.setdefault(flush, len(flushes)) << 16)
    if not keys:
        return
    key, owner = np.concatenate(keys), np.concatenate(owners)
    del keys, owners
    order = np.argsort(key)
    key, owner = key[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(first, len(key)))
    owner = owner[np.repeat(size > 1, size)]
    owner, count = np.unique(owner[owner & SHARED != SHARED], return_counts=True)
    at = np.searchsorted(owner >> 16, np.arange(len(flushes) + 1))
    for k, number in enumerate(flushes):
        some, n = owner[at[k] : at[k + 1]], count[at[k] : at[k + 1]]
        if len(some):
            row = [[1], [number], None, None, None, None, None, None, [(some & SHARED).astype(np.uint16).tobytes()], [n.astype(np.int32).tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.nulls(1, f.type) if v is None else pa.array(v, f.type) for v, f in zip(row, schema)], schema=schema)


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, tag, key, n, cnt): the documents of whole flushes, with their sets' counts added up."""
    docs, more = [], {}
    for batch in batches:
        t = pa.Table.from_batches([batch])
        kind = t["kind"].to_numpy()
        docs.append(t.filter(pa.array(kind == 0)))
        t = t.filter(pa.array(kind == 1))
        for flush, fps, ids in zip(*(t[c].to_pylist() for c in ("flush", "fps", "ids"))):
            np.add.at(more.setdefault(flush, np.zeros(SHARED + 1, np.int32)), np.frombuffer(fps, np.uint16), np.frombuffer(ids, np.int32))
    for t in docs:
        if t.num_rows:
            flush, idx = t["flush"].to_numpy(), t["idx"].to_numpy()
            extra = np.zeros(len(idx), np.int32)
            for f in np.unique(flush).tolist():
                if f in more:
                    mine = (flush == f) & (idx >= 0)
                    extra[mine] = more[f][idx[mine]]
            t = t.set_column(t.schema.get_field_index("cnt"), "cnt", pa.array(t["cnt"].to_numpy() + extra))
            yield from t.select(["doc_id", "tag", "key", "n", "cnt"]).to_batches()


def _sets(width: int):
    """(key, text) -> the set itself, where the text has that key; once for a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[bytes] = set()
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for lo, hi, data, offs in slices(batch.column(1)):
                rows = []
                for k, x in zip(keys[lo:hi], shingle_sets(data, offs, width)):
                    if k not in done and key_of(x) == k:
                        done.add(k)
                        rows.append((k, x))
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.binary()), pa.array([len(x) for _, x in rows], pa.int32()), pa.array([bitmap(x, BITS) for _, x in rows], pa.list_(pa.int64())), pa.array([bitmap(x, bitmap_size(len(x))) for _, x in rows], pa.list_(pa.int64())), pa.array([x.view(np.int64) for _, x in rows], pa.list_(pa.int64()))], names=["key", "n", "bits", "wide", "arr"])

    return run


def _cells(log: int):
    """How many sets of a task have a shingle in each cell: (block, cells of it, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(1 << log, np.uint32), [], 0
        for batch in batches:
            some = np.asarray(batch.column(0).flatten()).view(U64) >> U64(64 - log)
            held.append(some.astype(np.uint32))
            size += len(some)
            if size > 1 << log:
                total += np.bincount(np.concatenate(held), minlength=1 << log).astype(np.uint32)
                held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=1 << log).astype(np.uint32)
        for lo in range(0, 1 << log, CELL_BLOCK):
            at = np.flatnonzero(total[lo : lo + CELL_BLOCK])
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([lo // CELL_BLOCK], pa.int32()), pa.array([at.astype(np.uint16).tobytes()]), pa.array([np.minimum(total[lo + at], 65_535).astype(np.uint16).tobytes()])], names=["block", "cells", "counts"])

    return run


def _sum_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of each block, as bytes that grow with their logarithms."""
    blocks: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, cells, counts in zip(*(batch.column(k).to_pylist() for k in range(3))):
            blocks.setdefault(block, np.zeros(CELL_BLOCK, np.int64))[np.frombuffer(cells, np.uint16)] += np.frombuffer(counts, np.uint16)
    for block, total in blocks.items():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.minimum(6 * np.log2(1.0 + total), 255).astype(np.uint8).tobytes()])], names=["block", "bytes"])


def commonness(sets: DataFrame, total: int) -> np.ndarray:
    """For each cell of shingles how common they are: at most 2 ** CELLS bytes, whatever the input. total: shingles."""
    log = min(CELLS, max(16, (total // 4).bit_length()))
    part = arrow_map(sets.select("arr"), _cells(log), "block int, cells binary, counts binary")
    rows = arrow_map(part.repartition(max(1, (1 << log) // CELL_BLOCK), "block"), _sum_cells, "block int, bytes binary").collect()
    out = np.zeros(1 << log, np.uint8)
    for r in rows:
        out[r.block * CELL_BLOCK : (r.block + 1) * CELL_BLOCK] = np.frombuffer(r.bytes, np.uint8)
    return out


def _lead(common, percent: int):
    """(id, n, arr) -> (id, n, weight, lead): the first shingles in the order of commonness, and how common all are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = common.value
        shift = U64(65 - len(table).bit_length())
        for batch in batches:
            arrs, lead, weight = batch.column(2), [], []
            flat = np.asarray(arrs.flatten()).view(U64)
            at = np.concatenate(([0], np.cumsum(np.asarray(arrs.value_lengths())))) if batch.num_rows else np.zeros(1, np.int64)
            rank = table[flat >> shift]
            for i in range(batch.num_rows):
                own, r = flat[at[i] : at[i + 1]], rank[at[i] : at[i + 1]]
                n = len(own)
                some = own[np.argsort(r, kind="stable")[: n - least(n, percent) + 1]]  # own is sorted by hash
                lead.append(some.view(np.int64))
                weight.append(float(r.mean()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(weight, pa.float64()), pa.array(lead, pa.list_(pa.int64()))], names=["id", "n", "weight", "lead"])

    return run


def _settle(percent: int):
    """Keeps the pairs (a, b) that are links: bitmap bound, then exact intersection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = {c: batch.column(c) for c in batch.schema.names}
            flat = {c: np.asarray(cols[c].flatten()).view(U64) for c in ("wide_a", "wide_b", "arr_a", "arr_b")}
            at = {c: np.concatenate(([0], np.cumsum(np.asarray(cols[c].value_lengths())))) for c in flat}
            keep = []
            for i in range(batch.num_rows):
                p, q, x, y = (flat[c][at[c][i] : at[c][i + 1]] for c in flat)
                total, size = len(x) + len(y), min(len(p), len(q))
                apart = int(np.bitwise_count(folded(p, size) ^ folded(q, size)).sum())
                if (100 + percent) * (total - apart) < 2 * percent * total:
                    continue
                if len(x) > len(y):
                    x, y = y, x
                place = np.searchsorted(y, x)
                place[place == len(y)] = 0
                both = int((y[place] == x).sum())
                if 100 * both >= percent * (total - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([cols[c].take(pa.array(keep, pa.int64())) for c in ("a", "b")], names=["a", "b"])

    return run


def with_set(pairs: DataFrame, sets: DataFrame, side: str, other: str, cols: list[str]) -> DataFrame:
    """pairs with the columns cols of the set of its column side, as cols_side.

    Pairs with a set that has more than BLOCK of them are dealt by salts, as many as blocks, and meet copies of it:
    there are at most as many copies as a BLOCK-th of the pairs."""
    found = sets.select(F.col("id").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in cols))
    hot = cut(pairs.groupBy(side).agg(F.count("*").alias("size")).where(F.col("size") > BLOCK).select(side, F.ceil(F.col("size") / BLOCK).cast("int").alias("salts")))
    if hot.isEmpty():
        return pairs.join(found, side)
    known = pairs.join(hot, side, "left")
    cold = known.where("salts is null").drop("salts").join(found, side)
    spread = found.join(hot, side).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    warm = known.where("salts is not null").withColumn("salt", F.pmod(F.xxhash64(other), "salts").cast("int")).drop("salts")
    return cold.unionByName(warm.join(spread, [side, "salt"]).drop("salt"))


def settle(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) that are links. pairs was cut: it is read several times."""
    full = with_set(with_set(pairs, sets, "a", "b", ["wide", "arr"]), sets, "b", "a", ["wide", "arr"])
    return arrow_map(full, _settle(percent), "a long, b long")


def _possible(apart: Column, total: Column, percent: int) -> Column:
    """The bitmap bound: whether sets of total size may overlap enough if that many bits differ."""
    return (total - apart) * (100 + percent) >= total * (2 * percent)


def _overlap_possible(percent: int) -> Column:
    """Size ratio, what the places leave, and bitmap bound, for the sides x and y of a join. Of two sets' common
    shingles the first in order leaves the most room, so a pair that is none here at a later one is one at that."""
    apart = sum((F.bit_count(F.col(f"x.w{i}").bitwiseXOR(F.col(f"y.w{i}"))) for i in range(BITS // 64)), F.lit(0))
    total = F.col("x.n") + F.col("y.n")
    ratio = F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent
    room = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos")) * (100 + percent) >= total * percent
    return ratio & room & _possible(apart, total, percent)


def _halved(bits: Column, other: Column) -> Column:
    """bits folded to the length of other, where that is half as long."""
    half = F.size(other)
    return F.when(F.size(bits) > half, F.zip_with(F.slice(bits, 1, half), F.slice(bits, half + 1, half), lambda p, q: p.bitwiseXOR(q))).otherwise(bits)


def _classes(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, tag, key, n, cnt) of docs, tag being a hash of the text and key the set's, and (key, rep, top):
    each key's first row and that of its component, as (id is null, id, tag)."""
    spark = docs.sparkSession
    parts = shuffle_parts(spark)
    slim = texts_of(docs, F.col(id_col).cast("long").alias("doc_id"), text_col=text_col)
    slim = slim.select("doc_id", F.xxhash64("text").alias("tag"), "text")
    met = arrow_map(slim, _reach(parts, percent, width), REACH).repartition(parts, "rng")
    met = arrow_map(met, _count, REACHED).repartition(parts, "flush")
    rows = cut(arrow_map(met, _total, "doc_id long, tag long, key binary, n int, cnt int"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")).alias("rep")
    classes = cut(rows.where("n > 0").groupBy("key", "n").agg(first, F.max("cnt").alias("cnt")))
    lowest = F.expr(f"int((300 - 3 * {percent}) * int(({percent} * n + 99) div 100) + 499) div 500")
    alive = classes.where(F.col("cnt") >= lowest)
    total = alive.agg(F.sum("n")).first()[0] or 0
    same = slim["doc_id"].eqNullSafe(F.col("r.doc_id")) & (slim["tag"] == F.col("r.tag"))
    sets = slim.join(alive.select("key", F.col("rep").alias("r")), same).select("key", "text")
    sets = arrow_map(sets, _sets(width), "key binary, n int, bits array<bigint>, wide array<bigint>, arr array<bigint>")
    sets = cut(sets.withColumn("id", F.monotonically_increasing_id()), by="id")
    roots = _components(sets, total, percent)

    final = sets.select("id", "key").join(roots, "id").select("key", F.col("root").cast("string").alias("root")).distinct()
    final = classes.select("key", "rep").join(final, "key", "left").withColumn("root", F.coalesce("root", F.hex("key")))
    low = final.groupBy("root").agg(F.min("rep").alias("top"))
    return rows, final.join(dealt_anew(low, "root"), "root").select("key", "rep", "top")


def _components(sets: DataFrame, total: int, percent: int) -> DataFrame:
    """(id, root) for every set."""
    common = sets.sparkSession.sparkContext.broadcast(commonness(sets, total))
    lead = cut(arrow_map(sets.select("id", "n", "arr"), _lead(common, percent), "id long, n int, weight double, lead array<bigint>"), by="id")
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent)) + 1e-9).cast("int")

    t = lead.select("id", "weight", F.explode("lead").alias("sh"))
    # the sets whose shingles are most common lead: an original links with its edited copies, these less with each other
    heads = t.groupBy("sh").agg(F.max(F.struct("weight", "id")).alias("m"), F.count("*").alias("size")).where("size > 1").select("sh", F.col("m.id").alias("head"))
    near = t.join(heads, "sh").where("id <> head").groupBy("id", "head").agg(F.count("*").alias("size"))
    near = cut(near.groupBy("id").agg(F.max_by("head", F.struct("size", "head")).alias("head")).select(F.col("id").alias("a"), F.col("head").alias("b")))
    links = settle(near, sets, percent)
    comps = cut(graphs.components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))))

    known = sets.join(comps.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    t = lead.join(comps.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id")).select("id", "n", "root", F.posexplode("lead").alias("pos", "sh"))
    small = F.col("pos") <= F.col("n") - F.expr(f"int(({2 * percent} * n + {99 + percent}) div {100 + percent})")
    mixed = t.groupBy("sh").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size"), F.max(small).alias("small")).where("lo <> hi and small")
    t = cut(t.withColumn("small", small).join(mixed.select("sh", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "sh"))
    t = t.join(sets.select("id", *(F.get("bits", F.lit(i)).alias(f"w{i}") for i in range(BITS // 64))), "id")
    t = t.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    # the smaller set of a pair, x, stands in the tiles of its own band, the larger in those and the ones below
    x = t.where("small").withColumn("y_block", every).withColumnRenamed("block", "x_block").withColumn("band", band).alias("x")
    y = t.withColumn("x_block", every).withColumnRenamed("block", "y_block").withColumn("band", F.explode(F.array(band, band - 1))).alias("y")
    on = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("sh", "band", "x_block", "y_block")]
    on += [F.struct("x.n", "x.id") < F.struct("y.n", "y.id"), F.col("x.root") != F.col("y.root"), _overlap_possible(percent)]
    left = cut(x.join(y, on).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct())
    for s, o in ("ab", "ba"):
        left = with_set(left, known, s, o, ["n", "wide", "root"])
    apart = F.aggregate(F.zip_with(_halved(F.col("wide_a"), F.col("wide_b")), _halved(F.col("wide_b"), F.col("wide_a")), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda p, q: p + q)
    left = left.select("a", "b", F.col("root_a").alias("ra"), F.col("root_b").alias("rb"), apart.alias("apart"), (F.col("n_a") + F.col("n_b")).alias("total"))
    left = cut(left.where(_possible(F.col("apart"), F.col("total"), percent)).select("a", "b", "ra", "rb", (F.col("apart") / F.col("total")).alias("d")))
    roots = known.select("id", "root")
    for last in (False, True):
        # first the closest pair of each component, as often that joins it; in the end all that is left
        tried = left.select("a", "b", "ra", "rb")
        if not last:
            ends = F.explode(F.array("ra", "rb")).alias("r")
            tried = left.select(ends, "d", "a", "b", "ra", "rb").groupBy("r").agg(F.min(F.struct("d", "a", "b", "ra", "rb")).alias("p")).select("p.a", "p.b", "p.ra", "p.rb").distinct()
            tried = cut(tried)
        hits = settle(tried.select("a", "b"), sets, percent)
        moved = graphs.components(hits.join(tried, ["a", "b"]).select(F.col("ra").alias("u"), F.col("rb").alias("v")))
        moved = cut(moved.select(F.col("node").alias("root"), F.col("root").alias("top")))
        now = lambda df, c: df.join(moved.select(F.col("root").alias(c), "top"), c, "left").withColumn(c, F.coalesce("top", c)).drop("top")
        roots = now(roots, "root")
        if not last:
            left = cut(now(now(left.join(tried.select("a", "b"), ["a", "b"], "left_anti"), "ra"), "rb").where("ra <> rb"))
    return roots


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs, with the id under its own name.

    Sets: distinct shingles of width words (`[^\\x20\\x09-\\x0D]+`, A-Z lower-cased); fewer words make one shingle; no
    words or a null text make an empty set, linked with nothing. Links: 100 |x & y| >= percent |x | y|. A component is
    named by its smallest id. Repeated rows and repeated ids are rows of their own, in one component if their sets
    are equal; a null id never names a component unless it stands alone. Further columns are ignored."""
    rows, found = _classes(docs, id_col, text_col, width, percent)
    full = rows.where("n > 0").join(found, "key").select("doc_id", "n", F.col("top.doc_id").alias("component_id"))
    bare = rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return full.union(bare).select(F.col("doc_id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.col("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """The rows of docs that stay when one row of each component stays: that with the smallest id, nulls last.

    The verdict is on rows, by id and text: of rows with one id, those of other components stay; of rows that agree in
    id and text one stays. Rows without words stay. All columns stay as they are."""
    rows, found = _classes(docs, id_col, text_col, width, percent)
    mine = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")
    judged = rows.where("n > 0").join(found, "key").select("doc_id", "tag", (mine == F.col("top")).alias("stays"))
    judged = judged.groupBy("doc_id", "tag").agg(F.max("stays").alias("stays"), F.count("*").alias("copies"))
    judged = cut(judged.where("copies > 1 or not stays"))
    marked = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("own"))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("own") == F.col("tag"))
    single = marked.join(judged, same, "left_anti").select("row.*")
    twice = judged.where("stays")
    if twice.isEmpty():
        return single
    return single.unionByName(marked.join(twice, same, "left_semi").dropDuplicates(["id", "own"]).select("row.*"))
