"""Token counts by a compiled finite-state tokenizer.

The byte-level tokenizer is compiled into two deterministic machines. The first splits a text into pre-tokens; whether
one begins at a character depends on its neighbours alone, so the machine's flags come from one pass over character
classes. The second reads a pre-token's bytes; its transitions carry the change of the emitted-token count (see
bpe.Automaton), and a flag puts it back to its start.

Texts are dealt in chunks. A chunk's map sends the state before it to the state after it and the tokens counted. From
the first flag in the chunk on, this no longer depends on the state before: all chunks run that part side by side, and
the map of a chunk with a flag sends all states to one. The maps of the parts before the flags, and of chunks without
any, are tabled: at first where the chunk before leaves off, and for a chunk without a flag also at the start state, as
if a pre-token began with it; then at every state that an entry of the table before leads to, until the tables are
closed. As the machine soon forgets where it began, that takes few rounds, in each of which all chunks run side by
side. The tables then compose in a parallel prefix scan: each entry is joined with the one it leads to, and in every
round the stretches that entries stand for double."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from ._common import DIGIT, GAP, LETTER, OTHER, arrow_map, char_classes, slices, texts_of

#: Bytes of a chunk, and bytes that run at once.
CHUNK, PIECE = 96, 1 << 19


def pre_token_begins(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Flags of the bytes at which a pre-token begins, for
    `'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`."""
    flags = np.zeros(len(data), bool)
    if not len(data):
        return flags
    lead = (data & 0xC0) != 0x80
    place = np.flatnonzero(lead)
    code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(code)
    kind = char_classes()[code]
    first = np.zeros(n + 1, bool)  # first character of a text
    char_no = np.cumsum(lead) - 1
    full = offs[:-1] < offs[1:]
    first[char_no[offs[:-1][full]]] = True
    first[n] = True
    gap = kind >= GAP
    prev_gap, prev_kind = np.concatenate(([False], gap[:-1])), np.concatenate(([OTHER], kind[:-1]))
    next_gap = np.concatenate((gap[1:], [True]))
    last = first[1:]
    start = first[:n].copy()
    head = first[:n]
    start |= gap & ~prev_gap
    start |= gap & ~next_gap & ~last  # the last of a white run before a word stands alone or leads the word
    start |= ~gap & prev_gap & (prev_kind == GAP)
    start |= ~gap & ~prev_gap & (kind != prev_kind)
    quote = code == 39
    if quote.any():
        at = np.flatnonzero(quote & (head | (prev_kind == LETTER) | (prev_kind == DIGIT) | (prev_kind == GAP)))
        pad = np.concatenate((np.where(first[:n], 0, code), [0, 0, 0]))  # no look beyond the text's end
        one, two = pad[at + 1], pad[at + 2]
        pair = lambda s: (one == ord(s[0])) & (two == ord(s[1]))
        is_one = np.isin(one, [ord(c) for c in "stmd"])
        is_two = ~is_one & (pair("re") | pair("ve") | pair("ll"))
        for k, which in ((2, is_one), (3, is_two)):
            q = at[which]
            start[q + 1] = False
            if k == 3:
                start[q + 2] = False
            start[q[q + k < n] + k] = True
    flags[place[start]] = True
    return flags


class Counter:
    def __init__(self, path: str):
        merges, self.added = bpe.byte_level(path)
        self.machine = bpe.Automaton(merges)
        self.special = regex.compile(b"|".join(regex.escape(s.encode()) for s in sorted(self.added, key=len, reverse=True))) if self.added else None

    def _run(self, data, flags, begin, length, state):
        """Lanes of bytes [begin, begin + length) from the given states: states after them and token counts."""
        order = np.argsort(-length, kind="stable")
        begin, state = begin[order], state[order].copy()
        count = np.zeros(len(order), np.int64)
        alive = len(order) - np.searchsorted(np.sort(length), np.arange(int(length.max(initial=0))), "right")
        for j, k in enumerate(alive.tolist()):
            at = begin[:k] + j
            now = np.where(flags[at], 0, state[:k])
            state[:k], change = self.machine.advance(now, data[at].astype(np.int64))
            count[:k] += change
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return state[back], count[back]

    def count(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Tokens of each text."""
        rows, extra = np.arange(len(offs) - 1), np.zeros(len(offs) - 1, np.int64)
        if self.special is not None and (found := [m.span() for m in self.special.finditer(data.tobytes())]):
            inner = offs[1:-1]
            found = [(a, b) for a, b in found if not ((inner > a) & (inner < b)).any()]
            cuts = np.array(sorted(x for s in found for x in s), np.int64)
            owner = np.searchsorted(offs, [a for a, _ in found], "right") - 1
            np.add.at(extra, owner, 1)
            keep = np.ones(len(data), bool)
            for a, b in found:
                keep[a:b] = False
            shift = np.concatenate(([0], np.cumsum(keep)))
            every = np.sort(np.concatenate((offs, cuts)))
            rows = np.clip(np.searchsorted(offs, every[:-1], "right") - 1, 0, len(rows) - 1)
            data, offs = data[keep], shift[every]
        total = np.zeros(len(extra), np.int64)
        full = offs[:-1] < offs[1:]
        begin, end, rows = offs[:-1][full], offs[1:][full], rows[full]
        lo = 0
        while lo < len(begin):
            hi = max(lo + 1, int(np.searchsorted(end, begin[lo] + PIECE, "right")))
            some, first, last = data[begin[lo] : end[hi - 1]], begin[lo:hi] - begin[lo], end[lo:hi] - begin[lo]
            if hi == lo + 1 and len(some) > PIECE:
                for piece, flags in self._pieces(some):
                    total[rows[lo]] += self._count(piece, flags, np.array([0]), np.array([len(piece)]))[0]
            else:
                np.add.at(total, rows[lo:hi], self._count(some, pre_token_begins(some, np.append(first, last[-1])), first, last))
            lo = hi
        return total + extra

    @staticmethod
    def _pieces(data: np.ndarray):
        """One text in pieces that end where a pre-token begins, with their flags. Flags depend on a few characters on
        either side; only a pre-token longer than a piece makes a piece longer."""
        flags, n, near = np.zeros(len(data), bool), len(data), 64
        lead = lambda k: next(j for j in range(k, -1, -1) if j == n or data[j] & 0xC0 != 0x80)  # noqa: E731  a character's begin
        for lo in range(0, n, PIECE):
            a, b = lead(max(0, lo - near)), lead(min(n, lo + PIECE + near))
            flags[lo : lo + PIECE] = pre_token_begins(data[a:b], np.array([0, b - a]))[lo - a :][:PIECE]
        marks, at = np.append(np.flatnonzero(flags), n), 0
        while at < n:
            k = max(int(np.searchsorted(marks, at + PIECE, "right")) - 1, int(np.searchsorted(marks, at, "right")))
            yield data[at : marks[k]], flags[at : marks[k]]
            at = int(marks[k])

    def _count(self, data, flags, begin, end):
        """Tokens of each of the texts [begin, end), which begin with a flag."""
        if self.machine.full():
            self.machine.clear()
        chunks = (end - begin + CHUNK - 1) // CHUNK
        owner = np.repeat(np.arange(len(begin)), chunks)
        at = begin[owner] + CHUNK * (np.arange(len(owner)) - np.repeat(np.cumsum(chunks) - chunks, chunks))
        to = np.minimum(at + CHUNK, end[owner])
        marks = np.flatnonzero(flags)
        flag = np.minimum(np.append(marks, len(data))[np.searchsorted(marks, at)], to)  # the first, or the chunk's end
        leave, count = self._run(data, flags, flag, to - flag, np.zeros(len(at), np.int64))
        total = np.bincount(owner, weights=count, minlength=len(begin)).astype(np.int64)
        needs, is_open = flag > at, flag == to
        ahead = np.append(needs[1:], False)  # only chunks of the same text have bytes before their first flag
        known = np.flatnonzero(~is_open & ahead)
        start = known + 1 << 32 | leave[known]
        new = np.unique(np.concatenate((start, np.flatnonzero(is_open & ahead) << 32)))
        keys, links, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        every = keys[0]
        while len(new):  # a key is a chunk and a state before it, its link the key after it
            chunk = new >> 32
            out, more = self._run(data, flags, at[chunk], flag[chunk] - at[chunk], new & 0xFFFFFFFF)
            onward = is_open[chunk] & ahead[chunk]
            link = np.where(onward, chunk + 1 << 32 | out, -1)
            keys.append(new), links.append(link), counts.append(more)
            every = np.sort(np.concatenate((every, new)))
            new = np.setdiff1d(link[onward], every)
        order = np.argsort(np.concatenate(keys))
        link, counts = np.concatenate(links)[order], np.concatenate(counts)[order]
        link = np.where(link < 0, len(every), np.searchsorted(every, link))
        link, counts = np.append(link, len(every)), np.append(counts, 0)
        while (link < len(every)).any():
            counts, link = counts + counts[link], link[link]
        np.add.at(total, owner[known], counts[np.searchsorted(every, start)])
        return total


@lru_cache(4)
def counter(path: str) -> Counter:
    return Counter(path)


def _count_batches(path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            tokens, size = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, _, data, offs in slices(batch.column(1), 1 << 21):
                tokens.append(c.count(data, offs))
                size.append(np.diff(offs))
            tokens, size = np.concatenate(tokens), np.concatenate(size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(tokens), pa.array(tokens > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of docs, the id under its own name.

    path: a tokenizers file with a byte-level BPE model. Counts are those of the library without added special tokens;
    a special token's own string in a text is one token, as is the library's default. Null and empty texts have none.
    Rows are independent: repeated rows, null ids and further columns change nothing."""
    slim = texts_of(docs, F.col(id_col).cast("long").alias("doc_id"), text_col=text_col)
    out = arrow_map(slim, _count_batches(path, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("doc_id", id_col)
