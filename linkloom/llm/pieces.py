"""SentencePiece encoding and decoding with a Viterbi search that shares prefixes.

A normalised text falls into marked words (white space marks, then other characters): no piece reaches across their
bounds. The distinct words of a batch are sorted, which is the order of a depth-first walk of their trie: the forward
cells of a prefix serve all words that begin with it. For a unigram model a cell holds the best sum of scores; for a
BPE model, where merges rather than sums decide, it holds the one piece that ends the prefix's encoding (see bpe).
Words are then encoded by walking the cells back.

Words of a BPE model that aren't very long go through their trie level by level, all new prefixes of a length at once;
the others go one by one, with a stack of cells. A word's ids are packed once, and a text's ids are its words' joined."""

from __future__ import annotations

import codecs
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from ._common import arrow_map, slices, texts_of

MARK = "▁"
WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
MOST_WORDS = 400_000
#: Words that go through their trie level by level at once, and the most characters of one.
LANES, LEVELS = 1 << 16, 64
#: What an unknown piece is shown as.
UNKNOWN = " \u2047 "
codecs.register_error("each_byte", lambda e: ("\ufffd", e.start + 1))


def common(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


class Codec:
    """kind: 'bpe' or 'unigram'. pieces: string -> (id, score). byte_ids: 256 ids, if characters may fall back."""

    #: Ids without a text, and how many of the pieces that a text begins with lose a mark: none, one, all that are one.
    control: frozenset[int] = frozenset()
    strips = 1

    def __init__(self, kind: str, pieces: dict[str, tuple[int, float]], unk: int, byte_ids: list[int] | None, texts: list[str] | None = None):
        self.kind, self.pieces, self.unk, self.byte_ids = kind, pieces, unk, byte_ids
        self.begins = {p[:k] for p in pieces for k in range(1, len(p) + 1)}
        self.score = dict(pieces.values())
        self.met: dict[str, tuple[str, list[tuple[int, int]]]] = {}
        self.whole = any(MARK in p.lstrip(MARK) for p in pieces)  # then words may not be parted
        self.texts = texts
        self.byte_of = {i: b for b, i in enumerate(byte_ids or [])}
        worst = min((s for _, s in pieces.values()), default=0.0)
        self.unk_score = worst - 10.0
        if kind == "bpe":
            entries = {p: i for p, (i, _) in pieces.items()}
            rank = {}
            for p, (i, score) in pieces.items():
                for k in range(1, len(p)):
                    if p[:k] in entries and p[k:] in entries:
                        rank[entries[p[:k]], entries[p[k:]]] = (-score, i)
            self.merges = bpe.Merges(entries, rank)
            self._number_ends()
        self.raw = [bytes([self.byte_of[i]]) if i in self.byte_of else t.encode() for i, t in enumerate(texts or [])]
        self.size = np.array([len(x) for x in self.raw], np.int64)
        self.known: dict[str, array] = {}  # ids of words, 32 bits each
        self.lossy: set[str] = set()  # those of them that decoding doesn't give back

    def fallback(self, c: str) -> tuple[int, ...]:
        return tuple(self.byte_ids[b] for b in c.encode()) if self.byte_ids else (self.unk,)

    def words(self, normal: str) -> list[str]:
        if self.whole and normal:
            return [normal]
        if MARK + MARK in normal or "\0" in normal:
            return WORDS.findall(normal)
        out = normal.replace(MARK, "\0" + MARK).split("\0")  # quicker where each word has one mark
        return out if out[0] else out[1:]

    def learn(self, words: set[str]) -> None:
        """Encodes words, in sorted order."""
        if len(self.known) + len(words) > MOST_WORDS:
            self.known.clear()
            self.lossy.clear()
        order = sorted(words)
        if self.kind == "bpe":
            some = [w for w in order if len(w) <= LEVELS]
            for lo in range(0, len(some), LANES):
                self._learn_levels(some[lo : lo + LANES])
            order = [w for w in order if len(w) > LEVELS]
        # a cell: (length of the last piece, its id or None for a fallback, best score, see ends)
        cells: list[tuple] = [(0, bpe.START, 0.0, "")]
        before = ""
        step = self._next_bpe if self.kind == "bpe" else self._next_unigram
        for w in order:
            n = common(w, before)
            del cells[n + 1 :]
            for j in range(n + 1, len(w) + 1):
                cells.append(step(w[j - 1], j, cells))
            before = w
            out, j = [], len(w)
            while j:
                size, piece = cells[j][:2]
                if piece is not None:
                    out.append(piece)
                else:
                    out += self.fallback(w[j - 1])[::-1]
                j -= size
            out.reverse()
            self.known[w] = array("I", out)
            if self.texts and self.joined(out) != w:
                self.lossy.add(w)

    def _number_ends(self) -> None:
        """Numbers what begins a piece, 0 for nothing: top is the longest piece that is an end of it (0: none), below
        the next one, each by its number; long and last are the length and the id of the piece of a number."""
        order = ["", *sorted(self.begins, key=len)]
        self.named, self.number = order, {s: k for k, s in enumerate(order)}
        self.long, self.last = np.array([len(s) for s in order], np.int64), np.array([self.pieces.get(s, (-1,))[0] for s in order], np.int64)
        top, below = [0] * len(order), [0] * len(order)
        for k, s in enumerate(order[1:], 1):
            below[k] = top[self._longest(s[1:])]
            top[k] = k if s in self.pieces else below[k]
        self.top, self.below = np.array(top), np.array(below)
        self.moves = bpe.Table(16)

    def _longest(self, s: str) -> int:
        """The longest end of s that begins a piece."""
        while s not in self.number:
            s = s[1:]
        return self.number[s]

    def _move(self, key: int) -> int:
        return self._longest(self.named[key >> 21] + chr(key & 0x1FFFFF))

    def _learn_levels(self, words: list[str]) -> None:
        """learn of sorted words. Column i of a level is the cell of word i's prefix of that length; the first word with
        a prefix makes its cell, the words that share it take it."""
        if self.moves.filled > 1_000_000:
            self.moves.clear()
        n, size = len(words), np.array([len(w) for w in words], np.int64)
        most = int(size.max())
        chars = np.full((most, n), -1, np.int32)
        begin = np.cumsum(size) - size
        flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        chars[np.arange(len(flat)) - np.repeat(begin, size), np.repeat(np.arange(n), size)] = flat
        piece, step = np.full((most + 1, n), bpe.START, np.int32), np.zeros((most + 1, n), np.int8)
        end, fresh = np.zeros(n, np.int64), np.zeros(n, bool)
        fresh[0] = True
        for j in range(1, most + 1):
            fresh[1:] |= chars[j - 1, 1:] != chars[j - 1, :-1]
            new = np.flatnonzero(fresh & (size >= j))
            to = self.moves.found(end[new] << 21 | chars[j - 1, new], self._move)
            found, back = np.full(len(new), bpe.START, np.int32), np.ones(len(new), np.int8)
            left, at = np.arange(len(new)), self.top[to]
            while len(left := left[(some := at > 0)]):  # from the longest piece on, until one may follow
                at = at[some]
                before = piece[j - self.long[at], new[left]].astype(np.int64)
                fits = self.merges.all_follow(before, self.last[at])
                found[left[fits]], back[left[fits]] = self.last[at[fits]], self.long[at[fits]]
                left, at = left[~fits], self.below[at[~fits]]
            share = np.cumsum(np.bincount(new, minlength=n)) - 1
            piece[j], step[j], end = found[share], back[share], to[share]
        # back from the words' ends
        lane, at, ends, ids, code = np.arange(n), size.copy(), [], [], []
        while len(lane := lane[at[lane] > 0]):
            k = at[lane]
            ends.append(begin[lane] + k)
            ids.append(piece[k, lane])
            code.append(chars[k - 1, lane])
            at[lane] -= step[k, lane]
        ends, ids, code = map(np.concatenate, (ends, ids, code))
        order = np.argsort(ends)
        ends, ids, code = ends[order], ids[order], code[order]
        owner, bare = np.searchsorted(begin, ends) - 1, ids < 0
        if bare.any():
            code = code[bare].tolist()
            made = {c: self.fallback(chr(c)) for c in set(code)}
            filled = [made[c] for c in code]
            width = np.ones(len(ids), np.int64)
            width[bare] = [len(x) for x in filled]
            ids, owner, bare = np.repeat(ids, width), np.repeat(owner, width), np.repeat(bare, width)
            ids[bare] = [i for x in filled for i in x]
        bounds = np.searchsorted(owner, np.arange(n + 1)).tolist()
        packed = array("I", ids.astype(np.uint32).tobytes())
        self.known.update((w, packed[a:b]) for w, a, b in zip(words, bounds, bounds[1:]))
        if self.texts:  # decoded together; ids that give back a word's bytes give back the word
            place = np.append(0, np.cumsum(self.size[packed]))[bounds]
            if not np.array_equal(place, np.append(0, np.cumsum(np.add.reduceat(1 + (flat >= 0x80) + (flat >= 0x800) + (flat >= 0x10000), begin)))) or b"".join(map(self.raw.__getitem__, packed)) != "".join(words).encode():
                self.lossy.update(w for w in words if self.joined(self.known[w]) != w)

    def ends(self, tail: str) -> tuple[str, list[tuple[int, int]]]:
        """Of a prefix that ends with tail: its longest end that begins a piece, and (size, id) of the pieces that are
        its ends, longest first. tail: that longest end before the last character, and this character."""
        got = self.met.get(tail)
        if got is None:
            if len(self.met) > 1_000_000:
                self.met.clear()
            end = tail
            while end and end not in self.begins:
                end = end[1:]
            got = self.met[tail] = end, [(len(end) - k, self.pieces[end[k:]][0]) for k in range(len(end)) if end[k:] in self.pieces]
        return got

    def _next_bpe(self, c: str, j: int, cells: list) -> tuple:
        end, found = self.met.get(cells[-1][3] + c) or self.ends(cells[-1][3] + c)
        for size, piece in found:
            last = cells[j - size][1]
            if self.merges.follows(bpe.START if last is None else last, piece):
                return size, piece, 0.0, end
        return 1, None, 0.0, end

    def _next_unigram(self, c: str, j: int, cells: list) -> tuple:
        end, found = self.ends(cells[-1][3] + c)
        best = (1, None, cells[j - 1][2] + self.unk_score, end)
        for size, piece in reversed(found):
            if (score := cells[j - size][2] + self.score[piece]) > best[2]:
                best = (size, piece, score, end)
        return best

    def packed(self, normal: list[str]) -> Iterator[tuple[bytes, bool]]:
        """Of normalised texts: ids, 32 bits each, and whether decoding is known to give the text back."""
        parted = [self.words(t) for t in normal]
        held = [[*map(self.known.get, ws)] for ws in parted]
        if new := {w for ws, hs in zip(parted, held) for w, h in zip(ws, hs) if h is None}:
            if len(self.known) + len(new) > MOST_WORDS:
                new = set().union(*parted)
            self.learn(new)
            held = [[self.known[w] if h is None else h for w, h in zip(ws, hs)] for ws, hs in zip(parted, held)]
        for ws, hs in zip(parted, held):
            out, same = b"".join(hs), self.lossy.isdisjoint(ws)
            if not self.byte_ids:  # characters without a piece in a row are one unknown piece
                ids = np.frombuffer(out, np.uint32)
                unk = ids == self.unk
                if unk.any():
                    out, same = ids[~(unk & np.append(False, unk[:-1]))].tobytes(), False
            yield out, same

    def encode(self, normal: list[str]) -> list[list[int]]:
        """Ids of normalised texts."""
        return [array("I", x).tolist() for x, _ in self.packed(normal)]

    def joined(self, ids: list[int]) -> str:
        """The normalised text: pieces joined, bytes read as UTF-8."""
        if self.byte_of.keys().isdisjoint(ids):
            return "".join(map(self.texts.__getitem__, ids))
        return "".join(self._parts(ids, self.texts.__getitem__))

    def _parts(self, ids: list[int], text_of) -> Iterator[str]:
        """Texts of ids one by one, stretches of bytes as one; each byte that is no UTF-8 becomes a mark."""
        held = bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                held.append(b)
                continue
            if held:
                yield held.decode("utf-8", "each_byte")
                held.clear()
            yield text_of(i)
        if held:
            yield held.decode("utf-8", "each_byte")

    def decode(self, ids: list[int]) -> str | None:
        """The text as the library gives it: nothing for control ids, a mark for the unknown one, and no mark of white
        space before the text where the model puts one there. None if an id is null or has no piece."""
        if any(i is None or not 0 <= i < len(self.texts) for i in ids):
            return None
        at_begin = self.strips > 0
        out = []
        for t in self._parts(ids, lambda i: "" if i in self.control else UNKNOWN if i == self.unk else self.texts[i]):
            if at_begin and t:
                bare = t.removeprefix(MARK)
                at_begin = self.strips > 1 and not bare
                t = bare
            out.append(t)
        return "".join(out).replace(MARK, " ")


@lru_cache(4)
def load(path: str) -> tuple[sentencepiece.SentencePieceProcessor, Codec]:
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    texts = [sp.id_to_piece(i) for i in range(n)]
    byte_ids = [i for i in range(n) if sp.is_byte(i)]
    pieces = {t: (i, sp.get_score(i)) for i, t in enumerate(texts) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
    # a BPE model's scores are its merges' ranks, negated
    scores = [sp.get_score(i) for i in range(n) if texts[i] in pieces]
    kind = "bpe" if all(float(s).is_integer() and s <= 0 for s in scores) else "unigram"
    codec = Codec(kind, pieces, sp.unk_id(), sorted(byte_ids, key=lambda i: int(texts[i][3:-1], 16)) if len(byte_ids) == 256 else None, texts)
    codec.control = frozenset(i for i in range(n) if sp.is_control(i))
    begins = [i for t, (i, _) in pieces.items() if t[0] == MARK and t.strip(MARK)][:1]
    codec.strips = int(not begins or sp.decode(begins)[:1] != " ")
    if codec.strips and begins and MARK in pieces:
        codec.strips += sp.decode([pieces[MARK][0], *begins])[:1] != " "
    return sp, codec


def _encode(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, codec = load(path)
        for batch in batches:
            for lo, hi, _, _ in slices(batch.column(1), 1 << 22):
                part = batch.slice(lo, hi - lo)
                normal = [sp.normalize(t) for t in part.column(1).to_pylist()]
                ids, same = zip(*codec.packed(normal))
                same = [s or codec.joined(array("I", x)) == t for x, s, t in zip(ids, same, normal)]
                cols = [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(zlib.crc32, ids), pa.int64()), pa.array(same, pa.bool_())]
                names = ["doc_id", "n_pieces", "ids_crc32", "round_trip"]
                if with_ids:
                    cols, names = [*cols, pa.array([array("I", x).tolist() for x in ids], pa.list_(pa.int64()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def encode(docs: DataFrame, path: str, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, round_trip) for every row of docs, with_ids also ids; the id under its own name.

    Ids are those of the library without begin and end. round_trip: decoding gives the normalised text back. Null and
    empty texts have no ids. Rows are independent; null ids, repeats and further columns change nothing."""
    slim = texts_of(docs, F.col(id_col).cast("long").alias("doc_id"), text_col=text_col)
    out = arrow_map(slim, _encode(path, with_ids), "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean" + ", ids array<bigint>" * with_ids)
    return out.withColumnRenamed("doc_id", id_col)


def decode(ids: DataFrame, path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """ids with a column text_col: the text that the library gives for the pieces of ids_col, so that control ids give
    nothing and the unknown one its mark. Null for a null row and for one with a null id or an id out of range; an
    empty row is an empty text. Repeated rows are rows like others, other columns stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, codec = load(path)
        for batch in batches:
            k = batch.schema.get_field_index(ids_col)
            text = [None if x is None else codec.decode(x) for x in batch.column(k).to_pylist()]
            yield batch.append_column(text_col, pa.array(text, pa.string()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ids.schema)
    return arrow_map(ids, run, f"{schema}, `{text_col}` string")
