"""Language identification of spans: script ranges, per-word scores and a Viterbi path.

Training counts character trigrams of words, hashed to a fixed number of buckets, and the scripts of letters, per
language. A word's scripts narrow the candidates to the languages that use them; a candidate's score is the summed
log likelihood of the word's trigrams. The best path over a text's words pays a penalty for each change of language,
so that spans come out whole. A document gets the language with most letters, and their share as its score."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import LETTER, U64, arrow_map, char_classes, edges_between, mix, raw, slices, texts_of

BUCKETS = 1 << 14
UNKNOWN = "und"
#: First code points of script ranges, and the script that begins there.
SCRIPTS = [(0x0, "Latin"), (0x370, "Greek"), (0x400, "Cyrillic"), (0x530, "Armenian"), (0x590, "Hebrew"), (0x600, "Arabic"), (0x700, "Other"), (0x900, "Devanagari"), (0x980, "Indic"), (0xE00, "Thai"), (0xE80, "Other"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"), (0x3040, "Kana"), (0x3130, "Hangul"), (0x31A0, "Other"), (0x3400, "Han"), (0xA4D0, "Other"), (0xA720, "Latin"), (0xA800, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB07, "Other"), (0xFF21, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0xFFDD, "Other"), (0x20000, "Han")]
NAMES = sorted({s for _, s in SCRIPTS})


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its lower case (0: no letter) and its script's number."""
    code = np.arange(0x110000, dtype=np.uint32)
    for x in np.flatnonzero(char_classes()[: 0x20000] == LETTER).tolist():
        low = chr(x).lower()
        if len(low) == 1:
            code[x] = ord(low)
    code[char_classes() != LETTER] = 0
    starts = np.array([a for a, _ in SCRIPTS])
    ids = np.array([NAMES.index(s) for _, s in SCRIPTS], np.uint8)
    return code, np.repeat(ids, np.diff(np.append(starts, 0x110000)))


def letters(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased code points or 0, scripts, trigram buckets, offsets) by character."""
    lower, script = tables()
    code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    offs = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offs]
    z = lower[code]
    one, two = np.zeros(len(z), np.uint32), np.zeros(len(z), np.uint32)
    one[1:] = z[:-1]
    begin = offs[:-1][offs[:-1] < offs[1:]]
    one[begin] = 0
    two[1:] = one[:-1]
    two[begin] = 0
    two[one == 0] = 0
    gram = mix((z.astype(U64) << U64(42)) ^ (one.astype(U64) << U64(21)) ^ two.astype(U64))
    return z, script[code], (gram & U64(BUCKETS - 1)).astype(np.int64), offs


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, slot, n): counts of buckets, then of scripts."""
    width = BUCKETS + len(NAMES)
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(1).to_pylist()
        for lo, hi, data, offs in slices(batch.column(0), 1 << 18):
            z, script, gram, offs = letters(data, offs)
            names = sorted(set(langs[lo:hi]))
            own = np.repeat([names.index(x) for x in langs[lo:hi]], np.diff(offs))
            ok = z > 0
            own, gram, script = own[ok].astype(np.int64) * width, gram[ok], script[ok]
            n = np.bincount(own + gram, minlength=len(names) * width) + np.bincount(own + BUCKETS + script, minlength=len(names) * width)
            for name, part in zip(names, n.reshape(-1, width)):
                if name in total:
                    total[name] += part
                else:
                    total[name] = part
    for name, n in total.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "slot", "n"])


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray):
        """counts: a row of bucket and script counts per language."""
        self.langs = langs
        grams = counts[:, :BUCKETS].astype(float)
        self.score = np.ascontiguousarray(np.log((grams + 0.5) / (grams.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)).T.astype(np.float32))
        uses = counts[:, BUCKETS:].astype(float)
        self.uses = (uses >= 0.01 * uses.sum(axis=1, keepdims=True)) & (uses > 0)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts over all rows of docs with a language; only the fixed-size tables of each language reach the driver."""
    slim = docs.where(F.col(lang_col).isNotNull()).select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(lang_col).alias("lang"))
    rows = arrow_map(slim, _learn, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows.lang.unique())
    counts = np.zeros((len(langs), BUCKETS + len(NAMES)), np.int64)
    counts[rows.lang.map({x: k for k, x in enumerate(langs)}).to_numpy(dtype=np.int64), rows.slot.to_numpy(dtype=np.int64)] = rows.n
    return Model(langs, counts)


def best_paths(score: np.ndarray, at: np.ndarray, penalty: float) -> np.ndarray:
    """For each row of score (a word by languages) its language on its text's best path; texts are score[at[i]:at[i+1]].

    All texts advance together, longest first."""
    length = np.diff(at)
    order = np.argsort(-length, kind="stable")
    begin, length = at[:-1][order], length[order]
    alive = len(order) - np.searchsorted(np.sort(length), np.arange(int(length.max(initial=0))), "right")
    back = np.zeros(score.shape, np.int8 if score.shape[1] < 128 else np.int32)
    own = np.arange(score.shape[1])
    now = np.zeros((len(order), score.shape[1]), np.float64)
    for j, k in enumerate(alive.tolist()):
        rows = begin[:k] + j
        v = now[:k]
        if j:
            top = v.argmax(axis=1)
            jump = v[np.arange(k), top][:, None] - penalty
            change = jump > v
            back[rows] = np.where(change, top[:, None], own)
            v = np.where(change, jump, v)
        now[:k] = v + score[rows]
    path = np.zeros(len(score), np.int64)
    state = now.argmax(axis=1)
    for j in range(len(alive) - 1, -1, -1):
        k = int(alive[j])
        rows = begin[:k] + j
        path[rows] = state[:k]
        if j:
            state[:k] = back[rows, state[:k]]
    return path


def word_scores(model: Model, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word begins, word ends, words of each text as offsets, score of each word by languages), in characters of the
    texts joined. Languages are summed one by one, so that memory grows with words, not characters, by languages."""
    z, script, gram, offs = letters(data, offs)
    begins, ends = edges_between(z > 0, offs)
    at = np.searchsorted(begins, offs)
    score = np.zeros((len(begins), len(model.langs)))
    if len(begins) and model.langs:
        inner = z > 0
        gram, edges = gram[inner], np.cumsum(ends - begins) - (ends - begins)
        for k in range(len(model.langs)):
            score[:, k] = np.add.reduceat(model.score[:, k][gram], edges, dtype=np.float64)
        score = np.round(score, 6)
        used = np.bitwise_or.reduceat(np.uint32(1) << script[inner].astype(np.uint32), edges)
        can = np.zeros((len(begins), len(model.langs)), bool)
        for k in np.unique(used).tolist():
            kinds = [s for s in range(len(NAMES)) if k >> s & 1]
            can[used == k] = model.uses[:, kinds].all(axis=1)
        can |= ~can.any(axis=1, keepdims=True)
        score = np.where(can, score, score.min(axis=1, keepdims=True) - 20.0)
    return begins, ends, at, score


def spans(model: Model, data: np.ndarray, offs: np.ndarray, penalty: float):
    """(word begins, word ends, languages, words of each text as offsets) in characters of the texts joined."""
    begins, ends, at, score = word_scores(model, data, offs)
    path = best_paths(score, at, penalty) if len(begins) and model.langs else np.zeros(len(begins), np.int64)
    return begins, ends, path, at


def _onward(score: np.ndarray, now: np.ndarray | None, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """The best sums after a piece's words from those before it (None: a text's begin), and each word's way back."""
    own, back = np.arange(score.shape[1]), np.zeros(score.shape, np.int32)
    for j, more in enumerate(score):
        if now is None:
            now, back[j] = more.copy(), own
            continue
        top = int(now.argmax())
        change = now[top] - penalty > now
        back[j] = np.where(change, top, own)
        now = np.where(change, now[top] - penalty, now) + more
    return now, back


def long_spans(model: Model, data: np.ndarray, penalty: float, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(letters, languages) of the words of one text, piece by piece from the last. Pieces end at a space, the best
    sums go from piece to piece, and the way back through a piece is found again when its turn comes."""
    cuts, gaps = [0], np.flatnonzero(data == 32)
    while len(data) - cuts[-1] > limit:
        k = int(np.searchsorted(gaps, cuts[-1] + limit, "right")) - 1
        if k < 0 or gaps[k] <= cuts[-1]:
            k = int(np.searchsorted(gaps, cuts[-1], "right"))
        if k >= len(gaps):
            break
        cuts.append(int(gaps[k]))
    cuts.append(len(data))
    piece = lambda k: word_scores(model, data[cuts[k] : cuts[k + 1]], np.array([0, cuts[k + 1] - cuts[k]]))
    before: list[np.ndarray | None] = [None]
    for k in range(len(cuts) - 1):
        score = piece(k)[3]
        before.append(_onward(score, before[-1], penalty)[0] if len(score) else before[-1])
    if before[-1] is None:
        return
    state = int(before[-1].argmax())
    for k in range(len(cuts) - 2, -1, -1):
        begins, ends, _, score = piece(k)
        back, path = _onward(score, before[k], penalty)[1].tolist() if len(score) else [], np.zeros(len(score), np.int64)
        for j in range(len(score) - 1, -1, -1):
            path[j] = state
            state = back[j][state]
        yield ends - begins, path


def _judge(model: Model, penalty: float, column: pa.Array) -> tuple[list, list, list]:
    """For each text its language, the share of that, and the number of spans. Texts of like lengths go together, as
    those of a slice advance together, word by word."""
    lang, share, runs = [], [], []
    width = max(1, len(model.langs))
    limit = max(1 << 15, (1 << 21) // max(4, width))
    order = np.argsort(np.diff(raw(column)[1]), kind="stable")
    back = np.argsort(order)
    for lo, hi, data, offs in slices(column.take(pa.array(order)), limit):
        weight, n = np.zeros((hi - lo, width)), np.zeros(hi - lo, np.int64)
        if hi - lo == 1 and len(data) > 2 * limit and model.langs:
            later = None
            for size, path in long_spans(model, data, penalty, limit):
                weight[0] += np.bincount(path, size, minlength=width)
                n[0] += int((path[1:] != path[:-1]).sum()) + (len(path) > 0 and later is not None and path[-1] != later)
                later = path[0] if len(path) else later
            n[0] += later is not None
        else:
            begins, ends, path, at = spans(model, data, offs, penalty)
            owner = np.repeat(np.arange(hi - lo), np.diff(at))
            np.add.at(weight, (owner, path), ends - begins)
            change = np.ones(len(path), bool)
            change[1:] = (path[1:] != path[:-1]) | (owner[1:] != owner[:-1])
            n = np.bincount(owner[change], minlength=hi - lo)
        best, total = weight.argmax(axis=1), weight.sum(axis=1)
        runs += n.tolist()
        lang += [model.langs[b] if t and model.langs else UNKNOWN for b, t in zip(best.tolist(), total.tolist())]
        share += (weight.max(axis=1) / np.maximum(total, 1) * (len(model.langs) > 0)).tolist()
    return [lang[k] for k in back], [share[k] for k in back], [runs[k] for k in back]


def _predict(model: Model, penalty: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, share, runs = _judge(model, penalty, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(share, pa.float64()), pa.array(runs, pa.int64())], names=["doc_id", "lang_pred", "score", "n_spans"])

    return run


def identify(docs: DataFrame, model: Model, penalty: float = 8.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, n_spans) for every row of docs, the id under its own name.

    `und` with score 0 where a text is null, empty or without letters, or where the model has no language. Ties go to
    the language first in order. Rows are independent; null ids, repeats and further columns change nothing."""
    slim = texts_of(docs, F.col(id_col).cast("long").alias("doc_id"), text_col=text_col)
    out = arrow_map(slim, _predict(model, penalty), "doc_id long, lang_pred string, score double, n_spans long")
    return out.withColumnRenamed("doc_id", id_col)


def keep_known(docs: DataFrame, model: Model, least_share: float, penalty: float = 8.0, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text has a language that reaches least_share of its letters; null and empty texts and
    those without letters go. Each row has its own verdict, whatever its id; all columns stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, share, _ = _judge(model, penalty, batch.column(batch.schema.get_field_index(text_col)))
            yield batch.filter(pa.array([x != UNKNOWN and s >= least_share for x, s in zip(lang, share)], pa.bool_()))

    return arrow_map(docs, run, docs.schema)


def label_spans(model: Model, text: str, penalty: float = 8.0) -> list[tuple[int, int, str]]:
    """(start, end, language) of the spans of a text, in code points, from first to last letter of each."""
    data = np.frombuffer(text.encode(), np.uint8)
    begins, ends, path, _ = spans(model, data, np.array([0, len(data)]), penalty)
    out: list[tuple[int, int, str]] = []
    for a, b, k in zip(begins.tolist(), ends.tolist(), path.tolist()):
        if out and out[-1][2] == model.langs[k]:
            out[-1] = (out[-1][0], b, model.langs[k])
        else:
            out.append((a, b, model.langs[k]))
    return out
